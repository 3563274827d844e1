"""python -m fragweave bin|combine-coverage|gfa-to-fasta: the three commands over files."""

from __future__ import annotations

import argparse
import dataclasses
import logging
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans import binning
from .sources import fasta, graphs, named, tables
from .sources.lines import PLACE


def arguments(argv: list[str]) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="fragweave")
    commands = top.add_subparsers(dest="command", required=True)
    one = commands.add_parser("bin", help="assign contigs to bins")
    for f in dataclasses.fields(binning.Params):
        flag = f"--{f.name.replace('_', '-')}"
        if f.name == "compat":
            one.add_argument(flag, action=argparse.BooleanOptionalAction, default=True)
            continue
        needed = f.default is dataclasses.MISSING
        kind = str if needed or f.default is None else type(f.default)
        one.add_argument(flag, type=kind, required=needed, default=None if needed else f.default)
    one.add_argument("--output", required=True)
    one = commands.add_parser("combine-coverage", help="one table from one file for each sample")
    one.add_argument("--covpath", required=True)
    one.add_argument("--output", required=True)
    one.add_argument("--by", choices=("contig", "pos"), default="pos")
    one = commands.add_parser("gfa-to-fasta", help="the segments of a graph as FASTA")
    one.add_argument("--graph", required=True)
    one.add_argument("--output", required=True)
    return top.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    args = vars(arguments(sys.argv[1:] if argv is None else argv))
    command, output = args.pop("command"), args.pop("output")
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if "://" not in output:  # a folder of the driver's machine: the log goes there too
        os.makedirs(output, exist_ok=True)
        handlers.append(logging.FileHandler(os.path.join(output, f"{args.get('prefix') or ''}fragweave.log")))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s", handlers=handlers, force=True)
    spark = SparkSession.builder.appName(f"fragweave {command}").getOrCreate()
    if command == "bin":
        try:
            p = binning.Params(**args)
        except ValueError as e:
            print(e, file=sys.stderr)
            return 1
        binning.write(binning.run(spark, p), output, p)
    elif command == "combine-coverage":
        rows = tables.read_coverage(spark, f"{args['covpath'].rstrip('/')}/*.tsv")
        samples = [r["sample"] for r in rows.select("sample").distinct().orderBy("sample").collect()]  # one for each file
        out = tables.combine_coverage(rows, samples, args["by"], keep_pos=True).withColumnRenamed("contig", "Contig")
        columns = ["Contig", *samples]
        for name, header in (("coverage", False), ("coverage_with_header", True)):
            if named.usable(output):
                tables.write_table_file(out, output, f"{name}.tsv", ["_pos"], "\t", header, columns=columns)
            else:
                tables.write_table(out.select(columns), f"{output}/{name}", "\t", header)
    else:
        rows = graphs.segments_to_fasta(spark, args["graph"], place=True).filter(F.col("seq") != "")
        if named.usable(output):
            fasta.write_fasta_file(rows, output, "edges.fasta", list(PLACE), width=60)
        else:
            fasta.write_fasta(rows, f"{output}/edges", width=60)
    return 0


if __name__ == "__main__":
    sys.exit(main())
