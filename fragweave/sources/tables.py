"""Abundance, coverage and marker-hit tables, and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import contig_of_gene
from . import named, ranges
from .lines import PLACE, numbered, records


def read_abundance(spark: SparkSession, path) -> DataFrame:
    """(name, coverage): a name and any number of values in each line, no header."""
    parts = F.split(F.col("value"), "\t")
    values = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.trim(x).cast("double"))
    return records(spark, path).filter(F.trim("value") != "").select(parts[0].alias("name"), values.alias("coverage"))


def read_hits(spark: SparkSession, path) -> DataFrame:
    """(line_no, target, contig, marker, qlen, hmm_from, hmm_to) of a per-domain hit table; comment lines are skipped."""
    rows = records(spark, path).filter(~F.startswith("value", F.lit("#")) & (F.trim("value") != ""))
    words = F.split(F.trim("value"), r"\s+")
    # fixed places of the format: target, query, query length, first and last position on the model
    out = rows.select(
        words[0].alias("target"),
        words[3].alias("marker"),
        words[5].cast("int").alias("qlen"),
        words[15].cast("int").alias("hmm_from"),
        words[16].cast("int").alias("hmm_to"),
        *PLACE,
    )
    return numbered(out).withColumn("contig", contig_of_gene(F.col("target")))


def scan_hits(spark: SparkSession, path) -> DataFrame:
    """(target, contig, marker, qlen, hmm_from, hmm_to, file, at): as ``read_hits``, with each line's file and first byte in place of a number.

    Filters on marker, target and the numbers reach the readers (``ranges``).
    """
    columns = ["marker", "qlen", "hmm_from", "hmm_to", "file", "at"]
    return ranges.scan(spark, path, "hits").select("target", contig_of_gene(F.col("target")).alias("contig"), *columns)


def read_coverage(spark: SparkSession, path) -> DataFrame:
    """(sample, pos, contig, coverage) of files with a header of two columns; a file's row numbers start at 0."""
    rows = records(spark, path).filter(F.trim("value") != "")
    numbers = numbered(rows.select("value", F.col("_file").alias("file"), *PLACE), "line")
    heads = numbers.groupBy("file").agg(F.min("line").alias("head"), F.min_by("value", "line").alias("title"))
    parts = F.split("value", "\t")
    return (
        numbers.join(heads, "file")
        .filter("line > head")
        .select(F.split("title", "\t")[1].alias("sample"), (F.col("line") - F.col("head") - 1).alias("pos"), parts[0].alias("contig"), parts[1].cast("double").alias("coverage"))
    )


def combine_coverage(rows: DataFrame, samples: list[str], by: str = "contig", keep_pos: bool = False) -> DataFrame:
    """One column for each sample. ``pos`` joins by row number (names are those of the first sample), ``contig`` by name.

    ``keep_pos``: with ``_pos``, the row number (by name: that of the first sample), which orders the result.
    """
    if by == "contig":
        wide = rows.groupBy("contig").pivot("sample", samples).agg(F.first("coverage")).dropna()
        return wide.join(rows.filter(F.col("sample") == samples[0]).groupBy("contig").agg(F.min("pos").alias("_pos")), "contig") if keep_pos else wide
    wide = rows.groupBy("pos").pivot("sample", samples).agg(F.first("coverage")).dropna()
    names = rows.filter(F.col("sample") == samples[0]).select("pos", "contig")
    return names.join(wide, "pos").select("contig", *samples, *([F.col("pos").alias("_pos")] if keep_pos else []))


def _cell(value, delimiter: str):
    """Quoted only where it has to be."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    special = text.contains(delimiter) | text.contains('"') | text.contains("\n") | text.contains("\r")
    return F.when(special, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def table_lines(columns: list[str], delimiter: str = ",", crlf: bool = False):
    """A row's columns as a line with minimal quoting and its line end."""
    return F.concat(F.concat_ws(delimiter, *[_cell(F.col(c), delimiter) for c in columns]), F.lit("\r\n" if crlf else "\n"))


def write_table(rows: DataFrame, path: str, delimiter: str = ",", header: bool = False, crlf: bool = False) -> None:
    """A folder of parts of delimited text with minimal quoting; ``crlf``: lines end in carriage return and line feed."""
    if header:
        rows.write.csv(path, sep=delimiter, header=True)
        return
    cells = F.concat_ws(delimiter, *[_cell(F.col(c), delimiter) for c in rows.columns])
    rows.select(F.concat(cells, F.lit("\r" if crlf else "")).alias("value")).write.text(path)


def write_table_file(rows: DataFrame, folder: str, name: str, order: list, delimiter: str = ",", header: bool = False, crlf: bool = False, columns: list[str] | None = None) -> None:
    """One file of this name with all or the given columns, rows in ``order``; ``header`` puts the columns' names before them."""
    columns = columns or rows.columns
    end = "\r\n" if crlf else "\n"
    keys = [(F.col(c) if isinstance(c, str) else c).alias(f"_order{k}") for k, c in enumerate(order)]
    lines = rows.select(F.lit(name).alias("file"), table_lines(columns, delimiter, crlf).alias("value"), *keys)
    named.write(lines, [f"_order{k}" for k in range(len(keys))], folder, {name: delimiter.join(columns) + end if header else ""})
