"""FASTA in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import wrapped
from . import named, ranges
from .lines import numbered, records


def read_fasta(spark: SparkSession, path) -> DataFrame:
    """(pos, record_id, description, seq), in file order. A file is split between records, so large files are read in parallel."""
    rows = records(spark, path, "\n>").filter(F.trim("value") != "")
    head = F.trim(F.regexp_replace(F.split(F.col("value"), "\r?\n", 2)[0], "^>", ""))
    body = F.coalesce(F.get(F.split(F.col("value"), "\r?\n", 2), F.lit(1)), F.lit(""))
    out = rows.select(
        F.split(head, r"\s+")[0].alias("record_id"),
        head.alias("description"),
        F.regexp_replace(body, r"\s", "").alias("seq"),
        "_file",
        "_block",
        "_row",
    )
    return numbered(out, "pos").select("pos", "record_id", "description", "seq")


def scan_fasta(spark: SparkSession, path) -> DataFrame:
    """(record_id, description, seq, length, file, at): as ``read_fasta``, with each record's file and first byte in place of a number.

    Filters on the columns but ``seq`` reach the readers (``ranges``).
    """
    return ranges.scan(spark, path, "fasta").select("record_id", "description", "seq", "length", "file", "at")


def fasta_text(rows: DataFrame, width: int | None = None, name: str = "record_id") -> DataFrame:
    """One text value for each record, as a text writer takes it."""
    seq = F.col("seq") if width is None else wrapped(F.col("seq"), width)
    return rows.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), seq).alias("value"))


def write_fasta(rows: DataFrame, path: str, width: int | None = None, name: str = "record_id") -> None:
    fasta_text(rows, width, name).write.text(path)


def write_bins(rows: DataFrame, path: str) -> None:
    """rows: (quality, bin, record_id, seq). One folder for each quality and bin; a large bin is written by several tasks."""
    text = rows.select("quality", "bin", F.concat(F.lit(">"), F.col("record_id"), F.lit("\n"), F.col("seq")).alias("value"))
    text.hint("rebalance", "quality", "bin").write.partitionBy("quality", "bin").text(path)


def write_fasta_file(rows: DataFrame, folder: str, name: str, order: list, width: int | None = None, record: str = "record_id") -> None:
    """One file of this name, records in ``order``."""
    seq = F.col("seq") if width is None else wrapped(F.col("seq"), width)
    keys = [(F.col(c) if isinstance(c, str) else c).alias(f"_order{k}") for k, c in enumerate(order)]
    text = rows.select(F.lit(name).alias("file"), F.concat(F.lit(">"), F.col(record), F.lit("\n"), seq, F.lit("\n")).alias("value"), *keys)
    named.write(text, [f"_order{k}" for k in range(len(keys))], folder, {name: ""})


def bin_file(prefix: str = ""):
    """Of (quality, bin) the name of its file: final bins apart from those of low quality, which end in ``_seqs``."""
    final = F.concat(F.lit(f"{prefix}bins/{prefix}"), F.col("bin"), F.lit(".fasta"))
    low = F.concat(F.lit(f"{prefix}low_quality_bins/{prefix}"), F.col("bin"), F.lit("_seqs.fasta"))
    return F.when(F.col("quality") == "final", final).otherwise(low)


def write_bin_files(rows: DataFrame, folder: str, order: list, prefix: str = "") -> None:
    """rows: (quality, bin, record_id, seq) and what ``order`` needs. One file for each bin, sequences unwrapped."""
    keys = [(F.col(c) if isinstance(c, str) else c).alias(f"_order{k}") for k, c in enumerate(order)]
    text = rows.select(bin_file(prefix).alias("file"), F.concat(F.lit(">"), F.col("record_id"), F.lit("\n"), F.col("seq"), F.lit("\n")).alias("value"), *keys)
    named.write(text, [f"_order{k}" for k in range(len(keys))], folder)
