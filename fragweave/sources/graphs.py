"""Assembly graphs: segments and links of GFA, contig paths of two assemblers.

Links are (a, b) as written; whoever needs both directions takes ``both_ways``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sequences import number_in, sanitize
from ..scratch import Tables
from . import ranges
from .lines import PLACE, numbered, records


def _tab(k: int) -> Column:
    return F.get(F.split(F.col("value"), "\t"), F.lit(k))


def _word(k: int) -> Column:
    return F.get(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " "), F.lit(k))


def read_segments(spark: SparkSession, path, route: str = "custom") -> DataFrame:
    """(contig_id, name, seq) of the S lines, numbered in file order. ``megahitc`` names lose their last two characters."""
    rows = records(spark, path).filter(F.startswith("value", F.lit("S")))
    name = _word(1)
    if route == "megahitc":
        name = F.left(name, F.length(name) - 2)
    return numbered(rows.select(name.alias("name"), _word(2).alias("seq"), *PLACE), "contig_id").select("contig_id", "name", "seq")


def read_links(spark: SparkSession, path, route: str = "custom") -> DataFrame:
    """(a, b) of the L lines, without orientation; self-links stay only on the ``megahit`` route."""
    links = records(spark, path).filter(F.startswith("value", F.lit("L"))).select(_tab(1).alias("a"), _tab(3).alias("b"))
    return links if route == "megahit" else links.filter("a <> b")


def read_oriented_links(spark: SparkSession, path, style: str, anywhere: bool = False) -> DataFrame:
    """(a, b) with orientation. ``suffix``: name and sign. ``prefix``: names lose ``edge_`` and get - when reversed.

    ``anywhere`` takes every line that holds an L, as some tools do, instead of L lines.
    """
    rows = records(spark, path)
    rows = rows.filter(F.contains("value", F.lit("L")) if anywhere else F.startswith("value", F.lit("L")))

    def end(k: int) -> Column:
        if style == "suffix":
            return F.concat(_tab(k), _tab(k + 1))
        bare = F.substr(_tab(k), F.lit(6))
        return F.when(_tab(k + 1) == "-", F.concat(F.lit("-"), bare)).otherwise(bare)

    return rows.select(end(1).alias("a"), end(3).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")


def both_ways(links: DataFrame, once: bool = True) -> DataFrame:
    """``once``: no link is repeated, at the price of a shuffle."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.distinct() if once else both


def read_spades_paths(spark: SparkSession, path, compat: bool = True) -> DataFrame:
    """(contig_id, number, name, reverse, pos, segment): the oriented segments of each path record.

    A record is a header and its path lines; all lines but the last end in a semicolon. ``compat``: the first line
    of several also loses its last segment's sign, as in the tool whose results are matched.
    Numbers are given in file order to the first of consecutive records with one contig number.
    """
    rows = records(spark, path, "\nNODE_").filter(F.trim("value") != "")
    text = F.regexp_replace(F.regexp_replace("value", "^(NODE_)?", "NODE_"), r"\s+$", "")
    lines = F.split(text, "\r?\n")
    rows = rows.select(F.trim(lines[0]).alias("header"), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))).alias("parts"), *PLACE)
    # only what stands before a blank line counts
    blank = F.array_position("parts", "").cast("int")
    rows = rows.withColumn("parts", F.when(blank > 0, F.slice("parts", F.lit(1), F.greatest(blank - 1, F.lit(0)))).otherwise(F.col("parts")))
    return _oriented_segments(rows, compat)


def scan_spades_paths(spark: SparkSession, path, compat: bool = True) -> DataFrame:
    """As ``read_spades_paths``, records cut and parsed by ranges of bytes (``ranges``)."""
    rows = ranges.scan(spark, path, "paths").select("header", "parts", F.col("file").alias("_file"), F.col("block").alias("_block"), F.col("at").alias("_row"))
    return _oriented_segments(rows, compat)


def _oriented_segments(rows: DataFrame, compat: bool) -> DataFrame:
    bare = F.transform("parts", lambda p: F.regexp_replace(F.trim(p), ";$", ""))
    if compat:
        first = F.transform(F.slice("parts", 1, 1), lambda p: F.when(F.endswith(F.trim(p), F.lit(";")), F.left(F.trim(p), F.length(F.trim(p)) - 2)).otherwise(F.trim(p)))
        bare = F.concat(first, F.slice(bare, F.lit(2), F.greatest(F.size("parts") - 1, F.lit(0))))
    rows = numbered(rows.withColumn("segments", F.split(F.array_join(bare, ","), ",")), "record")
    rows = rows.withColumn("name", F.regexp_replace("header", "'$", "")).withColumn("reverse", F.endswith("header", F.lit("'")))
    rows = rows.withColumn("number", number_in(F.col("name")))
    return contig_numbers(rows).select("contig_id", "number", "name", "reverse", "record", F.posexplode("segments").alias("pos", "segment"))


def contig_numbers(rows: DataFrame) -> DataFrame:
    """rows: (number, record). Adds contig_id: the rank, in file order, of a number's first appearance."""
    first = rows.groupBy("number").agg(F.min("record").alias("_first"))
    ids = Tables(rows.sparkSession, "contigs").ordinals(first, ["_first"], "contig_id")
    return rows.join(ids.select("number", F.col("contig_id").cast("int")), "number")


def run_starts(rows: DataFrame, value: str, order: str, partition: list[str] = ()) -> DataFrame:
    """Rows at which the value differs from the one before."""
    w = Window.partitionBy(*partition).orderBy(order)
    return rows.withColumn("_before", F.lag(value).over(w)).filter(~F.col(value).eqNullSafe(F.col("_before"))).drop("_before")


def first_paths(paths: DataFrame) -> DataFrame:
    """Of several records of a contig number the first in the file."""
    first = paths.groupBy("number").agg(F.min("record").alias("record"))
    return paths.join(first, ["number", "record"], "left_semi")


def read_flye_paths(spark: SparkSession, path) -> DataFrame:
    """(name, pos, segment) of an assembly table: first and last column, stars removed, commas trimmed once at each end."""
    rows = records(spark, path).filter(~F.startswith("value", F.lit("#")) & (F.trim("value") != ""))
    words = F.split(F.trim("value"), r"\s+")
    joined = F.regexp_replace(F.regexp_replace(F.replace(F.element_at(words, -1), F.lit("*"), F.lit("")), "^,", ""), ",$", "")
    return rows.select(words[0].alias("name"), F.posexplode(F.split(joined, ",")).alias("pos", "segment"))


def segments_to_fasta(spark: SparkSession, path, place: bool = False) -> DataFrame:
    """(record_id, seq): the sanitized segments of every line that holds an S, as a FASTA writer takes them; with their ``place`` if asked."""
    rows = records(spark, path).filter(F.contains("value", F.lit("S")) & F.get(F.split("value", "\t"), F.lit(2)).isNotNull())
    return rows.select(_tab(1).alias("record_id"), sanitize(_tab(2)).alias("seq"), *(PLACE if place else ()))
