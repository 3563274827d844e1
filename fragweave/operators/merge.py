"""Bins that belong together, output bins and their quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Tables
from . import nearest

def merge_neighbours(bins: DataFrame, w_intra: float, kept: Tables | None = None) -> DataFrame:
    """(bin_id, partner, weight): the most similar bin without a common marker, the smaller id on ties.

    bins: (bin_id, markers, profile, coverage), any number of them (``nearest.best_other``).
    """
    found = nearest.best_other(bins.select("bin_id", "markers", "profile", "coverage"), w_intra, "markers", kept)
    return found.select(F.col("own").alias("bin_id"), F.col("bin_id").alias("partner"), "weight")


def cliques(bins: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(clique, bins): linked pairs and single bins. Nearest neighbours by a symmetric weight form a forest, so there are no larger cliques."""
    pairs = neighbours.select(F.least("bin_id", "partner").alias("a"), F.greatest("bin_id", "partner").alias("b")).distinct()
    linked = pairs.select(F.explode(F.array("a", "b")).alias("bin_id")).distinct()
    single = bins.select("bin_id").join(linked, "bin_id", "left_anti").select(F.array("bin_id").alias("bins"))
    every = pairs.select(F.array("a", "b").alias("bins")).union(single)
    return every.select(F.concat_ws("_", F.transform("bins", lambda b: b.cast("string"))).alias("clique"), "bins")


def bin_sizes(members: DataFrame, lengths: DataFrame) -> DataFrame:
    """(bin_id, size): bases of a bin. members: (bin_id, contig_id); lengths: (contig_id, length)."""
    return members.select("bin_id", "contig_id").join(lengths.select("contig_id", "length"), "contig_id").groupBy("bin_id").agg(F.sum("length").cast("long").alias("size"))


def judged(groups: DataFrame, sizes: DataFrame, bins: DataFrame, n_mg: int, bin_mg_threshold: float, min_bin_size: int) -> DataFrame:
    """(clique, bins, size, weak, quality): ``final`` or ``low``.

    Weak: a bin alone, with fewer markers than a share of ``n_mg``. Low: weak, or fewer than ``min_bin_size`` bases.
    bins: (bin_id, markers).
    """
    each = groups.select("clique", "bins", F.explode("bins").alias("bin_id")).join(sizes, "bin_id", "left").join(bins.select("bin_id", F.size("markers").alias("m")), "bin_id", "left")
    sums = each.groupBy("clique", "bins").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.sum("m").alias("m"))
    weak = (F.size("bins") == 1) & (F.coalesce("m", F.lit(0)) < F.lit(n_mg * bin_mg_threshold))
    quality = F.when(weak | (F.col("size") < min_bin_size), "low").otherwise("final")
    return sums.select("clique", "bins", "size", weak.alias("weak"), quality.alias("quality"))


def results(groups: DataFrame, members: DataFrame) -> DataFrame:
    """(contig_id, clique, quality): a contig's row for each clique of its bin."""
    return groups.select("clique", "quality", F.explode("bins").alias("bin_id")).join(members.select("bin_id", "contig_id"), "bin_id").select("contig_id", "clique", "quality")


def final_of(rows: DataFrame) -> DataFrame:
    """One row for each contig: final before low, then the last clique by name."""
    order = Window.partitionBy("contig_id").orderBy((F.col("quality") == "final").desc(), F.col("clique").desc())
    return rows.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def with_sequences(sequences: DataFrame, finals: DataFrame) -> DataFrame:
    """(quality, bin, record_id, seq) of the sequences that are in an output bin. sequences: (contig_id, record_id, seq), further columns stay."""
    return sequences.join(finals, "contig_id").select("quality", F.concat(F.lit("bin_"), F.col("clique")).alias("bin"), *[c for c in sequences.columns if c != "contig_id"])
