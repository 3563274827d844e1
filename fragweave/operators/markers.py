"""Marker hits, marker tables, and the order in which markers are worked off."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def passing_hits(hits: DataFrame, contigs: DataFrame | None, min_length: int, share: float) -> DataFrame:
    """Hits that cover more than a share of the marker, on contigs that are long enough (any, without ``contigs``).

    hits: (line_no, contig, marker, qlen, hmm_from, hmm_to). contigs: (contig_id, name, length).
    """
    good = hits.filter((F.col("hmm_to") - F.col("hmm_from")) > F.col("qlen") * F.lit(float(share)))
    if contigs is None:
        return good
    long = contigs.filter(F.col("length") >= min_length).select("contig_id", F.col("name").alias("contig"), "length")
    return good.join(long, "contig")


def marker_contigs(hits: DataFrame, contig: str = "contig_id") -> DataFrame:
    """(marker, contigs, n, first_seen): distinct contigs in the order in which they were first seen."""
    each = hits.groupBy("marker", contig).agg(F.min("line_no").alias("seen"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seen", F.col(contig).alias("c")))), lambda s: s["c"])
    return each.groupBy("marker").agg(ordered.alias("contigs"), F.count(F.lit(1)).alias("n"), F.min("seen").alias("first_seen"))


def contig_markers(hits: DataFrame, contig: str = "contig_id") -> DataFrame:
    """(contig, markers): the distinct markers of each contig, sorted."""
    return hits.groupBy(contig).agg(F.array_sort(F.collect_set("marker")).alias("markers"))


def marker_histogram(by_marker: DataFrame) -> DataFrame:
    """(n, n_markers), most contigs first."""
    return by_marker.groupBy("n").agg(F.count(F.lit(1)).alias("n_markers")).orderBy(F.col("n").desc())


def gene_counts(by_marker: DataFrame) -> DataFrame:
    """The distinct numbers of contigs, descending."""
    return by_marker.select("n").distinct().orderBy(F.col("n").desc())


def marker_order(hits: DataFrame, contig: str = "contig_id") -> DataFrame:
    """(step, marker, n, total): most contigs first, then most markers over these contigs, then first seen.

    One row for each marker: bounded by the marker set, whatever the data.
    """
    pairs = hits.groupBy("marker", contig).agg(F.min("line_no").alias("seen"))
    sizes = pairs.groupBy(contig).agg(F.count(F.lit(1)).alias("m"))
    each = pairs.join(sizes, contig).groupBy("marker").agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("total"), F.min("seen").alias("first_seen"))
    order = Window.orderBy(F.col("n").desc(), F.col("total").desc(), "first_seen")
    return each.select((F.row_number().over(order) - 1).alias("step"), "marker", "n", "total")


def seed_bins(hits: DataFrame, contig: str = "contig_id") -> DataFrame:
    """(bin_id, contig): the contigs of the first marker, in first-seen order."""
    first = marker_order(hits, contig).filter("step = 0").select("marker")
    rows = hits.join(F.broadcast(first), "marker").groupBy(contig).agg(F.min("line_no").alias("seen"))  # one row is broadcast
    return rows.select((F.row_number().over(Window.orderBy("seen")) - 1).alias("bin_id"), contig)
