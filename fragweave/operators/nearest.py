"""The most similar bin for each row, by an exact index over any number of bins.

A weight is at least what the distance of the profiles alone gives, since no coverage probability exceeds 1, and that grows with the distance.
So a weight that is not to be exceeded is a radius around a row's profile (``radius``), and bins outside it need no scoring.

Bins go to the nearest of a few pivots (bins themselves) and are laid in blocks by their distance to it. By the triangle inequality a block is
of use only where its distances overlap with the row's distance to the pivot, give or take the radius: a range join with the blocks' bounds, whose number is
at most ``BLOCKS + PIVOTS`` and which are broadcast. Blocks are joined by their number, and a bin in a block is scored only if its own
distance allows it. A block that many rows need is one row on its side, so the other side can be split. Rounding is met by slack in the radius.
Where vectors are whole, ``boxes`` takes the coverage into the bounds as well and forms weights in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import MAX_WEIGHT, MU_INTER, SIGMA_INTER, SIGMA_INTRA, euclidean, pair_weight
from ..scratch import Tables, spread
from . import boxes

#: Bins up to which a row meets them all in place.
DENSE = 64
PIVOTS = 32
#: Bins in a block, unless there would be more than ``BLOCKS`` blocks.
BLOCK, BLOCKS = 128, 16_384
#: Bins up to which the blocks themselves travel to the rows (1 KB each for 4-mers).
TRAVEL = 20_000
SLACK = 1e-9
#: Beyond this distance the density of one genome vanishes in doubles, and the weight is the largest.
FARTHEST = 39 * SIGMA_INTRA
#: Above any weight of a pair within ``FARTHEST``.
FARTHEST_WEIGHT = 700.0


def radius(weight: Column) -> Column:
    """The largest distance of two profiles whose weight can be as small as this; negative where none can."""
    a = 1 / (2 * SIGMA_INTRA**2) - 1 / (2 * SIGMA_INTER**2)
    b = MU_INTER / SIGMA_INTER**2
    # ln(10^w - 1), the logarithm of the odds of the other density
    odds = weight * F.lit(math.log(10)) + F.log1p(-F.pow(F.lit(10.0), -weight))
    c = F.lit(math.log(SIGMA_INTRA / SIGMA_INTER) - MU_INTER**2 / (2 * SIGMA_INTER**2)) - odds
    inside = F.lit(b * b) - F.lit(4 * a) * c
    root = (F.sqrt(F.greatest(inside, F.lit(0.0))) - F.lit(b)) / F.lit(2 * a)
    near = F.when((weight > 0) & (inside >= 0), root * (1 + SLACK) + SLACK).otherwise(F.lit(-1.0))
    return F.when(weight >= FARTHEST_WEIGHT, F.lit(FARTHEST)).otherwise(F.least(near, F.lit(FARTHEST)))


@dataclass(frozen=True)
class Other:
    """Which bins a row may have: not the one in its column ``own``, and, with ``unlike``, none that shares a value of this list with the row's struct ``_a``."""

    own: str
    unlike: str | None = None

    def __call__(self, b: Column) -> Column:
        other = b["bin_id"] != F.col(self.own)
        return other if self.unlike is None else other & ~F.arrays_overlap(b[self.unlike], F.col(f"_a.{self.unlike}"))


@dataclass
class Index:
    #: One row: ``_pivots``, structs of (bin_id, profile, coverage).
    pivots: DataFrame
    #: (_q, _block, _bins): a pivot's bins in blocks, structs with the distance ``_d`` to it.
    blocks: DataFrame
    #: (_q, _block, _lo, _hi): the blocks' bounds.
    bounds: DataFrame
    n: int


def _nearest(profile: Column) -> Column:
    return F.array_min(F.transform("_pivots", lambda p: F.struct(euclidean(p["profile"], profile).alias("d"), p["bin_id"].alias("q"))))


def index(bins: DataFrame, n: int, kept: Tables) -> Index:
    """bins: (bin_id, profile, coverage), further columns go into the blocks; ``n``: how many there are."""
    first = bins.select("bin_id", "profile", "coverage").orderBy(F.xxhash64("bin_id"), "bin_id").limit(PIVOTS)
    pivots = kept.keep(first.agg(F.collect_list(F.struct("bin_id", "profile", "coverage")).alias("_pivots")), "pivots")
    at = spread(bins).join(F.broadcast(pivots)).withColumn("_near", _nearest(F.col("profile"))).drop("_pivots")
    ranked = kept.ordinals(at.select("*", F.col("_near.q").alias("_q"), F.col("_near.d").alias("_d")).drop("_near"), ["_q", "_d", "bin_id"], "_no")
    size = max(BLOCK, -(-n // BLOCKS))
    own = F.struct("_d", *bins.columns)
    blocks = ranked.groupBy("_q", F.floor(F.col("_no") / size).alias("_block")).agg(F.collect_list(own).alias("_bins"), F.min("_d").alias("_lo"), F.max("_d").alias("_hi"))
    blocks = kept.keep(blocks, "blocks")
    return Index(pivots, blocks.select("_q", "_block", "_bins"), blocks.select("_q", "_block", "_lo", "_hi"), n)


def candidates(rows: DataFrame, found: Index, limit: float | None) -> DataFrame:
    """The rows with ``_r``, and for each block that may hold a bin within it (_q, _block) and the distance ``_dq`` to its pivot.

    The weight not to be exceeded is ``limit``, or the smallest of a row's weights to the pivots.
    """
    near = spread(rows).join(F.broadcast(found.pivots))
    if limit is None:
        seen = F.transform("_pivots", lambda p: F.coalesce(pair_weight(F.col("profile"), F.col("coverage"), p["profile"], p["coverage"]), F.lit(MAX_WEIGHT)))
        near = near.withColumn("_r", radius(F.array_min(seen)))
    else:
        near = near.withColumn("_r", radius(F.lit(float(limit))))
    to = F.transform("_pivots", lambda p: F.struct(p["bin_id"].alias("_q"), euclidean(p["profile"], F.col("profile")).alias("_dq")))
    near = near.filter("_r >= 0").select(*rows.columns, "_r", F.inline(to))
    within = (F.col("_lo") <= F.col("_dq") + F.col("_r")) & (F.col("_hi") >= F.col("_dq") - F.col("_r"))
    return near.join(F.broadcast(found.bounds), "_q").filter(within).drop("_lo", "_hi")


def best(rows: DataFrame, key: str, bins: DataFrame, kept: Tables | None = None, limit: float | None = None, allowed: Callable[[Column], Column] | None = None, dense: int = DENSE) -> DataFrame:
    """(key, bin_id, weight): the bin of the smallest weight, the smaller id on ties; rows without one below the largest double are left out.

    rows: (key, profile, coverage) and what ``allowed`` needs, each key once. bins: (bin_id, profile, coverage) and what ``allowed``, given a bin as a struct, needs.
    ``limit``: no weight above it.
    """

    def lowest(own: Column) -> Column:
        """Of an array of bins."""
        own = F.filter(own, allowed) if allowed else own
        each = F.transform(own, lambda b: F.struct(F.coalesce(pair_weight(F.col("profile"), F.col("coverage"), b["profile"], b["coverage"]), F.lit(MAX_WEIGHT)).alias("weight"), b["bin_id"].alias("bin_id")))
        return F.array_min(F.filter(each, lambda s: s["weight"] <= limit) if limit is not None else each)

    n = bins.count()
    if n > dense and (allowed is None or isinstance(allowed, Other)):
        kept = kept or Tables(rows.sparkSession, "nearest")
        rows, bins = (t.filter("profile IS NOT NULL AND coverage IS NOT NULL") for t in (rows, bins))
        if boxes.fits(rows, bins, key):
            unlike = allowed.unlike if allowed else None
            return boxes.best(rows, key, bins, n, kept, limit, allowed.own if allowed else None, (f"_a.{unlike}", unlike) if unlike else None)
    if n <= dense:
        every = bins.agg(F.collect_list(F.struct(*bins.columns)).alias("_bins"))  # one row, of checked size
        out = spread(rows).join(F.broadcast(every)).select(key, lowest(F.col("_bins")).alias("_b"))
    else:
        found = index(bins, n, kept or Tables(rows.sparkSession, "nearest"))
        blocks = F.broadcast(found.blocks) if n <= TRAVEL else found.blocks
        met = candidates(rows, found, limit).join(blocks, ["_q", "_block"])
        ring = F.filter("_bins", lambda b: F.abs(b["_d"] - F.col("_dq")) <= F.col("_r"))
        out = met.select(key, lowest(ring).alias("_b")).groupBy(key).agg(F.min("_b").alias("_b"))
    return out.filter(F.col("_b").isNotNull() & (F.col("_b.weight") < MAX_WEIGHT)).select(key, "_b.bin_id", "_b.weight")


def best_other(bins: DataFrame, limit: float | None = None, unlike: str | None = None, kept: Tables | None = None) -> DataFrame:
    """(own, bin_id, weight): each bin's nearest other bin, the smaller id on ties, as ``best`` finds it.

    bins: (bin_id, profile, coverage), and ``unlike`` if given: a list in which two bins may have no value in common. Bins that agree in all but their id are one
    class and are met once: what is scored grows with the pairs of classes, however many copies they have.
    """
    kept = kept or Tables(bins.sparkSession, "classes")
    further = [c for c in bins.columns if c not in ("bin_id", "profile", "coverage")]
    alike = F.struct("profile", "coverage", *further)
    # of the copies two ids are of use: the smallest, and for that one another
    classes = bins.groupBy(alike.alias("_a")).agg(F.min("bin_id").alias("_least"))
    nexts = bins.select("bin_id", alike.alias("_a")).join(classes, "_a").filter("bin_id > _least").groupBy("_least").agg(F.min("bin_id").alias("_next"))
    classes = kept.keep(classes.join(nexts, "_least", "left"), "classes")
    extra = [F.col(f"_a.{c}").alias(c) for c in further]
    rows = classes.select(F.col("_least").alias("_class"), "_a", "_a.profile", "_a.coverage")
    every = classes.select(F.col("_least").alias("bin_id"), "_a.profile", "_a.coverage", *extra)

    allowed = Other("_class", unlike)
    found = best(rows, "_class", every, kept, limit, allowed).select(F.col("_class").alias("_least"), F.struct("weight", "bin_id").alias("_b"))
    own = F.coalesce(pair_weight(F.col("_a.profile"), F.col("_a.coverage"), F.col("_a.profile"), F.col("_a.coverage")), F.lit(MAX_WEIGHT))
    may = F.col("_next").isNotNull() & (own < MAX_WEIGHT)
    if limit is not None:
        may = may & (own <= limit)
    if unlike:
        may = may & ~F.arrays_overlap(f"_a.{unlike}", f"_a.{unlike}")
    told = classes.join(found, "_least", "left").select("_a", "_least", "_next", "_b", F.when(may, own).alias("_own"))
    each = bins.select(F.col("bin_id").alias("own"), alike.alias("_a")).join(told, "_a")
    copy = F.when(F.col("_own").isNotNull(), F.struct(F.col("_own").alias("weight"), F.when(F.col("own") == F.col("_least"), F.col("_next")).otherwise(F.col("_least")).alias("bin_id")))
    return each.select("own", F.least("_b", copy).alias("_b")).filter("_b IS NOT NULL").select("own", "_b.bin_id", "_b.weight")
