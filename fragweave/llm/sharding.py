"""Minimax contiguous sharding: atomic groups in a fixed order, cut so that the largest shard is as small as possible.

Groups are equal texts (null is a group of its own), in the order of their SHA-256 digests, null first.
The smallest feasible capacity is found by binary search, each capacity being checked greedily. The driver checks against a histogram of
the groups' running ends, of a fixed number of cells: a cell's ends lie between its first and its last, which bounds every greedy cut
from both sides. Capacities that are feasible or not by these bounds need no look at the data; the cells in which the others cut are
counted anew, finer, until one capacity and its cuts are settled. A round is one grouped sum, and each has thousands of times finer
cells. Greedy cuts at that capacity fill the first shards and may leave nothing to the last, so the order is cut evenly within it: each cut is the
first end at or beyond an equal share, unless the shard would grow beyond the capacity, the rest could not be held by the shards that
follow, or one of them would be left without a group. DataFrame operators only.

Size of a document: UTF-8 bytes of its text plus 1; a null text counts 1. Slots number the documents of a shard from 0
in the order (digest, doc_id), null doc_ids first; repeated doc_ids and rows get slots of their own. Very long texts are atomic
like others: the largest shard is no smaller than the largest group. A shard is empty only if there are fewer groups than shards: then each group
has one and the last shards are empty.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ordered_sums

#: Cells of a round of counting.
CELLS = 32768


def _counted(groups: DataFrame, spans: list[tuple[int, int]], cells: int) -> list[tuple[int, int, int]]:
    """(first, last, n) of the ends in each cell of the spans (inclusive), ascending; at most so many and one a span."""
    width = max(1, -(-sum(b - a + 1 for a, b in spans) // cells))
    place = F.lit(None).cast("long")
    for a, b in spans:
        place = F.when(F.col("end").between(a, b), F.lit(a) + F.floor((F.col("end") - a) / width) * width).otherwise(place)
    rows = groups.select("end", place.alias("cell")).filter("cell IS NOT NULL").groupBy("cell")
    return sorted(tuple(r)[1:] for r in rows.agg(F.min("end"), F.max("end"), F.count(F.lit(1))).collect())


class Ends:
    """What is known of ascending numbers: cells of (first, last, n) that hold them all."""

    def __init__(self, cells: list[tuple[int, int, int]]):
        self.cells = cells
        self.firsts = [c[0] for c in cells]
        #: Cells that were asked for a number which they do not tell.
        self.asked: set[int] = set()

    def at(self, target: int) -> int:
        """The last cell that starts at the target or before it; -1 if none does."""
        return bisect_right(self.firsts, target) - 1

    def least(self, target: int) -> int:
        """No more than the largest number up to the target, and a number or 0."""
        k = self.at(target)
        if k < 0:
            return 0
        first, last, _ = self.cells[k]
        return last if target >= last else first

    def most(self, target: int) -> int:
        """No less than it."""
        k = self.at(target)
        if k < 0:
            return 0
        first, last, n = self.cells[k]
        return last if target >= last else first if n <= 2 else target

    def floor(self, target: int) -> int:
        """The largest number up to the target, 0 if there is none; where the cell does not tell, a guess, and the cell is noted."""
        if self.least(target) != self.most(target):
            self.asked.add(self.at(target))
        return self.least(target)

    def ceil(self, target: int) -> int:
        """The smallest number from the target on, in the same way; the last number if there is none, 0 for a target up to 0."""
        k = self.at(target)
        if target <= 0:
            return 0
        if k >= 0 and target <= self.cells[k][1]:
            first, last, n = self.cells[k]
            if first < target and n > 2:
                self.asked.add(k)
            return first if first == target else last
        return self.cells[min(k + 1, len(self.cells) - 1)][0] if k + 1 < len(self.cells) else self.cells[-1][1]

    def open_at(self, low: int, high: int) -> tuple[int, int] | None:
        """The first and the last cell with unknown numbers that are met between two targets."""
        some = [k for k in range(max(0, self.at(low)), self.at(high) + 1) if self.cells[k][2] > 2]
        return (some[0], some[-1]) if some else None

    def refined(self, some: list[tuple[int, int]], count) -> Ends:
        """With these runs of cells counted anew; runs that touch are one."""
        runs: list[list[int]] = []
        for a, b in sorted(some):
            if runs and a <= runs[-1][1] + 1:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
        gone = {k for a, b in runs for k in range(a, b + 1)}
        return Ends(sorted([c for k, c in enumerate(self.cells) if k not in gone] + count([(self.cells[a][0], self.cells[b][1]) for a, b in runs])))


def _greedy(near, total: int, shards: int, capacity: int) -> list[int]:
    """Cuts of one capacity, each as far as it reaches."""
    ends, at = [], 0
    for _ in range(shards):
        at = max(at, near(min(total, at + capacity)))
        ends.append(at)
    return ends


def cuts(groups: DataFrame, shards: int, cells: int = CELLS) -> tuple[int, list[int]]:
    """The smallest capacity for which ``shards`` contiguous parts suffice, and the ends of these parts if each is filled before the next.

    ``groups`` has ``size`` (at least 1) and ``end``, its running sum in the order.
    """
    return _settled(groups, shards, cells)[:2]


def _settled(groups: DataFrame, shards: int, cells: int) -> tuple[int, list[int], Ends]:
    top = groups.agg(F.max("end"), F.max("size")).first()
    if top[0] is None:
        return 0, [0] * shards, Ends([])
    total, largest = int(top[0]), int(top[1])
    low = max(largest, -(-total // shards))  # no smaller capacity is feasible
    high = min(total, total // shards + largest)  # always feasible

    def count(spans):
        # some cells for each span at least, so that every round makes them finer
        return _counted(groups, spans, max(cells, 16 * shards))

    ends = Ends(count([(1, total)]))
    while True:
        tried = range(low, high)
        # in [low, high] lies the smallest feasible capacity: up to ``high`` some may be feasible, from there all are
        high = low + bisect_left(tried, True, key=lambda c: _greedy(ends.least, total, shards, c)[-1] >= total)
        low += bisect_left(range(low, high), True, key=lambda c: _greedy(ends.most, total, shards, c)[-1] >= total)
        least, most = _greedy(ends.least, total, shards, low), _greedy(ends.most, total, shards, high)
        if low == high and least == most:
            return high, least, ends
        starts = zip([0, *least[:-1]], [0, *most[:-1]], strict=True)
        met = [ends.open_at(min(total, a + low), min(total, b + high)) for a, b in starts]
        ends = ends.refined([m for m in met if m], count)  # a run for each cut at most


def even_cuts(groups: DataFrame, shards: int, cells: int = CELLS) -> tuple[int, list[int]]:
    """The smallest capacity, and the ends of parts that are within it and near equal; none is empty while groups are left."""
    capacity, filled, ends = _settled(groups, shards, cells)
    total = filled[-1]
    # the ends of as many last groups as there are shards
    tail = sorted(r["end"] for r in groups.select("end").orderBy(F.col("end").desc()).limit(shards).collect())
    if len(tail) < shards:
        return capacity, tail + [total] * (shards - len(tail))
    while True:
        ends.asked.clear()
        least = [total]  # where a part must end at the earliest, so that those after it hold the rest
        for _ in range(shards - 1):
            least.append(ends.ceil(least[-1] - capacity))
        least.reverse()
        out, at = [], 0
        for k in range(shards - 1):
            share = at - (at - total) // (shards - k)  # of what is left
            end = max(ends.ceil(max(share, at + 1)), least[k])
            at = min(end if end <= at + capacity else ends.floor(at + capacity), tail[k])
            out.append(at)
        if not ends.asked:
            return capacity, [*out, total]
        ends = ends.refined([(k, k) for k in sorted(ends.asked)], lambda spans: _counted(groups, spans, max(cells, 16 * len(spans))))


def shard(docs: DataFrame, shards: int = 8, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, text_key, size, text_crc32, shard, slot."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "sharding")
    data = F.encode(F.col("text"), "UTF-8")
    sized = scratch.keep(
        docs.select(
            F.col("doc_id").cast("long"),
            F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("text_key"),
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(data, F.lit(b""))).alias("text_crc32"),
        ),
        "sized",
    )
    groups = sized.groupBy("text_key").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    order = [F.col("text_key").asc_nulls_first()]
    groups = scratch.keep(ordered_sums(scratch, groups, order, {"end": "size", "n_end": "n"}).select("text_key", "size", "end", "n_end"), "groups")
    _, ends = even_cuts(groups, shards)
    # the last group of each shard: at most one row for each shard
    last = {r["end"]: (r["text_key"], r["n_end"]) for r in groups.filter(F.col("end").isin([e for e in ends if e])).collect()}
    to, first, done = F.lit(0), F.lit(0).cast("long"), 0
    for k, e in enumerate(ends[:-1]):
        if e <= done:  # an empty shard
            continue
        key, n = last[e]
        past = F.coalesce(F.col("text_key") > F.lit(bytes(key)), F.lit(False)) if key is not None else F.col("text_key").isNotNull()
        to = F.when(past, F.lit(k + 1)).otherwise(to)
        first = F.when(past, F.lit(n).cast("long")).otherwise(first)
        done = e
    ranked = ordered_sums(scratch, sized.withColumn("one", F.lit(1).cast("long")), [*order, F.col("doc_id").asc_nulls_first()], {"rank": "one"})
    return ranked.select("doc_id", "text_key", "size", "text_crc32", to.cast("int").alias("shard"), (F.col("rank") - 1 - first).alias("slot"))


def query(spark: SparkSession, docs: DataFrame, shards: int = 8) -> DataFrame:
    return shard(docs, shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
