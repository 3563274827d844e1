"""Lempel-Ziv phrase fingerprints: parse a text into dictionary phrases, hash the phrase set, keep the smallest hashes.

The parse is that of LZ78 over code points: each phrase is the shortest piece, from where the last one ended, that was no phrase
before. Phrases are hashed whole; the fingerprint is the bottom ``SIZE`` of the scrambled hashes, 32 bits each, ascending, as
hexadecimal digits. Two fingerprints are as alike as the share of the smallest ``SIZE`` of their union that both hold:
an estimate of the Jaccard similarity of the phrase sets, 1 for equal texts. Two empty texts are alike (1); an empty one
and another are not (0). Null texts count as empty.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, partitions
from .shingles import scramble

SIZE = 64
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 1 << 14


def _powers() -> tuple[np.ndarray, np.ndarray]:
    back = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, back):
        p = np.ones(_STEP, np.uint64)
        with np.errstate(over="ignore"):
            p[1:] = np.multiply.accumulate(np.full(_STEP - 1, base, np.uint64))
        out.append(p)
    return out[0], out[1]


_UP, _DOWN = _powers()


def parse(text: str, known: set[str], ends: list[int], offset: int = 0, open_at: int = 0, whole: str | None = None) -> int:
    """Goes on parsing ``text`` with the phrases ``known``: adds phrases and their ends, and returns where the last, unended piece starts.

    The piece in progress is ``whole[open_at:offset]``; ``text`` stands at ``offset``.
    """
    piece = "" if whole is None else whole[open_at:offset]
    start, add, end = open_at, known.add, ends.append
    for k, c in enumerate(text, offset + 1):
        piece += c
        if piece not in known:
            add(piece)
            end(k)
            piece = ""
            start = k
    return start


def phrase_hashes(text: str, ends: list[int], rest: int) -> np.ndarray:
    """Distinct hashes of the phrases ``text[a:b]`` between ends, and of what is left from ``rest`` on.

    Polynomials of the code points, taken from prefix sums that start anew every so often, so that powers stay few.
    """
    cut = [*ends, len(text)] if rest < len(text) else list(ends)
    if not cut:
        return np.zeros(0, np.uint64)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    b = np.array(cut, np.int64)
    a = np.concatenate([[0], b[:-1]])
    with np.errstate(over="ignore"):
        out = np.zeros(len(b), np.uint64)
        for low in range(0, len(codes), _STEP):
            part = codes[low : low + _STEP]
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * _UP[: len(part)])])
            x, y = np.searchsorted(a, low), np.searchsorted(a, low + len(part))
            inside = b[x:y] <= low + len(part)
            s, e = a[x:y][inside] - low, b[x:y][inside] - low
            out[x:y][inside] = (sums[e] - sums[s]) * _DOWN[s]
            for k in np.flatnonzero(~inside) + x:  # a phrase across the seam: at most one
                h = 0
                for i, c in enumerate(codes[a[k] : b[k]].tolist()):
                    h = (h + c * pow(_BASE, i, 1 << 64)) & 0xFFFFFFFFFFFFFFFF
                out[k] = h
        return scramble(out + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def bottom(hashes: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The smallest distinct hashes, 32 bits each."""
    h = np.unique((hashes >> np.uint64(32)).astype(np.uint32))
    return h[:size]


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:size]
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.count_nonzero(both <= union[-1]) / len(union))


def fingerprint(text: str, size: int = SIZE) -> np.ndarray:
    known: set[str] = set()
    ends: list[int] = []
    rest = parse(text, known, ends)
    return bottom(phrase_hashes(text, ends, rest), size)


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def both_fingerprints(text: str, following: str, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, str]:
    """Of a text and its edited text: the part that they share is parsed once."""
    changed = edited(text, following)
    shared = len(text) - len(text) // 2
    known: set[str] = set()
    ends: list[int] = []
    open_at = parse(text[:shared], known, ends)
    also, ends_also = set(known), list(ends)
    rest = parse(text[shared:], known, ends, shared, open_at, text)
    rest_also = parse(changed[shared:], also, ends_also, shared, open_at, changed)
    return bottom(phrase_hashes(text, ends, rest), size), bottom(phrase_hashes(changed, ends_also, rest_also), size), changed


def _hex(a: np.ndarray) -> str:
    return a.astype(">u4").tobytes().hex()


_OUT = [("doc_id", "long"), ("n_chars", "long"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double")]
_ARROW = {"long": "int64", "string": "string", "double": "double"}


def _placed(scratch: Scratch, rows: DataFrame, parts: int) -> tuple[DataFrame, list[tuple]]:
    """rows: (doc_id, text). Adds last, down and h, by which all rows are in order, and p, the range of that order; and the ranges' first keys.

    The order goes by the inverted doc_id and then by a hash of the text, so that a hot or null id spans many ranges. Bounds
    come from the keys alone.
    """
    keyed = rows.select("doc_id", "text", F.col("doc_id").isNull().alias("last"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).alias("down"), F.xxhash64("text").alias("h"))
    keys = scratch.keep(keyed.select("last", "down", "h"), "keys")
    dealt = keys.repartitionByRange(parts, "last", "down", "h").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("last", "down", "h")).alias("head"))
    # one for each range: their number is fixed
    heads = sorted({tuple(r["head"]) for r in dealt.collect()})
    key = F.struct("last", "down", "h")

    def part(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high + 1) // 2
        bound = F.struct(F.lit(heads[mid][0]).alias("last"), F.lit(heads[mid][1]).cast("long").alias("down"), F.lit(heads[mid][2]).cast("long").alias("h"))
        return F.when(key >= bound, part(mid, high)).otherwise(part(low, mid - 1))

    return keyed.withColumn("p", part(0, max(0, len(heads) - 1))), heads


def compare_neighbours(docs: DataFrame, size: int = SIZE, scratch: Scratch | None = None) -> DataFrame:
    """One row for each document, in descending order of doc_id (null last, equal ids by a hash of the text; the last's next is the first).

    Texts are dealt once, by ranges of that order; the first document of a range also goes to the range before it, so that
    the last one there meets its next. Within a range documents stream by, one text held at a time, however long.
    An empty table gives an empty result; columns besides doc_id and text are ignored.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "phrases")
    n = partitions(spark)
    placed, heads = _placed(scratch, docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), 4 * n)
    # the first row of each range, one of equal ones, is the guest of the range before; the first range comes round to the last
    table = spark.createDataFrame([(*key, (k - 1) % len(heads)) for k, key in enumerate(heads)], "l boolean, d long, x long, before int")
    firsts = placed.join(F.broadcast(table), (F.col("last") == F.col("l")) & (F.col("down") == F.col("d")) & (F.col("h") == F.col("x")))
    guests = firsts.groupBy("before").agg(F.min(F.struct("text", "doc_id")).alias("g")).select("g.doc_id", "g.text", F.col("before").alias("p"), F.lit(1).alias("guest"), F.lit(False).alias("last"), F.lit(0).cast("long").alias("down"), F.lit(0).cast("long").alias("h"))
    dealt = placed.select("doc_id", "text", "p", F.lit(0).alias("guest"), "last", "down", "h").union(guests)
    dealt = dealt.repartitionById(n, F.col("p") % n).sortWithinPartitions("p", "guest", "last", "down", "h", "text").select("doc_id", "text", "p", "guest")

    def run(batches):
        held = None  # the document that waits for its next one's text
        ready = None  # the row that waits for its next one's fingerprint, and its own
        for batch in batches:
            out = []
            for doc_id, text, _, guest in zip(*(batch.column(k) for k in range(4)), strict=True):
                text = text.as_py()
                if held is not None:
                    own, other, changed = both_fingerprints(held[1], text, size)
                    if ready is not None:
                        out.append((*ready[0], likeness(ready[1], own, size)))
                    sha = hashlib.sha256(changed.encode("utf-8")).hexdigest()
                    ready = (held[0], len(held[1]), sha, _hex(own), _hex(other), likeness(own, other, size)), own
                held = doc_id.as_py(), text
                if guest.as_py():
                    out.append((*ready[0], likeness(ready[1], fingerprint(text, size), size)))
                    held, ready = None, None
            if out:
                yield pa.record_batch([pa.array(c, pa.type_for_alias(_ARROW[t])) for c, (_, t) in zip(zip(*out, strict=True), _OUT, strict=True)], names=[c for c, _ in _OUT])

    return dealt.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in _OUT))


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return compare_neighbours(docs)
