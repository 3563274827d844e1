"""Importance resampling towards a target distribution, with words found and hashed on Arrow's UTF-8 buffers.

The texts of a batch lie in one buffer of bytes. A lookup table lower-cases A-Z and tells word bytes from others; a word begins where the
class of neighbouring bytes differs, or at the start of a text. All words of a slice advance their CRC-32 at the same time, one byte a
step, by the usual table. What lies beyond ``STRIDE`` bytes of a word is cut into strides that advance beside the others and are joined afterwards,
a CRC being linear: so a text that is one word takes no more steps than another of its length.

A word's bucket is its CRC modulo ``BUCKETS``. Counts by bucket over all documents (s, in all S) and all target texts (t, T) give a bucket's gain,
floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))). A document's weight is the floored mean of its words' gains; its score adds Gumbel noise from
SHA-256 of ``seed:doc_id``, so that the highest scores are a draw without replacement. Documents are read once: what is kept of them is two bytes a word.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of whole texts, A-Z lower-cased. Null and empty texts have none: 0 features, weight 0. Documents of fewer
than ``LEAST`` words are scored and not drawn. A null doc_id has no noise: its words count in S, its score and rank are null and it is not of the N.
Ties go to the smaller doc_id; rows of one doc_id and one score go by features, more first, and equal rows take ranks one after the
other. Empty tables: no documents give an empty result, no target texts give T = 0. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, tidy

BUCKETS, LEAST, PERCENT, SEED = 10_000, 20, 10, 2024
#: Bytes of texts that are worked on at a time (a longer text is worked on whole), and bytes of a word that advance in one piece.
SLICE, STRIDE = 1 << 22, 64
#: The polynomial of CRC-32, reflected.
POLYNOMIAL = 0xEDB88320


def _table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(POLYNOMIAL), out >> 1)
    return out


CRC = _table()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Of lower-cased bytes: 0-9, a-z and all of other scripts.
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _beyond_a_stride() -> np.ndarray:
    """For each byte of a CRC, what it becomes when STRIDE zero bytes follow."""
    out = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    for _ in range(STRIDE):
        out = CRC[out & 0xFF] ^ (out >> 8)
    return out


FAR = _beyond_a_stride()


def _advance(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, state: np.ndarray) -> np.ndarray:
    """All CRCs over their bytes at once; those that are done leave."""
    order = np.argsort(-lengths, kind="stable")
    at, out = starts[order], state[order]
    # how many have a further byte at each step
    more = np.searchsorted(-lengths[order], -np.arange(1, (lengths.max() if len(lengths) else 0) + 1), side="right")
    for k, n in enumerate(more.tolist()):
        out[:n] = CRC[(out[:n] ^ data[at[:n] + k]) & 0xFF] ^ (out[:n] >> 8)
    back = np.empty_like(out)
    back[order] = out
    return back


def crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each data[start:end] (none empty)."""
    lengths = ends - starts
    first = (lengths - 1) % STRIDE + 1  # what is left beside whole strides
    state = _advance(data, starts, first, np.full(len(starts), 0xFFFFFFFF, np.uint32))
    long = np.flatnonzero(lengths > STRIDE)
    if len(long):
        strides = (lengths[long] - first[long]) // STRIDE
        base = np.cumsum(strides) - strides
        where = np.arange(strides.sum()) - np.repeat(base, strides)
        pieces = np.repeat(starts[long] + first[long], strides) + where * STRIDE
        parts = _advance(data, pieces, np.full(len(pieces), STRIDE), np.zeros(len(pieces), np.uint32))
        # words side by side, their strides one after the other
        by = np.argsort(-strides, kind="stable")
        long, base, strides = long[by], base[by], strides[by]
        for k, n in enumerate(np.searchsorted(-strides, -np.arange(1, strides[0] + 1), side="right").tolist()):
            s = state[long[:n]]
            state[long[:n]] = FAR[0][s & 0xFF] ^ FAR[1][(s >> 8) & 0xFF] ^ FAR[2][(s >> 16) & 0xFF] ^ FAR[3][s >> 24] ^ parts[base[:n] + k]
    return state ^ np.uint32(0xFFFFFFFF)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words of each row) of lower-cased bytes with rows at the offsets, by differences of the bytes' classes."""
    inside = WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    rows = offsets[:-1][np.diff(offsets) > 0]  # where a text begins, words do
    first[rows] = inside[rows]
    last[rows[1:] - 1] = inside[rows[1:] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most SLICE bytes, or of one row."""
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE, side="right")) - 1)
        yield a, b
        a = b


def buckets(texts: pa.Array, n: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words of the texts in order, and how many words each text has."""
    texts = texts.fill_null("").cast(pa.large_binary()) if isinstance(texts, pa.Array) else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    out, counts = [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)]
    for a, b in _slices(offsets):
        own = offsets[a : b + 1] - offsets[a]
        part = LOWER[data[offsets[a] : offsets[b]]]
        starts, ends, per = words(part, own)
        out.append((crcs(part, starts, ends) % np.uint32(n)).astype(np.uint16))
        counts.append(per)
    return np.concatenate(out), np.concatenate(counts)


def featured(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = BUCKETS) -> DataFrame:
    """(id, n_features, buckets): two bytes for each word, in order."""
    if n > 1 << 16:
        raise ValueError("at most 65536 buckets")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                own, counts = buckets(batch.column(1), n)
                ends = np.concatenate([[0], np.cumsum(counts) * 2]).astype(np.int64)
                packed = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(own.tobytes())])
                yield pa.record_batch([batch.column(0), pa.array(counts), packed.cast(pa.binary())], names=["id", "n_features", "buckets"])
        tidy()

    return docs.select(F.col(id_col).cast("long"), F.col(text).cast("string")).mapInArrow(run, "id long, n_features long, buckets binary")


def _numbers(column) -> np.ndarray:
    """The buckets of a batch, one row's after the other's."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].view(np.uint16) if at[-1] > at[0] else np.zeros(0, np.uint16)


def histogram(feats: DataFrame, n: int = BUCKETS) -> np.ndarray:
    """How many words each bucket has. Every task sends one row for each bucket that it met, and as many as buckets come back."""

    def run(batches):
        total = np.zeros(n, np.int64)
        for batch in batches:
            total += np.bincount(_numbers(batch.column(0)), minlength=n)
        full = np.flatnonzero(total)
        yield pa.record_batch([pa.array(full), pa.array(total[full])], names=["bucket", "n"])

    out = np.zeros(n, np.int64)
    for r in feats.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    n = len(source)
    s, t = source.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weighed(feats: DataFrame, gain: np.ndarray) -> DataFrame:
    """(id, n_features, weight)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                counts = batch.column(1).to_numpy()
                upto = np.concatenate([[0], np.cumsum(gain[_numbers(batch.column(2))])])
                ends = np.cumsum(counts)
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array((upto[ends] - upto[ends - counts]) // np.maximum(counts, 1))], names=["id", "n_features", "weight"])

    return feats.select("id", "n_features", "buckets").mapInArrow(run, "id long, n_features long, weight long")


def noise(key: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln(u))), u from the first 32 bits of SHA-256 of ``seed:key``."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def drawn(scratch: Scratch, scored: DataFrame, percent: int = PERCENT, least: int = LEAST) -> DataFrame:
    """scored: (doc_id, n_features, weight, score). Adds ``rank``.

    Scores are whole numbers of a bounded range, so a count for each tells which can be among the drawn; those alone are put in order.
    """
    may = (F.col("n_features") >= least) & F.col("score").isNotNull()
    per = sorted(((r["score"], r["n"]) for r in scored.filter(may).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    take = percent * sum(n for _, n in per) // 100
    none = F.lit(None).cast("long").alias("rank")
    if not take:
        return scored.select("*", none)
    low, over = None, 0
    for low, n in per:  # noqa: B007
        over += n
        if over >= take:
            break
    high = may & (F.col("score") >= low)
    order = [F.col("score").desc(), F.col("doc_id").asc(), F.col("n_features").desc()]
    top = scratch.ordinals(scored.filter(high), order, "_at").select(*scored.columns, F.when(F.col("_at") < take, F.col("_at") + 1).cast("long").alias("rank"))
    return top.union(scored.filter(~F.coalesce(high, F.lit(False))).select("*", none))


def resample(docs: DataFrame, target: DataFrame, scratch: Scratch | None = None, n: int = BUCKETS, least: int = LEAST, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank: every document; those with a rank are drawn. Both tables have a text, docs a doc_id."""
    scratch = scratch or Scratch(docs.sparkSession, "resample")
    feats = scratch.keep(featured(docs, n=n), "feats")
    goal = featured(target.select(F.lit(0).alias("doc_id"), "text"), n=n)
    rows = weighed(feats, gains(histogram(feats, n), histogram(goal, n))).withColumnRenamed("id", "doc_id")
    scored = scratch.keep(rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    scratch.drop(feats)
    return drawn(scratch, scored, percent, least)


def query(spark: SparkSession, docs: DataFrame, target: DataFrame) -> DataFrame:
    return resample(docs, target)


def draw_sql(docs: str, target: str) -> str:
    """DuckDB SQL for ``resample``; the CRC is folded over the bytes of each distinct word."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def split(table: str) -> str:
        return f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table}"

    step = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    return f"""
WITH RECURSIVE tab AS (SELECT range AS i, 0 AS k, range::BIGINT AS c FROM range(256) UNION ALL SELECT i, k + 1, {step} FROM tab WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM tab WHERE k = 8),
d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, {split(docs)}), b AS MATERIALIZED (SELECT {split(target)}),
dw AS MATERIALIZED (SELECT r, unnest(w) AS x FROM d), bw AS MATERIALIZED (SELECT unnest(w) AS x FROM b),
u AS MATERIALIZED (SELECT x, hex(x) AS h FROM (SELECT x FROM dw UNION SELECT x FROM bw)),
z AS MATERIALIZED (SELECT x, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
  lambda a, y: xor(t[xor(a, y) % 256 + 1], a // 256)), 4294967295) % {BUCKETS} AS k FROM u CROSS JOIN crc),
s AS (SELECT k, count(*) AS n FROM dw JOIN z USING (x) GROUP BY k), t AS (SELECT k, count(*) AS n FROM bw JOIN z USING (x) GROUP BY k),
g AS MATERIALIZED (SELECT DISTINCT z.k, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + {BUCKETS}) / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw) + {BUCKETS}))))::BIGINT AS gain
  FROM z LEFT JOIN s ON s.k = z.k LEFT JOIN t ON t.k = z.k),
m AS (SELECT r, floor(sum(gain) / count(*))::BIGINT AS weight FROM dw JOIN z USING (x) JOIN g USING (k) GROUP BY r),
c AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN m USING (r)),
o AS (SELECT *, CASE WHEN n_features >= {LEAST} AND doc_id IS NOT NULL THEN row_number() OVER (PARTITION BY n_features >= {LEAST} AND doc_id IS NOT NULL ORDER BY score DESC, doc_id, n_features DESC) END AS k FROM c)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= {PERCENT} * (SELECT count(k) FROM o) // 100 THEN k END AS rank FROM o
"""
