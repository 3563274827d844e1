"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges.

1. Documents with one shingle set form a class; its smallest doc_id stands for it (exact copies never meet as pairs).
2. A class has one minimum for each of ``BINS`` ranges of its hashes; an empty range borrows from a full one, chosen
   by universal hashing of (range, try). ``ROWS`` minima make a band; classes with an equal band share a bucket.
3. Stars: a bucket proposes the edges from its smallest and its largest class to the others: two edges for each
   member at most. Edges are confirmed on the full sets, and connected components are taken.
4. Rest: in a bucket whose members are still of several components, pairs across components remain. Its members are cut by
   size (sets of two sizes apart cannot be similar enough) and into blocks; blocks meet where a pair is possible, which leaves out
   the largest component with itself. A pair goes on if the histograms of its hashes, a few hashes to a cell, have enough in
   common: what they share bounds the intersection from above, so no link is lost, at any size. Sets small enough to travel with
   their histograms are compared in full where they meet, and two components need one link only; larger survivors are fetched and
   confirmed. So the star's saving loses no connection of any bucket, and pairs inside a component are never formed.

Two sets are linked if 100 * intersection >= percent * union. Documents without words or text are linked with nothing.
A row with a null doc_id is linked with nothing, its component is null and it is kept. Repeated doc_ids: every row goes
by its own text. Ties take the smallest doc_id. Very long texts are taken whole; blocks of large sets have fewer members.
An empty table gives an empty result. Extra columns are ignored, unless they are carried.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, partitions, tidy
from .shingles import overlap, scramble, shingles

BINS, ROWS = 200, 5
PERCENT, WIDTH = 80, 5
#: Members of a block in step 4 at most and at least, and hashes of a block at which it has fewer.
BLOCK, LEAST_BLOCK, BLOCK_HASHES = 256, 8, 1 << 25
#: Hashes of a set that travels to the blocks whole. Larger ones are fetched for the pairs that their histograms allow.
WHOLE = 1024


def signature(hashes: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Minimum of each bin; empty bins densified. ``hashes`` sorted, not empty."""
    to = ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    full, first = np.unique(to, return_index=True)  # sorted hashes: a bin's first is its minimum
    out = np.zeros(bins, np.uint64)
    out[full] = hashes[first]
    if len(full) < bins:
        has = np.zeros(bins, bool)
        has[full] = True
        empty, k = np.flatnonzero(~has), 1
        while len(empty):
            pick = (scramble(empty.astype(np.uint64) * np.uint64(0x100000001B3) + np.uint64(k << 20)) % np.uint64(bins)).astype(np.int64)
            good = has[pick]
            out[empty[good]] = out[pick[good]]
            empty, k = empty[~good], k + 1
            if k > 64 * bins:  # cannot go on for ever: the nearest full bin after it
                out[empty] = out[full[np.searchsorted(full, empty) % len(full)]]
                break
    return out


def histogram(hashes: np.ndarray) -> tuple[bytes, int]:
    """How many hashes fall into each of 2**k equal ranges, 2 to 4 on average, up to 255; and how many are beyond that."""
    k = max(0, len(hashes).bit_length() - 2)
    each = np.bincount((hashes >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k) if k else np.array([len(hashes)])
    few = np.minimum(each, 255)
    return few.astype(np.uint8).tobytes(), int((each - few).sum())


def folded(cells: bytes, n: int) -> np.ndarray:
    """A histogram by fewer, larger ranges."""
    return np.frombuffer(cells, np.uint8).astype(np.uint16).reshape(n, -1).sum(axis=1, dtype=np.uint16)


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of the signature."""
    m = sig.reshape(-1, rows)
    with np.errstate(over="ignore"):
        key = np.arange(1, len(m) + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for i in range(rows):
            key = scramble(key ^ m[:, i]) * np.uint64(0x9E3779B97F4A7C15)
    return key.view(np.int64)


def _sets(docs: DataFrame, width: int, with_bands: bool, carry: tuple[str, ...] = ()) -> DataFrame:
    """Of (doc_id, text): doc_id, n_shingles, set_key and bands. Of (doc_id, text, node, set_key): node, the set and its histogram."""

    def banded(batches):
        for batch in batches:
            n, keys, sigs = [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py(), width)
                n.append(len(s))
                keys.append(_key(s))
                sigs.append(bands(signature(s)).tobytes() if len(s) else b"")
            ends = np.cumsum([0, *(len(x) // 8 for x in sigs)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(sigs), np.int64)))
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), lists, *batch.columns[2:]], names=["doc_id", "n_shingles", "set_key", "bands", *carry])
        tidy()

    def whole(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                sets = [shingles(t.as_py(), width) for t in part.column(1)]
                mine = pa.array([_key(s) == w for s, w in zip(sets, part.column(3).to_pylist(), strict=True)], pa.bool_())
                cells, beyond = zip(*map(histogram, sets), strict=True)
                yield pa.record_batch([part.column(2), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(cells, pa.binary()), pa.array(beyond, pa.int64())], names=["node", "hashes", "cells", "beyond"]).filter(mine)
        tidy()

    if with_bands:
        extra = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
        return docs.mapInArrow(banded, f"doc_id long, n_shingles long, set_key binary, bands array<long>{extra}")
    return docs.mapInArrow(whole, "node long, hashes binary, cells binary, beyond long")


def _key(hashes: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of (a, b) those whose full sets are as similar as asked."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb"))
    # a set that is too small beside the other cannot be similar enough
    small = F.least(F.octet_length("ha"), F.octet_length("hb"))
    large = F.greatest(F.octet_length("ha"), F.octet_length("hb"))
    joined = pairs.join(left, "a").join(right, "b").filter(small * 100 >= large * percent).select("a", "b", "ha", "hb")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = overlap(x, y)
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, "a long, b long")


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(v, comp): the smallest vertex reachable over ``links`` (a, b), for every vertex that has a link.

    Every round each vertex takes the smallest label around it, then its label's label; a few rounds suffice
    for the flat groups of near copies, and it goes on until nothing changes.
    """
    edges = scratch.keep(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    label = scratch.keep(edges.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("comp")), "label")
    while True:
        near = edges.join(label, edges["b"] == label["v"]).groupBy(F.col("a").alias("w")).agg(F.min("comp").alias("n"))
        low = label.join(near, F.col("v") == F.col("w")).select("v", F.col("comp").alias("old"), F.least("comp", "n").alias("c"))
        low = scratch.keep(low, "low")
        over = low.select(F.col("v").alias("_c"), F.col("c").alias("_cc"))
        jump = low.join(over, F.col("c") == F.col("_c"), "left").select("v", "old", F.least(F.col("c"), F.coalesce("_cc", "c")).alias("comp"))
        after = scratch.keep(jump, "jump")
        changed = after.filter("comp <> old").limit(1).count()
        scratch.drop(label)
        scratch.drop(low)
        label = after
        if not changed:
            scratch.drop(edges)
            return label.select("v", "comp")


def _dealt(members: DataFrame, percent: int) -> DataFrame:
    """members: (key, rep, comp, n). Adds own, lo, hi: a member's block, and the blocks that meet in a cell; a row for each such cell.

    Blocks are of one bucket, size class and side (0: the bucket's largest component). Classes one apart can hold similar sets.
    """
    width = max(math.log(100 / percent) * 1.001, 0.01)
    per = members.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m"))
    largest = per.groupBy("key").agg(F.max(F.struct("m", "comp"))["comp"].alias("largest"))
    size = F.floor(F.log(F.col("n")) / F.lit(width)).cast("int")
    rows = members.join(largest, "key").select("key", "rep", "comp", "n", size.alias("c"), (F.col("comp") != F.col("largest")).cast("int").alias("side"))
    block = F.least(F.lit(BLOCK), F.greatest(F.lit(LEAST_BLOCK), F.floor(F.lit(float(BLOCK_HASHES)) / F.exp((F.col("c") + 1) * F.lit(width)))))
    groups = rows.groupBy("key", "c", "side").agg(F.count(F.lit(1)).alias("m")).select("key", F.struct("c", "side", F.ceil(F.col("m") / block).cast("int").alias("parts")).alias("g"))
    groups = groups.groupBy("key").agg(F.collect_list("g").alias("groups"))  # as many as there are size classes, twice

    def code(c: Column, side: Column, part: Column) -> Column:
        return F.shiftleft((c * 2 + side).cast("long"), 32) + part

    mine = F.filter("groups", lambda g: (g["c"] == F.col("c")) & (g["side"] == F.col("side")))[0]["parts"]
    rows = rows.join(groups, "key").withColumn("own", code(F.col("c"), F.col("side"), F.pmod(F.xxhash64("rep"), mine)))
    near = F.filter("groups", lambda g: (F.abs(g["c"] - F.col("c")) <= 1) & ((g["side"] == 1) | (F.col("side") == 1)))
    others = F.flatten(F.transform(near, lambda g: F.transform(F.sequence(F.lit(0), g["parts"] - 1), lambda p: code(g["c"], g["side"], p))))
    met = rows.select("key", "rep", "comp", "n", "own", F.explode(others).alias("other"))
    return met.select("key", "rep", "comp", "n", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))


def _rest(scratch: Scratch, buckets: DataFrame, comp: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Step 4: pairs across components in one bucket that are linked, or may be as far as their histograms tell."""
    labelled = buckets.join(comp, buckets["rep"] == comp["v"], "left").select("key", "rep", "n", F.coalesce("comp", "rep").alias("comp"))
    labelled = scratch.keep(labelled, "labelled")
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("first"), F.max("comp").alias("last")).filter("first <> last").select("key")
    members = scratch.keep(labelled.join(mixed, "key", "left_semi"), "members")
    slim = sets.select(F.col("node").alias("rep"), "cells", "beyond", F.when(F.octet_length("hashes") <= 8 * WHOLE, F.col("hashes")).alias("whole"))

    def cells(key, table):
        lo, hi = key[1].as_py(), key[2].as_py()
        rep, comp, n, own, beyond = (table[c].to_numpy() for c in ("rep", "comp", "n", "own", "beyond"))
        hists = table["cells"].to_pylist()
        fewest = min(map(len, hists))
        hists = np.array([folded(h, fewest) for h in hists])
        whole = [None if h is None else np.frombuffer(h, np.uint64) for h in table["whole"].to_pylist()]
        group = np.unique(comp, return_inverse=True)[1]  # components, as far as this cell has linked them
        right = np.flatnonzero(own == hi)
        a_out, b_out = [], []
        for x in np.flatnonzero(own == lo).tolist():
            other = group[right] != group[x]
            other &= np.minimum(n[right], n[x]) * 100 >= np.maximum(n[right], n[x]) * percent
            if lo == hi:
                other &= rep[right] > rep[x]
            near = right[other]
            both = np.minimum(hists[near], hists[x]).sum(axis=1, dtype=np.int64) + beyond[near] + beyond[x]
            for y in near[both * (100 + percent) >= percent * (n[near] + n[x])].tolist():
                if whole[x] is not None and whole[y] is not None:
                    if group[x] == group[y] or overlap(whole[x], whole[y]) * (100 + percent) < percent * (n[x] + n[y]):
                        continue
                    group[group == group[y]] = group[x]
                a_out.append(min(rep[x], rep[y]))
                b_out.append(max(rep[x], rep[y]))
        return pa.table([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    # as many tasks as there are partitions, however few bytes the cells are: their work is in the pairs
    dealt = _dealt(members, percent).join(slim, "rep").repartition(partitions(scratch.spark), "key", "lo", "hi")
    return dealt.groupBy("key", "lo", "hi").applyInArrow(cells, "a long, b long").distinct()


def near_dups(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, scratch: Scratch | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable), kept and ``carry``: one row for each input row."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "neardup")
    own = docs.select(F.col("doc_id").cast("long"), "text")
    banded = scratch.keep(_sets(docs.select(F.col("doc_id").cast("long"), "text", *carry), width, True, carry), "banded")
    shingled = banded.filter(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    classes = shingled.groupBy("set_key").agg(F.min("doc_id").alias("first_id"))
    classes = scratch.keep(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")  # numbered once, when written
    heads = shingled.join(classes, "set_key").filter("doc_id = first_id")
    rows = heads.select(F.explode("bands").alias("key"), "rep", F.col("n_shingles").alias("n"))
    stars = rows.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi")
    buckets = scratch.keep(rows.join(stars, "key").distinct(), "buckets")
    ends = F.explode(F.array("lo", "hi")).alias("c")
    pairs = buckets.select("rep", ends).filter("rep <> c").select(F.least("rep", "c").alias("a"), F.greatest("rep", "c").alias("b")).distinct()
    pairs = scratch.keep(pairs, "pairs")
    wanted = classes.join(buckets.select("rep").distinct(), "rep", "left_semi").select(F.col("first_id").alias("doc_id"), F.col("rep").alias("node"), "set_key")
    texts = own.join(wanted, "doc_id").select("doc_id", "text", "node", "set_key").dropDuplicates(["doc_id", "text", "node"])
    sets = scratch.keep(_sets(texts, width, False), "sets")
    links = scratch.keep(_confirm(pairs, sets, percent), "links")
    comp = scratch.keep(components(scratch, links), "comp")
    more = scratch.keep(_confirm(_rest(scratch, buckets, comp, sets, percent), sets, percent), "more")
    if more.limit(1).count():
        first, comp = comp, scratch.keep(components(scratch, links.union(more)), "comp")
        scratch.drop(first)
    labelled = scratch.keep(classes.join(comp, classes["rep"] == comp["v"], "left").select("set_key", "first_id", F.coalesce("comp", "rep").alias("comp")), "labelled")
    for done in (classes, buckets, pairs, sets, links, more, comp):  # the answer needs the banded and the labelled rows alone
        scratch.drop(done)
    lowest = labelled.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    of_set = labelled.join(lowest, "comp").select("set_key", "component_id")
    out = banded.select("doc_id", "n_shingles", "set_key", *carry).join(of_set, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), *carry)


def brute_sql(table: str, percent: int = PERCENT, width: int = WIDTH) -> str:
    """DuckDB SQL for ``near_dups``: all pairs of sets with a shingle in common, counted once for equal sets."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS w FROM {table}
), d AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(w) - {width - 1}, 1) + 1), lambda i: array_to_string(w[i:i + {width - 1}], ' ')))) END AS s FROM w
), c AS (
  SELECT min(doc_id) AS id, s, len(s) AS n FROM d WHERE len(s) > 0 GROUP BY s
), x AS (SELECT id, n, unnest(s) AS g FROM c),
p AS (
  SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id, a.n, b.n
  HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))
), e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT id, id AS reach FROM c UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reach),
m AS (SELECT id, min(reach) AS low FROM r GROUP BY id)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(m.low, d.doc_id) AS component_id, coalesce(m.low, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN c ON d.s = c.s LEFT JOIN m ON m.id = c.id
"""
