"""Exact top-k by inner product: a ball tree for each shard of candidates, searched by branch and bound.

Components are turned into integers, floor(scale * x). A shard is built into a ball tree once and kept in the scratch table.
A query's bound at a node is q . centre + |q| * radius. Nodes are entered in the order of their bounds, and a
node below the query's current k-th score is not entered.

Shards are searched in rounds, each three times as many as all before: within a round they run side by side, and after it a
query's best k are merged, so that its current k-th score prunes in all shards of the next round. The rounds grow with the
logarithm of the shards. A tree meets a block of queries; a query keeps k rows at most between rounds.

Ties go to the smaller id; a query's own row is no candidate, other rows of its id are. Rows with a null id and vectors that are
null or hold null or non-finite components take no part, nor do doubles that overflow when scaled. Shorter vectors, empty ones too, count as if
zeros followed. Where doubles may not hold a sum of products it is taken in Python's integers; a score beyond 64 bits ranks
where it belongs and is null in ``score``. Repeated rows are candidates each, and each asks; with equal scores and ids they rank
one after the other. Very long vectors are a matter of a shard's memory: its rows times the longest vector.
Extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import heapq
import io
import math
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

K, SCALE = 5, 256.0
#: Rows of a shard, queries of a block, rows of a leaf.
SHARD, BLOCK, LEAF = 4096, 8192, 64
#: Up to here every whole number is a double; a larger double is whole.
_EXACT = float(1 << 53)


def integers(vectors: DataFrame, id_col: str, vector: str, scale: float = SCALE) -> DataFrame:
    """(id, v): usable vectors as arrays of whole doubles."""

    def whole(x: Column) -> Column:
        scaled = x.cast("double") * F.lit(scale)
        return F.when(F.abs(scaled) < F.lit(_EXACT), F.floor(scaled).cast("double")).otherwise(scaled)

    def unfit(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) * F.lit(scale) > F.lit(sys.float_info.max))

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    return rows.filter(~F.exists("v", unfit)).select("id", F.transform("v", whole).alias("v"))


def _matrix(column, dims: int | None = None) -> np.ndarray:
    rows = column.to_pylist()
    dims = dims or max(map(len, rows))
    out = np.zeros((len(rows), dims))
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def build(own: np.ndarray, ids: np.ndarray, m: np.ndarray, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """Nodes in preorder with centre, radius, span of rows and children (-1: a leaf); rows in the order of the leaves.

    own: numbers of the rows, by which a query finds itself.
    """
    order = np.argsort(ids, kind="stable")
    centre, radius, span, child = [], [], [], []
    rows = np.empty(len(ids), np.int64)
    todo, filled = [(order, None, 0)], 0
    while todo:
        part, parent, side = todo.pop()
        at = len(centre)
        if parent is not None:
            child[parent][side] = at
        x = m[part]
        c = x.mean(axis=0)
        d = np.sqrt(((x - c) ** 2).sum(axis=1))
        centre.append(c)
        radius.append(d.max())
        child.append([-1, -1])
        span.append([0, 0])
        if len(part) <= leaf or d.max() == 0:
            span[at] = [filled, filled + len(part)]
            rows[filled : filled + len(part)] = part
            filled += len(part)
            continue
        # along the line between two far points, halves of equal size
        a = x[d.argmax()]
        b = x[((x - a) ** 2).sum(axis=1).argmax()]
        by = np.argsort(x @ (b - a), kind="stable")
        half = len(part) // 2
        todo += [(part[np.sort(by[half:])], at, 1), (part[np.sort(by[:half])], at, 0)]
    return {"own": own[rows], "ids": ids[rows], "m": m[rows], "centre": np.array(centre), "radius": np.array(radius), "span": np.array(span), "child": np.array(child)}


def _under(score: float) -> float:
    """The score, or the next double below it where it is none."""
    try:
        near = float(score)
    except OverflowError:
        return sys.float_info.max if score > 0 else -math.inf
    return near if near <= score else math.nextafter(near, -math.inf)


def _ordered(score: int) -> bytes:
    """Bytes in the order of the numbers, of any size."""
    size = abs(score).to_bytes(-(-abs(score).bit_length() // 8), "big")
    up = b"\x80" + len(size).to_bytes(2, "big") + size
    return up if score >= 0 else bytes(255 - b for b in up)


def _whole(x: np.ndarray) -> np.ndarray:
    return np.frompyfunc(int, 1, 1)(x)


def search(tree: dict[str, np.ndarray], own: np.ndarray, q: np.ndarray, kth: np.ndarray, k: int = K):
    """For each query up to k (score, id), best first: all that may be among the best k, given that ``kth`` is reached elsewhere."""
    dims = tree["m"].shape[1]
    if q.shape[1] > dims:
        q = q[:, :dims]
    elif q.shape[1] < dims:
        q = np.pad(q, ((0, 0), (0, dims - q.shape[1])))
    # a little more than the bound itself, for what rounding may take from it; what overflows bounds nothing
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.sqrt((q**2).sum(axis=1))
        reach = np.sqrt((tree["centre"] ** 2).sum(axis=1)) + tree["radius"]
        bound = q @ tree["centre"].T + norm[:, None] * tree["radius"][None, :]
        bound += 1e-9 * norm[:, None] * reach[None, :] + 1e-6
    bound[np.isnan(bound)] = np.inf
    exact: dict[int, np.ndarray] = {}
    found = []
    for x in range(len(q)):
        best: list[tuple[float, int]] = []
        floor = float(kth[x])
        front = [(-bound[x, 0], 0)]
        while front:
            up, node = heapq.heappop(front)
            if -up < floor:
                break  # every node that is left has a lower bound
            left, right = tree["child"][node]
            if left >= 0:
                for n in (left, right):
                    if bound[x, n] >= floor:
                        heapq.heappush(front, (-bound[x, n], n))
                continue
            a, b = tree["span"][node]
            ids, others = tree["ids"][a:b], tree["own"][a:b] != own[x]
            if norm[x] * reach[node] * (1 + 1e-9) < _EXACT:
                scores = tree["m"][a:b] @ q[x]
                near = np.flatnonzero((scores >= floor) & others)
                if len(near) > k:  # the best of the leaf, ties by id
                    near = near[np.lexsort((ids[near], -scores[near]))[:k]]
                best += [(-s, i) for s, i in zip(scores[near].tolist(), ids[near].tolist(), strict=True)]
            else:
                if node not in exact:
                    exact[node] = _whole(tree["m"][a:b])
                scores = exact[node] @ _whole(q[x])
                best += [(-s, i) for s, i, other in zip(scores.tolist(), ids.tolist(), others.tolist(), strict=True) if other and s >= floor]
            best.sort()
            del best[k:]
            if len(best) == k:
                floor = max(floor, _under(-best[-1][0]))
        found.append([(int(-s), i) for s, i in best])
    return found


def _packed(tree: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    small = np.abs(tree["m"]).max(initial=0) < 1 << 31
    np.savez(out, **{n: a.astype(np.int32) if n == "m" and small else a for n, a in tree.items()})
    return out.getvalue()


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    tree = dict(np.load(io.BytesIO(data)))
    tree["m"] = tree["m"].astype(np.float64)
    return tree


def _trees(rows: DataFrame, leaf: int) -> DataFrame:
    def one(key, table):
        tree = build(table["row"].to_numpy(), table["id"].to_numpy(), _matrix(table["v"]), leaf)
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([_packed(tree)], pa.binary())], names=["shard", "tree"])

    return rows.groupBy("shard").applyInArrow(one, "shard long, tree binary")


_FOUND = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("rising", pa.binary()), ("low", pa.float64())])


def _searched(trees: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """trees: (shard, block, tree); asked: (shard, block, row, id, v, kth). A tree meets a block of queries, in both of bounded size.

    Returns for each query (query_row, query_id, vec_id, score, rising, low): the score, its bytes in order, a double not above it.
    """

    def one(left, right):
        if not left.num_rows or not right.num_rows:
            return _FOUND.empty_table()
        tree, rows, ids = _unpacked(left["tree"][0].as_py()), right["row"].to_numpy(), right["id"].to_pylist()
        out = []
        for a in range(0, len(rows), 512):  # the bounds of some queries at a time
            part = right.slice(a, 512)
            found = search(tree, rows[a : a + 512], _matrix(part["v"]), part["kth"].to_numpy(), k)
            out += [(r, i, c, s if -(1 << 63) <= s < 1 << 63 else None, _ordered(s), _under(s)) for r, i, f in zip(rows[a : a + 512].tolist(), ids[a : a + 512], found, strict=True) for s, c in f]
        return pa.table([pa.array(c, f.type) for c, f in zip(list(zip(*out, strict=True)) or [()] * len(_FOUND), _FOUND, strict=True)], schema=_FOUND)

    return trees.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(one, "query_row long, query_id long, vec_id long, score long, rising binary, low double")


def _range(low: int, high: int) -> Column:
    return F.explode(F.sequence(F.lit(low).cast("long"), F.lit(high - 1).cast("long")))


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K, shard_rows: int = SHARD, block: int = BLOCK, leaf: int = LEAF, scratch: Scratch | None = None) -> DataFrame:
    """candidates and queries: (row, id, v) with v as of ``integers``; a candidate of the query's own ``row`` is left out.

    Returns query_id, rank, vec_id, score.
    """
    scratch = scratch or Scratch(candidates.sparkSession, "topk")
    n, n_queries = candidates.count(), queries.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n_queries // block))
    # dealt by the row's number, so that a hot vector or id spreads
    trees = scratch.keep(_trees(candidates.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards))), leaf), "trees")
    held = scratch.keep(queries.select("row", "id", "v", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).alias("block")), "queries")
    order = Window.partitionBy("query_row").orderBy(F.col("rising").desc(), "vec_id")
    best, start = None, 0
    while start < shards:
        end = min(shards, max(1, 4 * start))
        asked = held.withColumn("kth", F.lit(float("-inf")))
        if best is not None:
            low = best.groupBy("query_row").agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("low")).filter(F.col("n") >= k)
            asked = held.join(low, F.col("row") == F.col("query_row"), "left").select("row", "id", "v", "block", F.coalesce("low", F.lit(float("-inf"))).alias("kth"))
        here = trees.filter((F.col("shard") >= start) & (F.col("shard") < end)).select("shard", "tree", _range(0, blocks).alias("block"))
        found = _searched(here, asked.select("block", "row", "id", "v", "kth", _range(start, end).alias("shard")), k)
        # ranks are limited before the shuffle too, so a query never gathers more than k rows from each task
        ranked = (found if best is None else best.union(found.select(*best.columns))).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        before, best = best, scratch.keep(ranked.select("query_row", "query_id", "vec_id", "score", "rising", "low"), "best")
        if before is not None:
            scratch.drop(before)
        start = end
    return best.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, embeddings: DataFrame, every: int = 50, k: int = K) -> DataFrame:
    """Each row with an id divisible by ``every`` asks all others."""
    scratch = Scratch(spark, "topk")
    rows = scratch.keep(integers(embeddings, "vec_id", "embedding").withColumn("row", F.monotonically_increasing_id()), "rows")  # numbered once, when written
    return top_k(rows, rows.filter(F.col("id") % every == 0), k, scratch=scratch)


def brute_sql(table: str, every: int = 50, k: int = K) -> str:
    """DuckDB SQL for ``query``: all scores."""
    return f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id,
         list_resize(list_transform(embedding, lambda x: floor(256 * x::DOUBLE)), (SELECT max(len(embedding)) FROM {table}), 0.0) AS v
  FROM {table} WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % {every} = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= {k}
"""
