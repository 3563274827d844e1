"""Exact top-k against brute force."""

import math

import numpy as np
import pytest
from fragweave.llm import topk
from fragweave.llm.common import Scratch, read
from pyspark.sql import functions as F


def brute(rows, k=5, every=50):
    """Every row with an id divisible by ``every`` asks all other rows; integers of any size."""
    usable = [(i, [math.floor(256 * x) if abs(x) < 1e300 else 256 * int(x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for place, (q, v) in enumerate(usable):
        if q % every == 0:
            got = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for other, (i, w) in enumerate(usable) if other != place)[:k]
            out += [(q, r + 1, i, -s if -(2**63) <= -s < 2**63 else None) for r, (s, i) in enumerate(got)]
    return sorted(out, key=str)


def asked(table):
    rows = topk.integers(table, "vec_id", "embedding").withColumn("row", F.monotonically_increasing_id())
    return Scratch(table.sparkSession, "t").keep(rows)


@pytest.mark.parametrize("shard_rows,leaf", [(64, 8), (100_000, 64)])
def test_equals_brute_force(spark, sf, shard_rows, leaf):
    rng = np.random.default_rng(3)
    rows = [(r["vec_id"], list(r["embedding"])) for r in read(spark, sf, "embeddings").collect()]
    rows += [(10_000 + i, rows[7][1]) for i in range(150)]  # a hot vector, ties
    rows += [(20_000, None), (20_050, [1.0, None]), (20_100, [float("nan")]), (20_150, [float("inf")]), (20_200, []), (20_250, [0.5]), (None, [1.0]), (20_300, [1e30] * 64), (20_350, [0.1] * 64), (20_350, [0.1] * 64), (20_350, [0.2] * 64)]
    rows += [(30_000 + i, (rng.normal(size=64) * 1e6).tolist()) for i in range(60)]  # large components
    table = spark.createDataFrame([(*r, 0, 1) for r in rows], "vec_id long, embedding array<double>, shard int, row int").repartition(3)
    v = asked(table)
    got = topk.top_k(v, v.filter("id % 50 = 0"), shard_rows=shard_rows, leaf=leaf, block=7)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    two = spark.createDataFrame([(0, [1.0]), (1, [2.0])], schema)
    assert [tuple(r) for r in topk.query(spark, two).collect()] == [(0, 1, 1, 256 * 512)]
    assert topk.query(spark, spark.createDataFrame([], schema)).count() == 0


def test_wide_components(spark):
    """Components of any finite size ask and are found; sums beyond the doubles are exact."""
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(400)]
    for i, size in enumerate([65536.0, 70000.0, -70000.0, 1e5, 3e8, 3.1e9, -3.1e9, 1e20, 1e30, -1e30, 3e38]):
        rows += [(1000 + 50 * i + j, (rng.normal(size=8) * (size if j < 2 else 1)).clip(-3.4e38, 3.4e38).astype(np.float32).tolist()) for j in range(3)]
        rows[-1][1][3] = float(np.float32(size))
    rows += [(5003, [float("inf")] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    want = brute(rows)
    assert any(s is None for *_, s in want)
    got = topk.query(spark, table)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect()), key=str) == want
    v = asked(table)
    got = topk.top_k(v, v.filter("id % 50 = 0"), shard_rows=64, leaf=8, block=7)
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_other_rows_of_the_query_s_id_are_candidates(spark):
    rows = [(0, [1.0]), (0, [2.0]), (50, []), (1, [3.0])]
    got = topk.query(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows))
    assert (0, 2, 0, 2 * 65536) in brute(rows) and (50, 1, 0, 0) in brute(rows)


def test_the_kth_score_is_shared_between_rounds(spark, monkeypatch):
    """After the first round every query starts with a bound."""
    asked_with = []
    plain = topk._searched

    def spy(trees, queries, k):
        asked_with.append((trees.select("shard").distinct().count(), queries.filter("kth = double('-infinity')").count()))
        return plain(trees, queries, k)

    monkeypatch.setattr(topk, "_searched", spy)
    table = spark.createDataFrame([(i, [float(i % 13), float(i % 7)]) for i in range(600)], "vec_id long, embedding array<float>")
    v = asked(table)
    topk.top_k(v, v.filter("id % 50 = 0"), shard_rows=20).collect()
    assert [n for n, _ in asked_with] == [1, 3, 12, 14] and [open_ for _, open_ in asked_with] == [12, 0, 0, 0]


def test_wide_scores_differ_by_less_than_a_double_holds(spark):
    rows = [(i, [2.0**30, float(i % 50)]) for i in range(1, 101)]
    got = topk.query(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).filter("query_id = 100")
    # all products of the first components are 2**76; the second of 100 is 0, so ties go by id
    assert [(r["vec_id"], r["score"]) for r in got.collect()] == [(i, None) for i in range(1, 6)]
    rows = [(0, [2.0**22, 1.0])] + [(i, [2.0**22, i / 256]) for i in range(1, 31)]
    got = topk.query(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).filter("query_id = 0")
    assert [(r["vec_id"], r["score"]) for r in got.collect()] == [(i, (1 << 60) + 256 * i) for i in range(30, 25, -1)]


def test_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    rows = [(i, [float(i % 7), 70000.0 + i if i % 3 else -float(i)]) for i in range(200)] + [(250, []), (100, [1.0, 2.0]), (None, [1.0]), (300, None)]
    con = duckdb.connect()
    con.execute("CREATE TABLE e (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO e VALUES (?, ?)", rows)
    got = topk.query(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(topk.brute_sql("e")).fetchall())


def test_branches_are_pruned():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 8)) * 50
    m = np.floor(centres[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 8)))
    tree = topk.build(np.arange(4000), np.arange(4000), m, leaf=32)
    seen = []

    class Spy(dict):
        def __getitem__(self, key):
            if key == "ids":
                seen.append(1)
            return super().__getitem__(key)

    topk.search(Spy(tree), np.array([-1]), m[:1], np.array([-np.inf]))
    assert len(seen) < 0.5 * 4000 / 32
