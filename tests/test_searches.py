"""Distances of asked pairs, in the driver and on the executors, against plain searches."""

import random
from collections import Counter

import pytest
from fragweave.operators import graphs, kernels
from fragweave.plans import binning
from fragweave.scratch import Tables


def plain(edges, start):
    out, front = {start: 0}, [start]
    while front:
        front = list({n for v in front for e in edges if v in e for n in e if n not in out})
        out |= {n: len_of(out, edges, n) for n in front}
    return out


def len_of(out, edges, n):
    return 1 + min(out[m] for e in edges if n in e for m in e if m in out and m != n)


@pytest.mark.parametrize("edges_in_driver", [0, 10_000])
def test_paths_of_asked_pairs(spark, monkeypatch, edges_in_driver):
    rng = random.Random(8)
    edges = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(28)} | {(100 + k, 101 + k) for k in range(15)}
    vertices = sorted({v for e in edges for v in e} | {200})
    pairs = [(rng.choice(vertices), rng.choice(vertices)) for _ in range(60)] + [(100, 115), (115, 103), (200, 100), (200, 200)]
    of = {v: plain(edges, v) for v in vertices}
    want = [of[a].get(b, -1) + 1 for a, b in pairs]
    assert 0 in want and 16 in want and 1 in want
    monkeypatch.setattr(binning, "DRIVER_EDGES", edges_in_driver)
    kept = Tables(spark, "t")
    table = kept.keep(spark.createDataFrame(sorted(edges), "src long, dst long"), "edges")
    assert binning._near_paths(table, kept)(pairs) == want
    monkeypatch.setattr(binning, "PAIRS", 3)
    if not edges_in_driver:
        with pytest.raises(ValueError, match="pairs"):
            binning._near_paths(table, kept)(pairs)


def test_a_search_ends_with_its_targets():
    adjacent = {k: [k - 1, k + 1] for k in range(1000)}
    assert kernels.hops(adjacent, 5, {7, 3}) == {7: 2, 3: 2}
    assert kernels.hops({}, 5, {7}) == {} and kernels.hops({}, 5, {5}) == {5: 0}


def test_distances_of_no_pairs(spark):
    edges = spark.createDataFrame([(1, 2)], "src long, dst long")
    assert graphs.distances(edges, spark.createDataFrame([], "source long, target long")).collect() == []


def random_graph(spark, seed):
    rng = random.Random(seed)
    edges = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(rng.choice([30, 45, 70]))}
    adjacent = {v: {b for a, b in edges if a == v} | {a for a, b in edges if b == v} for v in range(40)}
    return spark.createDataFrame(sorted(edges), "src long, dst long"), adjacent


def plain_hops(adjacent, start, stop=()):
    out, front = {start: 0}, [start]
    while front:
        front = sorted({n for v in front if v == start or v not in stop for n in adjacent[v]} - set(out))
        out |= {v: max(out.values()) + 1 for v in front}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_searches_of_any_depth(spark, seed):
    """Cycles and stop vertices, which are met again on later levels; all levels, by rows and by bits."""
    edges, adjacent = random_graph(spark, seed)
    ids, stop = spark.range(40).select("id"), set(range(0, 40, 4))
    stops = ids.filter("id % 4 = 0")
    for given, plain in ((None, ()), (stops, stop)):
        want = {(s, v, d) for s in range(40) for v, d in plain_hops(adjacent, s, plain).items()}
        assert sorted(map(tuple, graphs.hops(edges, ids, None, given).collect())) == sorted(want)
        counts = Counter((v, d) for _, v, d in want)
        assert {(r["id"], r["dist"]): r["n"] for r in graphs.reach(edges, ids, None, given).collect()} == counts
    pairs = spark.createDataFrame([(a, (a * 7 + k) % 40) for a in range(40) for k in range(3)], "source long, target long")
    got = {tuple(r) for r in graphs.distances(edges, pairs).collect()}
    assert got == {(a, b, d) for a, b in map(tuple, pairs.collect()) if a != b and (d := plain_hops(adjacent, a).get(b)) is not None}


def test_a_level_meets_the_last_two(spark, monkeypatch):
    """On a long path each level reads two fronts before it, however many there are."""
    read, real = [], Tables.keep
    monkeypatch.setattr(Tables, "keep", lambda self, df, label="t": (read.append(len(df.inputFiles())) if label == "front" else None) or real(self, df, label))
    edges = spark.range(12).selectExpr("id AS src", "id + 1 AS dst").coalesce(1)
    got = graphs.hops(edges, spark.range(1).select("id").coalesce(1), None)
    assert {tuple(r) for r in got.collect()} == {(0, k, k) for k in range(13)}
    assert max(read[6:]) <= max(read[:6]) + 2
