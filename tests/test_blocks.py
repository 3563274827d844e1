"""Searches from many sources, dealt by word: as plain searches, and components do not meet."""

import random

import pytest
from fragweave.operators import graphs
from fragweave.scratch import Tables
from test_incidence import adjacency, bfs, ids, plain_pairs, rows


def made(n, seed=4):
    rng = random.Random(seed)
    left = {(v, rng.randrange(n)) for v in range(n) for _ in range(2)} | {(v, n) for v in range(9)}
    right = {(rng.randrange(n), rng.randrange(n)) for _ in range(n)} | {(n + 5, n + 5)}
    return left, right


@pytest.mark.parametrize("sides", [1, 2])
def test_searches(spark, monkeypatch, sides):
    monkeypatch.setattr(graphs, "LANES", 1)
    monkeypatch.setattr(graphs, "ROW", 3)
    n = 160
    left, right = made(n)
    right = left if sides == 1 else right
    tables = [spark.createDataFrame(sorted(t), "id long, segment long") for t in (left, right)]
    graph = graphs.Incidence(*tables[:sides])
    assert graphs.blocks(graph, ids(spark, range(n)), Tables(spark, "t")) is not None
    adjacent, rng = adjacency(plain_pairs(left, right)), random.Random(5)
    stop = set(rng.sample(range(n), 30))
    for some in (None, stop):
        counts = {}
        for v in range(n):
            for u, d in bfs(adjacent, v, some or frozenset()).items():
                if d <= 3:
                    counts[u, d] = counts.get((u, d), 0) + 1
        assert rows(graphs.reach(graph, ids(spark, range(n)), 3, some and ids(spark, some))) == {(*k, c) for k, c in counts.items()}
    asked = {(rng.randrange(n), rng.randrange(n)) for _ in range(900)} | {(v, v) for v in range(n)} | {(4, 1000), (1000, 4)}
    table = spark.createDataFrame(sorted(asked), "source long, target long")
    far = {(a, b): bfs(adjacent, a).get(b) for a, b in asked}
    assert rows(graphs.distances(graph, table)) == {(a, b, d) for (a, b), d in far.items() if d} and max(d or 0 for d in far.values()) > 3
    means = {}
    for (a, _), d in far.items():
        means.setdefault(a, []).append(0 if d is None else d + 1)
    assert rows(graphs.mean_vertices(graph, table)) == {(a, sum(x) // len(x)) for a, x in means.items()}


def test_rows_grow_with_the_copies(spark, monkeypatch):
    """Copies of a graph have no path between them, so what is written grows with their number and not with its square."""
    monkeypatch.setattr(graphs, "LANES", 1)
    written = []

    def counting(keep):
        def run(self, df, *args, **kw):
            out = keep(self, df, *args, **kw)
            written.append(out.count())
            return out

        return run

    for name in ("keep", "keep_bucketed"):
        monkeypatch.setattr(Tables, name, counting(getattr(Tables, name)))
    n, total = 128, []
    one = spark.createDataFrame(sorted({(v, s) for v, s in made(n)[0]}), "id long, segment long")
    for copies in (1, 6):
        table = one.crossJoin(spark.range(copies).select(graphs.F.col("id").alias("k"))).selectExpr("id + k * 1000 AS id", "segment + k * 1000 AS segment")
        written.clear()
        got = graphs.reach(graphs.Incidence(table), table.select("id"), 3).collect()
        assert len(got) % copies == 0
        total.append(sum(written))
    assert total[1] < 7 * total[0]
