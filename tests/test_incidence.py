"""Graphs as incidence tables, and searches by bit sets, against plain searches over pairs."""

import random
from collections import defaultdict

import pytest
from fragweave.operators import graphs
from fragweave.scratch import Tables


def plain_pairs(left, right):
    on = defaultdict(set)
    for b, h in right:
        on[h].add(b)
    return {(min(a, b), max(a, b)) for a, h in left for b in on[h] if a != b}


def adjacency(pairs):
    out = defaultdict(set)
    for a, b in pairs:
        out[a].add(b)
        out[b].add(a)
    return out


def bfs(adjacent, start, stop=frozenset()):
    out, front, k = {start: 0}, {start}, 0
    while front:
        k += 1
        front = {u for v in front if v == start or v not in stop for u in adjacent[v]} - set(out)
        out |= dict.fromkeys(front, k)
    return out


def made(seed, n=60):
    rng = random.Random(seed)
    left = {(rng.randrange(n), f"s{rng.randrange(n)}") for _ in range(n * 5 // 4)}
    right = {(rng.randrange(n), f"s{rng.randrange(n)}") for _ in range(n)} | {(rng.randrange(n), "s1") for _ in range(9)}
    return n, left, (left if seed % 2 else right)


@pytest.fixture(params=[1, 2], scope="module")
def graph(request, spark):
    n, left, right = made(request.param)
    tables = [spark.createDataFrame(sorted(t), "id long, segment string") for t in (left, right)]
    inc = graphs.Incidence(tables[0]) if left == right else graphs.Incidence(*tables)
    return n, plain_pairs(left, right), inc


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "id long")


def rows(df):
    got = [tuple(r) for r in df.collect()]
    assert len(set(got)) == len(got)
    return set(got)


def test_pairs_components_isolation(spark, graph):
    n, pairs, inc = graph
    adjacent = adjacency(pairs)
    assert rows(inc.pairs()) == pairs
    want = {(v, min(bfs(adjacent, v))) for v in range(n)}
    assert rows(inc.components(ids(spark, range(n)))) == want
    assert rows(graphs.components(ids(spark, range(n)), inc.pairs())) == want
    assert rows(inc.isolated(ids(spark, range(n)))) == {(v,) for v in range(n) if not adjacent[v]}
    assert len({c for _, c in want}) > 3


@pytest.mark.parametrize("as_pairs", [True, False])
def test_searches(spark, graph, as_pairs):
    n, pairs, inc = graph
    if as_pairs and inc.right is None:
        return  # pairs are pairs, of whichever table
    adjacent, g = adjacency(pairs), inc.pairs() if as_pairs else inc
    rng = random.Random(5)
    stop, wanted = set(rng.sample(range(n), 20)), set(rng.sample(range(n), 8))
    counts = defaultdict(int)
    for v in range(n):
        for u, d in bfs(adjacent, v, stop).items():
            counts[u, d] += d <= 3
    assert rows(graphs.reach(g, ids(spark, range(n)), 3, ids(spark, stop))) == {(*k, c) for k, c in counts.items() if c}
    level = set()
    for v in range(0, n, 2):
        far = {u: d for u, d in bfs(adjacent, v).items() if u in wanted and d}
        level |= {(v, u, d) for u, d in far.items() if d == min(far.values())}
    assert rows(graphs.nearest(g, ids(spark, range(0, n, 2)), ids(spark, wanted))) == level and len(level) > 5
    asked = {(rng.randrange(n), rng.randrange(n)) for _ in range(300)} | {(3, 3), (4, 1000), (1000, 4)}
    table = spark.createDataFrame(sorted(asked), "source long, target long")
    far = {(a, b): bfs(adjacent, a).get(b) for a, b in asked}
    assert rows(graphs.distances(g, table)) == {(a, b, d) for (a, b), d in far.items() if d}
    means = defaultdict(list)
    for (a, _), d in far.items():
        means[a].append(0 if d is None else d + 1)
    assert rows(graphs.mean_vertices(g, table)) == {(a, sum(x) // len(x)) for a, x in means.items()}
    assert any(0 in x and sum(x) for x in means.values())


def test_a_hub_costs_its_contigs_and_not_their_pairs(spark, monkeypatch):
    """One segment on so many contigs; a chain hangs on one of them."""
    written, keep = [], Tables.keep

    def counting(self, df, label="t"):
        out = keep(self, df, label)
        written.append(out.count())
        return out

    monkeypatch.setattr(Tables, "keep", counting)
    n = 20_000
    table = spark.range(n).selectExpr("id", "'hub' AS segment").union(spark.range(5).selectExpr(f"id + {n - 1}", "concat('c', id)")).union(spark.range(5).selectExpr(f"id + {n}", "concat('c', id)"))
    inc = graphs.Incidence(table)
    assert inc.components(table.select("id").distinct()).filter("component = 0").count() == n + 5
    got = {r["dist"]: r["n"] for r in graphs.reach(inc, ids(spark, [7]), 4).groupBy("dist").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    assert got == {0: 1, 1: n - 1, 2: 1, 3: 1, 4: 1}
    assert rows(graphs.distances(inc, spark.createDataFrame([(7, n + 4), (0, 9)], "source long, target long"))) == {(7, n + 4, 6), (0, 9, 1)}
    assert sum(written) < 25 * n


def test_edges_shrink(spark, monkeypatch):
    live, keep = [], Tables.keep

    def counting(self, df, label="t"):
        out = keep(self, df, label)
        if label == "live":
            live.append(out.count())
        return out

    monkeypatch.setattr(Tables, "keep", counting)
    rng = random.Random(3)
    names = rng.sample(range(10_000), 600)
    chain = spark.createDataFrame(list(zip(names, names[1:], strict=False)), "src long, dst long")
    assert {r["component"] for r in graphs.components(ids(spark, names), chain).collect()} == {min(names)}
    assert live[-1] == 0 and all(b <= a / 2 for a, b in zip(live, live[1:], strict=False)) and len(live) < 12


def test_routes_give_the_same_graphs(spark):
    rng = random.Random(9)
    paths = [(c, rec, k, f"{rng.randrange(30)}{rng.choice('+-')}") for c in range(25) for rec in range(rng.randrange(1, 3)) for k in range(rng.randrange(1, 5))]
    links = [(f"{rng.randrange(30)}{rng.choice('+-')}", f"{rng.randrange(30)}{rng.choice('+-')}") for _ in range(25)]
    p = spark.createDataFrame(paths, "contig_id long, record int, pos int, segment string")
    both = spark.createDataFrame(links + [(b, a) for a, b in links], "a string, b string")
    for last_only in (True, False):
        assert rows(graphs.spades_incidence(p, both, last_only).pairs()) == rows(graphs.spades_edges(p, both, last_only))
    turned = p.selectExpr("contig_id", "CASE WHEN right(segment, 1) = '-' THEN '-' ELSE '' END || left(segment, length(segment) - 1) AS segment")
    signed = both.selectExpr(*[f"CASE WHEN right({c}, 1) = '-' THEN '-' ELSE '' END || left({c}, length({c}) - 1) AS {c}" for c in "ab"])
    assert rows(graphs.flye_incidence(turned, signed).pairs()) == rows(graphs.flye_edges(turned, signed))


def test_no_sources(spark):
    inc = graphs.Incidence(spark.createDataFrame([(1, "a"), (2, "a")], "id long, segment string"))
    assert graphs.reach(inc, ids(spark, [])).collect() == [] and graphs.nearest(inc, ids(spark, []), ids(spark, [1])).collect() == []
    assert graphs.distances(inc, spark.createDataFrame([], "source long, target long")).collect() == []
