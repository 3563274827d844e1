"""Edges by segments: each pair of contigs is formed once for a pair of segments, odd names keep their meaning, and tasks grow with the table."""

import itertools

import pytest
from fragweave.operators import graphs


def reverse(s):
    return s[1:] if s.startswith("-") else "-" + s


def plain_flye(paths, links):
    out = set()
    for (a, s), (b, t) in itertools.product(paths, paths):
        ways = {s, reverse(s)}
        to = {y for x, y in links if x in ways and y is not None}
        to |= {y.removeprefix("-") for y in to}
        if a != b and (t in ways or t in to or t == s.removeprefix("-")):
            out.add((min(a, b), max(a, b)))
    return out


def spied(monkeypatch):
    formed, real = [], graphs.simple_edges

    def spy(pairs, *args, **kwargs):
        formed.append(pairs.filter("a <> b").count())
        return real(pairs, *args, **kwargs)

    monkeypatch.setattr(graphs, "simple_edges", spy)
    return formed


def test_pairs_are_formed_once(spark, monkeypatch):
    """Four contigs on one segment, three on another that is linked with it."""
    paths = [(c, "1") for c in range(4)] + [(c, "2") for c in range(4, 7)]
    links = [("1", "-2"), ("-2", "1")]
    formed = spied(monkeypatch)
    got = graphs.flye_edges(spark.createDataFrame(paths, "contig_id long, segment string"), spark.createDataFrame(links, "a string, b string"))
    assert {tuple(r) for r in got.collect()} == plain_flye(paths, links) == set(itertools.combinations(range(7), 2))
    assert formed == [4 * 3 // 2 + 3 * 2 // 2 + 4 * 3]


@pytest.mark.parametrize("links", [[], [("1", "-2"), ("-2", "1"), ("--5", "x"), ("x", "--5")], [("3", None), ("", "2"), ("2", ""), ("-3", "7"), ("7", "-3")]])
def test_odd_names(spark, links):
    names = ["1", "-1", "2", "-2", "--5", "-5", "5", "x", "", "-", "3", "7", "-7"]
    paths = [(k % 9, s) for k, s in enumerate(names)] + [(20 + k, s) for k, s in enumerate(names)] + [(20, "1"), (20, "-1")]
    rows = spark.createDataFrame([*paths, (30, None), (31, None)], "contig_id long, segment string")
    got = graphs.flye_edges(rows, spark.createDataFrame(links, "a string, b string"))
    assert {tuple(r) for r in got.collect()} == plain_flye(paths, links)


def test_more_tasks_for_a_larger_table(spark, monkeypatch):
    monkeypatch.setattr(graphs, "TASK_ROWS", 10)
    rows = spark.range(200).selectExpr("id AS contig_id", "id % 50 AS segment")
    edges = graphs.shared_edges(rows)
    assert edges.count() == 50 * 6 and edges.rdd.getNumPartitions() == 20


@pytest.fixture
def many_parts(spark):
    """More shuffle partitions than a table needs, as on a cluster."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("n, tasks", [(200, 20), (800, 80)])
def test_tasks_hold_as_many_rows_whatever_the_session_says(spark, monkeypatch, many_parts, n, tasks):
    monkeypatch.setattr(graphs, "TASK_ROWS", 10)
    rows = spark.range(n).selectExpr("id AS contig_id", f"id % {n // 4} AS segment")
    assert graphs.segments_of(rows, n).rdd.getNumPartitions() == tasks
    edges = graphs.shared_edges(rows)
    assert edges.rdd.getNumPartitions() == tasks and edges.count() == n // 4 * 6


def plain_spades(paths, links, last_only):
    def ways(s):
        return {s, s[:-1] + ("-" if s.endswith("+") else "+")}

    out = set()
    for a in {r[0] for r in paths}:
        own = sorted((p, s) for c, r, p, s in paths if c == a and r == min(r for c, r, *_ in paths if c == a))
        left = set().union(*(ways(s) for _, s in (own[-1:] if last_only else own) if s is not None))
        mine = set().union(*(ways(s) for _, s in own if s is not None))
        left |= {y for x, y in links if x in mine and y is not None}
        out |= {(min(a, b), max(a, b)) for b, _, _, t in paths if a != b and t in left}
    return out


SPADES_PATHS = [(0, 0, (1, 1), "1+"), (0, 0, (1, 2), "2-"), (0, 3, (0, 9), "7+"), (1, 5, (4, 0), "2+"), (1, 2, (9, 0), "3x"), (1, 2, (3, 7), "4+"), (2, 0, (0, 0), ""), (3, 0, (0, 0), "+"), (4, 0, (0, 0), "x")]
SPADES_PATHS += [(5, 1, (0, 0), "3+"), (6, 1, (0, 0), "7-"), (7, 1, (2, 0), "1-"), (7, 1, (10, 0), "9+"), (8, 4, (0, 0), "4+"), (8, 4, (0, 1), None), (9, 0, (0, 0), "8+"), (9, 0, (0, 0), "8+")]
SPADES_LINKS = [("1-", "9+"), ("9+", "1-"), ("9+", "1-"), ("3x", "x"), ("x", "3x"), ("+", None), (None, "8+"), ("", "8+"), ("8+", ""), ("7+", "7+")]


def spades(spark, last_only=True):
    paths = spark.createDataFrame(SPADES_PATHS, "contig_id long, record int, pos struct<a: long, b: int>, segment string")
    return graphs.spades_edges(paths, spark.createDataFrame(SPADES_LINKS, "a string, b string"), last_only)


@pytest.mark.parametrize("last_only", [True, False])
@pytest.mark.parametrize("task_rows", [3, 500_000])
def test_spades_edges_of_odd_names(spark, monkeypatch, last_only, task_rows):
    monkeypatch.setattr(graphs, "TASK_ROWS", task_rows)
    got = [tuple(r) for r in spades(spark, last_only).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_spades(SPADES_PATHS, SPADES_LINKS, last_only)


def test_spades_edges_shuffle_each_table_once(spark, monkeypatch):
    """Own paths by contig, their segments, links, what is reached, all paths by segment, and the pairs."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(before, ("false", "-1"), strict=True):
        spark.conf.set(k, v)
    try:
        monkeypatch.setattr(graphs, "TASK_ROWS", 2)
        plan = spades(spark)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("+- Exchange ") == 6 and plan.count("ReusedExchange ") == 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
