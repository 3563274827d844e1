"""Operators against plain Python on small random inputs."""

import itertools
import math
import random

import numpy as np
import pytest
from fragweave.functions import scoring, sequences
from fragweave.functions.scoring import MAX_WEIGHT
from fragweave.operators import assign, features, graphs, kernels, markers, merge
from pyspark.sql import functions as F


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_kmers(spark):
    seqs = {1: "ACGTNACGTTTT", 2: "ACG", 3: "aaaa", 4: "GGGGCCCC", 5: ""}
    df = spark.createDataFrame(list(seqs.items()), "contig_id int, seq string")
    want = {}
    for i, s in seqs.items():
        s = "".join(c if c in "ACGT" else "A" for c in s)
        for p in range(len(s) - 3):
            k = s[p : p + 4]
            k = min(k, k.translate(str.maketrans("ACGT", "TGCA"))[::-1])
            want[i, k] = want.get((i, k), 0) + 1
    assert {(r[0], r[1]): r[2] for r in features.kmer_counts(df).collect()} == want
    index = sequences.canonical_index()
    assert len(index) == 136
    for r in features.dense_profiles(df).collect():
        total = sum(n for (i, _), n in want.items() if i == r["contig_id"])
        assert r["profile"] == pytest.approx([want.get((r["contig_id"], k), 0) / max(1, total) for k in index])


def test_lgamma_and_probabilities(spark):
    xs = [1.0, 1.0001, 2.5, 30.2, 1e5]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(scoring.lgamma(F.col("x"))).collect()]
    assert got == pytest.approx([math.lgamma(x) for x in xs], rel=1e-12, abs=1e-12)
    rng = np.random.default_rng(2)
    p, c = rng.random((6, 8)) * 0.05, rng.random((6, 3)) * 20 + 1e-4
    df = spark.createDataFrame([(int(a), int(b), *[list(map(float, v)) for v in (p[a], c[a], p[b], c[b])]) for a in range(6) for b in range(6)], "a int, b int, pa array<double>, ca array<double>, pb array<double>, cb array<double>")
    w = kernels.weights(p, c, p, c)
    for r in df.withColumn("w", scoring.pair_weight(F.col("pa"), F.col("ca"), F.col("pb"), F.col("cb"))).collect():
        assert r["w"] == pytest.approx(w[r["a"], r["b"]], rel=1e-6)


def test_many_samples_vanish():
    a, b = np.full((1, 33), 1e-4), np.full((1, 33), 1e4)
    assert kernels.weights(np.zeros((1, 2)), a, np.zeros((1, 2)), b)[0, 0] == MAX_WEIGHT


def graph(rng, n, m):
    return {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}


def distances(edges, start, stop=()):
    adjacent = {}
    for a, b in edges:
        adjacent.setdefault(a, set()).add(b)
        adjacent.setdefault(b, set()).add(a)
    dist, front = {start: 0}, [start]
    while front:
        step = []
        for v in front:
            if v in stop and v != start:
                continue
            for n in adjacent.get(v, ()):
                if n not in dist:
                    dist[n] = dist[v] + 1
                    step.append(n)
        front = step
    return dist


def test_graph_searches(spark):
    rng = random.Random(4)
    n = 40
    edges = graph(rng, n, 36) | {(k, k + 1) for k in range(30, 39)}
    e = spark.createDataFrame(sorted(edges), "src int, dst int")
    v = spark.createDataFrame([(k,) for k in range(n)], "id int")
    reach = {k: distances(edges, k) for k in range(n)}
    assert rows(graphs.components(v, e)) == [(k, min(reach[k])) for k in range(n)]
    assert rows(graphs.isolated(v, e)) == [(k,) for k in range(n) if len(reach[k]) == 1]
    some = v.filter("id % 6 = 0")
    starts = [k for k in range(n) if k % 6 == 0]
    assert rows(graphs.hops(e, some, 3)) == sorted((s, i, d) for s in starts for i, d in reach[s].items() if d <= 3)
    assert rows(graphs.hops(e, some, None)) == sorted((s, i, d) for s in starts for i, d in reach[s].items())
    labelled = {k for k in range(n) if k % 5 == 1}
    lab = v.filter("id % 5 = 1")
    assert rows(graphs.first_labelled(e, some, lab, 4)) == sorted((s, i, d) for s in starts for i, d in distances(edges, s, labelled).items() if i in labelled and 0 < d <= 4)
    want = []
    for s in starts:
        hit = {i: d for i, d in reach[s].items() if i in labelled and d > 0}
        want += [(s, i, d) for i, d in hit.items() if d == min(hit.values())]
    assert rows(graphs.nearest_level(e, some, lab)) == sorted(want)
    parts = graphs.components(v, e)
    marked = {min(reach[k]) for k in labelled}
    assert {r[0] for r in graphs.with_labelled(parts, lab).collect()} == {k for k in range(n) if min(reach[k]) in marked}


def test_edges_from_paths(spark):
    paths = spark.createDataFrame([(0, 0, 0, "1+"), (0, 0, 1, "2+"), (1, 2, 0, "2-"), (2, 4, 0, "9+"), (3, 6, 0, "1+"), (3, 6, 1, "8+")], "contig_id int, record int, pos int, segment string")
    links = spark.createDataFrame([("8-", "9+"), ("9+", "8-")], "a string, b string")
    # 0 and 1 share 2 by its reverse; 3 and 2 are linked; 0 and 3 share 1, which is the last segment of neither
    assert rows(graphs.spades_edges(paths, links)) == [(0, 1), (2, 3)]
    assert rows(graphs.spades_edges(paths, links, last_only=False)) == [(0, 1), (0, 3), (2, 3)]
    flye = spark.createDataFrame([(0, "1"), (0, "-2"), (1, "2"), (2, "7"), (3, "5")], "contig_id int, segment string")
    links = spark.createDataFrame([("-5", "-7"), ("-7", "-5")], "a string, b string")
    assert rows(graphs.flye_edges(flye, links)) == [(0, 1), (2, 3)]


def test_markers(spark):
    h = spark.createDataFrame([(1, 10, "A"), (2, 11, "A"), (3, 10, "A"), (4, 11, "B"), (5, 12, "B"), (6, 12, "C")], "line_no int, contig_id int, marker string")
    assert rows(markers.marker_contigs(h)) == [("A", [10, 11], 2, 1), ("B", [11, 12], 2, 4), ("C", [12], 1, 6)]
    assert [tuple(r) for r in markers.marker_order(h).orderBy("step").collect()] == [(0, "B", 2, 4), (1, "A", 2, 3), (2, "C", 1, 2)]
    assert rows(markers.seed_bins(h)) == [(0, 11), (1, 12)]
    edge = spark.createDataFrame([(1, "x", "M", 100, 0, 50), (2, "x", "M", 100, 0, 51)], "line_no int, contig string, marker string, qlen int, hmm_from int, hmm_to int")
    assert [r["line_no"] for r in markers.passing_hits(edge, None, 0, 0.5).collect()] == [2]


@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (5, 3), (4, 4), (6, 2)])
def test_assignment_is_the_cheapest(shape):
    rng = np.random.default_rng(sum(shape))
    for _ in range(30):
        cost = np.round(rng.random(shape) * 10, 1)
        cost[rng.random(shape) < 0.2] = MAX_WEIGHT
        got = kernels.assignment(cost)
        n = min(shape)
        assert len(got) == n == len({a for a, _ in got}) == len({b for _, b in got})

        def value(pairs, cost=cost):
            picked = [cost[a, b] for a, b in pairs]
            return sum(x == MAX_WEIGHT for x in picked), round(sum(x for x in picked if x < MAX_WEIGHT), 6)

        if shape[0] <= shape[1]:
            every = [list(enumerate(p)) for p in itertools.permutations(range(shape[1]), n)]
        else:
            every = [[(a, b) for b, a in enumerate(p)] for p in itertools.permutations(range(shape[0]), n)]
        assert value(got) == min(map(value, every))


def test_matching_rules():
    table = {(2, 0): 1.0, (2, 1): 9.0, (3, 0): 9.0, (3, 1): 9.0, (4, 0): 0.5, (4, 1): 9.0}

    def weight(a, b):
        return np.array([[table.get((x, y), 1.0) for y in b] for x in a])

    own = {0: {"A"}, 1: {"A"}, 2: {"B"}, 3: {"B"}, 4: {"B"}}
    lengths = dict.fromkeys(own, 5000)
    bins = kernels.match([[0, 1], [2, 3]], own, lengths, weight, lambda pairs: [0] * len(pairs), 2.0, 4.0, 20)
    assert bins.members == [[0, 2], [1], [3]]  # 3 is too unlike and far, so it opens a bin
    near = kernels.match([[0, 1], [2, 3]], own, lengths, weight, lambda pairs: [3] * len(pairs), 2.0, 4.0, 20)
    assert near.members == [[0, 2], [1]]
    far = kernels.match([[0, 1], [2]], own, lengths, weight, lambda pairs: [30] * len(pairs), 2.0, 4.0, 20)
    assert far.members == [[0], [1]]
    assert kernels.match_left(near, [4], own, lengths, weight, 2.0).members == [[0, 2], [1]]  # B is taken in the one, unlike in the other
    assert kernels.match([], {}, {}, weight, lambda pairs: [0] * len(pairs), 1, 1, 1).members == []


def test_gate(spark):
    markers_ = {1: {"A"}, 2: {"A"}, 3: {"A", "B"}, 4: set(), 5: {"C"}}
    lengths = {1: 10, 2: 200_000, 3: 10, 4: 1, 5: 1}
    want = [(1, 0), (2, 0), (4, 0), (5, 0)]
    assert kernels.gated([(k, 0) for k in markers_], {}, markers_, lengths) == want
    cand = spark.createDataFrame([(k, 0) for k in (5, 3, 1, 2, 4)], "contig_id long, bin_id long")
    own = spark.createDataFrame([(k, sorted(m)) for k, m in markers_.items() if m], "contig_id long, markers array<string>")
    held = spark.createDataFrame([(0, [])], "bin_id long, markers array<string>")
    size = spark.createDataFrame(list(lengths.items()), "contig_id long, length int")
    assert rows(assign.gated_assign(cand, held, own, size)) == want


def slow_propagate(adjacent, of, long, weight, depth):
    """Rebuilds all offers of withdrawn vertices by scanning the whole queue."""
    of, queue, out = dict(of), [], []

    def free(v):
        return v in long and v not in of

    def offers(v):
        return [(d, weight.get((v, of[u]), MAX_WEIGHT), v, u, of[u]) for u, d in kernels._labelled(adjacent, v, depth, of)]

    for v in sorted({x for s in of if s in long for x in kernels._level(adjacent, s, free)}):
        queue += offers(v)
    while queue:
        best = min(queue)
        queue.remove(best)
        _, w, v, _, b = best
        if v in of or w == MAX_WEIGHT:
            continue
        of[v] = b
        out.append((v, b))
        again = set(kernels._level(adjacent, v, free))
        queue = [o for o in queue if o[2] not in again] + [o for x in sorted(again) for o in offers(x)]
    return out


def test_propagation(spark):
    rng = random.Random(8)
    for _ in range(20):
        n = 30
        adjacent = {}
        for a, b in graph(rng, n, 40):
            adjacent.setdefault(a, []).append(b)
            adjacent.setdefault(b, []).append(a)
        of = {v: rng.randrange(3) for v in rng.sample(range(n), 4)}
        long = set(rng.sample(range(n), 22)) | set(of)
        weight = {(v, b): rng.choice([MAX_WEIGHT, round(rng.random(), 3)]) for v in range(n) for b in range(3)}
        assert kernels.propagate(adjacent, of, long, weight, 4) == slow_propagate(adjacent, of, long, weight, 4)
    chain = {0: [1], 1: [0, 2], 2: [1]}
    w = {(v, 0): 0.5 for v in range(3)}
    assert kernels.propagate(chain, {0: 0}, {0, 1, 2}, w, 1, limit=0.4) == []
    assert kernels.propagate(chain, {0: 0}, {0, 1, 2}, w, 1, limit=0.6, markers={1: {"A"}}, bins_markers={0: {"A"}}, lengths={1: 5}) == []
    assert kernels.propagate(chain, {0: 0}, {0, 1, 2}, w, 1, limit=0.6, markers={0: {"A"}, 1: {"A"}}, bins_markers={0: {"A"}}, lengths={1: 5})[0] == (1, 0)


def test_merge_and_judge(spark):
    p = [0.1] * 4
    bins = spark.createDataFrame([(0, ["A"], p, [5.0]), (1, ["B"], p, [5.0]), (2, ["A"], p, [5.0]), (3, ["A", "B"], p, [5.0])], "bin_id int, markers array<string>, profile array<double>, coverage array<double>")
    near = merge.merge_neighbours(bins, 100.0)
    assert rows(near.select("bin_id", "partner")) == [(0, 1), (1, 0), (2, 1)]
    groups = merge.cliques(bins, near)
    assert rows(groups.select("clique")) == [("0_1",), ("1_2",), ("3",)]
    members = spark.createDataFrame([(b, 10 * b) for b in range(4)], "bin_id int, contig_id int")
    sizes = merge.bin_sizes(members, spark.createDataFrame([(10 * b, 100) for b in range(4)], "contig_id int, length int"))
    judged = merge.judged(groups, sizes, bins, 9, 0.33333, 200)
    assert rows(judged.select("clique", "size", "weak", "quality")) == [("0_1", 200, False, "final"), ("1_2", 200, False, "final"), ("3", 100, True, "low")]
    every = merge.results(judged, members)
    assert rows(every.filter("contig_id = 10").select("clique")) == [("0_1",), ("1_2",)]
    assert rows(merge.final_of(every).select("contig_id", "clique")) == [(0, "0_1"), (10, "1_2"), (20, "1_2"), (30, "3")]
    seqs = spark.createDataFrame([(30, "r", "AC")], "contig_id int, record_id string, seq string")
    assert rows(merge.with_sequences(seqs, merge.final_of(every))) == [("low", "bin_3", "r", "AC")]


def test_checked_limits(spark):
    with pytest.raises(ValueError, match="more than 3"):
        assign.checked(spark.range(10), 3, "things")
    with pytest.raises(ValueError):
        scoring.threshold(0)
