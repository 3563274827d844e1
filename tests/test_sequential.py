"""The sequential steps against plain versions written from their definitions, on whole tables and on small random graphs.

The plain versions call none of the engine's kernels: weights, matchings, searches and queues are this file's own.
"""

import math
import random
from collections import defaultdict, deque

import duckdb
import numpy as np
import pytest
from fragweave.operators import assign, kernels
from fragweave.plans import catalogue

MAX = 1.7976931348623157e308


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in ("part", "lineitem", "orders", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def normal(x, mean, sd):
    return math.exp(-(((x - mean) / sd) ** 2) / 2) / (sd * math.sqrt(2 * math.pi))


def weight(a, b):
    """a and b: (profile, coverage)."""
    d = math.dist(a[0], b[0])
    same, other = normal(d, 0, 0.01037897 / 2), normal(d, 0.0676654, 0.03419337)

    def poisson(k, rate):
        return math.prod(max(math.exp(x * math.log(y) - math.lgamma(x + 1) - y), 1e-10) for x, y in zip(k, rate, strict=True))

    p, q = (same / (same + other) if same + other else 0.0), min(poisson(a[1], b[1]), poisson(b[1], a[1]))
    return -(math.log10(p) + math.log10(q)) if p * q > 0 else MAX


def cheapest(cost):
    """Pairs of the cheapest matching that uses up the smaller side: successive shortest paths by repeated relaxation."""
    n, m = len(cost), len(cost[0])
    if n > m:
        return sorted((i, j) for j, i in cheapest([list(c) for c in zip(*cost, strict=True)]))
    to = {}  # column to row
    for _ in range(n):
        free = [i for i in range(n) if i not in to.values()]
        row = {i: (0.0, None) for i in free}
        col = {}
        changed = True
        while changed:
            changed = False
            for i, (d, _) in list(row.items()):
                for j in range(m):
                    if to.get(j) != i and d + cost[i][j] < col.get(j, (math.inf,))[0] - 1e-12:
                        col[j] = d + cost[i][j], i
                        changed = True
            for j, (d, _) in col.items():
                if j in to and d - cost[to[j]][j] < row.get(to[j], (math.inf,))[0] - 1e-12:
                    row[to[j]] = d - cost[to[j]][j], j
                    changed = True
        j = min((j for j in col if j not in to), key=lambda j: col[j][0])
        while j is not None:
            i = col[j][1]
            to[j], j = i, row[i][1]
    return sorted((i, j) for j, i in to.items())


def far(adjacent, start):
    out, queue = {start: 0}, deque([start])
    while queue:
        v = queue.popleft()
        for u in adjacent[v]:
            if u not in out:
                out[u] = out[v] + 1
                queue.append(u)
    return out


def feature_of(duck):
    out = {}
    for c, *n in duck.execute("SELECT o_custkey, " + ", ".join(f"count(*) FILTER (o_orderpriority LIKE '{k}%')" for k in range(1, 6)) + ", " + ", ".join(f"count(*) FILTER (o_orderstatus = '{s}')" for s in "FOP") + " FROM orders GROUP BY 1").fetchall():
        out[c] = [x / sum(n[:5]) * 0.02 for x in n[:5]], [max(float(x), 1e-4) for x in n[5:]]
    return out


def plain_matching(duck):
    feature = feature_of(duck)
    own, contigs = defaultdict(set), {}
    for c, m in duck.execute(f"SELECT contig_id, marker FROM ({catalogue.ORACLE['marker_hits']})").fetchall():
        own[c].add(m)
    for m, _, _, c in duck.execute(catalogue.ORACLE["marker_contig_counts"]).fetchall():
        contigs[m] = [int(x) for x in c.split(",")]
    order = [m for _, m, _, _ in sorted(duck.execute(catalogue.ORACLE["marker_iteration_order"]).fetchall())]
    length = dict(duck.execute("SELECT c_custkey, c_acctbal + 1000 FROM customer").fetchall())
    adjacent = defaultdict(set)
    for k in (1, 3):
        for a, b in duck.execute(f"SELECT c_custkey, lead(c_custkey, {k}) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) FROM customer").fetchall():
            if b is not None:
                adjacent[a].add(b)
                adjacent[b].add(a)
    vertices = {}

    def path(c, d):
        if c not in vertices:
            vertices[c] = far(adjacent, c)
        return vertices[c].get(d, -1) + 1

    bins = [[c] for c in contigs[order[0]]]
    held = [set(own[c]) for c in contigs[order[0]]]
    gates = defaultdict(int)
    low, high = catalogue.MATCH_LIMIT, 2 * catalogue.MATCH_LIMIT
    for m in order[1:]:
        todo = [c for c in contigs[m] if not any(c in b for b in bins)]
        if not todo:
            continue
        cost = [[sum(weight(feature[c], feature[d]) for d in b) / len(b) for b in bins] for c in todo]
        rejected, snapshot = [], [list(b) for b in bins]
        for i, j in sorted(cheapest(cost), key=lambda p: p[1]):
            c, total = todo[i], sum(path(todo[i], d) for d in snapshot[j])
            near = total // len(snapshot[j]) <= catalogue.MATCH_FAR
            gates["far"] += cost[i][j] <= low and not near
            gates["clash"] += cost[i][j] <= low and near and bool(held[j] & own[c])
            if cost[i][j] <= low and near and not held[j] & own[c]:
                bins[j].append(c)
                held[j] |= own[c]
                gates["in"] += 1
            elif cost[i][j] > high:
                rejected.append((len(own[snapshot[j][0]]), length[snapshot[j][0]], c, j, total))
        if rejected:
            _, _, c, j, total = max(rejected, key=lambda r: r[:2])
            if total == 0 or total // len(snapshot[j]) >= catalogue.MATCH_FAR:
                bins.append([c])
                held.append(set(own[c]))
                gates["opened"] += 1
    before = [list(b) for b in bins]
    left = {}
    for c in sorted((c for c in own if not any(c in b for b in bins)), key=lambda c: (-length[c], c)):
        options = [(sum(weight(feature[c], feature[d]) for d in b) / len(b), j) for j, b in enumerate(bins) if not held[j] & own[c]]
        if options and min(options)[0] <= catalogue.LEFT_LIMIT:
            j = min(options)[1]
            bins[j].append(c)
            held[j] |= own[c]
            left[c] = j
    return before, left, gates


def test_matching_and_leftovers(spark, sf, duck):
    before, left, gates = plain_matching(duck)
    assert min(gates[g] for g in ("far", "clash", "in")) > 0, gates
    got = sorted(map(tuple, catalogue.matching(spark, sf).select("bin_id", "seq_no", "contig_id").collect()))
    assert got == [(b, k, c) for b, own in enumerate(before) for k, c in enumerate(own)]
    assert left and dict(map(tuple, catalogue.leftover_assign(spark, sf).select("contig_id", "bin_id").collect())) == left


@pytest.mark.parametrize("held", [None, 30])
def test_a_weight_is_formed_once(monkeypatch, held):
    """Over steps in which contigs come back and bins grow; with little room some are formed again, and bins stay the same."""
    if held is not None:
        monkeypatch.setattr(kernels, "HELD", held)
    again = 0
    for seed in range(12):
        rng = random.Random(seed)
        n = 60
        at = [(rng.random(), rng.random()) for _ in range(n)]
        own = {c: {f"m{k}" for k in rng.sample(range(9), rng.randrange(1, 4))} for c in range(n)}
        steps = [[c for c in range(n) if f"m{k}" in own[c]] for k in range(9)]
        lengths = {c: rng.randrange(1000, 9000) for c in range(n)}
        asked = defaultdict(int)

        def weight(a, b, at=at, asked=asked):
            for x in a:
                for y in b:
                    asked[x, y] += 1
            return np.array([[10 * math.dist(at[x], at[y]) for y in b] for x in a]).reshape(len(a), len(b))

        class Afresh(kernels.Means):
            def of(self, contigs):
                return np.array([[sum(10 * math.dist(self.at[c], self.at[d]) for d in m) / len(m) for m in self.bins.members] for c in contigs])

        def both(seen, means, at=at, own=own, steps=steps, lengths=lengths):
            with monkeypatch.context() as patch:
                patch.setattr(kernels, "Means", means)
                bins = kernels.match(steps, own, lengths, seen, lambda pairs: [1] * len(pairs), 3.0, 5.0, 20)
                return kernels.match_left(bins, list(own), own, lengths, seen, 3.0)

        Afresh.at = at
        got = both(weight, kernels.Means)
        assert got.members == both(None, Afresh).members and max(map(len, got.members)) > 2
        assert set(got.means.sums) <= set(own) - set(got.of) and got.means.cells == sum(map(len, got.means.sums.values()))
        again += sum(k - 1 for k in asked.values())
    assert (again == 0) == (held is None)


def test_running_means_hold_the_answer_and_a_block():
    """Five samples, 1500 contigs and bins that grow: beside the means that are asked for, memory takes no more than a few blocks."""
    import tracemalloc

    rng = np.random.default_rng(3)
    n = 3000
    profiles, covs = rng.random((n, 4)) * 0.01, rng.integers(1, 9, (n, 5)).astype(float)

    def weight(a, b):
        return kernels.weights(profiles[a], covs[a], profiles[b], covs[b])

    bins = kernels.Bins()
    bins.means = kernels.Means(weight, bins)
    for c in range(1500):
        bins.open(c, {"a"})
    asked = list(range(1500, n))
    tracemalloc.start()
    try:
        first = bins.means.of(asked).shape
        bins.add(3, 1500, {"b"})
        got = bins.means.of(asked[1:])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert first == (1500, 1500) and peak < 150e6
    want = weight(asked[1:], list(range(1500)))
    want[:, 3] = (want[:, 3] + weight(asked[1:], [1500])[:, 0]) / 2
    assert np.allclose(got, want, rtol=1e-12, atol=0)


def test_gated_assign(spark, sf, duck):
    own = defaultdict(set)
    for c, m in duck.execute(f"SELECT contig_id, marker FROM ({catalogue.ORACLE['marker_hits']})").fetchall():
        own[c].add(m)
    rows = duck.execute("SELECT c_custkey, c_nationkey, c_acctbal + 1000 FROM customer ORDER BY 1").fetchall()
    held = defaultdict(set)
    for c, b, _ in rows:
        if own[c]:
            held[b] = {min(held[b] | {min(own[c])})}
    assert all(held[b] for _, b, _ in rows if any(own[c] for c, x, _ in rows if x == b))
    want = []
    for c, b, n in rows:
        shared = len(own[c] & held[b])
        if not own[c] or shared == 0 or (shared == 1 and n > 100_000):
            want.append((c, b))
            held[b] |= own[c]
    got = sorted(map(tuple, catalogue.gated_assign(spark, sf).select("contig_id", "bin_id").collect()))
    assert got == want and any(own[c] for c, _ in want) and len(want) < len(rows)


def spread(adjacent, of, long, w, depth, limit=None, held=None, own=None, length=None):
    """Offers in a plain list; the least is taken, and offers of the vertices around a new member are made anew."""
    of, out, held, own = dict(of), [], defaultdict(set, {b: set(m) for b, m in (held or {}).items()}), own or {}

    def open_level(v):
        seen, front = {v}, {v}
        while front:
            front = {u for x in front for u in adjacent.get(x, ())} - seen
            seen |= front
            hit = {u for u in front if u in long and u not in of}
            if hit:
                return hit
        return set()

    def offers(v):
        seen, front, got = {v}, {v}, []
        for hop in range(1, depth + 1):
            front = {u for x in front for u in adjacent.get(x, ())} - seen
            seen |= front
            got += [(hop, w.get((v, of[u]), MAX), v, u, of[u]) for u in front if u in of]
            front = {u for u in front if u not in of}
        return got

    queue = [o for v in set().union(*(open_level(s) for s in of if s in long), set()) for o in offers(v)]
    while queue:
        best = min(queue)
        queue.remove(best)
        hop, x, v, u, b = best
        if v in of:
            continue
        shared = own.get(v, set()) & held[b]
        if limit is None:
            fits = x != MAX
        else:
            exempt = not shared or (len(shared) == 1 and length[v] > 100_000) or (hop == 1 and own.get(v, set()) & own.get(u, set()) == shared)
            fits = x < limit and hop <= depth and exempt
        if fits:
            of[v] = b
            out.append((v, b))
            held[b] |= own.get(v, set())
            again = open_level(v)
            queue = [o for o in queue if o[2] not in again] + [o for a in again for o in offers(a)]
    return out


def made_graph(rng):
    n = 26
    adjacent = defaultdict(list)
    for _ in range(34):
        a, b = rng.sample(range(n), 2)
        adjacent[a].append(b)
        adjacent[b].append(a)
    of = {v: rng.randrange(3) for v in rng.sample(range(n), 5)}
    long = set(rng.sample(range(n), 19)) | set(rng.sample(sorted(of), 4))
    return adjacent, of, long, {(v, b): rng.choice([MAX, rng.random(), rng.random()]) for v in range(n) for b in range(3)}


def test_gated_propagation_on_random_graphs():
    from fragweave.operators import kernels  # the code under test

    rng, seen = random.Random(12), 0
    for _ in range(150):
        adjacent, of, long, w = made_graph(rng)
        own = {v: set(rng.sample("ABCDE", rng.randrange(3))) for v in long}
        held = {b: set().union(*(own.get(v, set()) for v, x in of.items() if x == b)) for b in range(3)}
        length = {v: rng.choice([500, 100_000, 100_001]) for v in long}
        depth, limit = rng.choice([1, 2, 10]), rng.choice([0.3, 0.8])
        want = spread(adjacent, of, long, w, depth, limit, held, own, length)
        assert kernels.propagate(adjacent, of, long, w, depth, limit, {b: set(m) for b, m in held.items()}, own, length) == want
        seen += len(want)
    assert seen > 150


def test_final_propagation(spark, sf, duck):
    adjacent = defaultdict(set)
    for by in ("o_custkey", "o_custkey, o_orderpriority"):
        for a, b in duck.execute(f"SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY {by} ORDER BY o_orderdate, o_orderkey) FROM orders").fetchall():
            if b is not None:
                adjacent[a].add(b)
                adjacent[b].add(a)
    rows = duck.execute("SELECT o_orderkey, o_custkey, o_orderstatus, left(o_orderpriority, 1)::INT - 1, o_totalprice FROM orders").fetchall()
    want = set()
    for c in {r[1] for r in rows}:  # a customer's orders are connected
        own = [r for r in rows if r[1] == c]
        of = {r[0]: r[3] for r in own if r[2] == "F"}
        w = {(r[0], b): abs(r[4] / 50_000 - b) for r in own for b in range(5)}
        want |= {(v, b, k) for k, (v, b) in enumerate(spread(adjacent, of, {r[0] for r in own if r[2] != "O"}, w, 10))}
    got = catalogue.final_propagation(spark, sf).select("contig_id", "bin_id", "seq_no").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 300


def test_member_and_seed_weights(spark):
    """Means over all members and over possible ones, in blocks, against sums by hand."""
    import pandas as pd
    from fragweave.operators import kernels

    rng = random.Random(5)
    contigs = [(k, [rng.random() * 0.02 for _ in range(4)], [rng.choice([3.0, 9.0, 2e4])] * 30) for k in range(40)]
    members = [(rng.randrange(6) if k else 7, [rng.random() * 0.02 for _ in range(4)], [rng.choice([3.0, 9.0, 2e4])] * 30) for k in range(50)]
    table = spark.createDataFrame(contigs, "contig_id long, profile array<double>, coverage array<double>").repartition(3)
    before, kernels.CELLS = kernels.CELLS, 2000
    try:
        for possible in (False, True):
            got = {r["contig_id"]: r["weights"] for r in assign.bin_weights(table, pd.DataFrame(members, columns=["bin_id", "profile", "coverage"]), 8, possible).collect()}
            kinds = set()
            for c, *f in contigs:
                for b in range(8):
                    each = [weight(f, m[1:]) for m in members if m[0] == b]
                    n = sum(x < MAX for x in each) if possible else len(each)
                    want = sum(each) / n if n and not math.isinf(sum(each)) else MAX
                    kinds.add((n == 0, want == MAX))
                    assert got[c][b] == pytest.approx(want, rel=1e-9)
            assert len(kinds) >= 2
    finally:
        kernels.CELLS = before
