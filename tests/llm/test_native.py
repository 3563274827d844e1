"""Sharding and mixing against brute force, with their laws."""

import itertools
import math
import random
import struct
import zlib
from collections import defaultdict

import pytest
import xxhash
from fragweave.llm import mixing, sharding
from fragweave.llm.common import read

ODD = [(900, None, None), (901, "", "src0"), (902, "a b", None), (None, "a b", "zz"), (903, "a b", "zz"), (903, "a b", "zz"), (904, "x " * 5000, "src1")]


@pytest.fixture(scope="module")
def docs(spark, sf):
    odd = spark.createDataFrame([(*r, 1, 1) for r in ODD], "doc_id long, text string, source string, size long, shard int")
    return read(spark, sf, "documents").selectExpr("doc_id", "text", "source", "n_chars as size", "1 as shard").union(odd)


def feasible(sizes, shards, capacity):
    used, left = 1, capacity
    for s in sizes:
        if s > left:
            used, left = used + 1, capacity
        left -= s
    return used <= shards


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards(spark, docs, shards):
    got = [r.asDict() for r in sharding.shard(docs, shards).collect()]
    assert len(got) == docs.count()
    groups, size, slots = defaultdict(set), defaultdict(int), defaultdict(list)
    for r in got:
        groups[r["text_key"] and bytes(r["text_key"])].add(r["shard"])
        size[r["text_key"] and bytes(r["text_key"])] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(len(s) == 1 for s in groups.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    order = sorted(size, key=lambda k: (k is not None, k))
    assert [next(iter(groups[k])) for k in order] == sorted(next(iter(groups[k])) for k in order)
    sizes = [size[k] for k in order]
    largest = max(sum(size[k] for k in order if s in groups[k]) for s in slots)
    assert feasible(sizes, shards, largest) and not feasible(sizes, shards, largest - 1)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in got:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))


def test_mix(spark, docs):
    rows = [r.asDict() for r in mixing.query(spark, docs).collect()]
    assert sorted(map(str, rows)) == sorted(str(r.asDict()) for r in mixing.query(spark, docs.repartition(3)).collect())
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r["source"]] += len((r["text"] or "").encode().split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while True:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            open_.remove(s)
        left = 1.5 * sum(sizes.values()) - sum(target.values())
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s])
        assert r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    for s in order:
        assert abs(taken[s] - target[s]) <= largest[s]


@pytest.mark.parametrize("cells", [1, 400, 100_000])
def test_the_capacity_is_the_smallest(spark, cells):
    rng = random.Random(cells)
    for shards, sizes in [(8, [rng.randrange(1, 60) for _ in range(3000)]), (5, [1] * 700), (8, [3, 3, 3]), (4, [10**12] + [rng.randrange(1, 10**11) for _ in range(300)]), (3, [5])]:
        ends = list(itertools.accumulate(sizes))
        groups = spark.createDataFrame(list(zip(sizes, ends, strict=True)), "size long, end long").repartition(3)
        capacity, got = sharding.cuts(groups, shards, cells)
        assert feasible(sizes, shards, capacity) and (capacity == max(sizes) or not feasible(sizes, shards, capacity - 1))
        want, at = [], 0
        for _ in range(shards):
            at = max([e for e in ends if e <= at + capacity], default=at)
            want.append(at)
        assert got == want and got[-1] == ends[-1]


def test_few_rounds_settle_the_search(spark, monkeypatch):
    """The rounds do not grow with the groups: at most three here, and each sends a bounded number of cells."""
    rounds, plain = [], sharding._counted

    def spy(*args):
        got = plain(*args)
        rounds.append(len(got))
        return got

    monkeypatch.setattr(sharding, "_counted", spy)
    groups = spark.range(1, 200_001).selectExpr("1000 + id * 7919 % 5003 AS size", "id").selectExpr("size", "sum(size) OVER (ORDER BY id) AS end")
    sharding.cuts(groups, 8, 4096)
    assert len(rounds) <= 3 and max(rounds) <= 4096 + 8


def plain_key(doc_id, text, weight, seed=17):
    """-ln(u) / w with u from the engine's own 64-bit hash, chained over the columns."""
    h = 42
    for data in (struct.pack("<q", doc_id), text.encode(), struct.pack("<i", seed)):
        h = xxhash.xxh64_intdigest(data, h)
    return -math.log(((h >> 11) + 0.5) / 2**53) / weight


def test_the_chosen_set_is_that_of_the_plain_method(spark):
    """Sorted by exponential keys, taken while they fit, the gap offered to later ones that fit until none does, then the nearest end."""
    docs = [(i, " ".join(["w"] * (1 + (i * 7919) % 60)), "abc"[i % 3], 0.05 + (i % 11) / 5) for i in range(400)]
    docs += [(900, " ".join(["w"] * 900), "a", 50.0), (901, "", "b", 1.0), (902, "w", "c", float("nan")), (903, "w w", "c", None)]
    table = spark.createDataFrame(docs, "doc_id long, text string, source string, weight double").repartition(5)
    got = {r["doc_id"]: r.asDict() for r in mixing.mix(table, weight="weight").collect()}
    assert len(got) == len(docs)
    partly = 0
    for s in "abc":
        own = [(plain_key(i, t, w if w is not None and w >= 0.1 else 0.1), i, len(t.split())) for i, t, x, w in docs if x == s]
        size = sum(n for *_, n in own)
        target = got[own[0][1]]["target"]
        epochs = int(target // size)
        left, used, chosen = target - epochs * size, 0, set()
        for _, i, n in sorted(own):
            used += n
            if n and epochs < 2 and used <= left:
                chosen.add(i)
        gap = left - sum(n for _, i, n in own if i in chosen)
        while epochs < 2:
            more, used = set(), 0
            for _, i, n in sorted(own):
                if n and i not in chosen and n <= gap:
                    used += n
                    if used <= gap:
                        more.add(i)
            if not more:
                break
            chosen |= more
            gap -= sum(n for _, i, n in own if i in more)
        rest = sorted((n, k, i) for k, i, n in own if n and i not in chosen and epochs < 2)
        if rest and rest[0][0] - gap < gap:
            chosen.add(rest[0][2])
        assert {i for _, i, _ in own if got[i]["chosen"]} == chosen
        partly += 0 < len(chosen) < len(own)
        assert all(got[i]["epochs"] == epochs and got[i]["taken"] == n * (epochs + (i in chosen)) for _, i, n in own)
    assert partly >= 2


def ends(rows):
    """By source: target, taken, and twice how far they may be apart: the smallest document that could be taken once more.

    Where none is left, the last one taken is meant, which is not larger than the largest of them.
    """
    out = {}
    for r in rows:
        out.setdefault(r["source"], []).append(r)
    for s, own in out.items():
        open_ = [r for r in own if r["size"] and r["epochs"] < 2]
        left, had = [r["size"] for r in open_ if not r["chosen"]], [r["size"] for r in open_]
        out[s] = own[0]["target"], sum(r["taken"] for r in own), min(left) if left else max(had, default=0)
    return out


@pytest.mark.parametrize("where", ["sf0.001", "sf0.01"])
def test_every_source_ends_near_its_target(spark, where):
    got = ends(mixing.mix(read(spark, f"/root/testdata/{where}", "documents")).collect())
    assert len(got) == 20
    for target, taken, least in got.values():
        assert abs(taken - target) <= ((least or 0) + 1e-6) / 2


def test_small_sources_take_the_nearer_end(spark):
    one = [(k, " ".join(["w"] * n), s) for s, sizes in {"a": [200], "b": [100, 100], "c": [400, 1], "d": [1000] + [10] * 300}.items() for k, n in enumerate(sizes)]
    table = spark.createDataFrame(one, "doc_id long, text string, source string")
    for share in (0.2, 0.7, 1.5):
        for target, taken, least in ends(mixing.mix(table, share=share).collect()).values():
            assert abs(taken - target) <= ((least or 0) + 1e-6) / 2
    two = spark.createDataFrame([(1, "w " * 200, "a"), (2, "w " * 100, "b"), (3, "w " * 100, "b")], "doc_id long, text string, source string")
    got = ends(mixing.mix(two, weights=(1.0,), share=0.75).collect())
    assert got["a"][1] == 200 and got["b"][1] in (100, 200)  # targets of 150: 200 is as near as 100, and nearer than nothing


def test_even_shards(spark):
    rng = random.Random(1)
    some = [([1] * 9, 8), ([1] * 20, 8), ([3, 3, 3], 8), ([500] + [1] * 1000, 8), ([1] * 500 + [500] + [1] * 500, 8)]
    some += [([rng.choice([1, 5, rng.randrange(1, 1000)]) for _ in range(rng.randrange(1, 300))], shards) for shards in (1, 2, 8, 13)]
    for sizes, shards in some:
        for cells in (20,) if len(sizes) < 300 else (sharding.CELLS,):
            at = list(itertools.accumulate(sizes))
            groups = spark.createDataFrame(list(zip(sizes, at, strict=True)), "size long, end long")
            capacity, got = sharding.even_cuts(groups, shards, cells)
            parts = [b - a for a, b in zip([0, *got], got, strict=False)]
            assert set(got) <= set(at) and got[-1] == at[-1] and max(parts) <= capacity and feasible(sizes, shards, capacity)
            assert capacity == max(sizes) or not feasible(sizes, shards, capacity - 1)
            assert sum(p > 0 for p in parts) == min(shards, len(sizes))
            if set(sizes) == {1}:
                assert max(parts) - min(parts) <= 1


def test_equal_texts_fill_every_shard(spark):
    for n, want in ((9, [1] * 7 + [2]), (20, [2, 2, 2, 2, 3, 3, 3, 3])):
        table = spark.createDataFrame([(k, f"{k:02d}", *[0] * 6) for k in range(n)], "doc_id long, text string, slot int, size int, end int, n int, rank int, _tie int")
        rows = sharding.query(spark, table).collect()
        assert sorted(sum(r["shard"] == s for r in rows) for s in range(8)) == want
    same = spark.createDataFrame([(None, "same")] * 50 + [(1, None)] * 3, "doc_id long, text string")
    rows = sharding.query(spark, same).collect()
    assert sorted(r["slot"] for r in rows if r["size"] == 5) == list(range(50)) and {r["shard"] for r in rows} == {0, 1}


def test_mix_prefers_heavier_documents(spark):
    docs = spark.createDataFrame([(i, ("a word of some ten more " * 4) if i % 2 else ("1$ 2# " * 12), "s" if i < 600 else "t") for i in range(800)], "doc_id long, text string, source string")
    rows = mixing.mix(docs, weights=(1.0, 2.0), share=0.9).collect()
    low = [r for r in rows if r["source"] == "s"]
    good = sum(r["taken"] for r in low if r["doc_id"] % 2)
    assert good > 0.5 * sum(r["taken"] for r in low)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.query(spark, none).count() == 0
    assert sharding.query(spark, none).count() == 0
