"""The exact index against all pairs: equal rows, few pairs scored, any number of bins."""

import math
import random

import pytest
from fragweave.functions.scoring import threshold
from fragweave.operators import merge, nearest
from fragweave.scratch import Tables
from pyspark.sql import functions as F
from test_sequential import MAX, weight

SCHEMA = "contig_id long, profile array<double>, coverage array<double>"


def made(n, rng, centres, far=0.1):
    """Clusters of one genome each, some rows far from all, some repeated."""
    out = []
    for k in range(n):
        c, depth = centres[rng.randrange(len(centres))]
        wide = 0.002 if rng.random() > far else 0.3
        out.append((k, [x + rng.gauss(0, wide) for x in c], [max(1e-4, rng.gauss(depth, 2)), rng.choice([1e-4, 3.0])]))
    return out + [(n + k, *out[k][1:]) for k in range(10)]


@pytest.fixture(scope="module")
def clusters():
    rng = random.Random(11)
    centres = [([rng.uniform(0, 0.08) for _ in range(8)], rng.uniform(5, 60)) for _ in range(25)]
    return made(120, rng, centres), made(700, rng, centres, 0.03)


def plain(rows, bins, limit=None, allowed=lambda a, b: True):
    out = {}
    for k, p, c in rows:
        every = [(weight((p, c), (q, d)), b) for b, q, d in bins if allowed(k, b)]
        every = [x for x in every if x[0] < MAX and (limit is None or x[0] <= limit)]
        if every:
            out[k] = min(every)
    return out


def same(got, want, bins, rows):
    assert set(got) == set(want)
    feature, own = {b: (q, d) for b, q, d in bins}, {k: (p, c) for k, p, c in rows}
    for k, (w, b) in want.items():
        assert math.isclose(got[k][0], w, rel_tol=1e-7, abs_tol=1e-9)
        # the smaller id of equal bins; another one only where rounding decides
        assert got[k][1] == b or (feature[got[k][1]] != feature[b] and math.isclose(weight(own[k], feature[got[k][1]]), w, rel_tol=1e-9))


@pytest.mark.parametrize("travel", [True, False])
def test_equals_all_pairs(spark, clusters, monkeypatch, travel):
    rows, bins = clusters
    monkeypatch.setattr(nearest, "BLOCK", 16)
    if not travel:
        monkeypatch.setattr(nearest, "TRAVEL", 0)
    own, every = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(bins, SCHEMA).withColumnRenamed("contig_id", "bin_id")
    got = {r["contig_id"]: (r["weight"], r["bin_id"]) for r in nearest.best(own, "contig_id", every).collect()}
    want = plain(rows, bins)
    assert len(want) < len(rows)  # some are too far from all
    same(got, want, bins, rows)


def test_few_pairs_are_scored(spark, clusters, monkeypatch):
    rows, bins = clusters
    monkeypatch.setattr(nearest, "BLOCK", 16)
    own, every = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(bins, SCHEMA).withColumnRenamed("contig_id", "bin_id")
    found = nearest.index(every, len(bins), Tables(spark, "t"))
    assert found.bounds.count() <= nearest.PIVOTS + len(bins) // 16 + 1
    met = nearest.candidates(own, found, None).join(found.blocks, ["_q", "_block"])
    ring = F.filter("_bins", lambda b: F.abs(b["_d"] - F.col("_dq")) <= F.col("_r"))
    scored = met.agg(F.sum(F.size(ring))).first()[0]
    print("share of pairs scored:", scored / (len(rows) * len(bins)))
    assert scored < 0.3 * len(rows) * len(bins)


def test_merge_neighbours_of_many(spark, clusters, monkeypatch):
    _, bins = clusters
    bins = bins[:250]
    monkeypatch.setattr(nearest, "BLOCK", 16)
    limit = threshold(0.1) * 3
    every = spark.createDataFrame([(k, [str(k % 3)], p, c) for k, p, c in bins], "bin_id long, markers array<string>, profile array<double>, coverage array<double>")
    got = {r["bin_id"]: (r["weight"], r["partner"]) for r in merge.merge_neighbours(every, limit).collect()}
    want = plain(bins, bins, limit, lambda a, b: a % 3 != b % 3)
    assert want
    same(got, want, bins, bins)


def test_odd_rows(spark, clusters):
    _, bins = clusters
    bins = [*bins[:90], (900, None, [1.0, 1.0]), (901, [0.0] * 8, None)]
    every = spark.createDataFrame(bins, SCHEMA).withColumnRenamed("contig_id", "bin_id")
    rows = [(0, None, [1.0, 1.0]), (1, bins[3][1], None), (2, bins[3][1], bins[3][2]), (3, [9.0] * 8, [1.0, 1.0])]
    got = [r["contig_id"] for r in nearest.best(spark.createDataFrame(rows, SCHEMA), "contig_id", every).collect()]
    assert got == [2]
    assert nearest.best(every.limit(0).withColumnRenamed("bin_id", "contig_id"), "contig_id", every).count() == 0
    assert nearest.best(spark.createDataFrame(rows, SCHEMA), "contig_id", every.limit(0)).count() == 0


def test_radius(spark):
    """The weight at the radius is the weight asked for, and smaller ones have smaller radii."""
    asked = [0.001, 0.0093, 0.05, 0.5, 1.0, 4.0, 20.0, 80.0, 250.0, 800.0, MAX]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in asked], "w double").select(nearest.radius(F.col("w"))).collect()]
    assert got[0] == -1 and got[-1] == nearest.FARTHEST == got[-2] and got == sorted(got)
    for w, r in zip(asked[2:-2], got[2:-2], strict=True):
        same_, other = (math.exp(-((r - m) ** 2) / (2 * s * s)) / s for m, s in ((0, 0.01037897 / 2), (0.0676654, 0.03419337)))
        assert math.isclose(-math.log10(same_ / (same_ + other)), w, rel_tol=1e-5, abs_tol=1e-6)


@pytest.mark.parametrize("copies", [1, 3])
def test_copies_are_one_class(spark, clusters, copies, monkeypatch):
    """Copies do not add pairs; a copy's nearest other bin, and the smaller id on ties, are as among all pairs."""
    rows, _ = clusters
    bins = [(b + k * 1000, p, c) for k in range(copies) for b, p, c in rows]
    met = []
    whole = nearest.best

    def counted(own, key, every, *args):
        met.append((own.count(), every.count()))
        return whole(own, key, every, *args)

    monkeypatch.setattr(nearest, "best", counted)
    frame = spark.createDataFrame(bins, SCHEMA).withColumnRenamed("contig_id", "bin_id")
    got = {r["own"]: (r["weight"], r["bin_id"]) for r in nearest.best_other(frame).collect()}
    assert met == [(120, 120)]
    same(got, plain(bins, bins, allowed=lambda a, b: a != b), bins, bins)
    # copies with a marker never meet; without any they do
    marked = frame.withColumn("markers", F.when(F.col("bin_id") % 2 == 0, F.array(F.lit("m"))).otherwise(F.array().cast("array<string>")))
    got = {r["bin_id"]: (r["weight"], r["partner"]) for r in merge.merge_neighbours(marked, 30.0).collect()}
    same(got, plain(bins, bins, 30.0, lambda a, b: a != b and (a % 2 == 1 or b % 2 == 1)), bins, bins)
