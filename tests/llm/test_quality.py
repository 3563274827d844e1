"""Quality classifier: held-out accuracy, calibration and odd rows."""

import zlib

import numpy as np
from fragweave.llm import quality
from fragweave.llm.common import Scratch, read


def auc(y, s):
    y, s = np.array(y), np.array(s)
    a, b = s[y == 1][:, None], s[y == 0][None, :]
    return ((a > b) + 0.5 * (a == b)).mean()


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    docs, labels = read(spark, path, "documents"), read(spark, path, "labels")
    out = {r["doc_id"]: r for r in quality.query(spark, docs, labels).collect()}
    assert len(out) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for i, r in out.items())
    y = [(r["quality"], out[r["doc_id"]]) for r in labels.collect() if out[r["doc_id"]]["held_out"]]
    score = auc([q for q, _ in y], [r["score"] for _, r in y])
    right = np.mean([q == r["predicted"] for q, r in y])
    print("held out", len(y), "auc", score, "accuracy", right)
    assert score > 0.9 and right > 0.9


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a " * 100_000), (None, "x"), (3, " \n"), (4, "漢字" * 50)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.query(spark, docs, none).collect()
    assert len(got) == 6 and all(r["score"] == 0.5 for r in got)
    ones = spark.createDataFrame([(1, 1), (2, 1), (3, None), (4, 1), (3, 7), (None, 1)], "doc_id long, quality int")
    assert all(r["score"] == 1.0 for r in quality.query(spark, docs, ones).collect())
    assert quality.query(spark, docs.limit(0), ones).count() == 0
    scratch = Scratch(spark, "t")
    model = quality.fit(quality.features(docs), ones, scratch)
    assert quality.accepted(docs, model).columns == docs.columns and quality.accepted(docs, model).count() == 6


def test_isotonic_is_the_monotone_fit():
    at, level = quality.isotonic(np.arange(5.0), np.array([0, 1, 0, 1, 1.0]), np.ones(5))
    assert list(at) == [0, 1.5, 3.5] and list(level) == [0, 0.5, 1]


def test_equals_a_direct_fit(spark, sf):
    """Means, cosines, ridge and calibration computed at once, in one place, by formula."""
    docs, labels = read(spark, sf, "documents").repartition(5), read(spark, sf, "labels")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    y = {r["doc_id"]: r["quality"] for r in labels.collect() if r["doc_id"] in texts}
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i in texts}
    x = {i: np.array(quality.statistics(t)) for i, t in texts.items()}
    own = sorted(i for i in y if fold[i] > 1)
    rows = np.array([x[i] for i in own])
    mean, sd = rows.mean(axis=0), rows.std(axis=0)
    sd[sd <= 1e-9] = 1.0
    rng, d, n = np.random.default_rng(quality.SEED), len(quality.NAMES), quality.COSINES
    w, b = rng.normal(size=(d, n)), rng.uniform(0, 2 * np.pi, n)

    def mapped(ids):
        z = np.clip((np.array([x[i] for i in ids]) - mean) / sd, -8, 8) / np.sqrt(d)
        return np.concatenate([np.sqrt(2 / n) * np.cos(z @ w + b), z, np.ones((len(ids), 1))], axis=1)

    z = mapped(own)
    # ridge by its other form: the least squares of the rows with ridge rows below them
    tall = np.vstack([z, np.sqrt(quality.RIDGE) * np.eye(z.shape[1])])
    direct = np.linalg.lstsq(tall, np.concatenate([[y[i] for i in own], np.zeros(z.shape[1])]), rcond=None)[0]
    scratch = Scratch(spark, "t")
    model = quality.fit(scratch.keep(quality.features(docs), "f"), labels, scratch)
    assert np.allclose(model.weights, direct, atol=1e-6)
    assert np.allclose(quality.fit(quality.labelled_features(docs, labels), labels, scratch).weights, direct, atol=1e-6)

    step = 5 / quality.STEPS
    held = sorted((round(float(r) / step) * step, y[i]) for i, r in zip([i for i in y if fold[i] == 1], mapped([i for i in y if fold[i] == 1]) @ direct, strict=True))
    at, want = sorted({r for r, _ in held}), []
    mean_of = lambda lo, hi: np.mean([q for r, q in held if lo <= r <= hi])
    for v in at:  # the monotone fit by its max-min formula
        want.append(max(min(mean_of(lo, hi) for hi in at if hi >= v) for lo in at if lo <= v))
    for level, centre in zip(model.level, model.raw_at, strict=True):
        assert min(abs(level - v) for v in want) < 1e-9 and at[0] - 1e-9 <= centre <= at[-1] + 1e-9
    assert len(set(np.round(want, 9))) == len(model.level)


def test_cosines_are_a_gaussian_kernel():
    x = np.random.default_rng(0).normal(size=(6, 10))
    z = quality.cosines(x, 40_000)[:, :40_000]
    want = np.exp(-((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2) / (2 * 10))
    assert np.abs(z @ z.T - want).max() < 0.03
