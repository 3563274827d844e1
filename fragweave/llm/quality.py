"""Quality classifier: random Fourier features of document statistics, ridge by summed normal equations, isotonic calibration.

Statistics describe the whole text: shares of kinds of characters and words, repetition, lines, entropy. Nothing else of a
document is an input. They are standardised by the training rows, mapped by random cosines to an approximation of a Gaussian
kernel, and fitted by ridge regression: each partition sums its part of the normal equations, partitions are summed as a tree.
Raw scores are calibrated by isotonic regression on a fold that the ridge has not seen.

Null texts count as empty and are scored as such. Training rows need a label of 0 or 1 and a text row of their doc_id; of several
labels of one id the smallest counts. Without training rows every score is 0.5; with labels of one kind it is that label.
Repeated doc_ids are scored row by row. Very long texts are read whole. Tied raw scores get one score; calibration counts them together. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, tidy

COSINES, RIDGE, SEED = 192, 3.0, 11
THRESHOLD = 0.3
#: Parts of the normal equations (24 KB each) that are summed apart, and tasks whose sums meet in one group.
CHUNKS, FAN = 16, 1000
#: Labelled ids (8 bytes each) up to which they are broadcast; beyond, texts are shuffled to them.
BROADCAST_IDS = 1_000_000
#: Steps of the raw score that calibration tells apart.
STEPS = 2000

NAMES = (
    "log_chars", "log_words", "letters", "upper", "digits", "spaces", "symbols", "wide", "entropy", "word_length",
    "distinct_words", "top_word", "repeats", "alpha_words", "upper_words", "title_words", "marked_words", "log_lines", "line_length",
    "distinct_lines", "stops", "word_deviation", "char_runs", "distinct_pairs",
)

_KIND = np.zeros(256, np.uint8)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", bytes(range(128, 256))), 1):
    _KIND[list(_chars)] = _k


def statistics(text: str | None) -> list[float]:
    """The values of NAMES; all zero for an empty text."""
    if not text:
        return [0.0] * len(NAMES)
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    n = len(data)
    each = np.bincount(data, minlength=256)
    kinds = np.bincount(_KIND, weights=each, minlength=6) / n
    p = each[each > 0] / n
    words = text.split()
    w = max(1, len(words))
    seen = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    lines = text.split("\n")
    alpha = sum(map(str.isalpha, words))
    return [
        math.log1p(n), math.log1p(len(words)), kinds[1] + kinds[2] + kinds[5], kinds[2], kinds[3], kinds[4], kinds[0], kinds[5], float(-(p * np.log2(p)).sum()), float(lengths.mean()) if words else 0.0,
        len(seen) / w, max(seen.values(), default=0) / w, sum(map(eq, words, words[1:])) / w, alpha / w, sum(map(str.isupper, words)) / w, sum(map(str.istitle, words)) / w, 1 - sum(map(str.isalnum, words)) / w, math.log1p(len(lines)), math.log1p(n / len(lines)),
        len(set(lines)) / len(lines), (each[46] + each[33] + each[63]) / w, float(lengths.std()) if words else 0.0, float(np.count_nonzero(data[1:] == data[:-1])) / n, len(set(zip(words, words[1:], strict=False))) / w,
    ]


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x)."""

    def run(batches):
        for batch in batches:
            rows = [statistics(t.as_py()) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])
        tidy()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, x array<double>")


def labelled_features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, x) of the documents that have a label: all that ``fit`` reads."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    if own.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:  # so that texts stay where they are
        own = F.broadcast(own)
    return features(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(own, "doc_id", "left_semi"))


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


@dataclass
class Model:
    """What scoring needs; its size does not depend on the data."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    raw_at: np.ndarray
    level: np.ndarray

    def cosines(self, x: np.ndarray) -> np.ndarray:
        return cosines((np.clip((x - self.mean) / self.scale, -8, 8)))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.cosines(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.raw_at, self.level)


def cosines(z: np.ndarray, n: int = COSINES, seed: int = SEED) -> np.ndarray:
    """Random features of standardised rows, with the rows themselves and a constant."""
    rng = np.random.default_rng(seed)
    d = z.shape[1]
    w, b = rng.normal(size=(d, n)) / math.sqrt(d), rng.uniform(0, 2 * math.pi, n)
    return np.hstack([math.sqrt(2 / n) * np.cos(z @ w + b), z / math.sqrt(d), np.ones((len(z), 1))])


def _array(batch, k: int) -> np.ndarray:
    column = batch.column(k)
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _summed(rows: DataFrame, fit: Model) -> np.ndarray:
    """The normal equations of (x, y): Z'Z with Z'y as its last column.

    Each task sums its rows; tasks are summed by ``FAN`` and these sums again, so that a group holds no more than the root of
    the number of tasks, in chunks of some rows of the matrix each.
    """

    def part(batches):
        total = None
        for batch in batches:
            z = fit.cosines(_array(batch, 0))
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            got = z.T @ np.hstack([z, y[:, None]])
            total = got if total is None else total + got
        if total is not None:
            task = TaskContext.get().partitionId() // FAN
            for k, rows_ in enumerate(np.array_split(total, CHUNKS)):
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array([task], pa.int32()), pa.array([rows_.tobytes()], pa.binary())], names=["chunk", "task", "sums"])

    def add(key, table):
        got = None
        for s in sorted(table["sums"].to_pylist()):  # in one order, so that reruns agree
            s = np.frombuffer(s)
            got = s if got is None else got + s
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([0], pa.int32()), pa.array([got.tobytes()], pa.binary())], names=["chunk", "task", "sums"])

    schema = "chunk int, task int, sums binary"
    sums = rows.select("x", "y").mapInArrow(part, schema)
    got = sums.groupBy("chunk", "task").applyInArrow(add, schema).groupBy("chunk").applyInArrow(add, schema).collect()
    n = len(fit.weights)
    return np.concatenate([np.frombuffer(r["sums"]) for r in sorted(got, key=lambda r: r["chunk"])]).reshape(n, n + 1)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; the centres of the blocks and their levels."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, y, w, strict=True):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(feats: DataFrame, labels: DataFrame, scratch: Scratch, label: str = "quality", ridge: float = RIDGE) -> Model:
    """Learns from labelled rows outside fold 0; fold 1 calibrates."""
    y = labels.filter(F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("double").alias("y"))
    rows = scratch.keep(feats.join(y, "doc_id").withColumn("fold", fold(F.col("doc_id"))).filter("fold <> 0").select("x", "y", "fold"), "train")
    d, n = len(NAMES), COSINES + len(NAMES) + 1
    fitted = rows.filter("fold <> 1")
    if fitted.limit(1).count() == 0:
        fitted = rows
    at = [F.element_at("x", k + 1) for k in range(d)]
    m = fitted.agg(*[F.avg(c).alias(f"m{k}") for k, c in enumerate(at)], *[F.stddev_pop(c).alias(f"s{k}") for k, c in enumerate(at)], F.min("y").alias("lo"), F.max("y").alias("hi")).first()
    if m["lo"] is None or m["lo"] == m["hi"]:
        level = 0.5 if m["lo"] is None else m["lo"]
        return Model(np.zeros(d), np.ones(d), np.zeros(n), np.array([0.0, 1.0]), np.array([level, level]))
    scale = np.array([m[f"s{k}"] for k in range(d)])
    model = Model(np.array([m[f"m{k}"] for k in range(d)]), np.where(scale > 1e-9, scale, 1.0), np.zeros(n), np.zeros(2), np.zeros(2))
    sums = _summed(fitted, model)
    model.weights = np.linalg.solve(sums[:, :n] + ridge * np.eye(n), sums[:, n])
    held = rows.filter("fold = 1")
    if held.limit(1).count() == 0:
        held = fitted

    def raw(batches):
        for batch in batches:
            steps = np.rint(np.clip(model.raw(_array(batch, 0)), -2, 3) * (STEPS / 5))
            yield pa.record_batch([pa.array(steps.astype(np.int32)), batch.column(1)], names=["step", "y"])

    # as many rows as there are steps, at most
    got = held.select("x", "y").mapInArrow(raw, "step int, y double").groupBy("step").agg(F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("step").toPandas()
    model.raw_at, model.level = isotonic(got["step"].to_numpy() * (5 / STEPS), got["y"].to_numpy(), got["n"].to_numpy().astype(float))
    return model


def score(feats: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def run(batches):
        for batch in batches:
            s = np.clip(model.score(_array(batch, 1)), 0, 1)
            yield pa.record_batch([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    out = feats.mapInArrow(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that the model does not reject."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.array([statistics(t.as_py()) for t in batch.column(at)])
                yield batch.filter(pa.array(model.score(x) >= threshold))
        tidy()

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    scratch = Scratch(spark, "quality")
    feats = scratch.keep(features(docs), "features")
    return score(feats, fit(feats, labels, scratch))
