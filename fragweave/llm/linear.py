"""A linear score of quality in DataFrame operators alone, for stages that run no Python on the executors.

Shares of kinds of characters, variety of words and lines, and lengths are taken in thousandths, as whole numbers, so the sums of the normal equations are exact and
reruns agree. The ridge is solved in the driver; its size does not depend on the data. The score is the fitted value, between 0 and 1.

Rows outside fold 0 with a label of 0 or 1 are learned from, of several labels of one id the smallest, as in ``quality``. Without them every score is 0.5;
with labels of one kind it is that label. Null texts count as empty; very long texts are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import BROADCAST_IDS, fold

RIDGE = 3.0


def statistics(text: Column) -> list[Column]:
    """Of a text, as thousandths; all zero for an empty one but for what counts its one line."""
    t = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.length(t), F.lit(1))
    words, lines = F.split(t, r"\s+"), F.split(t, "\n")

    def share(other: str) -> Column:
        return F.length(F.regexp_replace(t, other, "")) / chars

    def distinct(values: Column) -> Column:
        return F.size(F.array_distinct(values)) / F.size(values)

    every = [
        F.log1p(F.length(t)), share(r"[^\p{L}]+"), share("[^A-Z]+"), share("[^0-9]+"), share(r"\S+"), share("[^.!?]+"), F.log1p(chars / F.size(words)),
        distinct(words), F.log1p(F.size(lines)), distinct(lines),
    ]
    return [F.round(c * 1000).cast("long") for c in every]


@dataclass
class Model:
    at: np.ndarray
    weights: np.ndarray
    level: float

    def score(self, x: Column) -> Column:
        """Of an array of ``statistics``."""
        total = F.lit(float(self.level))
        for k, (m, w) in enumerate(zip(self.at, self.weights, strict=True)):
            total = total + (x[k] - F.lit(float(m))) * F.lit(float(w))
        return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """docs: (doc_id, text). Only texts with a label are read."""
    y = labels.filter(F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("long").alias("y")).filter(fold(F.col("doc_id")) != 0)
    if y.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:  # so that texts stay where they are
        y = F.broadcast(y)
    d = len(statistics(F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(y, "doc_id").select(F.array(*statistics(F.col("text"))).alias("x"), "y")
    cells = [F.col("x")[k] for k in range(d)] + [F.col("y"), F.lit(1).cast("long")]
    # sums of products of whole numbers: one row, whatever the data
    sums = rows.agg(*[F.sum((cells[i] * cells[j]).cast("decimal(38,0)")).alias(f"s{i}_{j}") for i in range(d + 2) for j in range(i, d + 2)]).first()
    s = np.array([[float(sums[f"s{min(i, j)}_{max(i, j)}"] or 0) for j in range(d + 2)] for i in range(d + 2)])
    n = s[d + 1, d + 1]
    if not n:
        return Model(np.zeros(d), np.zeros(d), 0.5)
    mean = s[d + 1, : d + 1] / n
    spread = s[: d + 1, : d + 1] / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(spread)[:d], 0))
    scale = np.where(scale > 1e-6, scale, np.inf)  # what does not vary has no weight
    z = spread[:d, :d] / np.outer(scale, scale)
    weights = np.linalg.solve(z + RIDGE / n * np.eye(d), spread[:d, d] / scale) / scale
    return Model(mean[:d], weights, float(mean[d]))
