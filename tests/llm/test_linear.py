"""The native quality score, and the mixing stage without Python on the executors."""

import corpus_pipeline
import pytest
from fragweave.llm import linear, quality
from fragweave.llm.common import read
from pyspark.sql import functions as F


def scored(docs, model):
    return docs.select("doc_id", model.score(F.array(*linear.statistics(F.col("text")))).alias("score"))


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    model = linear.fit(docs, labels)
    rows = scored(docs, model).join(labels, "doc_id").filter(quality.fold(F.col("doc_id")) == 0).collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == k] for k in (1, 0))
    assert good and bad and sum(g > b for g in good for b in bad) >= 0.98 * len(good) * len(bad)
    again = linear.fit(docs.repartition(7), labels)
    assert list(again.weights) == list(model.weights) and again.level == model.level


def test_odd(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, None), (2, ""), (None, "x " * 100_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in (1, 2, 3)], "doc_id long, quality int")
    assert {r["score"] for r in scored(docs, linear.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert {r["score"] for r in scored(docs, linear.fit(docs, labels)).collect()} == {1.0}


def test_mixing_runs_no_python(spark, sf, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("Python on the executors")

    frame = type(spark.range(1))
    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(frame, name, refused)
    docs = read(spark, sf, "documents")
    out = corpus_pipeline.mix_sources(spark, docs, sf)
    assert out.columns == docs.columns and out.count()
    with pytest.raises(AssertionError):
        corpus_pipeline.classify(spark, docs, sf)
