"""A corpus pipeline over ``documents``: each stage's output is written as Parquet and read as the next one's input.

A stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last return the columns of documents,
and any further ones, whatever their names. Rows are told apart by all their columns; null doc_ids and null, empty or very long
texts pass as the operators define; an empty table gives an empty result.
"""

from __future__ import annotations

from fragweave.llm import bpe, linear, lines, mixing, neardup, quality
from fragweave.llm.common import Scratch, read, rows_as_structs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _digest(row: Column, names: list[str]) -> Column:
    """Of all columns: each as its length and value, or a mark for null, so that unlike rows never spell the same."""
    value = [row[c].cast("string") for c in names]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in value]), 256)


def _numbered(scratch: Scratch, docs: DataFrame, model: linear.Model | None = None) -> DataFrame:
    """(row, digest, n): whole rows under numbers of their own, which are given once, when written; with a model also its score."""
    held = rows_as_structs(docs)
    score = [model.score(F.array(*linear.statistics(F.col("row.text")))).alias("score")] if model else []
    return scratch.keep(held.select("row", *score, _digest(F.col("row"), docs.columns).alias("digest"), F.monotonically_increasing_id().alias("n")), "numbered")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents and drops those that score under the threshold."""
    labels = read(spark, sf_dir, "labels")
    return quality.accepted(docs, quality.fit(quality.labelled_features(docs, labels), labels, Scratch(spark, "classify")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's boilerplate lines out of its documents; every document stays."""
    out = lines.dedup(rows_as_structs(docs).select("row", "row.text", "row.source"), "source")
    own = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[own.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id; of equal rows one stays.

    Rows are judged under numbers of their own, so null and repeated doc_ids are grouped by their texts as well. A null
    doc_id comes after all others, and rows of one doc_id go by their digest.
    """
    numbered = _numbered(Scratch(spark, "nearcopies"), docs)
    judged = neardup.near_dups(numbered.select(F.col("n").alias("doc_id"), "row.text", F.col("row.doc_id").alias("id"), "digest"), carry=("id", "digest"))
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "digest", F.col("doc_id").alias("n"))).alias("first")
    of_group = judged.groupBy("component_id").agg(first).select("first.*")
    # documents without words are groups of their own, so equal rows among them are left
    kept = of_group.groupBy("id", "digest").agg(F.min("n").alias("n"))
    return numbered.join(kept.select("n"), "n", "left_semi").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice. Its weight is a score of quality learned from the labels.

    A stage hands on the columns of documents and no score, and this one is of DataFrame operators alone, so texts are scored here, as they are now, by
    a linear model of all labelled documents, since few of those that the first stage rejects are left to learn from.
    """
    scratch = Scratch(spark, "mix")
    numbered = _numbered(scratch, docs, linear.fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))
    mixed = mixing.mix(numbered.select("row.doc_id", "row.text", "row.source", "digest", "n", "score"), carry=("digest", "n"), weight="score")
    times = mixed.select("n", (F.col("epochs") + F.col("chosen").cast("long")).alias("times")).filter("times > 0")
    return numbered.join(times, "n").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy")).select("row.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and digests of them and of the text that they decode to."""
    out = bpe.encode(docs, decoded=True)
    return out.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("classify", classify),
    ("drop_lines", drop_lines),
    ("drop_near_copies", drop_near_copies),
    ("mix_sources", mix_sources),
    ("tokenize", tokenize),
]

#: Shingle similarity, kernels and merges are beyond SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.drop(before)
    return docs
