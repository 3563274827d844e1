"""Files of exact names written by many tasks: bytes, order, failures."""

import random

import pytest
from fragweave.scratch import Tables
from fragweave.sources import fasta, named, tables
from pyspark.sql import functions as F


def tree(path):
    return {str(p.relative_to(path)): p.read_bytes() for p in path.rglob("*") if p.is_file()} if path.exists() else {}


def test_bytes_and_order(spark, tmp_path):
    rng = random.Random(5)
    # one file holds most rows; values of many sizes, some empty, null or beyond ASCII; equal rows
    rows = [("hot.txt" if rng.random() < 0.7 else f"d/{rng.randrange(6)}.txt", rng.randrange(300), rng.choice(["", "é\n", "x" * rng.randrange(3000), None])) for _ in range(4000)]
    rows += rows[:50]
    frame = spark.createDataFrame(rows, "file string, at_line int, value string").repartition(7)
    named.write(frame, ["at_line"], str(tmp_path / "out"), {"hot.txt": "head\n", "none.txt": "only\n"})
    want = {}
    for f, _, v in sorted(rows, key=lambda r: (r[0], r[1], (r[2] or "").encode())):
        want[f] = want.get(f, b"") + (v or "").encode()
    want["hot.txt"], want["none.txt"] = b"head\n" + want["hot.txt"], b"only\n"
    assert tree(tmp_path / "out") == want
    # a second job replaces what it writes and leaves the rest
    named.write(frame.filter("file = 'd/1.txt'"), ["at_line"], str(tmp_path / "out"))
    assert tree(tmp_path / "out") == want


def test_a_hot_file_is_many_tasks(spark):
    frame = spark.range(4000).select(F.lit("a").alias("file"), F.col("id").cast("string").alias("value"), "id")
    got = named.placed(frame, ["id"], Tables(spark, "t"))
    sizes = [r[0] for r in got.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert max(sizes) < 2500 and len(sizes) > 1
    assert [r["at"] for r in got.orderBy("at").limit(12).collect()] == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12]


def test_failures_leave_nothing(spark, tmp_path):
    spark.dataSource.register(named.NamedFiles)

    def put(rows, at):
        rows.write.format(named.FORMAT).mode("append").save(str(tmp_path / at))

    row = spark.range(1000).repartition(4)
    text = F.when(F.col("id") == 777, F.raise_error(F.lit("broken"))).otherwise(F.lit("ab")).cast("binary")
    with pytest.raises(Exception, match="broken"):
        put(row.select(F.lit("f").alias("file"), (F.col("id") * 2).alias("at"), text.alias("value")), "task")
    assert tree(tmp_path / "task") == {}
    # bytes that are not there, as where machines share no folder
    with pytest.raises(Exception, match="share"):
        put(row.select(F.lit("f").alias("file"), (F.col("id") * 3).alias("at"), F.lit(b"ab").alias("value")), "gap")
    assert tree(tmp_path / "gap") == {}
    with pytest.raises(Exception, match="below the folder"):
        put(row.select(F.lit("../f").alias("file"), F.col("id").alias("at"), F.lit(b"a").alias("value")), "deep/out")
    assert tree(tmp_path / "deep") == {}
    with pytest.raises(Exception, match="without a file"):
        put(row.select(F.lit(None).cast("string").alias("file"), F.col("id").alias("at"), F.lit(b"a").alias("value")), "null")
    with pytest.raises(ValueError, match="no places"):
        named.write(row.select(F.lit("f").alias("file"), F.lit("a").alias("value")), [], "s3a://bucket/x")


def test_written_bytes(spark, tmp_path):
    rows = spark.createDataFrame([('a,"b', "bin_1", 2), ("c", None, 1)], "contig string, bin string, k int")
    out = str(tmp_path / "t")
    tables.write_table_file(rows, out, "x.csv", ["k"], crlf=True, columns=["contig", "bin"])
    tables.write_table_file(rows, out, "y.tsv", [F.col("k") * -1], "\t", header=True)
    tables.write_table_file(rows.limit(0), out, "empty.csv", ["k"])
    assert tree(tmp_path / "t") == {"x.csv": b'c,\r\n"a,""b",bin_1\r\n', "y.tsv": b'contig\tbin\tk\n"a,""b"\tbin_1\t2\nc\t\t1\n', "empty.csv": b""}


def test_bin_files(spark, tmp_path):
    seqs = [("final", "bin_1_2", "a", "ACGT" * 30, 3), ("final", "bin_1_2", "b", "", 1), ("low", "bin_3", "c", "A", 2)]
    fasta.write_bin_files(spark.createDataFrame(seqs, "quality string, bin string, record_id string, seq string, pos int"), str(tmp_path / "b"), ["pos"], "p_")
    assert tree(tmp_path / "b") == {"p_bins/p_bin_1_2.fasta": b">b\n\n>a\n" + b"ACGT" * 30 + b"\n", "p_low_quality_bins/p_bin_3_seqs.fasta": b">c\nA\n"}
