"""Readers and writers on small files with the formats' oddities."""

import pytest
from fragweave.functions import sequences
from fragweave.operators import features, graphs
from fragweave.sources import fasta, graphs as graph_files, tables
from pyspark.sql import functions as F


def put(tmp_path, name, text):
    (tmp_path / name).write_bytes(text.encode())
    return str(tmp_path / name)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_fasta(spark, tmp_path):
    path = put(tmp_path, "a.fa", ">c1 first one\r\nACGT\r\nacgtn\r\n>c2\nA\n\n>c3 x\n")
    assert rows(fasta.read_fasta(spark, path)) == [(0, "c1", "c1 first one", "ACGTacgtn"), (1, "c2", "c2", "A"), (2, "c3", "c3 x", "")]
    out = str(tmp_path / "out")
    fasta.write_fasta(spark.createDataFrame([("a", "ACGT" * 40)], "record_id string, seq string"), out, width=60)
    text = "".join(r[0] + "\n" for r in spark.read.text(out).collect())
    assert text == ">a\n" + "\n".join(("ACGT" * 40)[k : k + 60] for k in (0, 60, 120)) + "\n"
    assert rows(fasta.read_fasta(spark, out).select("record_id", "seq")) == [("a", "ACGT" * 40)]


def test_numbers_follow_the_file_over_many_splits(spark, tmp_path):
    path = put(tmp_path, "big.fa", "".join(f">c{k}\n{'ACGT' * (k % 7)}\n" for k in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = fasta.read_fasta(spark, path).orderBy("pos").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r["pos"], r["record_id"]) for r in got] == [(k, f"c{k}") for k in range(5000)]


GFA = "H\tVN:Z:1.0\nS\tk1_0 \tACgt\tLN:i:4\nS\tk2_0\tAC\nL\tk1_0\t+\tk2_0\t-\t0M\nL\tk1_0\t+\tk1_0\t-\t0M\nP\tx\n"


def test_gfa(spark, tmp_path):
    path = put(tmp_path, "g.gfa", GFA)
    assert rows(graph_files.read_segments(spark, path)) == [(0, "k1_0", "ACgt"), (1, "k2_0", "AC")]
    assert rows(graph_files.read_segments(spark, path, "megahitc").select("name")) == [("k1",), ("k2",)]
    assert rows(graph_files.read_links(spark, path)) == [("k1_0", "k2_0")]
    assert rows(graph_files.read_links(spark, path, "megahit")) == [("k1_0", "k1_0"), ("k1_0", "k2_0")]
    assert rows(graph_files.read_oriented_links(spark, path, "suffix")) == [("k1_0+", "k1_0-"), ("k1_0+", "k2_0-")]
    flye = put(tmp_path, "f.gfa", "S\tedge_1\tA\nL\tedge_1\t-\tedge_2\t+\t0M\n")
    assert rows(graph_files.read_oriented_links(spark, flye, "prefix")) == [("-1", "2")]
    assert rows(graph_files.segments_to_fasta(spark, path)) == [("k1_0 ", "ACGT"), ("k2_0", "AC")]
    names = spark.createDataFrame([(0, "k1_0"), (1, "k2_0")], "contig_id int, name string")
    assert rows(graphs.named_edges(graph_files.read_links(spark, path, "megahit"), names)) == [(0, 1)]
    with pytest.raises(Exception, match="no contig is named"):
        graphs.named_edges(graph_files.read_links(spark, path), names.filter("contig_id = 0")).collect()


PATHS = """NODE_5_length_90_cov_2
11+,12-;
13+;
14+
NODE_5_length_90_cov_2'
14-,13-
NODE_7_length_50_cov_1
15+
"""


@pytest.mark.parametrize("compat,first", [(True, ["11+", "12", "13+", "14+"]), (False, ["11+", "12-", "13+", "14+"])])
def test_spades_paths(spark, tmp_path, compat, first):
    got = graph_files.read_spades_paths(spark, put(tmp_path, "p", PATHS), compat).orderBy("record", "pos").collect()
    assert [r["segment"] for r in got if r["record"] == 0] == first
    assert [(r["contig_id"], r["number"], r["reverse"]) for r in got if r["pos"] == 0] == [(0, 5, False), (0, 5, True), (1, 7, False)]
    own = graph_files.first_paths(spark.createDataFrame(got))
    assert {(r["number"], r["record"]) for r in own.collect()} == {(5, 0), (7, 2)}


def test_flye_paths(spark, tmp_path):
    path = put(tmp_path, "i", "#seq_name\tlength\ncontig_1\t10\t*,1,-2,*\ncontig_2\t9\t3,*,4\n")
    assert rows(graph_files.read_flye_paths(spark, path)) == [("contig_1", 0, "1"), ("contig_1", 1, "-2"), ("contig_2", 0, "3"), ("contig_2", 1, ""), ("contig_2", 2, "4")]


def test_hits_and_genes(spark, tmp_path):
    line = "c_1_10_90_+ - 90 M1 acc 100 1e-9 1 0 1 1 1 1 1 0 5 70 1 1 1 1 0.9 d"
    got = tables.read_hits(spark, put(tmp_path, "h", f"# c\n{line}\n#\n  {line}\n")).orderBy("line_no").collect()
    assert [(r["contig"], r["marker"], r["qlen"], r["hmm_from"], r["hmm_to"]) for r in got] == [("c_1", "M1", 100, 5, 70)] * 2
    few = spark.createDataFrame([("a_b",), ("x_1_2_3",)], "g string").select(sequences.contig_of_gene(F.col("g")))
    assert rows(few) == [("",), ("x",)]


def test_coverage(spark, tmp_path):
    contigs = spark.createDataFrame([(0, "a", 2000), (1, "b", 10)], "contig_id int, name string, length int")
    ab = tables.read_abundance(spark, put(tmp_path, "ab", "a\t0\t5.5\nb\t1\t2\n"))
    got = features.coverage_vectors(ab, contigs, 1000)
    assert rows(got.select("contig_id", "coverage")) == [(0, [1e-4, 5.5])] and features.sample_count(got) == 2
    with pytest.raises(Exception, match="no contig is named"):
        features.coverage_vectors(ab, contigs.filter("contig_id = 0")).collect()
    one, two = put(tmp_path, "s1.tsv", "Contig\tS1\nx\t1\ny\t2\n"), put(tmp_path, "s2.tsv", "Contig\tS2\ny\t4\nz\t5\n")
    both = tables.read_coverage(spark, [one, two])
    assert rows(tables.combine_coverage(both, ["S1", "S2"])) == [("y", 2.0, 4.0)]
    assert rows(tables.combine_coverage(both, ["S1", "S2"], "pos")) == [("x", 1.0, 4.0), ("y", 2.0, 5.0)]


def test_delimiters(spark, tmp_path):
    for k, d in enumerate((",", ";", "\t", " ", "|")):
        out = str(tmp_path / f"t{k}")
        tables.write_table(spark.createDataFrame([("a", "bin_1")], "contig string, bin string").coalesce(1), out, d)
        assert [r[0] for r in spark.read.text(out).collect()] == [f"a{d}bin_1"]


def test_quoting_and_line_ends(spark, tmp_path):
    out = str(tmp_path / "q")
    tables.write_table(spark.createDataFrame([('a,"b', "bin_1"), ("c", None)], "contig string, bin string").coalesce(1), out, ",", crlf=True)
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "q").glob("part-*")))
    assert data == b'"a,""b",bin_1\r\nc,\r\n'
