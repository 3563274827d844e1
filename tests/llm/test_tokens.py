"""Token output and byte-level BPE against the libraries themselves."""

import glob
import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from fragweave.llm import bpe, tokens
from fragweave.llm.common import Scratch, read
from pyspark.sql import functions as F

ODD = [
    (5000, None),
    (5001, ""),
    (5002, "it's  a b \x1c \x85 x² ½ <|endoftext|>end\n\n  ok 漢字 １２ a_b __ ''s"),
    (5003, "  \n \n a"),
    (None, "xx yy"),
    (5003, " z"),
    (5004, "don't we'll  \t tabs em   nb​zw é ߀߁ ⅷ"),
    (5005, "longword" * 20000),
    (5005, "longword" * 20000),
]


@pytest.fixture(scope="module")
def docs(spark, sf):
    odd = spark.createDataFrame([(i, t, "x") for i, t in ODD], "doc_id long, text string, ids string")
    return read(spark, sf, "documents").selectExpr("doc_id", "text", "lang as ids").union(odd)


@pytest.fixture(scope="module")
def rows(docs):
    got = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    return sorted(got, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_token_files_hold_what_the_library_gives(spark, docs, rows):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokens.VOCABULARY)
    want, at = [], 0

    def place(r):
        h = xxhash.xxh64_intdigest(r[1].encode(), 42)
        return r[0] is not None, r[0] or 0, h - (1 << 64) if h >> 63 else h

    # equal ids are in the order of the engine's hash of the text; a null text hashes as the seed, and has an id of its own here
    for i, text in sorted(rows, key=place):
        ids = [*model.encode(text, add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = sorted((tuple(r) for r in tokens.query(spark, docs).collect()), key=lambda r: r[1])
    assert got == want


def read_rows(df):
    """Rows that the scan of a frame gave, after it has been counted."""
    run = df._jdf.queryExecution()
    run.executedPlan().executeCollect()
    return run.executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()


def test_files_have_stripes_filters_and_answer_lookups(spark):
    """Small stripes, although documents are fewer than the writer's usual checks; a Bloom filter in each; stripes and row groups are skipped."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        docs = read(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").filter("doc_id % 3 > 0")
        path = Scratch(spark, "t").path("orc")
        tokens.write(docs, path, stripe_bytes=1 << 16, row_group=1000)
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        stripes = rows = 0
        for f in sorted(glob.glob(path.removeprefix("file://") + "/*.orc")):
            file = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f), jvm.org.apache.orc.OrcFile.readerOptions(conf))
            assert file.getRowIndexStride() == 1000
            rows += file.getNumberOfRows()
            batches = file.rows()
            for k in range(file.getStripes().size()):
                footer = batches.readStripeFooter(file.getStripes().get(k)).toString()
                assert "BLOOM_FILTER_UTF8" in footer and "DIRECT_V2" in footer and "ROW_INDEX" in footer
                stripes += 1
        assert rows == docs.count() and stripes >= 8
        one = docs.selectExpr("max(doc_id)").first()[0]
        some = tokens.read(spark, path, [one])
        assert [r["doc_id"] for r in some.collect()] == [one]
        assert f"EqualTo(doc_id,{one})], ReadSchema" in some._jdf.queryExecution().toString()
        assert "In(doc_id, [0,1])" in tokens.read(spark, path, [0, 1])._jdf.queryExecution().toString()
        assert 1 <= read_rows(some) <= rows / 4  # the other stripes are not read
        # an id between the least and the greatest, which only the Bloom filters know to be absent
        absent = tokens.read(spark, path, [one // 6 * 3])
        assert absent.count() == 0 and read_rows(tokens.read(spark, path, [one // 6 * 3])) <= rows / 20
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_bpe_is_the_library_and_comes_back(spark, docs, rows):
    import tiktoken

    model = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.rank_table(), special_tokens={})
    want = Counter()
    for i, text in rows:
        ids = model.encode_ordinary(text)
        want[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in bpe.query(spark, docs).collect()) == want
    apart = bpe.decode(bpe.encode(docs)).selectExpr("doc_id", "n_tokens", "sha2(ids, 256)", "sha2(decoded, 256)")
    assert Counter(tuple(r) for r in apart.collect()) == want


def test_split_agrees_with_the_library_on_every_odd_character():
    import tiktoken

    model = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.rank_table(), special_tokens={})
    rng = np.random.default_rng(5)
    chars = [chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000] + list(" \n\tab1'.s") * 200
    for _ in range(400):
        text = "".join(rng.choice(chars, 60))
        assert model.encode_ordinary(text) == [i for w in bpe.split(text) for i in model.encode_ordinary(w)]
        assert "".join(bpe.split(text)) == text


def test_a_hot_id_spans_files(spark):
    rows = [(None, f"text {k}") for k in range(400)] + [(3, None)] * 400
    path = Scratch(spark, "t").path("orc")
    tokens.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path)
    per = [r["n"] for r in tokens.read(spark, path).groupBy("part").agg(F.count("*").alias("n")).collect()]
    assert sum(per) == 800 and len(per) >= 3 and max(per) <= 400
    assert tokens.digest(spark, path).selectExpr("max(start + n_tokens)").first()[0] == sum(tokens.read(spark, path).selectExpr("size(ids)").toPandas().iloc[:, 0])


def test_decoding_needs_known_ids():
    assert bpe._decoded(np.zeros(0, np.uint32), [0, 0], bpe.RANKS) == [b"", b""]
    table = bpe.token_bytes({b"a": 0, b"bc": 2})
    assert table.to_pylist() == [b"a", None, b"bc"]
    with pytest.raises((ValueError, IndexError)):
        bpe._decoded(np.array([10**6], np.uint32), [1], bpe.RANKS)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.query(spark, none).count() == 0
    assert bpe.query(spark, none).count() == 0
