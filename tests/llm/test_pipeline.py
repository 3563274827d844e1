"""Each stage of the pipeline against a plain version of it, on the stage's own input."""

import hashlib
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
from fragweave.llm import bpe, lines, mixing, quality
from fragweave.llm.common import Scratch, read
from test_neardup import brute

SF = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_stages(spark):
    scratch = Scratch(spark, "t")
    docs = read(spark, SF, "documents")
    odd = spark.createDataFrame([(9000, None, None, "src0", None), (9001, "", "en", None, 0), (None, "no id " * 9, "en", "src0", 5), (9002, docs.first()["text"], "en", "src1", 1), (9002, docs.first()["text"], "en", "src1", 1)], docs.schema)
    docs = scratch.keep(docs.union(odd).union(docs.limit(3)), "in")
    names = docs.columns
    before = rows(docs)
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.keep(stage(spark, docs, SF), name)
        out[name] = rows(docs)
        assert name == "tokenize" or docs.columns == names

    scored = {(r["doc_id"]): r["predicted"] for r in quality.query(spark, scratch.spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long"), read(spark, SF, "labels")).collect()}
    assert Counter(out["classify"]) == Counter(r for r in before if scored[r[0]])
    bad = {r["doc_id"] for r in read(spark, SF, "labels").collect() if r["quality"] == 0}
    gone = Counter(before) - Counter(out["classify"])
    assert sum(r[0] in bad for r in gone) >= 0.8 * len([r for r in before if r[0] in bad])
    assert len(out["classify"]) >= 0.85 * len([r for r in before if r[0] not in bad])

    con = duckdb.connect()
    con.execute("CREATE TABLE d (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO d VALUES (?, ?, ?)", [(r[0], r[1], r[3]) for r in out["classify"]])
    want = Counter((r[0], r[1]) for r in con.execute(f"SELECT doc_id, text FROM ({lines.clean_sql('d')})").fetchall())
    assert Counter((r[0], r[1]) for r in out["drop_lines"]) == want
    assert all(r[4] == (None if r[1] is None else len(r[1])) for r in out["drop_lines"])

    keep = {i for i, _, c, k in brute([(r[0], r[1]) for r in out["drop_lines"]], 80) if k}
    assert Counter(out["drop_near_copies"]) == Counter(set(r for r in out["drop_lines"] if r[0] in keep))

    taken = Counter(out["mix_sources"])
    assert set(taken) <= set(out["drop_near_copies"]) and max(taken.values()) <= 2
    words = {r: len((r[1] or "").encode().split()) for r in out["drop_near_copies"]}
    total = sum(words.values())
    assert abs(sum(words[r] * n for r, n in taken.items()) - 1.5 * total) < 0.25 * total
    # each source as the operator's targets have it, within half of its largest document
    per = {}
    for r, n in words.items():
        per[r[3]] = per.get(r[3], 0) + n
    want = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(per.items()), "source string, source_size long")).collect()}
    for s, target in want.items():
        own = {r: n for r, n in words.items() if r[3] == s}
        assert abs(sum(n * taken[r] for r, n in own.items()) - target) <= max(own.values()) / 2 + 1e-6

    import tiktoken

    model = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.rank_table(), special_tokens={})
    want = Counter()
    for r in out["mix_sources"]:
        ids = np.array(model.encode_ordinary(r[1] or ""), "<u4").tobytes()
        want[r[0], len(ids) // 4, ids, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()] += 1
    assert Counter((a, b, bytes(c), d, e) for a, b, c, d, e in out["tokenize"]) == want


def test_near_copies_of_null_and_repeated_ids(spark):
    names = read(spark, SF, "documents").columns
    text = [" ".join(f"{c}{k}" for k in range(200)) for c in "abcde"]
    near = [t + " more" for t in text]
    made = [
        (None, text[0], "en", "s", 1), (None, near[0], "en", "s", 2), (None, text[0], "en", "t", 1),  # one of the three
        (7, text[1], "en", "s", 1), (None, near[1], "en", "s", 1),  # the one with an id
        (5, text[2], "en", "s", 1), (5, near[2], "en", "s", 1), (6, text[2], "en", "s", 1),  # one of those with 5
        (8, text[3], "en", "s", 1), (8, text[3], "en", "t", 1),  # alike but for the source: one
        (9, text[4], "en", "s", 1), (9, "of its own " * 9, "en", "s", 1),  # repeated id, unlike texts: both
        (None, None, "en", "s", None), (None, None, "en", "s", None), (None, "", "en", "s", 0), (10, "", "en", "s", 0), (10, "", "en", "t", 0),
    ]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert out.columns == names
    got = Counter(rows(out))
    assert set(got.values()) == {1} and set(got) <= set(made)
    groups = [made[:3], made[3:4], made[5:7], made[8:10], made[10:11], made[11:12], made[12:13], made[14:15], made[15:16], made[16:17]]
    assert [sum(r in got for r in g) for g in groups] == [1] * len(groups) and len(got) == len(groups)


NAMES = ["_row", "_id", "_copy", "row", "digest", "n", "times", "copy", "doc", "size", "key", "n_lines", "cells", "target", "x"]


def test_columns_of_any_name_and_odd_texts(spark):
    """Every further column comes through every stage but the last; very long texts, nulls in any column, repeated rows."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES)
    made = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], *[f"{n} {r['doc_id']}" for n in NAMES]) for r in read(spark, SF, "documents").collect()]
    made += [(9000, " ".join(f"w{k % 5000} stands" for k in range(150_000)), "en", "src0", 1, *NAMES), (None, None, None, None, None, *[None] * len(NAMES)), made[0], made[0]]
    docs = spark.createDataFrame(made, schema).repartition(3)
    by = {}
    for r in made:
        by.setdefault((r[0], r[5]), r)
    scratch = Scratch(spark, "t")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, SF), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *NAMES]
        out = rows(docs)
        assert out and all(r[5:] == by[r[0], r[5]][5:] for r in out)
    assert corpus_pipeline.tokenize(spark, docs, SF).count() == docs.count()


def test_rows_that_spell_the_same_are_not_one(spark):
    made = [(1, "", "a", "b\x1fc", 1), (1, "", "a\x1fb", "c", 1), (1, "", "a", None, 1), (1, "", "a", "-", 1), (1, "", None, "a", 1)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")
    assert Counter(rows(corpus_pipeline.drop_near_copies(spark, docs, SF))) == Counter(made)


def test_empty(spark):
    none = read(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, SF)
        assert none.count() == 0
