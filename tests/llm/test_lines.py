"""Line dedup against its SQL and on made pages."""

import duckdb
from fragweave.llm import lines
from fragweave.llm.common import read


def test_equals_sql(spark):
    path = "/root/testdata/sf0.01"
    got = sorted(tuple(r) for r in lines.query(spark, read(spark, path, "documents")).select("doc_id", "n_dropped", "n_lines", "text").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, n_dropped, n_lines, text FROM ({lines.clean_sql('documents')})").fetchall())
    assert got == want and sum(r[1] for r in got) > 0


def test_made_pages(spark):
    long = "boiler " * 2000
    rows = [(i, f"menu\nown {i}\n\n{long}\nmenu", "a", 1) for i in range(20)]
    rows += [(100 + i, f"menu\nown {i}", "b", 1) for i in range(9)]  # the ratio decides on few pages too
    rows += [(400, "menu\nalone", "c", 1)]  # nothing repeats it
    rows += [(200 + i, f"x{i}\nfoot", None, 1) for i in range(12)]
    rows += [(300, None, "a", 1), (301, "", "a", 1), (None, "menu", "a", 1), (302, "menu", "a", 1), (302, "menu", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines int")
    out = {(r["doc_id"], r["source"]): r for r in lines.dedup(docs, "source").collect()}
    assert out[(3, "a")]["text"] == "own 3\n" and (out[(3, "a")]["n_lines"], out[(3, "a")]["n_dropped"]) == (5, 3)
    assert out[(103, "b")]["text"] == "own 3" and out[(400, "c")]["text"] == "menu\nalone"
    assert out[(203, None)]["text"] == "x3"
    assert out[(300, "a")]["text"] is None and out[(301, "a")]["text"] == "" and out[(302, "a")]["text"] == ""
    assert lines.dedup(docs, "source").count() == len(rows)
    assert lines.dedup(docs.limit(0), "source").count() == 0


def test_names_and_every_line(spark):
    """Columns of any name stay; long sets, ties and repeated lines against plain Python."""
    names = ["_host", "_keys", "_kept", "host", "of", "cells", "row", "lines", "kept", "a b"]
    rows = []
    for i in range(40):
        menu = [f"menu {k}" + " x" * (k % 40) for k in range(60) if (i + k) % 7]
        rows.append((i, "\n".join([*menu, f"own {i}", "", menu[0]]), ("s" if i < 30 else None), *[f"{n} {i}" for n in names]))
    rows += [(50, None, "s", *names), (51, "", "s", *names), (52, "menu 3" + " x" * 3, "alone", *names)]
    schema = "id long, text string, site string, " + ", ".join(f"`{n}` string" for n in names)
    for ratio in (0.1, 0.8, 0.855):
        got = lines.dedup(spark.createDataFrame(rows, schema).repartition(4), "site", ratio)
        assert got.columns == ["id", "text", "site", *names, "n_lines", "n_dropped"]
        want = []
        for r in rows:
            host = [set((x[1] or "").split("\n")) for x in rows if x[2] == r[2]]
            own = [] if r[1] is None else r[1].split("\n")
            left = [x for x in own if x == "" or sum(x in h for h in host) < 2 or sum(x in h for h in host) <= ratio * len(host)]
            want.append((r[0], None if r[1] is None else "\n".join(left), *r[2:], len(own), len(own) - len(left)))
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert lines._sets(lines.boilerplate(spark.createDataFrame(rows, schema), "site")).selectExpr("max(size(cells))").first()[0] > 10


def test_long_text_and_no_rows(spark):
    schema = "id long, text string, site string"
    rows = [(i, "same " * 300_000 + f"\nown {i}", "s") for i in range(3)]
    got = lines.dedup(spark.createDataFrame(rows, schema), "site")
    assert sorted(r["text"] for r in got.collect()) == ["own 0", "own 1", "own 2"]
    assert lines.dedup(spark.createDataFrame([], schema), "site").collect() == []
