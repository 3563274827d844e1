"""Every registered query against its DuckDB SQL on the small tables."""

import __spark_entry__ as entry
import duckdb
import pytest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
#: These have tests of their own, on larger or odd rows.
OWN = {n for n in entry.queries() if n.startswith("op") or n == "pipeline"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(f"{r[k]:.9g}" if isinstance(r[k], float) else str(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - OWN))
def test_equals_sql(spark, sf, duck, name):
    got = entry.queries()[name](spark, sf)
    want = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    kinds = {d[0]: str(d[1]) for d in want.description}
    assert {n: TYPES[t] for n, t in got.dtypes} == kinds
    assert plain(map(tuple, got.collect()), got.columns) == plain(want.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - OWN))
def test_runs(spark, sf, name):
    rows = entry.queries()[name](spark, sf).collect()
    assert rows and sorted(map(tuple, rows)) == sorted(map(tuple, entry.queries()[name](spark, sf).collect()))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_are_of_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
