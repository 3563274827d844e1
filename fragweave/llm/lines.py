"""Line dedup by site-relative frequency: lines on too large a share of a host's pages are boilerplate and go.

A line is what stands between newlines. For each host the pages that hold a line (once each) are divided by the
host's pages; lines over ``ratio`` are dropped from every page of that host, whether they occur once or often; the other lines
stay in order. The ratio decides at every size of a host. Only a line that a single page holds is never boilerplate, as nothing
repeats it; ``least`` can ask for more pages. So two equal pages of a host with fewer than 20 pages lose what they share.

Lines are compared whole, by SHA-256 of their bytes, so very long lines and texts cost their length only; empty lines are never
boilerplate. Pages with a null host form one host; a null text stays null and holds no line. Repeated rows count as pages of their
own. Pages that lose all lines keep an empty text. Columns besides the text stay, whatever their names, but ``n_lines`` and
``n_dropped`` are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, rows_as_structs

RATIO = 0.1
#: Pages that make a repetition.
LEAST = 2
#: Boilerplate lines (32 bytes each at most) up to which the sets are broadcast; beyond, both sides are shuffled.
BROADCAST_KEYS = 200_000
#: Keys of a host that share a cell of its set, on average.
CELL = 4


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """The line itself if it is short, else its digest: never longer than 32 bytes, never equal for unlike lines."""
    data = line.cast("binary")
    return F.when(F.octet_length(line) < 32, data).otherwise(F.unhex(F.sha2(data, 256)))


def _cell(key: Column, cells: Column) -> Column:
    return F.pmod(F.xxhash64(key), cells).cast("int")


def boilerplate(pages: DataFrame, host: str, ratio: float = RATIO, least: int = LEAST, text: str = "text") -> DataFrame:
    """(host, line_key, pages_with, pages_all) of the lines that go."""
    rows = pages.select(F.col(host).alias("host"), F.col(text).alias("text"))
    totals = rows.groupBy(F.col("host").alias("of")).agg(F.count(F.lit(1)).alias("pages_all"))
    seen = rows.select("host", F.explode(F.array_distinct(_lines(F.col("text")))).alias("line")).filter(F.col("line") != "")
    counts = seen.select("host", _key(F.col("line")).alias("line_key")).groupBy("host", "line_key").agg(F.count(F.lit(1)).alias("pages_with"))
    counts = counts.filter(F.col("pages_with") >= least)
    return counts.join(totals, F.col("host").eqNullSafe(F.col("of"))).drop("of").filter(F.col("pages_with") > F.lit(ratio) * F.col("pages_all"))


def _sets(found: DataFrame) -> DataFrame:
    """(of, cells): a host's keys, dealt by hash to an array of short arrays, so that a line is looked up in one of these."""
    sized = found.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("n"))
    own = found.join(sized.select(F.col("host").alias("h"), "n"), F.col("host").eqNullSafe(F.col("h"))).select("host", "line_key", _cell(F.col("line_key"), F.col("n")).alias("cell"))
    every = sized.select("host", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("cell")).withColumn("line_key", F.lit(None).cast("binary"))
    filled = own.select("host", "cell", "line_key").union(every.select("host", "cell", "line_key")).groupBy("host", "cell").agg(F.collect_list("line_key").alias("keys"))
    cells = F.transform(F.array_sort(F.collect_list(F.struct("cell", "keys"))), lambda c: c["keys"])
    return filled.groupBy(F.col("host").alias("of")).agg(cells.alias("cells"))


def dedup(pages: DataFrame, host: str, ratio: float = RATIO, least: int = LEAST, text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """``pages`` with ``text`` cleaned, and ``n_lines`` and ``n_dropped`` in addition.

    A host has fewer than mean-lines-a-page / ratio boilerplate lines, so its set is small however many pages it has;
    each page gets the set of its host by a left join, whose pages side Spark may split for a hot host, and looks a line up
    among some few keys.
    """
    scratch = scratch or Scratch(pages.sparkSession, "lines")
    found = scratch.keep(boilerplate(pages, host, ratio, least, text), "boilerplate")
    sets = _sets(found)
    if found.count() <= BROADCAST_KEYS:
        sets = F.broadcast(sets)
    joined = rows_as_structs(pages).join(sets, F.col("row")[host].eqNullSafe(F.col("of")), "left")
    whole = F.col("row")[text]

    def stays(line: Column) -> Column:
        key = _key(line)
        return (line == "") | ~F.array_contains(F.element_at("cells", _cell(key, F.size("cells")) + 1), key)

    lines = F.coalesce(_lines(whole), F.array().cast("array<string>"))
    out = joined.select("row", lines.alias("lines"), F.when(F.col("cells").isNull(), lines).otherwise(F.filter(lines, stays)).alias("kept"))
    cleaned = F.when(whole.isNotNull(), F.array_join("kept", "\n"))
    own = [(cleaned if c == text else F.col("row")[c]).alias(c) for c in pages.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*own, F.size("lines").alias("n_lines"), (F.size("lines") - F.size("kept")).alias("n_dropped"))


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Documents by source, with production parameters."""
    return dedup(docs, "source").select("doc_id", "text", "n_lines", "n_dropped")


def clean_sql(table: str, ratio: float = RATIO, least: int = LEAST) -> str:
    """DuckDB SQL for ``query``."""
    return f"""
WITH lines AS (
  SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS ls FROM {table}
), seen AS (
  SELECT source, unnest(list_distinct(ls)) AS line FROM lines
), bad AS (
  SELECT s.source, s.line FROM (SELECT source, line, count(*) AS c FROM seen WHERE line <> '' GROUP BY source, line) s
  JOIN (SELECT source, count(*) AS n FROM {table} GROUP BY source) t ON s.source IS NOT DISTINCT FROM t.source
  WHERE c >= {least} AND c > {ratio}::DOUBLE * n
), marked AS (
  SELECT l.r, l.doc_id, l.i, l.line, b.line IS NOT NULL AS gone
  FROM (SELECT r, doc_id, source, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM lines) l
  LEFT JOIN bad b ON l.source IS NOT DISTINCT FROM b.source AND l.line = b.line
)
SELECT l.doc_id, CASE WHEN l.text IS NOT NULL THEN coalesce(m.text, '') END AS text,
       coalesce(m.n_lines, 0)::INT AS n_lines, coalesce(m.n_dropped, 0)::INT AS n_dropped
FROM lines l LEFT JOIN (
  SELECT r, string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) AS text, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped
  FROM marked GROUP BY r
) m ON l.r = m.r
"""
