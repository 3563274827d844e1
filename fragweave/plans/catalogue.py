"""Registered queries: every operator applied to the whole generated tables, with DuckDB SQL for the same rows.

The tables stand in for assembly data: a document's bases are a sequence; a part is a contig and an order a segment;
an order line is a marker hit on a customer (contig) for the part's brand (marker); events by user and type are coverage
by contig and sample. The file queries write a table in a format to the scratch folder and scan it again.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring, sequences
from ..operators import assign, features, graphs, kernels, markers, merge, nearest
from ..scratch import Tables
from ..sources import fasta, named, tables
from ..sources import graphs as graph_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

TYPES = ("click", "error", "purchase", "signup", "view")
MIN_LENGTH, SHARE = 1000, 0.9
W_INTRA = scoring.threshold(0.1) * (len(TYPES) + 1)
N_MG, BIN_MG, MIN_SIZE = 25, 0.33333, 20_000
DEPTH = 4


def query(sql: str | None = None):
    def add(run):
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLE[run.__name__] = sql
        return run

    return add


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{table}.parquet")


# ---- sequences

_SEQ = "s AS (SELECT doc_id, regexp_replace(upper(text), '[^GATC]', '', 'g') AS seq FROM documents)"
_KMERS = f"""{_SEQ}, k AS (
  SELECT doc_id, unnest(list_transform(range(1, greatest(length(seq) - 2, 1)), lambda p: substr(seq, p, 4))) AS k FROM s
), c AS (SELECT doc_id, least(k, translate(reverse(k), 'ACGT', 'TGCA')) AS kmer, count(*) AS n FROM k GROUP BY 1, 2)"""


def bases(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", sequences.sanitize(F.col("text")).alias("seq"))


@query(f"WITH {_KMERS} SELECT * FROM c")
def kmer_counts(spark, sf):
    return features.kmer_counts(bases(spark, sf), "doc_id")


@query(f"WITH {_KMERS} SELECT doc_id, kmer, round(n / sum(n) OVER (PARTITION BY doc_id), 6) AS freq FROM c")
def kmer_profiles(spark, sf):
    return features.kmer_frequencies(features.kmer_counts(bases(spark, sf), "doc_id"), "doc_id").withColumn("freq", F.round("freq", 6))


@query(f"WITH {_KMERS}, x AS (SELECT DISTINCT kmer FROM c) SELECT kmer, row_number() OVER (ORDER BY kmer) - 1 AS slot FROM x")
def kmer_index(spark, sf):
    seen = features.kmer_counts(bases(spark, sf), "doc_id").select("kmer").distinct()
    slots = spark.createDataFrame(list(enumerate(sequences.canonical_index())), "slot long, kmer string")
    return slots.join(seen, "kmer", "left_semi").select("kmer", "slot")


@query(f"WITH {_SEQ} SELECT doc_id, length(seq)::BIGINT AS length FROM s")
def seq_sanitize_lengths(spark, sf):
    return bases(spark, sf).select("doc_id", F.length("seq").cast("long").alias("length"))


@query(f"WITH {_SEQ} SELECT doc_id, length(seq)::BIGINT AS length FROM s WHERE length(seq) >= {MIN_LENGTH}")
def long_sequences(spark, sf):
    return features.long_contigs(seq_sanitize_lengths(spark, sf), MIN_LENGTH)


@query(f"WITH {_SEQ} SELECT doc_id, translate(reverse(seq), 'ACGT', 'TGCA') AS rc FROM s")
def revcomp(spark, sf):
    return bases(spark, sf).select("doc_id", sequences.reverse_complement(F.col("seq")).alias("rc"))


@query("SELECT s_suppkey, replace(s_name, '#', '_') AS contig, s_suppkey AS number FROM supplier")
def name_parse(spark, sf):
    gene = F.concat(F.replace("s_name", F.lit("#"), F.lit("_")), F.lit("_12_840_+"))
    node = F.concat(F.lit("NODE_"), F.col("s_suppkey").cast("string"), F.lit("_length_90_cov_1"))
    return read(spark, sf, "supplier").select("s_suppkey", sequences.contig_of_gene(gene).alias("contig"), sequences.number_in(node).alias("number"))


@query("""SELECT v, '-' || v AS prefixed, v || '-' AS suffixed, v AS back FROM (SELECT DISTINCT l_orderkey::VARCHAR AS v FROM lineitem)""")
def reverse_segments(spark, sf):
    v = read(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("v")).distinct()
    turned = sequences.reversed_segment(F.col("v"), "prefix")
    return v.select("v", turned.alias("prefixed"), sequences.reversed_segment(F.concat("v", F.lit("+")), "suffix").alias("suffixed"), sequences.reversed_segment(turned, "prefix").alias("back"))


@query(f"WITH {_SEQ} SELECT doc_id, row_number() OVER (ORDER BY length(seq) DESC, doc_id) - 1 AS place FROM s")
def longest_first(spark, sf):
    rows = seq_sanitize_lengths(spark, sf)
    return Tables(spark, "longest").ordinals(rows, [F.col("length").desc(), "doc_id"], "place").select("doc_id", "place")


# ---- coverage

_COV = f"""c AS (
  SELECT u.user_id, t.pos, greatest(coalesce(e.n, 0)::DOUBLE, 1e-4) AS coverage
  FROM (SELECT DISTINCT user_id FROM events) u
  CROSS JOIN (SELECT unnest([{', '.join(repr(t) for t in TYPES)}]) AS event_type, unnest(range(5)) AS pos) t
  LEFT JOIN (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) e ON e.user_id = u.user_id AND e.event_type = t.event_type
)"""


def user_features(spark: SparkSession, sf: str) -> DataFrame:
    """(contig_id, group, profile, coverage): event counts by type, and their shares as a composition."""
    wide = read(spark, sf, "events").groupBy("user_id").agg(*[F.count(F.when(F.col("event_type") == t, 1)).cast("double").alias(t) for t in TYPES])
    total = sum((F.col(t) for t in TYPES[1:]), F.col(TYPES[0]))
    return wide.select(
        F.col("user_id").alias("contig_id"),
        (F.col("user_id") % 5).alias("bin_id"),
        F.array(*[F.col(t) / total * 0.1 for t in TYPES]).alias("profile"),
        F.array(*[scoring.floored(F.col(t)) for t in TYPES]).alias("coverage"),
    )


_USERS = f"""w AS (
  SELECT user_id AS contig_id, user_id % 5 AS bin_id, {', '.join(f"count(*) FILTER (event_type = '{t}')::DOUBLE AS n{k}" for k, t in enumerate(TYPES))} FROM events GROUP BY user_id
), u AS (
  SELECT contig_id, bin_id, {', '.join(f'n{k} / (n0 + n1 + n2 + n3 + n4) * 0.1 AS p{k}, greatest(n{k}, 1e-4) AS c{k}' for k in range(5))} FROM w
), b AS (
  SELECT bin_id, {', '.join(f'avg(p{k}) AS p{k}, avg(c{k}) AS c{k}' for k in range(5))} FROM u GROUP BY bin_id
)"""


def _dist(a: str, b: str) -> str:
    return "sqrt(" + " + ".join(f"({a}.p{k} - {b}.p{k}) ** 2" for k in range(5)) + ")"


def _comp(d: str) -> str:
    def pdf(mean: float, sd: float) -> str:
        return f"(exp(-0.5 * (({d}) - {mean!r}) / {sd!r} * (({d}) - {mean!r}) / {sd!r}) / ({sd!r} * sqrt(2 * pi())))"

    same, other = pdf(scoring.MU_INTRA, scoring.SIGMA_INTRA), pdf(scoring.MU_INTER, scoring.SIGMA_INTER)
    return f"({same} / ({same} + {other}))"


def _cov(a: str, b: str) -> str:
    def one(x: str, y: str) -> str:
        return " * ".join(f"greatest(exp({x}.c{k} * ln({y}.c{k}) - lgamma({x}.c{k} + 1) - {y}.c{k}), 1e-10)" for k in range(5))

    return f"least({one(a, b)}, {one(b, a)})"


def _weight(a: str, b: str) -> str:
    c, v = _comp(_dist(a, b)), _cov(a, b)
    return f"CASE WHEN {c} * {v} > 0 THEN -(log10({c}) + log10({v})) ELSE {scoring.MAX_WEIGHT!r} END"


def user_bins(spark: SparkSession, sf: str) -> DataFrame:
    f = user_features(spark, sf)
    return features.bin_profiles(f.select("bin_id", "contig_id"), f.drop("bin_id"))


def _scored(spark, sf) -> DataFrame:
    b = user_bins(spark, sf).select("bin_id", F.col("profile").alias("bp"), F.col("coverage").alias("bc"))
    f = user_features(spark, sf).drop("bin_id")
    every = b.agg(F.collect_list(F.struct("bin_id", "bp", "bc")).alias("bins"))  # five bins
    return f.join(F.broadcast(every)).select("contig_id", "profile", "coverage", F.inline("bins"))


@query(f"WITH {_COV} SELECT user_id, pos, coverage FROM c")
def abundance_vectors(spark, sf):
    f = user_features(spark, sf)
    return f.select(F.col("contig_id").alias("user_id"), F.posexplode("coverage").alias("pos", "coverage")).withColumn("pos", F.col("pos").cast("long"))


@query(f"""SELECT user_id AS contig, {', '.join(f"(count(*) FILTER (event_type = '{t}'))::DOUBLE AS {t}" for t in TYPES)} FROM events GROUP BY user_id
HAVING {' AND '.join(f"count(*) FILTER (event_type = '{t}') > 0" for t in TYPES)}""")
def coverage_combine(spark, sf):
    rows = read(spark, sf, "events").groupBy(F.col("user_id").alias("contig"), F.col("event_type").alias("sample")).agg(F.count(F.lit(1)).cast("double").alias("coverage"))
    return tables.combine_coverage(rows, list(TYPES))


@query("SELECT (count(DISTINCT event_type))::INT AS samples, count(DISTINCT user_id) AS contigs FROM events")
def sample_count(spark, sf):
    f = user_features(spark, sf)
    n = features.sample_count(f)
    return f.agg(F.lit(n).alias("samples"), F.count(F.lit(1)).alias("contigs"))


@query(f"WITH {_USERS} SELECT contig_id, b.bin_id, round({_dist('u', 'b')}, 8) AS distance FROM u CROSS JOIN b")
def euclidean_pairs(spark, sf):
    return _scored(spark, sf).select("contig_id", "bin_id", F.round(scoring.euclidean(F.col("profile"), F.col("bp")), 8).alias("distance"))


@query(f"WITH {_USERS} SELECT contig_id, b.bin_id, round({_comp(_dist('u', 'b'))}, 8) AS p FROM u CROSS JOIN b")
def comp_probability(spark, sf):
    return _scored(spark, sf).select("contig_id", "bin_id", F.round(scoring.composition_probability(scoring.euclidean(F.col("profile"), F.col("bp"))), 8).alias("p"))


@query(f"WITH {_USERS} SELECT contig_id, b.bin_id, round({_cov('u', 'b')}, 12) AS p FROM u CROSS JOIN b")
def cov_probability(spark, sf):
    return _scored(spark, sf).select("contig_id", "bin_id", F.round(scoring.coverage_probability(F.col("coverage"), F.col("bc")), 12).alias("p"))


@query(f"WITH {_USERS} SELECT contig_id, b.bin_id, round({_weight('u', 'b')}, 6) AS weight FROM u CROSS JOIN b")
def log_prob(spark, sf):
    return _scored(spark, sf).select("contig_id", "bin_id", F.round(scoring.pair_weight(F.col("profile"), F.col("coverage"), F.col("bp"), F.col("bc")), 6).alias("weight"))


@query("WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos FROM embeddings) SELECT label, pos, round(avg(x), 8) AS mean FROM x GROUP BY label, pos")
def mean_profiles(spark, sf):
    rows = read(spark, sf, "embeddings").select("label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return features.mean_vectors(rows, "label", "v").select("label", F.posexplode("v").alias("pos", "mean")).select("label", F.col("pos").cast("long").alias("pos"), F.round("mean", 8).alias("mean"))


@query(f"""WITH {_USERS}, s AS (SELECT contig_id, b.bin_id, {_weight('u', 'b')} AS weight FROM u CROSS JOIN b)
SELECT contig_id, bin_id, round(weight, 6) AS weight FROM s WHERE weight < {scoring.MAX_WEIGHT!r}
QUALIFY row_number() OVER (PARTITION BY contig_id ORDER BY weight, bin_id) = 1""")
def nearest_profile_assign(spark, sf):
    return assign.nearest_profile(user_features(spark, sf).drop("bin_id"), user_bins(spark, sf)).withColumn("weight", F.round("weight", 6))


_OTHERS = f"""{_USERS}, s AS (SELECT x.contig_id, y.contig_id AS other, {_weight('x', 'y')} AS weight FROM u x JOIN u y ON x.contig_id <> y.contig_id)"""


def _user_bins_each(spark, sf) -> DataFrame:
    """Every user as a bin of its own."""
    return user_features(spark, sf).select(F.col("contig_id").alias("bin_id"), "profile", "coverage", F.array((F.col("contig_id") % 3).cast("string")).alias("markers"))


@query(f"WITH {_OTHERS} SELECT contig_id, round(min(weight), 6) AS weight FROM s WHERE weight < {scoring.MAX_WEIGHT!r} GROUP BY contig_id")
def nearest_user(spark, sf):
    """The weight of each user's nearest other user, by the index over all of them."""
    got = nearest.best_other(_user_bins_each(spark, sf).drop("markers"))
    return got.select(F.col("own").alias("contig_id"), F.round("weight", 6).alias("weight"))


@query(f"WITH {_OTHERS} SELECT contig_id AS bin_id, round(min(weight), 6) AS weight FROM s WHERE weight <= {W_INTRA!r} AND contig_id % 3 <> other % 3 GROUP BY contig_id")
def user_merge_neighbours(spark, sf):
    """As ``bin_merge_neighbours``, with every user as a bin."""
    return merge.merge_neighbours(_user_bins_each(spark, sf), W_INTRA).select("bin_id", F.round("weight", 6).alias("weight"))


def _bin_weights(spark, sf, possible: bool) -> DataFrame:
    f = user_features(spark, sf)
    rows = assign.weights_to_all(f.drop("bin_id"), f.drop("contig_id"), 5, possible).select("contig_id", F.posexplode("weights").alias("bin_id", "weight"))
    return rows.select("contig_id", F.col("bin_id").cast("long").alias("bin_id"), F.round("weight", 6).alias("weight"))


_PAIRS = f"p AS (SELECT u.contig_id, d.bin_id, {_weight('u', 'd')} AS w FROM u CROSS JOIN u d)"


@query(f"""WITH {_USERS}, {_PAIRS}
SELECT contig_id, bin_id, round(CASE WHEN isinf(sum(w)) THEN {scoring.MAX_WEIGHT!r} ELSE sum(w) / count(*) END, 6) AS weight FROM p GROUP BY 1, 2""")
def member_weights(spark, sf):
    """Every contig against every bin's members, as the matching weighs them."""
    return _bin_weights(spark, sf, False)


@query(f"""WITH {_USERS}, {_PAIRS}
SELECT contig_id, bin_id, round(CASE WHEN isinf(sum(w)) OR count(*) FILTER (w < {scoring.MAX_WEIGHT!r}) = 0 THEN {scoring.MAX_WEIGHT!r}
  ELSE sum(w) / count(*) FILTER (w < {scoring.MAX_WEIGHT!r}) END, 6) AS weight FROM p GROUP BY 1, 2""")
def seed_weights(spark, sf):
    """Every contig against every bin's seeds, as the propagation weighs them."""
    return _bin_weights(spark, sf, True)


@query("""WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), w AS (
  SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2
) SELECT c.user_id AS contig_id, t.pos, greatest(coalesce(w.n, 0)::DOUBLE, 1e-4) AS coverage
FROM c CROSS JOIN (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS event_type, unnest(range(5)) AS pos) t
LEFT JOIN w ON w.user_id = c.user_id AND w.event_type = t.event_type WHERE c.n * 20 >= 1000""")
def coverage_vectors(spark, sf):
    """An abundance table by name against contigs that are long enough."""
    events = read(spark, sf, "events").withColumn("name", F.col("user_id").cast("string"))
    contigs = events.groupBy(F.col("user_id").alias("contig_id"), "name").agg((F.count(F.lit(1)) * 20).alias("length"))
    raw = events.groupBy("name").agg(F.array(*[F.count(F.when(F.col("event_type") == t, 1)).cast("double") for t in TYPES]).alias("coverage"))
    rows = features.coverage_vectors(raw, contigs, 1000).select("contig_id", F.posexplode("coverage").alias("pos", "coverage"))
    return rows.select("contig_id", F.col("pos").cast("long").alias("pos"), "coverage")


def _user_bin_markers(spark, sf) -> DataFrame:
    return user_bins(spark, sf).withColumn("markers", F.array(F.concat(F.lit("m"), (F.col("bin_id") % 3).cast("string"))))


_NEIGHBOURS = f"""{_USERS}, n AS (
  SELECT x.bin_id, y.bin_id AS partner, {_weight('x', 'y')} AS weight FROM b x JOIN b y ON x.bin_id <> y.bin_id AND x.bin_id % 3 <> y.bin_id % 3
), m AS (SELECT * FROM n WHERE weight <= {W_INTRA!r} QUALIFY row_number() OVER (PARTITION BY bin_id ORDER BY weight, partner) = 1)"""


@query(f"WITH {_NEIGHBOURS} SELECT bin_id, partner, round(weight, 6) AS weight FROM m")
def bin_merge_neighbours(spark, sf):
    return merge.merge_neighbours(_user_bin_markers(spark, sf), W_INTRA).withColumn("weight", F.round("weight", 6))


@query(f"""WITH {_NEIGHBOURS}, p AS (SELECT DISTINCT least(bin_id, partner) AS a, greatest(bin_id, partner) AS z FROM m)
SELECT a || '_' || z AS clique, 2 AS n FROM p UNION ALL
SELECT bin_id::VARCHAR, 1 FROM b WHERE bin_id NOT IN (SELECT a FROM p UNION SELECT z FROM p)""")
def bin_cliques(spark, sf):
    bins = _user_bin_markers(spark, sf)
    return merge.cliques(bins, merge.merge_neighbours(bins, W_INTRA)).select("clique", F.size("bins").alias("n"))


# ---- graphs: parts as contigs, orders as segments

_PS = "ps AS (SELECT DISTINCT l_partkey AS c, l_orderkey AS s FROM lineitem)"
_LINKS = f"{_PS}, e AS (SELECT DISTINCT a.c AS src, b.c AS dst FROM ps a JOIN ps b ON a.s = b.s AND a.c < b.c), g AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"


def segments(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").select(F.col("l_partkey").alias("contig_id"), F.col("l_orderkey").alias("segment")).distinct()


def part_edges(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "lineitem").select(F.col("l_partkey").alias("contig_id"), F.col("l_orderkey").alias("segment"))
    return graphs.shared_edges(rows)


def _parts(spark, sf) -> DataFrame:
    return read(spark, sf, "part").select(F.col("p_partkey").alias("id"))


#: Orders as contigs: linked with the customer's next, and with the next of its priority.
_CHAIN = """l0 AS (
  SELECT o_orderkey AS x, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS y FROM orders UNION
  SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) FROM orders
), e AS (SELECT DISTINCT least(x, y) AS src, greatest(x, y) AS dst FROM l0 WHERE y IS NOT NULL), g AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"""
_URGENT = "o_orderpriority = '1-URGENT'"


def following(spark: SparkSession, sf: str, *by: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("o_orderdate", "o_orderkey")
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("a"), F.lead("o_orderkey").over(w).alias("b")).filter("b IS NOT NULL")


def order_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graphs.simple_edges(following(spark, sf, "o_custkey").union(following(spark, sf, "o_custkey", "o_orderpriority")))


def _orders(spark, sf, where: str = "true") -> DataFrame:
    return read(spark, sf, "orders").filter(where).select(F.col("o_orderkey").alias("id"))


@query(f"WITH {_PS} SELECT DISTINCT a.c AS src, b.c AS dst FROM ps a JOIN ps b ON a.s = b.s AND a.c < b.c")
def shared_segment_edges(spark, sf):
    return part_edges(spark, sf)


_ORDER_LINKS = """l AS (SELECT o_orderkey AS x, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS y FROM orders),
l2 AS (SELECT x, y FROM l WHERE y IS NOT NULL UNION SELECT y, x FROM l WHERE y IS NOT NULL)"""


def _order_links(spark, sf) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = read(spark, sf, "orders").select(F.col("o_orderkey").alias("a"), F.lead("o_orderkey").over(w).alias("b")).filter("b IS NOT NULL")
    return graph_files.both_ways(rows)


@query(f"WITH {_PS}, {_ORDER_LINKS} SELECT DISTINCT least(a.c, b.c) AS src, greatest(a.c, b.c) AS dst FROM ps a JOIN l2 ON a.s = l2.x JOIN ps b ON b.s = l2.y WHERE a.c <> b.c")
def link_expansion_edges(spark, sf):
    rows = read(spark, sf, "lineitem").select(F.col("l_partkey").alias("contig_id"), F.col("l_orderkey").alias("segment"))
    return graphs.linked_edges(rows, _order_links(spark, sf))


@query(f"WITH {_ORDER_LINKS} SELECT x AS a, y AS b FROM l2")
def symmetric_links(spark, sf):
    return _order_links(spark, sf)


@query("""WITH l AS (SELECT o_orderkey AS x, lead(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS y FROM orders)
SELECT x AS id FROM l WHERE y IS NULL AND x NOT IN (SELECT y FROM l WHERE y IS NOT NULL)""")
def isolated_nodes(spark, sf):
    """Orders that are alone with their customer and priority."""
    return graphs.isolated(_orders(spark, sf), graphs.simple_edges(following(spark, sf, "o_custkey", "o_orderpriority")))


_REACH = f"""WITH RECURSIVE {_CHAIN}, r AS (
  SELECT o_orderkey AS id, o_orderkey AS reach FROM orders UNION SELECT r.id, g.dst FROM r JOIN g ON g.src = r.reach
), m AS (SELECT id, min(reach) AS component FROM r GROUP BY id)"""


@query(f"{_REACH} SELECT id, component FROM m")
def components(spark, sf):
    kept = Tables(spark, "components")
    return graphs.components(_orders(spark, sf), kept.keep(order_edges(spark, sf), "edges"), kept)


@query(f"{_REACH} SELECT id, component FROM m WHERE component IN (SELECT component FROM m JOIN orders ON o_orderkey = id WHERE {_URGENT})")
def labelled_components(spark, sf):
    return graphs.with_labelled(components(spark, sf), _orders(spark, sf, _URGENT))


def _bfs(where: str, stop: str = "true") -> str:
    return f"""WITH RECURSIVE {_CHAIN}, r AS (
  SELECT o_orderkey AS source, o_orderkey AS id, 0 AS dist FROM orders WHERE {where}
  UNION SELECT r.source, g.dst, r.dist + 1 FROM r JOIN g ON g.src = r.id JOIN orders o ON o.o_orderkey = r.id WHERE r.dist < {DEPTH} AND (r.dist = 0 OR {stop})
), d AS (SELECT source, id, min(dist) AS dist FROM r GROUP BY 1, 2)"""


@query(f"{_bfs('true')} SELECT source, id, dist FROM d")
def bounded_paths(spark, sf):
    """From every order."""
    kept = Tables(spark, "paths")
    return graphs.hops(kept.keep(order_edges(spark, sf), "edges"), _orders(spark, sf), DEPTH, tables=kept)


@query(f"{_bfs('true')} SELECT source, floor(sum(dist + 1) / count(*))::BIGINT AS avg_vertices FROM d GROUP BY source")
def mean_path_vertices(spark, sf):
    return graphs.mean_path_length(bounded_paths(spark, sf), ["source"])


@query(f"{_bfs(f'NOT {_URGENT}', f'NOT o.{_URGENT}')} SELECT source, id, dist FROM d JOIN orders ON o_orderkey = id WHERE {_URGENT} AND dist > 0")
def bfs_first_labelled(spark, sf):
    """From every order without the label, not passing a labelled one."""
    kept = Tables(spark, "labelled")
    return graphs.first_labelled(kept.keep(order_edges(spark, sf), "edges"), _orders(spark, sf, f"NOT {_URGENT}"), _orders(spark, sf, _URGENT), DEPTH, kept)


@query(f"""WITH RECURSIVE {_CHAIN}, r AS (
  SELECT o_orderkey AS source, o_orderkey AS id, 0 AS dist FROM orders WHERE {_URGENT} UNION SELECT r.source, g.dst, r.dist + 1 FROM r JOIN g ON g.src = r.id WHERE r.dist < 40
), d AS (SELECT source, id, min(dist) AS dist FROM r JOIN orders ON o_orderkey = id WHERE o_orderstatus = 'P' AND NOT {_URGENT} AND dist > 0 GROUP BY 1, 2)
SELECT source, id, dist FROM d QUALIFY dense_rank() OVER (PARTITION BY source ORDER BY dist) = 1""")
def nearest_unlabelled_level(spark, sf):
    """From every labelled order."""
    kept = Tables(spark, "level")
    wanted = _orders(spark, sf, f"o_orderstatus = 'P' AND NOT {_URGENT}")
    return graphs.nearest_level(kept.keep(order_edges(spark, sf), "edges"), _orders(spark, sf, _URGENT), wanted, kept)


@query(f"""WITH RECURSIVE {_CHAIN}, asked AS (
  SELECT a.o_orderkey AS source, b.o_orderkey AS target FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey WHERE a.o_orderstatus = 'F' AND b.o_orderstatus = 'O'
  UNION SELECT o_orderkey, o_orderkey + 1 FROM orders WHERE o_orderstatus = 'F'
), r AS (
  SELECT DISTINCT source, source AS id, 0 AS dist FROM asked UNION SELECT r.source, g.dst, r.dist + 1 FROM r JOIN g ON g.src = r.id WHERE r.dist < 40
) SELECT source, target, min(dist) AS dist FROM asked JOIN r USING (source) WHERE r.id = target AND target <> source GROUP BY 1, 2""")
def asked_distances(spark, sf):
    """Only the pairs that are asked for: orders of one customer, and orders of no common component, which have no path."""
    kept = Tables(spark, "asked")
    orders = read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    others = orders.select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("target"), F.col("o_orderstatus").alias("s"))
    same = orders.join(others, (F.col("o_custkey") == F.col("c")) & (F.col("o_orderkey") != F.col("target")) & (F.col("s") == "O")).filter("o_orderstatus = 'F'")
    pairs = same.select(F.col("o_orderkey").alias("source"), "target").union(orders.filter("o_orderstatus = 'F'").select("o_orderkey", F.col("o_orderkey") + 1))
    return graphs.distances(kept.keep(order_edges(spark, sf), "edges"), pairs.distinct(), kept)


# ---- the graph of all parts that share an order, searched by (part, order) and from all parts at once

#: Levels that the SQL unrolls; every search on this graph ends before.
_FAR = 8
_PARTS = f"""{_LINKS}, v AS (SELECT p_partkey AS id, p_brand, p_size, p_brand LIKE 'Brand#1%' AS labelled, p_size > 45 AND p_brand NOT LIKE 'Brand#1%' AS wanted FROM part),
nb AS (SELECT max(id)::INT + 1 AS n FROM v)"""


def _bits(sources: str, depth: int, stop: str = "false") -> str:
    """CTEs f0, f1, ...: (id, b), the sources that meet a vertex on this level, as bits by their ids."""
    steps = [f"{_PARTS}, f0 AS MATERIALIZED (SELECT id, set_bit(bitstring('0', n), id::INT, 1) AS b FROM v CROSS JOIN nb WHERE {sources})", "s0 AS MATERIALIZED (SELECT * FROM f0)"]
    for k in range(1, depth + 1):
        go = f"f{k - 1}" if k == 1 else f"(SELECT f{k - 1}.* FROM f{k - 1} JOIN v USING (id) WHERE NOT ({stop}))"
        steps.append(f"m{k} AS MATERIALIZED (SELECT g.dst AS id, bit_or(f.b) AS b FROM {go} f JOIN g ON g.src = f.id GROUP BY g.dst)")
        steps.append(f"f{k} AS MATERIALIZED (SELECT id, b FROM (SELECT m.id, CASE WHEN s.b IS NULL THEN m.b ELSE m.b & ~s.b END AS b FROM m{k} m LEFT JOIN s{k - 1} s USING (id)) WHERE bit_count(b) > 0)")
        steps.append(f"s{k} AS MATERIALIZED (SELECT id, bit_or(b) AS b FROM (SELECT * FROM s{k - 1} UNION ALL SELECT * FROM f{k}) GROUP BY id)")
    return "WITH " + ",\n".join(steps)


def _levels(depth: int, first: int = 0) -> str:
    return " UNION ALL ".join(f"SELECT id, {k} AS dist, b FROM f{k}" for k in range(first, depth + 1))


def part_graph(spark, sf) -> graphs.Incidence:
    return graphs.Incidence(segments(spark, sf).select(F.col("contig_id").alias("id"), F.col("segment")))


def _part_ids(spark, sf, where: str = "true") -> DataFrame:
    return read(spark, sf, "part").filter(where).select(F.col("p_partkey").alias("id"))


_LABELLED, _WANTED = "p_brand LIKE 'Brand#1%'", "p_size > 45 AND p_brand NOT LIKE 'Brand#1%'"


def _least() -> str:
    """CTE c: the smallest id that is connected; labels go around until they no longer change, long before the last round."""
    steps = [f"{_PARTS}, c0 AS (SELECT id, id AS c FROM v)"]
    for k in range(1, _FAR + 1):
        steps.append(f"c{k} AS MATERIALIZED (SELECT id, least(c{k - 1}.c, coalesce(x.m, c{k - 1}.c)) AS c FROM c{k - 1} LEFT JOIN (SELECT g.src AS id, min(c) AS m FROM g JOIN c{k - 1} y ON y.id = g.dst GROUP BY 1) x USING (id))")
    return "WITH " + ",\n".join(steps) + f", c AS (SELECT * FROM c{_FAR})"


@query(f"{_least()} SELECT id, c AS component FROM c")
def part_components(spark, sf):
    kept = Tables(spark, "components")
    return part_graph(spark, sf).components(_part_ids(spark, sf), kept)


@query(f"{_least()} SELECT id, c AS component FROM c WHERE c IN (SELECT c FROM c JOIN v USING (id) WHERE labelled)")
def part_labelled_components(spark, sf):
    return graphs.with_labelled(part_components(spark, sf), _part_ids(spark, sf, _LABELLED))


@query(f"WITH {_LINKS} SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT src FROM g)")
def part_isolated(spark, sf):
    return part_graph(spark, sf).isolated(_part_ids(spark, sf))


@query(f"{_bits('true', DEPTH)} SELECT id, dist, bit_count(b)::BIGINT AS n FROM ({_levels(DEPTH)})")
def part_reach(spark, sf):
    """Bounded paths from every part to every part, as the number of sources at each distance of a part."""
    return graphs.reach(part_graph(spark, sf), _part_ids(spark, sf), DEPTH)


@query(f"{_bits('NOT labelled', DEPTH, 'labelled')} SELECT id, dist, bit_count(b)::BIGINT AS n FROM ({_levels(DEPTH, 1)}) JOIN v USING (id) WHERE labelled")
def part_first_labelled(spark, sf):
    """From every part without the label, not passing a labelled one: how many meet each labelled part, and how far from it."""
    labelled = Tables(spark, "labelled").keep(_part_ids(spark, sf, _LABELLED), "labelled")
    met = graphs.reach(part_graph(spark, sf), _part_ids(spark, sf, f"NOT ({_LABELLED})"), DEPTH, labelled)
    return met.filter("dist > 0").join(labelled, "id", "left_semi")


@query(f"""{_bits('labelled', _FAR)}, h AS (SELECT s.id AS source, f.id, dist FROM ({_levels(_FAR, 1)}) f JOIN v w ON w.id = f.id AND w.wanted JOIN v s ON s.labelled AND get_bit(f.b, s.id::INT) = 1)
SELECT source, id, dist FROM h QUALIFY dense_rank() OVER (PARTITION BY source ORDER BY dist) = 1""")
def part_nearest_level(spark, sf):
    """From every labelled part."""
    return graphs.nearest(part_graph(spark, sf), _part_ids(spark, sf, _LABELLED), _part_ids(spark, sf, _WANTED))


_ASKED = "asked AS (SELECT a.id AS source, b.id AS target FROM v a JOIN v b ON a.p_brand = b.p_brand AND a.p_size = b.p_size)"


def _asked(spark, sf) -> DataFrame:
    """Parts of one brand and size, each with itself too."""
    a = read(spark, sf, "part").select(F.col("p_partkey").alias("source"), "p_brand", "p_size")
    return a.join(a.withColumnRenamed("source", "target"), ["p_brand", "p_size"]).select("source", "target")


@query(f"{_bits('true', _FAR)}, {_ASKED} SELECT source, target, dist FROM asked JOIN ({_levels(_FAR, 1)}) f ON f.id = target AND get_bit(f.b, source::INT) = 1")
def part_distances(spark, sf):
    kept = Tables(spark, "asked")
    return graphs.distances(part_graph(spark, sf), kept.keep(_asked(spark, sf), "asked"), kept)


@query(f"""{_bits('true', _FAR)}, {_ASKED}, d AS (SELECT source, target, dist + 1 AS n FROM asked JOIN ({_levels(_FAR)}) f ON f.id = target AND get_bit(f.b, source::INT) = 1)
SELECT source, floor(sum(coalesce(n, 0)) / count(*))::BIGINT AS avg_vertices FROM asked LEFT JOIN d USING (source, target) GROUP BY source""")
def part_mean_vertices(spark, sf):
    """Parts that no path joins count 0."""
    return graphs.mean_vertices(part_graph(spark, sf), _asked(spark, sf))


_SIGN = "CASE WHEN l_linenumber % 2 = 0 THEN '-' ELSE '+' END"
_SPADES = f"""{_ORDER_LINKS}, k AS (SELECT x || '+' AS a, y || '-' AS b FROM l WHERE y IS NOT NULL), kk AS (SELECT a, b FROM k UNION SELECT b, a FROM k),
p AS (SELECT l_partkey AS c, CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS record, l_orderkey || {_SIGN} AS s,
  row_number() OVER (PARTITION BY l_partkey, l_linestatus ORDER BY l_orderkey, l_linenumber) AS pos FROM lineitem),
f AS (SELECT c, min(record) AS record FROM p GROUP BY c), own AS (SELECT p.* FROM p JOIN f USING (c, record)),
turn AS (SELECT s, CASE WHEN right(s, 1) = '+' THEN left(s, length(s) - 1) || '-' ELSE left(s, length(s) - 1) || '+' END AS t FROM (SELECT DISTINCT s FROM p)),
last AS (SELECT c, arg_max(s, pos) AS s FROM own GROUP BY c), one AS (SELECT c, s FROM last UNION SELECT c, t FROM last JOIN turn USING (s)),
every AS (SELECT DISTINCT c, s FROM own UNION SELECT c, t FROM own JOIN turn USING (s)),
ab AS (SELECT o.c AS a, p.c AS b FROM one o JOIN p ON o.s = p.s UNION SELECT o.c, p.c FROM every o JOIN kk ON kk.a = o.s JOIN p ON p.s = kk.b)"""


@query(f"WITH {_SPADES} SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM ab WHERE a <> b")
def spades_edges(spark, sf):
    """Parts as contigs with a path record for each line status; signs by line number."""
    paths = read(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("contig_id"),
        F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("record"),
        F.struct("l_orderkey", "l_linenumber").alias("pos"),
        F.concat(F.col("l_orderkey").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, "-").otherwise("+")).alias("segment"),
    )
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    links = read(spark, sf, "orders").select(F.concat(F.col("o_orderkey").cast("string"), F.lit("+")).alias("a"), F.concat(F.lead("o_orderkey").over(w).cast("string"), F.lit("-")).alias("b"))
    return graphs.spades_edges(paths, graph_files.both_ways(links.filter("b IS NOT NULL"), once=False))


_FLYE = f"""{_ORDER_LINKS}, k AS (SELECT x::VARCHAR AS a, '-' || y AS b FROM l WHERE y IS NOT NULL), kk AS (SELECT a, b FROM k UNION SELECT b, a FROM k),
p AS (SELECT DISTINCT l_partkey AS c, CASE WHEN l_linenumber % 2 = 0 THEN '-' ELSE '' END || l_orderkey AS s FROM lineitem),
t AS (SELECT c, s FROM p UNION SELECT c, CASE WHEN s LIKE '-%' THEN substr(s, 2) ELSE '-' || s END FROM p),
z AS (SELECT DISTINCT t.c, kk.b AS s FROM t JOIN kk ON kk.a = t.s), zz AS (SELECT c, s FROM z UNION SELECT c, ltrim(s, '-') FROM z),
ab AS (SELECT a.c AS a, b.c AS b FROM t a JOIN p b USING (s) UNION SELECT a.c, b.c FROM p a JOIN p b ON ltrim(a.s, '-') = ltrim(b.s, '-') UNION SELECT zz.c, p.c FROM zz JOIN p USING (s))"""


@query(f"WITH {_FLYE} SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM ab WHERE a <> b")
def flye_edges(spark, sf):
    """Parts as contigs with signed segments."""
    sign = F.when(F.col("l_linenumber") % 2 == 0, "-").otherwise("")
    paths = read(spark, sf, "lineitem").select(F.col("l_partkey").alias("contig_id"), F.concat(sign, F.col("l_orderkey").cast("string")).alias("segment")).distinct()
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    links = read(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("a"), F.concat(F.lit("-"), F.lead("o_orderkey").over(w).cast("string")).alias("b"))
    return graphs.flye_edges(Tables(spark, "flye").keep(paths, "paths"), graph_files.both_ways(links.filter("b IS NOT NULL")))


@query(f"""WITH {_LINKS}, n AS (SELECT count(*) AS edges FROM e)
SELECT count(*) AS contigs, count(*) FILTER (p_retailprice >= {MIN_LENGTH}) AS long, count(*) FILTER (p_partkey NOT IN (SELECT src FROM g)) AS isolated,
  count(*) FILTER (p_retailprice >= {MIN_LENGTH} AND p_partkey NOT IN (SELECT src FROM g)) AS long_isolated, any_value(edges) AS edges, 2 AS samples FROM part CROSS JOIN n""")
def run_counters(spark, sf):
    """What a run logs of its input."""
    from . import binning

    contigs = read(spark, sf, "part").select(F.col("p_partkey").alias("contig_id"), F.col("p_retailprice").alias("length"))
    n = binning.counters(binning.Input(contigs, Tables(spark, "counters").keep(part_edges(spark, sf), "edges"), contigs, contigs, 2), MIN_LENGTH)
    return spark.createDataFrame([tuple(n.values())], ", ".join(f"{k} {'int' if k == 'samples' else 'long'}" for k in n))


@query("""WITH e AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
SELECT user_id, event_id, event_type FROM e WHERE event_type IS DISTINCT FROM b""")
def path_run_starts(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = read(spark, sf, "events").withColumn("place", F.row_number().over(w))
    return graph_files.run_starts(rows, "event_type", "place", ["user_id"]).select("user_id", "event_id", "event_type")


@query("SELECT user_id AS number, event_id AS record FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def path_first_wins(spark, sf):
    return graph_files.first_paths(read(spark, sf, "events").select(F.col("user_id").alias("number"), F.col("event_id").alias("record")))


@query("""WITH f AS (SELECT user_id AS number, min(event_id) AS first FROM events GROUP BY 1) SELECT number, (row_number() OVER (ORDER BY first) - 1)::INT AS contig_id FROM f""")
def dense_ids(spark, sf):
    rows = read(spark, sf, "events").select(F.col("user_id").alias("number"), F.col("event_id").alias("record"))
    return graph_files.contig_numbers(rows).select("number", "contig_id").distinct()


# ---- markers: order lines as hits on customers

_HITS = f"""h AS (
  SELECT l_orderkey * 10 + l_linenumber AS line_no, o_custkey AS contig_id, p_brand AS marker, c_acctbal + 1000 AS length
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey JOIN customer ON c_custkey = o_custkey
  WHERE l_quantity::INT - 0 > 50 * {SHARE}::DOUBLE AND c_acctbal + 1000 >= {MIN_LENGTH}
)"""
_ORDERED = f"""{_HITS}, q AS (SELECT DISTINCT marker, contig_id FROM h), z AS (SELECT contig_id, count(*) AS m FROM q GROUP BY 1),
f AS (SELECT marker, min(line_no) AS first_seen FROM h GROUP BY 1),
o AS (SELECT q.marker, count(*) AS n, sum(m) AS total, any_value(first_seen) AS first_seen FROM q JOIN z USING (contig_id) JOIN f USING (marker) GROUP BY 1),
t AS (SELECT row_number() OVER (ORDER BY n DESC, total DESC, first_seen) - 1 AS step, marker, n, total::BIGINT AS total FROM o)"""
_SEEDS = f"{_ORDERED}, sb AS (SELECT contig_id, row_number() OVER (ORDER BY min(line_no)) - 1 AS bin_id FROM h JOIN t USING (marker) WHERE step = 0 GROUP BY contig_id)"


def customers(spark, sf) -> DataFrame:
    return read(spark, sf, "customer").select(F.col("c_custkey").alias("contig_id"), F.col("c_name").alias("name"), (F.col("c_acctbal") + 1000).alias("length"))


def raw_hits(spark, sf) -> DataFrame:
    line, part, order = (read(spark, sf, t) for t in ("lineitem", "part", "orders"))
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(order, F.col("l_orderkey") == F.col("o_orderkey")).join(customers(spark, sf), F.col("o_custkey") == F.col("contig_id"))
    return rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_no"), F.col("name").alias("contig"), F.col("p_brand").alias("marker"), F.lit(50).alias("qlen"), F.lit(0).alias("hmm_from"), F.col("l_quantity").cast("int").alias("hmm_to"))


def hits(spark, sf) -> DataFrame:
    return markers.passing_hits(raw_hits(spark, sf), customers(spark, sf), MIN_LENGTH, SHARE).select("line_no", "contig_id", "marker", "length")


@query(f"WITH {_HITS} SELECT line_no, contig_id, marker FROM h")
def marker_hits(spark, sf):
    return hits(spark, sf).select("line_no", "contig_id", "marker")


@query(f"""SELECT l_orderkey * 10 + l_linenumber AS line_no, c_name AS contig, p_brand AS marker FROM lineitem JOIN orders ON o_orderkey = l_orderkey
JOIN part ON p_partkey = l_partkey JOIN customer ON c_custkey = o_custkey WHERE l_quantity::INT > 50 * {SHARE}::DOUBLE""")
def marker_hits_any_length(spark, sf):
    return markers.passing_hits(raw_hits(spark, sf), None, 0, SHARE).select("line_no", "contig", "marker")


@query(f"""WITH {_HITS}, q AS (SELECT marker, contig_id, min(line_no) AS seen FROM h GROUP BY 1, 2)
SELECT marker, count(*) AS n, min(seen) AS first_seen, string_agg(contig_id::VARCHAR, ',' ORDER BY seen) AS contigs FROM q GROUP BY 1""")
def marker_contig_counts(spark, sf):
    joined = F.array_join(F.transform("contigs", lambda c: c.cast("string")), ",")
    return markers.marker_contigs(hits(spark, sf)).select("marker", "n", "first_seen", joined.alias("contigs"))


@query(f"WITH {_HITS} SELECT contig_id, string_agg(DISTINCT marker, ',' ORDER BY marker) AS markers FROM h GROUP BY 1")
def contig_markers(spark, sf):
    return markers.contig_markers(hits(spark, sf)).select("contig_id", F.array_join("markers", ",").alias("markers"))


@query(f"WITH {_ORDERED} SELECT n, count(*) AS n_markers FROM t GROUP BY n")
def gene_count_histogram(spark, sf):
    return markers.marker_histogram(markers.marker_contigs(hits(spark, sf)))


@query(f"WITH {_ORDERED} SELECT DISTINCT n FROM t")
def gene_counts(spark, sf):
    return markers.gene_counts(markers.marker_contigs(hits(spark, sf)))


@query(f"WITH {_ORDERED} SELECT step, marker, n, total FROM t")
def marker_iteration_order(spark, sf):
    return markers.marker_order(hits(spark, sf)).withColumn("step", F.col("step").cast("long"))


@query(f"WITH {_SEEDS} SELECT bin_id, contig_id FROM sb")
def seed_bins(spark, sf):
    return markers.seed_bins(hits(spark, sf)).select(F.col("bin_id").cast("long"), "contig_id")


@query(f"""WITH {_SEEDS}, bm AS (SELECT DISTINCT bin_id, marker FROM sb JOIN q USING (contig_id)),
x AS (SELECT DISTINCT q.contig_id, bm.bin_id FROM q JOIN bm USING (marker))
SELECT contig_id, (SELECT count(*) FROM sb) - count(*) AS n_free FROM x GROUP BY contig_id
UNION ALL SELECT contig_id, (SELECT count(*) FROM sb) FROM z WHERE contig_id NOT IN (SELECT contig_id FROM x)""")
def conflict_free_bins(spark, sf):
    kept = Tables(spark, "free")
    h = kept.keep(hits(spark, sf), "hits")
    own = kept.keep(markers.contig_markers(h), "markers")
    bins = own.join(seed_of(h), "contig_id").select("bin_id", "markers")
    return assign.free_counts(own, bins, kept).select("contig_id", "n_free")


def seed_of(h: DataFrame) -> DataFrame:
    return markers.seed_bins(h).select(F.col("bin_id").cast("long"), "contig_id")


_MEMBERS = f"{_HITS}, mb AS (SELECT h.contig_id, min(struct_pack(l := line_no, m := marker)).m AS brand, any_value(length) AS length FROM h GROUP BY 1), d AS (SELECT brand, row_number() OVER (ORDER BY brand) - 1 AS bin_id FROM (SELECT DISTINCT brand FROM mb)), sz AS (SELECT bin_id, sum(floor(length))::BIGINT AS size, count(*) AS n FROM mb JOIN d USING (brand) GROUP BY 1)"


def brand_members(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Customers in bins by the brand first seen on them, and their lengths."""
    h = hits(spark, sf)
    first = h.groupBy("contig_id").agg(F.min(F.struct("line_no", "marker"))["marker"].alias("brand"), F.first("length").alias("length"))
    ids = first.select("brand").distinct().select("brand", (F.row_number().over(Window.orderBy("brand")) - 1).cast("long").alias("bin_id"))  # as many as brands
    rows = first.join(ids, "brand")
    return rows.select("bin_id", "contig_id"), rows.select("contig_id", F.floor("length").alias("length"))


@query(f"WITH {_MEMBERS} SELECT bin_id, size FROM sz")
def bin_sizes(spark, sf):
    return merge.bin_sizes(*brand_members(spark, sf))


#: Bins 2k and 2k + 1 form a clique, but for the last ones.
_GROUPS = f"""{_MEMBERS}, gr AS (SELECT bin_id, CASE WHEN bin_id < 10 THEN bin_id // 2 ELSE bin_id END + CASE WHEN bin_id < 10 THEN 1000 ELSE 0 END AS gid FROM d),
cl AS (SELECT gid, string_agg(bin_id::VARCHAR, '_' ORDER BY bin_id) AS clique, count(*) AS k, sum(size)::BIGINT AS size, min(mk) AS mk FROM gr JOIN sz USING (bin_id) JOIN (
  SELECT bin_id, count(DISTINCT marker) AS mk FROM mb JOIN d USING (brand) JOIN h ON h.contig_id = mb.contig_id GROUP BY 1) USING (bin_id) GROUP BY gid),
ju AS (SELECT clique, size, k = 1 AND mk < {N_MG * BIN_MG!r} AS weak, CASE WHEN (k = 1 AND mk < {N_MG * BIN_MG!r}) OR size < {MIN_SIZE} THEN 'low' ELSE 'final' END AS quality FROM cl)"""


def _judged(spark, sf) -> tuple[DataFrame, DataFrame]:
    members, lengths = brand_members(spark, sf)
    bins = members.join(hits(spark, sf).select("contig_id", "marker"), "contig_id").groupBy("bin_id").agg(F.collect_set("marker").alias("markers"))
    partner = F.when(F.col("bin_id") % 2 == 0, F.col("bin_id") + 1).otherwise(F.col("bin_id") - 1)
    pairs = bins.filter("bin_id < 10").select("bin_id", partner.alias("partner"))
    return merge.judged(merge.cliques(bins, pairs), merge.bin_sizes(members, lengths), bins, N_MG, BIN_MG, MIN_SIZE), members


@query(f"WITH {_GROUPS} SELECT clique, size FROM ju")
def clique_sizes(spark, sf):
    return _judged(spark, sf)[0].select("clique", "size")


@query(f"WITH {_GROUPS} SELECT clique, weak, quality FROM ju")
def quality_gate(spark, sf):
    return _judged(spark, sf)[0].select("clique", "weak", "quality")


@query(f"WITH {_GROUPS} SELECT c_name AS contig, 'bin_' || clique AS bin, quality FROM mb JOIN d USING (brand) JOIN gr USING (bin_id) JOIN cl USING (gid) JOIN ju USING (clique) JOIN customer ON c_custkey = mb.contig_id")
def result_table(spark, sf):
    groups, members = _judged(spark, sf)
    rows = merge.final_of(merge.results(groups, members))
    return rows.join(customers(spark, sf), "contig_id").select(F.col("name").alias("contig"), F.concat(F.lit("bin_"), "clique").alias("bin"), "quality")


@query(f"WITH {_GROUPS} SELECT count(DISTINCT clique) AS bins FROM ju WHERE quality = 'final'")
def final_bin_count(spark, sf):
    return _judged(spark, sf)[0].filter("quality = 'final'").agg(F.count_distinct("clique").alias("bins"))


@query(f"WITH {_HITS} SELECT c_custkey AS contig_id FROM customer WHERE c_acctbal + 1000 >= {MIN_LENGTH} AND c_custkey NOT IN (SELECT contig_id FROM h)")
def long_unbinned(spark, sf):
    long = features.long_contigs(customers(spark, sf), MIN_LENGTH)
    return assign.unbinned(long, hits(spark, sf)).select("contig_id")


@query(f"WITH {_SEEDS} SELECT contig_id FROM z WHERE contig_id NOT IN (SELECT contig_id FROM sb)")
def set_difference(spark, sf):
    """Marker contigs that are no seeds."""
    h = Tables(spark, "difference").keep(hits(spark, sf), "hits")
    return assign.unbinned(markers.contig_markers(h).select("contig_id"), seed_of(h))


@query(f"WITH {_SEEDS} SELECT contig_id FROM z WHERE contig_id IN (SELECT contig_id FROM sb)")
def set_intersection(spark, sf):
    """Marker contigs that are seeds."""
    h = Tables(spark, "intersection").keep(hits(spark, sf), "hits")
    return assign.binned(markers.contig_markers(h).select("contig_id"), seed_of(h))


@query("SELECT c_custkey AS contig_id, c_name AS name, c_acctbal + 1000 AS length FROM customer")
def unique_names(spark, sf):
    """Rows pass if no name is repeated; else it is an error."""
    from . import binning

    return binning.unique_names(customers(spark, sf))


@query("SELECT n_nationkey AS k, round(-log10((n_nationkey + 1) / 25.0::DOUBLE), 9) AS weight FROM nation")
def thresholds(spark, sf):
    """Weights of probabilities, one for each nation."""
    p = (F.col("n_nationkey") + 1) / F.lit(25.0)
    return read(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("k"), (-F.round(-scoring.threshold_column(p), 9)).alias("weight"))


@query(f"WITH {_GROUPS} SELECT quality, 'bin_' || clique AS bin, c_name AS record_id, c_mktsegment AS seq FROM mb JOIN d USING (brand) JOIN gr USING (bin_id) JOIN cl USING (gid) JOIN ju USING (clique) JOIN customer ON c_custkey = mb.contig_id")
def final_join(spark, sf):
    """Sequences of all contigs that are in an output bin."""
    groups, members = _judged(spark, sf)
    seqs = read(spark, sf, "customer").select(F.col("c_custkey").alias("contig_id"), F.col("c_name").alias("record_id"), F.col("c_mktsegment").alias("seq"))
    return merge.with_sequences(seqs, merge.final_of(merge.results(groups, members)))


# ---- files: written in a format, scanned again


@query(f"WITH {_SEQ} SELECT doc_id::VARCHAR AS record_id, 'doc ' || doc_id AS description, seq FROM s")
def fasta_scan(spark, sf):
    kept = Tables(spark, "fasta")
    path = kept.path("fasta")
    rows = bases(spark, sf).select(F.concat(F.col("doc_id").cast("string"), F.lit(" doc "), F.col("doc_id").cast("string")).alias("record_id"), "seq")
    fasta.write_fasta(rows, path, width=60)
    return fasta.read_fasta(spark, path).select("record_id", F.substr("description", F.length("record_id") + 2).alias("description"), "seq")


@query("SELECT p_partkey::VARCHAR AS name, p_brand AS seq FROM part")
def gfa_segment_scan(spark, sf):
    path = _gfa(spark, sf)
    return graph_files.read_segments(spark, path).select("name", "seq")


def _gfa(spark, sf) -> str:
    path = Tables(spark, "gfa").path("gfa")
    s = read(spark, sf, "part").select(F.concat_ws("\t", F.lit("S"), F.col("p_partkey").cast("string"), "p_brand").alias("value"))
    e = part_edges(spark, sf).select(F.concat_ws("\t", F.lit("L"), F.col("src").cast("string"), F.lit("+"), F.col("dst").cast("string"), F.lit("-"), F.lit("0M")).alias("value"))
    s.union(e).write.text(path)
    return path


@query(f"WITH {_LINKS} SELECT src AS src, dst AS dst FROM e")
def gfa_named_edges(spark, sf):
    path = _gfa(spark, sf)
    names = read(spark, sf, "part").select(F.col("p_partkey").alias("contig_id"), F.col("p_partkey").cast("string").alias("name"))
    return graphs.named_edges(graph_files.read_links(spark, path), names)


@query(f"WITH {_LINKS} SELECT src || '+' AS a, dst || '-' AS b FROM e")
def gfa_oriented_links(spark, sf):
    return graph_files.read_oriented_links(spark, _gfa(spark, sf), "suffix")


@query(f"WITH {_LINKS} SELECT src::VARCHAR AS a, '-' || dst AS b FROM e")
def gfa_prefixed_links(spark, sf):
    path = Tables(spark, "edges").path("gfa")
    rows = part_edges(spark, sf)
    rows.select(F.concat(F.lit("L\tedge_"), F.col("src").cast("string"), F.lit("\t+\tedge_"), F.col("dst").cast("string"), F.lit("\t-\t0M")).alias("value")).write.text(path)
    return graph_files.read_oriented_links(spark, path, "prefix")


@query("SELECT p_partkey || 'L' AS a, p_size || 'x' AS b FROM part UNION ALL SELECT o_orderkey || '+', o_custkey || '-' FROM orders")
def gfa_links_anywhere(spark, sf):
    """Lines of any kind that hold an L count as links, as some tools read them."""
    path = Tables(spark, "anywhere").path("gfa")
    other = read(spark, sf, "part").select(F.concat_ws("\t", F.lit("S"), F.col("p_partkey").cast("string"), F.lit("L"), F.col("p_size").cast("string"), F.lit("x")).alias("value"))
    short = read(spark, sf, "part").select(F.concat_ws("\t", F.lit("S"), F.col("p_partkey").cast("string"), F.lit("LN")).alias("value"))
    links = read(spark, sf, "orders").select(F.concat_ws("\t", F.lit("L"), F.col("o_orderkey").cast("string"), F.lit("+"), F.col("o_custkey").cast("string"), F.lit("-")).alias("value"))
    other.union(short).union(links).write.text(path)
    return graph_files.read_oriented_links(spark, path, "suffix", anywhere=True)


def _plain_links(spark, sf) -> str:
    path = Tables(spark, "links").path("gfa")
    s = read(spark, sf, "part").select(F.concat(F.lit("S\tk"), F.col("p_partkey").cast("string"), F.lit(".0\tACGT")).alias("value"))
    e = read(spark, sf, "lineitem").select(F.concat(F.lit("L\t"), F.col("l_partkey").cast("string"), F.lit("\t+\t"), F.col("l_suppkey").cast("string"), F.lit("\t-")).alias("value"))
    s.union(e).write.text(path)
    return path


@query("SELECT l_partkey::VARCHAR AS a, l_suppkey::VARCHAR AS b, count(*) AS n FROM lineitem GROUP BY 1, 2")
def megahit_links(spark, sf):
    """On this route links of a contig with itself stay."""
    return graph_files.read_links(spark, _plain_links(spark, sf), "megahit").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_partkey::VARCHAR AS a, l_suppkey::VARCHAR AS b, count(*) AS n FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY 1, 2")
def megahitc_links(spark, sf):
    return graph_files.read_links(spark, _plain_links(spark, sf), "megahitc").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'k' || p_partkey AS name FROM part")
def megahitc_segments(spark, sf):
    """On this route names lose their last two characters."""
    return graph_files.read_segments(spark, _plain_links(spark, sf), "megahitc").select("name")


@query(f"WITH {_SEQ} SELECT doc_id::VARCHAR AS record_id, 'g' || doc_id AS name FROM s WHERE doc_id % 7 <> 3")
def matched_by_place(spark, sf):
    """Names of a graph's segments for records at the same place with the same sequence; others have no name."""
    from . import binning

    kept = Tables(spark, "place")
    rows = bases(spark, sf).withColumn("seq", F.concat(F.lit("A"), "seq")).orderBy("doc_id")
    records, graph = kept.path("fasta"), kept.path("gfa")
    fasta.write_fasta(rows.withColumn("record_id", F.col("doc_id").cast("string")), records, width=80)
    other = F.when(F.col("doc_id") % 7 == 3, F.concat("seq", F.lit("C"))).otherwise(F.col("seq"))
    rows.select(F.concat_ws("\t", F.lit("S"), F.concat(F.lit("g"), F.col("doc_id").cast("string")), other).alias("value")).write.text(graph)
    found = binning.matched_by_place(graph_files.read_segments(spark, graph, "megahit"), fasta.read_fasta(spark, records))
    return found.select("record_id", "name")


@query("""SELECT s_suppkey AS number, row_number() OVER (PARTITION BY s_suppkey ORDER BY l_orderkey, l_linenumber) - 1 AS pos, l_orderkey || '+' AS segment
FROM supplier JOIN lineitem ON l_suppkey = s_suppkey""")
def spades_path_scan(spark, sf):
    path = Tables(spark, "spades").path("paths")
    line = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s"), F.struct("l_orderkey", "l_linenumber").alias("k"))
    own = line.groupBy("s").agg(F.array_join(F.transform(F.array_sort(F.collect_list("k")), lambda k: F.concat(k["l_orderkey"].cast("string"), F.lit("+"))), ",").alias("p"))
    own.select(F.concat(F.lit("NODE_"), F.col("s").cast("string"), F.lit("_length_9_cov_1\n"), "p").alias("value")).write.text(path)
    return graph_files.read_spades_paths(spark, path).select("number", F.col("pos").cast("long").alias("pos"), "segment")


@query("""WITH x AS (SELECT l_suppkey AS s, l_orderkey AS o, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber))
SELECT s AS number, pos, o || CASE WHEN n > 1 AND pos = (n + 1) // 2 - 1 THEN '' ELSE '+' END AS segment FROM x""")
def spades_path_lines(spark, sf):
    """Records of several lines: the first line's last segment loses its sign, as the matched tool reads them."""
    return graph_files.read_spades_paths(spark, _path_lines(spark, sf)).select("number", F.col("pos").cast("long").alias("pos"), "segment")


def _path_lines(spark, sf) -> str:
    path = Tables(spark, "lines").path("paths")
    line = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s"), F.struct("l_orderkey", "l_linenumber").alias("k"))
    own = line.groupBy("s").agg(F.transform(F.array_sort(F.collect_list("k")), lambda k: F.concat(k["l_orderkey"].cast("string"), F.lit("+"))).alias("p"))
    half = F.ceil(F.size("p") / 2).cast("int")
    first, rest = F.array_join(F.slice("p", F.lit(1), half), ","), F.array_join(F.slice("p", half + 1, F.size("p")), ",")
    body = F.when(F.size("p") > 1, F.concat(first, F.lit(";\n"), rest)).otherwise(first)
    own.select(F.concat(F.lit("NODE_"), F.col("s").cast("string"), F.lit("_length_9_cov_1\n"), body).alias("value")).write.text(path)
    return path


@query("SELECT DISTINCT o_custkey::VARCHAR AS name, o_orderkey::VARCHAR AS segment FROM orders")
def flye_path_scan(spark, sf):
    path = Tables(spark, "flye").path("info")
    rows = read(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.collect_set("o_orderkey"), lambda x: x.cast("string")), ",").alias("p"))
    rows.select(F.concat(F.col("o_custkey").cast("string"), F.lit("\t10\t*\t*,"), "p", F.lit(",*")).alias("value")).union(spark.createDataFrame([("#seq_name length",)], "value string")).write.text(path)
    return graph_files.read_flye_paths(spark, path).select("name", "segment")


@query(f"WITH {_COV} SELECT user_id::VARCHAR AS name, pos, round(coverage, 6) AS coverage FROM c")
def abundance_scan(spark, sf):
    path = Tables(spark, "abundance").path("tsv")
    cells = F.array_join(F.transform("coverage", lambda x: x.cast("string")), "\t")
    user_features(spark, sf).select(F.concat_ws("\t", F.col("contig_id").cast("string"), cells).alias("value")).write.text(path)
    rows = tables.read_abundance(spark, path).select("name", F.posexplode("coverage").alias("pos", "coverage"))
    return rows.select("name", F.col("pos").cast("long").alias("pos"), F.round("coverage", 6).alias("coverage"))


@query("SELECT c_name AS contig, p_brand AS marker, l_quantity::INT AS hmm_to, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3")
def hit_table_scan(spark, sf):
    return tables.read_hits(spark, _hit_table(spark, sf)).groupBy("contig", "marker", "hmm_to").agg(F.count(F.lit(1)).alias("n"))


def _hit_table(spark, sf) -> str:
    path = Tables(spark, "hits").path("domtbl")
    cells = [F.concat("contig", F.lit("_1_90_+")), F.lit("-"), F.lit("0"), F.col("marker"), F.lit("-"), F.col("qlen").cast("string"), *[F.lit("0")] * 9, F.col("hmm_from").cast("string"), F.col("hmm_to").cast("string"), F.lit("x")]
    raw_hits(spark, sf).select(F.concat_ws("  ", *cells).alias("value")).union(spark.createDataFrame([("# target",)], "value string")).write.text(path)
    return path


@query(f"""SELECT user_id::VARCHAR AS contig, {', '.join(f"(count(*) FILTER (event_type = '{t}'))::DOUBLE AS {t}" for t in TYPES)} FROM events GROUP BY user_id
HAVING {' AND '.join(f"count(*) FILTER (event_type = '{t}') > 0" for t in TYPES)}""")
def coverage_files(spark, sf):
    kept = Tables(spark, "coverage")
    paths = []
    for t in TYPES:
        paths.append(kept.path(t))
        rows = read(spark, sf, "events").filter(F.col("event_type") == t).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
        body = rows.select(F.concat_ws("\t", F.col("user_id").cast("string"), F.col("n").cast("string")).alias("value"), F.lit(1).alias("k"))
        head = spark.createDataFrame([(f"Contig\t{t}", 0)], "value string, k int")
        head.union(body).coalesce(1).sortWithinPartitions("k").select("value").write.text(paths[-1])
    return tables.combine_coverage(tables.read_coverage(spark, paths), list(TYPES))


@query(f"""SELECT (row_number() OVER (ORDER BY user_id))::VARCHAR AS contig, {', '.join(f"(count(*) FILTER (event_type = '{t}'))::DOUBLE AS {t}" for t in TYPES)} FROM events GROUP BY user_id""")
def coverage_by_place(spark, sf):
    """Rows of the files joined by their number; names are those of the first file."""
    kept = Tables(spark, "places")
    wide = read(spark, sf, "events").groupBy("user_id").agg(*[F.count(F.when(F.col("event_type") == t, 1)).alias(t) for t in TYPES])
    rows = kept.keep(kept.ordinals(wide, ["user_id"], "k"), "rows")
    paths = []
    for n, t in enumerate(TYPES):
        paths.append(kept.path(t))
        # only the first file has the names
        name = (F.col("k") + 1).cast("string") if n == 0 else F.lit("other")
        body = rows.select(F.concat_ws("\t", name, F.col(t).cast("string")).alias("value"), F.col("k").alias("at"))
        spark.createDataFrame([(f"Contig\t{t}", -1)], "value string, at long").union(body).repartitionByRange(1, "at").sortWithinPartitions("at").select("value").write.text(paths[-1])
    return tables.combine_coverage(tables.read_coverage(spark, paths), list(TYPES), by="pos")


@query(f"WITH {_GROUPS} SELECT c_name AS contig, 'bin_' || clique AS bin FROM mb JOIN d USING (brand) JOIN gr USING (bin_id) JOIN cl USING (gid) JOIN ju USING (clique) JOIN customer ON c_custkey = mb.contig_id WHERE quality = 'final'")
def table_sink(spark, sf):
    """The result table, written and read back."""
    path = Tables(spark, "table").path("table")
    tables.write_table(result_table(spark, sf).filter("quality = 'final'").select("contig", "bin"), path, ";", crlf=True)
    return spark.read.csv(path, schema="contig string, bin string", sep=";")


@query(f"""WITH {_SEQ} SELECT CASE WHEN doc_id % 2 = 0 THEN 'final' ELSE 'low' END AS quality, 'bin_' || (CASE WHEN doc_id % 3 > 0 THEN 0 ELSE doc_id % 10 END) AS bin, doc_id::VARCHAR AS record_id, 'A' || seq AS seq FROM s""")
def bins_sink(spark, sf):
    """Sequences by quality and bin, written as folders of records and read back; one bin holds most of them."""
    path = Tables(spark, "bins").path("bins")
    n = F.when(F.col("doc_id") % 3 > 0, 0).otherwise(F.col("doc_id") % 10).cast("string")
    rows = bases(spark, sf).select(F.when(F.col("doc_id") % 2 == 0, "final").otherwise("low").alias("quality"), F.concat(F.lit("bin_"), n).alias("bin"), F.col("doc_id").cast("string").alias("record_id"), F.concat(F.lit("A"), "seq").alias("seq"))
    fasta.write_bins(rows, path)
    lines = F.split(F.regexp_replace(F.trim("value"), "^>", ""), "\n")
    return spark.read.option("lineSep", "\n>").text(path).select("quality", "bin", lines[0].alias("record_id"), F.trim(lines[1]).alias("seq"))


def _bin_records(spark, sf) -> DataFrame:
    """Sequences by quality and bin; one bin holds most of them."""
    n = F.when(F.col("doc_id") % 3 > 0, 0).otherwise(F.col("doc_id") % 10).cast("string")
    quality = F.when(F.col("doc_id") % 2 == 0, "final").otherwise("low").alias("quality")
    return bases(spark, sf).select(quality, F.concat(F.lit("bin_"), n).alias("bin"), F.col("doc_id").cast("string").alias("record_id"), F.concat(F.lit("A"), "seq").alias("seq"), F.col("doc_id").alias("pos"))


_FILES = f"""{_SEQ}, t AS (
  SELECT CASE WHEN doc_id % 2 = 0 THEN 'bins/' ELSE 'low_quality_bins/' END || 'bin_' || (CASE WHEN doc_id % 3 > 0 THEN 0 ELSE doc_id % 10 END) || CASE WHEN doc_id % 2 = 0 THEN '' ELSE '_seqs' END || '.fasta' AS file,
    doc_id, '>' || doc_id || chr(10) || 'A' || seq || chr(10) AS value FROM s)"""


@query(f"""WITH {_FILES} SELECT file, md5(value) AS digest, strlen(value)::BIGINT AS n_bytes,
  coalesce(sum(strlen(value)) OVER (PARTITION BY file ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place FROM t""")
def file_places(spark, sf):
    """Where in its file each record begins, files of exact names."""
    text = F.concat(F.lit(">"), F.col("record_id"), F.lit("\n"), F.col("seq"), F.lit("\n"))
    rows = _bin_records(spark, sf).select(fasta.bin_file().alias("file"), text.alias("value"), "pos")
    got = named.placed(rows, ["pos"], Tables(spark, "places"))
    return got.select("file", F.md5("value").alias("digest"), F.octet_length("value").cast("long").alias("n_bytes"), F.col("at").alias("place"))


@query(f"WITH {_SEQ} SELECT CASE WHEN doc_id % 2 = 0 THEN 'bins/bin_' ELSE 'low_quality_bins/bin_' END || (CASE WHEN doc_id % 3 > 0 THEN 0 ELSE doc_id % 10 END) || CASE WHEN doc_id % 2 = 0 THEN '.fasta' ELSE '_seqs.fasta' END AS file, doc_id::VARCHAR AS record_id, 'A' || seq AS seq FROM s")
def bin_files(spark, sf):
    """One file for each bin, written by many tasks at once under its exact name; records read back with their file, a large file by many tasks."""
    path = Tables(spark, "bin_files").path("out")
    fasta.write_bin_files(_bin_records(spark, sf), path, ["pos"])
    found = spark.read.option("lineSep", "\n>").option("recursiveFileLookup", True).option("pathGlobFilter", "*.fasta").text(path)
    lines = F.split(F.regexp_replace(F.trim("value"), "^>", ""), "\n")
    return found.select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+/[^/]+)$", 1).alias("file"), lines[0].alias("record_id"), F.trim(lines[1]).alias("seq"))


@query(f"WITH {_FILES} SELECT file, doc_id::VARCHAR AS record_id, strlen(value) - strlen(doc_id::VARCHAR) - 3 AS length, md5(value) AS digest FROM t WHERE strlen(value) - strlen(doc_id::VARCHAR) - 3 >= {MIN_LENGTH} AND file LIKE 'bins/%'")
def long_records(spark, sf):
    """Records of at least the shortest length in final bins, from files of exact names read by ranges of bytes."""
    path = Tables(spark, "long_records").path("out")
    fasta.write_bin_files(_bin_records(spark, sf), path, ["pos"])
    found = fasta.scan_fasta(spark, path).filter((F.col("length") >= MIN_LENGTH) & F.contains("file", F.lit("/bins/")))
    text = F.concat(F.lit(">"), F.col("record_id"), F.lit("\n"), F.col("seq"), F.lit("\n"))
    return found.select(F.regexp_extract("file", "([^/]+/[^/]+)$", 1).alias("file"), "record_id", "length", F.md5(text).alias("digest"))


@query("SELECT c_name AS contig, p_brand AS marker, l_quantity::INT AS hmm_to, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey JOIN customer ON c_custkey = o_custkey WHERE l_quantity::INT >= 20 GROUP BY 1, 2, 3")
def long_hits(spark, sf):
    """Hits that reach far into the model, from a hit table read by ranges of bytes."""
    found = tables.scan_hits(spark, _hit_table(spark, sf)).filter("hmm_to >= 20")
    return found.groupBy("contig", "marker", "hmm_to").agg(F.count(F.lit(1)).alias("n"))


@query(ORACLE["spades_path_lines"])
def spades_path_ranges(spark, sf):
    """Records of several lines, cut and parsed by ranges of bytes."""
    return graph_files.scan_spades_paths(spark, _path_lines(spark, sf)).select("number", F.col("pos").cast("long").alias("pos"), "segment")


@query(f"""SELECT user_id::VARCHAR AS contig, {', '.join(f"(count(*) FILTER (event_type = '{t}'))::DOUBLE AS {t}" for t in TYPES)} FROM events GROUP BY user_id
HAVING {' AND '.join(f"count(*) FILTER (event_type = '{t}') > 0" for t in TYPES)}""")
def coverage_sink(spark, sf):
    """The combined coverage with a header, written and read back."""
    path = Tables(spark, "sink").path("tsv")
    tables.write_table(coverage_combine(spark, sf).withColumn("contig", F.col("contig").cast("string")), path, "\t", header=True)
    return spark.read.csv(path, sep="\t", header=True, schema=", ".join(["contig string", *[f"{t} double" for t in TYPES]]))


@query(f"WITH {_KMERS} SELECT doc_id, kmer, round(n / sum(n) OVER (PARTITION BY doc_id), 6) AS freq FROM c")
def cached_profiles(spark, sf):
    """Dense profiles by way of the cache: computed and written, then read from there."""
    path = Tables(spark, "cache").path("profiles")
    features.cached_profiles(bases(spark, sf), path, "doc_id")
    rows = features.cached_profiles(bases(spark, sf), path, "doc_id").select("doc_id", F.posexplode("profile").alias("slot", "freq")).filter("freq > 0")
    names = spark.createDataFrame(list(enumerate(sequences.canonical_index())), "slot int, kmer string")
    return rows.join(names, "slot").select("doc_id", "kmer", F.round("freq", 6).alias("freq"))


@query(f"WITH {_SEQ} SELECT doc_id::VARCHAR AS record_id, seq FROM s")
def segments_to_fasta(spark, sf):
    path = Tables(spark, "graph").path("gfa")
    rows = read(spark, sf, "documents").select(F.concat_ws("\t", F.lit("S"), F.col("doc_id").cast("string"), F.regexp_replace(F.coalesce("text", F.lit("")), r"[\t\r\n]", " ")).alias("value"))
    rows.write.text(path)
    return graph_files.segments_to_fasta(spark, path)


# ---- sequential operators: compared with plain versions in the tests


def _customer_features(spark, sf) -> DataFrame:
    rows = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("contig_id")).agg(
        *[F.count(F.when(F.startswith("o_orderpriority", F.lit(str(k))), 1)).cast("double").alias(f"p{k}") for k in range(1, 6)],
        *[F.count(F.when(F.col("o_orderstatus") == s, 1)).cast("double").alias(s) for s in "FOP"],
    )
    total = sum((F.col(f"p{k}") for k in range(2, 6)), F.col("p1"))
    return rows.select("contig_id", F.array(*[F.col(f"p{k}") / total * 0.02 for k in range(1, 6)]).alias("profile"), F.array(*[scoring.floored(F.col(s)) for s in "FOP"]).alias("coverage"))


def nation_edges(spark, sf) -> DataFrame:
    """Customers linked with the next of their nation, and with the third after it."""
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    rows = read(spark, sf, "customer")
    pairs = [rows.select(F.col("c_custkey").alias("a"), F.lead("c_custkey", k).over(w).alias("b")).filter("b IS NOT NULL") for k in (1, 3)]
    return graphs.simple_edges(pairs[0].union(pairs[1]))


def _matched(spark, sf, left: bool) -> tuple[kernels.Bins, list[int]]:
    """The matching's bins, and with ``left`` the leftovers that then joined one."""
    from .binning import marker_state, steps_of

    kept = Tables(spark, "matched")
    h = kept.keep(hits(spark, sf), "hits")
    rows = assign.checked(markers.contig_markers(h).join(_customer_features(spark, sf), "contig_id").join(customers(spark, sf), "contig_id"), assign.MARKER_CONTIGS, "marker contigs")
    weight, vertices, own, lengths = marker_state(rows, kept.keep(nation_edges(spark, sf), "edges"), kept)
    bins = kernels.match(steps_of(h), own, lengths, weight, vertices, MATCH_LIMIT, 2 * MATCH_LIMIT, MATCH_FAR)
    before = set(bins.of)
    if left:
        kernels.match_left(bins, list(own), own, lengths, weight, LEFT_LIMIT)
    return bins, [c for c in bins.of if c not in before]


#: Limits of the matching on customers: weights to join and open, vertices of a path, and the leftovers' weight.
MATCH_LIMIT, MATCH_FAR, LEFT_LIMIT = scoring.threshold(0.1) * 4, 1, scoring.threshold(0.05) * 4


def _frame(spark, bins: kernels.Bins) -> DataFrame:
    rows = [(b, c, k) for b, members in enumerate(bins.members) for k, c in enumerate(members)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["bin_id", "contig_id", "seq_no"]).astype("int64"), "bin_id long, contig_id long, seq_no long")


@query()
def matching(spark, sf):
    """Seeds, and one matching for each marker, with path lengths in a graph of customers."""
    return _frame(spark, _matched(spark, sf, False)[0])


@query()
def leftover_assign(spark, sf):
    """What the matching left and the leftovers' pass then put into bins."""
    bins, new = _matched(spark, sf, True)
    return spark.createDataFrame(pd.DataFrame([(c, bins.of[c]) for c in new], columns=["contig_id", "bin_id"]).astype("int64"), "contig_id long, bin_id long")


@query()
def gated_assign(spark, sf):
    """Customers into the bins of their nations, in order, unless a marker clashes with what the bin holds from the start or got."""
    h = Tables(spark, "gated").keep(hits(spark, sf), "hits")
    candidates = read(spark, sf, "customer").select(F.col("c_custkey").alias("contig_id"), F.col("c_nationkey").cast("long").alias("bin_id"))
    held = candidates.join(h, "contig_id").groupBy("bin_id").agg(F.array(F.min("marker")).alias("markers"))
    return assign.gated_assign(candidates, held, markers.contig_markers(h), customers(spark, sf))


@query(f"""WITH {_USERS}, {_PAIRS}, g AS (SELECT DISTINCT contig_id // 10 AS g, bin_id FROM u WHERE contig_id % 3 = 0), q AS (SELECT * FROM p SEMI JOIN g ON g.g = p.contig_id // 10 AND g.bin_id = p.bin_id WHERE contig_id % 3 > 0)
SELECT contig_id, bin_id, round(CASE WHEN isinf(sum(w)) OR count(*) FILTER (w < {scoring.MAX_WEIGHT!r}) = 0 THEN {scoring.MAX_WEIGHT!r}
  ELSE sum(w) / count(*) FILTER (w < {scoring.MAX_WEIGHT!r}) END, 6) AS weight FROM q GROUP BY 1, 2""")
def asked_weights(spark, sf):
    """As ``seed_weights``, for users without a bin and the bins that their group of ten holds."""
    f = user_features(spark, sf)
    members = assign.members_of(f)
    parts = f.select(F.col("contig_id").alias("id"), F.floor(F.col("contig_id") / 10).alias("component"))
    asked = assign.asked_bins(parts, f.filter("contig_id % 3 = 0").select("contig_id", "bin_id"), f)
    rows = assign.asked_weights(f.drop("bin_id"), members, asked).select("contig_id", F.explode(F.arrays_zip("bins", "weights")).alias("x"))
    return rows.select("contig_id", F.col("x.bins").alias("bin_id"), F.round("x.weights", 6).alias("weight"))


@query()
def final_propagation(spark, sf):
    """The five priorities spread as labels from orders of status F over linked orders."""
    kept = Tables(spark, "spread")
    edges = kept.keep(order_edges(spark, sf), "edges")
    orders = read(spark, sf, "orders")
    parts = graphs.components(orders.select(F.col("o_orderkey").alias("id")), edges, kept)
    labelled = orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("contig_id"), (F.substring("o_orderpriority", 1, 1).cast("long") - 1).alias("bin_id"))
    weights = orders.select(F.col("o_orderkey").alias("contig_id"), F.sequence(F.lit(0), F.lit(4)).alias("bins"), F.array(*[F.abs(F.col("o_totalprice") / 50_000 - F.lit(float(b))) for b in range(5)]).alias("weights"))
    live = graphs.with_labelled(parts, labelled.select(F.col("contig_id").alias("id")))
    return assign.propagate(live, edges, labelled, orders.filter("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("contig_id")), weights, 10)
