"""Contig graphs: edge derivation, isolation, components, bounded searches.

Edges are (src, dst) with src < dst, distinct. Searches keep a frontier table and a visited table; each round is one
join with the edges and one anti-join, and is written, so that lineage stays short.

A segment on many contigs means a pair of contigs for each two of them. ``Incidence`` keeps (contig, segment) in place of pairs: a search goes from contigs
to segments and from segments to contigs, and enters a segment once, so a segment on n contigs costs n rows. Searches from many sources
carry sets of them as bits, 64 to a long, merged by ``bit_or`` before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import reversed_segment
from ..scratch import Tables


#: Rows of segments in a task when contigs meet by them.
TASK_ROWS = 500_000


def dealt(rows: DataFrame, n: int, *key: str) -> DataFrame:
    """``rows`` by ``key``, in one task for each ``TASK_ROWS`` of ``n`` and no fewer than the cores.

    The number is fixed where there is more than one, as adaptive execution joins parts by their bytes: from some size on, tasks then grow with the table.
    """
    tasks = -(-n // TASK_ROWS)
    return rows.repartition(max(tasks, rows.sparkSession.sparkContext.defaultParallelism), *key) if tasks > 1 else rows.repartition(*key)


def simple_edges(pairs: DataFrame, a: str = "a", b: str = "b", n: int | None = None) -> DataFrame:
    """Undirected, without loops, each once. ``n``: rows by which pairs are dealt before, where most are met once."""
    rows = pairs.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"))
    return (rows if n is None else dealt(rows, n, "src", "dst")).distinct()


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def segments_of(paths: DataFrame, n: int) -> DataFrame:
    """(contig_id, segment), distinct and dealt by segment in one shuffle. ``n``: rows of paths."""
    return dealt(paths.select("contig_id", "segment"), n, "segment").distinct()


def turned(segments: DataFrame, style: str | None = None) -> DataFrame:
    """(x, s): of (segment), each once, the segment, and its reverse if there is a style."""
    x = segments.select(F.col("segment").alias("x")).distinct()
    return x.select("x", F.explode(F.array("x", reversed_segment(F.col("x"), style)) if style else F.array("x")).alias("s"))


def linked(pairs: DataFrame, links: DataFrame, unsigned: bool = False) -> DataFrame:
    """(x, y): s of (x, s) is linked (a -> b, both ways given) to y. ``unsigned``: a linked ``-12`` also means a segment named ``12``."""
    b = F.explode(F.array("b", F.regexp_replace("b", "^-", ""))) if unsigned else F.col("b")
    return pairs.join(links.select(F.col("a").alias("s"), b.alias("y")).filter("y IS NOT NULL"), "s").select("x", "y")


def met(own: DataFrame, between: DataFrame, n: int) -> DataFrame:
    """(a, b): contigs with x and y, of ``segments_of``, for the pairs (x, y) of segments. A pair of segments is the same both ways, and contigs meet by it once."""
    rows = dealt(between.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")), n, "x").distinct()
    reached = own.select(F.col("contig_id").alias("a"), F.col("segment").alias("x")).join(rows, "x").select("a", "y", (F.col("x") == F.col("y")).alias("own"))
    right = own.select(F.col("contig_id").alias("b"), F.col("segment").alias("y"))
    once = (F.col("a") < F.col("b")) | (~F.col("own") & (F.col("a") > F.col("b")))
    return dealt(reached, n, "y").distinct().join(right, "y").filter(once).select("a", "b")


def shared_edges(paths: DataFrame, n: int | None = None) -> DataFrame:
    """Edges of contigs that have a segment in common. paths: (contig_id, segment); ``n``: its rows, counted if not known."""
    n = paths.count() if n is None else n
    own = segments_of(paths, n)
    pairs = own.select(F.col("contig_id").alias("a"), "segment").join(own.select(F.col("contig_id").alias("b"), "segment"), "segment")
    return simple_edges(pairs.filter("a < b"), n=n)


def linked_edges(paths: DataFrame, links: DataFrame, n: int | None = None) -> DataFrame:
    """Edges of contigs with segments that are linked (a -> b, both ways given)."""
    n = paths.count() if n is None else n
    own = segments_of(paths, n)
    return simple_edges(met(own, linked(turned(own), links), n), n=n)


def own_path(paths: DataFrame, n: int) -> DataFrame:
    """(contig_id, segment, last): the first record of each contig, in one shuffle; ``last`` marks its last segment. ``n``: rows of paths."""
    w = Window.partitionBy("contig_id").orderBy(F.col("record").asc_nulls_last(), F.col("pos").desc())
    rows = dealt(paths.select("contig_id", "record", "pos", "segment"), n, "contig_id")
    rows = rows.select("contig_id", "segment", (F.col("record") == F.first("record").over(w)).alias("own"), (F.row_number().over(w) == 1).alias("last"))
    return rows.filter("own").drop("own")


def linked_ways(own: DataFrame, links: DataFrame, n: int) -> DataFrame:
    """(contig_id, segment): what the segments of own, (contig_id, segment), or their reverse are linked to (a -> b, both ways given), signs at the end.

    A segment and its reverse differ in their last character alone, so segments and links meet by what is before it, and no reverse is shuffled.
    """

    def before(name: str) -> Column:
        return F.left(F.col(name), F.length(name) - 1).alias("name")

    x = dealt(own.select(before("segment"), "contig_id", "segment"), n, "name").distinct()
    to = dealt(links.select(before("a"), "a", "b"), n, "name").distinct()
    meets = (F.col("a") == F.col("segment")) | (F.col("a") == reversed_segment(F.col("segment"), "suffix"))
    return x.join(to, "name").filter(meets).select("contig_id", F.col("b").alias("segment"))


def spades_edges(paths: DataFrame, links: DataFrame, last_only: bool = True) -> DataFrame:
    """paths: (contig_id, record, pos, segment). A contig's own path is its first record; others match by any record. Links may be repeated.

    ``last_only``: of the own path only the last segment counts for sharing, as in the tool whose results are matched.
    """
    n = paths.count()
    own = own_path(paths, n)
    shared = own.filter("last") if last_only else own
    ways = shared.select("contig_id", F.explode(F.array("segment", reversed_segment(F.col("segment"), "suffix"))).alias("segment"))
    left = segments_of(ways.union(linked_ways(own, links, n)), n)
    right = segments_of(paths, n)
    return simple_edges(left.select(F.col("contig_id").alias("a"), "segment").join(right.select(F.col("contig_id").alias("b"), "segment"), "segment"), n=n)


def flye_edges(paths: DataFrame, links: DataFrame) -> DataFrame:
    """paths: (contig_id, segment) with signs in front. Segments that differ in their sign alone are the same, as one is the other's reverse."""
    n = paths.count()
    own = segments_of(paths, n)
    ways = turned(own, "prefix")
    between = ways.withColumnRenamed("s", "y").union(linked(ways, links, unsigned=True))
    return simple_edges(met(own, between, n), n=n)


def named_edges(links: DataFrame, contigs: DataFrame) -> DataFrame:
    """Links by name to edges by id; a link to an unknown name is an error."""

    def ids(side: str) -> DataFrame:
        return contigs.select(F.col("name").alias(side), F.col("contig_id").alias(f"{side}_id"))

    rows = links.join(ids("a"), "a", "left").join(ids("b"), "b", "left")
    for side in ("a", "b"):
        missing = F.raise_error(F.concat(F.lit("no contig is named "), F.coalesce(side, F.lit("null"))))
        rows = rows.withColumn(f"{side}_id", F.when(F.col(f"{side}_id").isNull(), missing).otherwise(F.col(f"{side}_id")))
    return simple_edges(rows, "a_id", "b_id")


def isolated(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices (id) without an edge."""
    return vertices.join(symmetric(edges).select(F.col("src").alias("id")).distinct(), "id", "left_anti")


def components(vertices: DataFrame, edges: DataFrame, tables: Tables | None = None) -> DataFrame:
    """(id, component): the smallest id that is connected. Isolated vertices are components of their own.

    Each round points every vertex at its smallest neighbour, if that is smaller, follows the pointers to their ends by doubling, and merges
    each tree into its end, which is its smallest vertex. Only edges between trees go on, each once, so edges shrink from round to round.
    The pointers of the rounds are put together at the end, the last and smallest first.
    """
    tables = tables or Tables(vertices.sparkSession, "components")
    live, rounds = tables.keep(simple_edges(edges, "src", "dst"), "live"), []
    while live.limit(1).count():
        least = symmetric(live).groupBy("src").agg(F.min("dst").alias("m"))
        to = tables.keep(least.select(F.col("src").alias("id"), F.least("src", "m").alias("to")), "to")
        while True:
            over = to.select(F.col("id").alias("to"), F.col("to").alias("end"))
            after = tables.keep(to.join(over, "to").select("id", F.col("end").alias("to"), (F.col("end") != F.col("to")).alias("moved")), "to")
            tables.drop(to)
            to = after
            if not to.filter("moved").limit(1).count():
                break
        rounds.append(to.select("id", "to"))
        ends = [to.select(F.col("id").alias(side), F.col("to").alias(f"{side}_to")) for side in ("src", "dst")]
        merged = live.join(ends[0], "src").join(ends[1], "dst")
        after = tables.keep(simple_edges(merged, "src_to", "dst_to"), "live")
        tables.drop(live)
        live = after
    if not rounds:
        return vertices.select("id", F.col("id").alias("component")).distinct()
    found = rounds.pop()
    while rounds:
        later = found.select(F.col("id").alias("to"), F.col("to").alias("end"))
        found = rounds.pop().join(later, "to", "left").select("id", F.coalesce("end", "to").alias("to"))
    return vertices.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("to", "id").alias("component"))


@dataclass
class Incidence:
    """Contigs a and b have an edge if some segment has a in ``left`` and b in ``right``; both are (id, segment), distinct.

    Where the two are the same table, give it once.
    """

    left: DataFrame
    right: DataFrame | None = None

    def _ways(self) -> tuple[DataFrame, DataFrame]:
        """(id, way, segment) to go to a segment by, and to come from it by: from left to right and from right to left."""
        if self.right is None:
            both = self.left.select("id", F.lit(0).alias("way"), "segment")
            return both, both
        sides = [t.select("id", F.lit(way).alias("way"), "segment") for t in (self.left, self.right) for way in (0, 1)]
        return sides[0].union(sides[3]), sides[2].union(sides[1])

    def pairs(self) -> DataFrame:
        """The edges (src, dst): a row for each two contigs of a segment."""
        right = self.left if self.right is None else self.right
        return simple_edges(self.left.select(F.col("id").alias("a"), "segment").join(right.select(F.col("id").alias("b"), "segment"), "segment"))

    def stars(self) -> DataFrame:
        """Edges that connect the same contigs: of each segment, from its smallest contig to the others.

        A segment with contigs on both sides connects them all; a contig has an edge if and only if it has one here.
        """
        if self.right is None:
            every = self.left.select("id", "segment")
            least = every.groupBy("segment").agg(F.min("id").alias("least"))
        else:
            every = self.left.select("id", "segment", F.lit(1).alias("l"), F.lit(0).alias("r")).union(self.right.select("id", "segment", F.lit(0), F.lit(1)))
            least = every.groupBy("segment").agg(F.min("id").alias("least"), F.max("l").alias("l"), F.max("r").alias("r")).filter("l = 1 AND r = 1").select("segment", "least")
            every = every.select("id", "segment").distinct()
        return simple_edges(every.join(least, "segment"), "least", "id")

    def isolated(self, vertices: DataFrame) -> DataFrame:
        return isolated(vertices, self.stars())

    def components(self, vertices: DataFrame, tables: Tables | None = None) -> DataFrame:
        return components(vertices, self.stars(), tables)


def spades_incidence(paths: DataFrame, links: DataFrame, last_only: bool = True) -> Incidence:
    """The graph of ``spades_edges``."""
    first = paths.groupBy("contig_id").agg(F.min("record").alias("record"))
    own = paths.join(first, ["contig_id", "record"], "left_semi")
    last = own.groupBy("contig_id").agg(F.max_by("segment", "pos").alias("segment")) if last_only else own
    left = _turned(last, "suffix").union(_reached(own, links, "suffix"))
    return Incidence(left.distinct(), paths.select(F.col("contig_id").alias("id"), "segment").distinct())


def flye_incidence(paths: DataFrame, links: DataFrame) -> Incidence:
    """The graph of ``flye_edges``; segments without their sign are segments of their own."""
    bare = paths.select(F.col("contig_id").alias("id"), F.concat(F.lit("bare "), F.regexp_replace("segment", "^-", "")).alias("segment"))
    reached = _reached(paths, links, "prefix")
    reached = reached.union(reached.select("id", F.regexp_replace("segment", "^-", "").alias("segment")))
    left = _turned(paths, "prefix").union(reached).union(bare)
    return Incidence(left.distinct(), paths.select(F.col("contig_id").alias("id"), "segment").union(bare).distinct())


def _turned(paths: DataFrame, style: str) -> DataFrame:
    rows = paths.select(F.col("contig_id").alias("id"), "segment").distinct()
    return rows.union(rows.select("id", reversed_segment(F.col("segment"), style).alias("segment")))


def _reached(paths: DataFrame, links: DataFrame, style: str) -> DataFrame:
    to = links.select(F.col("a").alias("segment"), F.col("b").alias("to"))
    return _turned(paths, style).join(to, "segment").select("id", F.col("to").alias("segment"))


#: Longs of bits in a row where ``reach`` searches by (contig, segment) and most vertices are met from many sources; elsewhere one.
LANES = 16


class Search:
    """Breadth-first from all sources at once. ``found`` is (word, id, b0, b1, ...): which sources met a vertex on the last level.

    Source k of word w is a bit of the rows of that word: of 64 sources in each of ``lanes`` longs. A level writes at most vertices x sources / (64 x lanes) rows,
    and segments likewise.
    """

    def __init__(self, graph: Incidence | DataFrame, sources: DataFrame, tables: Tables, lanes: int = 1):
        self.tables = tables
        if isinstance(graph, Incidence):
            to, back = graph._ways()
            self.to, self.back = tables.keep(to, "to"), None
            self.back = self.to if graph.right is None else tables.keep(back, "back")
        else:
            self.to, self.back = tables.keep(symmetric(graph), "edges"), None
        self.bits = [f"b{j}" for j in range(lanes)]
        numbered = sources.select("id").distinct().select("id", F.monotonically_increasing_id().alias("k"))
        per = F.lit(64 * lanes)
        #: (source, word, lane, bit), numbered once, when written
        place = [F.floor(F.col("k") / per).alias("word"), F.floor(F.col("k") % per / 64).cast("int").alias("lane"), (F.col("k") % 64).cast("int").alias("bit")]
        self.sources = tables.keep(numbered.select(F.col("id").alias("source"), *place), "sources")
        self.found = tables.keep(self._merged(self._set(self.sources, "word", F.col("source").alias("id")), ["word", "id"]), "found")
        self.seen = [self.found]
        self.entered: list[DataFrame] = []
        self.level = 0
        #: Whether what was seen long ago may be met again: where vertices are not passed. Else a neighbour of the last level is new, on it, or on the one before.
        self.all = False

    def _set(self, rows: DataFrame, *key) -> DataFrame:
        """Of rows with (lane, bit): the key and the bits in their columns."""
        return rows.select(*key, *[F.when(F.col("lane") == j, one("bit")).otherwise(F.lit(0).cast("long")).alias(b) for j, b in enumerate(self.bits)])

    def _merged(self, rows: DataFrame, key: list[str]) -> DataFrame:
        return rows.groupBy(*key).agg(*[F.bit_or(b).alias(b) for b in self.bits])

    def _any(self) -> Column:
        out = F.col(self.bits[0])
        for b in self.bits[1:]:
            out = out.bitwiseOR(F.col(b))
        return out != 0

    def has(self) -> Column:
        """Whether a row that carries (lane, bit) has it."""
        return F.expr(f"shiftright(array({', '.join(self.bits)})[lane], bit) & 1L = 1L")

    def counted(self) -> Column:
        """How many sources a row has."""
        return sum((F.bit_count(b) for b in self.bits[1:]), F.bit_count(self.bits[0])).cast("long")

    def _new(self, met: DataFrame, seen: list[DataFrame], key: list[str], label: str) -> DataFrame:
        """Of (key, bits) what has not been seen; one shuffle, in which tasks merge before they send."""
        zero = [F.lit(0).cast("long")] * len(self.bits)
        rows = met.select(*key, *self.bits, *[z.alias(f"s_{b}") for z, b in zip(zero, self.bits, strict=True)])
        for t in seen:
            rows = rows.union(t.select(*key, *zero, *self.bits))
        merged = rows.groupBy(*key).agg(*[F.bit_or(b).alias(b) for b in [*self.bits, *[f"s_{b}" for b in self.bits]]])
        left = [F.col(b).bitwiseAND(F.bitwise_not(F.col(f"s_{b}"))).alias(b) for b in self.bits]
        return self.tables.keep(merged.select(*key, *left).filter(self._any()), label)

    def _near(self, seen: list[DataFrame]) -> list[DataFrame]:
        return seen if self.all else seen[-2:]

    def _folded(self, seen: list[DataFrame], key: list[str]) -> list[DataFrame]:
        """Many tables of what was seen become one now and then."""
        if len(seen) < 8:
            return seen
        rows = seen[0]
        for t in seen[1:]:
            rows = rows.union(t)
        return [self.tables.keep(self._merged(rows, key), "seen")]

    def step(self, go: DataFrame | None = None) -> bool:
        """One hop from ``go``, or from all that was found last; False if nothing new is met."""
        go = self.found if go is None else go
        self.level += 1
        if self.back is None:
            met = go.join(self.to, go["id"] == self.to["src"]).select("word", F.col("dst").alias("id"), *self.bits)
        else:
            key = ["word", "way", "segment"]
            segments = self._new(go.join(self.to, "id").select(*key, *self.bits), self._near(self.entered), key, "segments")
            met = segments.join(self.back, ["way", "segment"]).select("word", "id", *self.bits)
            self.entered = self._folded([*self._near(self.entered), segments], key)
        self.found = self._new(met, self._near(self.seen), ["word", "id"], "found")
        self.seen = self._folded([*self._near(self.seen), self.found], ["word", "id"])
        return self.found.limit(1).count() > 0

    def levels(self, depth: int | None = None, stop: DataFrame | None = None) -> Iterator[DataFrame]:
        """(word, id, bits) of each level, the sources first. Vertices in ``stop`` (id) are met and not passed, unless they are the source."""
        self.all = stop is not None
        yield self.found
        while depth is None or self.level < depth:
            go = self.found if stop is None or not self.level else self.found.join(stop.select("id").distinct(), "id", "left_anti")
            if not self.step(go):
                return
            yield self.found

    def told(self, rows: DataFrame) -> DataFrame:
        """(source, id): a row for each bit."""
        return rows.join(self.sources, "word").filter(self.has()).select("source", "id")

    def only(self, open_: DataFrame) -> DataFrame:
        """What was found last, for the sources in ``open_`` (word, lane, bit) alone."""
        mask = self._merged(self._set(open_, "word"), ["word"]).select("word", *[F.col(b).alias(f"m_{b}") for b in self.bits])
        return self.found.join(mask, "word").select("word", "id", *[F.col(b).bitwiseAND(F.col(f"m_{b}")).alias(b) for b in self.bits]).filter(self._any())


#: Cells of a row of contigs or segments that a vertex or segment spreads its bits to.
ROW = 1000


class Blocks(Search):
    """The same for many sources on a graph where most vertices of a component are met from most words.

    Sources are numbered component by component, and each word keeps the edges of its components beside its bits, dealt by word. So a level is a job
    without a shuffle, which reads the edges once for each word; words and edges of unlike components never meet. A row of edges is of at most ``ROW`` cells.
    """

    def __init__(self, graph: Incidence, parts: DataFrame, numbered: DataFrame, words: DataFrame, n: int, total: int, tables: Tables):
        self.tables, self.n, self.total, self.level = tables, n, total, 0
        self.bits = [f"b{j}" for j in range(LANES)]
        self.seen_bits = [f"s{j}" for j in range(LANES)]
        self.graph, self.parts, self.words, self.stop = graph, parts, words, None
        self.to = self.back = None
        self.sources = numbered
        first = self._merged(self._set(numbered, "word", F.col("source").alias("id")), ["word", "id"])
        self._keep(first.select("word", "id", *self.bits, *[F.col(b).alias(s) for b, s in zip(self.bits, self.seen_bits, strict=True)]).repartition(n, "word"))

    def _keep(self, rows: DataFrame) -> None:
        state = self.tables.keep_bucketed(rows, "word", self.n, "state")
        left = sum((F.bit_count(s) for s in self.seen_bits[1:]), F.bit_count(self.seen_bits[0]))
        got = state.agg(F.sum(left.cast("long")).alias("seen"), F.sum(self.counted()).alias("new")).first()
        self.seen, self.new, self.state = got["seen"] or 0, got["new"] or 0, state
        self.found = state.select("word", "id", *self.bits).filter(self._any())

    def _rows(self, rows: DataFrame, key: list[str], cell: Column, order: list[str]) -> DataFrame:
        """(word, key, cells): the rows of a component, for each of its words."""
        place = F.floor((F.row_number().over(Window.partitionBy("component", *key).orderBy(*order)) - 1) / ROW).alias("_row")
        packed = rows.select("component", *key, cell.alias("cell"), place).groupBy("component", *key, "_row").agg(F.collect_list("cell").alias("cells")).drop("_row")
        return self.tables.keep_bucketed(packed.join(self.words, "component").drop("component").repartition(self.n, "word"), "word", self.n, "rows")

    def _edges(self) -> None:
        to, back = (t.join(self.parts, "id") for t in self.graph._ways())
        self.to = self._rows(to, ["id"], F.struct("way", "segment"), ["way", "segment"])
        if self.stop is not None:
            self.to = self.to.join(F.broadcast(self.stop) if self.few else self.stop, "id", "left").withColumn("go", F.col("stops").isNull())
            self.to = self.tables.keep_bucketed(self.to.drop("stops").repartition(self.n, "word"), "word", self.n, "rows")
        self.back = self._rows(back, ["way", "segment"], F.col("id"), ["id"])

    def by_word(self, rows: DataFrame) -> DataFrame:
        return self.tables.keep_bucketed(rows.repartition(self.n, "word"), "word", self.n, "by-word")

    @contextmanager
    def beside(self) -> Iterator[None]:
        """Tables that are dealt by word meet by further keys where they are."""
        conf, key = self.tables.spark.conf, "spark.sql.requireAllClusterKeysForCoPartition"
        before = conf.get(key, "true")
        conf.set(key, "false")
        try:
            yield
        finally:
            conf.set(key, before)

    def step(self, go: DataFrame | None = None) -> bool:
        if self.seen >= self.total:  # every vertex has met all sources of its component
            return False
        if self.to is None:
            self._edges()
        self.level += 1
        to = self.to if self.stop is None or self.level == 1 else self.to.filter("go")
        segments = self.found.join(to.select("word", "id", "cells"), ["word", "id"]).select("word", F.explode("cells").alias("c"), *self.bits)
        segments = self._merged(segments.select("word", "c.way", "c.segment", *self.bits), ["word", "way", "segment"])
        met = segments.join(self.back, ["word", "way", "segment"]).select("word", F.explode("cells").alias("id"), *self.bits)
        met = self._merged(met, ["word", "id"])
        zero = F.lit(0).cast("long")
        both = self.state.select("word", "id", *self.seen_bits).join(met, ["word", "id"], "full")
        seen = [F.coalesce(s, zero) for s in self.seen_bits]
        came = [F.coalesce(b, zero) for b in self.bits]
        new = [b.bitwiseAND(F.bitwise_not(s)).alias(n) for b, s, n in zip(came, seen, self.bits, strict=True)]
        after = [s.bitwiseOR(b).alias(n) for b, s, n in zip(came, seen, self.seen_bits, strict=True)]
        with self.beside():
            self._keep(both.select("word", "id", *new, *after))
        return self.new > 0

    def levels(self, depth: int | None = None, stop: DataFrame | None = None) -> Iterator[DataFrame]:
        if stop is not None:
            self.stop = stop.select("id", F.lit(True).alias("stops")).distinct()
            self.few = self.stop.limit(FEW + 1).count() <= FEW
        yield self.found
        while (depth is None or self.level < depth) and self.step():
            yield self.found


#: Ids up to which a set of them is broadcast.
FEW = 100_000


def blocks(graph: Incidence | DataFrame, sources: DataFrame, tables: Tables) -> Blocks | None:
    """``Blocks``, if there are more sources than one word has and vertices soon meet most words of their component; else None."""
    if not isinstance(graph, Incidence):
        return None
    per = 64 * LANES
    ids = tables.keep(sources.select("id").distinct(), "ids")
    if ids.limit(per + 1).count() <= per:
        return None
    vertices = ids.union(graph.left.select("id")) if graph.right is None else ids.union(graph.left.select("id")).union(graph.right.select("id"))
    parts = tables.keep(graph.components(vertices.distinct(), tables), "parts")
    k = tables.ordinals(ids.join(parts, "id"), ["component", "id"], "k")
    place = [F.floor(F.col("k") / per).cast("long").alias("word"), F.floor(F.col("k") % per / 64).cast("int").alias("lane"), (F.col("k") % 64).cast("int").alias("bit")]
    numbered = tables.keep(k.select(F.col("id").alias("source"), *place, "component"), "sources")
    words = tables.keep(numbered.groupBy("component", "word").agg(F.count(F.lit(1)).alias("n")), "words")
    whole = parts.groupBy("component").agg(F.count(F.lit(1)).alias("v")).join(words.groupBy("component").agg(F.count(F.lit(1)).alias("w"), F.sum("n").alias("s")), "component")
    size = whole.agg(F.sum(F.col("v") * F.col("w")).alias("rows"), F.sum(F.col("v") * F.col("s")).alias("total")).first()
    # what a first level writes at most: a pair of contigs for each segment
    to, back = (t.groupBy("way", "segment").agg(F.count(F.lit(1)).alias(c)) for t, c in zip(graph._ways(), ("x", "y"), strict=True))
    pairs = to.join(back, ["way", "segment"]).agg(F.sum(F.col("x") * F.col("y"))).first()[0] or 0
    if pairs * 4 < size["rows"]:
        return None
    n = words.select("word").distinct().count()
    n = max(tables.spark.sparkContext.defaultParallelism, min(2 * n, 4096))
    return Blocks(graph, parts, numbered.drop("component"), words.select("component", "word"), n, size["total"], tables)


def one(bit: str) -> Column:
    return F.expr(f"shiftleft(1L, {bit})")


def reach(graph: Incidence | DataFrame, sources: DataFrame, depth: int | None = None, stop: DataFrame | None = None, tables: Tables | None = None) -> DataFrame:
    """(id, dist, n): how many sources are so many hops from a vertex, 0 for themselves; nothing is formed for each pair of them.

    ``stop`` as in ``hops``.
    """
    tables = tables or Tables(sources.sparkSession, "reach")
    search = blocks(graph, sources, tables) or Search(graph, sources, tables, LANES if isinstance(graph, Incidence) else 1)
    rows = [found.groupBy("id").agg(F.sum(search.counted()).cast("long").alias("n")).select("id", F.lit(k).alias("dist"), "n") for k, found in enumerate(search.levels(depth, stop))]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


def with_labelled(parts: DataFrame, labelled: DataFrame) -> DataFrame:
    """Of (id, component) those whose component holds a labelled id."""
    hit = parts.join(labelled.select("id").distinct(), "id", "left_semi").select("component").distinct()
    return parts.join(hit, "component", "left_semi").select("id", "component")


def hops(edges: DataFrame, sources: DataFrame, depth: int | None, stop: DataFrame | None = None, tables: Tables | None = None) -> DataFrame:
    """(source, id, dist): breadth-first from each source, the source itself at 0, up to ``depth`` hops.

    Vertices in ``stop`` (id) are reached but not passed, unless they are the source.
    """
    tables = tables or Tables(edges.sparkSession, "hops")
    both = tables.keep(symmetric(edges), "edges")
    front = tables.keep(sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("dist")).distinct(), "front")
    fronts, level = [front], 0
    stops = None if stop is None else stop.select("id").distinct()
    while depth is None or level < depth:
        level += 1
        go = front if stops is None or level == 1 else front.join(stops, "id", "left_anti")
        step = go.join(both, go["id"] == both["src"]).select("source", F.col("dst").alias("id"), F.lit(True).alias("new"))
        # a neighbour of the last level that is not new is on it or on the one before
        for t in fronts[-2:]:
            step = step.union(t.select("source", "id", F.lit(False).alias("new")))
        after = step.groupBy("source", "id").agg(F.min("new").alias("new")).filter("new").select("source", "id", F.lit(level).alias("dist"))
        front = tables.keep(after, "front")
        if not front.limit(1).count():
            break
        fronts.append(front)
    out = fronts[0]
    for t in fronts[1:]:
        out = out.union(t)
    # a stop vertex is not passed, so it may be met again on any later level; but for it and the source every vertex is in one front
    return out if stops is None else out.groupBy("source", "id").agg(F.min("dist").alias("dist"))


def distances(graph: Incidence | DataFrame, pairs: DataFrame, tables: Tables | None = None) -> DataFrame:
    """(source, target, dist) of the pairs (source, target) that a path joins: the pairs asked for and no others.

    All sources search together, as bits; one that has met its targets leaves.
    """
    tables = tables or Tables(pairs.sparkSession, "distances")
    asked = pairs.select("source", "target").filter("source <> target").distinct()
    dealt_ = blocks(graph, asked.select(F.col("source").alias("id")), tables)
    if dealt_ is not None:
        return _distances_by_word(dealt_, asked)
    search = Search(graph, asked.select(F.col("source").alias("id")), tables)
    open_ = tables.keep(asked.join(search.sources, "source").select("source", "word", "lane", "bit", F.col("target").alias("id")), "open")
    found, go = open_.select("source", F.col("id").alias("target"), F.lit(0).alias("dist")).limit(0), search.found
    while search.step(go):
        hit = open_.join(search.found, ["word", "id"]).filter(search.has()).select("source", "id")
        hit = tables.keep(hit, "hit")
        found = found.union(hit.select("source", F.col("id").alias("target"), F.lit(search.level).alias("dist")))
        after = tables.keep(open_.join(hit, ["source", "id"], "left_anti"), "open")
        tables.drop(open_)
        open_ = after
        go = search.only(open_)
    return found


def _distances_by_word(search: Blocks, asked: DataFrame) -> DataFrame:
    """The same where no source leaves: a bit is new on one level alone, so each pair is met once."""
    targets = asked.join(search.sources, "source").join(search.parts.select(F.col("id").alias("target")), "target")
    open_ = search.by_word(targets.select("source", "word", "lane", "bit", F.col("target").alias("id")))
    found = open_.select("source", F.col("id").alias("target"), F.lit(0).alias("dist")).limit(0)
    while search.step():
        with search.beside():
            hit = search.tables.keep(open_.join(search.found, ["word", "id"]).filter(search.has()).select("source", F.col("id").alias("target")), "hit")
        found = found.union(hit.select("source", "target", F.lit(search.level).alias("dist")))
    return found


def mean_vertices(graph: Incidence | DataFrame, pairs: DataFrame, tables: Tables | None = None) -> DataFrame:
    """(source, avg_vertices): of the vertices on shortest paths to all asked targets; without a path 0, to itself 1."""
    tables = tables or Tables(pairs.sparkSession, "means")
    asked = tables.keep(pairs.select("source", "target").distinct(), "pairs")
    lengths = asked.join(distances(graph, asked, tables), ["source", "target"], "left").withColumn("dist", F.when(F.col("source") == F.col("target"), 0).otherwise(F.col("dist")))
    return mean_path_length(lengths.join(asked.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "source"), ["source"], "n")


def nearest(graph: Incidence | DataFrame, sources: DataFrame, wanted: DataFrame, tables: Tables | None = None) -> DataFrame:
    """As ``nearest_level``, with all sources searching together."""
    tables = tables or Tables(sources.sparkSession, "nearest")
    search = Search(graph, sources, tables)
    wanted = tables.keep(wanted.select("id").distinct(), "wanted")
    open_ = search.sources
    found, go = open_.select("source", F.col("source").alias("id"), F.lit(0).alias("dist")).limit(0), search.found
    while search.step(go):
        hit = tables.keep(search.told(search.only(open_).join(wanted, "id", "left_semi")), "hit")
        found = found.union(hit.select("source", "id", F.lit(search.level).alias("dist")))
        open_ = tables.keep(open_.join(hit.select("source").distinct(), "source", "left_anti"), "open")
        go = search.only(open_)
    return found


def first_labelled(edges: DataFrame, sources: DataFrame, labelled: DataFrame, depth: int | None, tables: Tables | None = None) -> DataFrame:
    """(source, id, dist) of the labelled vertices that a search which does not pass labelled vertices reaches."""
    reached = hops(edges, sources, depth, labelled, tables)
    return reached.join(labelled.select("id").distinct(), "id", "left_semi").filter("dist > 0").select("source", "id", "dist")


def nearest_level(edges: DataFrame, sources: DataFrame, wanted: DataFrame, tables: Tables | None = None) -> DataFrame:
    """(source, id, dist): all wanted vertices on the first level that has any, passing through any vertex.

    A source that has found its level leaves the search.
    """
    tables = tables or Tables(edges.sparkSession, "nearest")
    both = tables.keep(symmetric(edges), "edges")
    wanted = tables.keep(wanted.select("id").distinct(), "wanted")
    front = tables.keep(sources.select(F.col("id").alias("source"), "id").distinct(), "front")
    seen, found, level = front, None, 0
    while True:
        level += 1
        step = front.join(both, front["id"] == both["src"]).select("source", F.col("dst").alias("id")).distinct()
        step = tables.keep(step.join(seen, ["source", "id"], "left_anti"), "step")
        if not step.limit(1).count():
            break
        hit = tables.keep(step.join(wanted, "id", "left_semi").select("source", "id", F.lit(level).alias("dist")), "hit")
        found = hit if found is None else found.union(hit)
        front = tables.keep(step.join(hit.select("source").distinct(), "source", "left_anti"), "front")
        seen = tables.keep(seen.union(step), "seen") if level % 8 == 0 else seen.union(step)
    return found if found is not None else sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("dist")).limit(0)


def mean_path_length(lengths: DataFrame, key: list[str], n: str | None = None) -> DataFrame:
    """(key, avg): floor of the vertices on shortest paths (hops + 1; unreachable counts 0) over ``n``, or over the rows there are."""
    of = F.count(F.lit(1)) if n is None else F.first(n)
    return lengths.groupBy(*key).agg(F.floor(F.sum(F.coalesce(F.col("dist") + 1, F.lit(0))) / of).alias("avg_vertices"))
