"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

A rule is a host, a path prefix and a verdict. It fits its host and all subdomains if the url's path starts with its own;
of several the longest wins. Urls that a rule judges are the labelled rows. Boosted trees learn from them, by histograms:
features are cut into bins at training quantiles, and each level of each tree is one grouped sum of gradients over
(node, feature, bin), whose few rows choose the splits. Gradients are summed as whole numbers, so reruns agree. A row's margin
is a column of the training table, which is written once a tree; trees are arrays, so every level runs the same compiled code.
Features are length, depth, digit ratio, entropy, parameters and what the labelled rows say about the host's suffix; for a labelled
row itself that is what the rows of other folds say, so that no row's own label is among its features.
DataFrame operators only.

A null url, or one without "://", has empty host and path, fits no rule, and is judged by the trees as an empty url.
Without labelled rows the verdict is allow; with one kind of label it is that kind. Ties of gain go to the first feature and
the lowest cut. Repeated rows are judged row by row, and fall into one fold. Very long urls are taken whole. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: (host, path prefix, verdict)
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
TREES, DEPTH, BINS, RATE, RIDGE = 10, 3, 16, 0.3, 1.0
#: Folds of the labelled rows for the statistics of suffixes, and the weight of the mean in these.
FOLDS, PRIOR = 5, 10
_UNIT = 1 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def by_rules(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits; nulls if none does."""
    out = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for own, prefix, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(prefix))
        out = F.when(fits, F.struct(F.lit(own + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def _count(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def entropy(text: Column) -> Column:
    """Bits of a character of the text."""
    n = F.length(text)
    chars = F.array_distinct(F.split(text, ""))

    def share(c):
        return (n - F.length(F.replace(text, c, F.lit("")))) / n

    each = F.transform(F.filter(chars, lambda c: c != ""), lambda c: -share(c) * F.log2(share(c)))
    return F.when(n > 0, F.aggregate(each, F.lit(0.0), lambda a, b: a + b)).otherwise(F.lit(0.0))


def lexical(url: Column, path: Column) -> dict[str, Column]:
    digits = F.length(F.regexp_replace(url, "[^0-9]", ""))
    query = F.when(F.instr(url, "?") > 0, F.lit(1)).otherwise(F.lit(0))
    return {
        "length": F.length(url).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": _count(path, "/").cast("double"),
        "labels": _count(host_of(url), ".").cast("double"),
        "digits": F.coalesce(digits / F.nullif(F.length(url), F.lit(0)), F.lit(0.0)),
        "entropy": entropy(url),
        "parameters": (query + _count(url, "&")).cast("double"),
        "fragment": (F.instr(url, "#") > 0).cast("double"),
        "extension": (F.instr(F.substring_index(path, "/", -1), ".") > 0).cast("double"),
    }


FEATURES = ("length", "path_length", "depth", "labels", "digits", "entropy", "parameters", "fragment", "extension", "suffix_rate", "suffix_log")


@dataclass
class Tree:
    """Splits (feature, bin) of a full binary tree in heap order and the values of all nodes.

    What is not split sends all rows to its left child, which has its value.
    """

    splits: list[tuple[int, int]]
    values: list[float]

    def node(self, bins: Column, levels: int) -> Column:
        """Number of the node, in heap order, that a row reaches after so many levels."""
        features, cuts = F.lit([f for f, _ in self.splits]), F.lit([b for _, b in self.splits])
        at = F.lit(0)
        for _ in range(levels):
            right = F.element_at(bins, F.element_at(features, at + 1) + 1) > F.element_at(cuts, at + 1)
            at = at * 2 + 1 + right.cast("int")
        return at

    def value(self, bins: Column, depth: int) -> Column:
        return F.element_at(F.lit(self.values), self.node(bins, depth) + 1)


def _split(sums: dict[tuple[int, int], tuple[float, float]], n_features: int, ridge: float):
    """The best (feature, bin) of one node, or none, and the gradient and hessian sums at its left and right."""
    total_g = sum(g for (f, _), (g, _) in sums.items() if f == 0)
    total_h = sum(h for (f, _), (_, h) in sums.items() if f == 0)
    best, gain, sides = None, 1e-6, ((total_g, total_h), (0.0, 0.0))
    for f in range(n_features):
        g = h = 0.0
        bins = sorted(b for x, b in sums if x == f)
        for b in bins[:-1]:
            g, h = g + sums[f, b][0], h + sums[f, b][1]
            rest_g, rest_h = total_g - g, total_h - h
            got = g * g / (h + ridge) + rest_g * rest_g / (rest_h + ridge) - total_g * total_g / (total_h + ridge)
            if min(h, rest_h) >= 1e-3 and got > gain:
                best, gain, sides = (f, b), got, ((g, h), (rest_g, rest_h))
    return best, sides


def boost(rows: DataFrame, n_features: int, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, ridge: float = RIDGE, scratch: Scratch | None = None) -> tuple[float, list[Tree]]:
    """rows: (bins array<int>, y int). The base margin and the trees."""
    scratch = scratch or Scratch(rows.sparkSession, "boost")
    bins, p = F.col("bins"), F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("m")))
    mean = rows.agg(F.avg("y")).first()[0]
    base, grown = math.log(mean / (1 - mean)), []
    held = scratch.keep(rows.select("bins", "y", F.lit(base).alias("m")), "margins")
    while True:
        tree = Tree([(0, BINS)] * (2**depth - 1), [0.0] * (2 ** (depth + 1) - 1))
        open_ = {0}
        for level in range(depth):
            at = held.select(tree.node(bins, level).alias("node"), F.round((p - F.col("y")) * _UNIT).cast("long").alias("g"), F.round(p * (1 - p) * _UNIT).cast("long").alias("h"), F.posexplode("bins").alias("f", "b"))
            # rows out: nodes * features * bins at most, whatever the input
            cells = at.groupBy("node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            by: dict[int, dict] = {n: {} for n in open_}
            for c in cells:
                if c["node"] in by:
                    by[c["node"]][c["f"], c["b"]] = (c["g"] / _UNIT, c["h"] / _UNIT)
            following = set()
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                if node in open_:
                    split, sides = _split(by[node], n_features, ridge)
                    if node == 0:
                        g, h = (sum(x) for x in zip(*sides, strict=True))
                        tree.values[0] = -rate * g / (h + ridge)
                    if split is not None:
                        tree.splits[node] = split
                        for child, (g, h) in zip((2 * node + 1, 2 * node + 2), sides, strict=True):
                            tree.values[child] = -rate * g / (h + ridge)
                            following.add(child)
                        continue
                tree.values[2 * node + 1] = tree.values[node]
            open_ = following
        grown.append(tree)
        if len(grown) == trees:
            return base, grown
        before, held = held, scratch.keep(held.select("bins", "y", (F.col("m") + tree.value(bins, depth)).alias("m")), "margins")
        scratch.drop(before)


def margin(bins: Column, base: float, trees: list[Tree], depth: int = DEPTH) -> Column:
    return reduce(lambda a, t: a + t.value(bins, depth), trees, F.lit(base))


def _suffixes(rows: DataFrame, mean: float) -> DataFrame:
    """Adds what labelled urls say about the suffix: how often they are blocked, drawn to the mean, and how many there are.

    A labelled row is told by the rows of other folds only. Sums go by (suffix, fold) first, so a hot suffix is a few rows.
    """
    labelled = rows.filter("ruled IS NOT NULL")
    each = labelled.groupBy("suffix", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("ruled") == "block").cast("long")).alias("y"))
    per = each.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y"), F.map_from_entries(F.collect_list(F.struct("fold", F.struct("n", "y")))).alias("own"))
    told = rows.join(per, "suffix", "left")
    own = F.when(F.col("ruled").isNotNull(), F.try_element_at("own", F.col("fold")))
    n, y = (F.coalesce(F.col(c), F.lit(0)) - F.coalesce(own[c], F.lit(0)) for c in ("n", "y"))
    return told.withColumn("suffix_rate", (y + F.lit(PRIOR * mean)) / (n + PRIOR)).withColumn("suffix_log", F.log1p(n.cast("double"))).drop("n", "y", "own")


def judge(pages: DataFrame, rules=RULES, url: str = "url", key: str = "page_id", scratch: Scratch | None = None, hold_out: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the trees' probability of block).

    hold_out: labelled rows of this fold (0 to ``FOLDS`` - 1) teach nothing, and ``held_out`` marks them; by default all labelled rows teach.
    """
    spark = pages.sparkSession
    scratch = scratch or Scratch(spark, "urls")
    rows = pages.select(F.col(key).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("u")).select("page_id", "u", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"))
    rows = rows.withColumn("by", by_rules(F.col("host"), F.col("path"), rules)).withColumn("suffix", suffix_of(F.col("host")))
    fold = F.pmod(F.crc32(F.col("u").cast("binary")), F.lit(FOLDS)).cast("int")
    rows = rows.select("page_id", "host", "path", "by.rule", F.col("by.verdict").alias("verdict"), "suffix", fold.alias("fold"), *[c.alias(n) for n, c in lexical(F.col("u"), F.col("path")).items()])
    held = F.lit(False) if hold_out is None else F.col("verdict").isNotNull() & (F.col("fold") == hold_out)
    rows = rows.withColumn("held_out", held).withColumn("ruled", F.when(~F.col("held_out"), F.col("verdict")))
    rows = scratch.keep(rows, "rows")
    names = ["page_id", "host", "path", "rule", "verdict", "score", *(["held_out"] if hold_out is not None else [])]
    totals = rows.filter("ruled IS NOT NULL").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("ruled") == "block").cast("long")).alias("y")).first()
    n, ones = totals["n"], totals["y"] or 0
    if ones in (0, n):
        only, level = ("block", 1.0) if n and ones else ("allow", 0.0 if n else 0.5)
        return rows.withColumn("verdict", F.coalesce("verdict", F.lit(only))).withColumn("score", F.lit(level)).select(*names)
    rows = _suffixes(rows, ones / n)
    known = rows.filter("ruled IS NOT NULL")
    shares = F.array(*[F.lit(k / BINS) for k in range(1, BINS)])
    cut = known.agg(*[F.percentile_approx(f, shares, F.lit(10_000)).alias(f) for f in FEATURES]).first()

    def binned(f: str) -> Column:
        bounds = sorted(set(cut[f]))
        return reduce(lambda a, b: a + (F.col(f) > F.lit(float(b))).cast("int"), bounds, F.lit(0))

    binned_rows = scratch.keep(rows.select("page_id", "host", "path", "rule", "verdict", "ruled", "held_out", F.array(*[binned(f) for f in FEATURES]).alias("bins")), "binned")
    train = binned_rows.filter("ruled IS NOT NULL").select("bins", (F.col("ruled") == "block").cast("int").alias("y"))
    base, trees = boost(train, len(FEATURES), scratch=scratch)
    judged = binned_rows.withColumn("m", margin(F.col("bins"), base, trees))
    verdict = F.coalesce("verdict", F.when(F.col("m") >= 0, "block").otherwise("allow"))
    return judged.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("m")))).withColumn("verdict", verdict).select(*names)


def query(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return judge(pages)
