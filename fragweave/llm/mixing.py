"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the key -ln(u) / w: u a uniform number that follows from doc_id, text and seed,
w its quality weight: a column of the caller's (say a classifier's score), or else what the text itself shows. Documents are sorted by key within their source and prefix-summed; the source's
target takes whole epochs first, then the documents whose words end within the rest of the budget. The gap that a large
document leaves there goes to later ones that fit, in the order of their keys, again and again until none fits. Then the smallest of the others is taken too, if
that ends nearer to the target than leaving it. So a source ends within half of its smallest document that is left, or has none left.
DataFrame operators only; hot sources are dealt over many tasks. A running sum is a row's place in its source, so a pass over the gaps is told by one
row for each source, (largest size, last place), and nothing is written for the documents.

Size: words of the text; null or empty: 0. Sources are ordered by code point, null last, with weights that
repeat in this order. A weight that is null, not finite or under ``LOW`` counts as ``LOW``. Targets share ``share`` times all sizes by weight, at most ``most`` times their source's size;
the excess goes to the others by weight. Equal rows tie: they share u, and the running sum takes them in the order of the
carried columns, or any. Rows with a null doc_id take part like others; very long texts are read once and do not travel.
An empty table gives an empty result. Columns that are not carried are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, ordered_sums, uniform

WEIGHTS = (3.0, 1.0, 2.0)
#: Sources up to which their table (some 50 bytes each) is broadcast, so that a hot source's rows stay where they are.
SOURCES = 100_000


#: The smallest weight: no document is out of reach.
LOW = 0.1


def _split(text: Column) -> Column:
    """A text at its white space: its words, and an empty string before or after them where it begins or ends with white space."""
    return F.split(text, r"[\x20\x09-\x0D]+")


def words(text: Column) -> Column:
    """How many words a text has."""
    parts = _split(text)
    ends = [(F.element_at(parts, k) == "").cast("int") for k in (1, -1)]
    return F.greatest(F.size(parts) - ends[0] - ends[1], F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """A weight in [LOW, 1] of a whole text: the share of letters and white space, times how varied its words are.

    Varied: distinct words over twice the root of the number of words, at most 1, so that length alone does not count.
    An empty text has LOW.
    """
    plain = F.length(F.regexp_replace(text, r"[^\p{L}\s]+", "")) / F.nullif(F.length(text), F.lit(0))
    parts = _split(text)
    varied = F.least(F.lit(1.0), F.size(F.array_distinct(parts)) / (2 * F.sqrt(F.size(parts).cast("double"))))
    return F.lit(LOW) + F.lit(1 - LOW) * F.coalesce(plain * varied, F.lit(0.0))


def targets(per: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """per: (source, source_size). Adds ``target``.

    With sources sorted by cap / weight the capped ones come first, so the level that the others share
    is that of the first source whose cap is not below it.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    w = F.element_at(cycle, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = per.withColumn("w", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    rows = (
        rows.withColumn("before", F.coalesce(F.sum("cap").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("w_from", F.sum("w").over(level.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("all", F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy()))
        .withColumn("level", (F.col("all") - F.col("before")) / F.col("w_from"))
    )
    rows = rows.withColumn("shared", F.max(F.when(F.col("cap") >= F.col("level") * F.col("w"), F.col("level"))).over(Window.partitionBy()))
    return rows.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("shared") * F.col("w"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 17, scratch: Scratch | None = None, carry: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """weight: the column of quality weights, if the documents bring them.

    ``carry`` may not hold names of the columns that are returned or worked with. Returns doc_id, source, size, source_size, target, epochs (whole passes), chosen (in the fractional pass), taken, and ``carry``."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "mixing")
    text = F.coalesce(F.col("text"), F.lit(""))
    w = quality(text) if weight is None else F.col(weight).cast("double")
    w = F.when((w >= LOW) & ~F.isnan(w) & (w < float("inf")), w).otherwise(F.lit(LOW))
    # the texts are read here and nowhere else
    keyed = docs.select(
        F.col("doc_id").cast("long"),
        "source",
        *carry,
        words(text).alias("size"),
        (-F.log(uniform(F.col("doc_id"), F.col("text"), seed=seed)) / w).alias("key"),
    )
    keyed = scratch.keep(keyed, "keyed")
    order = [F.col("source").asc_nulls_last(), "key", "doc_id", *carry]
    run = scratch.keep(ordered_sums(scratch, keyed, order, {"upto": "size"}, ["source"], "range"), "run")
    scratch.drop(keyed)
    per = targets(run.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most).withColumnRenamed("source", "_source")
    epochs = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("long")
    per = per.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    # a source that takes all epochs is done; passes: what each further look at the documents took
    none = F.array().cast("array<struct<size:double,upto:long,at:boolean>>")
    per = scratch.keep(per.withColumn("open", F.col("epochs") < F.lit(int(most))).withColumn("passes", none), "sources")
    per = _filled(scratch, run, per)
    out = _with_sources(run, per)
    chosen = _chosen()
    taken = (F.col("epochs") + chosen.cast("long")) * F.col("size")
    return out.select("doc_id", "source", "size", *[c for c in carry], "source_size", "target", "epochs", chosen.alias("chosen"), taken.alias("taken"))


def _chosen() -> Column:
    """Whether the fractional pass takes a row, by its place and its source's passes."""
    later = F.exists("passes", lambda p: F.when(p["at"], F.col("upto") == p["upto"]).otherwise((F.col("size") <= p["size"]) & (F.col("upto") <= p["upto"])))
    return F.col("open") & (F.col("size") > 0) & ((F.col("upto") <= F.col("rest")) | later)


def _filled(scratch: Scratch, run: DataFrame, per: DataFrame) -> DataFrame:
    """The sources with their passes: the gaps are filled with what fits, and the end that is nearest is taken."""
    first = _with_sources(run, per).groupBy("_source").agg(F.coalesce(F.sum(F.when(_chosen(), F.col("size"))), F.lit(0)).alias("got"))
    per = _after(scratch, per.withColumn("gap", F.col("rest")), first, None)
    while True:
        open_ = F.col("open") & (F.col("size") > 0) & ~_chosen()
        left = _with_sources(run, per).filter(open_ & (F.col("size") <= F.col("gap")))
        # the ranges of the order in which a source's gap is filled; only their rows are looked at one by one
        ranges = left.groupBy("_source", "range").agg(F.sum("size").alias("sum"), F.min("gap").alias("_gap"))
        before = F.coalesce(F.sum("sum").over(Window.partitionBy("_source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        met = ranges.withColumn("before", before).filter("before < _gap").select(F.col("_source").alias("_s"), F.col("range").alias("_range"), "before")
        rows = left.join(met, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("range") == F.col("_range")))
        end = F.col("before") + F.sum("size").over(Window.partitionBy("_source", "range").orderBy("upto").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        got = rows.withColumn("end", end).filter("end <= gap").groupBy("_source").agg(F.max("end").alias("got"), F.max("upto").alias("last"), F.first("gap").alias("size"))
        got = scratch.keep(got, "pass")
        if not got.limit(1).count():
            break
        done, per = per, _after(scratch, per, got.withColumn("pass", F.struct(F.col("size").cast("double").alias("size"), F.col("last").alias("upto"), F.lit(False).alias("at"))).drop("size", "last"), "pass")
        scratch.drop(done)
        scratch.drop(got)
    left = _with_sources(run, per).filter(F.col("open") & (F.col("size") > 0) & ~_chosen())
    nearer = left.groupBy("_source").agg(F.min(F.struct("size", "upto")).alias("m"), F.first("gap").alias("_gap")).filter("m.size - _gap < _gap")
    ends = nearer.select("_source", F.lit(0).alias("got"), F.struct(F.lit(0.0).alias("size"), F.col("m.upto").alias("upto"), F.lit(True).alias("at")).alias("pass"))
    return _after(scratch, per, ends, "pass")


def _after(scratch: Scratch, per: DataFrame, got: DataFrame, made: str | None) -> DataFrame:
    """The sources after a pass: (_source, got) less of a gap, and the pass itself."""
    got = got.withColumnRenamed("_source", "_s")
    out = per.join(got, F.col("_source").eqNullSafe(F.col("_s")), "left").withColumn("gap", F.col("gap") - F.coalesce("got", F.lit(0)))
    if made:
        out = out.withColumn("passes", F.when(F.col(made).isNull(), F.col("passes")).otherwise(F.array_append("passes", F.col(made))))
    return scratch.keep(out.select(*per.columns), "sources")


def _with_sources(run: DataFrame, per: DataFrame) -> DataFrame:
    """The rows with their source's row, which is broadcast if there are few, so that a hot source's rows stay where they are."""
    few = F.broadcast(per) if per.limit(SOURCES + 1).count() <= SOURCES else per
    return run.join(few, F.col("source").eqNullSafe(F.col("_source")))


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
