"""Shared plumbing: scratch tables that outlive an executor, ordered prefix sums, Arrow helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import Tables

#: Rows of an Arrow batch.
BATCH = 2000


def tidy() -> None:
    """Gives a Python worker's freed memory back to the machine; workers wait for further tasks beside the JVM."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


class Scratch(Tables):
    """Written tables of one operator call, for operators whose Python workers get texts."""

    def __init__(self, spark: SparkSession, name: str):
        super().__init__(spark, name)
        # texts go to Python workers in batches of this many rows: it bounds their memory
        most = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(most)) <= BATCH:
            spark.conf.set(most, BATCH)


def rows_as_structs(df: DataFrame, name: str = "row") -> DataFrame:
    """One column that holds each row whole, so that no helper column can have the name of one of its own."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def uniform(*cols: Column, seed: int = 0) -> Column:
    """A number in (0, 1) that depends on the columns and the seed alone."""
    bits = F.shiftrightunsigned(F.xxhash64(*cols, F.lit(seed)), 11)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def ordered_sums(scratch: Scratch, df: DataFrame, order: list, sums: dict[str, str], group: list[str] = (), range_name: str | None = None) -> DataFrame:
    """Adds running sums (this row included) over the order of all rows.

    ``sums``: output name to summed column. With ``group`` (which must lead the order) the sums
    restart for each group; hot groups may span many tasks. ``range_name`` keeps the number of a row's range under that name. Rows are dealt by range of the whole
    order, summed in each range, and get the sum of the ranges before. Native operators only.
    Dealing by range reads ``df`` twice (it looks for the bounds first), so what is dear to compute is written before.
    """
    n = partitions(scratch.spark)
    # rows that are equal in the order are told apart by where they stand, so that they too spread over ranges
    df, order = df.withColumn("_tie", F.monotonically_increasing_id()), [*order, "_tie"]
    ranged = scratch.keep(df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()), "ranged")
    group = list(group)
    keys = [*group, "_pid"]
    per = ranged.groupBy(*keys).agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    if group:
        before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    start = per.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_b_{o}") for o in sums],
    )
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = ranged
    for o, c in sums.items():
        inner = inner.withColumn(f"_r_{o}", F.sum(c).over(upto))
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = inner.join(start, match, "left")
    for o in sums:
        out = out.withColumn(o, F.col(f"_r_{o}") + F.col(f"_b_{o}"))
    drop = ["_pid", "_tie", *[f"_k_{k}" for k in keys], *[f"_b_{o}" for o in sums], *[f"_r_{o}" for o in sums]]
    if range_name:
        out = out.withColumn(range_name, F.col("_pid"))
    return out.drop(*drop)


