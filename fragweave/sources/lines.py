"""Text with its place: which file, where in it, and dense numbers in file order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What orders records: file, start of the block, record within the block.
PLACE = ("_file", "_block", "_row")


def records(spark: SparkSession, path, separator: str | None = None) -> DataFrame:
    """(value, _file, _block, _row): one row for each line, or for each piece between separators."""
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    return reader.text(path).select(
        F.rtrim(F.col("value"), F.lit("\r")).alias("value"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )


def numbered(rows: DataFrame, name: str = "line_no") -> DataFrame:
    """Dense numbers from 0 in file order.

    Blocks are counted (one row each) and a row's number is its rank in the block after the blocks before.
    """
    at = Window.partitionBy("_file", "_block").orderBy("_row")
    counts = rows.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_file", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    ranked = rows.withColumn("_rank", F.row_number().over(at) - 1)
    return ranked.join(starts, ["_file", "_block"]).withColumn(name, F.col("_start") + F.col("_rank")).drop("_start", "_rank", *PLACE)
