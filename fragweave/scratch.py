"""Written tables that cut the lineage of iterative plans."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Where none is set: a folder of this machine if driver and tasks are one process, and an error on a cluster.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="fragweave-")
    return "file://" + _OWN[app]


def spread(rows: DataFrame) -> DataFrame:
    """For work that is heavy for each row: an input too small to fill all cores by itself is dealt anew.

    Judged by the planner's estimate of its bytes, so nothing runs for it; a large input stays where it is.
    """
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    piece = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return rows.repartition(cores) if size < cores * piece else rows


class Tables:
    """Tables of one call; ``drop`` deletes one that no later plan reads, the rest goes when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{root(spark)}/fragweave/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        #: By identity of the frame, which is held so that no other gets its number: path, and the catalogue's name if it has one.
        self.places: dict[int, tuple[DataFrame, str, str | None]] = {}
        atexit.register(self._clean)

    def path(self, label: str) -> str:
        self.n += 1
        return f"{self.base}/{self.n:03d}-{label}"

    def keep(self, df: DataFrame, label: str = "t") -> DataFrame:
        path = self.path(label)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.places[id(out)] = out, path, None
        return out

    def keep_bucketed(self, df: DataFrame, key: str, buckets: int, label: str = "b") -> DataFrame:
        """As ``keep``, dealt by ``key``: later joins and groups by it read the table without a shuffle."""
        name = f"fragweave_{uuid.uuid4().hex[:16]}"
        path = self.path(label)
        df.write.option("compression", "zstd").option("path", path).format("parquet").bucketBy(buckets, key).saveAsTable(name)
        out = self.spark.table(name)
        self.places[id(out)] = out, path, name
        return out

    def ordinals(self, rows: DataFrame, order: list, name: str) -> DataFrame:
        """Adds dense numbers from 0 in the given order, without one task that sorts all rows.

        Rows are dealt by range and written, so that the two readings agree; ranges are counted, and each
        range numbers its rows from where the ranges before it end.
        """
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = self.keep(rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
        before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        starts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
        ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1)
        return ranked.join(starts, "_range").withColumn(name, F.col("_start") + F.col("_rank")).drop("_range", "_start", "_rank")

    def drop(self, df: DataFrame) -> None:
        place = self.places.pop(id(df), None)
        if place:
            self._gone(*place[1:])

    def clear(self) -> None:
        """All tables go now, as no plan reads them any more."""
        self._clean()
        self.places.clear()
        atexit.unregister(self._clean)

    def _gone(self, path: str, name: str | None) -> None:
        if name:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._delete(path)

    def _delete(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def _clean(self) -> None:
        try:
            for _, path, name in self.places.values():
                if name:
                    self._gone(path, name)
            self._delete(self.base)
        except Exception:  # the JVM may be gone already
            pass
