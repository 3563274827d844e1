"""Files of exact names, each written by many tasks at once.

A file's rows are put in order and each row's place in bytes is computed by Spark (``placed``: sizes summed by range, then within
a range). Tasks write their rows at these places, so no task and no driver sees a whole file, and a row is written to the
same place by a second attempt of its task. Writing goes to a hidden folder beside the files; when all tasks are done and every byte is
there, the files are renamed to their names, one by one, each whole. A failed job leaves no file and no folder behind.

Places in a file need a file system that all machines mount (``usable``); elsewhere results are written as folders of parts.
A table without rows gives the files named in ``heads`` alone. Equal rows keep their number. A null value is an empty one; rows without a file are an error.
"""

from __future__ import annotations

import contextlib
import json
import os
import shutil
import uuid
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..scratch import Tables

FORMAT = "fragweave_named"
#: Bytes that a task holds before it writes them.
BUFFER = 8 << 20


def usable(path: str) -> bool:
    return "://" not in path or path.startswith("file://")


def _inside(folder: str, name: str) -> str:
    path = os.path.normpath(os.path.join(folder, name))
    if os.path.isabs(name) or not path.startswith(folder + os.sep):
        raise ValueError(f"not a name below the folder: {name!r}")
    return path


@dataclass
class Written(WriterCommitMessage):
    bytes_of: dict[str, int]


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, heads: dict[str, str]):
        self.folder = os.path.normpath(folder)
        self.hidden = os.path.join(self.folder, f".writing-{uuid.uuid4().hex}")
        self.heads = {name: text.encode() for name, text in heads.items()}
        os.makedirs(self.hidden)  # here alone: a task that outlives its job finds it gone and fails

    def _put(self, name: str, at: int, data: bytes) -> None:
        path = _inside(self.hidden, name)
        below = self.hidden
        for part in os.path.relpath(os.path.dirname(path), self.hidden).split(os.sep):
            below = os.path.normpath(os.path.join(below, part))
            if below != self.hidden:
                with contextlib.suppress(FileExistsError):
                    os.mkdir(below)
        handle = os.open(path, os.O_WRONLY | os.O_CREAT, 0o666)
        try:
            view = memoryview(data)
            while view:
                done = os.pwrite(handle, view, at)
                view, at = view[done:], at + done
            os.fsync(handle)
        finally:
            os.close(handle)

    def write(self, iterator) -> Written:
        total: Counter[str] = Counter()
        name, start, held, size = None, 0, [], 0
        for batch in iterator:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("file", "at", "value")]
            for file, at, value in zip(columns[0].to_pylist(), columns[1].to_pylist(), columns[2], strict=True):
                value = value.as_py() or b""
                if file is None:
                    raise ValueError("a row without a file")
                if file != name or at != start + size or size >= BUFFER:
                    if held:
                        self._put(name, start, b"".join(held))
                    name, start, held, size = file, at, [], 0
                held.append(value)
                size += len(value)
                total[file] += len(value)
        if held:
            self._put(name, start, b"".join(held))
        return Written(dict(total))

    def commit(self, messages) -> None:
        total = Counter({name: len(head) for name, head in self.heads.items()})
        for m in messages:
            if m is not None:
                total.update(m.bytes_of)
        for name, head in self.heads.items():
            self._put(name, 0, head)
        for name, n in total.items():
            there = os.path.getsize(path) if os.path.exists(path := _inside(self.hidden, name)) else -1
            if there != n:
                self._drop()
                raise OSError(f"{name}: {there} bytes where {n} were written; the folder must be one that all machines share")
        for name in total:
            target = _inside(self.folder, name)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            os.replace(_inside(self.hidden, name), target)
        self._drop()

    def _drop(self) -> None:
        """Renamed first, so that no task can add to it any more."""
        with contextlib.suppress(FileNotFoundError):
            os.rename(self.hidden, self.hidden + "-gone")
        shutil.rmtree(self.hidden + "-gone", ignore_errors=True)

    def abort(self, messages) -> None:
        self._drop()


class NamedFiles(DataSource):
    """Sink of (file, at, value): bytes and their place in a file below the folder ``path``; ``heads`` (JSON): first bytes by file."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "file string, at long, value binary"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"].removeprefix("file://"), json.loads(self.options.get("heads", "{}")))


def placed(rows: DataFrame, order: list[str | Column], kept: Tables, heads: dict[str, str] | None = None) -> DataFrame:
    """(file, at, value): where in its file each row's bytes begin, rows in ``order`` within a file, equal ones by value.

    rows: (file, value) and what ``order`` needs. Rows are dealt by range of file and order, so a large file spans many tasks.
    """
    spark: SparkSession = rows.sparkSession
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    names = [f"_key{k}" for k in range(len(keys))]
    own = rows.select("file", F.coalesce(F.col("value").cast("binary"), F.lit(b"")).alias("value"), *[k.alias(n) for k, n in zip(keys, names, strict=True)])
    dealt = own.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "file", *names)
    dealt = kept.keep(dealt.select("*", F.octet_length("value").cast("long").alias("_n"), F.spark_partition_id().alias("_range")), "ranges")
    before = Window.partitionBy("file").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("file", "_range").agg(F.sum("_n").alias("_size")).select("file", "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    if heads:
        first = F.create_map(*[F.lit(x) for name, head in heads.items() for x in (name, len(head.encode()))])
        starts = starts.withColumn("_start", F.col("_start") + F.coalesce(first[F.col("file")], F.lit(0)))
    within = Window.partitionBy("file", "_range").orderBy(*names, "value").rowsBetween(Window.unboundedPreceding, -1)
    inner = dealt.withColumn("_at", F.coalesce(F.sum("_n").over(within), F.lit(0)))
    return inner.join(starts, ["file", "_range"]).select("file", (F.col("_start") + F.col("_at")).alias("at"), "value")


def write(rows: DataFrame, order: list[str | Column], path: str, heads: dict[str, str] | None = None) -> None:
    """rows: (file, value) and what ``order`` needs; ``heads``: files that are there in any case, with their first text."""
    if not usable(path):
        raise ValueError(f"no places in files of {path}")
    spark = rows.sparkSession
    kept = Tables(spark, "named")
    spark.dataSource.register(NamedFiles)
    placed(rows, order, kept, heads).write.format(FORMAT).option("heads", json.dumps(heads or {})).mode("append").save(path)
    kept.clear()
