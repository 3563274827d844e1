"""Records of FASTA, hit and path files by ranges of bytes: ``spark.read.format("fragweave_records")``.

Files are cut into ranges; a task yields the records that begin in its range and reads on to the end of the last, so a large file is read by many tasks and
a record is read once wherever it ends. Each record carries its file, its range's start (``block``) and its own first byte (``at``): its order, without a count.
Filters on ``file`` leave out files before any task starts. Filters on other scalar columns are applied where a record is parsed, so what they drop never
leaves the Python worker. Spark hands filters over where ``spark.sql.python.filterPushdown.enabled`` is true; ``scan`` asks the session. Elsewhere Spark filters afterwards.

Kinds: ``fasta`` (record_id, description, seq, length), ``hits`` (target, marker, qlen, hmm_from, hmm_to), ``paths`` (header, parts). Files are those of a
file system that all machines mount (``named.usable``); a ``.gz`` file is one range. Empty files, blank lines, comment lines of hits and records of spaces alone give no rows;
names that start with a dot or an underscore are skipped in folders; bytes that are no UTF-8 become U+FFFD. A hit line with fewer than 17 words or a
number that is none is an error that names its file and byte.
"""

from __future__ import annotations

import glob
import gzip
import json
import operator
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith

from . import named

FORMAT = "fragweave_records"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Bytes read at a time; rows and bytes of a batch.
CHUNK, ROWS, BYTES = 4 << 20, 2000, 8 << 20
BLANK = b" \t\n\x0b\x0c\r"
#: Suffixes of codecs that are not read here.
CODECS = (".bz2", ".zst", ".lz4", ".snappy", ".deflate", ".xz")

_PLACE = "file string, block long, at long, "
SCHEMA = {
    "fasta": _PLACE + "record_id string, description string, seq string, length long",
    "hits": _PLACE + "target string, marker string, qlen int, hmm_from int, hmm_to int",
    "paths": _PLACE + "header string, parts array<string>",
}
MARK = {"fasta": b">", "hits": b"", "paths": b"NODE_"}
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}


def pieces(path: str, start: int, end: int | None, mark: bytes) -> Iterator[tuple[int, bytes]]:
    """(first byte, bytes) of the records that begin in [start, end): at the file's start and wherever a line starts with the mark."""
    separator = b"\n" + mark
    with (gzip.open if path.endswith(".gz") else open)(path, "rb") as file:
        # the line end before a range's first byte belongs to the range before
        base = max(start - 1, 0)
        file.seek(base)
        held, look, begin = bytearray(), 0, None if start else 0
        while True:
            found = held.find(separator, look)
            if found >= 0:
                if begin is not None:
                    yield base + begin, bytes(held[begin:found])
                begin = look = found + 1
                if end is not None and base + begin >= end:
                    return
                continue
            more = file.read(CHUNK)
            if not more:
                break
            # a separator may lie across two reads
            look = max(look, len(held) - len(mark))
            gone = look if begin is None else begin
            del held[:gone]
            held += more
            base, look, begin = base + gone, look - gone, None if begin is None else 0
        if begin is not None:
            yield base + begin, bytes(held[begin:])


def _text(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def _fasta(at: int, piece: bytes) -> tuple | None:
    head, *rest = re.split(rb"\r?\n", piece, maxsplit=1)
    head = _text(head.removeprefix(b">").strip(b" "))
    seq = _text(rest[0].translate(None, BLANK)) if rest else ""
    return re.split(r"[ \t\n\x0b\x0c\r]+", head, maxsplit=1)[0], head, seq, len(seq)


def _hit(at: int, piece: bytes) -> tuple | None:
    if piece.startswith(b"#"):
        return None
    words = re.split(rb"[ \t\n\x0b\x0c\r]+", piece.strip(b" "))
    if len(words) < 17:
        raise ValueError("fewer than 17 words")
    return _text(words[0]), _text(words[3]), int(words[5]), int(words[15]), int(words[16])


def _path(at: int, piece: bytes) -> tuple | None:
    header, *parts = re.split(r"\r?\n", "NODE_" + _text(piece.removeprefix(b"NODE_").rstrip(BLANK)))
    # only what stands before a blank line counts
    return header.strip(" "), parts[: parts.index("")] if "" in parts else parts


PARSE = {"fasta": _fasta, "hits": _hit, "paths": _path}

_COMPARE = {EqualTo: operator.eq, EqualNullSafe: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}
_STRING = {StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: str.__contains__}


def holds(f, value) -> bool:
    """Whether a value, which is never null, passes a filter."""
    if isinstance(f, Not):
        return not holds(f.child, value)
    if isinstance(f, IsNotNull):
        return True
    if isinstance(f, In):
        return value in f.value
    if type(f) in _STRING:
        return _STRING[type(f)](value, f.value)
    return _COMPARE[type(f)](value, f.value)


def _column(f) -> str | None:
    """The one column of a filter that is applied here, else none. What compares with null is left to Spark."""
    if isinstance(f, Not):
        return _column(f.child)
    values = f.value if isinstance(f, In) else () if isinstance(f, IsNotNull) else (getattr(f, "value", None),)
    known = isinstance(f, (In, IsNotNull)) or type(f) in _COMPARE or type(f) in _STRING
    return f.attribute[0] if known and len(f.attribute) == 1 and all(v is not None for v in values) else None


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int | None


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], kind: str, step: int):
        self.paths, self.kind, self.step = paths, kind, step
        self.fields = [tuple(c.rsplit(" ", 1)) for c in SCHEMA[kind].split(", ")]
        self.filters: list[tuple[str, object]] = []

    def files(self) -> list[str]:
        out: list[str] = []
        for path in self.paths:
            path = os.path.abspath(path.removeprefix("file://"))
            found = sorted(glob.glob(path, recursive=True)) if glob.has_magic(path) else [path]
            for one in found:
                if not os.path.isdir(one):
                    out.append(one)
                    continue
                for folder, below, names in os.walk(one):
                    below[:] = sorted(d for d in below if d[0] not in "._")
                    out += [os.path.join(folder, n) for n in sorted(names) if n[0] not in "._"]
        for one in out:
            if one.endswith(CODECS):
                raise ValueError(f"a codec that is not read by ranges: {one}")
        own = [f for name, f in self.filters if name == "file"]
        return [one for one in dict.fromkeys(out) if all(holds(f, one) for f in own)]

    def partitions(self) -> list[Range]:
        out = []
        for path in self.files():
            size = os.path.getsize(path)
            if path.endswith(".gz"):
                out.append(Range(path, 0, None))
            else:
                out += [Range(path, a, min(a + self.step, size)) for a in range(0, size, self.step)]
        return out

    def read(self, partition: Range):
        # a table without files is one empty partition
        if partition is None:
            return
        names = [n for n, _ in self.fields]
        schema = pa.schema([(n, _ARROW[t]) for n, t in self.fields])
        tests = [(names.index(name) - 3, f) for name, f in self.filters if name in names[3:]]
        before = [(names.index(name), f) for name, f in self.filters if name in names[1:3]]
        mark, parse = MARK[self.kind], PARSE[self.kind]
        rows, held = [], 0
        for at, piece in pieces(partition.path, partition.start, partition.end, mark):
            place = partition.path, partition.start, at
            if not (piece[len(mark) :] if at else piece).rstrip(b"\r").strip(b" ") or not all(holds(f, place[k]) for k, f in before):
                continue
            try:
                row = parse(at, piece.rstrip(b"\r"))
            except ValueError as e:
                raise ValueError(f"{partition.path}, byte {at}: {e}") from e
            if row is None or not all(holds(f, row[k]) for k, f in tests):
                continue
            rows.append(place + row)
            held += len(piece)
            if len(rows) >= ROWS or held >= BYTES:
                yield self._batch(rows, schema)
                rows, held = [], 0
        if rows:
            yield self._batch(rows, schema)

    @staticmethod
    def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


class _Pushing(_Reader):
    def pushFilters(self, filters):  # noqa: N802
        scalar = {name for name, kind in self.fields if kind != "array<string>"}
        for f in filters:
            name = _column(f)
            if name in scalar:
                self.filters.append((name, f))
            else:
                yield f


class Records(DataSource):
    """Options: ``path`` or ``files`` (JSON list), ``kind``, ``rangebytes``, ``push`` (true where the session hands filters over)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA[self._kind()]

    def _kind(self) -> str:
        kind = self.options.get("kind", "fasta")
        if kind not in SCHEMA:
            raise ValueError(f"kind: one of {', '.join(SCHEMA)}")
        return kind

    def reader(self, schema) -> _Reader:
        paths = json.loads(self.options["files"]) if "files" in self.options else [self.options["path"]]
        make = _Pushing if self.options.get("push", "false").lower() == "true" else _Reader
        return make(paths, self._kind(), max(1, int(self.options.get("rangebytes", 128 << 20))))


def scan(spark: SparkSession, path, kind: str) -> DataFrame:
    """Records of a file, folder or pattern, or of a list of them; ranges are as large as the session's file partitions."""
    paths = [path] if isinstance(path, str) else list(path)
    for one in paths:
        if not named.usable(one):
            raise ValueError(f"no ranges in files of {one}")
    spark.dataSource.register(Records)
    step = str(spark.conf.get("spark.sql.files.maxPartitionBytes")).lower().removesuffix("b")
    unit = {"k": 10, "m": 20, "g": 30}.get(step[-1:])
    step = int(step[:-1]) << unit if unit else int(step)
    reader = spark.read.format(FORMAT).option("kind", kind).option("files", json.dumps(paths)).option("rangebytes", str(step))
    return reader.option("push", str(spark.conf.get(PUSHDOWN, "false")).lower()).load()
