"""Token ids in ORC: integer run-length encoding, row indexes and Bloom filters on document ids.

``write`` encodes texts and lays the ids out in ascending ``doc_id`` order, one ORC file for each
range of ids. ``read`` gives rows back; a filter on ``doc_id`` reaches the ORC reader, which skips
stripes and row groups by their statistics and Bloom filters. Spark splits a file by its stripes, so
stripes are read in parallel.

Rows with a null ``doc_id`` come first; rows with one ``doc_id`` are in the order of a hash of their texts, and ranges cut
between them, so that a hot or null id spans many files. A null text counts as empty: its document is the end id alone.
A very long text is one row; stripes end where their size says so, so it does not make its neighbours' stripe larger.
Extra columns are ignored; an empty table gives files without rows, or none.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from itertools import count, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, partitions

END = 0
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

#: The public splitting pattern, in terms of the standard library; for texts of _SAFE characters only.
_SPLIT = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ÿŠšŒœŽžŸƒªµº]+|\s+(?!\S)|\s+")
#: Of code page 1252: line ends, tab, printable characters without odd spaces, circumflexes and number forms.
_SAFE = b"\t\n\r" + bytes(range(0x20, 0x7F)) + "ŠšŒœŽž–—‘’“”…€¡«»¿".encode("cp1252") + bytes([*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])


def pieces(text: str) -> list[str] | None:
    """The pre-tokens of a text; None if it has characters for which only the library's own split counts."""
    try:
        if text.encode("cp1252").translate(None, _SAFE):
            return None
    except UnicodeEncodeError:
        return None
    return _SPLIT.findall(text)


class Encoder:
    """The tokenizers library, asked once for each distinct pre-token; a worker keeps what it has asked.

    Words are numbered as they come; ids of word n are ``flat[starts[n]:starts[n + 1]]``.
    """

    KEPT = 1_500_000
    _loaded: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        # a token's letters stand for its bytes, one each
        self.bytes_of = np.zeros(self.model.get_vocab_size(), np.int64)
        for token, k in self.model.get_vocab().items():
            self.bytes_of[k] = len(token)
        self.forget()

    @classmethod
    def load(cls, path: str) -> Encoder:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def forget(self) -> None:
        self.number: dict[str, int] = defaultdict(count().__next__)
        self.starts, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self) -> None:
        """Ids of the words numbered since last time. Letters after one space stay a pre-token when glued: one call for many."""
        new = list(islice(reversed(self.number), len(self.number) - len(self.starts) + 1))[::-1]
        got: list[np.ndarray | None] = [None] * len(new)
        glued = [k for k, w in enumerate(new) if w[0] == " " and w[1:].isalpha()]
        groups = [glued[a : a + 1000] for a in range(0, len(glued), 1000)]
        for a in range(0, len(groups), 20):
            texts = ["".join([new[k] for k in g]) for g in groups[a : a + 20]]
            for g, code in zip(groups[a : a + 20], self.model.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = np.array(code.ids, np.uint32)
                ends = np.cumsum([len(new[k].encode("utf-8")) for k in g])
                cuts = np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 1
                for k, x, y in zip(g, [0, *cuts.tolist()], cuts.tolist(), strict=False):
                    got[k] = ids[x:y]
        got = [self.whole(w) if x is None else x for w, x in zip(new, got, strict=True)]
        if got:
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.fromiter(map(len, got), np.int64, len(got)))])
            self.flat = np.concatenate([self.flat, *got])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.number) > self.KEPT:
            self.forget()
        number, codes = self.number.__getitem__, []
        for t in texts:
            words = None if any(s in t for s in self.special) else pieces(t)
            codes.append(None if words is None else np.fromiter(map(number, words), np.int64, len(words)))
        self._learn()
        out = []
        for t, c in zip(texts, codes, strict=True):
            if c is None:
                out.append(self.whole(t))
                continue
            n = self.starts[c + 1] - self.starts[c]
            ends = np.cumsum(n)
            at = np.repeat(self.starts[c] - ends + n, n)
            at += np.arange(len(at))
            out.append(self.flat[at])
        return out


def blocks(column: pa.Array, chars: int = 2_000_000):
    """Slices of a string column, each of about so many bytes, as (offset, texts); null becomes empty."""
    start, held, size = 0, [], 0
    for k, text in enumerate(column):
        text = text.as_py() or ""
        held.append(text)
        size += len(text)
        if size >= chars:
            yield start, held
            start, held, size = k + 1, [], 0
    if held:
        yield start, held


_SCHEMA = "doc_id long, part int, part_start long, n_tokens int, ids array<int>"


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """Rows of the file format, in the order and the partitions of ``docs``."""
    arrow = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("part_start", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.list_(pa.int32()))])
    tail = np.array([end], np.uint32)

    def run(batches):
        coder, part, at = Encoder.load(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            for start, texts in blocks(batch.column(1)):
                coded = coder.encode(texts)
                counts = np.array([len(c) + 1 for c in coded], np.int64)
                ends = np.cumsum(counts)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.concatenate([x for c in coded for x in (c, tail)]).view(np.int32)))
                n = len(texts)
                yield pa.record_batch([batch.column(0).slice(start, n), pa.array(np.full(n, part, np.int32)), pa.array(at + ends - counts), pa.array(counts.astype(np.int32)), ids], schema=arrow)
                at += int(ends[-1])

    return docs.mapInArrow(run, _SCHEMA)


def write(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end: int = END, stripe_bytes: int = 64 << 20, row_group: int = 1000, false_positives: float = 0.01) -> None:
    """Encodes ``docs`` (doc_id, text) into ORC files at ``path``, in ascending doc_id order over all files."""
    n = partitions(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = own.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.monotonically_increasing_id())
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    (
        encode(ordered, vocabulary, end)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", str(false_positives))
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(row_group))
        .option("orc.stripe.size", str(stripe_bytes))
        .option("orc.rows.between.memory.checks", "1")  # a stripe's size is looked at after each batch, whatever the texts' lengths
        .option("orc.dictionary.key.threshold", "0")
        .option("compression", "snappy")
        .option("maxRecordsPerFile", "0")
        .orc(path)
    )


def read(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The rows of ``write``'s files; with ``doc_ids`` only these documents, by pushed-down filter."""
    rows = spark.read.schema(_SCHEMA).orc(path)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin([int(x) for x in doc_ids]))


def digest(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start (ids before the document), n_tokens and ids_crc32."""
    rows = read(spark, path)
    sizes = rows.groupBy("part").agg(F.max(F.col("part_start") + F.col("n_tokens")).alias("size"))
    # one row for each file: bounded by the number of files
    size = {r["part"]: r["size"] for r in sizes.collect()}
    offset, total = {}, 0
    for part in sorted(size):
        offset[part] = total
        total += size[part]

    def run(batches):
        for batch in batches:
            column = batch.column(4)
            ends, flat = column.offsets.to_numpy(), memoryview(column.values.to_numpy(zero_copy_only=True)).cast("B")
            crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            start = [offset[p] + s for p, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(start, pa.int64()), batch.column(3).cast(pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    path = Scratch(spark, "tokens").path("orc")
    write(docs, path, vocabulary)
    return digest(spark, path)
