"""Byte-level BPE by a global distinct-word shuffle, and decoding by the token-byte table.

Texts are split into pre-tokens in blocks of documents. A block keeps the position list of its
pre-tokens as indexes into its own distinct words, and sends only these words on, dealt by hash:
a frequent word travels once for each block, however often it occurs. Each bucket of words encodes
every distinct word once; the ids go back to the blocks, which reassemble their texts by position.
Decoding joins ids with the token-byte table, (id, bytes) as large as the vocabulary: an Arrow column whose row numbers are
the ids, so that the join is one ``take`` for many documents and needs no shuffle.

``encode`` takes (doc_id, text) and returns (doc_id, ids, n_tokens) with ids as little-endian
unsigned 32-bit integers. Null texts count as empty; ids are then empty. Rows are kept one by one,
so repeated or null doc_ids and equal texts stay as they are. A very long text is a block of its own. Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import struct
import zlib
from collections import defaultdict
from itertools import count

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, partitions, tidy
from .tokens import blocks, pieces

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Characters of text in a block. It bounds the memory of a task.
BLOCK_CHARS = 8_000_000


def rank_table(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def token_bytes(ranks: dict[bytes, int]) -> pa.LargeBinaryArray:
    """The token-byte table: the bytes of id k at row k; null for a number that is no id."""
    rows: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, k in ranks.items():
        rows[k] = token
    return pa.array(rows, pa.large_binary())


class Words:
    """Ids of single pre-tokens, by the library's merges; one for each worker and rank file."""

    _loaded: dict[str, Words] = {}

    def __init__(self, path: str):
        import tiktoken

        ranks = rank_table(path)
        self.model = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.token_bytes = token_bytes(ranks)

    @classmethod
    def load(cls, path: str) -> Words:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def ids(self, word: bytes) -> bytes:
        got = self.model.encode_ordinary(word.decode("utf-8"))
        return struct.pack(f"<{len(got)}I", *got)


_split = None


def split(text: str) -> list[str]:
    """Matches of the public pattern."""
    global _split
    got = pieces(text)
    if got is None:
        if _split is None:
            import regex

            _split = regex.compile(PATTERN)
        got = _split.findall(text)
    return got


def pack(values: list[bytes]) -> bytes:
    """Byte strings with their lengths, compressed."""
    lengths = np.fromiter(map(len, values), np.uint32, len(values))
    return zstandard.compress(struct.pack("<I", len(values)) + lengths.tobytes() + b"".join(values), 3)


def unpack(packed: bytes) -> tuple[np.ndarray, bytes]:
    """Lengths, and the strings end to end."""
    raw = zstandard.decompress(packed)
    n = struct.unpack_from("<I", raw)[0]
    return np.frombuffer(raw, np.uint32, n, 4).astype(np.int64), raw[4 + 4 * n :]


def planes(codes: np.ndarray) -> bytes:
    """Integers, compressed byte by byte."""
    return zstandard.compress(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def unplane(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


_BLOCK = "block long, doc_ids array<long>, counts array<int>, codes binary, words array<struct<bucket:int,packed:binary>>"


def _blocks(docs: DataFrame, buckets: int) -> DataFrame:
    def run(batches):
        base, k = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for start, texts in blocks(batch.column(1), BLOCK_CHARS):
                index: dict[str, int] = defaultdict(count().__next__)
                counts, codes = [], []
                for text in texts:
                    words = split(text)
                    counts.append(len(words))
                    codes.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
                own = [w.encode("utf-8") for w in index]
                to = np.fromiter((zlib.crc32(w) % buckets for w in own), np.int32, len(own))
                order = sorted(range(len(own)), key=own.__getitem__)
                order = np.array(order, np.int64)[np.argsort(to[order], kind="stable")] if own else np.zeros(0, np.int64)
                place = np.empty(len(own), np.int32)
                place[order] = np.arange(len(own), dtype=np.int32)
                out, cuts = [], np.searchsorted(to[order], np.arange(buckets + 1))
                for b in np.unique(to).tolist():
                    out.append({"bucket": b, "packed": pack([own[i] for i in order[cuts[b] : cuts[b + 1]].tolist()])})
                flat = np.concatenate(codes)
                yield pa.record_batch(
                    [
                        pa.array([base + k], pa.int64()),
                        pa.array([batch.column(0).slice(start, len(texts)).to_pylist()], pa.list_(pa.int64())),
                        pa.array([counts], pa.list_(pa.int32())),
                        pa.array([planes(place[flat])], pa.binary()),
                        pa.array([out], pa.list_(pa.struct([("bucket", pa.int32()), ("packed", pa.binary())]))),
                    ],
                    names=["block", "doc_ids", "counts", "codes", "words"],
                )
                k += 1
                del index, codes, own, order, place, out, flat
                tidy()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _BLOCK)


def _coded(words: DataFrame, ranks: str) -> DataFrame:
    """words: (bucket, block, packed), a bucket's rows together. Each distinct word of a bucket is encoded once."""

    def run(batches):
        coder, now, known = Words.load(ranks), None, {}
        for batch in batches:
            out = []
            for bucket, packed in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if bucket != now:
                    now, known = bucket, {}
                lengths, raw = unpack(packed.as_py())
                ends = np.cumsum(lengths).tolist()
                own, a = [], 0
                for b in ends:
                    word, a = raw[a:b], b
                    got = known.get(word)
                    if got is None:
                        got = known[word] = coder.ids(word)
                    own.append(got)
                counts = np.fromiter(map(len, own), np.uint32, len(own)) // 4
                counts, flat = planes(counts), planes(np.frombuffer(b"".join(own), np.uint32))
                out.append(struct.pack("<I", len(counts)) + counts + flat)
            yield pa.record_batch([batch.column(1), batch.column(0), pa.array(out, pa.binary())], names=["block", "bucket", "ids"])

    return words.mapInArrow(run, "block long, bucket int, ids binary")


def _counted(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each word of a bucket has, and the ids end to end."""
    n = struct.unpack_from("<I", packed)[0]
    return unplane(packed[4 : 4 + n]).astype(np.int64), unplane(packed[4 + n :])


def _gather(sizes: np.ndarray, flat: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the coded words one after another, and where each word ends."""
    starts, n = np.cumsum(sizes) - sizes, sizes[codes]
    ends = np.cumsum(n)
    at = np.repeat(starts[codes] - (ends - n), n)
    at += np.arange(len(at))
    return flat[at], ends


def _decoded(ids: np.ndarray, ends: list[int], ranks: str) -> list[bytes]:
    """The bytes of ids by the token-byte table, cut where ``ends`` says."""
    got = Words.load(ranks).token_bytes.take(pa.array(ids, pa.uint32()))
    if got.null_count:
        raise ValueError("an id has no bytes")
    _, offsets, data = got.buffers()
    at = np.frombuffer(offsets, np.int64, len(got) + 1)[ends].tolist() if len(got) else [0] * len(ends)
    data = memoryview(data) if data is not None else memoryview(b"")
    return [bytes(data[x:y]) for x, y in zip([0, *at[:-1]], at, strict=True)]


def _join(left, right, decoded_by: str | None):
    """One block: its position lists and the ids of its words; with a rank file also the bytes that the ids stand for."""
    parts = sorted(zip(right["bucket"].to_pylist(), right["ids"].to_pylist(), strict=True))
    got = [_counted(p) for _, p in parts]
    sizes = np.concatenate([np.zeros(0, np.int64), *(g[0] for g in got)])
    words = np.concatenate([np.zeros(0, np.uint32), *(g[1] for g in got)])
    row = {k: left[k][0].as_py() for k in ("doc_ids", "counts", "codes")}
    codes, last = unplane(row["codes"]), np.cumsum(row["counts"])
    out, n_tokens, back, done = [], [], [], 0
    for a in range(0, len(last), 64):  # some documents at a time
        upto = last[min(a + 64, len(last)) - 1]
        flat, ends = _gather(sizes, words, codes[done:upto])
        at = np.concatenate([[0], ends])[last[a : a + 64] - done].tolist()
        for x, y in zip([0, *at[:-1]], at, strict=True):
            out.append(flat[x:y].tobytes())
            n_tokens.append(y - x)
        if decoded_by:
            back += _decoded(flat, at, decoded_by)
        done = upto
    columns = {"doc_id": pa.array(row["doc_ids"], pa.int64()), "ids": pa.array(out, pa.binary()), "n_tokens": pa.array(n_tokens, pa.int64())}
    if decoded_by:
        columns["decoded"] = pa.array(back, pa.binary())
    tidy()
    return pa.table(columns)


def encode(docs: DataFrame, ranks: str = RANKS, scratch: Scratch | None = None, decoded: bool = False) -> DataFrame:
    """(doc_id, ids, n_tokens); with ``decoded`` also what ``decode`` would add, from the same worker."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "bpe")
    n = partitions(spark)
    held = scratch.keep_bucketed(_blocks(docs, 4 * n), "block", n)  # so that the position lists need no shuffle
    words = held.select(F.explode("words").alias("w"), "block").select("w.bucket", "block", "w.packed")
    ids = _coded(words.repartitionById(n, F.col("bucket") % n).sortWithinPartitions("bucket"), ranks)  # four buckets a task
    codes = held.select("block", "doc_ids", "counts", "codes")
    schema = "doc_id long, ids binary, n_tokens long" + ", decoded binary" * decoded
    return codes.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(lambda left, right: _join(left, right, ranks if decoded else None), schema)


def decode(coded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """Adds ``decoded``, the bytes of ``ids`` by the token-byte table; null ids give null, an id that is none an error."""
    names = [c for c in coded.columns if c != "decoded"]
    coded = coded.select(*names)
    at = names.index("ids")

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids = [x or b"" for x in part.column(at).to_pylist()]
                out = pa.array(_decoded(np.frombuffer(b"".join(ids), np.uint32), np.cumsum([len(x) // 4 for x in ids]).tolist(), ranks), pa.binary())
                yield pa.record_batch([*part.columns, pc.if_else(part.column(at).is_valid(), out, None)], names=[*names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema.fields)
    return coded.mapInArrow(run, f"{schema}, decoded binary")


def query(spark: SparkSession, docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """Whole texts encoded and decoded again, as digests."""
    return encode(docs, ranks, decoded=True).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
