"""Vector codes by a product quantizer in whole numbers: vectors are cut into parts, each part becomes the index of its codebook's nearest entry.

Components are floor(scale * x). A round assigns every part and replaces each entry by the floored mean of its parts; tasks send sums for each entry,
so what meets is tasks x entries, and the driver holds the codebooks alone.

The nearest entry is found by bounds from coarse to fine. For a block of a vector and of an entry with sums s, s' of n components and norms r, r' of
what is left beside the mean, (s - s')^2 / n + (r - r')^2 is no more than their squared distance. The entry of the least bound over the whole part gives a
distance that is reached; entries whose bound is above it leave, first by whole parts, then by halves, then by quarters. Bounds are doubles with room for rounding,
so no entry leaves wrongly; those that stay get exact distances in whole numbers, and ties go to the lower index.

Vectors that are null or hold null or non-finite components take no part. Shorter vectors, empty ones too, count as if zeros followed, up to the longest or
the next multiple of the parts. First entries are the vectors of the smallest ids, nulls last, ties by their components; of fewer vectors than entries,
codebooks have so many. Components beyond 2^27 are worked on in Python's integers, exactly; an error beyond 64 bits is null, and so is its label's.
Rows with a null id, repeated ids and repeated rows are vectors like others. Null labels are one group, NaN another. An empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096.0
#: Components up to which squared distances of any usual part stay within 64 bits.
SAFE = 1 << 27
#: Blocks of a part at each level of bounds, and vectors that are worked on at a time.
LEVELS, STEP = (1, 2, 4), 4096
#: Labels up to which their table is broadcast.
LABELS = 100_000
#: Bits of a digit in which sums travel, so that no sum of sums overflows.
DIGIT = 32
_LONG = (1 << 63) - 1


def usable(vectors: DataFrame, id_col: str, vector: str, label: str) -> DataFrame:
    """(id, label, v): vectors without nulls and non-finite components, as doubles."""

    def unfit(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("v")).filter("v IS NOT NULL")
    return rows.filter(~F.exists("v", unfit)).select("id", "label", F.transform("v", lambda x: x.cast("double")).alias("v"))


def integers(column, dims: int, scale: float = SCALE) -> np.ndarray:
    """Rows of whole numbers: int64 if all are safe, else Python's integers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten(), float)
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    x = np.zeros((len(column), dims))
    lengths = np.diff(ends, prepend=0)
    x[np.repeat(np.arange(len(column)), lengths), np.arange(len(flat)) - np.repeat(ends - lengths, lengths)] = flat
    if not len(x) or np.abs(x).max() * scale < SAFE:
        return np.floor(x * scale).astype(np.int64)
    whole = np.frompyfunc(lambda v: (n := v.as_integer_ratio())[0] * int(scale) // n[1], 1, 1)
    return whole(x)


def _blocks(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sums, norms beside the mean, sizes) of each row's n blocks."""
    sums, norms, sizes = [], [], []
    for part in np.array_split(x, n, axis=1):
        s = part.sum(axis=1).astype(float)
        sums.append(s)
        norms.append(np.sqrt(((part - (s / part.shape[1])[:, None]) ** 2).sum(axis=1)))
        sizes.append(part.shape[1])
    return np.array(sums).T, np.array(norms).T, np.array(sizes, float)


def nearest(x: np.ndarray, entries: np.ndarray, exact: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each row's nearest entry. ``exact`` gets how many distances were formed."""
    n, k = len(x), len(entries)
    if x.dtype == object or entries.dtype == object:
        d = np.array([[((row - e) ** 2).sum() for e in entries.astype(object)] for row in x.astype(object)], dtype=object).reshape(n, k)
        at = np.array([min(range(k), key=lambda j: row[j]) for row in d], np.int64)
        return at, d[np.arange(n), at] if n else np.zeros(0, object)
    room = 1e-12 * float(max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0), 1)) ** 2
    rows = cols = limit = None
    for level in [b for b in LEVELS if b <= x.shape[1]]:
        (s, r, size), (t, q, _) = _blocks(x, level), _blocks(entries, level)
        if rows is None:
            low = (s - t.T) ** 2 / size[0] + (r - q.T) ** 2  # one block: rows against entries
            guess = low.argmin(axis=1)
            limit = ((x - entries[guess]) ** 2).sum(axis=1)
            rows, cols = np.nonzero(low <= (limit * (1 + 1e-9) + room)[:, None])
        else:
            low = ((s[rows] - t[cols]) ** 2 / size + (r[rows] - q[cols]) ** 2).sum(axis=1)
            stay = low <= limit[rows] * (1 + 1e-9) + room
            rows, cols = rows[stay], cols[stay]
    d = np.full((n, k), _LONG)
    d[rows, cols] = ((x[rows] - entries[cols]) ** 2).sum(axis=1)
    if exact is not None:
        exact.append(len(rows) + n)
    at = d.argmin(axis=1)
    return at, d[np.arange(n), at]


@dataclass
class Codebooks:
    """books: by part, entries of whole numbers."""

    books: list[np.ndarray]
    dims: int
    scale: float = SCALE

    @property
    def width(self) -> int:
        return self.dims // len(self.books)

    def parts(self, batch_column) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first row, part, whole numbers) of slices of a batch."""
        for a in range(0, len(batch_column), STEP):
            x = integers(batch_column.slice(a, STEP), self.dims, self.scale)
            for p in range(len(self.books)):
                yield a, p, x[:, p * self.width : (p + 1) * self.width]

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(c)) for book in self.books for entry in book for c in entry).encode()).hexdigest()


def _book(rows: list[list[int]]) -> np.ndarray:
    out = np.array(rows, dtype=object)
    return out.astype(np.int64) if all(abs(c) < SAFE for row in rows for c in row) else out


def begin(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, scale: float = SCALE) -> Codebooks | None:
    """The first vectors' parts; None if there are no vectors."""
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return None
    dims = max(1, -(-longest // parts)) * parts
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").toArrow()
    x = integers(first.column("v"), dims, scale)
    width = dims // parts
    return Codebooks([_book(x[:, p * width : (p + 1) * width].tolist()) for p in range(parts)], dims, scale)


def improve(rows: DataFrame, old: Codebooks) -> Codebooks:
    """One round: entries become the floored means of the parts that are nearest to them; unused ones stay."""

    def run(batches):
        sums: dict[tuple[int, int], list] = {}
        for batch in batches:
            for _, p, x in old.parts(batch.column(0)):
                at, _ = nearest(x, old.books[p])
                order = np.argsort(at, kind="stable")
                used, starts = np.unique(at[order], return_index=True)
                # safe components: a slice's sums are far below 64 bits
                for e, s, n in zip(used.tolist(), np.add.reduceat(x[order], starts, axis=0).tolist(), np.diff([*starts, len(at)]).tolist(), strict=True):
                    held = sums.setdefault((p, e), [[0] * old.width, 0])
                    held[0], held[1] = [a + b for a, b in zip(held[0], s, strict=True)], held[1] + n
        out = []
        for (p, e), (total, n) in sums.items():
            out.append((p, e, -1, 0, n))
            for c, value in enumerate(total):
                digit = 0
                while True:
                    last = -(1 << DIGIT) <= value < 1 << DIGIT
                    out.append((p, e, c, digit, value if last else value & ((1 << DIGIT) - 1)))
                    if last:
                        break
                    value, digit = value >> DIGIT, digit + 1
        columns = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.record_batch([pa.array(c, pa.int32()) for c in columns[:4]] + [pa.array(columns[4], pa.int64())], names=["part", "entry", "place", "digit", "n"])

    met = rows.select("v").mapInArrow(run, "part int, entry int, place int, digit int, n long").groupBy("part", "entry", "place", "digit").agg(F.sum("n").alias("n"))
    total: dict[tuple[int, int, int], int] = {}
    for r in met.collect():  # entries x components x digits at most
        at = r["part"], r["entry"], r["place"]
        total[at] = total.get(at, 0) + (r["n"] << (DIGIT * r["digit"]))
    books = []
    for p, book in enumerate(old.books):
        counts = [total.get((p, e, -1), 0) for e in range(len(book))]
        books.append(_book([[total[p, e, c] // counts[e] if counts[e] else v for c, v in enumerate(entry)] for e, entry in enumerate(book.tolist())]))
    return Codebooks(books, old.dims, old.scale)


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(id, label, code, error): a byte for each part, and the squared distances summed."""
    kind = rows.schema["label"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            codes = np.zeros((batch.num_rows, len(books.books)), np.uint8)
            errors = np.zeros(batch.num_rows, object)
            for a, p, x in books.parts(batch.column(2)):
                at, d = nearest(x, books.books[p])
                codes[a : a + len(x), p] = at
                errors[a : a + len(x)] += d.astype(object)
            told = [None if e > _LONG else int(e) for e in errors]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(told, pa.int64())], names=["id", "label", "code", "error"])

    return rows.select("id", "label", "v").mapInArrow(run, f"id long, label {kind}, code binary, error long")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE, scratch: Scratch | None = None) -> tuple[DataFrame, Codebooks | None]:
    """(id, label, code, error), one row for each usable vector, and the codebooks. All vectors take part in every round."""
    if not 0 < entries <= 256:
        raise ValueError("1 to 256 entries")
    scratch = scratch or Scratch(vectors.sparkSession, "codes")
    rows = usable(vectors, id_col, vector, label)
    books = begin(rows, parts, entries, scale)
    if books is None:
        return rows.select("id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")), None
    for _ in range(rounds):
        books = improve(rows, books)
    return scratch.keep(encode(rows, books), "codes"), books


def query(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    scratch = Scratch(spark, "codes")
    rows, books = compress(vectors, scratch=scratch)
    # an error that is beyond 64 bits makes its label's so
    exact = F.sum(F.col("error").cast("decimal(38,0)"))
    fits = (F.count("error") == F.count(F.lit(1))) & (exact <= F.lit(_LONG).cast("decimal(38,0)"))
    per = scratch.keep(rows.groupBy(F.col("label").alias("_label")).agg(F.when(fits, exact).cast("long").alias("label_error")), "labels")
    per = F.broadcast(per) if per.limit(LABELS + 1).count() <= LABELS else per
    out = rows.join(per, F.col("label").eqNullSafe(F.col("_label")))
    return out.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.digest() if books else "").alias("codebooks_sha256"))


def codes_sql(table: str, dims: int = 64, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """DuckDB SQL for ``query`` on vectors of ``dims`` components: every distance of every round."""
    w = dims // parts
    dist = " + ".join(f"(x[{i}] - c[{i}]) * (x[{i}] - c[{i}])" for i in range(1, w + 1))
    steps = [f"b0 AS MATERIALIZED (SELECT p, e, x AS c FROM x JOIN (SELECT id, row_number() OVER (ORDER BY id) - 1 AS e FROM k ORDER BY id LIMIT {entries}) USING (id))"]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT id, p, min(struct_pack(d := {dist}, e := e)) AS m, any_value(x) AS x FROM x JOIN b{r} USING (p) GROUP BY id, p)")
        if r < rounds:
            mean = ", ".join(f"((sum(x[{i}]) - ((sum(x[{i}]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT" for i in range(1, w + 1))
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(n.c, b{r}.c) AS c FROM b{r} LEFT JOIN (SELECT p, m.e AS e, [{mean}] AS c FROM a{r} GROUP BY p, m.e) n USING (p, e))")
    body = ",\n".join(steps)
    return f"""
WITH k AS MATERIALIZED (
  SELECT vec_id AS id, label, list_transform(embedding, lambda v: floor(4096 * v::DOUBLE)::BIGINT) AS v FROM {table}
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
), x AS MATERIALIZED (SELECT id, p, v[p * {w} + 1:p * {w} + {w}] AS x FROM k CROSS JOIN (SELECT range AS p FROM range({parts})) q),
{body},
o AS (SELECT id, string_agg(lpad(lower(to_hex(m.e)), 2, '0'), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} GROUP BY id),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM b{rounds})
SELECT id AS vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM o JOIN k USING (id) CROSS JOIN h
"""
