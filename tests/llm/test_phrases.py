"""Phrase fingerprints against a plain parse."""

import hashlib

import pytest
import xxhash
from fragweave.llm import phrases
from fragweave.llm.common import read


def plain(text):
    known, piece, out = set(), "", []
    for c in text:
        piece += c
        if piece not in known:
            known.add(piece)
            out.append(piece)
            piece = ""
    return out + ([piece] if piece else [])


def spans(text):
    known, ends = set(), []
    rest = phrases.parse(text, known, ends)
    cut = [*ends, *([len(text)] if rest < len(text) else [])]
    return [text[a:b] for a, b in zip([0, *cut[:-1]], cut, strict=False)], ends, rest


@pytest.mark.parametrize("text", ["", "a", "aaaaaaa", "abababab😀é", "the cat sat on the mat " * 3000, "x" * 40000])
def test_parse_and_hashes(text):
    got, ends, rest = spans(text)
    assert got == plain(text)
    hashes = phrases.phrase_hashes(text, ends, rest)
    of = {}
    for p, h in zip(got, hashes.tolist(), strict=True):
        assert of.setdefault(p, h) == h
    assert len(set(of.values())) == len(of)
    for other in ("zz" + text, text + "q"):
        g, e, r = spans(other)
        for p, h in zip(g, phrases.phrase_hashes(other, e, r).tolist(), strict=True):
            assert of.get(p, h) == h


MASK = (1 << 64) - 1


def mixed(x):
    """The public 64-bit finaliser."""
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def own_fingerprint(text):
    """By the definition: phrases of the plain parse, each a polynomial of its code points, the 64 smallest of 32 bits."""
    found = set()
    for p in set(plain(text)):
        h = sum((ord(c) + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, c in enumerate(p))
        found.add(mixed((h + len(p) * 0xD6E8FEB86659FD93) & MASK) >> 32)
    return sorted(found)[:64]


def own_likeness(a, b):
    if not a or not b:
        return float(a == b)
    union = sorted({*a, *b})[:64]
    return sum(x in a and x in b for x in union) / len(union)


def spelled(a):
    return "".join(f"{x:08x}" for x in a)


def in_order(rows):
    """Descending doc_id, null last; equal ids by the engine's own hash of the text."""

    def place(r):
        h = xxhash.xxh64_intdigest((r[1] or "").encode(), 42)
        return r[0] is None, -(r[0] or 0), h - (1 << 64) if h >> 63 else h

    return sorted(((i, t or "") for i, t in rows), key=place)


def expected(rows):
    order, out = in_order(rows), []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        changed = t[: len(t) - half] + after[:half]
        a, b, c = (own_fingerprint(x) for x in (t, changed, after))
        out.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), spelled(a), spelled(b), own_likeness(a, b), own_likeness(a, c)))
    return sorted(out, key=str)


def test_neighbours(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in read(spark, sf, "documents").collect()]
    rows += [(5000, None), (5001, ""), (5001, ""), (5002, "ab😀" * 9000), (5003, "b"), (5003, "a"), (None, "null id"), (-4, rows[3][1]), (-5, rows[3][1])]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, p int, guest int").repartition(5)
    got = phrases.compare_neighbours(docs).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)
    assert sum(r["near_edited"] for r in got) > sum(r["near_next"] for r in got)
    one = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    assert [r["near_next"] for r in phrases.compare_neighbours(one).collect()] == [1.0]
    assert phrases.compare_neighbours(one.limit(0)).count() == 0


def test_a_hot_id_spans_ranges(spark):
    rows = [(None, f"text {k} of many") for k in range(60)] + [(7, f"other {k}") for k in range(60)] + [(None, None)] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, phrases.compare_neighbours(docs).collect()), key=str) == expected(rows)
    placed, heads = phrases._placed(phrases.Scratch(spark, "t"), docs.selectExpr("doc_id", "coalesce(text, '') AS text"), 8)
    most = placed.groupBy("p").count().selectExpr("max(count)").first()[0]
    assert len(heads) >= 6 and most <= 60


def test_likeness():
    a, b = phrases.fingerprint("abc abc abd"), phrases.fingerprint("")
    assert phrases.likeness(a, a) == phrases.likeness(b, b) == 1 and phrases.likeness(a, b) == 0
