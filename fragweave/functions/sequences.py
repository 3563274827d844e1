"""Sequences and k-mers."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

K = 4


def reverse_complement(seq: Column) -> Column:
    """Characters other than A, C, G, T stay as they are."""
    return F.translate(F.reverse(seq), "ACGT", "TGCA")


def sanitize(seq: Column) -> Column:
    """Upper case, bases only."""
    return F.regexp_replace(F.upper(seq), "[^GATC]+", "")


def as_bases(seq: Column) -> Column:
    """What k-mer counting sees: any character that is no upper-case base counts as A."""
    return F.regexp_replace(seq, "[^ACGT]", "A")


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(kmer, reverse_complement(kmer))


def positions(seq: Column, k: int = K) -> Column:
    """Where a k-mer starts, from 1; none if the sequence is shorter than k."""
    n = F.length(seq) - F.lit(k - 1)
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def kmer_at(forward: Column, backward: Column, position: Column, k: int = K) -> Column:
    """The canonical k-mer at a position, from the bytes of a sequence and of its reverse complement.

    Bytes are cut in place, where a string would be walked from its start.
    """
    turned = F.octet_length(forward) - position - F.lit(k - 2)
    return F.least(F.substr(forward, position, F.lit(k)), F.substr(backward, turned, F.lit(k)))


def canonical_index(k: int = K) -> list[str]:
    """All canonical k-mers in lexicographic order; a k-mer's slot is its place here."""
    swap = str.maketrans("ACGT", "TGCA")
    every = ("".join(p) for p in product("ACGT", repeat=k))
    return sorted({min(m, m.translate(swap)[::-1]) for m in every})


def reversed_segment(segment: Column, style: str) -> Column:
    """The same segment read the other way. ``suffix``: 12+ and 12-; ``prefix``: 12 and -12."""
    if style == "suffix":
        turned = F.when(F.endswith(segment, F.lit("+")), F.lit("-")).otherwise(F.lit("+"))
        return F.concat(F.left(segment, F.length(segment) - 1), turned)
    return F.when(F.startswith(segment, F.lit("-")), F.substr(segment, F.lit(2))).otherwise(F.concat(F.lit("-"), segment))


def contig_of_gene(gene: Column, fields: int = 3) -> Column:
    """A gene name without its last fields (start, end, strand); with fewer fields, nothing is left."""
    parts = F.split(gene, "_")
    return F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - fields, F.lit(0))), "_")


def number_in(name: Column, pattern: str = r"NODE_(.*)_length_") -> Column:
    """The first group of the pattern as a number."""
    return F.regexp_extract(name, pattern, 1).try_cast("bigint")


def wrapped(seq: Column, width: int = 60) -> Column:
    """Lines of a fixed width."""
    return F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), "\n$", "")
