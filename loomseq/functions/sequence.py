"""Columns over sequences of bases and over alignment strings, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(s: Column) -> Column:
    """A, C, G, T exchanged and the order turned; any other character becomes N."""
    return F.regexp_replace(F.reverse(F.translate(F.upper(s), "ACGT", "TGCA")), "[^ACGTN]", "N")


def _count(s: Column, base: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(base), F.lit("")))


def gc_fraction(s: Column) -> Column:
    """G and C over the length; 0 for an empty sequence."""
    return F.when(F.length(s) > 0, (_count(s, "G") + _count(s, "C")) / F.length(s)).otherwise(0.0)


def entropy(s: Column) -> Column:
    """Base-2 entropy over A, C, G and T."""
    n = [_count(s, b) for b in "ACGT"]
    total = n[0] + n[1] + n[2] + n[3]
    parts = [F.when(c > 0, -(c / total) * F.log2(c / total)).otherwise(0.0) for c in n]
    return parts[0] + parts[1] + parts[2] + parts[3]


def longest_run(s: Column) -> Column:
    """Length of the longest run of one character."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(s, F.lit(r"((.)\2*)"), 1), F.length)), F.lit(0))


def kmers(s: Column, k: int) -> Column:
    """All k-mers of A, C, G and T, in order; none for a null. A look-ahead takes one step a letter, so the time is linear in the text."""
    return F.coalesce(F.regexp_extract_all(s, F.lit(f"(?=([ACGT]{{{k}}}))"), 1), F.array().cast("array<string>"))


def kmer_uniqueness(s: Column, k: int) -> Column:
    """Distinct over all valid k-mers; 0 without any."""
    x = kmers(s, k)
    return F.when(F.size(x) > 0, F.size(F.array_distinct(x)) / F.size(x)).otherwise(0.0)


def cigar_valid(c: Column) -> Column:
    return F.rlike(c, F.lit(r"^([1-9][0-9]*[MIDNSHP=X])+$"))


def cigar_length(c: Column, ops: str) -> Column:
    """Sum of the lengths of the operations named."""
    runs = F.regexp_extract_all(c, F.lit(rf"([0-9]+)[{ops}]"), 1)
    return F.aggregate(runs, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def reference_end(pos: Column, c: Column) -> Column:
    return pos + cigar_length(c, "MDN=X")


def terminal_run(s: Column) -> Column:
    """Length of the run of A or of T that ends the sequence."""
    return F.length(F.regexp_extract(s, "(A+|T+)$", 1))


def most_edits(length: Column, least: float) -> Column:
    """Edits that a longer length allows at an identity of `least`."""
    return F.greatest(F.floor((1 - min(max(least, 0.0), 1.0)) * length + 1e-9), F.lit(0)).cast("int")


def edit_identity(a: Column, b: Column, least: float) -> Column:
    """1 - edits / longer length, where the edits allow at least `least`; else null, also where one is empty. Only the band that so many edits can reach is computed: a pair costs its length times the band."""
    longer = F.greatest(F.length(a), F.length(b))
    d = F.call_function("levenshtein", a, b, most_edits(longer, least))  # -1 beyond the bound
    return F.when((F.length(a) > 0) & (F.length(b) > 0) & (d >= 0), 1 - d / longer)
