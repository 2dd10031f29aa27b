"""Predicates over alignment records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomseq.functions.sequence import cigar_length

UNMAPPED, SECONDARY, SUPPLEMENTARY = 0x4, 0x100, 0x800


def _longest(cigar: Column, op: str) -> Column:
    found = F.transform(F.regexp_extract_all(cigar, F.lit(f"([0-9]+){op}"), 1), lambda x: x.cast("long"))
    return F.coalesce(F.array_max(found), F.lit(0))


def _block(cigar: Column) -> Column:
    """Longest stretch of matched bases that no other operation breaks."""
    runs = F.regexp_extract_all(cigar, F.lit("((?:[0-9]+[M=X])+)"), 1)
    return F.coalesce(F.array_max(F.transform(runs, lambda r: cigar_length(r, "M=X"))), F.lit(0))


def _near(cigar: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(cigar, pattern, group)


def informative(flag: Column, mapq: Column, length: Column, cigar: Column, nm: Column, sa: Column) -> Column:
    """Whether a read is kept for the search of insertions.

    Unmapped, secondary and short (under 50) reads go. A read without a signal
    (supplementary, SA tag, clip of 100, insertion of 50) stays above mapping
    quality 20. One with a signal needs a matched stretch of 200 and, unless it
    has the insertion, 120 matched bases beside each long clip and at most one
    mismatch in five matched bases. Nulls of flag, mapq or length count as 0, of
    cigar as empty, of nm and sa as absent.
    """
    flag, mapq, length, cigar = F.coalesce(flag, F.lit(0)), F.coalesce(mapq, F.lit(0)), F.coalesce(length, F.lit(0)), F.coalesce(cigar, F.lit(""))
    has = lambda bit: flag.bitwiseAND(F.lit(bit)) != 0
    inserted, clipped = _longest(cigar, "I") >= 50, _longest(cigar, "S") >= 100
    signal = has(SUPPLEMENTARY) | sa.isNotNull() | clipped | inserted
    lead, trail = r"^(?:[0-9]+H)*([0-9]+)S((?:[0-9]+[M=X])*)", r"((?:[0-9]+[M=X])*)(?<![0-9])([0-9]+)S(?:[0-9]+H)*$"
    number = lambda c: F.coalesce(c.try_cast("long"), F.lit(0))
    bare = ((number(_near(cigar, lead, 1)) >= 100) & (cigar_length(_near(cigar, lead, 2), "M=X") < 120)) | ((number(_near(cigar, trail, 2)) >= 100) & (cigar_length(_near(cigar, trail, 1), "M=X") < 120))
    matched = cigar_length(cigar, "M=X")
    noisy = F.coalesce((matched > 0) & (nm / F.greatest(matched, F.lit(1)) > 0.2), F.lit(False))
    fit = (_block(cigar) >= 200) & (inserted | ~(bare | noisy))
    return ~has(UNMAPPED) & ~has(SECONDARY) & (length >= 50) & F.when(signal, fit).otherwise(mapq > 20)
