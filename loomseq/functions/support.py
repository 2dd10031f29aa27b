"""Predicates and reasons over the read support of a candidate insertion, all built-in expressions. Counts below 0 and nulls count as 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomseq.functions import sequence as S

#: Fixed values of the read-level rules.
INSERTION_MAPQ, FRAGMENT_SLACK, LOCUS_GAP = 60, 25, 50


def count(c: Column) -> Column:
    return F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))


def insertion_mapq(mapq: Column) -> Column:
    """Whether an insertion of an alignment string counts as evidence: at the highest mapping quality only."""
    return F.coalesce(mapq == INSERTION_MAPQ, F.lit(False))


def low_complexity_clip(is_clip: Column, s: Column, at_most: float = 0.90, run: int = 80, entropy: float = 1.25, unique: float = 0.35) -> Column:
    """Whether a clipped piece is empty, or rich in A and T, or one long run, or of low entropy, or of few distinct 5-mers. Other pieces never are."""
    s = F.coalesce(s, F.lit(""))
    acgt = F.length(F.regexp_replace(s, "[^ACGT]", ""))
    at = F.when(acgt > 0, F.length(F.regexp_replace(s, "[^AT]", "")) / acgt).otherwise(0.0)
    return is_clip & ((s == "") | (at >= at_most) | (S.longest_run(s) >= run) | (S.entropy(s) < entropy) | (S.kmer_uniqueness(s, 5) < unique))


def low_quality_anchor(is_clip: Column, anchor: Column, nm: Column, shortest: int = 20, mismatches: float = 0.12) -> Column:
    """Whether a clipped piece's anchor is short (but not 0) or has too many mismatches a base. A null or negative nm is unknown."""
    return is_clip & (anchor > 0) & ((anchor < shortest) | F.coalesce((nm >= 0) & (nm / anchor > mismatches), F.lit(False)))


def in_owner_bin(anchor: Column, start: Column, end: Column) -> Column:
    return (anchor >= start) & (anchor < end)


def bin_of(pos: Column, size: int) -> Column:
    """Number of the bin of a position; 0 for a negative one."""
    return F.greatest(F.floor(pos / size), F.lit(0))


def local_fragment(junction: Column, left: Column, right: Column, slack: int = FRAGMENT_SLACK) -> Column:
    """Whether a junction lies within `slack` of the breakpoints; unknown (negative) positions never do."""
    lo = F.greatest(F.least(left, right) - slack, F.lit(0))
    hi = F.greatest(lo, F.greatest(left, right) + slack)
    return (junction >= 0) & (left >= 0) & (right >= 0) & junction.between(lo, hi)


def keep_for_assembly(first: Column, alt: Column, ref: Column, split: Column, indel: Column, left: Column, right: Column) -> Column:
    """Whether a hypothesis goes on: the first in rank, any split or indel, clips on both sides with two reads, or three clips of one side with three reads that outnumber the reference twice."""
    alt, ref, left, right = map(count, (alt, ref, left, right))
    both = (left > 0) & (right > 0)
    one = ((left > 0) != (right > 0)) & (F.greatest(left, right) >= 3) & (alt >= 3) & (alt >= 2 * F.greatest(ref, F.lit(1)))
    return first | (count(split) > 0) | (count(indel) > 0) | (both & (alt >= 2)) | one


def in_ledger(*counts: Column) -> Column:
    """Whether any counter is above 0."""
    return F.greatest(F.lit(0), *map(count, counts)) > 0


def partial_context(left: Column, right: Column, partial: Column, reads: Column) -> Column:
    """Both anchors, and two partial-context and two event reads."""
    return (count(left) > 0) & (count(right) > 0) & (count(partial) >= 2) & (count(reads) >= 2)


def validator_reason(left: Column, right: Column, full: Column, partial: Column, reads: Column, precise: Column) -> Column:
    anchored = (count(left) > 0) & (count(right) > 0)
    context = (count(full) > 0) | (count(precise) > 0)
    return (
        F.when(~anchored & ~context, "VALIDATOR_NO_BILATERAL_ANCHOR")
        .when(~context & ~partial_context(left, right, partial, reads), "VALIDATOR_NO_PRECISE_OR_FULL_CONTEXT")
        .otherwise("VALIDATOR_PASS")
    )


def segmentation_gate(left: Column, right: Column, full: Column, partial: Column, reads: Column, precise: Column) -> Column:
    """Reason that keeps a hypothesis from segmentation; empty if none. Anchors are needed on both sides here."""
    context = (count(full) > 0) | (count(precise) > 0)
    return (
        F.when(~((count(left) > 0) & (count(right) > 0)), "PRESEG_NO_BILATERAL_ANCHOR")
        .when(~context & ~partial_context(left, right, partial, reads), "PRESEG_NO_PRECISE_OR_FULL_CONTEXT")
        .otherwise("")
    )


def interpretable(passed: Column, model: Column, reason: Column) -> Column:
    """Passed, not an outlier of the sequence model, and annotated from the insert."""
    return F.coalesce(passed & (model != "TE_MODEL_OUTLIER") & reason.startswith("PASS_INSERT"), F.lit(False))


def null_control(certificate: Column, promotable: Column, qc: Column) -> Column:
    """Whether a ledger row is a control of its own sample."""
    return certificate & ~promotable & ~F.coalesce(qc.startswith("PASS_TE"), F.lit(False))


def reported(qc: Column, posterior_qc: Column, lfdr_qc: Column, certificate: Column, calibrated: bool = True) -> Column:
    """Whether a call is reported: with three passes and a certificate, or, uncalibrated, always."""
    return (qc.startswith("PASS_TE") & (posterior_qc == "PASS_TE_POSTERIOR") & (lfdr_qc == "PASS_TE_LFDR") & certificate) if calibrated else F.lit(True)


def de_novo(exact: Column, family: Column, ambiguous: Column, veto: bool = False, review: bool = True) -> Column:
    """Struct status, passed of a child's call from its parents' reads."""
    exact, family, ambiguous = map(count, (exact, family, ambiguous))
    vetoed = (exact > 0) | ((family > 0) if veto else F.lit(False))
    doubt = ((ambiguous > 0) | (family > 0)) if review else F.lit(False)
    status = F.when(vetoed, "PARENT_VETO").when(doubt, "REVIEW").otherwise("PASS")
    return F.struct(status.alias("status"), (status == "PASS").cast("int").alias("passed"))


def high_precision(identity: Column, coverage: Column, length: Column, family: Column, score: float = 3500.0, core: float = 0.80) -> Column:
    """Identity x covered core x length at least `score`, coverage at least `core`, and a named family."""
    named = F.coalesce(~F.upper(family).isin("", "NA", "UNKNOWN"), F.lit(False))
    return named & (identity * coverage * length >= score) & (coverage >= core)


def interval_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0))


def same_locus(a_left: Column, a_right: Column, a_pos: Column, b_left: Column, b_right: Column, b_pos: Column, gap: int = LOCUS_GAP) -> Column:
    """Whether two calls of one contig are one locus: two proper intervals that touch, else at most `gap` apart. An end that is negative stands for the position."""

    def span(left, right, pos):
        known = (left >= 0) & (right >= 0)
        return F.when(known, F.least(left, right)).otherwise(pos), F.when(known, F.greatest(left, right)).otherwise(pos)

    (al, ar), (bl, br) = span(a_left, a_right, a_pos), span(b_left, b_right, b_pos)
    known = (al >= 0) & (ar >= 0) & (bl >= 0) & (br >= 0)
    apart = F.greatest(F.greatest(bl - ar, al - br), F.lit(0))
    return known & (apart <= F.when((ar > al) & (br > bl), 0).otherwise(gap))


def family_key(value: Column) -> Column:
    """First part of a family name up to / : or -, in lower case; null and missing marks are empty."""
    v = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(v.isin("", ".", "na", "none", "unknown"), "").otherwise(F.regexp_extract(v, r"^([^/:\-]*)", 1))


def trio_family(value: Column) -> Column:
    """Family class of a trio: ALU, SVA, LINE1, ERV by prefix, else the upper-cased name up to a delimiter."""
    v = F.upper(F.trim(F.coalesce(value, F.lit(""))))
    return (
        F.when(v.startswith("ALU"), "ALU").when(v.startswith("SVA"), "SVA").when(v.startswith("L1") | v.startswith("LINE1"), "LINE1")
        .when(v.startswith("ERV") | v.startswith("HERV"), "ERV").otherwise(F.regexp_extract(v, r"^([^/:\-_#|]*)", 1))
    )


def window_around(start: Column, end: Column, flank: int, length: Column) -> Column:
    """Struct start, end (from 1, both included) of an interval with a flank, within the contig."""
    return F.struct(F.greatest(F.least(start, end) - flank, F.lit(1)).alias("start"), F.least(F.greatest(start, end) + flank, length).alias("end"))
