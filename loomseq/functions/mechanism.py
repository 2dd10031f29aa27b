"""Scores of the mechanism behind an insertion: boundaries, segmentation, posteriors, certificates. All built-in expressions over plain columns.

The weights and thresholds are fixed values of the models.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomseq.functions.alignment import once
from loomseq.functions.support import count


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def unit(x: Column) -> Column:
    return clamp(x, 0.0, 1.0)


def saturating(n: Column, scale: float) -> Column:
    """1 - exp(-n / scale); 0 for no count."""
    return F.when(n > 0, 1 - F.exp(-n / scale)).otherwise(0.0)


def log_sum(*x: Column) -> Column:
    top = F.greatest(*x)
    total = F.exp(x[0] - top)
    for v in x[1:]:
        total = total + F.exp(v - top)
    return top + F.ln(total)


#: Labels of a boundary. Fixed values.
PASS_BOUNDARY_TSD, PASS_BOUNDARY_BLUNT, PASS_BOUNDARY_SMALL_DEL, PASS_BOUNDARY_NONCANONICAL_CONSISTENT = "PASS_BOUNDARY_TSD", "PASS_BOUNDARY_BLUNT", "PASS_BOUNDARY_SMALL_DEL", "PASS_BOUNDARY_NONCANONICAL_CONSISTENT"
REJECT_BOUNDARY_MISSING_REF_SEGMENTS, REJECT_BOUNDARY_INVALID_REF_SEGMENTS, REJECT_BOUNDARY_TSD_RANGE, REJECT_BOUNDARY_DEL_RANGE = "REJECT_BOUNDARY_MISSING_REF_SEGMENTS", "REJECT_BOUNDARY_INVALID_REF_SEGMENTS", "REJECT_BOUNDARY_TSD_RANGE", "REJECT_BOUNDARY_DEL_RANGE"


def boundary(ls: Column, le: Column, rs: Column, re: Column, shortest: int = 3, longest: int = 50) -> Column:
    """Struct passed, type, length, qc of two flanks on the reference: an overlap in range is a duplication (TSD), none a BLUNT end, a gap up to `longest` a SMALL_DEL."""
    d = rs - le
    missing = F.least(ls, le, rs, re) < 0
    invalid = (ls >= le) | (rs >= re)
    kind = F.when(missing | invalid, None).when(d.between(-longest, -shortest), "TSD").when(d == 0, "BLUNT").when(d.between(1, longest), "SMALL_DEL")
    qc = (
        F.when(missing, REJECT_BOUNDARY_MISSING_REF_SEGMENTS).when(invalid, REJECT_BOUNDARY_INVALID_REF_SEGMENTS).when(kind == "TSD", PASS_BOUNDARY_TSD).when(kind == "BLUNT", PASS_BOUNDARY_BLUNT)
        .when(kind == "SMALL_DEL", PASS_BOUNDARY_SMALL_DEL).when(d < 0, REJECT_BOUNDARY_TSD_RANGE).otherwise(REJECT_BOUNDARY_DEL_RANGE)
    )
    return F.struct(kind.isNotNull().alias("passed"), kind.alias("type"), F.when(kind.isNotNull(), F.abs(d)).alias("length"), qc.alias("qc"))


def boundary_evidence(ls: Column, le: Column, rs: Column, re: Column, envelope: Column, shortest: int = 3, longest: int = 50) -> Column:
    """Struct defined, canonical, consistent, type, length, qc, score. A span that is no canonical boundary is still consistent if the breakpoints' envelope holds it."""
    b = boundary(ls, le, rs, re, shortest, longest)
    n = F.abs(rs - le)
    defined = (F.least(ls, le, rs, re) >= 0) & (ls < le) & (rs < re)
    held = defined & ~b["passed"] & (envelope > 0) & (n <= envelope)
    z = (F.ln(n.cast("double")) - F.ln(F.lit(12.0))) / 0.7
    score = (
        F.when(b["type"] == "TSD", 1.2 - 0.5 * z * z).when(b["type"] == "BLUNT", 1.0).when(b["type"] == "SMALL_DEL", clamp(0.8 - n / 80.0, 0.2, 0.8)).when(held, 0.25).otherwise(-2.0)
    )
    return F.struct(
        defined.alias("defined"), b["passed"].alias("canonical"), (b["passed"] | held).alias("consistent"), F.when(held, "NONCANONICAL").otherwise(b["type"]).alias("type"),
        F.when(held, n).otherwise(b["length"]).alias("length"), F.when(held, PASS_BOUNDARY_NONCANONICAL_CONSISTENT).otherwise(b["qc"]).alias("qc"), score.alias("score"),
    )


def one_sided(passed: Column, has_insert: Column, left_len: Column, right_len: Column) -> Column:
    return passed & has_insert & ((left_len > 0) != (right_len > 0))


def segmentation_score(passed: Column, has_insert: Column, left_len: Column, right_len: Column, left_id: Column, right_id: Column) -> Column:
    """Half for the flanks' length and half for their identity; of a one-sided pass, its only flank counts."""
    one = one_sided(passed, has_insert, left_len, right_len)
    length = F.when(one, F.greatest(left_len, right_len)).otherwise(F.least(left_len, right_len))
    identity = F.when(~one, F.least(left_id, right_id)).when(left_len > 0, left_id).otherwise(right_id)
    gap = (left_len <= 0) | (right_len <= 0)
    return 0.5 * clamp((length - 50.0) / 25.0, -2.0, 2.0) + 0.5 * clamp((identity - 0.90) / 0.05, -2.0, 2.0) - F.when(one, 0.5).when(gap, 1.0).otherwise(0.0) - F.when(passed, 0.0).otherwise(1.5)


def reference_conflict(alt: Column, ref: Column, one: Column) -> Column:
    alt, ref = count(alt), count(ref)
    share = F.when(alt + ref > 0, ref / (alt + ref)).otherwise(0.0)
    return unit(F.greatest(share, 0.60 * saturating(ref, 8.0), F.when(one & (ref > 0), 0.35).otherwise(0.0)))


def independent_support(alt: Column, mechanistic: Column) -> Column:
    """Of reads that show the mechanism: how many, and which share of all."""
    alt, n = count(alt), count(mechanistic)
    return F.when((alt > 0) & (n > 0), F.sqrt(saturating(n, 4.0) * unit(n / alt))).otherwise(0.0)


def event_support(alt: Column, gq: Column, fraction: Column, independent: Column) -> Column:
    return unit(0.45 * saturating(count(alt), 8.0) + 0.30 * independent + 0.15 * unit(gq / 60.0) + 0.10 * unit(fraction))


def certificate(event: Column, independent: Column, sequence: Column, structure: Column, boundary_: Column, conflict: Column, artifact: Column, structure_width: Column) -> Column:
    """Struct vs_artifact, vs_other, ambiguity, support: lower log Bayes factors of six blocks of evidence and their mean ambiguity.

    structure is the log ratio of the element's structure over its best rival,
    structure_width its ambiguity; the others are signals from 0 to 1.
    """
    e = -0.75 + 3.0 * event - 2.2 * conflict
    i = -1.0 + 4.0 * independent - 1.2 * conflict
    q = -1.4 + 4.2 * sequence - artifact
    t = clamp(structure, -4.0, 5.0)
    b = -0.7 + 2.4 * boundary_ - 0.7 * conflict
    r = -3.0 * conflict - 0.8 * artifact
    width = (0.55 - 0.30 * event) + (0.75 - 0.45 * independent) + (0.65 - 0.40 * sequence) + structure_width + (0.55 - 0.35 * boundary_) + (0.20 + 0.50 * conflict)
    return F.struct(
        (e + i + q + 0.9 * t + b + r - 0.65).alias("vs_artifact"), (0.40 * e + 0.70 * i + q + 0.9 * t + 0.85 * b + 0.35 * r - 0.39).alias("vs_other"),
        (width / 6.0).alias("ambiguity"), unit(0.35 * independent + 0.25 * event + 0.25 * boundary_ + 0.15 * sequence).alias("support"),
    )


def worst_lfdr(vs_artifact: Column, vs_other: Column, ambiguity: Column, artifact: Column, q: float) -> Column:
    """Struct lfdr, qc: the local fdr at the least favourable prior and the lower Bayes factor."""
    least = clamp(0.05 * (1 - 0.7 * artifact), 0.005, 0.05)
    odds = F.exp(clamp(F.least(vs_artifact, vs_other) - ambiguity, -60.0, 60.0)) * least
    lfdr = 1.25 / (1.25 + odds)
    return F.struct(lfdr.alias("lfdr"), F.when(lfdr <= q, "PASS_TE_LFDR").otherwise("TE_LFDR_HIGH").alias("qc"))


def local_posterior(
    alt: Column, ref: Column, precise: Column, bilateral: Column, gq: Column, segmentation: Column, sequence: Column, has_insert: Column, one: Column, defined: Column, canonical: Column,
    consistent: Column, closed: Column, unknown: Column, confidence: Column, identity: Column, coverage: Column, margin: Column,
) -> Column:
    """Struct te, other, artifact, qc: a softmax of three linear scores, and whether the first passes its thresholds.

    segmentation and sequence are log support; closed: both flanks and a
    consistent boundary; unknown: an element without a family.
    """
    alt, ref, precise, bilateral = map(count, (alt, ref, precise, bilateral))
    balance = clamp(F.ln(alt + 1.0) - F.ln(ref + 1.0), -2.0, 2.0)
    structural = clamp(0.65 * balance + 0.45 * clamp(F.ln(precise + bilateral + 1.0), 0.0, 2.0) + clamp((gq - 20.0) / 40.0, 0.0, 1.5), -2.0, 3.0)
    seg = clamp(segmentation, -2.0, 2.0)
    edge = F.when(closed, 1.0).when(one & has_insert, -0.35).when(defined & consistent, 0.25).otherwise(-1.0)
    deficit = 0.45 * unit((0.62 - unit(identity)) / 0.16) + 0.20 * unit((0.90 - unit(coverage)) / 0.40) + 0.15 * unit((0.05 - unit(margin)) / 0.05)
    part = lambda c, x: F.when(c, x).otherwise(0.0)
    context = (
        part(~has_insert, 1.6) + part(one, 1.1) + part(~defined | (~canonical & ~consistent), 0.9) + part(precise + bilateral == 0, 0.5) + F.least(F.lit(1.0), 0.08 * ref)
        + part(unknown, deficit + F.when(confidence == "LOW", 0.50).when(confidence == "MEDIUM", 0.20).otherwise(0.0))
    )
    te = -0.25 + structural + 0.75 * seg + sequence + edge - 0.35 * context
    other = 0.10 + 0.85 * structural + 0.60 * seg - 0.75 * sequence + F.when(has_insert, 0.25).otherwise(-0.75)
    artifact = -0.10 + context - 0.25 * structural - 0.15 * seg - 0.35 * F.greatest(sequence, F.lit(0.0))
    total = log_sum(te, other, artifact)
    fine = (F.exp(te - total) >= F.when(closed, 0.65).otherwise(0.72)) & (te - artifact >= F.when(closed, 0.75).otherwise(1.25)) & (te - other >= F.when(unknown, 0.55).otherwise(0.25))
    return F.struct(F.exp(te - total).alias("te"), F.exp(other - total).alias("other"), F.exp(artifact - total).alias("artifact"), F.when(fine, "PASS_TE_POSTERIOR").otherwise("").alias("qc"))


def structure_scores(length: Column, identity: Column, coverage: Column, margin: Column, tail: Column, residual: Column, masked: Column, entropy: Column) -> Column:
    """Struct core, poly, rest, poly_posterior, transduced_posterior of an insert that is laid out as element core, poly-A tail and rest."""
    core = F.greatest(F.least(F.round(length * coverage), length), F.lit(1.0))
    poly = F.least(tail.cast("double"), length - core)
    rest = length - core - poly
    logistic = lambda x: 1 / (1 + F.exp(-clamp(x, -40.0, 40.0)))
    return F.struct(core.alias("core"), poly.alias("poly"), rest.alias("rest"), logistic(1.28 * poly - 3).alias("poly_posterior"), logistic(0.06 * rest * (entropy - 0.55) - 1.6 + 0.6 * identity).alias("transduced_posterior"), F.greatest(residual - masked, F.lit(0.0)).alias("unmasked"))


def structure_evidence(identity: Column, coverage: Column, margin: Column, poly: Column, transduced: Column, model: Column, score: Column, residual: Column, masked: Column, reason: Column, path: Column) -> Column:
    """Struct te, other, artifact: log evidence of the structure under three explanations."""
    hard = F.greatest(residual - masked, F.lit(0.0))
    is_ = lambda label: F.coalesce(model == label, F.lit(False))
    fit = F.when(is_("TE_MODEL_IN_DISTRIBUTION"), 0.35 + 0.25 * score).when(is_("TE_MODEL_EDGE"), -0.15).when(is_("TE_MODEL_OUTLIER"), -0.85).otherwise(0.0)
    weak = F.when(reason == "PASS_INSERT_TE_ALIGNMENT_UNKNOWN", 0.45).when(reason == "PASS_INSERT_TE_ALIGNMENT_FAMILY_ONLY", 0.25).otherwise(0.0)
    te = -1.1 + 2 * identity + 2.45 * coverage + 0.55 * unit(4 * margin) + 0.55 * poly + 0.35 * transduced + fit - 1.25 * hard - 0.55 * masked - weak - F.when(path, 0.0).otherwise(2.0)
    other = -0.25 + 1.65 * hard + 0.75 * residual - 1.25 * coverage - 0.85 * identity - 0.25 * poly
    artifact = -0.10 + 1.10 * masked + F.when(is_("TE_MODEL_OUTLIER"), 1.25).otherwise(0.0) + F.when(reason == "TE_ALIGNMENT_LOW_IDENTITY", 0.65).otherwise(0.0) - 0.95 * coverage - 0.75 * identity
    return F.struct(te.alias("te"), other.alias("other"), artifact.alias("artifact"))


def het_balance(alt: Column, ref: Column) -> Column:
    """How close the counts are to one half, weighted by the smaller."""
    alt, ref = count(alt), count(ref)
    af = F.when(alt + ref > 0, alt / (alt + ref)).otherwise(0.0)
    return (1 - F.least(F.abs(af - 0.5) / 0.5, F.lit(1.0))) * F.ln(1.0 + F.least(alt, ref))


def promotion_score(alt: Column, te: Column, worst: Column, robust: Column, identity: Column, coverage: Column, margin: Column, ref: Column, conflict: Column, passed: Column, posterior_passed: Column, lfdr_passed: Column) -> Column:
    bonus = F.when(passed, 6).otherwise(0) + F.when(posterior_passed, 4).otherwise(0) + F.when(lfdr_passed, 2).otherwise(0)
    return alt + 8 * te + 4 * (1 - worst) + 6 * (1 - robust) + 3 * identity + 3 * coverage + 2 * margin - 1.5 * ref - 10 * conflict + bonus


#: State: mean and strength of identity, event, independent, quality, artifact, conflict; then the log prior. The first four are elements. Fixed values.
LATENT = {
    "active_tprt_te": ((0.94, 12.0), (0.86, 5.5), (0.80, 6.0), (0.88, 3.0), (0.06, 4.5), (0.08, 2.5), -1.35),
    "cut_paste_te": ((0.92, 11.0), (0.84, 5.5), (0.76, 6.0), (0.86, 3.0), (0.07, 4.5), (0.08, 2.5), -1.35),
    "ltr_complex_te": ((0.90, 10.0), (0.80, 5.0), (0.70, 5.5), (0.84, 3.0), (0.10, 4.0), (0.12, 2.5), -1.50),
    "degraded_unknown_te": ((0.72, 3.5), (0.62, 4.0), (0.50, 5.0), (0.72, 2.5), (0.22, 3.0), (0.20, 2.0), -1.80),
    "non_te_insert": ((0.30, 5.5), (0.82, 5.0), (0.68, 4.0), (0.82, 3.0), (0.12, 3.5), (0.12, 2.0), -0.85),
    "artifact_reference": ((0.38, 3.5), (0.22, 4.0), (0.12, 4.0), (0.35, 3.0), (0.72, 5.0), (0.55, 3.0), -0.75),
}
#: State: what a kind of family adds to its log prior. Fixed values.
COMPATIBLE = {
    "active_tprt_te": {"retro": 0.75, "ltr": 0.20, "dna": -0.55, "unknown": -0.35},
    "cut_paste_te": {"dna": 0.75, "retro": -0.40, "ltr": -0.40, "unknown": -0.20},
    "ltr_complex_te": {"ltr": 0.75, "retro": -0.10, "dna": -0.50, "unknown": -0.30},
    "degraded_unknown_te": {"unknown": 0.40},
}
#: Words of a family's name that tell its kind, the first kind that fits. Fixed values.
FAMILY_WORDS = {
    "ltr": ("ltr", "erv", "gypsy", "copia", "bel-pao", "dirs"),
    "dna": ("dna", "hat", "pif", "harbinger", "tc1", "mariner", "piggybac", "mutator", "merlin", "cmc", "dong"),
    "retro": ("l1", "l2", "line", "sine", "alu", "sva", "rte", "r2", "cr1", "penelope", "5s-deu-l2"),
}
NO_FAMILY = ("", "unknown", "na", "none")
_ELEMENTS = tuple(LATENT)[:4]
_EDGE = 1e-6


def family_kind(family: Column, subfamily: Column) -> Column:
    """ltr, dna, retro or other by the words of the names; unknown without any name."""
    f, s = F.lower(F.coalesce(family, F.lit(""))), F.lower(F.coalesce(subfamily, F.lit("")))
    name = F.concat(f, F.lit(":"), s)
    kind = F.when(f.isin(*NO_FAMILY) & s.isin(*NO_FAMILY), "unknown")
    for k, words in FAMILY_WORDS.items():
        found = F.lit(False)
        for w in words:
            found = found | F.contains(name, F.lit(w))
        kind = kind.when(found, k)
    return kind.otherwise("other")


SIGNALS = ("identity", "event", "independent", "quality", "artifact", "conflict")


def latent_signals(
    df: DataFrame, identity: Column, alt: Column, ref: Column, mechanistic: Column, gq: Column, af: Column, segmentation: Column, one: Column, has_insert: Column, label: Column, defined: Column, canonical: Column, consistent: Column, confidence: Column, kind: Column, out: str = "signals"
) -> DataFrame:
    """df with `out`: struct of the six signals of the latent states, from 0 to 1, the family's kind and its prior of activity.

    mechanistic: split, insertion and two-sided clip reads, and those that agree
    with the insert; segmentation: its adjusted score; one: whether it passed with
    one flank; label: of the sequence model; confidence: of the annotation. What
    is used more than once is a column of its own, computed once.
    """
    c = F.col
    rows = once(df, **{"__alt": count(alt), "__ref": count(ref), "__one": F.coalesce(one, F.lit(False)), "__mech": mechanistic, "__kind": kind, "__identity": unit(identity), "__quality": unit(gq / 60.0)})
    share = F.when(c("__alt") + c("__ref") > 0, c("__ref") / (c("__alt") + c("__ref"))).otherwise(0.0)
    floor = F.when(c("__one") & (c("__ref") > 0), 0.35).otherwise(0.0)
    rows = once(rows, **{
        "__independent": F.sqrt(saturating(c("__mech"), 4.0) * F.when(c("__alt") > 0, unit(c("__mech") / c("__alt"))).otherwise(0.0)),
        "__conflict": unit(F.greatest(share, 0.60 * saturating(c("__ref"), 8.0), floor)),
    })
    least = lambda x, v: F.when(F.coalesce(x, F.lit(False)), v).otherwise(0.0)
    artifact = F.greatest(
        least(~has_insert, 1.0), least(label == "TE_MODEL_OUTLIER", 1.0), least(label == "TE_MODEL_EDGE", 0.45), least(~defined & ~c("__one"), 0.35), least(defined & ~canonical & ~consistent, 0.50), least(confidence == "LOW", 0.35), 0.80 * c("__conflict"),
    )
    rows = once(rows, **{"__event": unit(0.35 * saturating(c("__alt"), 8.0) + 0.30 * c("__independent") + 0.20 * unit((segmentation + 1.0) / 3.0) + 0.15 * unit(af)), "__artifact": unit(artifact)})
    known = F.when(c("__kind") == "unknown", 0.0).otherwise(1.0)
    activity = clamp(0.30 * c("__identity") + 0.25 * c("__event") + 0.20 * c("__independent") + 0.15 * c("__quality") + 0.10 * known - 0.30 * c("__artifact") - 0.10 * c("__conflict"), 0.02, 0.98)
    return once(rows, **{out: F.struct(*(c(f"__{n}").alias(n) for n in SIGNALS), c("__kind").alias("kind"), activity.alias("activity"))}).select(*df.columns, out)


def with_latent_mechanism(df: DataFrame, signals: str, out: str, target: float = 0.10) -> DataFrame:
    """df with `out`: struct mechanism (the first of the likeliest states), te, non_te, artifact, activity, lfdr, worst_case_lfdr and lfdr_qc of a column of latent_signals: a softmax over states of log prior (base, activity, family) and of six signals.

    The worst case takes from the elements and gives to the others, the more the
    less the signals are independent and the more the reference speaks against.
    """
    c = F.col
    f = c(signals)
    edge = {n: clamp(f[n], _EDGE, 1 - _EDGE) for n in (*SIGNALS, "activity")}
    rows = once(df, **{f"__a_{n}": F.ln(x) for n, x in edge.items()}, **{f"__b_{n}": F.ln(1 - x) for n, x in edge.items()})
    scores = {}
    for state, (*shapes, base) in LATENT.items():
        fit = F.lit(0.0)
        for k, v in COMPATIBLE.get(state, {}).items():
            fit = F.when(f["kind"] == k, v).otherwise(fit)
        if state == "degraded_unknown_te":
            fit = F.when((f["kind"] != "unknown") & (f["identity"] < 0.75), 0.20).otherwise(fit)
        total = base + (0.55 if state in _ELEMENTS else -0.20) * (c("__a_activity") - c("__b_activity")) + fit
        for n, (mean, strength) in zip(SIGNALS, shapes, strict=True):
            total = total + strength * (mean * c(f"__a_{n}") + (1 - mean) * c(f"__b_{n}"))
        scores[f"__s_{state}"] = total
    for n, total in scores.items():
        rows = once(rows, **{n: total})  # a step each: code of all states together is too long to be compiled
    rows = rows.withColumns({"__top": F.greatest(*(c(n) for n in scores)), "__gap": 1.0 - f["independent"]})
    elements, others = [n for n in scores if n[4:] in _ELEMENTS], [n for n in scores if n[4:] not in _ELEMENTS]
    part = lambda names: sum((F.exp(c(n) - c("__top")) for n in names[1:]), F.exp(c(names[0]) - c("__top")))
    rows = once(rows, __te=part(elements), __null=part(others))
    # Both sides of the worst case move by one factor each; their odds are enough.
    odds = F.ln(c("__te")) - (0.95 + 2.60 * c("__gap") + 0.75 * f["conflict"]) - F.ln(c("__null")) - (0.95 + 1.65 * c("__gap") + 0.55 * f["conflict"])
    rows = once(rows, __worst=1 / (1 + F.exp(odds)))
    whole = c("__te") + c("__null")
    best = F.coalesce(*(F.when(c(n) == c("__top"), n[4:]) for n in scores))
    state = lambda n: F.exp(c(f"__s_{n}") - c("__top")) / whole
    qc = F.when(c("__worst") <= min(max(target, 0.0), 1.0), "PASS_TE_LFDR").otherwise("TE_LFDR_HIGH")
    result = F.struct(
        best.alias("mechanism"), (c("__te") / whole).alias("te"), state("non_te_insert").alias("non_te"), state("artifact_reference").alias("artifact"), f["activity"].alias("activity"),
        (c("__null") / whole).alias("lfdr"), c("__worst").alias("worst_case_lfdr"), qc.alias("lfdr_qc"),
    )
    return rows.select(*df.columns, result.alias(out))
