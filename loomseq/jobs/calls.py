"""Queries of the support, mechanism, locus, matching, selection and table operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseq.functions import mechanism as M
from loomseq.functions import support as P
from loomseq.operators import conformal, loci, matching, naming, sets
from loomseq.sources import tables
from loomseq.sources.shared import new_path

C = F.col

#: Stand-ins for a candidate's evidence, in terms of a line's columns; the same text in both dialects.
EVIDENCE = {
    "id": "l_orderkey * 10 + l_linenumber",
    "alt": "(l_orderkey * 7 + l_linenumber * 3) % 23",
    "ref": "(l_orderkey * 5 + l_linenumber) % 17",
    "split": "l_partkey % 4",
    "indel": "l_suppkey % 3",
    "lclip": "(l_orderkey + l_suppkey) % 6",
    "rclip": "(l_orderkey + l_partkey) % 5",
    "gq": "l_partkey % 61",
    "ident": "cast(50 + l_partkey % 51 as double) / 100",
    "cov": "cast(l_suppkey % 101 as double) / 100",
    "margin": "cast(l_orderkey % 31 as double) / 100",
    "ls": "l_partkey % 400 - 5",
    "le": "l_partkey % 400 + l_linenumber * 10 - 20",
    "rs": "l_partkey % 400 + l_suppkey % 120 - 40",
    "re": "l_partkey % 400 + l_suppkey % 120 + l_orderkey % 40 - 42",
}
_E = "SELECT " + ", ".join(f"{x} AS {n}" for n, x in EVIDENCE.items()) + " FROM lineitem"


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "lineitem").selectExpr(*(f"{x} AS {n}" for n, x in EVIDENCE.items()))


def _r(c, n: str, digits: int = 7):
    return F.round(c, digits).alias(n)


# ---------------------------------------------------------------- predicates


def p_support_predicates(spark: SparkSession, sf: str) -> DataFrame:
    """P2, P4 to P11 and P13."""
    e = _evidence(spark, sf)
    precise = C("split") + C("indel")
    return e.select(
        "id",
        P.insertion_mapq(C("gq")).alias("p2"),
        P.low_quality_anchor(C("alt") > 3, C("gq"), C("ref") - 2).alias("p4"),
        P.in_owner_bin(C("ls"), F.lit(100), F.lit(200)).alias("p5"),
        P.local_fragment(C("ls"), C("rs"), C("re")).alias("p6"),
        P.keep_for_assembly(C("gq") == 7, C("alt"), C("ref"), C("split"), C("indel") * F.lit(0), C("lclip"), C("rclip")).alias("p7"),
        P.in_ledger(C("split"), C("indel"), C("lclip")).alias("p8"),
        P.partial_context(C("lclip"), C("rclip"), C("split"), C("alt")).alias("p9"),
        P.validator_reason(C("lclip"), C("rclip"), C("indel") - 1, C("split"), C("alt"), C("split") - 2).alias("p10"),
        P.segmentation_gate(C("lclip"), C("rclip"), C("indel") - 1, C("split"), C("alt"), C("split") - 2).alias("p11"),
        P.interpretable(C("alt") > 5, F.when(C("ref") > 9, "TE_MODEL_OUTLIER").otherwise("TE_MODEL_EDGE"), F.when(precise > 2, "PASS_INSERT_TE_ALIGNMENT").otherwise("TE_LOW")).alias("p13"),
        P.bin_of(C("ls"), 64).alias("h19"),
        P.interval_overlap(C("ls"), C("le"), C("rs"), C("re")).alias("h4"),
        P.same_locus(C("ls"), C("le"), C("ls"), C("rs"), C("re"), C("rs")).alias("j8"),
    )


_PARTIAL = "(lclip > 0 AND rclip > 0 AND split >= 2 AND alt >= 2)"
_CONTEXT = "(indel - 1 > 0 OR split - 2 > 0)"


def p_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """P18, P21, P23, P29, F54 and F56."""
    li, part = _read(spark, sf, "lineitem"), _read(spark, sf, "part").select(C("p_partkey").alias("l_partkey"), "p_type")
    q = C("l_quantity").cast("int")
    qc = F.when(q % 3 == 0, "PASS_TE_X").otherwise("LEDGER")
    family = F.concat(F.element_at(F.array(*map(F.lit, ("ALUYa5", "SVA_F", "L1HS", "HERV-K", "none", "Tigger1/DNA", "."))), (q % 7 + 1).cast("int")))
    d = P.de_novo(q % 4 - 2, q % 3, q % 5 - 1, veto=True)
    return li.select(
        (C("l_orderkey") * 10 + C("l_linenumber")).alias("id"),
        P.null_control(q > 10, q % 2 == 0, qc).alias("p18"),
        P.reported(qc, F.when(q % 2 == 0, "PASS_TE_POSTERIOR").otherwise(""), F.lit("PASS_TE_LFDR"), q > 5).alias("p21"),
        d["status"].alias("p23"), d["passed"].alias("p23_passed"),
        P.high_precision(C("l_discount") * 4 + 0.6, C("l_tax") + 0.76, q * 160, family).alias("p29"),
        P.family_key(family).alias("f54"), P.trio_family(family).alias("f54_trio"),
        P.window_around(C("l_partkey"), C("l_suppkey"), 10, F.lit(120).cast("long"))["start"].alias("f56_start"), P.window_around(C("l_partkey"), C("l_suppkey"), 10, F.lit(120).cast("long"))["end"].alias("f56_end"),
    )


# ---------------------------------------------------------------- scores


def f28_boundary(spark: SparkSession, sf: str) -> DataFrame:
    """F28 and F29."""
    b = M.boundary_evidence(C("ls"), C("le"), C("rs"), C("re"), C("gq"))
    return _evidence(spark, sf).withColumn("b", b).select("id", "b.defined", "b.canonical", "b.consistent", "b.type", "b.length", "b.qc", _r(C("b.score"), "score"))


def _segmentation() -> dict:
    return {"passed": C("indel") > 0, "has_insert": C("split") > 0, "left_len": C("lclip") * 20, "right_len": C("rclip") * 25, "left_id": C("ident"), "right_id": 1 - C("margin")}


def f31_segmentation(spark: SparkSession, sf: str) -> DataFrame:
    s = _segmentation()
    return _evidence(spark, sf).select("id", M.one_sided(*list(s.values())[:4]).alias("one_sided"), _r(M.segmentation_score(**s), "score"))


_SEG = "(SELECT *, indel > 0 AS passed, split > 0 AS ins, lclip * 20 AS ll, rclip * 25 AS rl, ident AS li, 1 - margin AS ri, indel > 0 AND split > 0 AND ((lclip > 0) <> (rclip > 0)) AS one FROM e)"


def f38_posterior(spark: SparkSession, sf: str) -> DataFrame:
    s = _segmentation()
    e = _evidence(spark, sf).withColumns({"seg": M.segmentation_score(**s), "one": M.one_sided(*list(s.values())[:4]), "b": M.boundary_evidence(C("ls"), C("le"), C("rs"), C("re"), C("gq"))})
    closed = (C("lclip") > 0) & (C("rclip") > 0) & C("b.defined") & C("b.consistent")
    p = M.local_posterior(
        C("alt"), C("ref"), C("split") + C("indel"), F.least("lclip", "rclip"), C("gq"), C("seg"), C("margin") * 8 - 1, C("split") > 0, C("one"), C("b.defined"), C("b.canonical"), C("b.consistent"), closed,
        C("alt") % 3 == 0, F.when(C("ref") % 3 == 0, "LOW").when(C("ref") % 3 == 1, "MEDIUM").otherwise("HIGH"), C("ident"), C("cov"), C("margin"),
    )
    return e.withColumn("p", p).select("id", _r(C("p.te"), "te"), _r(C("p.other"), "other"), _r(C("p.artifact"), "artifact"), F.when((F.abs(C("p.te") - 0.65) < 1e-7) | (F.abs(C("p.te") - 0.72) < 1e-7), None).otherwise(C("p.qc")).alias("qc"))


_B = """b AS (SELECT *, least(ls, le, rs, re) < 0 AS missing, ls >= le OR rs >= re AS invalid, rs - le AS d FROM e),
 b2 AS (SELECT *, NOT missing AND NOT invalid AS defined, CASE WHEN missing OR invalid THEN NULL WHEN d BETWEEN -50 AND -3 THEN 'TSD' WHEN d = 0 THEN 'BLUNT' WHEN d BETWEEN 1 AND 50 THEN 'SMALL_DEL' END AS kind FROM b),
 b3 AS (SELECT *, kind IS NOT NULL AS canonical, defined AND kind IS NULL AND gq > 0 AND abs(d) <= gq AS held FROM b2)"""


def f40_certificate(spark: SparkSession, sf: str) -> DataFrame:
    """F40 and F41 with H12 and H13's signals."""
    mech = C("split") + C("indel") + F.least("lclip", "rclip")
    e = _evidence(spark, sf).withColumns({"ind": M.independent_support(C("alt"), mech), "conflict": M.reference_conflict(C("alt"), C("ref"), C("split") == 1)})
    e = e.withColumn("event", M.event_support(C("alt"), C("gq"), C("margin"), C("ind")))
    e = e.withColumn("c", M.certificate(C("event"), C("ind"), C("cov"), C("ident") * 9 - 5, C("margin"), C("conflict"), F.lit(0.3), F.lit(0.4)))
    e = e.withColumn("w", M.worst_lfdr(C("c.vs_artifact"), C("c.vs_other"), C("c.ambiguity"), F.lit(0.3), 0.1))
    return e.select("id", _r(C("event"), "event"), _r(C("ind"), "independent"), _r(C("conflict"), "conflict"), _r(C("c.vs_artifact"), "vs_artifact"), _r(C("c.vs_other"), "vs_other"), _r(C("c.ambiguity"), "ambiguity"), _r(C("c.support"), "support"), _r(C("w.lfdr"), "lfdr"), F.when(F.abs(C("w.lfdr") - 0.1) > 1e-9, C("w.qc")).alias("qc"))


def f35_structure(spark: SparkSession, sf: str) -> DataFrame:
    """F35's scores, F45's balance and the promotion score."""
    e = _evidence(spark, sf)
    e = e.withColumn("s", M.structure_scores(C("alt") * 30 + 60, C("ident"), C("cov"), C("margin"), C("lclip") * 4, C("margin"), C("margin") / 2, C("ident")))
    model = F.when(C("ref") % 4 == 0, "TE_MODEL_IN_DISTRIBUTION").when(C("ref") % 4 == 1, "TE_MODEL_EDGE").when(C("ref") % 4 == 2, "TE_MODEL_OUTLIER")
    reason = F.when(C("alt") % 3 == 0, "PASS_INSERT_TE_ALIGNMENT_UNKNOWN").when(C("alt") % 3 == 1, "TE_ALIGNMENT_LOW_IDENTITY").otherwise("PASS_INSERT_TE_ALIGNMENT_FAMILY_ONLY")
    e = e.withColumn("v", M.structure_evidence(C("ident"), C("cov"), C("margin"), C("s.poly_posterior"), C("s.transduced_posterior"), model, C("cov"), C("margin"), C("margin") / 2, reason, C("split") > 0))
    promo = M.promotion_score(C("alt"), C("cov"), C("margin"), C("margin"), C("ident"), C("cov"), C("margin"), C("ref"), C("margin"), C("split") > 0, C("indel") > 0, C("lclip") > 0)
    return e.select("id", C("s.core").cast("long").alias("core"), C("s.poly").cast("long").alias("poly"), C("s.rest").cast("long").alias("rest"), _r(C("s.poly_posterior"), "poly_p"), _r(C("s.transduced_posterior"), "trans_p"), _r(C("v.te"), "te"), _r(C("v.other"), "other"), _r(C("v.artifact"), "artifact"), _r(M.het_balance(C("alt"), C("ref")), "het"), _r(promo, "promotion"))


def f39_latent(spark: SparkSession, sf: str) -> DataFrame:
    """the latent mechanism with its activity, family, worst case and label."""
    e = _evidence(spark, sf)
    family = F.element_at(F.array(*map(F.lit, ("ALU", "hAT-1", "ERVK", "unknown", "Foo", "L1HS"))), (C("alt") % 6 + 1).cast("int"))
    kind = M.family_kind(family, F.when(C("ref") % 2 == 0, "NA").otherwise("sub"))
    label = F.when(C("split") % 5 == 0, "TE_MODEL_OUTLIER").when(C("split") % 5 == 1, "TE_MODEL_EDGE").otherwise("TE_MODEL_INLIER")
    odd = lambda c: C(c) % 2 == 1
    rows = M.latent_signals(e.withColumn("kind", kind), C("ident"), C("alt"), C("ref"), C("split") + C("indel") + F.least("lclip", "rclip"), C("gq"), C("cov"), C("margin") * 4 - 1, odd("lclip"), C("gq") > 3, label, odd("indel"), odd("alt"), odd("ref"), F.when(C("gq") % 3 == 0, "LOW").otherwise("HIGH"), C("kind"))
    m = M.with_latent_mechanism(rows, "signals", "m", 0.3)
    return m.select("id", "kind", "m.mechanism", _r(C("m.te"), "te"), _r(C("m.non_te"), "non_te"), _r(C("m.artifact"), "artifact"), _r(C("m.activity"), "activity"), _r(C("m.lfdr"), "lfdr"), _r(C("m.worst_case_lfdr"), "worst"), "m.lfdr_qc")


def _latent_sql() -> str:
    u = lambda x: f"least(greatest({x}, 0), 1)"
    sat = lambda n, s: f"(CASE WHEN {n} > 0 THEN 1 - exp(-({n}) / {s}::DOUBLE) ELSE 0 END)"
    edge = lambda x: f"least(greatest({x}, 0.000001::DOUBLE), 0.999999::DOUBLE)"
    has = lambda words: " OR ".join(f"contains(name, '{w}')" for w in words)
    kinds = " ".join(f"WHEN {has(w)} THEN '{k}'" for k, w in M.FAMILY_WORDS.items())
    scores = []
    for state, (*signals, base) in M.LATENT.items():
        fit = " ".join(f"WHEN kind = '{k}' THEN {v}" for k, v in M.COMPATIBLE.get(state, {}).items())
        if state == "degraded_unknown_te":
            fit += " WHEN identity < 0.75 THEN 0.20"
        terms = [f"{base}::DOUBLE", f"{0.55 if state in M._ELEMENTS else -0.2}::DOUBLE * ln({edge('activity')} / (1 - {edge('activity')}))", f"CASE {fit} ELSE 0 END::DOUBLE" if fit else "0"]
        terms += [f"{st}::DOUBLE * ({me}::DOUBLE * ln({edge(n)}) + (1 - {me}::DOUBLE) * ln(1 - {edge(n)}))" for n, (me, st) in zip(("identity", "event", "independent", "quality", "artifact", "conflict"), signals, strict=True)]
        scores.append(" + ".join(terms) + f" AS s_{state}")
    te, null = [f"s_{n}" for n in M._ELEMENTS], [f"s_{n}" for n in M.LATENT if n not in M._ELEMENTS]
    total = " + ".join(f"exp({x})" for x in te + null)
    best = " ".join(f"WHEN {x} = greatest({', '.join(te + null)}) THEN '{x[2:]}'" for x in te + null)
    return f"""WITH e AS ({_E}), a AS (SELECT *, lower(['ALU', 'hAT-1', 'ERVK', 'unknown', 'Foo', 'L1HS'][(alt % 6 + 1)::INT]) AS fam, CASE WHEN ref % 2 = 0 THEN 'na' ELSE 'sub' END AS sub, split + indel + least(lclip, rclip) AS mech, lclip % 2 = 1 AS one FROM e),
        b AS (SELECT *, fam || ':' || sub AS name, sqrt({sat("mech", 4.0)} * CASE WHEN alt > 0 THEN {u("mech / alt")} ELSE 0 END) AS independent, {u("gq / 60")} AS quality, {u("ident")} AS identity,
          greatest(CASE WHEN alt + ref > 0 THEN ref / (alt + ref) ELSE 0 END, 0.6::DOUBLE * {sat("ref", 8.0)}, CASE WHEN one AND ref > 0 THEN 0.35::DOUBLE ELSE 0 END) AS conflict FROM a),
        c AS (SELECT *, CASE WHEN fam IN ('', 'unknown', 'na', 'none') AND sub = 'na' THEN 'unknown' {kinds} ELSE 'other' END AS kind, {u(f"0.35::DOUBLE * {sat('alt', 8.0)} + 0.3::DOUBLE * independent + 0.2::DOUBLE * {u('(margin * 4 - 1 + 1) / 3')} + 0.15::DOUBLE * {u('cov')}")} AS event,
          greatest(CASE WHEN gq > 3 THEN 0 ELSE 1 END, CASE split % 5 WHEN 0 THEN 1 WHEN 1 THEN 0.45 ELSE 0 END::DOUBLE, CASE WHEN indel % 2 <> 1 AND NOT one THEN 0.35 ELSE 0 END::DOUBLE, CASE WHEN indel % 2 = 1 AND alt % 2 <> 1 AND ref % 2 <> 1 THEN 0.5 ELSE 0 END::DOUBLE, CASE WHEN gq % 3 = 0 THEN 0.35 ELSE 0 END::DOUBLE, 0.8::DOUBLE * conflict) AS artifact FROM b),
        d AS (SELECT *, least(greatest(0.3::DOUBLE * identity + 0.25::DOUBLE * event + 0.2::DOUBLE * independent + 0.15::DOUBLE * quality + CASE WHEN kind = 'unknown' THEN 0 ELSE 0.1::DOUBLE END - 0.3::DOUBLE * artifact - 0.1::DOUBLE * conflict, 0.02::DOUBLE), 0.98::DOUBLE) AS activity FROM c),
        f AS (SELECT *, {", ".join(scores)} FROM d), g AS (SELECT *, {total} AS total, ({" + ".join(f"exp({x})" for x in te)}) * exp(-(0.95::DOUBLE + 2.6::DOUBLE * (1 - independent) + 0.75::DOUBLE * conflict)) AS wt, ({" + ".join(f"exp({x})" for x in null)}) * exp(0.95::DOUBLE + 1.65::DOUBLE * (1 - independent) + 0.55::DOUBLE * conflict) AS wn FROM f)
        SELECT id, kind, CASE {best} END AS mechanism, round(({" + ".join(f"exp({x})" for x in te)}) / total, 7) AS te, round(exp(s_non_te_insert) / total, 7) AS non_te, round(exp(s_artifact_reference) / total, 7) AS artifact, round(activity, 7) AS activity,
          round((exp(s_non_te_insert) + exp(s_artifact_reference)) / total, 7) AS lfdr, round(wn / (wt + wn), 7) AS worst, CASE WHEN wn / (wt + wn) <= 0.3::DOUBLE THEN 'PASS_TE_LFDR' ELSE 'TE_LFDR_HIGH' END AS lfdr_qc FROM g"""


# ---------------------------------------------------------------- loci


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "events").select("event_id", "user_id", "event_type", F.unix_seconds(F.date_trunc("second", "ts")).alias("pos"), "value")


def a1_density_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """A1 and A2 (U4 inside): events of a user as signals, a unit of position for 100 seconds."""
    e = _events(spark, sf).where("user_id IS NOT NULL").select("user_id", F.floor(C("pos") / 600).alias("p"), (50 + C("event_id") % 300).alias("len"), F.when(C("event_id") % 3 == 0, "split").otherwise("cigar").alias("source"), F.concat(F.lit("r"), C("event_id") % 50).alias("read"))
    return loci.describe_clusters(loci.density_clusters(e, "user_id", "p", "len", "source", "read", strong=3), "user_id", "p", "len", "source", "read")


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as calls: contig, ends and a score."""
    o = _read(spark, sf, "orders")
    left = F.datediff("o_orderdate", F.lit("1992-01-01")).cast("long") * 40 + C("o_orderkey") % 40
    return o.select(C("o_orderkey").alias("id"), (C("o_custkey") % 50).alias("contig"), left.alias("left"), (left + C("o_custkey") % 4 * 20).alias("right"), (C("o_orderkey") % 50).alias("score"), (C("o_orderkey") % 7 == 0).alias("promoted"), (C("o_orderkey") % 9).alias("cost"))


_CALLS = "SELECT o_orderkey AS id, o_custkey % 50 AS contig, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) * 40 + o_orderkey % 40 AS l, l + o_custkey % 4 * 20 AS r, o_orderkey % 50 AS score, o_orderkey % 7 = 0 AS promoted, o_orderkey % 9 AS cost FROM orders"


def w7_locus_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """One call of each locus."""
    return loci.one_of_each_locus(_calls(spark, sf), "contig", "left", "right", ["left", "right", "id"], [C("score")]).select("id", "contig", "left", "right", "score")


def j21_undominated(spark: SparkSession, sf: str) -> DataFrame:
    """J21 with J6 and J8."""
    return loci.undominated(_calls(spark, sf), "id", "contig", "left", "right", ["score"], ["cost"], "promoted").select("id")


def j20_null_p(spark: SparkSession, sf: str) -> DataFrame:
    """Each fifth order is a control of the others."""
    o = _read(spark, sf, "orders").select(C("o_orderkey").alias("id"), (C("o_custkey") % 50).cast("double").alias("a"), (C("o_orderkey") % 40).cast("double").alias("b"), (C("o_custkey") % 7).cast("double").alias("cost"), (C("o_orderkey") % 199).alias("ctx"))
    control = C("id") % 5 == 0
    return conformal.null_p_values(o.where(~control), o.where(control), ["a", "b"], "cost", "ctx").select("id", "n_null", "n_dominating", "n_support", F.round("p", 9).alias("p"))


def w6_selectors(spark: SparkSession, sf: str) -> DataFrame:
    """W6's rules in turn, over values that are distinct for distinct orders up to their period."""
    k = C("o_orderkey")
    u = (F.pmod(k * 7919, F.lit(10007)) + 1) / 10007.0
    v = (F.pmod(k * 104729, F.lit(10009)) + 1) / 10009.0
    o = _read(spark, sf, "orders").select(k.alias("id"), F.pow(u, 4).alias("p"), F.pow(v, 3).alias("lfdr"), (1 / (u * v)).alias("e"))
    return conformal.select_in_turn(o, "id", "p", "lfdr", "e", True, 0.3).select("id", "selected_by")


def _truth(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = _events(spark, sf).where("user_id IS NOT NULL")
    even = C("event_id") % 2 == 0
    calls = e.where(even).select(C("user_id").alias("contig"), C("event_id").alias("call"), "pos", C("event_type").alias("family"))
    return calls, e.where(~even).select(C("user_id").alias("contig"), C("event_id").alias("truth"), "pos", C("event_type").alias("family"))


def j15_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """J14's and J15's candidate pairs within the radius, counted by call."""
    calls, truth = _truth(spark, sf)
    return matching.point_pairs(calls, truth, 40_000).groupBy("call").agg(F.count("*").alias("n"), F.min("distance").alias("distance"))


def j15_one_to_one(spark: SparkSession, sf: str) -> DataFrame:
    calls, truth = _truth(spark, sf)
    return matching.match_one_to_one(calls, truth, 40_000)


def j14_unused(spark: SparkSession, sf: str) -> DataFrame:
    """Calls take truth in input order, not by distance."""
    calls, truth = _truth(spark, sf)
    return matching.match_unused(calls, truth, 40_000).select("call", "truth_pos", "distance")


def a19_call_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A19 over J15's one-to-one pairs."""
    calls, truth = _truth(spark, sf)
    return matching.call_scores(calls, truth, matching.match_one_to_one(calls, truth, 40_000))


def j17_stabbed(spark: SparkSession, sf: str) -> DataFrame:
    calls, truth = _truth(spark, sf)
    return matching.stabbed(truth.select("contig", C("truth").alias("point"), C("pos").alias("at"), "family"), calls.select("contig", (C("pos") - 30_000).alias("start"), (C("pos") + C("call") % 7 * 10_000).alias("end"), "family")).select("point", "covers", "same_family")


def j18_nearest_rows(spark: SparkSession, sf: str) -> DataFrame:
    calls, truth = _truth(spark, sf)
    return matching.nearest_rows(truth.select("contig", C("truth").alias("window"), C("pos").alias("start"), (C("pos") + 5000).alias("end")), calls.select("contig", C("call").alias("row"), C("pos").alias("start"), (C("pos") + C("call") % 5 * 1000).alias("end")), 50_000).select("window", "n_rows", "n_inside", "best", "distance")


def a21_summary(spark: SparkSession, sf: str) -> DataFrame:
    o = _read(spark, sf, "orders").select("o_orderpriority", (C("o_orderkey") % 3 == 0).alias("hit"), (C("o_custkey") % 100).alias("v"))
    got = matching.evaluation_summary(o, "o_orderpriority", "hit", ["v"])
    return got.select("o_orderpriority", C("overall").cast("int").alias("overall"), "n", "n_detected", _r(C("rate"), "rate"), "sum_v", _r(C("mean_v"), "mean_v"), "max_v")


def f57_sweep(spark: SparkSession, sf: str) -> DataFrame:
    e = _evidence(spark, sf)
    cuts = spark.range(1, 30).select((C("id") / 100).alias("threshold"))
    got = matching.threshold_sweep(e.withColumn("hit", C("alt") > C("ref")), "margin", "hit", cuts)
    return got.select("threshold", "emitted", "tp", _r(C("precision"), "precision"), _r(C("recall"), "recall"))


# ---------------------------------------------------------------- naming


def a13_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of an order as segments on three subjects. A bit is added before rounding, so that products that end in a half round alike."""
    li = _read(spark, sf, "lineitem")
    q = C("l_quantity").cast("long")
    h = li.select(C("l_orderkey").alias("query"), (C("l_suppkey") % 3).cast("string").alias("subject"), (C("l_discount") * 3 + 0.6).alias("identity"), (q * 3).alias("q_start"), (q * 3 + C("l_partkey") % 90).alias("q_end"), (1 + C("l_partkey") % 90).alias("length"), q.alias("bits"), C("l_tax").alias("e_value"))
    got = naming.subject_hits(h, li.select(C("l_orderkey").alias("query")).distinct().withColumn("query_length", F.lit(240).cast("long")))
    return got.select("query", "subject", _r(C("identity") + 3e-9, "identity"), _r(C("coverage") + 3e-9, "coverage"), _r(C("score") + 3e-9, "score"), "bits", _r(C("e_value"), "e_value"), "start", "end")


def a14_best_family(spark: SparkSession, sf: str) -> DataFrame:
    h = _read(spark, sf, "lineitem").select(C("l_orderkey").alias("query"), (C("l_suppkey") % 4).alias("family"), (C("l_partkey") % 9).alias("subfamily"), (C("l_quantity") % 10 / 10).cast("double").alias("score"))
    return naming.best_family(h).select("query", "family", "subfamily", _r(C("score"), "score"), "second_family", _r(C("second_score"), "second_score"), _r(C("margin"), "margin"), "ambiguous")


def a15_votes(spark: SparkSession, sf: str) -> DataFrame:
    from loomseq.jobs.evidence import BASES

    spell = lambda d, k, n: d.select(C(k).alias(n), F.translate(F.lower("text"), *BASES).alias("s"))
    got = naming.weighted_votes(spell(_read(spark, sf, "benchmark"), "item_id", "query"), spell(_read(spark, sf, "benchmark"), "item_id", "entry"), (9, 11))
    return got.select("query", "entry", _r(C("score"), "score"))


def a22_parents(spark: SparkSession, sf: str) -> DataFrame:
    q = C("l_quantity").cast("int")
    r = _read(spark, sf, "lineitem").select(C("l_suppkey").alias("candidate"), (C("l_partkey") % 3).cast("string").alias("source"), (C("l_orderkey") % 5).alias("read"), F.element_at(F.array(*map(F.lit, ("none", "ambiguous", "family", "exact"))), q % 4 + 1).alias("class"), q.alias("length"))
    return naming.parent_summary(r).select("candidate", "exact", "family", "ambiguous", F.array_join("sources", ",").alias("sources"))


def a10_communities(spark: SparkSession, sf: str) -> DataFrame:
    li = _read(spark, sf, "lineitem").groupBy(C("l_orderkey").alias("id"), (C("l_orderkey") % 700).alias("community")).agg(F.collect_set(C("l_suppkey").cast("string")).alias("names"), F.min(C("l_partkey") % 50).alias("ref"), F.min("l_partkey").alias("left"), F.max("l_partkey").alias("right"), F.max("l_discount").alias("identity"), F.max("l_tax").alias("coverage"), F.min("l_tax").alias("lfdr"), F.min(F.repeat(F.lit("A"), C("l_linenumber"))).alias("insert"))
    return naming.community_rows(li, "community").select("community", "rows", "alt", "ref", "start", "end", _r(C("identity"), "identity"), _r(C("coverage"), "coverage"), _r(C("lfdr"), "lfdr"), F.length("insert").cast("long").alias("insert_length"))


def a23_counters(spark: SparkSession, sf: str) -> DataFrame:
    c = _calls(spark, sf)
    reads = c.select("contig", C("left").alias("start"), (C("left") + 100 + C("score") * 9).alias("end"), (C("cost") * 4).cast("int").alias("flag"), (C("score") % 61).alias("mapq"), (C("score") % 5).alias("insertion"), (C("cost") % 3).alias("clip"))
    sites = c.select("contig", C("id").alias("site"), C("left").alias("pos"))
    return naming.local_counters(sites, reads).select("site", "depth", "reverse", "inserted", C("longest").cast("long").alias("longest"), "clipped", "spanning", "spanning_low")


# ---------------------------------------------------------------- sets and tables


def k_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """K1, K6, K9, K12, U1, U2."""
    li = _read(spark, sf, "lineitem")
    r = sets.ranked_hypotheses(li.select("l_orderkey", "l_linenumber", C("l_quantity").cast("long").alias("support"), (C("l_suppkey") % 7).alias("priority"), (C("l_partkey") % 90).alias("left"), (C("l_partkey") % 90 + 5).alias("right"), F.lit(40).alias("anchor")), "l_orderkey", "support", "priority", "left", "right", "anchor")
    return r.where("rank <= 2").select("l_orderkey", "rank", "score", "support", "left")


def k_picks(spark: SparkSession, sf: str) -> DataFrame:
    li = _read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (C("l_quantity").cast("long") * 10 + C("l_linenumber")).alias("length"), (C("l_partkey") * 20).alias("pos"), F.lit(1500).alias("start"), F.lit(1600).alias("end"))
    return sets.insertion_pick(li, "l_orderkey", "length", "pos", "start", "end").select("l_orderkey", "l_linenumber")


def k12_top_groups(spark: SparkSession, sf: str) -> DataFrame:
    return sets.top_groups(_read(spark, sf, "lineitem").withColumn("q", C("l_quantity").cast("long")), "l_suppkey", "q", 30)


def u_names(spark: SparkSession, sf: str) -> DataFrame:
    o = _read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.concat(F.lit(" s"), C("l_suppkey") % 9)).alias("a"), F.collect_list(F.concat(F.lit("s"), C("l_partkey") % 9)).alias("b"))
    clean = o.select("l_orderkey", sets.names_union(C("a")).alias("a"), sets.names_union(C("b")).alias("b"))
    return clean.select("l_orderkey", F.array_join(sets.names_union(C("a"), C("b")), ",").alias("names"), _r(sets.jaccard(C("a"), C("b")), "jaccard"))


CALL_COLUMNS = ["id", "contig", "left", "right", "score", "share", "promoted", "names"]


def s20_call_table(spark: SparkSession, sf: str) -> DataFrame:
    """Calls written as a table with its column order and read back."""
    c = _calls(spark, sf).withColumns({"share": F.when(C("score") % 3 > 0, C("score") / 50), "names": F.sequence(F.lit(1), C("cost") + 1), "contig": F.concat(F.lit("chr"), C("contig"))})
    path = new_path(spark, "calls")
    tables.write_table(c, path, CALL_COLUMNS, {"schema_version": 1, "rows": "all"})
    back = tables.read_back(spark, path, CALL_COLUMNS)
    return back.select(C("id").cast("long").alias("id"), "contig", C("left").cast("long").alias("left"), C("right").cast("long").alias("right"), C("score").cast("long").alias("score"), tables.number(C("share")).alias("share"), (C("promoted") == "1").alias("promoted"), C("names").cast("long").alias("n_names"))


def s22_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return tables.coverage_rows(_evidence(spark, sf), "ls", "re").select("id", "coverage_start", "coverage_end")


def s23_controls(spark: SparkSession, sf: str) -> DataFrame:
    e = _evidence(spark, sf).select("id", C("alt").alias("score"), F.when(C("split") == 0, "shift").otherwise("sample_local").alias("kind"))
    return tables.control_rows(e.where("id % 3 = 0"), e.where("id % 3 <> 0"), "kind", "score").select("id", "row_kind", "score", _r(C("tail"), "tail", 9))


def s17_truth(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a truth table with a preamble, parsed and filtered."""
    o = _read(spark, sf, "orders")
    k = C("o_orderkey")
    body = o.select(F.concat_ws("\t", F.concat(F.lit("chr"), C("o_custkey") % 5), k, (C("o_custkey") * 3).cast("string"), F.when(k % 4 == 0, "PASS").otherwise("LOW"), F.when(k % 7 == 0, "NA").otherwise("L1"), F.when(k % 9 == 0, ".").otherwise((k % 600).cast("string"))).alias("value"))
    head = spark.createDataFrame([("# made",), ("rows\tmany",), ("contig\tstart\tend\tFilter\tfamily\tlength",)], "value string")
    return tables.truth_rows(tables.parse_table(head.unionByName(body), ["contig", "Filter"]), "PASS", 50)


def s18_children(spark: SparkSession, sf: str) -> DataFrame:
    o = _read(spark, sf, "orders")
    k = C("o_orderkey")
    t = o.select(F.concat(F.lit("c"), C("o_custkey") % 5).alias("contig"), k.cast("string").alias("pos"), F.when(k % 3 == 0, "").otherwise("ALU").alias("family"), (k % 10).cast("string").alias("support"), F.when(k % 4 == 0, "-1").otherwise((k + 7).cast("string")).alias("bp_left"), (k - 5).cast("string").alias("bp_right"))
    return tables.child_candidates(t, 3, 40)


def s14_best_hits(spark: SparkSession, sf: str) -> DataFrame:
    o = _read(spark, sf, "orders")
    k = C("o_orderkey")
    line = F.concat_ws("\t", F.concat(F.lit("q"), k, F.lit("|x")), F.when(k % 6 == 0, "L1").otherwise(F.concat(F.lit("L1:P"), k % 5)), F.when(k % 10 == 0, "bad").otherwise((k % 100).cast("string")), (k % 7).cast("string"))
    return tables.best_hits(o.select(line.alias("value")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p_support_predicates, p_outcomes, f28_boundary, f31_segmentation, f38_posterior, f40_certificate, f35_structure, f39_latent, a1_density_clusters, w7_locus_dedup, j21_undominated, j20_null_p, w6_selectors, j15_pairs, j15_one_to_one,
        j14_unused, a19_call_scores, j17_stabbed, j18_nearest_rows, a21_summary, f57_sweep, a13_hits, a14_best_family, a15_votes, a22_parents, a10_communities, a23_counters, k_ranks, k_picks, k12_top_groups, u_names, s20_call_table, s22_coverage, s23_controls,
        s17_truth, s18_children, s14_best_hits,
    )
}

_Q = "CAST(floor(l_quantity) AS BIGINT)"
_EVT = "SELECT event_id, user_id AS u, event_type AS t, CAST(floor(epoch(ts)) AS BIGINT) AS pos FROM events WHERE user_id IS NOT NULL"
_CT = f"ev AS ({_EVT}), c AS (SELECT event_id AS call, u, pos, t FROM ev WHERE event_id % 2 = 0), h AS (SELECT event_id AS truth, u, pos, t FROM ev WHERE event_id % 2 <> 0)"
_GREEDY = f"""{_CT}, p AS (SELECT c.u, call, truth, abs(c.pos - h.pos) AS distance, row_number() OVER (PARTITION BY c.u ORDER BY abs(c.pos - h.pos), call, truth) AS n FROM c JOIN h ON c.u = h.u AND abs(c.pos - h.pos) <= 40000),
 g AS (SELECT DISTINCT u, 0::BIGINT AS n, NULL::BIGINT AS call, NULL::BIGINT AS truth, NULL::BIGINT AS distance, []::BIGINT[] AS uc, []::BIGINT[] AS ut, false AS take FROM p
  UNION ALL SELECT p.u, p.n, p.call, p.truth, p.distance, CASE WHEN k THEN list_append(g.uc, p.call) ELSE g.uc END, CASE WHEN k THEN list_append(g.ut, p.truth) ELSE g.ut END, k
  FROM g JOIN p ON p.u = g.u AND p.n = g.n + 1, LATERAL (SELECT NOT list_contains(g.uc, p.call) AND NOT list_contains(g.ut, p.truth) AS k)),
 m AS (SELECT call, truth, distance FROM g WHERE take)"""


def _cs(n: str, s: int) -> str:
    return f"(CASE WHEN {n} > 0 THEN 1 - exp(-({n}) / {s}.0::DOUBLE) ELSE 0 END)"


def _clamp(x: str, lo, hi) -> str:
    return f"least(greatest({x}, {lo}), {hi})"


def _sig(x: str) -> str:
    return f"(1 / (1 + exp(-{_clamp(x, -40, 40)})))"


_SCORE31 = f"""0.5 * {_clamp("((CASE WHEN one THEN greatest(ll, rl) ELSE least(ll, rl) END) - 50) / 25.0", -2, 2)} + 0.5 * {_clamp("((CASE WHEN NOT one THEN least(li, ri) WHEN ll > 0 THEN li ELSE ri END) - 0.90) / 0.05", -2, 2)}
 - (CASE WHEN one THEN 0.5 WHEN ll <= 0 OR rl <= 0 THEN 1.0 ELSE 0.0 END) - (CASE WHEN passed THEN 0 ELSE 1.5 END)"""

ORACLES: dict[str, str] = {
    "p_support_predicates": f"""WITH e AS ({_E}), s AS (SELECT *, CASE WHEN ls >= 0 AND le >= 0 THEN least(ls, le) ELSE ls END AS al, CASE WHEN ls >= 0 AND le >= 0 THEN greatest(ls, le) ELSE ls END AS ar, CASE WHEN rs >= 0 AND re >= 0 THEN least(rs, re) ELSE rs END AS bl, CASE WHEN rs >= 0 AND re >= 0 THEN greatest(rs, re) ELSE rs END AS br FROM e)
        SELECT id, gq = 60 AS p2, alt > 3 AND gq > 0 AND (gq < 20 OR (ref >= 2 AND (ref - 2) / gq > 0.12)) AS p4, ls >= 100 AND ls < 200 AS p5, ls >= 0 AND rs >= 0 AND re >= 0 AND ls >= least(rs, re) - 25 AND ls <= greatest(rs, re) + 25 AS p6,
        gq = 7 OR split > 0 OR (lclip > 0 AND rclip > 0 AND alt >= 2) OR ((lclip > 0) <> (rclip > 0) AND greatest(lclip, rclip) >= 3 AND alt >= 3 AND alt >= 2 * greatest(ref, 1)) AS p7, split > 0 OR indel > 0 OR lclip > 0 AS p8, {_PARTIAL} AS p9,
        CASE WHEN NOT (lclip > 0 AND rclip > 0) AND NOT {_CONTEXT} THEN 'VALIDATOR_NO_BILATERAL_ANCHOR' WHEN NOT {_CONTEXT} AND NOT {_PARTIAL} THEN 'VALIDATOR_NO_PRECISE_OR_FULL_CONTEXT' ELSE 'VALIDATOR_PASS' END AS p10,
        CASE WHEN NOT (lclip > 0 AND rclip > 0) THEN 'PRESEG_NO_BILATERAL_ANCHOR' WHEN NOT {_CONTEXT} AND NOT {_PARTIAL} THEN 'PRESEG_NO_PRECISE_OR_FULL_CONTEXT' ELSE '' END AS p11, alt > 5 AND ref <= 9 AND split + indel > 2 AS p13,
        greatest(floor(ls / 64), 0)::BIGINT AS h19, greatest(least(le, re) - greatest(ls, rs), 0) AS h4, least(al, ar, bl, br) >= 0 AND greatest(bl - ar, al - br, 0) <= CASE WHEN ar > al AND br > bl THEN 0 ELSE 50 END AS j8 FROM s""",
    "p_outcomes": f"""WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS id, {_Q} AS q, l_discount, l_tax, l_partkey AS a, l_suppkey AS b, ['ALUYa5', 'SVA_F', 'L1HS', 'HERV-K', 'none', 'Tigger1/DNA', '.'][{_Q} % 7 + 1] AS f FROM lineitem),
        s AS (SELECT *, CASE WHEN q % 4 = 3 OR q % 3 > 0 THEN 'PARENT_VETO' WHEN q % 5 > 1 THEN 'REVIEW' ELSE 'PASS' END AS p23 FROM l)
        SELECT id, q > 10 AND q % 2 <> 0 AND q % 3 <> 0 AS p18, q % 3 = 0 AND q % 2 = 0 AND q > 5 AS p21, p23, (p23 = 'PASS')::INTEGER AS p23_passed, (l_discount * 4 + 0.6) * (l_tax + 0.76) * (q * 160) >= 3500 AND l_tax + 0.76 >= 0.8 AS p29,
        CASE WHEN f IN ('none', '.') THEN '' ELSE lower(regexp_extract(f, '^[^/:-]*')) END AS f54, ['ALU', 'SVA', 'LINE1', 'ERV', 'NONE', 'TIGGER1', '.'][q % 7 + 1] AS f54_trio, greatest(least(a, b) - 10, 1) AS f56_start, least(greatest(a, b) + 10, 120) AS f56_end FROM s""",
    "f28_boundary": f"""WITH e AS ({_E}), {_B} SELECT id, defined, canonical, canonical OR held AS consistent, CASE WHEN held THEN 'NONCANONICAL' ELSE kind END AS type, CASE WHEN held OR canonical THEN abs(d) END AS length,
        CASE WHEN held THEN 'PASS_BOUNDARY_NONCANONICAL_CONSISTENT' WHEN kind = 'TSD' THEN 'PASS_BOUNDARY_TSD' WHEN kind = 'BLUNT' THEN 'PASS_BOUNDARY_BLUNT' WHEN kind = 'SMALL_DEL' THEN 'PASS_BOUNDARY_SMALL_DEL' WHEN missing THEN 'REJECT_BOUNDARY_MISSING_REF_SEGMENTS' WHEN invalid THEN 'REJECT_BOUNDARY_INVALID_REF_SEGMENTS' WHEN d < 0 THEN 'REJECT_BOUNDARY_TSD_RANGE' ELSE 'REJECT_BOUNDARY_DEL_RANGE' END AS qc,
        round(CASE kind WHEN 'TSD' THEN 1.2::DOUBLE - 0.5 * pow((ln(abs(d)) - ln(12)) / 0.7::DOUBLE, 2) WHEN 'BLUNT' THEN 1 WHEN 'SMALL_DEL' THEN {_clamp('0.8::DOUBLE - abs(d) / 80', 0.2, 0.8)} ELSE CASE WHEN held THEN 0.25 ELSE -2 END END, 7) AS score FROM b3""",
    "f31_segmentation": f"WITH e AS ({_E}) SELECT id, one AS one_sided, round({_SCORE31}, 7) AS score FROM {_SEG}",
    "f38_posterior": f"""WITH e0 AS ({_E}), e AS (SELECT * FROM e0), {_B}, s0 AS (SELECT *, indel > 0 AS passed, split > 0 AS ins, lclip * 20 AS ll, rclip * 25 AS rl, ident AS li, 1 - margin AS ri, indel > 0 AND split > 0 AND ((lclip > 0) <> (rclip > 0)) AS one, canonical OR held AS consistent FROM b3),
        s1 AS (SELECT *, {_clamp(_SCORE31, -2, 2)} AS seg, {_clamp(f"0.65 * {_clamp('ln(alt + 1) - ln(ref + 1)', -2, 2)} + 0.45 * {_clamp('ln(split + indel + least(lclip, rclip) + 1)', 0, 2)} + {_clamp('(gq - 20) / 40.0', 0, 1.5)}", -2, 3)} AS st, margin * 8 - 1 AS seq, lclip > 0 AND rclip > 0 AND defined AND consistent AS closed, alt % 3 = 0 AS unk FROM s0),
        s2 AS (SELECT *, CASE WHEN closed THEN 1 WHEN one AND ins THEN -0.35 WHEN defined AND consistent THEN 0.25 ELSE -1 END AS edge, (CASE WHEN ins THEN 0 ELSE 1.6 END) + (CASE WHEN one THEN 1.1 ELSE 0 END) + (CASE WHEN NOT defined OR NOT consistent THEN 0.9 ELSE 0 END) + (CASE WHEN split + indel + least(lclip, rclip) = 0 THEN 0.5 ELSE 0 END) + least(1, 0.08 * ref)
          + (CASE WHEN unk THEN 0.45 * {_clamp('(0.62 - ident) / 0.16', 0, 1)} + 0.20 * {_clamp('(0.90 - cov) / 0.40', 0, 1)} + 0.15 * {_clamp('(0.05 - margin) / 0.05', 0, 1)} + (CASE ref % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.2 ELSE 0 END) ELSE 0 END) AS ctx FROM s1),
        s3 AS (SELECT *, -0.25 + st + 0.75 * seg + seq + edge - 0.35 * ctx AS t, 0.10 + 0.85 * st + 0.60 * seg - 0.75 * seq + (CASE WHEN ins THEN 0.25 ELSE -0.75 END) AS o, -0.10 + ctx - 0.25 * st - 0.15 * seg - 0.35 * greatest(seq, 0) AS a FROM s2),
        s4 AS (SELECT *, exp(t) + exp(o) + exp(a) AS z FROM s3)
        SELECT id, round(exp(t) / z, 7) AS te, round(exp(o) / z, 7) AS other, round(exp(a) / z, 7) AS artifact, CASE WHEN abs(exp(t) / z - 0.65) < 1e-7 OR abs(exp(t) / z - 0.72) < 1e-7 THEN NULL
          WHEN exp(t) / z >= (CASE WHEN closed THEN 0.65 ELSE 0.72 END) AND t - a >= (CASE WHEN closed THEN 0.75 ELSE 1.25 END) AND t - o >= (CASE WHEN unk THEN 0.55 ELSE 0.25 END) THEN 'PASS_TE_POSTERIOR' ELSE '' END AS qc FROM s4""",
    "f40_certificate": f"""WITH e AS ({_E}), a AS (SELECT *, split + indel + least(lclip, rclip) AS m FROM e), b AS (SELECT *, CASE WHEN alt > 0 AND m > 0 THEN sqrt({_cs('m', 4)} * least(m / greatest(alt, 1), 1)) ELSE 0 END AS i,
          least(1, greatest(CASE WHEN alt + ref > 0 THEN ref / (alt + ref) ELSE 0 END, 0.6 * {_cs('ref', 8)}, CASE WHEN split = 1 AND ref > 0 THEN 0.35 ELSE 0 END)) AS r FROM a),
        c AS (SELECT *, {_clamp(f"0.45 * {_cs('alt', 8)} + 0.3 * i + 0.15 * least(gq / 60.0, 1) + 0.1 * margin", 0, 1)} AS ev, {_clamp('ident * 9 - 5', -4, 5)} AS t FROM b),
        d AS (SELECT *, -0.75 + 3 * ev - 2.2 * r AS le1, -1 + 4 * i - 1.2 * r AS li1, -1.4 + 4.2 * cov - 0.3 AS lq, -0.7 + 2.4 * margin - 0.7 * r AS lb, -3 * r - 0.24 AS lr FROM c),
        f AS (SELECT *, le1 + li1 + lq + 0.9 * t + lb + lr - 0.65 AS v, 0.4 * le1 + 0.7 * li1 + lq + 0.9 * t + 0.85 * lb + 0.35 * lr - 0.39 AS w, (0.55 - 0.3 * ev + 0.75 - 0.45 * i + 0.65 - 0.4 * cov + 0.4 + 0.55 - 0.35 * margin + 0.2 + 0.5 * r) / 6 AS am FROM d),
        g AS (SELECT *, 1.25 / (1.25 + exp({_clamp('least(v, w) - am', -60, 60)}) * {_clamp('0.05 * (1 - 0.7 * 0.3)', 0.005, 0.05)}) AS lf FROM f)
        SELECT id, round(ev, 7) AS event, round(i::DOUBLE, 7) AS independent, round(r::DOUBLE, 7) AS conflict, round(v, 7) AS vs_artifact, round(w, 7) AS vs_other, round(am, 7) AS ambiguity, round({_clamp('0.35 * i + 0.25 * ev + 0.25 * margin + 0.15 * cov', 0, 1)}, 7) AS support, round(lf, 7) AS lfdr, CASE WHEN abs(lf - 0.1) <= 1e-9 THEN NULL WHEN lf <= 0.1 THEN 'PASS_TE_LFDR' ELSE 'TE_LFDR_HIGH' END AS qc FROM g""",
    "f35_structure": f"""WITH e AS ({_E}), a AS (SELECT *, alt * 30 + 60 AS n, greatest(least(round((alt * 30 + 60) * cov), alt * 30 + 60), 1) AS core FROM e), b AS (SELECT *, least(lclip * 4, n - core) AS poly FROM a), c AS (SELECT *, n - core - poly AS rest FROM b),
        d AS (SELECT *, {_sig('1.28 * poly - 3')} AS pp, {_sig('0.06 * rest * (ident - 0.55) - 1.6 + 0.6 * ident')} AS tp, margin / 2 AS hard, CASE WHEN alt + ref > 0 THEN alt / (alt + ref) ELSE 0 END AS af FROM c)
        SELECT id, core::BIGINT AS core, poly::BIGINT AS poly, rest::BIGINT AS rest, round(pp, 7) AS poly_p, round(tp, 7) AS trans_p,
          round(-1.1 + 2 * ident + 2.45 * cov + 0.55 * least(4 * margin, 1) + 0.55 * pp + 0.35 * tp + (CASE ref % 4 WHEN 0 THEN 0.35 + 0.25 * cov WHEN 1 THEN -0.15 WHEN 2 THEN -0.85 ELSE 0 END) - 1.25 * hard - 0.55 * margin / 2 - (CASE alt % 3 WHEN 0 THEN 0.45 WHEN 1 THEN 0 ELSE 0.25 END) - (CASE WHEN split > 0 THEN 0 ELSE 2 END), 7) AS te,
          round(-0.25 + 1.65 * hard + 0.75 * margin - 1.25 * cov - 0.85 * ident - 0.25 * pp, 7) AS other, round(-0.10 + 1.10 * margin / 2 + (CASE ref % 4 WHEN 2 THEN 1.25 ELSE 0 END) + (CASE alt % 3 WHEN 1 THEN 0.65 ELSE 0 END) - 0.95 * cov - 0.75 * ident, 7) AS artifact,
          round((1 - least(abs(af - 0.5) / 0.5, 1)) * ln(1 + least(alt, ref)), 7) AS het,
          round(alt + 8 * cov + 4 * (1 - margin) + 6 * (1 - margin) + 3 * ident + 3 * cov + 2 * margin - 1.5 * ref - 10 * margin + (CASE WHEN split > 0 THEN 6 ELSE 0 END) + (CASE WHEN indel > 0 THEN 4 ELSE 0 END) + (CASE WHEN lclip > 0 THEN 2 ELSE 0 END), 7) AS promotion FROM d""",
    "f39_latent": _latent_sql(),
    "a1_density_clusters": """WITH RECURSIVE s AS (SELECT user_id, p, len, source, read, row_number() OVER (PARTITION BY user_id ORDER BY p, len, event_id) AS n FROM (SELECT event_id, user_id, CAST(floor(floor(epoch(ts)) / 600) AS BIGINT) AS p, 50 + event_id % 300 AS len, CASE WHEN event_id % 3 = 0 THEN 'split' ELSE 'cigar' END AS source, 'r' || (event_id % 50) AS read FROM events WHERE user_id IS NOT NULL)),
        e AS (SELECT a.user_id, a.n AS a, b.n AS b FROM s a JOIN s b ON a.user_id = b.user_id AND abs(a.p - b.p) < 500 AND sqrt(2.0 * (a.p - b.p) * (a.p - b.p) + (a.len - b.len) * (a.len - b.len)) < CASE WHEN a.source = 'cigar' AND b.source = 'cigar' THEN 250 ELSE 500 END),
        k AS (SELECT user_id, a AS n FROM e GROUP BY ALL HAVING count(*) >= 3),
        ke AS (SELECT e.* FROM e JOIN k x ON x.user_id = e.user_id AND x.n = e.a JOIN k y ON y.user_id = e.user_id AND y.n = e.b),
        r AS (SELECT user_id, n, n AS low FROM k UNION SELECT ke.user_id, ke.b, r.low FROM r JOIN ke ON ke.user_id = r.user_id AND ke.a = r.n WHERE r.low < ke.b),
        c AS (SELECT user_id, n, min(low) AS low FROM r GROUP BY ALL),
        d AS (SELECT e.user_id, e.a AS n, max(c.low) AS low FROM e JOIN c ON c.user_id = e.user_id AND c.n = e.b WHERE NOT EXISTS (FROM k WHERE k.user_id = e.user_id AND k.n = e.a) GROUP BY ALL),
        f AS (FROM c UNION ALL FROM d), o AS (SELECT user_id, n FROM s WHERE NOT EXISTS (FROM f WHERE f.user_id = s.user_id AND f.n = s.n)),
        oe AS (SELECT e.* FROM e JOIN o x ON x.user_id = e.user_id AND x.n = e.a JOIN o y ON y.user_id = e.user_id AND y.n = e.b),
        q AS (SELECT user_id, n, n AS low FROM o UNION SELECT oe.user_id, oe.b, q.low FROM q JOIN oe ON oe.user_id = q.user_id AND oe.a = q.n WHERE q.low < oe.b),
        g AS (SELECT user_id, n, 'c' || low AS cl FROM f UNION ALL SELECT user_id, n, 'o' || min(low) FROM q GROUP BY user_id, n)
        SELECT user_id, min(p) AS start, max(p) + 1 AS "end", list_sort(list(p))[count(*) // 2 + 1] AS anchor, count(*) AS signals, count(DISTINCT read) AS reads, count(DISTINCT read) FILTER (source = 'cigar') AS cigar_reads, count(DISTINCT read) FILTER (source = 'split') AS split_reads, 0::BIGINT AS clip_reads, max(len) AS longest FROM s JOIN g USING (user_id, n) GROUP BY user_id, cl""",
    "w7_locus_dedup": f"""WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY l, r, id) AS n FROM ({_CALLS})),
        h AS (SELECT contig, n, l AS hl, r AS hr, n AS head FROM c WHERE n = 1 UNION ALL
          SELECT c.contig, c.n, CASE WHEN apart THEN c.l ELSE hl END, CASE WHEN apart THEN c.r ELSE hr END, CASE WHEN apart THEN c.n ELSE head END FROM h JOIN c ON c.contig = h.contig AND c.n = h.n + 1, LATERAL (SELECT greatest(c.l - hr, hl - c.r, 0) > CASE WHEN hr > hl AND c.r > c.l THEN 0 ELSE 50 END AS apart)),
        b AS (SELECT c.*, row_number() OVER (PARTITION BY contig, head ORDER BY score DESC, l, r, id) AS k FROM c JOIN h USING (contig, n)) SELECT id, contig, l AS "left", r AS "right", score FROM b WHERE k = 1""",
    "j21_undominated": f"""WITH c AS ({_CALLS}) SELECT id FROM c WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.contig = c.contig AND d.id <> c.id AND greatest(d.l - c.r, c.l - d.r, 0) <= CASE WHEN c.r > c.l AND d.r > d.l THEN 0 ELSE 50 END
        AND d.score >= c.score AND d.cost <= c.cost AND (d.score > c.score OR d.cost < c.cost) AND NOT (d.promoted AND NOT c.promoted))""",
    "j20_null_p": """WITH l AS (SELECT o_orderkey AS id, o_custkey % 50 AS a, o_orderkey % 40 AS b, o_custkey % 7 AS cost, o_orderkey % 199 AS ctx, o_orderkey % 5 = 0 AS ctl FROM orders), n AS (FROM l WHERE ctl), k AS (SELECT ctx, count(*) AS m FROM n GROUP BY ctx HAVING count(*) >= 12),
        c AS (SELECT l.*, k.m, coalesce(k.m, (SELECT count(*) FROM n)) AS n_null FROM l LEFT JOIN k USING (ctx) WHERE NOT ctl),
        d AS (SELECT c.id, n_null, count(*) FILTER (n.a >= c.a AND n.b >= c.b AND n.cost <= c.cost) AS n_dominating, count(*) FILTER (n.a >= c.a) AS n_support FROM c LEFT JOIN n ON c.m IS NULL OR n.ctx = c.ctx GROUP BY ALL)
        SELECT id, n_null, n_dominating, n_support, round(greatest(1 + n_dominating, 1 + n_support) / (1 + n_null), 9) AS p FROM d""",
    "w6_selectors": """WITH o AS (SELECT o_orderkey AS id, ((o_orderkey * 7919) % 10007 + 1) / 10007.0::DOUBLE AS u, ((o_orderkey * 104729) % 10009 + 1) / 10009.0::DOUBLE AS v FROM orders), a AS (SELECT id, pow(u, 4) AS p, pow(v, 3) AS lfdr, 1 / (u * v) AS e FROM o),
        hm AS (SELECT sum(1.0::DOUBLE / i) AS h, count(*) AS m FROM (SELECT unnest(generate_series(1, (SELECT count(*) FROM a))) AS i)), r AS (SELECT p, row_number() OVER (ORDER BY p) AS k FROM a),
        s1 AS (SELECT id FROM a WHERE p <= (SELECT max(r.p) FROM r, hm WHERE r.p <= k * 0.3::DOUBLE / (m * h))), a2 AS (SELECT * FROM a WHERE id NOT IN (FROM s1)), r2 AS (SELECT e, row_number() OVER (ORDER BY e DESC) AS k, count(*) OVER () AS m FROM a2),
        s2 AS (SELECT id FROM a2 WHERE e >= (SELECT min(e) FROM r2 WHERE e * 0.3::DOUBLE * k >= m)), a3 AS (SELECT * FROM a2 WHERE id NOT IN (FROM s2)),
        r3 AS (SELECT id, row_number() OVER w AS k, avg(lfdr) OVER (w ROWS UNBOUNDED PRECEDING) AS mean FROM a3 WINDOW w AS (ORDER BY lfdr, id)), s3 AS (SELECT id FROM r3 WHERE k <= (SELECT max(k) FROM r3 WHERE mean <= 0.3 + 1e-9))
        SELECT id, CASE WHEN id IN (FROM s1) THEN 'conformal' WHEN id IN (FROM s2) THEN 'e_values' WHEN id IN (FROM s3) THEN 'bayes' END AS selected_by FROM a""",
    "j15_pairs": f"WITH {_CT} SELECT call, count(*) AS n, min(abs(c.pos - h.pos)) AS distance FROM c JOIN h ON c.u = h.u AND abs(c.pos - h.pos) <= 40000 GROUP BY call",
    "j15_one_to_one": f"WITH RECURSIVE {_GREEDY} SELECT call, truth, distance FROM m",
    "j14_unused": f"""WITH RECURSIVE {_CT}, t AS (SELECT u, list(DISTINCT pos ORDER BY pos) AS ps FROM h GROUP BY u), o AS (SELECT u, call, pos, row_number() OVER (PARTITION BY u ORDER BY call) AS n FROM c),
        g AS (SELECT u, 0::BIGINT AS n, NULL::BIGINT AS call, NULL::BIGINT AS hit, NULL::BIGINT AS distance, []::BIGINT[] AS used FROM t
          UNION ALL SELECT o.u, o.n, o.call, x.hit, abs(o.pos - x.hit), CASE WHEN x.hit IS NULL THEN g.used ELSE list_append(g.used, x.hit) END FROM g JOIN o ON o.u = g.u AND o.n = g.n + 1 JOIN t ON t.u = g.u,
          LATERAL (SELECT len(list_filter(t.ps, lambda p: p < o.pos)) AS k) y,
          LATERAL (SELECT list_filter(t.ps[greatest(1, y.k - 1):y.k + 2], lambda p: NOT list_contains(g.used, p) AND abs(p - o.pos) <= 40000) AS near) z,
          LATERAL (SELECT list_filter(z.near, lambda p: abs(p - o.pos) = list_min(list_transform(z.near, lambda r: abs(r - o.pos))))[1] AS hit) x)
        SELECT call, hit AS truth_pos, distance FROM g WHERE hit IS NOT NULL""",
    "a19_call_scores": f"""WITH RECURSIVE {_GREEDY}, x AS (SELECT count(*) AS tp, count(*) FILTER (c.t = h.t) AS ok, median(distance) AS median_error FROM m JOIN c USING (call) JOIN h USING (truth)), y AS (SELECT (SELECT count(*) FROM c) AS emitted, (SELECT count(*) FROM h) AS n)
        SELECT emitted, tp, emitted - tp AS fp, n - tp AS fn, tp / emitted AS precision, tp / n AS recall, 2 * (tp / emitted) * (tp / n) / (tp / emitted + tp / n) AS f1, tp AS family_committed, ok AS family_correct, tp - ok AS family_wrong, ok / tp AS concordance, tp / tp AS commit_rate, median_error FROM x, y""",
    "j17_stabbed": f"WITH {_CT} SELECT truth AS point, count(call) AS covers, coalesce(bool_or(c.t = h.t), false) AS same_family FROM h LEFT JOIN c ON c.u = h.u AND h.pos BETWEEN c.pos - 30000 AND c.pos + c.call % 7 * 10000 GROUP BY truth",
    "j18_nearest_rows": f"""WITH {_CT}, p AS (SELECT truth, call, greatest(c.pos - (h.pos + 5000), h.pos - (c.pos + c.call % 5 * 1000), 0) AS d FROM h JOIN c USING (u)), q AS (SELECT truth, count(*) AS n, count(*) FILTER (d = 0) AS i, arg_min(call, (d, call)) AS best, min(d) AS d FROM p WHERE d <= 50000 GROUP BY truth)
        SELECT truth AS "window", coalesce(n, 0) AS n_rows, coalesce(i, 0) AS n_inside, best, d AS distance FROM h LEFT JOIN q USING (truth)""",
    "a21_summary": """SELECT o_orderpriority, grouping(o_orderpriority)::INTEGER AS overall, count(*) AS n, count(*) FILTER (o_orderkey % 3 = 0) AS n_detected, round(count(*) FILTER (o_orderkey % 3 = 0) / count(*), 7) AS rate, sum(o_custkey % 100)::BIGINT AS sum_v, round(avg(o_custkey % 100), 7) AS mean_v, max(o_custkey % 100) AS max_v FROM orders GROUP BY ROLLUP (o_orderpriority)""",
    "f57_sweep": f"""WITH e AS ({_E}), t AS (SELECT i / 100 AS threshold FROM (SELECT unnest(generate_series(1, 29)) AS i)) SELECT threshold, count(*) AS emitted, count(*) FILTER (alt > ref) AS tp, round(count(*) FILTER (alt > ref) / count(*), 7) AS precision, round(count(*) FILTER (alt > ref) / (SELECT count(*) FROM e WHERE alt > ref), 7) AS recall FROM t JOIN e ON margin <= threshold GROUP BY threshold""",
    "a13_hits": f"""WITH h AS (SELECT l_orderkey AS query, (l_suppkey % 3)::VARCHAR AS subject, l_discount * 3 + 0.6 AS identity, {_Q} * 3 AS s, {_Q} * 3 + l_partkey % 90 AS e, 1 + l_partkey % 90 AS n, {_Q} AS bits, l_tax AS ev FROM lineitem),
        d AS (SELECT DISTINCT query, subject, s, e FROM h WHERE e > s), w AS (SELECT *, max(e) OVER (PARTITION BY query, subject ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM d), u AS (SELECT query, subject, sum(greatest(e - greatest(s, coalesce(reach, s)), 0)) AS c FROM w GROUP BY ALL),
        g AS (SELECT query, subject, sum(identity * n) / sum(n) AS identity, sum(bits)::BIGINT AS bits, min(ev) AS e_value, min(s) AS start, max(e) AS "end" FROM h GROUP BY ALL)
        SELECT query, subject, round(identity + 3e-9, 7) AS identity, round(least(coalesce(c, 0) / 240, 1) + 3e-9, 7) AS coverage, round(identity * least(coalesce(c, 0) / 240, 1) + 3e-9, 7) AS score, bits, round(e_value, 7) AS e_value, start, "end" FROM g LEFT JOIN u USING (query, subject)""",
    "a14_best_family": """WITH h AS (SELECT l_orderkey AS query, l_suppkey % 4 AS family, l_partkey % 9 AS subfamily, max((l_quantity % 10 / 10)::DOUBLE) AS score FROM lineitem GROUP BY ALL), t AS (SELECT query, family, max(score) AS score, arg_min(subfamily, (-score, subfamily)) AS subfamily FROM h GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, family) AS n FROM t), b AS (SELECT a.query, a.family, a.subfamily, a.score, s.family AS second_family, coalesce(s.score, 0) AS second_score FROM r a LEFT JOIN r s ON s.query = a.query AND s.n = 2 WHERE a.n = 1)
        SELECT query, family, subfamily, round(score, 7) AS score, second_family, round(second_score, 7) AS second_score, round(greatest(score - second_score, 0), 7) AS margin, (SELECT count(*) FROM h WHERE h.query = b.query AND h.family = b.family AND h.score >= b.score) > 1 AS ambiguous FROM b""",
    "a22_parents": f"""WITH r AS (SELECT l_suppkey AS candidate, (l_partkey % 3)::VARCHAR AS source, l_orderkey % 5 AS read, max({_Q} % 4) AS p FROM lineitem GROUP BY ALL)
        SELECT candidate, count(*) FILTER (p = 3) AS exact, count(*) FILTER (p = 2) AS family, count(*) FILTER (p = 1) AS ambiguous, coalesce(array_to_string(list_sort(list(DISTINCT source) FILTER (p > 0)), ','), '') AS sources FROM r GROUP BY candidate""",
    "a10_communities": """WITH o AS (SELECT l_orderkey AS id, l_orderkey % 700 AS community, min(l_partkey % 50) AS ref, min(l_partkey) AS l, max(l_partkey) AS r, max(l_discount) AS identity, max(l_tax) AS coverage, min(l_tax) AS lfdr, min(l_linenumber) AS n FROM lineitem GROUP BY ALL), x AS (SELECT l_orderkey % 700 AS community, count(DISTINCT l_suppkey) AS alt FROM lineitem GROUP BY ALL)
        SELECT community, count(*) AS rows, any_value(alt) AS alt, list_sort(list(ref))[count(*) // 2 + 1] AS ref, greatest(min(l) - 50, 0) AS start, max(r) + 50 AS "end", round(max(identity), 7) AS identity, round(max(coverage), 7) AS coverage, round(min(lfdr), 7) AS lfdr, max(n)::BIGINT AS insert_length FROM o JOIN x USING (community) GROUP BY community HAVING count(*) >= 2""",
    "a23_counters": f"""WITH c AS ({_CALLS}), d AS (SELECT contig, l AS s, l + 100 + score * 9 AS e, cost * 4 AS flag, score % 61 AS mapq, score % 5 AS ins, cost % 3 AS clip FROM c), t AS (SELECT contig, id AS site, l AS pos FROM c)
        SELECT site, count(d.s) AS depth, count(*) FILTER (flag // 16 % 2 = 1) AS reverse, count(*) FILTER (ins > 0) AS inserted, coalesce(max(ins), 0) AS longest, count(*) FILTER (clip > 0) AS clipped, count(*) FILTER (s <= pos - 100 AND e >= pos + 101) AS spanning, count(*) FILTER (s <= pos - 100 AND e >= pos + 101 AND mapq < 20) AS spanning_low
        FROM t LEFT JOIN d ON d.contig = t.contig AND d.e > pos - 100 AND d.s < pos + 101 GROUP BY site""",
    "k_ranks": f"""WITH h AS (SELECT l_orderkey, {_Q} AS support, l_suppkey % 7 AS priority, l_partkey % 90 AS l FROM lineitem), s AS (SELECT *, support * coalesce([8, 8, 7, 1, 6, 1][priority + 1], 1) AS score FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, least(abs(l - 40), abs(l + 5 - 40)), support DESC, priority, l)::INTEGER AS rank FROM s)
        SELECT l_orderkey, rank, score, support, l AS "left" FROM r WHERE rank <= 2""",
    "k_picks": f"""WITH h AS (SELECT l_orderkey, l_linenumber, {_Q} * 10 + l_linenumber AS n, l_partkey * 20 AS pos FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, pos) AS a FROM h), f AS (SELECT * FROM r WHERE a <= 2 OR pos BETWEEN 500 AND 2600), g AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY a) AS b FROM f) SELECT l_orderkey, l_linenumber FROM g WHERE b <= 4""",
    "k12_top_groups": f"SELECT l_suppkey, sum({_Q})::BIGINT AS total FROM lineitem GROUP BY 1 HAVING sum({_Q}) > 0 ORDER BY 2 DESC, 1 LIMIT 30",
    "u_names": """WITH o AS (SELECT l_orderkey, list_sort(list(DISTINCT 's' || (l_suppkey % 9))) AS a, list_sort(list(DISTINCT 's' || (l_partkey % 9))) AS b FROM lineitem GROUP BY ALL), p AS (SELECT *, list_sort(list_distinct(list_concat(a, b))) AS u FROM o) SELECT l_orderkey, array_to_string(u, ',') AS names, round(len(list_intersect(a, b)) / len(u), 7) AS jaccard FROM p""",
    "s20_call_table": f"WITH c AS ({_CALLS}) SELECT id, 'chr' || contig AS contig, l AS \"left\", r AS \"right\", score, CASE WHEN score % 3 > 0 THEN score / 50 END AS share, promoted, cost + 1 AS n_names FROM c",
    "s22_coverage": f"WITH e AS ({_E}) SELECT id, least(ls, re) AS coverage_start, greatest(ls, re) AS coverage_end FROM e WHERE ls >= 0 AND re >= 0",
    "s23_controls": f"""WITH e AS ({_E}), n AS (SELECT * FROM e WHERE id % 3 = 0), b AS (SELECT id, CASE WHEN id % 3 <> 0 THEN 'final_call' WHEN split = 0 THEN 'shift' ELSE 'sample_local' END AS row_kind, alt AS score FROM e), k AS (SELECT score, (1 + (SELECT count(*) FROM n WHERE n.alt >= d.score)) / (2 + (SELECT count(*) FROM n)) AS tail FROM (SELECT DISTINCT score FROM b) d)
        SELECT id, row_kind, score, round(tail, 9) AS tail FROM b JOIN k USING (score)""",
    "s17_truth": """SELECT 'chr' || (o_custkey % 5) AS contig, least(o_orderkey, o_custkey * 3) AS start, greatest(o_orderkey, o_custkey * 3) AS "end", CASE WHEN o_orderkey % 7 <> 0 THEN 'L1' END AS family, o_orderkey % 600 AS length FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey % 9 <> 0 AND o_orderkey % 600 >= 50""",
    "s18_children": """WITH o AS (SELECT o_orderkey AS k, o_custkey % 5 AS c, CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE o_orderkey + 7 END AS l, o_orderkey - 5 AS r FROM orders) SELECT 'c' || c AS contig, k AS pos, 'ALU' AS family, k % 10 AS support, CASE WHEN l >= 0 AND r >= 0 THEN least(l, r) ELSE greatest(k - 40, 0) END AS start, CASE WHEN l >= 0 AND r >= 0 THEN greatest(l, r) ELSE k + 40 END AS "end" FROM o WHERE k % 3 <> 0 AND k % 10 >= 3""",
    "s14_best_hits": """SELECT 'q' || o_orderkey AS key, 'L1' AS family, CASE WHEN o_orderkey % 6 = 0 THEN 'L1' ELSE 'P' || (o_orderkey % 5) END AS subfamily, CASE WHEN o_orderkey % 10 <> 0 THEN (o_orderkey % 100)::DOUBLE END AS identity, (o_orderkey % 7)::DOUBLE AS coverage FROM orders""",
}


def _votes_sql() -> str:
    from loomseq.jobs.evidence import _KMERS

    parts = []
    for k in (9, 11):
        q = f"SELECT item_id AS query, kmer FROM ({_KMERS.format(key='item_id', k=k, table='benchmark')}) WHERE regexp_full_match(kmer, '[ACGT]+')"
        parts.append(f"SELECT query, entry, {k}.0::DOUBLE * count(*) / any_value(n) AS v FROM (SELECT a.query, a.kmer, n FROM ({q}) a JOIN (SELECT query, count(*) AS n FROM ({q}) GROUP BY query) USING (query)) JOIN (SELECT query AS entry, kmer FROM ({q}) UNION SELECT query, reverse(translate(kmer, 'ACGT', 'TGCA')) FROM ({q})) USING (kmer) GROUP BY query, entry")
    return f"SELECT query, entry, round(sum(v) / 20, 7) AS score FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL"


ORACLES["a15_votes"] = _votes_sql()
