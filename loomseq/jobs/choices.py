"""Queries of hypotheses, explanations and breakpoints over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseq.functions import explanation as X
from loomseq.operators import hypotheses as H

C = F.col


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "lineitem").select(C("l_orderkey").alias("component"), C("l_linenumber").cast("int").alias("n"), C("l_quantity").cast("int").alias("q"), C("l_partkey").alias("p"), C("l_suppkey").alias("s"))


_L = "l AS (SELECT l_orderkey AS component, l_linenumber::BIGINT AS n, floor(l_quantity)::BIGINT AS q, l_partkey AS p, l_suppkey AS s FROM lineitem)"


def k2_hypotheses(spark: SparkSession, sf: str) -> DataFrame:
    li = _lines(spark, sf)
    o = _read(spark, sf, "orders").select(C("o_orderkey").alias("component"), F.lit(1000).cast("long").alias("anchor"), F.lit(990).cast("long").alias("left"), (C("o_orderkey") % 50 + 1010).alias("right"))
    source = F.element_at(F.array(*map(F.lit, ("split", "insertion", "clip_left", "clip_right"))), ((C("n") + C("q")) % 4 + 1).cast("int"))
    side = F.element_at(F.array(*map(F.lit, ("left", "right", "unknown"))), (C("q") % 3 + 1).cast("int"))
    frag = li.select("component", source.alias("source"), side.alias("side"), (C("p") * 37 % 600 + 700).alias("junction"))
    at = lambda m, k: F.when((C("q") + k) % 3 != 0, C("s") * m % 500 + C("p") % 7 * 60 + 600)
    signals = li.select("component", at(13, 0).alias("split_left"), at(17, 1).alias("split_right"), at(19, 2).alias("clip_left"), at(23, 0).alias("clip_right"), at(29, 1).alias("insertion"))
    precise = li.where("n = 1").select("component", (C("p") * 11 % 1400 + 300).alias("pos"))
    got = H.enumerate_hypotheses(o, precise, frag, signals)
    return got.select("component", "left", "right", "support", C("priority").cast("long").alias("priority"), "score", "rank")


def k3_hypotheses(spark: SparkSession, sf: str) -> DataFrame:
    """K3 with its pick at the anchor and its rescued one; k3_diverse is the plain choice."""
    left = C("p") % 900
    right = left + F.when(C("q") % 3 == 0, 0).otherwise(C("s") % 60)
    li = _lines(spark, sf).select("component", F.lit(420).alias("anchor"), left.alias("left"), right.alias("right"), F.floor((left + right) / 2).alias("center"), (C("q") % 4 + 1).alias("support"), (C("s") % 6).cast("int").alias("priority"), "n", "q", "p", "s")
    li = li.withColumn("score", C("support") * H.weight(C("priority")))
    rank = F.row_number().over(_by("component", F.desc("score"), "left", "right", "n", "q", "p", "s"))
    return H.diverse_hypotheses(li.withColumn("rank", rank), 2).select("component", "place", "rank", "left", "right")


def _by(key: str, *order):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(*order)


def _summaries(spark: SparkSession, sf: str) -> DataFrame:
    li = _lines(spark, sf)
    left = 1000 + C("p") % 120
    rows = li.select(
        "component", F.row_number().over(_by("component", "n", "q", "p", "s")).alias("index"), left.alias("left"), (left + C("s") % 40 * (C("q") % 2)).alias("right"), F.sequence(F.lit(1), C("q") % 4 + 4).alias("names"), (C("q") % 9).alias("alt"), (C("s") % 3).alias("split"), (C("p") % 2).alias("indel"),
        (C("q") % 5 != 0).alias("feasible"), (C("s") % 3).alias("precise"), (C("p") % 3).alias("full"), (C("q") % 3).alias("left_anchor"), (C("s") % 4).alias("right_anchor"), F.lit(1060).alias("anchor"), (C("s") % 2 + 1).alias("support"), (C("p") % 4).cast("int").alias("priority"), (C("q") % 7).alias("score"),
    )
    return rows.withColumn("left", F.when(C("index") == 3, C("left") + 700).otherwise(C("left"))).withColumn("right", F.when(C("index") == 3, C("left")).otherwise(C("right")))


def a8_collapse(spark: SparkSession, sf: str) -> DataFrame:
    return H.collapse_hypotheses(_summaries(spark, sf)).select("component", "place", C("index").cast("int").alias("index"))


def k4_shortlist(spark: SparkSession, sf: str) -> DataFrame:
    return H.shortlist(_summaries(spark, sf)).select("component", "place", C("index").cast("int").alias("index"))


def f42_explanations(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of an order as the explanations of its event, the line's number as kind."""
    li = _lines(spark, sf)
    names = (*X.PRIMARY, *X.TIES)
    each = li.select("component", F.struct(C("n").alias("o"), C("q").alias("o2"), C("p").alias("o3"), F.struct(((C("n") + C("s")) % 4).alias("kind"), *(F.when(C("p") % (i + 2) == 0, 0).otherwise((C("q") + C("s") * i) % 3).alias(f) for i, f in enumerate(names)), F.when(C("s") % 3 == 0, "UNKNOWN").otherwise("L1").alias("family"), F.when(C("p") % 3 == 0, "").when(C("p") % 3 == 1, "UNKNOWN").otherwise("P2").alias("subfamily")).alias("e")).alias("x"))
    events = each.groupBy("component").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["e"]).alias("es"))
    d = events.select("component", X.decide(C("es"), C("component") % 2 == 0).alias("d"))
    return d.select("component", "d.kind", "d.qc", "d.emit", "d.evidence_only", "d.unknown", "d.family", "d.subfamily", "d.residuals", F.array_join("d.order", ",").alias("order"))


def f46_posterior(spark: SparkSession, sf: str) -> DataFrame:
    li = _lines(spark, sf)
    pos = F.when(C("q") % 13 == 0, -1).otherwise(C("p") % 80 + F.when(C("p") % 97 == 0, 2600).otherwise(0))
    got = li.groupBy("component").agg(F.sort_array(F.collect_list(F.struct(pos.alias("pos"), (C("q") % 4 == 0).alias("split"), (C("q") % 4 == 1).alias("insertion"), (C("q") % 4 == 2).alias("clip")))).alias("s"))
    p = got.select("component", X.breakpoint_posterior(C("s")).alias("p"))
    return p.select("component", "p.width", F.round("p.entropy", 9).alias("entropy"), "p.mode", F.round("p.mass", 9).alias("mass"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (k2_hypotheses, k3_hypotheses, a8_collapse, k4_shortlist, f42_explanations, f46_posterior)}

_W = "coalesce([8, 8, 7, 1, 6, 1][priority + 1], 1)"
_S = f"""{_L}, r0 AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY n, q, p, s) AS i FROM l),
 r1 AS (SELECT *, 1000 + p % 120 + CASE WHEN i = 3 THEN 700 ELSE 0 END AS a FROM r0), r AS (SELECT component, i, a, CASE WHEN i = 3 THEN a ELSE a + s % 40 * (q % 2) END AS b, range(1, q % 4 + 5) AS names, q % 9 AS alt, s % 3 + p % 2 AS prec, q % 5 <> 0 AS feasible,
   s % 3 AS precise, p % 3 AS full_reads, least(q % 3, s % 4) AS anchors, s % 2 + 1 AS support, p % 4 AS priority, q % 7 AS score FROM r1)"""
_J = "len(list_intersect({0}, {1}))::DOUBLE / (len({0}) + len({1}) - len(list_intersect({0}, {1})))"


def _at(m: int, k: int) -> str:
    return f"CASE WHEN (q + {k}) % 3 <> 0 THEN s * {m} % 500 + p % 7 * 60 + 600 END"


def _posterior() -> str:
    return f"""WITH {_L}, g AS (SELECT component, p % 80 + CASE WHEN p % 97 = 0 THEN 2600 ELSE 0 END AS pos, CASE q % 4 WHEN 0 THEN 2.0 WHEN 1 THEN 3.0 WHEN 2 THEN 6.0 ELSE 8.0 END::DOUBLE AS w FROM l WHERE q % 13 <> 0),
        k AS (SELECT component, min(pos) - 20 AS lo, least(max(pos) + 20, min(pos) - 20 + 2000) AS hi FROM g GROUP BY component HAVING count(*) >= 2), x AS (SELECT component, unnest(range(lo, hi + 1)) AS x, lo, hi FROM k),
        f AS (SELECT x.component, x.x, any_value(x.lo) AS lo, any_value(x.hi) AS hi, sum(exp(-0.5::DOUBLE * ((x.x - g.pos) / g.w) * ((x.x - g.pos) / g.w)) / g.w) AS f FROM x JOIN g ON g.component = x.component GROUP BY x.component, x.x),
        d AS (SELECT *, f / sum(f) OVER (PARTITION BY component) AS d FROM f), c AS (SELECT *, sum(d) OVER (PARTITION BY component ORDER BY x ROWS UNBOUNDED PRECEDING) AS cum FROM d),
        y AS (SELECT component, coalesce(min(x) FILTER (cum >= 0.95::DOUBLE), any_value(hi)) - min(x) FILTER (cum >= 0.05::DOUBLE) AS width, -sum(CASE WHEN d > 0 THEN d * ln(d) ELSE 0 END) / ln(count(*)) AS entropy, sum(d) AS mass FROM c GROUP BY component),
        m AS (SELECT component, min(x) AS mode FROM (SELECT *, max(d) OVER (PARTITION BY component) AS top FROM d) WHERE d >= top * (1 - 1e-9::DOUBLE) GROUP BY component)
        SELECT o.component, coalesce(width, 0)::DOUBLE AS width, round(coalesce(entropy, 0), 9) AS entropy, mode, round(coalesce(mass, 0), 9) AS mass FROM (SELECT DISTINCT component FROM l) o LEFT JOIN y ON y.component = o.component LEFT JOIN m ON m.component = o.component"""


def _explained() -> str:
    names = (*X.PRIMARY, *X.TIES)
    cols = ", ".join(f"CASE WHEN p % {i + 2} = 0 THEN 0 ELSE (q + s * {i}) % 3 END AS {f}" for i, f in enumerate(names))
    dom = "(" + " AND ".join(f"b.{f} <= x.{f}" for f in X.PRIMARY) + ") AND (" + " OR ".join(f"b.{f} < x.{f}" for f in X.PRIMARY) + ")"
    line = " || ';' || ".join(f"'{n}=' || {f}" for n, f in X.WRITTEN.items())
    return f"""WITH {_L}, e AS (SELECT component, n, q, p AS pp, (n + s) % 4 AS kind, {cols}, CASE WHEN s % 3 = 0 THEN 'UNKNOWN' ELSE 'L1' END AS family, ['', 'UNKNOWN', 'P2'][p % 3 + 1] AS subfamily FROM l),
        i AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY n, q, pp, {", ".join(names)}) AS j FROM e),
        r AS (SELECT *, ['REFERENCE', 'INSERTION_NON_TE', 'TE', 'ARTIFACT'][kind + 1] AS name, row_number() OVER (PARTITION BY component ORDER BY {" + ".join(X.PRIMARY)}, {" + ".join(X.TIES)}, kind DESC, j) AS rank FROM i),
        o AS (SELECT component, string_agg(name, ',' ORDER BY rank) AS "order" FROM r GROUP BY component), b AS (SELECT *, {line} AS residuals FROM r WHERE rank = 1),
        a AS (SELECT b.component, coalesce(bool_and({dom}), true) AS alone FROM b LEFT JOIN r x ON x.component = b.component AND x.rank > 1 GROUP BY b.component HAVING true),
        q AS (SELECT b.*, "order", component % 2 = 0 AS closed, CASE WHEN missing_required_components > 0 OR structural_conflicts > 0 THEN 'NO_CALL_INCOMPLETE' WHEN kind = 2 AND NOT alone THEN 'TE_AMBIGUOUS' WHEN kind = 2 AND component % 2 = 0 THEN 'PASS_TE_CLOSED' WHEN kind = 2 THEN 'PASS_TE_IMPRECISE'
          WHEN kind = 1 AND alone THEN 'PASS_NONTE_INSERTION' ELSE 'REFERENCE_OR_ARTIFACT' END AS qc FROM b JOIN o USING (component) JOIN a USING (component))
        SELECT component, name AS kind, qc, qc IN ('PASS_TE_CLOSED', 'PASS_TE_IMPRECISE') AS emit, qc = 'PASS_TE_IMPRECISE' AS evidence_only, qc = 'PASS_TE_IMPRECISE' OR (qc = 'PASS_TE_CLOSED' AND (subfamily IN ('', 'UNKNOWN') OR family = 'UNKNOWN')) AS unknown, family, subfamily, residuals, "order" FROM q"""


ORACLES: dict[str, str] = {
    "k2_hypotheses": f"""WITH {_L}, o AS (SELECT o_orderkey AS component, 990 AS a, o_orderkey % 50 + 1010 AS b FROM orders),
        f AS (SELECT component, ['split', 'insertion', 'clip_left', 'clip_right'][(n + q) % 4 + 1] AS source, ['left', 'right', 'unknown'][q % 3 + 1] AS side, p * 37 % 600 + 700 AS pos FROM l),
        far AS (SELECT component, min(pos) AS x, max(pos) AS y FROM (SELECT component, p * 11 % 1400 + 300 AS pos FROM l WHERE n = 1 UNION ALL SELECT component, pos FROM f JOIN o USING (component) WHERE source IN ('split', 'insertion') AND greatest(a - pos, pos - b) <= 1000) GROUP BY component),
        w AS (SELECT component, greatest(least(a, coalesce(x, a)) - 200, 0) AS lo, greatest(b, coalesce(y, b)) + 200 AS hi FROM o LEFT JOIN far USING (component)),
        s AS (SELECT l.component, lo, hi, {_at(13, 0)} AS sl, {_at(17, 1)} AS sr, {_at(19, 2)} AS cl, {_at(23, 0)} AS cr, {_at(29, 1)} AS ins FROM l JOIN w USING (component)),
        k AS (SELECT component, CASE WHEN source = 'split' THEN 'split_' || side ELSE source END AS kind, pos FROM f JOIN w USING (component) WHERE pos BETWEEN lo AND hi
          UNION ALL SELECT component, 'raw_split_left', sl FROM s WHERE sl BETWEEN lo AND hi AND (sr IS NULL OR abs(sl - 1000) < abs(sr - 1000) OR (abs(sl - 1000) = abs(sr - 1000) AND sl <= sr))
          UNION ALL SELECT component, 'raw_split_right', sr FROM s WHERE sr BETWEEN lo AND hi AND NOT (sl IS NOT NULL AND (abs(sl - 1000) < abs(sr - 1000) OR (abs(sl - 1000) = abs(sr - 1000) AND sl <= sr)))
          UNION ALL SELECT component, 'raw_clip_left', cl FROM s WHERE cl BETWEEN lo AND hi UNION ALL SELECT component, 'raw_clip_right', cr FROM s WHERE cr BETWEEN lo AND hi UNION ALL SELECT component, 'raw_insertion', ins FROM s WHERE ins BETWEEN lo AND hi),
        g AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY component, kind ORDER BY pos) > 75 THEN 1 ELSE 0 END AS cut FROM k), h AS (SELECT *, sum(cut) OVER (PARTITION BY component, kind ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM g),
        c AS (SELECT component, kind, count(*) AS support, floor(median(pos))::BIGINT AS c FROM h GROUP BY component, kind, run), z AS (SELECT *, row_number() OVER (PARTITION BY component, kind ORDER BY support DESC, abs(c - 1000), c) AS n FROM c),
        p AS (SELECT * FROM (VALUES (0, 'split_left', 'split_right'), (2, 'raw_split_left', 'raw_split_right'), (3, 'clip_left', 'clip_right'), (5, 'raw_clip_left', 'raw_clip_right')) v(priority, lk, rk)),
        lz AS (SELECT component, priority, n, c, support FROM z JOIN p ON kind = lk WHERE n <= 6), rz AS (SELECT component, priority, n, c, support FROM z JOIN p ON kind = rk WHERE n <= 6),
        u AS (SELECT component, CASE WHEN kind = 'insertion' THEN 1 ELSE 4 END AS priority, n AS a, 0 AS b, c AS lo, c AS hi, support FROM z WHERE kind IN ('insertion', 'raw_insertion') AND n <= 2
          UNION ALL SELECT component, priority, coalesce(lz.n, 0), coalesce(rz.n, 0), least(lz.c, rz.c), greatest(lz.c, rz.c), coalesce(lz.support, 0) + coalesce(rz.support, 0) FROM lz FULL JOIN rz USING (component, priority) WHERE greatest(lz.c, rz.c) - least(lz.c, rz.c) <= 250),
        v AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY component, lo, hi ORDER BY priority, a, b) = 1),
        e AS (SELECT component, priority::BIGINT AS priority, lo, hi, support FROM v UNION ALL SELECT component, 2147483647::BIGINT, 1000, 1000, 1 FROM o WHERE component NOT IN (SELECT component FROM v)), t AS (SELECT *, support * {_W} AS score FROM e)
        SELECT component, lo::BIGINT AS "left", hi::BIGINT AS "right", support::BIGINT AS support, priority::BIGINT AS priority, score::BIGINT AS score, row_number() OVER (PARTITION BY component ORDER BY score DESC, abs((lo + hi) // 2 - 1000), support DESC, priority, lo, hi)::INTEGER AS rank FROM t""",
    "k3_hypotheses": f"""WITH RECURSIVE {_L}, r0 AS (SELECT *, p % 900 AS a, p % 900 + CASE WHEN q % 3 = 0 THEN 0 ELSE s % 60 END AS b, q % 4 + 1 AS support, s % 6 AS priority FROM l), r1 AS (SELECT *, (a + b) // 2 AS c, support * {_W} AS score FROM r0),
        r AS (SELECT component, a, b, c, support, priority, score, row_number() OVER (PARTITION BY component ORDER BY score DESC, a, b, n, q, p, s) AS i, count(*) OVER (PARTITION BY component) AS m FROM r1),
        g AS (SELECT component, 1::BIGINT AS i, [{{'i': i, 'a': a, 'b': b, 'c': c}}] AS t FROM r WHERE i = 1
          UNION ALL SELECT g.component, r.i, CASE WHEN len(g.t) < 2 AND len(list_filter(g.t, lambda x: abs(x.a - r.a) <= 30 AND abs(x.b - r.b) <= 30)) = 0 THEN list_append(g.t, {{'i': r.i, 'a': r.a, 'b': r.b, 'c': r.c}}) ELSE g.t END FROM g JOIN r ON r.component = g.component AND r.i = g.i + 1),
        d AS (SELECT g.component, g.t, m, len(list_filter(g.t, lambda x: abs(x.c - 420) <= 100)) > 0 AS near FROM g JOIN r ON r.component = g.component AND r.i = g.i WHERE g.i = m),
        n AS (SELECT d.component, arg_min({{'i': r.i, 'a': r.a, 'b': r.b, 'c': r.c}}, (abs(r.c - 420), -score, -support, priority, r.a, r.b, r.i)) AS pick FROM d JOIN r USING (component) WHERE NOT near AND d.m > 2 AND score >= 8 AND len(list_filter(d.t, lambda x: x.a = r.a AND x.b = r.b)) = 0 GROUP BY d.component),
        e AS (SELECT d.component, d.m, near OR pick IS NOT NULL AS goes_on, CASE WHEN near OR pick IS NULL THEN t WHEN len(t) < 2 THEN list_append(t, pick) ELSE list_append(t[1:1], pick) END AS t FROM d LEFT JOIN n USING (component) WHERE d.m > 2),
        f AS (SELECT e.component, arg_min({{'i': r.i, 'a': r.a, 'b': r.b, 'c': r.c}}, (abs(r.c - 420), priority, r.c, r.i)) AS pick FROM e JOIN r USING (component) WHERE goes_on AND priority <= 1 AND r.a = r.b AND support <= 1 AND len(list_filter(e.t, lambda x: (x.a = r.a AND x.b = r.b) OR abs(x.c - r.c) < 500)) = 0 GROUP BY e.component),
        w AS (SELECT component, unnest(u) AS x, unnest(range(1, len(u) + 1)) AS place FROM (SELECT component, CASE WHEN pick IS NULL THEN t ELSE list_append(t, pick) END AS u FROM e LEFT JOIN f USING (component)))
        SELECT component, place::INTEGER AS place, x.i::INTEGER AS rank, x.a AS "left", x.b AS "right" FROM w UNION ALL SELECT component, i::INTEGER, i::INTEGER, a, b FROM r WHERE m <= 2""",
    "a8_collapse": f"""WITH RECURSIVE {_S}, g AS (SELECT component, 1::BIGINT AS i, [{{'i': i, 'a': a, 'b': b, 'names': names, 'alt': alt, 'prec': prec}}] AS t FROM r WHERE i = 1
          UNION ALL SELECT g.component, r.i, CASE WHEN k.at IS NULL THEN list_append(g.t, {{'i': r.i, 'a': r.a, 'b': r.b, 'names': r.names, 'alt': r.alt, 'prec': r.prec}})
            WHEN (-r.alt, -r.prec, abs(r.b - r.a), r.i) < (-g.t[k.at].alt, -g.t[k.at].prec, abs(g.t[k.at].b - g.t[k.at].a), g.t[k.at].i) THEN list_concat(list_append(g.t[1:k.at - 1], {{'i': r.i, 'a': r.a, 'b': r.b, 'names': r.names, 'alt': r.alt, 'prec': r.prec}}), g.t[k.at + 1:]) ELSE g.t END
          FROM g JOIN r ON r.component = g.component AND r.i = g.i + 1, LATERAL (SELECT list_filter(range(1, len(g.t) + 1), lambda j: abs(g.t[j].a - r.a) <= 30 AND abs(g.t[j].b - r.b) <= 30 AND {_J.format("g.t[j].names", "r.names")} >= 0.8)[1] AS at) k),
        d AS (SELECT component, t FROM g QUALIFY row_number() OVER (PARTITION BY component ORDER BY i DESC) = 1) SELECT component, unnest(range(1, len(t) + 1))::INTEGER AS place, (unnest(t)).i::INTEGER AS index FROM d""",
    "k4_shortlist": f"""WITH RECURSIVE {_S}, v AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY precise DESC, full_reads DESC, anchors DESC, greatest(b - a, 0), least(abs(a - 1060), abs(b - 1060)), alt DESC, i) AS k FROM r WHERE feasible),
        g AS (SELECT component, 1::BIGINT AS k, [{{'i': i, 'a': a, 'b': b, 'names': names}}] AS t FROM v WHERE k = 1
          UNION ALL SELECT g.component, v.k, CASE WHEN len(list_filter(g.t, lambda x: abs(x.a - v.a) <= 60 AND abs(x.b - v.b) <= 60 AND {_J.format("x.names", "v.names")} >= 0.5)) > 0 THEN g.t ELSE list_append(g.t, {{'i': v.i, 'a': v.a, 'b': v.b, 'names': v.names}}) END FROM g JOIN v ON v.component = g.component AND v.k = g.k + 1),
        d AS (SELECT component, t FROM g QUALIFY row_number() OVER (PARTITION BY component ORDER BY k DESC) = 1),
        e AS (SELECT d.component, arg_min({{'i': v.i, 'a': v.a, 'b': v.b, 'names': v.names}}, (priority, -score, v.a, v.k)) AS pick FROM d JOIN v USING (component) WHERE support = 1 AND priority <= 1 AND v.a = v.b AND len(list_filter(d.t, lambda x: x.i = v.i OR (x.a = v.a AND x.b = v.b) OR abs(v.a - (x.a + (x.b - x.a) // 2)) < 500)) = 0 GROUP BY d.component),
        f AS (SELECT component, CASE WHEN pick IS NULL THEN t ELSE list_append(t, pick) END AS t FROM d LEFT JOIN e USING (component)) SELECT component, unnest(range(1, len(t) + 1))::INTEGER AS place, (unnest(t)).i::INTEGER AS index FROM f""",
    "f42_explanations": _explained(),
    "f46_posterior": _posterior(),
}
