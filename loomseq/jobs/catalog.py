"""Queries of the core operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseq.functions import sequence as S
from loomseq.jobs import calls, choices, events, evidence, places
from loomseq.operators import intervals as I
from loomseq.operators import selection as L


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _day(c: str) -> F.Column:
    return F.datediff(F.col(c), F.lit("1992-01-01")).cast("long")


def _spans(spark, sf) -> DataFrame:
    return _read(spark, sf, "lineitem").select(F.pmod("l_suppkey", F.lit(100)).alias("contig"), _day("l_shipdate").alias("l_start"), (_day("l_shipdate") + F.col("l_quantity").cast("long")).alias("l_end"))


def j1_interval_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Each order's 30 days against the lines of its contig: how many overlap, and by how much."""
    wanted = _read(spark, sf, "orders").select("o_orderkey", F.pmod("o_custkey", F.lit(100)).alias("contig"), _day("o_orderdate").alias("r_start"), (_day("o_orderdate") + 30).alias("r_end"))
    got = I.overlap_totals(_spans(spark, sf), wanted)
    return got.groupBy("o_orderkey").agg(F.sum("n").alias("n_spans"), F.sum("shared").alias("shared"))


def a4_interval_merge(spark: SparkSession, sf: str) -> DataFrame:
    return I.merge_intervals(_read(spark, sf, "lineitem").select("l_partkey", _day("l_shipdate").alias("s"), (_day("l_shipdate") + F.col("l_quantity").cast("long")).alias("e")), "l_partkey", "s", "e", 8)


def _events(spark, sf, *kinds: str) -> DataFrame:
    e = _read(spark, sf, "events").select("event_id", "user_id", "event_type", F.unix_seconds(F.date_trunc("second", "ts")).alias("pos"))
    return e.where(F.col("event_type").isin(*kinds)) if kinds else e


def a3_gap_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return I.gap_clusters(_events(spark, sf), "user_id", "pos", 86_400)


def j16_nearest(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    even = F.pmod("event_id", F.lit(2)) == 0
    return I.nearest(e.where(even).select("event_id", "user_id", "pos"), e.where(~even), "user_id", "pos", 200_000)


def j5_support_edges(spark: SparkSession, sf: str) -> DataFrame:
    got = L.support_edges(_read(spark, sf, "lineitem"), "l_orderkey", "l_partkey", shared=2, jaccard=0.5)
    return got.select("a", "b", "n_shared", F.round("jaccard", 9).alias("jaccard"))


def a16_empirical_tail(spark: SparkSession, sf: str) -> DataFrame:
    li = _read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", "l_extendedprice")
    got = L.empirical_tail(li.where("l_linestatus = 'F'"), li.where("l_linestatus <> 'F'"), "l_extendedprice")
    return got.select("l_orderkey", "l_linenumber", F.round("tail", 12).alias("tail"))


def w1_step_up(spark: SparkSession, sf: str) -> DataFrame:
    p = _read(spark, sf, "orders").select("o_orderkey", (F.pmod(F.col("o_orderkey") * 7919, F.lit(10007)) / 10007.0).alias("u")).select("o_orderkey", (F.col("u") * F.col("u") * F.col("u")).alias("p"))
    return L.step_up(p, "p", 0.5).select("o_orderkey", "selected", F.round("threshold", 12).alias("threshold"))


def w5_bayes_prefix(spark: SparkSession, sf: str) -> DataFrame:
    got = L.bayes_prefix(_read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", (F.col("l_discount") * 2).alias("lfdr"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o")), "l_suppkey", "lfdr", "o", 0.05)
    return got.select("l_orderkey", "l_linenumber", "rank", "selected")


def a18_length_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return L.length_histogram(_read(spark, sf, "documents").select("source", "n_chars"), "source", "n_chars")


def a20_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("l_extendedprice")
    return _read(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.median(x), 6).alias("median"), F.round(F.percentile(x, F.lit(0.9)), 6).alias("p90"), F.round(F.percentile(x, F.lit(0.99)), 6).alias("p99"))


_BASES = ("abcdefghijklmnopqrstuvwxyz #0123456789", "ACGTACGTACGTACGTACGTACGTACNNACGTACGTAC")


def f_sequence_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """F13, F16 to F19 on part names spelt in bases."""
    s = F.translate(F.lower("p_name"), *_BASES)
    d = _read(spark, sf, "part").select("p_partkey", s.alias("s"))
    c = F.col("s")
    return d.select("p_partkey", S.reverse_complement(c).alias("rc"), F.round(S.gc_fraction(c), 9).alias("gc"), F.round(S.entropy(c), 9).alias("entropy"), S.longest_run(c).cast("long").alias("run"), F.round(S.kmer_uniqueness(c, 3), 9).alias("uniqueness"))


def f1_cigar(spark: SparkSession, sf: str) -> DataFrame:
    """alignment strings built from order lines."""
    q = F.col("l_quantity").cast("int")
    c = F.concat(q, F.lit("M"), F.col("l_linenumber"), F.when(q % 2 == 0, F.lit("I")).otherwise(F.lit("D")), q % 5, F.lit("S"))
    d = _read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("pos"), c.alias("cigar"))
    k = F.col("cigar")
    return d.select("l_orderkey", "l_linenumber", S.cigar_valid(k).alias("valid"), S.reference_end(F.col("pos"), k).alias("ref_end"), S.cigar_length(k, "I").alias("inserted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (j1_interval_overlap, j5_support_edges, j16_nearest, a3_gap_clusters, a4_interval_merge, a16_empirical_tail, a18_length_histogram, a20_quantiles, w1_step_up, w5_bayes_prefix, f1_cigar, f_sequence_metrics)
}

_DAY = "date_diff('day', DATE '1992-01-01', CAST({} AS DATE))"
_LI = f"SELECT l_partkey, l_suppkey % 100 AS contig, {_DAY.format('l_shipdate')} AS s, {_DAY.format('l_shipdate')} + CAST(floor(l_quantity) AS BIGINT) AS e FROM lineitem"
_EV = "SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS pos FROM events"
ORACLES: dict[str, str] = {
    "j1_interval_overlap": f"""WITH l AS ({_LI}), o AS (SELECT o_orderkey, o_custkey % 100 AS contig, {_DAY.format('o_orderdate')} AS rs, {_DAY.format('o_orderdate')} + 30 AS re FROM orders)
        SELECT o_orderkey, count(*) AS n_spans, sum(least(e, re) - greatest(s, rs))::BIGINT AS shared FROM l JOIN o USING (contig) WHERE e > rs AND s < re GROUP BY o_orderkey""",
    "j5_support_edges": """WITH s AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), z AS (SELECT o, count(*) AS n FROM s GROUP BY o),
        c AS (SELECT x.o AS a, y.o AS b, count(*) AS n_shared FROM s x JOIN s y ON x.p = y.p AND x.o < y.o GROUP BY ALL)
        SELECT a, b, n_shared, round(n_shared / (za.n + zb.n - n_shared), 9) AS jaccard FROM c JOIN z za ON a = za.o JOIN z zb ON b = zb.o WHERE n_shared >= 2 OR n_shared / (za.n + zb.n - n_shared) >= 0.5""",
    "j16_nearest": f"""WITH e AS ({_EV}), t AS (SELECT DISTINCT user_id, pos AS tp FROM e WHERE event_id % 2 <> 0),
        c AS (SELECT event_id, user_id, pos, tp, row_number() OVER (PARTITION BY event_id ORDER BY abs(pos - tp), tp) AS n FROM e LEFT JOIN t USING (user_id) WHERE event_id % 2 = 0)
        SELECT event_id, user_id, pos, CASE WHEN abs(pos - tp) <= 200000 THEN tp END AS truth_position, CASE WHEN abs(pos - tp) <= 200000 THEN abs(pos - tp) END AS distance FROM c WHERE n = 1""",
    "a3_gap_clusters": f"""WITH e AS ({_EV}), g AS (SELECT user_id, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY user_id ORDER BY pos) > 86400 THEN 1 ELSE 0 END AS n FROM e),
        r AS (SELECT user_id, pos, sum(n) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM g)
        SELECT user_id, min(pos) AS start, max(pos) AS "end", count(*) AS support, CAST(floor(median(pos)) AS BIGINT) AS centre FROM r GROUP BY user_id, run""",
    "a4_interval_merge": f"""WITH l AS ({_LI}), m AS (SELECT *, max(e) OVER (PARTITION BY l_partkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM l),
        r AS (SELECT *, sum(CASE WHEN s > reach + 8 THEN 1 ELSE 0 END) OVER (PARTITION BY l_partkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM m)
        SELECT l_partkey, min(s) AS start, max(e) AS "end", count(*) AS n FROM r GROUP BY l_partkey, run""",
    "a16_empirical_tail": """WITH n AS (SELECT l_extendedprice AS x, count(*) AS c FROM lineitem WHERE l_linestatus <> 'F' GROUP BY 1), t AS (SELECT count(*) AS n FROM lineitem WHERE l_linestatus <> 'F'),
        v AS (SELECT DISTINCT l_extendedprice AS x FROM lineitem WHERE l_linestatus = 'F'), a AS (SELECT x, sum(c) AS c FROM (SELECT * FROM n UNION ALL SELECT x, 0 FROM v) GROUP BY x),
        d AS (SELECT x, sum(c) OVER (ORDER BY x DESC ROWS UNBOUNDED PRECEDING) AS k FROM a)
        SELECT l_orderkey, l_linenumber, round((k + 1) / (n + 2), 12) AS tail FROM lineitem JOIN d ON x = l_extendedprice, t WHERE l_linestatus = 'F'""",
    "a18_length_histogram": """WITH b(bin, lo, hi) AS (VALUES ('1-10', 1, 10), ('11-100', 11, 100), ('101-1000', 101, 1000), ('>1000', 1001, 9000000000)), s AS (SELECT DISTINCT source FROM documents)
        SELECT s.source, bin, count(n_chars) AS n, coalesce(sum(n_chars), 0)::BIGINT AS total FROM s CROSS JOIN b LEFT JOIN documents d ON d.source = s.source AND n_chars BETWEEN lo AND hi GROUP BY ALL""",
    "a20_quantiles": "SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90, round(quantile_cont(l_extendedprice, 0.99), 6) AS p99 FROM lineitem GROUP BY ALL",
    "w1_step_up": """WITH u AS (SELECT o_orderkey, ((o_orderkey * 7919) % 10007) / 10007.0::DOUBLE AS u FROM orders), p AS (SELECT o_orderkey, u * u * u AS p FROM u),
        h AS (SELECT sum(1.0::DOUBLE / i) AS h, count(*) AS m FROM (SELECT unnest(generate_series(1, (SELECT count(*) FROM p))) AS i)), r AS (SELECT p, row_number() OVER (ORDER BY p) AS k FROM p),
        t AS (SELECT p, max(k) * 0.5::DOUBLE / (any_value(m) * any_value(h)) AS t FROM r, h GROUP BY p), c AS (SELECT max(p) AS p, arg_max(t, p) AS t FROM t WHERE p <= t)
        SELECT o_orderkey, coalesce(p.p <= c.p, false) AS selected, round(CASE WHEN p.p <= c.p THEN c.t ELSE t.t END, 12) AS threshold FROM p JOIN t ON p.p = t.p, c""",
    "w5_bayes_prefix": """WITH r AS (SELECT l_orderkey, l_linenumber, l_suppkey, row_number() OVER w AS rank, avg(l_discount * 2) OVER (w ROWS UNBOUNDED PRECEDING) AS m FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_discount * 2, l_orderkey * 10 + l_linenumber))
        SELECT l_orderkey, l_linenumber, rank::INTEGER AS rank, coalesce(rank <= max(CASE WHEN m <= 0.05 + 1e-9 THEN rank END) OVER (PARTITION BY l_suppkey), false) AS selected FROM r""",
    "f1_cigar": """WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey AS pos, CAST(floor(l_quantity) AS BIGINT) AS q FROM lineitem)
        SELECT l_orderkey, l_linenumber, q > 0 AND q % 5 > 0 AS valid, pos + q + CASE WHEN q % 2 = 0 THEN 0 ELSE l_linenumber END AS ref_end, CASE WHEN q % 2 = 0 THEN l_linenumber ELSE 0 END::BIGINT AS inserted FROM c""",
    "f_sequence_metrics": f"""WITH s AS (SELECT p_partkey, translate(lower(p_name), '{_BASES[0]}', '{_BASES[1]}') AS s FROM part),
        b AS (SELECT *, length(s)::DOUBLE AS n, [length(s) - length(replace(s, x, '')) for x in ['A', 'C', 'G', 'T']] AS c FROM s),
        k AS (SELECT p_partkey, count(*) AS k, count(DISTINCT w) AS d FROM (SELECT p_partkey, substr(s, i, 3) AS w FROM (SELECT *, unnest(generate_series(1, length(s) - 2)) AS i FROM s)) WHERE regexp_full_match(w, '[ACGT]+') GROUP BY p_partkey)
        SELECT p_partkey, regexp_replace(reverse(translate(s, 'ACGT', 'TGCA')), '[^ACGTN]', 'N', 'g') AS rc, round((c[2] + c[3]) / n, 9) AS gc,
            round(list_sum([CASE WHEN x > 0 THEN -(x / list_sum(c)) * log2(x / list_sum(c)) ELSE 0 END for x in c]), 9) AS entropy,
            list_max([length(x) for x in regexp_extract_all(s, '(A+|C+|G+|T+|N+|.)')])::BIGINT AS run, coalesce(round(d / k, 9), 0) AS uniqueness
        FROM b LEFT JOIN k USING (p_partkey)""",
}

QUERIES |= evidence.QUERIES | calls.QUERIES | places.QUERIES | events.QUERIES | choices.QUERIES
ORACLES |= evidence.ORACLES | calls.ORACLES | places.ORACLES | events.ORACLES | choices.ORACLES
