"""Queries of the evidence, source and streaming operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseq.functions import reads as R
from loomseq.functions import sequence as S
from loomseq.functions import stats
from loomseq.operators import evidence as E
from loomseq.operators import intervals as I
from loomseq.operators import selection as L
from loomseq.sources import text as X
from loomseq.streaming import windows as W

BASES = ("abcdefghijklmnopqrstuvwxyz #0123456789", "ACGTACGTACGTACGTACGTACGTACNNACGTACGTAC")


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    back = F.col("l_returnflag") == "R"
    return _read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count_if(back).alias("alt"), F.count_if(~back).alias("ref"))


def f36_genotype(spark: SparkSession, sf: str) -> DataFrame:
    g = stats.genotype(F.col("alt"), F.col("ref"), F.lit(0.05), F.lit(0.05))
    return _counts(spark, sf).withColumn("g", g).select("l_orderkey", "g.gt", "g.gq", "g.depth", F.round("g.fraction", 9).alias("fraction"), "g.passed")


def f37_low_fraction(spark: SparkSession, sf: str) -> DataFrame:
    return _counts(spark, sf).select("l_orderkey", F.round(stats.low_fraction_factor(F.col("alt"), F.col("ref")), 7).alias("factor"))


def f44_local_fdr(spark: SparkSession, sf: str) -> DataFrame:
    li = _read(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.round(stats.add_local_fdr(F.col("l_discount"), F.col("l_tax")), 7).alias("lfdr"))


def a12_overdispersion(spark: SparkSession, sf: str) -> DataFrame:
    c = _counts(spark, sf).withColumn("depth", F.col("alt") + F.col("ref"))
    return E.overdispersion(c, "alt", "depth").select("n", F.round("rho", 7).alias("rho"))


def w4_e_values(spark: SparkSession, sf: str) -> DataFrame:
    u = 10007.0 / (F.pmod(F.col("o_orderkey") * 7919, F.lit(10007)) + 1)
    return L.e_values(_read(spark, sf, "orders").select("o_orderkey", (u * u).alias("e")), "e", 0.25).select("o_orderkey", "selected")


def a9_communities(spark: SparkSession, sf: str) -> DataFrame:
    return E.communities(_read(spark, sf, "lineitem"), "l_orderkey", "l_partkey")


def _spelt(spark: SparkSession, sf: str, name: str, *keys: str) -> DataFrame:
    return _read(spark, sf, name).select(*keys, F.translate(F.lower("text"), *BASES).alias("s"))


def a25_kmer_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return E.kmer_document_frequency(_spelt(spark, sf, "benchmark", "item_id"), "item_id", "s", 9).select("kmer", "n_groups", F.round("weight", 9).alias("weight"))


def j9_kmer_votes(spark: SparkSession, sf: str) -> DataFrame:
    return E.kmer_votes(_spelt(spark, sf, "documents", "doc_id"), "doc_id", "s", _spelt(spark, sf, "benchmark", "item_id"), "item_id", "s", 8)


def a17_letter_runs(spark: SparkSession, sf: str) -> DataFrame:
    return E.letter_runs(_spelt(spark, sf, "documents", "doc_id"), "doc_id", "s")


def a19_match_scores(spark: SparkSession, sf: str) -> DataFrame:
    e = _read(spark, sf, "events").select("event_id", "event_type", F.unix_seconds(F.date_trunc("second", "ts")).alias("pos"))
    even = F.pmod("event_id", F.lit(2)) == 0
    truth = e.where(~even).select("event_type", "pos").distinct()
    got = I.nearest(e.where(even), truth, "event_type", "pos", 120)
    s = E.match_scores(got, truth.groupBy("event_type").agg(F.count("*").alias("n_truth")), "event_type")
    return s.select("event_type", "tp", "fp", "fn", "median_distance", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def f20_f22_identity(spark: SparkSession, sf: str) -> DataFrame:
    """part names spelt in bases against their brand and type."""
    spell = lambda c: F.translate(F.lower(c), *BASES)
    d = _read(spark, sf, "part").select("p_partkey", spell("p_name").alias("a"), spell("p_type").alias("b"))
    return d.select("p_partkey", S.terminal_run(F.col("a")).cast("long").alias("run"), F.round(S.edit_identity(F.col("a"), F.col("b"), 0.3), 9).alias("identity"))


def s11_vcf_insertions(spark: SparkSession, sf: str) -> DataFrame:
    """Orders written as variant lines and read back."""
    k = F.col("o_orderkey")
    info = F.concat(F.when(k % 3 == 0, "SVTYPE=DEL").otherwise("PRECISE;SVTYPE=INS"), F.lit(";SVLEN="), k % 500, F.lit(";SUPPORT="), k % 7)
    line = F.concat_ws("\t", F.concat(F.lit("chr"), F.col("o_custkey") % 5), k + 1, F.when(k % 4 == 0, ".").otherwise(F.concat(F.lit("v"), k)), F.lit("N"), F.when(k % 2 == 0, "<INS>").otherwise("ACGT"), k % 60, F.when(k % 5 == 0, "LOW").otherwise("."), info)
    return X.parse_vcf_insertions(_read(spark, sf, "orders").select(line.alias("value")), min_quality=10, min_length=50)


def p1_read_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines written as alignment lines, read back and passed through the gate."""
    q = F.col("l_quantity").cast("int")
    cigar = F.concat(q * 4, F.lit("S"), q * 3, F.lit("M"), q + 20, F.lit("I"), q * 5, F.lit("M"), F.col("l_linenumber") * 30, F.lit("S"))
    flag = F.when(q % 11 == 0, 4).when(q % 7 == 0, 2048).otherwise(0)
    line = F.concat_ws("\t", F.concat_ws(".", "l_orderkey", "l_linenumber"), flag, F.lit("chr1"), F.col("l_partkey") + 1, F.col("l_suppkey") % 61, cigar, F.lit("*"), F.lit(0), F.lit(0), F.repeat(F.lit("A"), q + 40), F.lit("*"), F.concat(F.lit("NM:i:"), q * F.col("l_linenumber")))
    r = X.parse_sam(_read(spark, sf, "lineitem").select(line.alias("value")))
    keep = R.informative(F.col("flag"), F.col("mapq"), F.length("seq"), F.col("cigar"), F.col("nm"), F.col("sa"))
    return r.select("qname", "pos", S.reference_end(F.col("pos"), F.col("cigar")).alias("ref_end"), keep.alias("kept"))


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = _read(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("ts", F.col("ts").cast("timestamp"))


def z5_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    """Events of each kind by the hour, from a stream."""
    s = W.tumbling(_stream(spark, sf), "ts", "1 hour", "2 hours", ["event_type"], n=F.count("*"), most=F.max("value"))
    return W.upserts(s, ["event_type", "start"], "tumbling").select("event_type", F.unix_seconds("start").alias("start"), "n", "most")


def z6_sessions(spark: SparkSession, sf: str) -> DataFrame:
    got = W.sessions(_read(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")), "ts", "1 day", "user_id")
    return got.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (f36_genotype, f37_low_fraction, f44_local_fdr, a12_overdispersion, w4_e_values, a9_communities, a25_kmer_frequency, j9_kmer_votes, a17_letter_runs, a19_match_scores, f20_f22_identity, s11_vcf_insertions, p1_read_gate, z5_tumbling, z6_sessions)
}

_CN = "c AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS alt, count(*) FILTER (l_returnflag <> 'R') AS ref, count(*) AS n FROM lineitem GROUP BY l_orderkey)"
_CHOOSE = "lgamma(n + 1) - lgamma(alt + 1) - lgamma(n - alt + 1)"


def _bb(a: str, b: str) -> str:
    return f"{_CHOOSE} + lgamma(alt + {a}) - lgamma({a}) + lgamma(ref + {b}) - lgamma({b}) - lgamma(n + {a} + {b}) + lgamma({a} + {b})"


_KMERS = "SELECT {key}, unnest([substr(s, i, {k}) for i in generate_series(1, length(s) - {k} + 1)]) AS kmer FROM (SELECT {key}, translate(lower(text), '" + BASES[0] + "', '" + BASES[1] + "') AS s FROM {table})"
ORACLES: dict[str, str] = {
    "f36_genotype": f"""WITH {_CN}, s AS (SELECT *, {_bb('0.95', '18.05')} + ln(0.25) AS a, {_bb('9.5', '9.5')} + ln(0.5) AS b, {_bb('18.05', '0.95')} + ln(0.25) AS h FROM c),
        g AS (SELECT *, greatest(a, b, h) AS t, greatest(b, h) <= a AS plain FROM s), p AS (SELECT *, exp(a - t) + exp(b - t) + exp(h - t) AS m FROM g),
        q AS (SELECT *, CASE WHEN plain THEN 0 ELSE least(greatest(round(-10 * log10(greatest((m - 1) / m, 1e-10))), 0), 99) END::INTEGER AS gq FROM p)
        SELECT l_orderkey, CASE WHEN plain THEN '0/0' WHEN b >= h THEN '0/1' ELSE '1/1' END AS gt, gq, n AS depth, round(alt / n, 9) AS fraction, NOT plain AND gq >= 20 AS passed FROM q""",
    "f37_low_fraction": f"WITH {_CN} SELECT l_orderkey, round({_bb('1.0', '9.0')} - ({_CHOOSE} + alt * ln(0.02) + ref * ln(0.98)), 7) AS factor FROM c",
    "f44_local_fdr": """WITH o AS (SELECT *, ln(greatest(l_discount, 1e-12) / greatest(1 - l_discount, 1e-12)) + ln(greatest(l_tax, 1e-12) / greatest(1 - l_tax, 1e-12)) AS s FROM lineitem)
        SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-least(greatest(s, -60), 60))), 7) AS lfdr FROM o""",
    "a12_overdispersion": f"""WITH {_CN}, o AS (SELECT alt::DOUBLE AS x, n::DOUBLE AS n FROM c WHERE n >= 4 AND alt / n > 0.15 AND alt / n < 0.85), t AS (SELECT count(*) AS m, sum(x) / sum(n) AS p, sum(n) AS nn, sum(n * n) AS n2 FROM o),
        v AS (SELECT any_value(m) AS m, sum(n * (x / n - p) * (x / n - p)) / (any_value(m) - 1) AS b, sum(x * (n - x) / n) / (any_value(nn) - any_value(m)) AS w, (any_value(nn) - any_value(n2) / any_value(nn)) / (any_value(m) - 1) AS n0 FROM o, t)
        SELECT m AS n, round(coalesce(CASE WHEN m >= 20 AND b + (n0 - 1) * w > 1e-9 THEN least(greatest((b - w) / (b + (n0 - 1) * w), 0), 0.5) END, 0.05), 7) AS rho FROM v""",
    "w4_e_values": """WITH u AS (SELECT o_orderkey, 10007.0::DOUBLE / ((o_orderkey * 7919) % 10007 + 1) AS u FROM orders), e AS (SELECT o_orderkey, u * u AS e FROM u),
        r AS (SELECT e, row_number() OVER (ORDER BY e DESC) AS k, count(*) OVER () AS m FROM e)
        SELECT o_orderkey, coalesce(e >= (SELECT min(e) FROM r WHERE e * 0.25::DOUBLE * k >= m), false) AS selected FROM e""",
    "a9_communities": """WITH RECURSIVE s AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), z AS (SELECT o, count(*) AS n FROM s GROUP BY o),
        c AS (SELECT x.o AS a, y.o AS b, count(*) AS k FROM s x JOIN s y ON x.p = y.p AND x.o <> y.o GROUP BY ALL),
        e AS (SELECT a, b FROM c JOIN z za ON a = za.o JOIN z zb ON b = zb.o WHERE k >= 2 OR k / (za.n + zb.n - k) >= 0.5),
        r AS (SELECT o, o AS low FROM z UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.o WHERE r.low < e.b)
        SELECT o AS l_orderkey, min(low) AS community FROM r GROUP BY o""",
    "a25_kmer_frequency": f"WITH k AS ({_KMERS.format(key='item_id', k=9, table='benchmark')}) SELECT kmer, count(DISTINCT item_id) AS n_groups, round(1 / count(DISTINCT item_id), 9) AS weight FROM k WHERE regexp_full_match(kmer, '[ACGT]+') GROUP BY kmer",
    "j9_kmer_votes": f"""WITH q AS (SELECT DISTINCT doc_id, kmer FROM ({_KMERS.format(key='doc_id', k=8, table='documents')}) WHERE regexp_full_match(kmer, '[ACGT]+')), f AS (SELECT * FROM ({_KMERS.format(key='item_id', k=8, table='benchmark')}) WHERE regexp_full_match(kmer, '[ACGT]+')),
        t AS (SELECT * FROM f UNION ALL SELECT item_id, reverse(translate(kmer, 'ACGT', 'TGCA')) FROM f),
        l AS (SELECT kmer, min(item_id) AS item_id FROM t GROUP BY kmer HAVING count(DISTINCT item_id) = 1) SELECT doc_id, item_id, count(*) AS hits FROM q JOIN l USING (kmer) GROUP BY ALL""",
    "a17_letter_runs": f"""WITH s AS (SELECT doc_id, translate(lower(text), '{BASES[0]}', '{BASES[1]}') AS s FROM documents), p AS (SELECT doc_id, unnest(regexp_extract_all(s, '([Nn]+|[^Nn]+)')) AS p, generate_subscripts(regexp_extract_all(s, '([Nn]+|[^Nn]+)'), 1) AS i FROM s),
        e AS (SELECT *, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS e FROM p) SELECT doc_id, e - length(p) AS start, e AS "end", length(p)::BIGINT AS length FROM e WHERE p LIKE 'N%' OR p LIKE 'n%'""",
    "a19_match_scores": """WITH e AS (SELECT event_id, event_type AS t, CAST(floor(epoch(ts)) AS BIGINT) AS pos FROM events), h AS (SELECT DISTINCT t, pos AS tp FROM e WHERE event_id % 2 <> 0),
        c AS (SELECT event_id, t, tp, abs(pos - tp) AS d, row_number() OVER (PARTITION BY event_id ORDER BY abs(pos - tp), tp) AS n FROM e LEFT JOIN h USING (t) WHERE event_id % 2 = 0),
        g AS (SELECT t, count(*) FILTER (d <= 120) AS tp, count(*) FILTER (d > 120 OR d IS NULL) AS fp, count(DISTINCT tp) FILTER (d <= 120) AS f, median(d) FILTER (d <= 120) AS median_distance FROM c WHERE n = 1 GROUP BY t), z AS (SELECT t, count(*) AS n FROM h GROUP BY t),
        r AS (SELECT t, tp, fp, n - f AS fn, median_distance, coalesce(tp / nullif(tp + fp, 0), 0) AS p, f / n AS r FROM g JOIN z USING (t))
        SELECT t AS event_type, tp, fp, fn, median_distance, round(p, 9) AS precision, round(r, 9) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 9) AS f1 FROM r""",
    "f20_f22_identity": f"""WITH s AS (SELECT p_partkey, translate(lower(p_name), '{BASES[0]}', '{BASES[1]}') AS a, translate(lower(p_type), '{BASES[0]}', '{BASES[1]}') AS b FROM part),
        d AS (SELECT *, levenshtein(a, b) AS d, greatest(length(a), length(b)) AS n FROM s) SELECT p_partkey, length(regexp_extract(a, '(A+|T+)$'))::BIGINT AS run, round(CASE WHEN d <= floor(0.7::DOUBLE * n + 1e-9) THEN 1 - d / n END, 9) AS identity FROM d""",
    "s11_vcf_insertions": """SELECT CASE WHEN k % 4 = 0 THEN 'chr' || c || ':' || (k + 1) || ':INS' ELSE 'v' || k END AS id, 'chr' || c AS contig, (k + 1)::INTEGER AS pos, (k + 1)::INTEGER AS "end", (k % 500)::INTEGER AS length, (k % 7)::INTEGER AS support,
        CASE WHEN k % 5 = 0 THEN 'LOW' ELSE 'PASS' END AS filter, (k % 60)::DOUBLE AS quality, CASE WHEN k % 2 <> 0 THEN 'ACGT' END AS alt
        FROM (SELECT o_orderkey AS k, o_custkey % 5 AS c FROM orders) WHERE k % 3 <> 0 AND k % 60 >= 10 AND (k % 500 = 0 OR k % 500 >= 50)""",
    "p1_read_gate": """WITH r AS (SELECT *, CAST(floor(l_quantity) AS BIGINT) AS q FROM lineitem), s AS (SELECT *, q >= 30 AS ins, q >= 25 OR l_linenumber >= 4 AS clip, q % 11 <> 0 AND q % 7 = 0 AS sup FROM r)
        SELECT l_orderkey || '.' || l_linenumber AS qname, l_partkey::INTEGER AS pos, l_partkey + 8 * q AS ref_end, q % 11 <> 0 AND q + 40 >= 50 AND
        CASE WHEN sup OR clip OR ins THEN q * 5 >= 200 AND (ins OR NOT ((q * 4 >= 100 AND q * 3 < 120) OR (l_linenumber * 30 >= 100 AND q * 5 < 120) OR l_linenumber / 8 > 0.2)) ELSE l_suppkey % 61 > 20 END AS kept FROM s""",
    "z5_tumbling": "SELECT event_type, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS start, count(*) AS n, max(value) AS most FROM events GROUP BY ALL",
    "z6_sessions": """WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) >= 86400000000 THEN 1 ELSE 0 END AS n FROM e),
        r AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT user_id, min(t) AS start, max(t) AS "end", count(*) AS n FROM r GROUP BY user_id, run""",
}
