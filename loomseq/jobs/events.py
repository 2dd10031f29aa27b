"""Queries of event consensus, segmentation and alignment over the driver's tables, each with its SQL.

References and reads are spelt from MD5 digests of the tables' keys, so their
sizes follow the tables and both engines spell the same; the SQL states what was
planted.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import md5

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomseq.operators import consensus as K
from loomseq.operators import families as M
from loomseq.operators import fragments as R
from loomseq.operators import segmentation as S
from loomseq.operators import sequences as Q
from loomseq.operators.reads import reference_chunks

C = F.col
HEX = ("0123456789abcdef", "ACGTACGTACGTACGT")
_TO_BASES = str.maketrans(*HEX)
_CHUNK = 512


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over all tasks before anything is spelt for them; a small file would be one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


@F.arrow_udf(T.StringType())
def _spell(seed: pa.Array, blocks: pa.Array) -> pa.Array:
    def one(seed: str, n: int) -> str:
        start = f"{seed}:".encode()
        return b"".join([md5(start + b"%d" % i, usedforsecurity=False).digest() for i in range(n)]).hex().translate(_TO_BASES)

    return pa.array([None if s is None or n is None else one(s, n) for s, n in zip(seed.to_pylist(), blocks.to_pylist(), strict=True)], pa.string())


def spelt(seed: Column, blocks: Column | int) -> Column:
    """32 bases for each block: seeds are spelt a batch at a time, each once however often its bases are named."""
    return _spell(seed.cast("string"), F.lit(blocks).cast("int") if isinstance(blocks, int) else blocks.cast("int"))


def _spelt(seed: str, blocks: str) -> str:
    return f"translate(array_to_string(list_transform(range({blocks}), lambda i: md5({seed} || ':' || i)), ''), '{HEX[0]}', '{HEX[1]}')"


def _planted(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """An event a document, on a reference of its length: paired, duplicated, on the other strand, with one flank, without any, short or failed."""
    d = _read(spark, sf, "documents").select(C("doc_id"), C("doc_id").cast("string").alias("contig"), (30 + F.floor(F.coalesce("n_chars", F.lit(0)) / 256)).cast("int").alias("blocks"))
    d = d.withColumn("sequence", spelt(F.concat(F.lit("ref"), C("contig")), C("blocks")))
    p, k = C("p"), C("kind")
    e = d.withColumns({"p": 300 + C("doc_id") * 7919 % (C("blocks") * 32 - 600), "kind": C("doc_id") % 9})
    cut = lambda a, n: F.substr("sequence", (a + 1).cast("int"), F.lit(n))
    insert = spelt(F.concat(F.lit("ins"), C("contig")), 3)
    noise = spelt(F.concat(F.lit("noise"), C("contig")), 7)
    pair = F.concat(cut(p - 90, 90), insert, cut(p, 90))
    text = (
        F.when(k == 0, pair).when(k == 1, F.concat(cut(p - 90, 90), insert, cut(p - 12, 90))).when(k == 2, F.reverse(F.translate(pair, "ACGT", "TGCA")))
        .when(k == 3, F.concat(cut(p - 90, 90), F.left(noise, F.lit(160)))).when(k == 4, F.concat(F.left(noise, F.lit(160)), cut(p, 90))).when(k == 7, F.left(noise, F.lit(48))).otherwise(noise)
    )
    strong = F.when(k == 5, 8).otherwise(3)
    events = e.select(
        C("doc_id").alias("event"), "contig", p.alias("left"), F.when(k == 1, p - 12).otherwise(p).alias("right"), text.alias("consensus"), (k != 8).alias("consensus_passed"), F.lit(4).alias("input_reads"),
        F.lit(2).alias("left_anchor"), F.lit(2).alias("right_anchor"), F.lit(4).alias("partial"), strong.alias("alt"), F.lit(0).alias("ref_span"),
    )
    return events, reference_chunks(d.select("contig", "sequence"), _CHUNK)


def f30_segmentation(spark: SparkSession, sf: str) -> DataFrame:
    """Flanks of planted events."""
    events, chunks = _planted(spark, sf)
    got = S.segment_events(events, chunks, _CHUNK)
    spans = [C(c) for c in ("left_ref_start", "left_ref_end", "right_ref_start", "right_ref_end", "left_length", "right_length", "strand")]
    return got.select("event", "passed", "qc", *(c.cast("long").alias(n) for c, n in zip(spans, ("left_start", "left_end", "right_start", "right_end", "left_length", "right_length", "strand"), strict=True)), F.md5(C("insert").cast("binary")).alias("insert"), (C("left_identity") + C("right_identity")).alias("identity"))


def _clips(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    o, li = _read(spark, sf, "orders"), _read(spark, sf, "lineitem")
    seg = o.select(C("o_orderkey").alias("event"), F.lit(100).alias("left"), F.lit(110).alias("right"), (C("o_orderkey") % 11 != 0).alias("passed"), F.left(spelt(F.concat(F.lit("o"), C("o_orderkey")), 4), F.when(C("o_orderkey") % 13 == 0, 40).otherwise(128)).alias("insert"))
    k, q, n = C("l_orderkey"), C("l_quantity").cast("int"), C("l_linenumber").cast("int")
    whole = spelt(F.concat(F.lit("o"), k), 4)
    changed = F.concat(F.left(whole, q), F.translate(F.substr(whole, q + 1, q % 19), "ACGT", "CGTA"), F.substr(whole, q + 1 + q % 19))
    kind = F.element_at(F.array(*map(F.lit, ("split", "insertion", "clip_left", "clip_right"))), ((n + q) % 4 + 1).cast("int"))
    frag = li.select(k.alias("event"), n.alias("read"), kind.alias("source"), F.when(kind == "clip_right", F.substr(changed, 129 - (45 + q), F.lit(128))).otherwise(F.left(changed, 45 + q)).alias("sequence"), (70 + q * 3 % 70).alias("junction"), (q % 17 == 0).alias("low_complexity"), (q % 23 == 0).alias("low_anchor"))
    return seg, frag


def f32_concordance(spark: SparkSession, sf: str) -> DataFrame:
    got = S.clip_concordance(*_clips(spark, sf))
    return got.select("event", "full_insert", "left_clip", "right_clip", F.round("left_clip_identity", 9).alias("left_identity"), F.round("right_clip_identity", 9).alias("right_identity"), "concordance")


def a6_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Event strings of order lines as fragments of reads."""
    o, li = _read(spark, sf, "orders"), _read(spark, sf, "lineitem")
    k, n, q = C("l_orderkey"), C("l_linenumber").cast("int"), C("l_quantity").cast("int")
    read = C("l_partkey") % 4
    kind = F.element_at(F.array(*map(F.lit, ("insertion", "clip_left", "clip_right", "split"))), (n % 4 + 1).cast("int"))
    row = li.select(k.alias("event"), read.alias("read"), n.alias("fragment"), kind.alias("source"), F.left(spelt(F.concat_ws("/", k, n), 2), q + 5).alias("sequence"), (30 + q * 2).alias("start"), (q + 5).alias("length"), (980 + q).alias("junction"))
    support = li.where((n + q) % 5 != 0).select(k.alias("event"), read.alias("read"))
    records = li.select(k.alias("event"), read.alias("read"), n.alias("record"), F.left(spelt(F.concat_ws("-", k, n), 8), 120 + q * 2).alias("sequence"), (q % 2 == 0).alias("primary"))
    events = o.select(C("o_orderkey").alias("event"), F.lit(1000).alias("left"), F.lit(995).alias("right"))
    got = K.consensus_inputs(events, support, row, records)
    counts = K.input_counts(got, F.concat_ws("=", "read", C("full").cast("int"), "text"))
    return counts.withColumn("texts", F.md5(F.array_join("texts", ",").cast("binary")))


def a7_consensus(spark: SparkSession, sf: str) -> DataFrame:
    """Reads of each document's sequence, each wrong in one place of its own."""
    d = _read(spark, sf, "documents").select("doc_id", spelt(F.concat(F.lit("truth"), C("doc_id")), 4).alias("s"), F.explode(F.sequence(F.lit(1), (1 + C("doc_id") % 6).cast("int"))).alias("read"))
    at = C("read") * 10 + 5
    text = F.concat(F.left("s", at - 1), F.translate(F.substr("s", at, F.lit(1)), "ACGT", "CGTA"), F.substr("s", at + 1))
    got = K.consensus(d.select(C("doc_id").alias("event"), "read", (C("doc_id") % 5 != 0).alias("full"), text.alias("text")))
    return got.select("event", F.md5(C("consensus").cast("binary")).alias("consensus"), "full_context", C("input_reads").cast("long").alias("input_reads"), "passed", "qc")


def f24_semiglobal(spark: SparkSession, sf: str) -> DataFrame:
    p = _read(spark, sf, "part").select("p_partkey", F.left(spelt(F.concat(F.lit("q"), C("p_partkey")), 1), (4 + C("p_partkey") % 9).cast("int")).alias("q"), F.left(spelt(F.concat(F.lit("t"), C("p_partkey")), 1), (C("p_partkey") % 20).cast("int")).alias("t"))
    return Q.semiglobal_identity(p, "q", "t", "identity").select("p_partkey", F.round("identity", 9).alias("identity"))


def f10_fragments(spark: SparkSession, sf: str) -> DataFrame:
    """Clips and insertions of order lines as reads."""
    q, n = C("l_quantity").cast("int"), C("l_linenumber").cast("int")
    parts = (q * 2, "S", n + 100, "M", q + 30, "I", F.lit(40), "M", n + 60, "I", q + 30, "M", n * 12, "S")
    total = q * 4 + n * 14 + 260
    reads = _read(spark, sf, "lineitem").select(
        (C("l_orderkey") * 10 + n).alias("component"), F.lit("c").alias("contig"), F.lit(1000).alias("anchor"), C("l_orderkey").alias("read"), n.alias("record"), (q % 2 * 16).alias("flag"), F.when(C("l_suppkey") % 3 == 0, 59).otherwise(60).alias("mapq"), (C("l_partkey") * 3).alias("pos"),
        F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts)).alias("cigar"), F.left(spelt(F.concat_ws("+", "l_orderkey", n), F.least(F.lit(20), F.ceil(total / 32))), total).alias("sequence"), F.lit(0).alias("nm"),
    )
    got = R.clip_and_insertion_fragments(reads)
    return got.select("component", "source", "start", "length", "anchor_len", "junction", F.md5(C("sequence").cast("binary")).alias("text"), "name")


def f11_split(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as split reads, with a supplementary record that agrees, one that does not, or none."""
    k = C("o_orderkey")
    n, s = (k % 50 + 620).cast("int"), (k % 100 + 330).cast("int")
    dealt = _dealt(_read(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey")
    o = dealt.select(k.alias("component"), F.lit("c").alias("contig"), F.lit(1000).alias("anchor"), C("o_custkey").alias("read"), F.left(spelt(F.concat(F.lit("s"), k), 21), n).alias("sequence"), n.alias("n"), s.alias("s"), (k % 3).alias("v"), (k % 11 == 0).alias("turned"))
    told = F.concat(F.lit("c,"), C("component") % 7 * 5 + 1001, F.lit(","), F.when(C("turned"), "-").otherwise("+"), F.lit(","), C("s"), F.lit("S"), C("n") - C("s"), F.lit("M,60,"), C("component") % 4, F.lit(";"))
    main = o.select("component", "contig", "anchor", "read", F.lit(1).alias("record"), F.lit(0).alias("flag"), F.lit(60).alias("mapq"), F.lit(700).alias("pos"), F.concat(F.lit("300M"), C("n") - 300, F.lit("S")).alias("cigar"), "sequence", told.alias("sa"), F.lit(None).cast("int").alias("nm"))
    at = (C("s") + F.when(C("v") == 1, C("component") % 5).otherwise(40)).cast("int")
    more = o.where("v > 0").select("component", "contig", "anchor", "read", F.lit(2).alias("record"), F.when(C("turned"), 0x810).otherwise(0x800).alias("flag"), F.lit(60).alias("mapq"), F.lit(1000).alias("pos"), F.concat(at, F.lit("S"), C("n") - at, F.lit("M")).alias("cigar"), "sequence", F.lit(None).cast("string").alias("sa"), F.lit(1).alias("nm"))
    got = R.split_fragments(main.union(more))
    return got.select("component", "start", "length", "anchor_len", "side", "junction", C("nm").cast("long").alias("nm"), "reliable", F.md5(C("sequence").cast("binary")).alias("text"), "name")


def a26_representatives(spark: SparkSession, sf: str) -> DataFrame:
    """Parts in families of 25, each its family's sequence up to a place of its own."""
    k = C("p_partkey")
    same = F.left(spelt(F.concat(F.lit("fam"), F.floor(k / 25)), 4), (k * 37 % 100 + 20).cast("int"))
    lib = _dealt(_read(spark, sf, "part").select(k), "p_partkey").select(F.floor(k / 25).alias("family"), k.alias("member"), k.alias("order"), F.when(k % 50 == 7, "").otherwise(F.concat(same, spelt(F.concat(F.lit("own"), k), 2))).alias("sequence"))
    return M.representatives(lib, 3, 7)


def p20_unknown(spark: SparkSession, sf: str) -> DataFrame:
    """P20: calls on references with runs, single bases or shares of N."""
    d = _read(spark, sf, "documents").select("doc_id", (C("doc_id") % 6).alias("k"), spelt(F.concat(F.lit("n"), C("doc_id")), 40).alias("s"))
    put = lambda at, n: F.concat(F.left("s", F.lit(at)), F.lit("N" * n), F.substr("s", F.lit(at + n + 1)))
    k = C("k")
    ref = F.when(k == 1, put(600, 25)).when(k == 2, put(600, 19)).when(k == 3, put(700, 1)).when(k == 4, F.translate("s", "ACG", "NNN")).when(k == 5, put(1200, 1)).otherwise(C("s"))
    chunks = reference_chunks(d.select(C("doc_id").cast("string").alias("contig"), ref.alias("sequence")), _CHUNK)
    none = C("doc_id") % 5 == 0
    calls = d.select(C("doc_id").alias("call"), C("doc_id").cast("string").alias("contig"), F.when(k == 5, 1200).when(C("doc_id") % 7 == 0, -1).otherwise(702).alias("pos"), F.when(none, -1).otherwise(705).alias("left"), F.when(none, -1).otherwise(700).alias("right"))
    return M.in_unknown_reference(calls, chunks, _CHUNK).select("call", "n_rich", "n_base", "vetoed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (a26_representatives, p20_unknown, f10_fragments, f11_split, f30_segmentation, f32_concordance, a6_inputs, a7_consensus, f24_semiglobal)}

_KIND = """CASE k WHEN 0 THEN {0} WHEN 1 THEN {1} WHEN 2 THEN {2} WHEN 3 THEN {3} WHEN 4 THEN {4} WHEN 5 THEN {5} ELSE {6} END"""
_PASS = "PASS_EVENT_SEGMENTATION"
ORACLES: dict[str, str] = {
    "f30_segmentation": f"""WITH d AS (SELECT doc_id, 30 + coalesce(n_chars, 0) // 256 AS blocks, doc_id % 9 AS k FROM documents), e AS (SELECT *, 300 + doc_id * 7919 % (blocks * 32 - 600) AS p,
        {_spelt("'ins' || doc_id", "3")} AS ins, {_spelt("'noise' || doc_id", "7")} AS noise, {_spelt("'ref' || doc_id", "blocks")} AS ref FROM d)
        SELECT doc_id AS event, k < 6 AS passed, {_KIND.format(f"'{_PASS}'", f"'{_PASS}'", f"'{_PASS}'", f"'{_PASS}_ONE_SIDED_LEFT'", f"'{_PASS}_ONE_SIDED_RIGHT'", f"'{_PASS}_UNPLACED_INSERT'", "CASE k WHEN 6 THEN 'NO_TRIPARTITE_EVENT_SEGMENTATION' WHEN 7 THEN 'EVENT_CONSENSUS_TOO_SHORT' ELSE 'NO_EVENT_CONSENSUS_TO_SEGMENT' END")} AS qc,
          {_KIND.format("p - 90", "p - 90", "p - 90", "p - 90", "p", "p", "-1")} AS left_start, {_KIND.format("p", "p - 12", "p", "p", "p", "p", "-1")} AS left_end,
          {_KIND.format("p", "p", "p", "p", "p", "p", "-1")} AS right_start, {_KIND.format("p + 90", "p + 78", "p + 90", "p", "p + 90", "p", "-1")} AS right_end,
          {_KIND.format("90", "78", "90", "90", "0", "0", "0")}::BIGINT AS left_length, {_KIND.format("90", "78", "90", "0", "90", "0", "0")}::BIGINT AS right_length, {_KIND.format("1", "1", "-1", "1", "1", "0", "0")}::BIGINT AS strand,
          md5({_KIND.format("ins", "substr(ref, (p - 11)::INT, 12) || ins || substr(ref, (p - 11)::INT, 12)", "ins", "left(noise, 160)", "left(noise, 160)", "noise", "''")}) AS insert, {_KIND.format("2", "2", "2", "1", "1", "0", "0")}::DOUBLE AS identity FROM e""",
    "a26_representatives": f"""WITH p AS (SELECT p_partkey AS k, p_partkey // 25 AS family, CASE WHEN p_partkey % 50 = 7 THEN '' ELSE left({_spelt("'fam' || p_partkey // 25", "4")}, (p_partkey * 37 % 100 + 20)::INT) || {_spelt("'own' || p_partkey", "2")} END AS s FROM part),
        m AS (SELECT k, family, coalesce(list_sort(list_distinct(list_transform(range(1, length(s) - 5), lambda i: substr(s, i, 7))))[1:64], []) AS m FROM p),
        d AS (SELECT a.family, a.k AS a, b.k AS b, 1 - len(list_intersect(a.m, b.m))::DOUBLE / greatest(len(a.m) + len(b.m) - len(list_intersect(a.m, b.m)), 1) AS d FROM m a JOIN m b ON a.family = b.family AND a.k <> b.k),
        x1 AS (SELECT family, k FROM (SELECT m.family, m.k, coalesce(sum(1 - d), 0) AS c FROM m LEFT JOIN d ON d.a = m.k GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY family ORDER BY round(c, 9) DESC, k) = 1),
        f2 AS (SELECT d.family, d.b AS k, d.d FROM d JOIN x1 ON d.a = x1.k), x2 AS (SELECT * FROM f2 QUALIFY row_number() OVER (PARTITION BY family ORDER BY d DESC, k) = 1),
        x3 AS (SELECT f2.family, f2.k FROM f2 JOIN x2 ON x2.family = f2.family AND x2.k <> f2.k JOIN d ON d.a = x2.k AND d.b = f2.k QUALIFY row_number() OVER (PARTITION BY f2.family ORDER BY least(f2.d, d.d) DESC, f2.k) = 1)
        SELECT family, k AS member, 1 AS place FROM x1 UNION ALL SELECT family, k, 2 FROM x2 UNION ALL SELECT family, k, 3 FROM x3""",
    "p20_unknown": f"""WITH d AS (SELECT doc_id, doc_id % 6 AS k, {_spelt("'n' || doc_id", "40")} AS s, CASE WHEN doc_id % 6 = 5 THEN 1200 WHEN doc_id % 7 = 0 THEN NULL ELSE 702 END AS pos, doc_id % 5 = 0 AS bare FROM documents),
        r AS (SELECT *, CASE k WHEN 1 THEN left(s, 600) || repeat('N', 25) || substr(s, 626) WHEN 2 THEN left(s, 600) || repeat('N', 19) || substr(s, 620) WHEN 3 THEN left(s, 700) || 'N' || substr(s, 702) WHEN 4 THEN translate(s, 'ACG', 'NNN') WHEN 5 THEN left(s, 1200) || 'N' || substr(s, 1202) ELSE s END AS t,
          CASE WHEN bare THEN pos ELSE 700 END AS lo, CASE WHEN bare THEN pos ELSE 705 END AS hi, coalesce(pos, CASE WHEN NOT bare THEN 702 END) AS anchor FROM d),
        w AS (SELECT *, substr(t, (lo - 249)::INT, (hi + 251 - (lo - 250))::INT) AS c FROM r),
        v AS (SELECT doc_id, coalesce(contains(c, repeat('N', 20)) OR (length(c) - length(replace(c, 'N', ''))) / length(c) >= 0.5, false) AS n_rich, coalesce(substr(t, anchor + 1, 1) = 'N', false) OR (NOT bare AND (substr(t, 701, 1) = 'N' OR substr(t, 706, 1) = 'N')) AS n_base FROM w)
        SELECT doc_id AS call, n_rich, n_base, n_rich OR n_base AS vetoed FROM v""",
    "f10_fragments": f"""WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS component, l_orderkey AS k, l_linenumber::BIGINT AS n, floor(l_quantity)::BIGINT AS q, l_suppkey % 3 <> 0 AS sure, l_partkey * 3 AS pos, left({_spelt("l_orderkey || '+' || l_linenumber", "20")}, (floor(l_quantity)::BIGINT * 4 + l_linenumber * 14 + 260)::INT) AS s FROM lineitem),
        f AS (SELECT *, unnest([{{'source': 'clip_left', 'a': 0, 'len': q * 2, 'anchor': n + 100, 'j': pos, 'tag': 'clipRefL', 'ok': q * 2 >= 50}}, {{'source': 'clip_right', 'a': length(s) - n * 12, 'len': n * 12, 'anchor': q + 30, 'j': pos + n + 170 + q, 'tag': 'clipRefR', 'ok': n * 12 >= 50}},
          {{'source': 'insertion', 'a': q * 2 + n + 100, 'len': q + 30, 'anchor': 40, 'j': pos + n + 100, 'tag': 'ins', 'ok': sure AND q + 30 >= 50}}, {{'source': 'insertion', 'a': q * 3 + n + 170, 'len': n + 60, 'anchor': least(40, q + 30), 'j': pos + n + 140, 'tag': 'ins', 'ok': sure}}]) AS f FROM l)
        SELECT component, f.source AS source, f.a AS start, f.len AS length, f.anchor AS anchor_len, f.j AS junction, md5(substr(s, (f.a + 1)::INT, f.len::INT)) AS text,
          'c:1000|read=' || k || '|idx=' || n || '|strand=' || CASE WHEN q % 2 = 1 THEN '-' ELSE '+' END || '|src=' || f.tag || CASE WHEN f.tag = 'ins' THEN '|start=' || f.a ELSE '' END || '|rj=' || f.j || '|len=' || f.len AS name FROM f WHERE f.ok""",
    "f11_split": f"""WITH o AS (SELECT o_orderkey AS k, o_custkey AS r, o_orderkey % 50 + 620 AS n, o_orderkey % 100 + 330 AS s, o_orderkey % 3 AS v, o_orderkey % 7 * 5 AS g, o_orderkey % 4 AS nm, left({_spelt("'s' || o_orderkey", "21")}, (o_orderkey % 50 + 620)::INT) AS t FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 100 + 30 - o_orderkey % 7 * 5 >= 50),
        f AS (SELECT k, r, t, CASE WHEN g = 0 AND nm <= 1 THEN s - 100 ELSE 288 END AS start, 112 AS length, CASE WHEN g = 0 AND nm <= 1 THEN 151 ELSE 150 END AS anchor_len, 1000 AS junction, CASE WHEN g = 0 AND nm <= 1 THEN nm ELSE -1 END AS nm, true AS reliable, '|qj=' || CASE WHEN g = 0 AND nm <= 1 THEN s ELSE 300 END || '|rj=1000|len=112' AS tail FROM o WHERE v < 2
          UNION ALL SELECT k, r, t, s, n - s, 151 - g, -1, nm, v < 2, '|sa_idx=1|sa=c:' || (g + 1001) || '+|qlen=' || (n - s) FROM o)
        SELECT k AS component, start, length, anchor_len, 'unknown' AS side, junction, nm, reliable, md5(substr(t, (start + 1)::INT, length::INT)) AS text, 'c:1000|read=' || r || '|idx=1|strand=+|src=splitSA' || tail AS name FROM f""",
    "f32_concordance": f"""WITH s AS (SELECT o_orderkey AS event, o_orderkey % 11 <> 0 AS passed, left({_spelt("'o' || o_orderkey", "4")}, CASE WHEN o_orderkey % 13 = 0 THEN 40 ELSE 128 END) AS ins FROM orders),
        l AS (SELECT l_orderkey AS event, l_linenumber::INT AS n, floor(l_quantity)::INT AS q, {_spelt("'o' || l_orderkey", "4")} AS w FROM lineitem),
        c AS (SELECT *, left(w, q) || translate(substr(w, q + 1, q % 19), 'ACGT', 'CGTA') || substr(w, q + 1 + q % 19) AS x, ['split', 'insertion', 'clip_left', 'clip_right'][(n + q) % 4 + 1] AS kind FROM l),
        f AS (SELECT event, n, q, kind, CASE WHEN kind = 'clip_right' THEN substr(x, 129 - (45 + q), 128) ELSE left(x, 45 + q) END AS seq FROM c WHERE 70 + q * 3 % 70 BETWEEN 75 AND 135),
        m AS (SELECT f.*, ins, least(length(seq), length(ins), 300)::INT AS t FROM f JOIN s USING (event) WHERE passed AND length(ins) >= 50),
        i AS (SELECT event, n, kind, CASE WHEN kind IN ('split', 'insertion') THEN CASE WHEN length(seq) >= 50 THEN 1.0 END WHEN t >= 50 AND q % 17 <> 0 AND q % 23 <> 0 THEN 1 - levenshtein(left(seq, t), CASE WHEN kind = 'clip_left' THEN left(ins, t) ELSE right(ins, t) END)::DOUBLE / t END AS y FROM m),
        g AS (SELECT event, count(DISTINCT CASE WHEN kind IN ('split', 'insertion') THEN n END) AS a, count(DISTINCT CASE WHEN kind = 'clip_left' THEN n END) AS b, count(DISTINCT CASE WHEN kind = 'clip_right' THEN n END) AS c,
          max(CASE WHEN kind = 'clip_left' THEN y END) AS yl, max(CASE WHEN kind = 'clip_right' THEN y END) AS yr FROM i WHERE y + 1e-9 >= 0.85 GROUP BY event)
        SELECT event, coalesce(a, 0) AS full_insert, coalesce(b, 0) AS left_clip, coalesce(c, 0) AS right_clip, round(coalesce(yl, 0), 9) AS left_identity, round(coalesce(yr, 0), 9) AS right_identity,
          CASE WHEN NOT passed THEN 'NO_EVENT_SEGMENTATION_FOR_CLIP_INSERT_CONCORDANCE' WHEN length(ins) < 50 THEN 'CLIP_INSERT_CONCORDANCE_INSERT_TOO_SHORT'
            WHEN a >= 1 AND ((b >= 1 AND c >= 1) OR greatest(b, c) >= 2) THEN 'PASS_CLIP_INSERT_CONCORDANCE' ELSE 'NO_CLIP_INSERT_CONCORDANCE' END AS concordance FROM s LEFT JOIN g USING (event)""",
    "a6_inputs": f"""WITH l AS (SELECT l_orderkey AS event, l_partkey % 4 AS read, l_linenumber::INT AS n, floor(l_quantity)::INT AS q, l_linenumber % 4 AS kind FROM lineitem),
        r AS (SELECT event, read, left({_spelt("event || '-' || n", "8")}, 120 + q * 2) AS s FROM l QUALIFY row_number() OVER (PARTITION BY event, read ORDER BY q DESC, q % 2, n) = 1),
        f AS (SELECT l.*, left({_spelt("l.event || '/' || n", "2")}, q + 5) AS ins, s, least(30 + q * 2, 80) AS b, least(length(s) - (35 + q * 3), 80)::INT AS a FROM l JOIN r USING (event, read)
          WHERE 980 + q BETWEEN 970 AND 1025 AND 35 + q * 3 <= length(s) AND (event, read) IN (SELECT (event, read) FROM l WHERE (n + q) % 5 <> 0)),
        t AS (SELECT event, read, n, kind, kind IN (0, 3) AS "full", CASE WHEN kind <> 1 THEN substr(s, 31 + q * 2 - b, b) ELSE '' END || ins || CASE WHEN kind <> 2 THEN substr(s, 36 + q * 3, a) ELSE '' END AS text FROM f
          WHERE (kind = 1 OR b >= 50) AND (kind = 2 OR a >= 50)),
        g AS (SELECT event, read, "full", arg_min(text, (-length(text), n, text)) AS text, bool_or(kind <> 1) AS l, bool_or(kind <> 2) AS r FROM t GROUP BY ALL)
        SELECT event, count(DISTINCT CASE WHEN "full" THEN read END) AS full_reads, count(DISTINCT CASE WHEN NOT "full" THEN read END) AS partial_reads, count(DISTINCT CASE WHEN l THEN read END) AS left_anchor, count(DISTINCT CASE WHEN r THEN read END) AS right_anchor,
          CASE WHEN bool_or("full") THEN count(DISTINCT CASE WHEN "full" THEN read END) ELSE count(DISTINCT read) END AS input_reads,
          md5(string_agg(read || '=' || "full"::INT || '=' || text, ',' ORDER BY read || '=' || "full"::INT || '=' || text)) AS texts FROM g GROUP BY event""",
    "a7_consensus": f"""WITH d AS (SELECT doc_id, {_spelt("'truth' || doc_id", "4")} AS s, 1 + doc_id % 6 AS n, doc_id % 5 <> 0 AS full_context FROM documents),
        r AS (SELECT doc_id, substr(s, 1, (p - 1)::INT) || translate(substr(s, p::INT, 1), 'ACGT', 'CGTA') || substr(s, (p + 1)::INT) AS t FROM (SELECT doc_id, s, unnest(range(1, n + 1)) * 10 + 5 AS p FROM d)),
        f AS (SELECT doc_id, min(t) AS t FROM r GROUP BY doc_id)
        SELECT doc_id AS event, md5(CASE WHEN n >= 3 THEN s WHEN n = 2 OR full_context THEN t ELSE '' END) AS consensus, full_context, n AS input_reads, n >= 2 OR full_context AS passed,
          CASE WHEN n >= 2 OR full_context THEN 'PASS_EVENT_CONSENSUS' ELSE 'INSUFFICIENT_EVENT_READS' END AS qc FROM d JOIN f USING (doc_id)""",
    "f24_semiglobal": f"""WITH p AS (SELECT p_partkey, left({_spelt("'q' || p_partkey", "1")}, (4 + p_partkey % 9)::INT) AS q, left({_spelt("'t' || p_partkey", "1")}, (p_partkey % 20)::INT) AS t FROM part),
        w AS (SELECT p_partkey, q, t, i, unnest(range(1, length(t) - i + 2)) AS n FROM (SELECT *, unnest(range(1, length(t) + 1)) AS i FROM p)),
        b AS (SELECT p_partkey, least(min(levenshtein(q, substr(t, i, n))), any_value(length(q))) AS d FROM w GROUP BY p_partkey)
        SELECT p_partkey, round(CASE WHEN d IS NULL THEN 0 ELSE 1 - d::DOUBLE / length(q) END, 9) AS identity FROM p LEFT JOIN b USING (p_partkey)""",
}
