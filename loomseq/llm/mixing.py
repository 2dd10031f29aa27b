"""Operator 3, mixing sources to target weights by systematic sampling.

Each source gets a target of words (its weight's share, capped at CAP times
its size, the excess reshared). A document's expected copies are its source's
target over size. Within a source, documents stand in an order by size; the
running sum of expected copies, moved by one random offset, emits a document
once for each integer that its step crosses.

The running sum is a rank times a constant, and the rank is found in two steps,
so that no task sorts a whole source: documents are dealt to cells (source,
power of two of the size, one of CELLS hash buckets); a small table of cell
counts gives each cell its start, and a window within the cell the rest.
Everything is integer arithmetic up to one product, so reruns agree. Texts are
read twice: for the cell counts (a small table, written once), and for the ranks.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomseq.llm.common import WORD, table
from loomseq.sources.shared import cut

CELLS, CAP, SEED = 512, 3, 7
WEIGHTS = (1, 2, 3)


def offset(seed: int) -> float:
    """The random offset, 0 <= u < 1, that a seed stands for."""
    return int.from_bytes(hashlib.sha256(str(seed).encode()).digest()[:6], "big") / 2**48


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """From one row for each source (source, source_size): also target.

    Sources by code point, null last, take `weights` in turn. Targets share all
    sizes by weight; one above cap times its size stops there, and the excess is
    reshared. With sources sorted by cap * size / weight, those before some
    point stop and the rest share what is left, so one running sum finds it.
    The windows run over the table of sources, not over documents.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", w)
    s = s.withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    by = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    all_ = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(all_) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumns({"level": left / weight_left, "ratio": F.col("most") / F.col("weight")})
    # The first source that its share does not fill sets the level of all after it.
    level = F.min(F.when(F.col("ratio") > F.col("level"), F.struct(F.col("ratio"), F.col("level")))).over(all_)["level"]
    return s.withColumn("target", F.coalesce(F.least("most", level * F.col("weight")), "most")).select("source", "source_size", "target")


def mix(docs: DataFrame, *, keep: list[str], id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: int = SEED, cells: int = CELLS) -> DataFrame:
    """Columns `keep`, then size, source_size, target (double) and copies (long, at most ceil(cap)).

    Every row is returned once, copies 0 included; explode by copies for the mix
    itself. Null and empty texts have size 0 and are never taken. A null source
    is a source of its own. Repeated rows are separate documents: rows of equal
    size and id stand by the hash of their text, and null ids are dealt by it.
    `keep` must not name the new columns.
    """
    key = ["__source", "__class", "__cell"]
    size = n_words(F.col(text))
    rows = docs.select(*keep, F.col(source).cast("string").alias("__source"), F.col(id).cast("string").alias("__id"), F.xxhash64(F.col(text).cast("string")).alias("__hash"), size.alias("size"))
    rows = rows.withColumns({"__class": F.when(F.col("size") > 0, F.length(F.bin("size"))).otherwise(0), "__cell": (F.conv(F.substring(F.md5(F.coalesce(F.col("__id"), F.col("__hash").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % cells).cast("int")})
    cell = cut(rows.groupBy(*key).agg(F.sum("size").alias("words"), F.count("*").alias("n")), "cells")
    start = cell.withColumn("start", F.coalesce(F.sum("n").over(Window.partitionBy("__source").orderBy("__class", "__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    plan = targets(cell.groupBy("__source").agg(F.sum("words").alias("source_size")).withColumnRenamed("__source", "source"), weights, cap).withColumnRenamed("source", "__s")
    start = start.join(plan, F.col("__source").eqNullSafe(F.col("__s"))).select(*(F.col(k).alias(f"_{k}") for k in key), "start", "source_size", "target")
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("size", "__id", "__hash")) - 1
    rows = rows.withColumn("__rank", rank)
    same = F.col("__source").eqNullSafe(F.col("___source")) & (F.col("__class") == F.col("___class")) & (F.col("__cell") == F.col("___cell"))
    rows = rows.join(start, same)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    at = F.col("start") + F.col("__rank")
    crossed = F.floor((at + 1) * rate + offset(seed)) - F.floor(at * rate + offset(seed))
    copies = F.when(F.col("size") > 0, F.least(crossed, F.lit(int(-(-cap // 1))))).otherwise(0).cast("long")
    return rows.select(*keep, "size", "source_size", "target", copies.alias("copies"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return got.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3.0::DOUBLE * source_size AS most, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM s),
l AS (SELECT *, most / weight AS ratio,
        (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
t AS (SELECT source, source_size, coalesce(least(most, (SELECT arg_min(level, ratio) FROM l WHERE ratio > level) * weight), most) AS target FROM l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
        row_number() OVER (PARTITION BY d.source ORDER BY CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END, ('0x' || md5(CAST(doc_id AS VARCHAR))[:8])::BIGINT % {CELLS}, size, CAST(doc_id AS VARCHAR)) - 1 AS n
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN size > 0 THEN least(floor((n + 1) * rate + {offset(SEED)!r}::DOUBLE) - floor(n * rate + {offset(SEED)!r}::DOUBLE), {CAP}) ELSE 0 END * size)::BIGINT AS taken
FROM r
"""
