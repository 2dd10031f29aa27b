"""One-to-one matches, coverage and scores of calls against a truth set."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomseq.operators.components import components
from loomseq.operators.intervals import overlap_join, runs
from loomseq.operators.loci import near_pairs
from loomseq.sources.shared import cut


def point_pairs(calls: DataFrame, truth: DataFrame, radius: int) -> DataFrame:
    """contig, call, truth, distance of all pairs of positions at most `radius` apart. calls: contig, call, pos; truth: contig, truth, pos. Rows with a null match nothing."""
    a = calls.select("contig", "call", F.col("pos").alias("l_start"), F.col("pos").alias("l_end"))
    b = truth.select("contig", "truth", F.col("pos").alias("r_start"), F.col("pos").alias("r_end"))
    return near_pairs(a, b, radius).select("contig", "call", "truth", F.abs(F.col("l_start") - F.col("r_start")).alias("distance"))


def _islands(calls: DataFrame, truth: DataFrame, radius: int) -> DataFrame:
    """contig, pos, island: positions of both sides, cut apart where two neighbours lie more than the radius apart. No pair reaches over a cut."""
    points = calls.select("contig", "pos").unionByName(truth.select("contig", "pos")).select("contig", "pos", F.col("pos").alias("__e"))
    return runs(points, "contig", "pos", "__e", radius, 1 << 22).select("contig", "pos", F.xxhash64("contig", "head").alias("island"))


def match_one_to_one(calls: DataFrame, truth: DataFrame, radius: int) -> DataFrame:
    """call, truth, distance: pairs taken by (distance, call, truth), each call and each truth once.

    Positions are cut into islands that no pair reaches over; an island's pairs
    stream by in order through one task, whose state is the ids taken there.
    Repeated ids count as one: islands that share one are one. Rows with a null
    match nothing.
    """
    spark = calls.sparkSession
    island = _islands(calls, truth, radius)
    a = calls.where(F.col("call").isNotNull()).join(island, ["contig", "pos"]).select("contig", "call", F.col("pos").alias("l_start"), F.col("pos").alias("l_end"), "island")
    b = truth.where(F.col("truth").isNotNull()).select("contig", "truth", F.col("pos").alias("r_start"), F.col("pos").alias("r_end"))
    pairs = near_pairs(a, b, radius).groupBy("call", "truth", "island").agg(F.min(F.abs(F.col("l_start") - F.col("r_start"))).alias("distance"))
    pairs = cut(pairs, "pairs")
    shared = [pairs.groupBy(c).agg(F.min("island").alias("u"), F.max("island").alias("v"), F.collect_set("island").alias("all")).where("u <> v") for c in ("call", "truth")]
    links = cut(shared[0].select("u", F.explode("all").alias("v")).union(shared[1].select("u", F.explode("all").alias("v"))), "shared")  # of repeated ids only
    if links.limit(1).count():
        pairs = pairs.join(components(links, "u", "v"), F.col("island") == F.col("node"), "left").withColumn("island", F.coalesce("root", "island"))
        pairs = pairs.groupBy("call", "truth", "island").agg(F.min("distance").alias("distance"))
    schema = T.StructType([pairs.schema["call"], pairs.schema["truth"], pairs.schema["distance"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, used_calls, used_truth = object(), set(), set()
        for batch in batches:
            keep = []
            for i, (n, c, t) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)):
                if n != current:
                    current, used_calls, used_truth = n, set(), set()
                if c not in used_calls and t not in used_truth:
                    used_calls.add(c)
                    used_truth.add(t)
                    keep.append(i)
            yield batch.select(["call", "truth", "distance"]).take(pa.array(keep, pa.int64()))

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = pairs.select("island", "call", "truth", "distance").repartition(n, "island").sortWithinPartitions("island", "distance", "call", "truth")
    return order.mapInArrow(run, schema)


def match_unused(calls: DataFrame, truth: DataFrame, radius: int, order: str = "call") -> DataFrame:
    """contig, call, truth_pos, distance: each call in `order` takes the nearest position of the truth within the radius that none took before, the smaller on ties.

    Only two neighbours on either side of a call are looked at, taken or not, as
    the rule has it: a call may go without though a free position lies further
    off. Positions of the truth count once. An island (see above) streams by
    through one task, the truth first; the state is its positions. Rows with a
    null contig or position match nothing; `order` should be total in a contig.
    """
    island = _islands(calls, truth, radius)
    kinds = {c: calls.schema[c].dataType.simpleString() for c in ("contig", "call")}
    t = truth.select("contig", "pos").distinct().join(island, ["contig", "pos"]).selectExpr("island", "0 AS side", "CAST(NULL AS {}) AS o".format(calls.schema[order].dataType.simpleString()), "CAST(pos AS BIGINT) AS pos", "contig", "CAST(NULL AS {}) AS call".format(kinds["call"]))
    c = calls.join(island, ["contig", "pos"]).select("island", F.lit(1).alias("side"), F.col(order).alias("o"), F.col("pos").cast("long").alias("pos"), "contig", "call")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, spots, used = object(), [], set()
        for batch in batches:
            keep, found = [], []
            for i, (n, side, at) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True)):
                if n != current:
                    current, spots, used = n, [], set()
                if not side:
                    spots.append(at)
                    continue
                k = bisect_left(spots, at)
                near = [(abs(p - at), p) for p in spots[max(0, k - 2) : k + 2] if p not in used and abs(p - at) <= radius]
                if near:
                    used.add(min(near)[1])
                    keep.append(i)
                    found.append(min(near))
            part = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(4), part.column(5), pa.array([p for _, p in found], pa.int64()), pa.array([d for d, _ in found], pa.int64())], names=["contig", "call", "truth_pos", "distance"])

    n = int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = t.union(c).repartition(n, "island").sortWithinPartitions("island", "side", "o", "pos", "call")
    return rows.mapInArrow(run, f"contig {kinds['contig']}, call {kinds['call']}, truth_pos long, distance long")


def call_scores(calls: DataFrame, truth: DataFrame, matched: DataFrame) -> DataFrame:
    """One row: emitted, tp, fp, fn, precision, recall, f1, family_committed, family_correct, family_wrong, concordance, commit_rate, median_error. A ratio without a denominator is 0, or null for the family figures. calls: call, family; truth: truth, family ('' or null: none)."""
    known = lambda c: F.coalesce(c, F.lit("")) != ""
    m = matched.join(calls.select("call", F.col("family").alias("cf")), "call").join(truth.select("truth", F.col("family").alias("tf")), "truth")
    m = m.agg(
        F.count("*").alias("tp"), F.count_if(known(F.col("cf")) & known(F.col("tf"))).alias("family_committed"), F.count_if(known(F.col("cf")) & (F.col("cf") == F.col("tf"))).alias("family_correct"),
        F.percentile("distance", F.lit(0.5)).alias("median_error"),
    )
    n = calls.agg(F.count("*").alias("emitted")).join(truth.agg(F.count("*").alias("n_truth"))).join(m)  # one row each
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    n = n.withColumns({"precision": F.coalesce(ratio("tp", "emitted"), F.lit(0.0)), "recall": F.coalesce(ratio("tp", "n_truth"), F.lit(0.0))})
    p, r = F.col("precision"), F.col("recall")
    return n.select(
        "emitted", "tp", (F.col("emitted") - F.col("tp")).alias("fp"), (F.col("n_truth") - F.col("tp")).alias("fn"), "precision", "recall", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"),
        "family_committed", "family_correct", (F.col("family_committed") - F.col("family_correct")).alias("family_wrong"), ratio("family_correct", "family_committed").alias("concordance"), ratio("family_committed", "tp").alias("commit_rate"), "median_error",
    )


def stabbed(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """points (contig, point, at, family) with covers and same_family: how many closed intervals (contig, start, end, family) hold the position, and whether one is of its family."""
    a = points.where(F.col("point").isNotNull()).select("contig", "point", F.col("at").alias("l_start"), (F.col("at") + 1).alias("l_end"), F.col("family").alias("pf"))
    b = intervals.select("contig", F.col("start").alias("r_start"), (F.col("end") + 1).alias("r_end"), F.col("family").alias("qf"))
    got = overlap_join(a, b).groupBy("point").agg(F.count("*").alias("covers"), F.bool_or(F.coalesce(F.col("pf") == F.col("qf"), F.lit(False))).alias("same_family"))
    return points.join(got, "point", "left").select(*points.columns, F.coalesce("covers", F.lit(0)).alias("covers"), F.coalesce("same_family", F.lit(False)).alias("same_family"))


def nearest_rows(windows: DataFrame, rows: DataFrame, within: int) -> DataFrame:
    """windows (contig, window, start, end) with n_rows, n_inside, best and distance: rows (contig, row, start, end) at most `within` from the closed window, those that touch it, and the nearest (the smallest on ties)."""
    a = windows.where(F.col("window").isNotNull()).select("contig", "window", F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    b = rows.select("contig", "row", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    d = F.greatest(F.col("r_start") - F.col("l_end"), F.col("l_start") - F.col("r_end"), F.lit(0))
    got = near_pairs(a, b, within).withColumn("d", d).groupBy("window").agg(F.count("*").alias("n_rows"), F.count_if(F.col("d") == 0).alias("n_inside"), F.min(F.struct("d", "row")).alias("m"))
    out = windows.join(got, "window", "left")
    return out.select(*windows.columns, F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_inside", F.lit(0)).alias("n_inside"), F.col("m.row").alias("best"), F.col("m.d").alias("distance"))


def evaluation_summary(results: DataFrame, subset: str, detected: str, values: list[str]) -> DataFrame:
    """subset (null: all together), n, n_detected, rate, and sum, mean and max of each value."""
    stats = [f(v).alias(f"{n}_{v}") for v in values for n, f in (("sum", F.sum), ("mean", F.avg), ("max", F.max))]
    hit = F.count_if(F.coalesce(F.col(detected), F.lit(False)))
    return results.rollup(subset).agg(F.grouping(subset).alias("overall"), F.count("*").alias("n"), hit.alias("n_detected"), (hit / F.count("*")).alias("rate"), *stats)


def threshold_sweep(scored: DataFrame, score: str, truth: str, thresholds: DataFrame) -> DataFrame:
    """threshold, emitted, tp, precision, recall of keeping rows with a score of at most the threshold. thresholds: one column `threshold`; scores are first counted by the smallest threshold that holds them, so no row meets more than one."""
    cuts = F.array(*(F.lit(r[0]).cast("double") for r in thresholds.select("threshold").distinct().orderBy("threshold").collect()))
    first = F.array_min(F.filter(cuts, lambda t: F.col(score) <= t))
    true = F.coalesce(F.col(truth), F.lit(False))
    each = scored.groupBy(first.alias("first")).agg(F.count("*").alias("n"), F.count_if(true).alias("t"))
    all_true = each.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("all_true"))
    listed = each.join(all_true).withColumn("threshold", F.explode(F.filter(cuts, lambda t: F.col("first") <= t)))  # one row a threshold at most
    got = listed.groupBy("threshold").agg(F.sum("n").alias("emitted"), F.sum("t").alias("tp"), F.first("all_true").alias("all_true"))
    return got.select("threshold", "emitted", "tp", (F.col("tp") / F.col("emitted")).alias("precision"), F.when(F.col("all_true") > 0, F.col("tp") / F.col("all_true")).otherwise(0.0).alias("recall"))
