"""Selection of candidates against null controls: dominance and support p-values, and the cascade of rules after them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomseq.operators.selection import bayes_prefix, e_values, step_up
from loomseq.sources.shared import cut

#: Controls that a context needs to be judged by its own. Fixed value. Distinct controls that go to the tasks at once.
CONTEXT, BLOCK = 12, 100_000


def _finite(df: DataFrame, features: list[str], cost: str) -> DataFrame:
    ok = F.lit(True)
    for c in (*features, cost):
        x = F.col(c).cast("double")
        ok = ok & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return df.where(ok)


def null_p_values(candidates: DataFrame, nulls: DataFrame, features: list[str], cost: str, context: str) -> DataFrame:
    """candidates with n_null, n_dominating, n_support and p.

    Controls of a candidate are those of its context if these are CONTEXT or
    more, else all. One dominates if it is at least as high in every feature
    and at most as high in the cost; it supports if it is as high in the first
    feature. p is the larger of (1 + dominating) / (1 + controls) and
    (1 + supporting) / (1 + controls); 1 without controls or with a feature that
    is null or not finite. Controls with such features do not count.

    Equal controls are counted once. Their distinct rows, a sample's own and few,
    go to the tasks in blocks of BLOCK, a pass over the candidates for each.
    """
    spark = candidates.sparkSession
    num = [F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate((*features, cost))]
    names = [f"f{i}" for i in range(len(num))]
    own = _finite(nulls, features, cost).select(F.col(context).cast("string").alias("ctx"), *num).groupBy("ctx", *names).agg(F.count("*").alias("n"))
    own = cut(own, "nulls")
    by_context = own.groupBy("ctx").agg(F.sum("n").alias("n"))
    total = by_context.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    large = by_context.where(F.col("n") >= CONTEXT).withColumnRenamed("ctx", "c")
    rows = candidates.withColumn("__row", F.monotonically_increasing_id())
    rows = rows.join(large, F.col(context).cast("string").eqNullSafe(F.col("c")), "left")
    rows = cut(rows.withColumns({"__pooled": F.col("n").isNull(), "n_null": F.coalesce("n", F.lit(total))}).drop("n", "c"), "candidates")
    fine = _finite(rows, features, cost).select("__row", "__pooled", F.col(context).cast("string").alias("ctx"), *num)
    blocks = max(1, -(-own.count() // BLOCK))
    parts = None
    for b in range(blocks):
        some = (own if blocks == 1 else own.where(F.pmod(F.xxhash64("ctx", *names), F.lit(blocks)) == b)).toPandas()  # about BLOCK rows
        sent = spark.sparkContext.broadcast((some.ctx.to_numpy(object), some[names].to_numpy(np.float64), some.n.to_numpy(np.int64)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ctx, x, n = sent.value
            place = {c: np.flatnonzero(ctx == c) for c in set(ctx.tolist())}
            for batch in batches:
                pooled, own_ctx = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                y = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3, 3 + len(names))], 1)
                dom, sup = [], []
                for p, c, v in zip(pooled, own_ctx, y, strict=True):
                    at = slice(None) if p else place.get(c, np.zeros(0, np.int64))
                    f, m = x[at], n[at]
                    dom.append(int(m[(f[:, :-1] >= v[:-1]).all(1) & (f[:, -1] <= v[-1])].sum()))
                    sup.append(int(m[f[:, 0] >= v[0]].sum()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dom, pa.int64()), pa.array(sup, pa.int64())], names=["__row", "d", "s"])

        part = fine.mapInArrow(run, "__row long, d long, s long")
        parts = part if parts is None else parts.unionByName(part)
    got = parts.groupBy("__row").agg(F.sum("d").alias("n_dominating"), F.sum("s").alias("n_support"))
    p = F.when(F.col("n_dominating").isNull() | (F.col("n_null") == 0), 1.0).otherwise((1 + F.greatest("n_dominating", "n_support")) / (1 + F.col("n_null")))
    return rows.join(got, "__row", "left").withColumn("p", p).drop("__row", "__pooled")


def conformal_select(candidates: DataFrame, nulls: DataFrame, features: list[str], cost: str, context: str, q: float) -> DataFrame:
    """candidates with p, threshold, selected and reason: null p-values and the step-up rule. Without controls nothing is selected."""
    any_null = not _finite(nulls, features, cost).isEmpty()
    got = step_up(null_p_values(candidates, nulls, features, cost, context), "p", q)
    selected = F.col("selected") if any_null else F.lit(False)
    reason = F.when(F.lit(not any_null), "CONFORMAL_NULL_INSUFFICIENT").when(F.col("selected"), "PASS_CONFORMAL").otherwise("CONFORMAL_REJECT")
    return got.withColumns({"selected": selected, "reason": reason})


def select_in_turn(calls: DataFrame, id: str, p: str, lfdr: str, e: str, enough: bool, q: float) -> DataFrame:
    """calls with selected_by: the first rule that takes a call, null if none does.

    step_up over p (if there are enough controls; else a prefix by local fdr),
    then e-values, then the prefix by local fdr. Each rule ranks only what the
    ones before left. ids are distinct; ties in the local fdr go by id.
    """
    rules = [
        ("conformal" if enough else "lfdr_fallback", (lambda d: step_up(d, p, q)) if enough else (lambda d: bayes_prefix(d, None, lfdr, id, q))),
        ("e_values", lambda d: e_values(d, e, q)),
        ("bayes", lambda d: bayes_prefix(d, None, lfdr, id, q)),
    ]
    left, out = cut(calls.select(id, p, lfdr, e), "calls"), None
    for name, rule in rules:
        found = cut(rule(left).select(id, p, lfdr, e, "selected"), name)
        got = found.where("selected").select(id, F.lit(name).alias("selected_by"))
        out = got if out is None else out.unionByName(got)
        left = found.where("NOT selected").drop("selected")
    return calls.join(out, id, "left")
