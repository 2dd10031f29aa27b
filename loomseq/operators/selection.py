"""Selection under false-discovery control, null tails and sets of support."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomseq.operators.running import running_sums, running_total
from loomseq.sources.shared import cut

#: Owners of more names than this do not meet others at pairs of names.
PAIRED = 64


def empirical_tail(df: DataFrame, nulls: DataFrame, value: str) -> DataFrame:
    """df with tail = (1 + number of nulls >= value) / (2 + number of nulls). Both sides are counted by distinct value first."""
    n = nulls.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("__x")).agg(F.count("*").alias("c"))
    here = df.where(F.col(value).isNotNull()).select(F.col(value).alias("__x")).distinct().withColumn("c", F.lit(0).cast("long"))
    each = cut(n.unionByName(here).groupBy("__x").agg(F.sum("c").alias("c")), "values")
    total = each.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    tail = running_total(each, "__x", "c", "k", descending=True).select("__x", ((F.col("k") + 1) / (F.lit(total) + 2)).alias("tail"))
    return df.join(tail, F.col(value) == F.col("__x"), "left").drop("__x")


def harmonic(m: int) -> float:
    """1 + 1/2 + ... + 1/m; beyond 1,000 terms by its expansion, to 1e-13."""
    if m <= 1000:
        return math.fsum(1 / i for i in range(1, m + 1))
    return harmonic(1000) + math.log(m / 1000.0) + (1 / (2 * m) - 1 / 2000.0) - (1 / (12 * m * m) - 1 / 12_000_000.0)


def _ranked(df: DataFrame, value: str, descending: bool = False) -> tuple[DataFrame, int]:
    """Distinct values that are no null, how many rows have each up to it (rank), and how many rows there are."""
    each = cut(df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("__x")).agg(F.count("*").alias("n")), "values")
    total = each.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return running_total(each, "__x", "n", "rank", descending=descending), total


def e_values(df: DataFrame, e: str, q: float, cap: float = math.exp(40)) -> DataFrame:
    """df with selected: e-values (at most `cap` each), largest first, up to the largest rank with e * q * rank >= the number of e-values. Equal e stand or fall together; a null e is not selected and not counted."""
    capped = df.withColumn("__e", F.least(F.col(e).cast("double"), F.lit(cap)))
    ranked, m = _ranked(capped, "__e", descending=True)
    least = ranked.where(F.col("__x") * q * F.col("rank") >= m).agg(F.min("__x")).first()[0]
    return capped.withColumn("selected", F.coalesce(F.col("__e") >= F.lit(least), F.lit(False))).drop("__e")


def step_up(df: DataFrame, p: str, q: float) -> DataFrame:
    """df with selected and threshold: the Benjamini-Yekutieli step-up rule at level q.

    Rows with equal p stand or fall together. threshold is, for selected rows,
    that of the largest selected rank, for others rank * q / (m * H(m)) of the
    largest rank with their p. A null p is not counted, not selected and has no
    threshold.
    """
    ranked, m = _ranked(df, p)
    step = q / (m * harmonic(m)) if m else 0.0
    ranked = cut(ranked.select("__x", (F.col("rank") * F.lit(step)).alias("threshold")), "ranks")
    last = ranked.where(F.col("__x") <= F.col("threshold")).agg(F.max(F.struct("__x", "threshold"))).first()[0]
    chosen = F.coalesce(F.col(p) <= F.lit(last["__x"]), F.lit(False)) if last else F.lit(False)
    out = df.join(ranked, F.col(p) == F.col("__x"), "left").withColumn("selected", chosen)
    return out.withColumn("threshold", F.when(F.col("selected"), F.lit(last["threshold"] if last else None)).otherwise(F.col("threshold"))).drop("__x")


def bayes_prefix(df: DataFrame, group: str | None, lfdr: str, order: str, q: float) -> DataFrame:
    """df with rank and running_mean of the local fdr in ascending order (lfdr, then order) within a group (None: the whole table), and selected: up to the largest rank whose mean is at most q (within 1e-9, as running sums of doubles depend on how they are added). A null lfdr counts in no mean and sorts first."""
    keys = [] if group is None else [group]
    by = [F.col(lfdr).asc(), F.col(order).asc()]
    rows = running_sums(df, keys, by, {"rank": F.lit(1), "__n": F.when(F.col(lfdr).isNotNull(), 1).otherwise(0), "__sum": F.coalesce(F.col(lfdr), F.lit(0.0))})
    rows = cut(rows.withColumns({"rank": F.col("rank").cast("int"), "running_mean": F.col("__sum") / F.nullif("__n", F.lit(0))}).drop("__n", "__sum"), "means")
    fine = rows.where(F.col("running_mean") <= q + 1e-9)
    if group is None:
        return rows.withColumn("selected", F.coalesce(F.col("rank") <= F.lit(fine.agg(F.max("rank")).first()[0]), F.lit(False)))
    last = fine.groupBy(F.col(group).alias("__g")).agg(F.max("rank").alias("__last"))
    return rows.join(last, F.col(group).eqNullSafe(F.col("__g")), "left").withColumn("selected", F.coalesce(F.col("rank") <= F.col("__last"), F.lit(False))).drop("__g", "__last")


def support_edges(df: DataFrame, owner: str, name: str, shared: int = 2, jaccard: float = 0.5) -> DataFrame:
    """a < b, n_shared, jaccard: owners that share `shared` names, or one name at this Jaccard similarity.

    Where two names are asked, owners meet at pairs of names, so those that share
    one name only are not paired; one name is enough for owners of few names,
    which meet at it. Owners of more than PAIRED names are counted name by name.
    """
    sets = df.select(F.col(owner).alias("o"), F.col(name).alias("x")).where("o IS NOT NULL AND x IS NOT NULL").distinct()
    sets = cut(sets.join(sets.groupBy("o").agg(F.count("*").alias("n")), "o"), "sets")
    side = lambda d, o, n: d.withColumnsRenamed({"o": o, "n": n})
    met = lambda d, key: side(d, "a", "na").join(side(d, "b", "nb"), key).where("a < b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("n_shared"))
    if shared < 2 or jaccard * PAIRED <= 1:
        pairs = met(sets, "x")
    else:
        small = sets.where(F.col("n") <= PAIRED)
        names = small.groupBy("o", "n").agg(F.sort_array(F.collect_list("x")).alias("xs")).where("n > 1")  # at most PAIRED
        firsts = names.select("o", "n", "xs", F.posexplode("xs").alias("i", "x"))
        two = firsts.select("o", "n", "x", F.explode(F.slice("xs", F.col("i") + 2, PAIRED)).alias("y"))
        # Of s names s (s - 1) / 2 pairs are shared.
        more = met(two, ["x", "y"]).withColumn("n_shared", F.round((1 + F.sqrt(1 + 8 * F.col("n_shared"))) / 2).cast("long"))
        few = small.where(F.col("n") <= 1 / jaccard)
        close = side(few, "a", "na").join(side(few, "b", "nb"), "x").where((F.col("a") < F.col("b")) & (1 / (F.col("na") + F.col("nb") - 1) >= jaccard))
        lone = close.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("n_shared")).where("n_shared = 1")
        big = side(sets.where(F.col("n") > PAIRED), "a", "na").join(side(sets, "b", "nb"), "x").where((F.col("a") < F.col("b")) | ((F.col("a") > F.col("b")) & (F.col("nb") <= PAIRED)))
        turned = F.col("a") > F.col("b")
        ends = [F.when(turned, F.col(v)).otherwise(F.col(u)).alias(u) for u, v in (("a", "b"), ("b", "a"), ("na", "nb"), ("nb", "na"))]
        pairs = more.unionByName(lone).unionByName(big.select(*ends).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("n_shared")))
    pairs = pairs.withColumn("jaccard", F.col("n_shared") / (F.col("na") + F.col("nb") - F.col("n_shared")))
    return pairs.where((F.col("n_shared") >= shared) | (F.col("jaccard") >= jaccard)).select("a", "b", "n_shared", "jaccard")


def length_histogram(df: DataFrame, group: str, length: str) -> DataFrame:
    """group, bin, n, total: lengths in 1-10, 11-100, 101-1000 and above, empty bins of a group kept as zero."""
    bin_ = F.when(F.col(length) <= 10, "1-10").when(F.col(length) <= 100, "11-100").when(F.col(length) <= 1000, "101-1000").otherwise(">1000")
    have = df.where(F.col(length) >= 1).groupBy(group, bin_.alias("bin")).agg(F.count("*").alias("n"), F.sum(length).alias("total"))
    bins = df.select(group).distinct().withColumn("bin", F.explode(F.array(*map(F.lit, ("1-10", "11-100", "101-1000", ">1000")))))
    return bins.join(have, [group, "bin"], "left").select(group, "bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0)).alias("total"))
