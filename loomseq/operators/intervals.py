"""Interval joins, merges and nearest matches over any columns.

Intervals are half-open. A join of intervals is an equi-join on (contig, size
classes, bucket) and a test; each pair is kept in the one bucket where the later start lies, so
no removal of repeated pairs is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomseq.operators.running import running_extreme, running_sums


#: Width of the buckets of the smallest size class; each further class is STEP times as wide.
WIDTH, STEP, CLASSES = 64, 16, 12


def _class(start: Column, end: Column) -> Column:
    """Size class of an interval: the first whose buckets are at least as wide, so that it touches two of them at most."""
    size = F.greatest(end - start, F.lit(1))
    return F.aggregate(F.array(*(F.lit(WIDTH * STEP**i).cast("long") for i in range(CLASSES - 1))), F.lit(0), lambda n, w: n + (size > w).cast("int"))


def _placed(df: DataFrame, start: str, end: str, own: str, other: str, others: list[int]) -> DataFrame:
    """df with its size class (own), a class of the other side (other) and each bucket that it touches at the wider of the two."""
    rows = df.withColumn(own, _class(F.col(start), F.col(end))).withColumn(other, F.explode(F.array(*map(F.lit, others))))
    width = F.lit(WIDTH).cast("long") * F.pow(F.lit(STEP), F.greatest(own, other)).cast("long")
    last = F.greatest(F.col(end), F.col(start) + 1) - 1
    return rows.withColumn("width", width).withColumn("bucket", F.explode(F.sequence(F.floor(F.col(start) / F.col("width")), F.floor(last / F.col("width")))))


def overlap_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of rows whose intervals overlap (l.end > r.start and l.start < r.end) on the same contig.

    left: contig, l_start, l_end and more; right: contig, r_start, r_end and
    more. Rows with a null contig or end point match nothing. Empty intervals
    match what strictly holds them. An interval stands in two buckets at most
    for each size class that the other side has, however long it is.
    """
    fit = lambda d, s, e: d.where(F.col("contig").isNotNull() & F.col(s).isNotNull() & F.col(e).isNotNull())
    left, right = fit(left, "l_start", "l_end"), fit(right, "r_start", "r_end")
    # At most CLASSES numbers a side.
    lefts = [r[0] for r in left.select(_class(F.col("l_start"), F.col("l_end")).alias("c")).distinct().collect()]
    rights = [r[0] for r in right.select(_class(F.col("r_start"), F.col("r_end")).alias("c")).distinct().collect()]
    a = _placed(left, "l_start", "l_end", "__l", "__r", rights or [0])
    b = _placed(right, "r_start", "r_end", "__r", "__l", lefts or [0]).drop("width")
    both = a.join(b, ["contig", "__l", "__r", "bucket"])
    first = F.floor(F.greatest("l_start", "r_start") / F.col("width"))
    return both.where((F.col("l_end") > F.col("r_start")) & (F.col("l_start") < F.col("r_end")) & (F.col("bucket") == first)).drop("bucket", "width", "__l", "__r")


def overlap_totals(spans: DataFrame, wanted: DataFrame, block: int = 1 << 14) -> DataFrame:
    """Rows of wanted that overlap spans (as in overlap_join), with how many they overlap (n), by how much together (shared), the smallest start and the largest end among these (first, last).

    spans: contig, l_start, l_end; wanted: contig, r_start, r_end and more. No
    pair is built: the end points of both sides are laid into one order for each
    contig, and n and shared are differences of running counts and sums there.
    Intervals that end before they start are joined pair by pair.
    """
    fit = lambda d, s, e: d.where(F.col("contig").isNotNull() & F.col(s).isNotNull() & F.col(e).isNotNull())
    spans, wanted = fit(spans.select("contig", F.col("l_start").cast("long"), F.col("l_end").cast("long")), "l_start", "l_end"), fit(wanted, "r_start", "r_end")
    turned_l, turned_r = F.col("l_end") < F.col("l_start"), F.col("r_end") < F.col("r_start")
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    s, e = F.col("l_start"), F.col("l_end")
    each = spans.where(~turned_l).groupBy("contig", "l_start", "l_end").agg(F.count("*").alias("c"))
    c = F.col("c")
    starts = each.select("contig", s.alias("at"), c.alias("starts"), zero.alias("ends"), F.when(s == e, c).otherwise(zero).alias("empty"), e.alias("far"), none.alias("near"))
    ends = each.select("contig", e.alias("at"), zero.alias("starts"), c.alias("ends"), zero.alias("empty"), none.alias("far"), s.alias("near"))
    places = wanted.select("contig", F.col("r_start").cast("long"), F.col("r_end").cast("long")).distinct()
    asked = places.where(~turned_r)
    ask = lambda x: asked.select("contig", F.col(x).alias("at"), zero.alias("starts"), zero.alias("ends"), zero.alias("empty"), none.alias("far"), none.alias("near"))
    points = starts.union(ends).union(ask("r_start")).union(ask("r_end")).groupBy("contig", "at").agg(*(F.sum(x).alias(x) for x in ("starts", "ends", "empty")), F.max("far").alias("far"), F.min("near").alias("near"))
    at = F.col("at")
    points = running_sums(points, ["contig"], [at], {"n_starts": F.col("starts"), "n_ends": F.col("ends"), "s_starts": F.col("starts") * at, "s_ends": F.col("ends") * at})
    points = points.withColumn("__block", F.floor(at / block))
    points = running_extreme(points, "contig", "__block", [at], F.col("far"), "last", last=-1)
    points = running_extreme(points, "contig", "__block", [at], F.col("near"), "first", last=-1, down=True)
    covered = at * (F.col("n_starts") - F.col("n_ends")) - F.col("s_starts") + F.col("s_ends")  # bases of spans before a point
    lo = points.select("contig", at.alias("r_start"), F.col("n_ends").alias("__gone"), F.col("empty").alias("__empty"), covered.alias("__from"), "first")
    hi = points.select("contig", at.alias("r_end"), (F.col("n_starts") - F.col("starts")).alias("__begun"), covered.alias("__to"), "last")
    got = asked.join(lo, ["contig", "r_start"]).join(hi, ["contig", "r_end"])
    n = F.col("__begun") - F.col("__gone") + F.when(F.col("r_start") == F.col("r_end"), F.col("__empty")).otherwise(zero)
    got = got.select("contig", "r_start", "r_end", n.alias("n"), (F.col("__to") - F.col("__from")).alias("shared"), "first", "last").where("n > 0")
    odd_l, odd_r = spans.where(turned_l), places.where(turned_r)
    if not (odd_l.isEmpty() and odd_r.isEmpty()):
        pairs = overlap_join(odd_l, places).unionByName(overlap_join(spans.where(~turned_l), odd_r))
        odd = pairs.groupBy("contig", "r_start", "r_end").agg(F.count("*").alias("n"), F.sum(F.least("l_end", "r_end") - F.greatest("l_start", "r_start")).alias("shared"), F.min("l_start").alias("first"), F.max("l_end").alias("last"))
        got = got.unionByName(odd).groupBy("contig", "r_start", "r_end").agg(*(f(x).alias(x) for f, x in ((F.sum, "n"), (F.sum, "shared"), (F.min, "first"), (F.max, "last"))))
    return wanted.join(got, ["contig", "r_start", "r_end"]).select(*wanted.columns, "n", "shared", "first", "last")


def runs(df: DataFrame, key: str, start: str, end: str, gap: int, block: int) -> DataFrame:
    """Distinct intervals of a key, how often each occurs (n), and the start of the run that it belongs to (head)."""
    rows = df.where(F.col(key).isNotNull() & F.col(start).isNotNull() & F.col(end).isNotNull()).groupBy(key, start, end).agg(F.count("*").alias("n"))
    rows = rows.withColumn("__block", F.floor(F.col(start) / block))
    order = [F.col(start), F.col(end)]
    rows = running_extreme(rows, key, "__block", order, F.col(end), "__reach", last=-1)
    first = F.when(F.col("__reach").isNull() | (F.col(start) > F.col("__reach") + gap), F.col(start))
    return running_extreme(rows, key, "__block", order, first, "head").drop("__reach", "__block")


def merge_intervals(df: DataFrame, contig: str, start: str, end: str, gap: int, block: int = 1 << 16) -> DataFrame:
    """contig, start, end, n: intervals of a contig joined while a start is at most the running end plus gap. Rows with a null in these columns are left out."""
    found = runs(df.select(contig, start, end), contig, start, end, gap, block)
    return found.groupBy(contig, "head").agg(F.max(end).alias("__end"), F.sum("n").alias("__n")).select(contig, F.col("head").alias("start"), F.col("__end").alias("end"), F.col("__n").alias("n"))


def gap_clusters(df: DataFrame, key: str, position: str, gap: int, block: int = 1 << 22) -> DataFrame:
    """key, start, end, support, centre: positions of a key split where two neighbours are more than gap apart; centre is the median, the mean of the middle two truncated. The median of a cluster is taken over its distinct positions and their counts."""
    found = runs(df.select(key, F.col(position).alias("__p"), F.col(position).alias("__e")), key, "__p", "__e", gap, block)
    return found.groupBy(key, "head").agg(
        F.max("__p").alias("end"), F.sum("n").alias("support"), F.floor(F.percentile("__p", F.lit(0.5), F.col("n"))).cast("long").alias("centre")
    ).select(key, F.col("head").alias("start"), "end", "support", "centre")


def nearest(calls: DataFrame, truth: DataFrame, key: str, position: str, radius: int, block: int = 1 << 22) -> DataFrame:
    """calls, with truth_position and distance of the nearest truth of the same key within radius (else null); truth may serve many calls, and the one before wins a tie. A call with a null key or position matches none.

    Both sides are laid into one order for each key; the neighbours are the
    running largest and the next smallest truth, so no pair is ever built.
    """
    points = calls.select(key, position).distinct().withColumn("__t", F.lit(None).cast("long"))
    marks = truth.where(F.col(position).isNotNull()).select(key, position).distinct().withColumn("__t", F.col(position).cast("long"))
    rows = points.unionByName(marks).where(F.col(key).isNotNull() & F.col(position).isNotNull()).groupBy(key, position).agg(F.max("__t").alias("__t"))
    rows = rows.withColumn("__block", F.floor(F.col(position) / block))
    rows = running_extreme(rows, key, "__block", [F.col(position)], F.col("__t"), "__b")
    rows = running_extreme(rows, key, "__block", [F.col(position)], F.col("__t"), "__a", down=True)
    db, da = F.col(position) - F.col("__b"), F.col("__a") - F.col(position)
    rows = rows.withColumn("truth_position", F.when(da.isNull() | (db <= da), F.col("__b")).otherwise(F.col("__a")))
    rows = rows.withColumn("distance", F.abs(F.col(position) - F.col("truth_position"))).where(F.col("distance") <= radius)
    return calls.join(rows.select(key, position, "truth_position", "distance"), [key, position], "left").select(*calls.columns, "truth_position", "distance")
