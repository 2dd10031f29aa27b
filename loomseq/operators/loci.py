"""Clusters of signals and calls along a contig: density clusters, head-anchored loci, dominated calls.

Rows that cannot touch are cut apart first (islands), by blocked running
windows; what depends on an order within an island is one pass over sorted
rows, which holds the state of one cluster only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomseq.functions.support import LOCUS_GAP, same_locus
from loomseq.operators.intervals import overlap_join, runs
from loomseq.operators.running import running_sums
from loomseq.sources.shared import cut

#: Positions further apart are never in one cluster; a block of an island has at most so many signals. Distances under which two signals are neighbours, both from alignments or not. Fixed values.
GAP, MOST, NEAR, FAR, STRONG = 4000, 1500, 250.0, 500.0, 5


def density_labels(pos: np.ndarray, length: np.ndarray, intra: np.ndarray, least: int) -> np.ndarray:
    """Cluster number (from 1) of each signal of one block; 0: noise.

    Two signals are neighbours if the distance of (pos, end, length) is below
    NEAR (both intra) or FAR. A signal with `least` in reach, itself included,
    is a core; linked cores are a cluster, numbered by its first core. Others
    belong to the last cluster with a core in reach.
    """
    d = 2.0 * (pos[:, None] - pos) ** 2 + (length[:, None] - length) ** 2  # an end is its position plus one
    near = np.sqrt(d) < np.where(intra[:, None] & intra, NEAR, FAR)
    core = near.sum(1) >= least
    label, n = np.zeros(len(pos), np.int64), 0
    for i in np.flatnonzero(core):
        if label[i]:
            continue
        n += 1
        grown, edge = np.zeros(len(pos), bool), np.array([i])
        while len(edge):
            grown[edge] = True
            edge = np.flatnonzero(near[edge].any(0) & core & ~grown)
        label[grown] = n
    for c in range(1, n + 1):
        label[~core & near[core & (label == c)].any(0)] = c
    return label


def density_clusters(signals: DataFrame, contig: str, pos: str, length: str, source: str, read: str, strong: int = STRONG) -> DataFrame:
    """signals with `block` and `cluster`: density clusters of `strong` signals, then of those left over each linked group.

    Signals of a contig are cut where positions are more than GAP apart, and
    every MOST signals of the order (pos, length, read). `source` is 'cigar' for
    signals within one alignment. Rows with a null in these columns go.
    """
    rows = signals.where(F.col(contig).isNotNull() & F.col(pos).isNotNull() & F.col(length).isNotNull() & F.col(read).isNotNull())
    heads = runs(rows.select(contig, F.col(pos).alias("__p"), F.col(pos).alias("__e")), contig, "__p", "__e", GAP, 1 << 22).select(contig, F.col("__p").alias(pos), F.col("head").alias("__head")).distinct()
    rows = rows.join(heads, [contig, pos])
    rows = running_sums(rows, [contig, "__head"], [F.asc(pos), F.asc(length), F.asc(read), F.asc(source)], {"__n": F.lit(1)})
    rows = rows.withColumn("__part", F.floor((F.col("__n") - 1) / MOST))
    schema = T.StructType([*rows.schema.fields, T.StructField("block", T.StringType()), T.StructField("cluster", T.LongType())])

    def label(block):
        block = block.sort_values("__n")
        p, n, intra = block[pos].to_numpy(np.float64), block[length].to_numpy(np.float64), (block[source] == "cigar").to_numpy()
        first = density_labels(p, n, intra, strong)
        rest = np.flatnonzero(first == 0)
        first[rest] = density_labels(p[rest], n[rest], intra[rest], 1) + first.max(initial=0)
        return block.assign(block=f"{block[contig].iloc[0]}:{block['__head'].iloc[0]}:{block['__part'].iloc[0]}", cluster=first)

    return rows.groupBy(contig, "__head", "__part").applyInPandas(label, schema).drop("__head", "__n", "__part")


def describe_clusters(clustered: DataFrame, contig: str, pos: str, length: str, source: str, read: str) -> DataFrame:
    """One row for each cluster: start, end, anchor (the upper median position), reads (distinct), and distinct reads by source."""
    of = lambda kind: F.count_distinct(F.when(F.col(source) == kind, F.col(read))).alias(f"{kind}_reads")
    middle = F.element_at(F.array_sort(F.collect_list(pos)), (F.floor(F.count("*") / 2) + 1).cast("int"))  # a cluster has MOST signals at most
    out = clustered.groupBy(contig, "block", "cluster").agg(F.min(pos).alias("start"), (F.max(pos) + 1).alias("end"), middle.alias("anchor"), F.count("*").alias("signals"), F.count_distinct(read).alias("reads"), of("cigar"), of("split"), of("clip"), F.max(length).alias("longest"))
    return out.drop("block", "cluster")


def head_clusters(rows: DataFrame, keys: list[str], order: list[Column], left: str, right: str, gap: int = LOCUS_GAP) -> DataFrame:
    """rows with `head`: the number, within the keys, of the cluster that the row joins in `order`; a cluster grows while a row is in the locus of its first row, not of the row before.

    left and right are longs without nulls, left <= right. One pass over sorted
    rows; the state is the first row of the current cluster.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("head", T.LongType())])
    at = {c: i for i, c in enumerate(rows.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, lo, hi = None, 0, 0, 0
        for b in batches:
            found = []
            ks = zip(*(b.column(at[k]).to_pylist() for k in keys), strict=True)
            for k, a, e in zip(ks, b.column(at[left]).to_pylist(), b.column(at[right]).to_pylist(), strict=True):
                if k == key:
                    apart = max(0, a - hi, lo - e)
                    if apart > (0 if hi > lo and e > a else gap):
                        n, lo, hi = n + 1, a, e
                else:
                    key, n, lo, hi = k, 0, a, e
                found.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.int64())], names=schema.names)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def one_of_each_locus(calls: DataFrame, contig: str, left: str, right: str, order: list[str], prefer: list[Column], gap: int = LOCUS_GAP) -> DataFrame:
    """The best call of each head-anchored locus: `prefer` (descending), ties to the first in `order` (which should be total).

    Loci are cut apart where no call reaches the next by `gap`, and each piece is
    one pass. Calls with a null contig or end go.
    """
    rows = calls.where(F.col(contig).isNotNull() & F.col(left).isNotNull() & F.col(right).isNotNull())
    rows = rows.withColumns({"__l": F.least(left, right).cast("long"), "__r": F.greatest(left, right).cast("long")})
    heads = runs(rows.select(contig, "__l", "__r"), contig, "__l", "__r", gap, 1 << 22).select(contig, "__l", "__r", F.col("head").alias("__island")).distinct()
    rows = rows.join(heads, [contig, "__l", "__r"])
    found = head_clusters(rows, [contig, "__island"], [F.col(c).asc() for c in order], "__l", "__r", gap)
    w = Window.partitionBy(contig, "__island", "head").orderBy(*(p.desc() for p in prefer), *order)
    return found.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(*calls.columns)


def near_pairs(a: DataFrame, b: DataFrame, gap: int) -> DataFrame:
    """Pairs of rows of one contig whose closed intervals touch or lie at most `gap` apart. a: contig, l_start, l_end; b: contig, r_start, r_end; and more."""
    wide = a.withColumns({"l_start": F.col("l_start") - gap, "l_end": F.col("l_end") + gap + 1})
    got = overlap_join(wide, b.withColumn("r_end", F.col("r_end") + 1))
    return got.withColumns({"l_start": F.col("l_start") + gap, "l_end": F.col("l_end") - gap - 1, "r_end": F.col("r_end") - 1})


def undominated(calls: DataFrame, id: str, contig: str, left: str, right: str, features: list[str], costs: list[str], promoted: str, gap: int = LOCUS_GAP) -> DataFrame:
    """Calls that no other call of their locus beats: at least as good in all features (higher) and costs (lower), better in one. A promoted call cannot remove a direct one.

    Calls of one cell are all of each other's locus, and most are beaten by one
    of the cell's best, by each feature and cost; only the rest are compared
    with all calls of their locus.
    """
    cols = [id, *features, *costs, promoted]
    p = len(cols) - 1
    if p == 1:
        return calls
    lo, hi = F.least(left, right), F.greatest(left, right)
    step = max(1, min(gap, 2 * gap // 5))
    under = lambda x: F.floor(x / step) * step
    cell = F.when(lo < 0, None).when(hi == lo, under(lo)).when(under(hi) >= lo, under(hi))  # intervals hold their cell's point; points lie behind it, within the gap
    ok = calls.where(F.col(id).isNotNull()).select(F.col(contig).alias("contig"), lo.alias("lo"), hi.alias("hi"), cell.alias("cell"), *(F.col(c).alias(f"v_{i}") for i, c in enumerate(cols)))

    def beaten(a: list[Column], b: list[Column]) -> Column:
        good = [(a[i], b[i]) for i in range(1, 1 + len(features))] + [(b[i], a[i]) for i in range(1 + len(features), p)]
        no_worse, better = F.lit(True), F.lit(False)
        for x, y in good:
            no_worse, better = no_worse & (y >= x), better | (y > x)
        return (a[0] != b[0]) & no_worse & better & ~(b[p] & ~a[p])

    v = [F.col(f"v_{i}") for i in range(p + 1)]
    worth = [v[i] if i <= len(features) else -v[i] for i in range(1, p)]
    orders = [F.struct(*(w.alias(f"w_{i}") for i, w in enumerate(worth[n:] + worth[:n]))) for n in range(len(worth))]
    whole = F.struct(*(c.alias(f"v_{i}") for i, c in enumerate(v)))
    best = [F.max_by(F.when(kind, whole), F.when(kind, o)) for o in orders for kind in (F.lit(True), ~v[p])]
    heads = ok.where("contig IS NOT NULL AND cell IS NOT NULL").groupBy("contig", "cell").agg(*(b.alias(f"best_{i}") for i, b in enumerate(best)))
    by_head = F.lit(False)
    for i in range(len(best)):
        by_head |= F.coalesce(beaten(v, [F.col(f"best_{i}.v_{n}") for n in range(p + 1)]), F.lit(False))
    known = cut(ok.join(heads, ["contig", "cell"], "left").select(ok["contig"], "lo", "hi", *v, by_head.alias("lost")), "calls")

    side = lambda d, s, n: d.select("contig", F.col("lo").alias(f"{s}_start"), F.col("hi").alias(f"{s}_end"), *(c.alias(f"{n}_{i}") for i, c in enumerate(v)))
    pairs = near_pairs(side(known.where("NOT lost"), "l", "a"), side(known, "r", "b"), gap).where(same_locus(F.col("l_start"), F.col("l_end"), F.col("l_start"), F.col("r_start"), F.col("r_end"), F.col("r_start"), gap))
    lost = pairs.where(beaten(*([F.col(f"{n}_{i}") for i in range(p + 1)] for n in "ab"))).select(F.col("a_0").alias(id)).distinct()
    return calls.join(lost.union(known.where("lost").select(F.col("v_0").alias(id))), id, "left_anti")
