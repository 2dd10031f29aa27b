"""Connected components of a large set of links, by alternating star steps.

Each round turns every node's links into a star around its smallest neighbour,
first from the larger side, then from the smaller; the links become one star
for each component in about log(n) rounds. A round is joins and grouped minima,
so a node with very many links is pre-aggregated, and its join can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomseq.sources.shared import cut, new_path


def components(links: DataFrame, a: str, b: str, rounds: int = 40) -> DataFrame:
    """Columns node and root (the component's smallest node) of every node that has a link to another one.

    links: pairs of longs; nulls, self-links and repeats are ignored. An empty
    input gives an empty result.
    """
    e = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    paths = [new_path(links.sparkSession, "links") for _ in range(2)]  # rounds write them in turn
    e = cut(e, path=paths[0])
    mark = _mark(e)
    for i in range(1, rounds + 1):
        if not mark[0]:
            break
        # Larger neighbours of each node move to its smallest neighbour.
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Smaller neighbours of each node, and itself, move to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(moved.union(low.select("u", F.col("m").alias("v"))).distinct(), path=paths[i % 2])
        now = _mark(e)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle within {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mark(e: DataFrame) -> tuple:
    """Changes whenever the set of links does."""
    r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return (r[0], r[1])
