"""Running totals and running maxima over one long order, without one long task.

A window over a whole table, or over a key that holds a third of it, is one
task. Here the order is split into blocks; a window runs within each block, and
the blocks before add one number each. All frames begin at the unbounded
preceding row, which Spark keeps as one running state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomseq.sources.shared import cut

_UP_TO_HERE = (Window.unboundedPreceding, 0)
_BEFORE = (Window.unboundedPreceding, -1)


def running_sums(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with each of `sums` added up over the rows of the same `keys` up to this one in `order`.

    `order` should be total within a key. Rows are range-partitioned by keys and
    order and written once; each partition is a block, so neither a key that
    holds the whole table nor the table itself is one task. Null keys are keys.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = {f"__s{i}": c.alias(f"__s{i}") for i, c in enumerate(sums.values())}
    rows = df.select("*", *named.values()).repartitionByRange(n, *(F.col(k) for k in keys), *order).withColumn("__b", F.spark_partition_id())
    rows = cut(rows, "ordered")
    totals = rows.groupBy(*keys, "__b").agg(*(F.sum(s).alias(s) for s in named))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(*_BEFORE)  # one row for each block
    totals = totals.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__b").alias("__bb"), *(F.coalesce(F.sum(s).over(before), F.lit(0)).alias(s + "_before") for s in named))
    same = F.col("__b") == F.col("__bb")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    within = Window.partitionBy("__b", *keys).orderBy(*order).rowsBetween(*_UP_TO_HERE)
    out = {name: F.sum(s).over(within) + F.col(s + "_before") for name, s in zip(sums, named, strict=True)}
    return rows.join(totals, same).select(*df.columns, *(c.alias(name) for name, c in out.items()))


def running_total(df: DataFrame, order: str, value: str, out: str, descending: bool = False) -> DataFrame:
    """df with `out`, the sum of `value` over all rows up to this one in `order`, which is distinct (count repeated values first)."""
    return running_sums(df, [], [F.desc(order) if descending else F.asc(order)], {out: F.col(value)})


def running_extreme(df: DataFrame, key: str, block: str, order: list[Column], value: Column, out: str, *, last: int = 0, down: bool = False) -> DataFrame:
    """df with `out`: within a key, the maximum of `value` over the rows up to `last` (0: this row, -1: the one before); with down, the minimum over the rows up to `last` of the order turned round.

    `block` is a column that does not fall along the order (that does not rise
    along the order turned round, with down); a key's blocks are joined by one
    number each. `order` is ascending; with down it is walked from its end.
    """
    best = F.min if down else F.max
    rows = df.withColumn("__v", value)
    ends = rows.groupBy(key, block).agg(best("__v").alias("__v"))
    beyond = Window.partitionBy(key).orderBy(F.desc(block) if down else F.asc(block)).rowsBetween(*_BEFORE)
    ends = ends.select(key, block, best("__v").over(beyond).alias("__beyond"))
    within = Window.partitionBy(key, block).orderBy(*(c.desc() if down else c for c in order)).rowsBetween(Window.unboundedPreceding, last)
    both = (F.least if down else F.greatest)(best("__v").over(within), "__beyond")  # these skip nulls
    return rows.join(ends, [key, block]).withColumn(out, both).drop("__v", "__beyond")
