"""Small orders and sets within one row or one key: names, ranks, picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weight of the evidence class of a hypothesis, by priority. Fixed values.
WEIGHTS = (8, 8, 7, 1, 6, 1)


def names_union(*arrays: Column) -> Column:
    """Distinct names, trimmed and in order; nulls and empty names go."""
    every = F.concat(*(F.coalesce(a, F.expr("cast(array() as array<string>)")) for a in arrays))
    return F.array_sort(F.array_distinct(F.filter(F.transform(every, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct names; 0 for two empty sets."""
    both, all_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(all_ > 0, both / all_).otherwise(0.0)


def ranked_hypotheses(df: DataFrame, key: str, support: str, priority: str, left: str, right: str, anchor: str) -> DataFrame:
    """df with score and rank within a key: support times the weight of the evidence class, then the distance to the anchor, support, priority, left, right."""
    weight = F.coalesce(F.get(F.array(*map(F.lit, WEIGHTS)), F.col(priority).cast("int")), F.lit(1))
    away = F.least(F.abs(F.col(left) - F.col(anchor)), F.abs(F.col(right) - F.col(anchor)))
    w = Window.partitionBy(key).orderBy(F.desc("score"), away, F.desc(support), F.asc(priority), F.asc(left), F.asc(right))
    return df.withColumn("score", F.col(support) * weight).withColumn("rank", F.row_number().over(w))


def insertion_pick(df: DataFrame, read: str, length: str, pos: str, start: str, end: str, longest: int = 2, most: int = 4, reach: int = 1000) -> DataFrame:
    """Of each read the `longest` longest insertions, and up to `most` together with those within `reach` of the component."""
    w = Window.partitionBy(read).orderBy(F.desc(length), F.asc(pos))
    local = F.col(pos).between(F.col(start) - reach, F.col(end) + reach)
    rows = df.withColumn("__n", F.row_number().over(w)).where((F.col("__n") <= longest) | local)
    again = Window.partitionBy(read).orderBy("__n")
    return rows.withColumn("__m", F.row_number().over(again)).where(F.col("__m") <= most).drop("__n", "__m")


def longest_texts(df: DataFrame, key: str, text: str, most: int = 48) -> DataFrame:
    """Up to `most` texts of a key, the longest first, then by the text."""
    w = Window.partitionBy(key).orderBy(F.desc(F.length(text)), F.asc(text))
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows drawn without replacement (lowest keyed hash first), labelled S01, S02 and so on. An error if there are fewer."""
    drawn = df.withColumn("__h", F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256)).orderBy("__h", key).limit(n)
    rows = drawn.withColumn("label", F.format_string("S%02d", F.row_number().over(Window.orderBy("__h", key)))).drop("__h")  # n rows
    have = drawn.count()
    if have < n:
        raise ValueError(f"{n} rows asked of {have}")
    return rows


def top_groups(df: DataFrame, group: str, value: str, n: int = 30) -> DataFrame:
    """The n groups with the largest sum above 0, ties by name."""
    return df.groupBy(group).agg(F.sum(value).alias("total")).where("total > 0").orderBy(F.desc("total"), group).limit(n)


def diverse_top(df: DataFrame, key: str, order: list[Column], left: str, right: str, most: int, apart: int = 30) -> DataFrame:
    """Up to `most` rows of a key in order, each more than `apart` from every one taken before at one end at least. One pass over sorted rows; the state is the rows taken. 0 takes all."""
    import pyarrow as pa

    if not most:
        return df
    names = df.columns
    key_at, left_at, right_at = (names.index(c) for c in (key, left, right))

    def run(batches):
        current, taken = object(), []
        for b in batches:
            keep = []
            for i, (k, x, y) in enumerate(zip(b.column(key_at).to_pylist(), b.column(left_at).to_pylist(), b.column(right_at).to_pylist(), strict=True)):
                if k != current:
                    current, taken = k, []
                if len(taken) < most and all(abs(x - p) > apart or abs(y - q) > apart for p, q in taken):
                    taken.append((x, y))
                    keep.append(i)
            yield b.take(pa.array(keep, pa.int64()))

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ok = df.where(F.col(key).isNotNull() & F.col(left).isNotNull() & F.col(right).isNotNull())
    return ok.repartition(n, key).sortWithinPartitions(key, *order).mapInArrow(run, df.schema)
