"""Where a component's event may lie: hypotheses from clusters of positions, their diverse choice, collapse and shortlist.

The enumeration is joins and windows over clusters. The choices go through a
component's hypotheses in order and keep the first that fit; a component has at
most 112 of them (6 clusters a side for three kinds of pairs, 2 for each of two
single kinds), so a pass over sorted rows holds one component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomseq.operators.intervals import gap_clusters
from loomseq.operators.sets import WEIGHTS

#: Reach around seeds and precise positions, distance to which fragments count as linked, gap of a cluster, clusters kept (single, a side), span of a pair.
REACH, LINKED, GAP, SINGLE, SIDE, PAIR = 200, 1000, 75, 2, 6, 250
#: Slack of one place, reach and score of a pick at the anchor, distance of a rescued pick, likeness of names that collapses, slack and likeness of the shortlist.
PLACE, AT_ANCHOR, AT_SCORE, RESCUED, ALIKE, APART, DISTINCT = 30, 100, 8, 500, 0.8, 60, 0.5
#: Priority of the hypothesis that stands for none. Fixed value.
NONE = 2147483647
_PAIRED = {0: ("split_left", "split_right"), 2: ("raw_split_left", "raw_split_right"), 3: ("clip_left", "clip_right"), 5: ("raw_clip_left", "raw_clip_right")}
_ALONE = {1: "insertion", 4: "raw_insertion"}


def weight(priority: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, WEIGHTS)), F.when(priority < len(WEIGHTS), priority).cast("int")), F.lit(1))


def search_windows(components: DataFrame, precise: DataFrame, fragments: DataFrame) -> DataFrame:
    """components (component, anchor, left, right) with lo and hi: 200 around the seeds, and around every precise candidate and every insertion or split whose junction lies within 1,000 of the seeds.

    precise: component, pos; fragments: component, source, junction.
    """
    lo, hi = F.least("left", "right"), F.greatest("left", "right")
    seeds = components.select("component", lo.alias("a"), hi.alias("b"))
    linked = fragments.where(F.col("source").isin("insertion", "split")).select("component", F.col("junction").alias("pos")).join(seeds, "component")
    linked = linked.where(F.greatest(F.col("a") - F.col("pos"), F.col("pos") - F.col("b")) <= LINKED).select("component", "pos")
    far = precise.select("component", "pos").union(linked).where("pos >= 0").groupBy("component").agg(F.min("pos").alias("__a"), F.max("pos").alias("__b"))
    out = components.join(far, "component", "left")
    start = F.greatest(F.least(lo, F.coalesce("__a", lo)) - REACH, F.lit(0))
    return out.select(*components.columns, start.alias("lo"), F.greatest(hi + REACH, F.coalesce(F.col("__b"), hi) + REACH, F.greatest(lo - REACH, F.lit(0)) + 1).alias("hi"))


def enumerate_hypotheses(components: DataFrame, precise: DataFrame, fragments: DataFrame, signals: DataFrame, top_k: int = 0) -> DataFrame:
    """component, anchor, left, right, center, support, priority, score and rank: places of the event, from clusters of fragments' and raw signals' positions within the search window.

    components: component, anchor, left, right; precise: component, pos;
    fragments: component, source (split, insertion, clip_left, clip_right), side
    (left, right or else), junction; signals: component, and for a read
    split_left, split_right, clip_left, clip_right, insertion (null or negative:
    none). A read with both split sides counts on the nearer one. Clusters of two
    sides pair up within 250; without the other side a cluster stands alone. Of
    equal places the first kind counts. A component without any has its anchor.
    """
    w = search_windows(components, precise, fragments).select("component", "anchor", "lo", "hi")
    kind = F.when(F.col("source") == "split", F.when(F.col("side").isin("left", "right"), F.concat(F.lit("split_"), F.col("side")))).otherwise(F.col("source"))
    placed = fragments.select("component", kind.alias("kind"), F.col("junction").cast("long").alias("pos"))
    s = signals.join(w, "component")
    inside = lambda c: F.when((F.col(c) >= 0) & F.col(c).between(F.col("lo"), F.col("hi")), F.col(c).cast("long"))
    sl, sr = F.col("split_left"), F.col("split_right")
    both = (sl >= 0) & (sr >= 0)
    dl, dr = F.abs(sl - F.col("anchor")), F.abs(sr - F.col("anchor"))
    take_left = (dl < dr) | ((dl == dr) & (sl <= sr))
    each = F.array(
        F.struct(F.lit("raw_split_left").alias("kind"), F.when(F.coalesce(both & ~take_left, F.lit(False)), None).otherwise(inside("split_left")).alias("pos")),
        F.struct(F.lit("raw_split_right").alias("kind"), F.when(F.coalesce(both & take_left, F.lit(False)), None).otherwise(inside("split_right")).alias("pos")),
        *(F.struct(F.lit(f"raw_{c}").alias("kind"), inside(c).alias("pos")) for c in ("clip_left", "clip_right", "insertion")),
    )
    raw = s.select("component", F.explode(each).alias("x")).select("component", "x.kind", "x.pos")
    rows = placed.join(w, "component").where(F.col("pos").between(F.col("lo"), F.col("hi"))).select("component", "kind", "pos").union(raw).where("kind IS NOT NULL AND pos IS NOT NULL")

    found = gap_clusters(rows.select(F.struct("component", "kind").alias("k"), "pos"), "k", "pos", GAP).select("k.component", "k.kind", "support", F.col("centre").alias("center")).join(components.select("component", "anchor"), "component")
    place = Window.partitionBy("component", "kind").orderBy(F.desc("support"), F.abs(F.col("center") - F.col("anchor")), "center")
    alone = F.col("kind").isin(*_ALONE.values())
    found = found.withColumn("n", F.row_number().over(place)).where(F.col("n") <= F.when(alone, SINGLE).otherwise(SIDE)).where("center >= 0")
    of = lambda names: F.coalesce(*(F.when(F.col("kind") == n, p) for p, n in names.items()))
    one = found.where(alone).select("component", of(_ALONE).alias("priority"), F.col("n").alias("a"), F.lit(0).alias("b"), F.col("center").alias("left"), F.col("center").alias("right"), "support")
    side = lambda i, x: found.where(F.col("kind").isin(*(v[i] for v in _PAIRED.values()))).select("component", of({p: v[i] for p, v in _PAIRED.items()}).alias("priority"), F.col("n").alias(x), F.col("center").alias(x + "c"), F.col("support").alias(x + "s"))
    two = side(0, "a").join(side(1, "b"), ["component", "priority"], "full")
    left, right = F.least("ac", "bc"), F.greatest("ac", "bc")  # these skip nulls
    two = two.where(right - left <= PAIR).select("component", "priority", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"), left.alias("left"), right.alias("right"), (F.coalesce("as", F.lit(0)) + F.coalesce("bs", F.lit(0))).alias("support"))
    first = Window.partitionBy("component", "left", "right").orderBy("priority", "a", "b")
    every = one.union(two).withColumn("n", F.row_number().over(first)).where("n = 1").select("component", "left", "right", "support", "priority")
    none = components.join(every.select("component").distinct(), "component", "left_anti").select("component", F.greatest("anchor", F.lit(0)).cast("long").alias("left"), F.greatest("anchor", F.lit(0)).cast("long").alias("right"), F.lit(1).cast("long").alias("support"), F.lit(NONE).alias("priority"))
    out = every.union(none).join(components.select("component", "anchor"), "component")
    out = out.withColumns({"center": F.floor((F.col("left") + F.col("right")) / 2), "score": F.col("support") * weight(F.col("priority"))})
    order = Window.partitionBy("component").orderBy(F.desc("score"), F.abs(F.col("center") - F.col("anchor")), F.desc("support"), "priority", "left", "right")
    out = out.withColumn("rank", F.row_number().over(order)).select("component", "anchor", "left", "right", "center", "support", "priority", "score", "rank")
    return out.where(F.col("rank") <= top_k) if top_k > 0 else out


def _values(column: pa.Array) -> list:
    """A column's values; whole numbers without nulls, and lists of such, go through NumPy."""
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy().tolist()
    if pa.types.is_list(column.type) and not column.null_count:
        flat, ends = _values(column.flatten()), [0, *pa.compute.cumulative_sum(column.value_lengths()).to_pylist()]
        return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return column.to_pylist()


def picked(batches: Iterator[pa.RecordBatch], at: list[int], choose: Callable[[list[tuple]], list[int]], out: str) -> Iterator[pa.RecordBatch]:
    """Rows that `choose` picks of each key, in batches of rows sorted by key; at: where the key and what it needs stand. Keys are many and small, so the picks of all keys that end in a batch leave together."""
    current, rows, held, size, first = None, [], [], 0, 0  # held: rows not yet given out; first: where the current key begins there
    picks: list[int] = []
    places: list[int] = []

    def end_key() -> None:
        got = choose(rows)
        picks.extend(first + i for i in got)
        places.extend(range(1, len(got) + 1))

    def given() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).take(pa.array(picks, pa.int64())).append_column(out, pa.array(places, pa.int32()))
        yield from table.combine_chunks().to_batches()

    for b in batches:
        keys, *values = (_values(b.column(i)) for i in at)
        each = list(zip(*values, strict=True))
        held.append(b)
        start = 0
        for i, k in enumerate(keys):
            if current is None or k != current[0]:
                rows.extend(each[start:i])
                if current is not None:
                    end_key()
                current, rows, start, first = (k,), [], i, size + i
        rows.extend(each[start:])
        if picks:
            yield from given()
            picks.clear()
            places.clear()
        if first >= size:  # the current key begins in this batch
            held, first, size = [b.slice(first - size)], 0, b.num_rows - (first - size)
        else:
            size += b.num_rows
    if current is not None:
        end_key()
        if picks:
            yield from given()


def _chosen(df: DataFrame, key: str, order: list[Column], needed: list[str], choose: Callable[[list[tuple]], list[int]], out: str) -> DataFrame:
    """Rows of a key that `choose` picks from the tuples of `needed` in order, with their place among the picks (from 1). One pass over sorted rows; the state is one key's rows."""
    at = [df.columns.index(c) for c in (key, *needed)]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.where(F.col(key).isNotNull()).repartition(n, key).sortWithinPartitions(key, *order).mapInArrow(lambda batches: picked(batches, at, choose, out), f"{kinds}, `{out}` int")


def diverse_hypotheses(df: DataFrame, top_k: int) -> DataFrame:
    """Up to `top_k` hypotheses of each component in rank, each more than 30 from every one taken before at one end at least, with `place`.

    Then, if none of them lies within 100 of the anchor, the nearest of score 8
    or more is taken (in the last one's stead where top_k are taken), and one
    precise hypothesis of one read (split or insertion fragments, one position)
    that lies 500 or more from all taken is added, the nearest. A component of
    top_k hypotheses or fewer, or top_k = 0, passes whole.
    df: component, anchor, left, right, center, support, priority, score, rank.
    """

    def choose(rows: list[tuple]) -> list[int]:
        if not top_k or len(rows) <= top_k:
            return list(range(len(rows)))
        left, right, center, support, priority, score, anchor = zip(*rows, strict=True)
        taken: list[int] = []
        for i in range(len(rows)):
            if all(abs(left[i] - left[j]) > PLACE or abs(right[i] - right[j]) > PLACE for j in taken):
                taken.append(i)
                if len(taken) == top_k:
                    break
        has = lambda i: any(left[i] == left[j] and right[i] == right[j] for j in taken)
        away = lambda i: abs(center[i] - anchor[i])
        if not any(away(i) <= AT_ANCHOR for i in taken):
            near = [i for i in range(len(rows)) if not has(i) and score[i] >= AT_SCORE]
            if not near:
                return taken
            best = min(near, key=lambda i: (away(i), -score[i], -support[i], priority[i], left[i], right[i], i))
            if len(taken) < top_k:
                taken.append(best)
            else:
                taken[-1] = best
        lone = [i for i in range(len(rows)) if not has(i) and priority[i] in (0, 1) and left[i] == right[i] and support[i] <= 1 and all(abs(center[i] - center[j]) >= RESCUED for j in taken)]
        return taken + ([min(lone, key=lambda i: (away(i), priority[i], center[i], i))] if lone else [])

    return _chosen(df, "component", [F.asc("rank")], ["left", "right", "center", "support", "priority", "score", "anchor"], choose, "place")


def _alike(a: frozenset, b: frozenset) -> float:
    union = len(a | b)
    return len(a & b) / union if union else 0.0


def collapse_hypotheses(df: DataFrame) -> DataFrame:
    """Hypotheses of each component without near-repeats, with `place`: in order, a row joins the first kept one within 30 at both ends and with 0.8 of all read names shared, and stands for it if it is better (more reads, then more precise ones, a smaller width, the earlier).

    df: component, index (the order), left, right, alt, split, indel, names
    (array, null as empty). Two rows without names never join.
    """

    def choose(rows: list[tuple]) -> list[int]:
        names = [frozenset(r[6] or ()) for r in rows]
        better = lambda i: (-rows[i][3], -(rows[i][4] + rows[i][5]), abs(rows[i][2] - rows[i][1]), rows[i][0])
        kept: list[int] = []
        for i, r in enumerate(rows):
            for k, j in enumerate(kept):
                if abs(r[1] - rows[j][1]) <= PLACE and abs(r[2] - rows[j][2]) <= PLACE and _alike(names[i], names[j]) >= ALIKE:
                    if better(i) < better(j):
                        kept[k] = i
                    break
            else:
                kept.append(i)
        return kept

    return _chosen(df, "component", [F.asc("index")], ["index", "left", "right", "alt", "split", "indel", "names"], choose, "place")


def shortlist(df: DataFrame) -> DataFrame:
    """The feasible hypotheses of each component that go on, with `place` (1: the first): in order, those that lie more than 60 at one end from every one before, or share under half of their names; and one precise hypothesis of one read 500 or more from all of these.

    df: component, index, left, right, names, feasible, precise, full, left_anchor,
    right_anchor, alt, anchor, support, priority, score. Order: precise reads,
    reads with full context, the weaker side's anchors, width, distance to the
    anchor, alt, index.
    """

    def choose(rows: list[tuple]) -> list[int]:
        index, left, right, names, support, priority, score = zip(*rows, strict=True)
        sets = [frozenset(n or ()) for n in names]
        taken: list[int] = []
        for i in range(len(rows)):
            if not any(abs(left[i] - left[j]) <= APART and abs(right[i] - right[j]) <= APART and _alike(sets[i], sets[j]) >= DISTINCT for j in taken):
                taken.append(i)
        middle = [a + int((b - a) / 2) for a, b in zip(left, right, strict=True)]
        lone = [
            i for i in range(len(rows))
            if support[i] == 1 and priority[i] in (0, 1) and left[i] == right[i]
            and all(index[i] != index[j] and (left[i], right[i]) != (left[j], right[j]) and abs(left[i] - middle[j]) >= RESCUED for j in taken)
        ]
        return taken + ([min(lone, key=lambda i: (priority[i], -score[i], left[i], i))] if lone else [])

    c = F.col
    width = F.greatest(c("right") - c("left"), F.lit(0))
    away = F.least(F.abs(c("left") - c("anchor")), F.abs(c("right") - c("anchor")))
    order = [F.desc("precise"), F.desc("full"), F.least("left_anchor", "right_anchor").desc(), width.asc(), away.asc(), F.desc("alt"), F.asc("index")]
    return _chosen(df.where("feasible"), "component", order, ["index", "left", "right", "names", "support", "priority", "score"], choose, "place")
