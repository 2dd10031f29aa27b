"""Families of a library: bottom sketches of their members, and members that stand for them; calls that lie in unknown reference."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomseq.functions.sequence import kmers
from loomseq.operators.reads import windows_of
from loomseq.sources.shared import cut

#: K-mers of a sketch; reach around a call, the run and the share of N that make a context unknown.
SKETCH, CONTEXT, RUN, SHARE = 64, 250, 20, 0.5
#: Members of a family that are compared with another as many at a time, about.
BLOCK = 64


def sketch(sequence: Column, k: int) -> Column:
    """The first SKETCH distinct k-mers of A, C, G and T in their order."""
    return F.slice(F.sort_array(F.array_distinct(kmers(F.upper(sequence), k))), 1, SKETCH)


def sketch_distance(a: Column, b: Column) -> Column:
    """1 - shared by all k-mers of two sketches; 1 for two empty ones."""
    shared = F.size(F.array_intersect(a, b))
    return 1 - shared / F.greatest(F.size(a) + F.size(b) - shared, F.lit(1))


def likeness(sketches: DataFrame, block: int = BLOCK) -> DataFrame:
    """family, order, close: a member's likeness (shared by all k-mers) to the others of its family, added up; members like no other may be left out.

    sketches: family, order, mins. A family's members are dealt into blocks of
    about `block`, and a cell is all pairs within a block or between two. Cells
    are spread over all tasks, which hold one at a time, so a family may be as
    large as the table.
    """
    blocks = sketches.groupBy("family").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("order"), "blocks").cast("int")
    each = sketches.join(blocks, "family").select("family", "order", "mins", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = each.select("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "order", "mins")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            whole = pa.Table.from_batches([b] if last is None else [last, b]).combine_chunks().to_batches()[0]
            keys = list(zip(*(whole.column(i).to_pylist() for i in range(3)), strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1])]
            last = whole.slice(cuts[-1])  # its cell may go on in the next batch
            yield from added(whole.slice(0, cuts[-1]), cuts)
        if last is not None and last.num_rows:
            yield from added(last, [0, last.num_rows])

    def added(b: pa.RecordBatch, cuts: list[int]) -> Iterator[pa.RecordBatch]:
        if not b.num_rows:
            return
        own, (i, j) = b.column(3).to_numpy(), (b.column(c).to_numpy() for c in (1, 2))
        n = b.column(5).value_lengths().to_numpy().astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(n)])
        words = b.column(5).flatten().dictionary_encode().indices.to_numpy()
        out = np.zeros(b.num_rows)
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            which, word = np.unique(words[ends[s] : ends[e]], return_inverse=True)
            has = np.zeros((e - s, len(which)), np.float32)
            has[np.repeat(np.arange(e - s), n[s:e]), word] = 1
            shared = (has @ has.T).astype(np.float64)
            like = shared / np.maximum(n[s:e, None] + n[s:e] - shared, 1)
            like[(own[s:e, None] == own[s:e]) if i[s] != j[s] else np.eye(e - s, dtype=bool)] = 0  # pairs within a block belong to its own cell
            out[s:e] = like.sum(1)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(4), pa.array(out)], names=["family", "order", "close"])

    kind = {f.name: f.dataType.simpleString() for f in sketches.schema}
    n = int(sketches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    got = cells.repartition(n, "family", "i", "j").sortWithinPartitions("family", "i", "j").mapInArrow(run, f"family {kind['family']}, `order` {kind['order']}, close double")
    return got.groupBy("family", "order").agg(F.sum("close").alias("close"))


def representatives(library: DataFrame, limit: int, k: int) -> DataFrame:
    """family, member, place: up to `limit` members of each family, the medoid (the smallest sum of distances) first, then each time the one farthest from all taken; ties to the smaller `order`.

    library: family, member, order (total in a family), sequence; rows with a
    null family are left out. Sums are compared to nine digits. The medoid costs
    the square of a family's members, in cells of two blocks; a further pick is
    one join of each member with its family's last pick.
    """
    rows = cut(library.where("family IS NOT NULL").select("family", "member", "order", sketch(F.coalesce("sequence", F.lit("")), k).alias("mins")), "sketches")
    close = likeness(rows)
    # A sum of distances is the members less their likeness, so the medoid has the most of it.
    first = Window.partitionBy("family").orderBy(F.round(F.coalesce("close", F.lit(0.0)), 9).desc(), "order")
    left = rows.join(close, ["family", "order"], "left").withColumn("__n", F.row_number().over(first))
    taken = left.where("__n = 1").select("family", "member", "order", "mins", F.lit(1).alias("place"))
    out = taken.select("family", "member", "place")
    left = left.where("__n > 1").select("family", "member", "order", "mins", F.lit(2.0).alias("far"))
    for place in range(2, limit + 1):
        last = taken.select("family", F.col("mins").alias("__mins"))
        far = F.least("far", sketch_distance(F.col("mins"), F.col("__mins")))
        best = Window.partitionBy("family").orderBy(F.desc("far"), "order")
        left = cut(left.join(last, "family").withColumn("far", far).drop("__mins").withColumn("__n", F.row_number().over(best)), "far")
        taken = left.where("__n = 1").select("family", "member", "order", "mins", F.lit(place).alias("place"))
        out = out.union(taken.select("family", "member", "place"))
        left = left.where("__n > 1").drop("__n")
    return out if limit > 0 else out.limit(0)


def in_unknown_reference(calls: DataFrame, chunks: DataFrame, size: int) -> DataFrame:
    """calls (call, contig, pos, left, right) with n_rich (a run of 20 N, or half of the bases N, within 250 of the call), n_base (N at the position or at a breakpoint) and vetoed.

    Unknown positions are null or negative; the position stands for a missing
    breakpoint, and the middle of both for a missing position. A call without any
    position, or on a contig without bases there, is not vetoed. Calls with a
    null id are left out.
    """
    at = lambda c: F.when(F.col(c) >= 0, F.col(c).cast("long"))
    known = calls.where(F.col("call").isNotNull())
    both = at("left").isNotNull() & at("right").isNotNull()
    lo, hi = F.when(both, F.least(at("left"), at("right"))), F.greatest(at("left"), at("right"))
    anchor = F.coalesce(at("pos"), F.when(both, lo + F.floor((hi - lo) / 2)))
    start = F.greatest(F.coalesce(lo, anchor) - CONTEXT, F.lit(0))
    end = F.coalesce(hi, anchor) + CONTEXT + 1
    spot = lambda c: F.struct(c.alias("start"), (c + 1).alias("end"), F.lit(False).alias("wide"))
    spans = F.array(F.struct(start.alias("start"), end.alias("end"), F.lit(True).alias("wide")), spot(anchor), spot(at("left")), spot(at("right")))
    each = known.select("call", "contig", F.posexplode(spans).alias("i", "s")).where("s.start IS NOT NULL AND s.end > s.start")
    bases = windows_of(chunks, each.select(F.struct("call", "i").alias("window"), "contig", "s.start", "s.end", "s.wide"), size)
    n = F.length("bases") - F.length(F.replace("bases", F.lit("N"), F.lit("")))
    rich = F.col("wide") & (F.length("bases") > 0) & (F.rlike("bases", F.lit(f"N{{{RUN}}}")) | (n / F.length("bases") >= SHARE))
    got = bases.groupBy("window.call").agg(F.bool_or(F.coalesce(rich, F.lit(False))).alias("n_rich"), F.bool_or(~F.col("wide") & (F.col("bases") == "N")).alias("n_base"))
    out = known.join(got, "call", "left").na.fill(False, ["n_rich", "n_base"])
    return out.select(*calls.columns, "n_rich", "n_base", (F.col("n_rich") | F.col("n_base")).alias("vetoed"))
