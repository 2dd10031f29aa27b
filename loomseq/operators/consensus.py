"""One consensus of many reads of an event: what goes in, and a partial-order graph per event.

Fragments become event strings (the insert with up to 80 bases of its read on the
sides that are anchored), the longest one of a read stands for it, and at most
MOST strings of an event are aligned, one after another, to a graph of bases. An
event's strings are one array of a row, bounded by MOST, and events are dealt
over all tasks; equal strings are aligned once and weigh their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomseq.functions import support as P
from loomseq.operators.sets import longest_texts

#: Flank of an event string, shortest anchor, most strings, fewest strings without full context.
FLANK, ANCHOR, MOST, FEWEST = 80, 50, 48, 2
#: Scores of the alignment to the graph.
MATCH, MISMATCH, GAP = 2, -4, -4
FULL, LEFT_CLIP, RIGHT_CLIP = ("insertion", "split"), "clip_left", "clip_right"


def event_string(source: Column, read: Column, start: Column, length: Column, insert: Column) -> Column:
    """An insert with its read's bases on the anchored sides (both for an insertion or split, the right for a left clip, the left for a right clip); null where the fragment is not on the read, is empty, or an anchored side has under 50 bases. Only A, C, G and T stay, other characters become N."""
    acgt = lambda c: F.regexp_replace(F.upper(c), "[^ACGT]", "N")
    end = start + length
    fits = (F.length(insert) > 0) & (start >= 0) & (length > 0) & (end <= F.length(read))
    before = F.least(start, F.lit(FLANK))
    after = F.least(F.length(read) - end, F.lit(FLANK))
    left, right = F.substr(read, (start - before + 1).cast("int"), before.cast("int")), F.substr(read, (end + 1).cast("int"), after.cast("int"))
    text = (
        F.when(source.isin(*FULL) & (before >= ANCHOR) & (after >= ANCHOR), F.concat(left, insert, right))
        .when((source == LEFT_CLIP) & (after >= ANCHOR), F.concat(insert, right)).when((source == RIGHT_CLIP) & (before >= ANCHOR), F.concat(left, insert))
    )
    return F.when(fits, acgt(text))


def consensus_inputs(events: DataFrame, support: DataFrame, fragments: DataFrame, records: DataFrame) -> DataFrame:
    """event, read, full and text: the longest event string of a read with full and with partial context, of fragments at the event's breakpoints whose read supports it.

    events: event, left, right; support: event, read; fragments: event, read,
    fragment (its order), source, sequence, start, length, junction; records:
    event, read, record (its order), sequence, primary. The longest record of a
    read stands for it. Of equally long strings the first fragment's counts, then the smaller.
    """
    # All that holds bases is dealt by event and read, once; breakpoints come to it with the reads that support an event.
    here = support.select("event", "read").distinct().join(events.select("event", F.col("left").alias("__lo"), F.col("right").alias("__hi")), "event")
    named = fragments.where(F.col("read").isNotNull() & (F.col("read").cast("string") != ""))
    local = named.join(here, ["event", "read"]).where(P.local_fragment(F.col("junction"), F.col("__lo"), F.col("__hi")))
    rank = F.struct((-F.coalesce(F.length("sequence"), F.lit(0))).alias("n"), (~F.coalesce("primary", F.lit(False))).alias("p"), F.col("record").alias("o"))
    best = records.where(F.col("read").isNotNull()).groupBy("event", "read").agg(F.min_by("sequence", rank).alias("__read"))
    text = event_string(F.col("source"), F.col("__read"), F.col("start"), F.col("length"), F.col("sequence"))
    rows = local.join(best, ["event", "read"]).withColumn("text", text).where("text IS NOT NULL").withColumn("full", F.col("source").isin(*FULL))
    longest = F.min_by("text", F.struct(-F.length("text"), F.col("fragment"), F.col("text")))
    ends = (F.bool_or(F.col("source").isin(*FULL, RIGHT_CLIP)).alias("left_anchor"), F.bool_or(F.col("source").isin(*FULL, LEFT_CLIP)).alias("right_anchor"))
    return rows.groupBy("event", "read", "full").agg(longest.alias("text"), *ends)


def input_counts(inputs: DataFrame, text: Column | None = None) -> DataFrame:
    """event, full_reads, partial_reads, left_anchor, right_anchor (distinct reads) and input_reads: the full ones, or without any the partial ones. With a `text` of each row also texts, all of an event's in order, from the same pass."""
    of_read = () if text is None else (F.collect_list(text).alias("texts"),)
    of_event = () if text is None else (F.sort_array(F.flatten(F.collect_list("texts"))).alias("texts"),)
    reads = inputs.groupBy("event", "read").agg(*of_read, F.bool_or("full").alias("full"), F.bool_or(~F.col("full")).alias("partial"), F.bool_or("left_anchor").alias("l"), F.bool_or("right_anchor").alias("r"))
    got = reads.groupBy("event").agg(F.count_if("full").alias("full_reads"), F.count_if("partial").alias("partial_reads"), F.count_if("l").alias("left_anchor"), F.count_if("r").alias("right_anchor"), *of_event)
    return got.withColumn("input_reads", F.when(F.col("full_reads") > 0, F.col("full_reads")).otherwise(F.col("partial_reads")))


class Graph:
    """A partial-order graph of bases. Node 0 is the start and 1 the end; edges weigh the strings that take them."""

    def __init__(self) -> None:
        self.base = ["", ""]
        self.into: list[dict[int, int]] = [{}, {}]
        self.same: list[list[int]] = [[], []]  # nodes of another base at the same place
        self.order: list[int] = []  # of the nodes between, every edge leads onwards

    def _node(self, base: str) -> int:
        self.base.append(base)
        self.into.append({})
        self.same.append([])
        return len(self.base) - 1

    def align(self, text: str) -> list[int]:
        """For each base of text its node in the best global alignment, or -1. Ties: a base on a node before a skipped node before a base between nodes, and the earlier entered of two edges."""
        n = len(text)
        t = np.frombuffer(text.encode(), np.uint8)
        # Scores are kept less their column's gaps, so that gaps along the text are a running maximum and a fitting base gains its score less one gap.
        gain = {x: np.where(t == ord(x), MATCH - GAP, MISMATCH - GAP).astype(np.int32) for x in set(self.base[2:])}
        place = {0: 0}
        for i, v in enumerate(self.order):
            place[v] = i + 1
        score = np.zeros((len(self.order) + 1, n + 1), np.int32)
        fitted, got = np.empty(n, np.int32), np.empty(n + 1, np.int32)
        for i, v in enumerate(self.order, 1):
            row = score[i]
            for k, p in enumerate(self.into[v]):
                above = score[place[p]]
                now = got if k else row
                np.add(above, GAP, out=now)
                np.add(above[:-1], gain[self.base[v]], out=fitted)
                np.maximum(now[1:], fitted, out=now[1:])
                if k:
                    np.maximum(row, got, out=row)
            np.maximum.accumulate(row, out=row)
        ends = [(int(score[place[p], n]), -k, p) for k, p in enumerate(self.into[1])]
        at, j = max(ends)[2] if ends else 0, n
        out = [-1] * n
        cell = score.item
        while at or j:
            if at:
                here = cell(place[at], j)
                step = None
                if j:
                    less = here - (MATCH if text[j - 1] == self.base[at] else MISMATCH) + GAP
                    for p in self.into[at]:
                        if cell(place[p], j - 1) == less:
                            step = p
                            break
                    if step is not None:
                        out[j - 1] = at
                        at, j = step, j - 1
                        continue
                for p in self.into[at]:
                    if cell(place[p], j) + GAP == here:
                        step = p
                        break
                if step is not None:
                    at = step
                    continue
            j -= 1
        return out

    def add(self, text: str, weight: int = 1) -> None:
        at, chain = 0, not self.order
        for base, node in zip(text, self.align(text) if self.order else [-1] * len(text), strict=True):
            if node >= 0 and self.base[node] != base:
                other = next((s for s in self.same[node] if self.base[s] == base), None)
                if other is None:
                    other = self._node(base)
                    ring = [node, *self.same[node]]
                    for s in ring:
                        self.same[s].append(other)
                    self.same[other] = ring
                node = other
            elif node < 0:
                node = self._node(base)
            self.into[node][at] = self.into[node].get(at, 0) + weight
            at = node
        self.into[1][at] = self.into[1].get(at, 0) + weight
        if chain:
            self.order = list(range(2, len(self.base)))
        else:
            self._sort()

    def _sort(self) -> None:
        """Nodes so that edges lead onwards; a node comes when all before it have, the smaller first."""
        import heapq

        left = [len(e) - (0 in e) for e in self.into]
        out: dict[int, list[int]] = {}
        for v in range(2, len(self.base)):
            for p in self.into[v]:
                out.setdefault(p, []).append(v)
        ready = [v for v in range(2, len(self.base)) if not left[v]]
        heapq.heapify(ready)
        self.order = []
        while ready:
            v = heapq.heappop(ready)
            self.order.append(v)
            for w in out.get(v, ()):
                left[w] -= 1
                if not left[w]:
                    heapq.heappush(ready, w)

    def consensus(self) -> str:
        """The path of the heaviest edges, back from the end: into each node its heaviest edge, ties to the one whose own path weighs more, then to the earlier node."""
        total, came = {0: 0}, {}
        for v in [*self.order, 1]:
            if self.into[v]:
                w, _, p = max((w, total[p], -p) for p, w in self.into[v].items())
                came[v], total[v] = -p, w + total[-p]
        out, at = [], came.get(1, 0)
        while at:
            out.append(self.base[at])
            at = came[at]
        return "".join(reversed(out))


def consensus_of(texts: list[str]) -> str:
    """Consensus of strings in the order given; equal ones are aligned once, at the first one's turn."""
    g = Graph()
    count: dict[str, int] = {}
    for t in texts:
        if t:
            count[t] = count.get(t, 0) + 1
    if len(count) == 1:
        return next(iter(count))
    for t, n in count.items():
        g.add(t, n)
    return g.consensus()


def consensus(inputs: DataFrame, *, partial_only: bool = False, most: int = MOST, fewest: int = FEWEST) -> DataFrame:
    """event, consensus, full_context, input_reads, passed and qc, a row for each event that has an input string.

    inputs: event, read, full, text (consensus_inputs). With full context one
    read is enough; without (or with partial_only) it takes `fewest`. The
    longest `most` strings are aligned, longest first, ties by the text.
    """
    rows = inputs.where(F.col("event").isNotNull() & F.col("text").isNotNull() & (F.col("text") != "")).select("event", "read", "full", "text")
    has = rows.groupBy("event").agg((F.bool_or("full") & F.lit(not partial_only)).alias("use"))
    used = rows.join(has, "event").where(F.col("full") == F.col("use"))
    counts = used.groupBy("event").agg(F.count_distinct("read").alias("input_reads"), F.first("use").alias("full_context"))
    enough = counts.where(F.col("full_context") | (F.col("input_reads") >= fewest))
    picked = longest_texts(used.join(enough.select("event"), "event", "left_semi"), "event", "text", most)
    texts = picked.groupBy("event").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("t")).select("event", F.transform("t", lambda x: x["text"]).alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([consensus_of(t) for t in b.column(1).to_pylist()], pa.string())], names=["event", "consensus"])

    kind = rows.schema["event"].dataType.simpleString()
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: few bytes, much work
    built = texts.repartition(n, F.xxhash64("event")).mapInArrow(run, f"event {kind}, consensus string")
    asked = rows.select("event").distinct().join(counts, "event", "left").na.fill({"input_reads": 0, "full_context": False})
    out = asked.join(built, "event", "left").withColumn("passed", F.coalesce(F.length("consensus") > 0, F.lit(False)))
    good = "PASS_EVENT_CONSENSUS_PARTIAL_RETRY" if partial_only else "PASS_EVENT_CONSENSUS"
    qc = F.when(F.col("passed"), good).when(F.col("input_reads") == 0, "NO_EVENT_STRING_READS").when(F.col("consensus").isNull(), "INSUFFICIENT_EVENT_READS").otherwise("EMPTY_EVENT_CONSENSUS")
    return out.select("event", F.coalesce("consensus", F.lit("")).alias("consensus"), "full_context", "input_reads", "passed", qc.alias("qc"))
