"""Event segmentation: where the two flanks of an event's consensus lie on the reference, and what lies between them.

A flank is an end of the consensus of 50 to 120 bases. Its k-mers name offsets on
the reference window, in bins; at every offset of the best bins one banded pass
gives the edits of all lengths at once, as lengths grow from the offset's fixed
end. All events of an Arrow batch are searched together. Whole flow: a pair of
flanks; else one flank with the other searched from where it ends; else one
flank alone; else the same on the other strand; else, with strong support, the
consensus as an unplaced insert.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomseq.functions import alignment as A
from loomseq.functions import support as P
from loomseq.functions.edits import QUERY_END, TARGET_END, codes, prefix_edits, stacked
from loomseq.operators.reads import windows_of
from loomseq.sources.shared import cut

#: Shortest and longest flank, least identity, reach around a breakpoint, bases of an end that may be skipped, shortest insert, identities that count as equal, seeds and their bins.
SHORTEST, LONGEST, IDENTITY, REACH, SLACK, INSERT, MARGIN, SEED, BIN, BINS = 50, 120, 0.90, 200, 32, 1, 0.02, 11, 8, 8
#: Bases by which placements of one flank may lie apart; lengths of a duplication and of a deletion between the flanks.
DIAGONAL, DUPLICATION, DELETION = 5, (3, 50), (1, 50)
#: Bases of the reference on either side of a breakpoint that any search can look at.
AROUND = 2 * REACH + LONGEST
#: Support that an unplaced insert needs.
UNPLACED_ALT, UNPLACED_ANCHOR, UNPLACED_PARTIAL = 8, 2, 4

_PLACEMENT = np.dtype([(c, np.int64) for c in ("query_start", "query_end", "ref_start", "ref_end", "length", "delta", "offset")] + [("identity", np.float64)])
_COMPLEMENT = str.maketrans("ACGT", "TGCA")
_BASE = np.full(256, 4, np.int64)
_BASE[codes("ACGT")] = range(4)


@dataclass
class Search:
    """One flank to place: the left or right end of a sequence near a breakpoint, on a window that begins at `start`."""

    sequence: str
    left: bool
    breakpoint: int
    window: str
    start: int
    longest: int


def _most(length: int | np.ndarray):
    return np.floor((1 - IDENTITY) * length + 1e-9).astype(np.int64)


@lru_cache(1 << 12)  # a window is searched for both flanks of both strands, and again behind skipped bases
def _kmers(sequence: str) -> np.ndarray:
    """The k-mer at every start as a number; -1 where it is not all of A, C, G and T."""
    b = _BASE[codes(sequence)]
    n = len(b) - SEED + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    value = np.zeros(n, np.int64)
    for i in range(SEED):
        value <<= 2
        value |= b[i : i + n]
    other = b > 3
    if other.any():
        upto = np.concatenate(([0], np.cumsum(other)))
        value[upto[SEED:] > upto[:-SEED]] = -1
    return value


def seed_offsets(query: str, window: str, start: int, breakpoint: int, left: bool) -> np.ndarray:
    """Starts of the best bins of offsets at which k-mers of A, C, G and T agree: most hits, then the nearest to the breakpoint, then the smaller."""
    q, w = _kmers(query), _kmers(window)
    order = np.argsort(q)
    ordered = q[order]
    first = np.searchsorted(ordered, w)
    n = np.searchsorted(ordered, w, "right") - first
    n[w < 0] = 0
    if not n.any():
        return np.zeros(0, np.int64)
    j = np.repeat(np.arange(len(w)), n)
    i = order[np.repeat(first - np.cumsum(n) + n, n) + np.arange(len(j))]
    x = start + j - i
    bins, which = np.unique(np.trunc(x / BIN).astype(np.int64) * BIN, return_inverse=True)
    hit = np.bincount(which)
    near = np.full(len(bins), np.iinfo(np.int64).max)
    np.minimum.at(near, which, np.abs(x + (len(query) if left else 0) - breakpoint))
    return bins[np.lexsort((bins, near, -hit))[:BINS]]


def place(searches: list[Search]) -> list[np.ndarray]:
    """Placements of each flank, best first: identity, distance of its end from the breakpoint, skipped bases, length, start. Where none lies at the very end of the sequence, up to SLACK bases are skipped."""
    found = _place(searches, 0)
    none = [i for i, f in enumerate(found) if not len(f)]
    for i, f in zip(none, _place([searches[i] for i in none], SLACK), strict=True):
        found[i] = f
    return found


def _place(searches: list[Search], slack: int) -> list[np.ndarray]:
    query, target, lanes = [], [], []  # a lane: search, skipped bases, reference coordinate of its fixed end
    for n, s in enumerate(searches):
        size = len(s.sequence)
        if not s.window or s.longest < SHORTEST:
            continue
        end = min(s.longest + slack, size)
        seeds = seed_offsets(s.sequence[:end] if s.left else s.sequence[size - end :], s.window, s.start, s.breakpoint, s.left)
        if not len(seeds):
            continue
        q, w = codes(s.sequence), codes(s.window)
        for skip in range(min(slack, size - SHORTEST) + 1):
            q_lane = q[skip : skip + s.longest] if s.left else q[: size - skip][::-1][: s.longest]
            for fixed in (seeds[:, None] + np.arange(BIN)).ravel() + (skip if s.left else end - skip):  # lengths grow from here: rightwards for a left flank
                i = int(fixed) - s.start
                if 0 <= i <= len(w):
                    query.append(q_lane)
                    target.append(w[i : i + s.longest] if s.left else w[max(0, i - s.longest) : i][::-1])
                    lanes.append((n, skip, int(fixed), min(len(q_lane), len(target[-1]))))
    out = [np.zeros(0, _PLACEMENT) for _ in searches]
    if not lanes:
        return out
    lane = np.array(lanes, np.int64)
    wide = max(s.longest for s in searches)
    edits = prefix_edits(stacked(query, QUERY_END, wide), stacked(target, TARGET_END, wide), int(_most(wide))).astype(np.int64)
    length = np.arange(wide + 1)
    fits = (length >= SHORTEST) & (length[None] <= lane[:, 3:4]) & (edits <= _most(length))
    row, size = np.nonzero(fits)
    of, skip, fixed = lane[row, 0], lane[row, 1], lane[row, 2]
    left = np.array([s.left for s in searches])[of]
    total = np.array([len(s.sequence) for s in searches])[of]
    breakpoint = np.array([s.breakpoint for s in searches])[of]
    p = np.zeros(len(row), _PLACEMENT)
    p["query_start"] = np.where(left, skip, total - skip - size)
    p["ref_start"] = np.where(left, fixed, fixed - size)
    p["query_end"], p["ref_end"], p["length"], p["offset"] = p["query_start"] + size, p["ref_start"] + size, size, skip
    ends = np.where(left, p["ref_end"], p["ref_start"])
    p["delta"] = np.abs(ends - breakpoint)
    p["identity"] = 1 - edits[row, size] / size
    near = (ends >= np.maximum(0, breakpoint - REACH)) & (ends <= breakpoint + REACH)
    p, of = p[near], of[near]
    best = np.zeros((len(searches), wide + 1))
    np.maximum.at(best, (of, p["length"]), p["identity"])
    close = p["identity"] + MARGIN >= best[of, p["length"]]
    p, of = p[close], of[close]
    order = np.lexsort((p["ref_end"], p["ref_start"], -p["length"], p["offset"], p["delta"], -p["identity"], of))
    cuts = np.searchsorted(of[order], np.arange(len(searches) + 1))
    return [p[order[a:b]] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def best_pair(left: np.ndarray, right: np.ndarray, canonical: bool = False) -> tuple[int, int] | None:
    """Places of the best pair with an insert between: least identity, mean identity, both distances, both lengths, left start, right start; then the first. With `canonical` the flanks must also form a boundary on the reference."""
    if not len(left) or not len(right):
        return None
    ok = left["query_end"][:, None] + INSERT <= right["query_start"][None]
    if canonical:
        gap = right["ref_start"][None] - left["ref_end"][:, None]
        ok &= ((gap >= -DUPLICATION[1]) & (gap <= -DUPLICATION[0])) | (gap == 0) | ((gap >= DELETION[0]) & (gap <= DELETION[1]))
        ok &= (left["ref_start"] >= 0)[:, None] & (right["ref_start"] >= 0)[None]
    i, j = np.nonzero(ok)
    if not len(i):
        return None
    a, b = ({c: np.ascontiguousarray(p[c]) for c in ("identity", "delta", "length", "ref_start")} for p in (left, right))
    for key in (
        lambda: -np.minimum(a["identity"][i], b["identity"][j]), lambda: -0.5 * (a["identity"][i] + b["identity"][j]), lambda: a["delta"][i] + b["delta"][j],
        lambda: -(a["length"][i] + b["length"][j]), lambda: a["ref_start"][i], lambda: b["ref_start"][j],
    ):
        k = key()
        best = k == k.min()
        i, j = i[best], j[best]
    return int(i[0]), int(j[0])


def _part(window: tuple[str, int], lo: int, hi: int) -> tuple[str, int]:
    """A window cut to [lo, hi), and where it begins."""
    bases, start = window
    lo = max(0, lo)
    hi = max(lo + 1, hi)
    return bases[max(0, lo - start) : max(0, hi - start)], max(lo, start)


@dataclass
class _Event:
    sequence: str
    lo: int
    hi: int
    near_lo: tuple[str, int]
    near_hi: tuple[str, int]

    def longest(self, paired: bool) -> int:
        return min(LONGEST, len(self.sequence) - INSERT - (SHORTEST if paired else 0))

    def search(self, left: bool, paired: bool) -> Search:
        alone = self.longest(False)  # windows are those of a flank alone
        window, start = _part(self.near_lo, self.lo - REACH - alone, self.lo + REACH) if left else _part(self.near_hi, self.hi - REACH, self.hi + REACH + alone)
        return Search(self.sequence, left, self.lo if left else self.hi, window, start, self.longest(paired))

    def tether(self, anchor: np.void, anchor_left: bool) -> Search:
        """The other flank, looked for from where the anchor ends."""
        alone, at = self.longest(False), int(anchor["ref_end"] if anchor_left else anchor["ref_start"])
        around = self.near_lo if anchor_left else self.near_hi
        window, start = _part(around, at - REACH, at + REACH + alone) if anchor_left else _part(around, at - REACH - alone, at + REACH)
        return Search(self.sequence, not anchor_left, at, window, start, alone)


def _diagonal(p: np.ndarray) -> np.ndarray:
    return p["ref_start"] - p["query_start"]


def _one_place(p: np.ndarray, best: np.void) -> bool:
    """Whether all placements as good as `best` (within the margin) lie on its diagonal."""
    rival = p[p["identity"] + MARGIN >= best["identity"]]
    return bool((np.abs(_diagonal(rival) - (best["ref_start"] - best["query_start"])) <= DIAGONAL).all())


def segment(events: list[_Event]) -> list[tuple[str, np.void | None, np.void | None] | None]:
    """Label, left and right flank of each event whose consensus is long enough and has a window on both sides; None where nothing fits."""
    both = place([e.search(left, True) for e in events for left in (True, False)])
    out: list = [None] * len(events)
    open_ = []
    for n in range(len(events)):
        left, right = both[2 * n], both[2 * n + 1]
        pair = best_pair(left, right)
        if pair:
            out[n] = ("PASS_EVENT_SEGMENTATION", left[pair[0]], right[pair[1]])
        else:
            open_.append(n)
    tethers = [(n, side, f[0]) for n in open_ for side, f in ((True, both[2 * n]), (False, both[2 * n + 1])) if len(f) and _one_place(f, f[0])]
    rescued: dict[int, list] = {}
    for (n, anchor_left, anchor), far in zip(tethers, place([events[n].tether(a, s) for n, s, a in tethers]), strict=True):
        own = np.array([anchor], _PLACEMENT)
        pair = best_pair(own, far, True) if anchor_left else best_pair(far, own, True)
        if not pair:
            continue
        best = far[pair[1] if anchor_left else pair[0]]
        fits = [(best_pair(own, f, True) if anchor_left else best_pair(f, own, True)) is not None for f in far[:, None]]
        if _one_place(far[fits], best):
            rescued.setdefault(n, []).append((anchor, best) if anchor_left else (best, anchor))
    for n, pairs in rescued.items():
        lefts, rights = (np.array([p[i] for p in pairs], _PLACEMENT) for i in range(2))
        k = _better(lefts, rights)
        out[n] = ("PASS_EVENT_SEGMENTATION_TETHERED_FLANK", lefts[k], rights[k])
    open_ = [n for n in open_ if out[n] is None]
    alone = place([events[n].search(left, False) for n in open_ for left in (True, False)])
    for k, n in enumerate(open_):
        left, right = alone[2 * k], alone[2 * k + 1]
        if not len(left) and not len(right):
            continue
        size = len(events[n].sequence)
        key = lambda p: (-p["identity"], p["delta"], -p["length"], p["offset"], p["ref_start"])
        if len(left) and (not len(right) or key(left[0]) < key(right[0])):
            if size - left[0]["query_end"] >= INSERT:
                out[n] = ("PASS_EVENT_SEGMENTATION_ONE_SIDED_LEFT", left[0], None)
        elif right[0]["query_start"] >= INSERT:
            out[n] = ("PASS_EVENT_SEGMENTATION_ONE_SIDED_RIGHT", None, right[0])
    return out


def _better(lefts: np.ndarray, rights: np.ndarray) -> int:
    """Which of the rescued pairs is the better; the first if they tie."""
    return int(np.lexsort((rights["ref_start"], lefts["ref_start"], -(lefts["length"] + rights["length"]), lefts["delta"] + rights["delta"], -0.5 * (lefts["identity"] + rights["identity"]), -np.minimum(lefts["identity"], rights["identity"])))[0])


_FIELDS = [("left_flank", pa.string()), ("insert", pa.string()), ("right_flank", pa.string())] + [(c, pa.int64()) for c in ("left_ref_start", "left_ref_end", "right_ref_start", "right_ref_end", "left_length", "right_length")] + [("left_identity", pa.float64()), ("right_identity", pa.float64()), ("strand", pa.int32())]
_SCHEMA = "key string, qc string, left_flank string, insert string, right_flank string, left_ref_start long, left_ref_end long, right_ref_start long, right_ref_end long, left_length long, right_length long, left_identity double, right_identity double, strand int"


def _row(e: _Event, label: str, left: np.void | None, right: np.void | None, strand: int) -> tuple:
    s = e.sequence
    a, b = (int(left["query_end"]) if left is not None else 0), (int(right["query_start"]) if right is not None else len(s))
    text = lambda p: "" if p is None else s[int(p["query_start"]) : int(p["query_end"])]
    at = lambda p, c, other: other if p is None else int(p[c])
    return (label, text(left), s[a:b], text(right), at(left, "ref_start", e.lo), at(left, "ref_end", e.lo), at(right, "ref_start", e.hi), at(right, "ref_end", e.hi), at(left, "length", 0), at(right, "length", 0), 0.0 if left is None else float(left["identity"]), 0.0 if right is None else float(right["identity"]), strand)


def _segment_batches(batches: Iterator[pa.RecordBatch], most: int = 256) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, most):
            b = whole.slice(at, most)
            keys, lows, highs, texts, w_lo, w_hi = (c.to_pylist() for c in b.columns)
            events = [_Event(t, lo, hi, (x, max(0, lo - AROUND)), (y, max(0, hi - AROUND))) for lo, hi, t, x, y in zip(lows, highs, texts, w_lo, w_hi, strict=True)]
            rows: list = [("NO_TRIPARTITE_EVENT_SEGMENTATION", "", "", "", -1, -1, -1, -1, 0, 0, 0.0, 0.0, 0)] * len(events)
            windows = [bool(e.search(True, False).window) and bool(e.search(False, False).window) for e in events]
            turned = [_Event(e.sequence.translate(_COMPLEMENT)[::-1], e.lo, e.hi, e.near_lo, e.near_hi) for e in events]
            todo = [n for n, ok in enumerate(windows) if ok]
            for strand, which in ((1, events), (-1, turned)):
                for n, got in zip(todo, segment([which[n] for n in todo]), strict=True):
                    if got:
                        rows[n] = _row(which[n], *got, strand)
                todo = [n for n in todo if rows[n][-1] == 0 and turned[n].sequence != events[n].sequence]
            for n, ok in enumerate(windows):
                if not ok:
                    rows[n] = ("REFERENCE_WINDOW_FETCH_FAILED", *rows[n][1:])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[i + 1] for r in rows], t) for i, (_, t) in enumerate(_FIELDS))], names=["key", "qc", *(f for f, _ in _FIELDS)])


def segment_events(events: DataFrame, chunks: DataFrame, size: int) -> DataFrame:
    """events with passed, qc, left_flank, insert, right_flank, their reference spans, lengths and identities, and strand.

    events: event, contig, left, right, consensus, consensus_passed, and the
    counts input_reads, left_anchor, right_anchor, partial, alt and ref_span
    (nulls count as 0). chunks: a reference in chunks of `size` bases
    (reads.reference_chunks). Equal consensus, contig and breakpoints are placed
    once. Where nothing is placed the spans are -1, texts empty, strand 0. A
    failed, null or empty consensus, one below 51 bases, a null or negative
    breakpoint and a contig without bases there have their own label.
    """
    columns = events.columns
    events, text = A.once(events, __text=F.upper(F.coalesce("consensus", F.lit("")))), F.col("__text")
    lo, hi = F.least("left", "right"), F.greatest("left", "right")
    key = F.sha2(F.concat_ws("|", F.length("contig").cast("string"), F.col("contig"), lo.cast("string"), hi.cast("string"), text).cast("binary"), 256)
    broken = (F.coalesce(F.length("contig"), F.lit(0)) == 0) | F.coalesce((F.col("left") < 0) | (F.col("right") < 0), F.lit(True))
    fault = (
        F.when(~F.coalesce("consensus_passed", F.lit(False)) | (text == ""), "NO_EVENT_CONSENSUS_TO_SEGMENT")
        .when(F.length(text) < SHORTEST + INSERT, "EVENT_CONSENSUS_TOO_SHORT").when(broken, "INVALID_EVENT_BREAKPOINTS")
    )
    rows = events.withColumns({"__fault": fault, "__lo": lo, "__hi": hi}).withColumn("__key", F.when(F.col("__fault").isNull(), key))
    rows = cut(rows, "segments")  # windows, places and results each read them
    once = rows.where("__fault IS NULL").select(F.col("__key").alias("key"), F.col("contig"), F.col("__lo").cast("long").alias("lo"), F.col("__hi").cast("long").alias("hi"), F.col("__text").alias("text")).dropDuplicates(["key"])
    side = lambda n, c: once.select(F.concat(F.col("key"), F.lit(n)).alias("window"), "contig", F.greatest(F.col(c) - AROUND, F.lit(0)).alias("start"), (F.col(c) + AROUND).alias("end"))
    bases = windows_of(chunks, side("L", "lo").union(side("R", "hi")), size).select(F.expr("left(window, 64)").alias("key"), F.expr("right(window, 1)").alias("side"), "bases")
    near = bases.groupBy("key").agg(F.max(F.when(F.col("side") == "L", F.col("bases"))).alias("near_lo"), F.max(F.when(F.col("side") == "R", F.col("bases"))).alias("near_hi"))
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: few bytes, much work
    placed = once.join(near, "key").select("key", "lo", "hi", "text", "near_lo", "near_hi").repartition(n, F.xxhash64("key")).mapInArrow(_segment_batches, _SCHEMA)

    got = rows.join(placed.withColumnRenamed("qc", "__qc").withColumnRenamed("key", "__key"), "__key", "left")
    count = P.count
    strong = (count(F.col("ref_span")) == 0) & (count(F.col("alt")) >= UNPLACED_ALT) & (count(F.col("alt")) >= 2 * count(F.col("input_reads")))
    anchored = (count(F.col("left_anchor")) >= UNPLACED_ANCHOR) & (count(F.col("right_anchor")) >= UNPLACED_ANCHOR) & (count(F.col("partial")) >= UNPLACED_PARTIAL)
    unplaced = (F.col("__qc") == "NO_TRIPARTITE_EVENT_SEGMENTATION") & strong & anchored
    qc = F.coalesce("__fault", F.when(unplaced, "PASS_EVENT_SEGMENTATION_UNPLACED_INSERT").otherwise(F.col("__qc")))

    def field(name: str, other: Column | str | int | float) -> Column:
        instead = {"insert": F.col("__text"), "left_ref_start": F.col("__lo"), "left_ref_end": F.col("__lo"), "right_ref_start": F.col("__hi"), "right_ref_end": F.col("__hi")}.get(name)
        value = F.coalesce(F.col(name), F.lit(other))
        return (value if instead is None else F.when(F.coalesce(unplaced, F.lit(False)), instead).otherwise(value)).alias(name)

    empty = {n: "" if t == pa.string() else -1 if "_ref_" in n else 0 if t != pa.float64() else 0.0 for n, t in _FIELDS}
    return got.select(*(F.col(c) for c in columns), qc.startswith("PASS_").alias("passed"), qc.alias("qc"), *(field(n, empty[n]) for n, _ in _FIELDS))


#: Fixed values of the agreement of clips with an insert: shortest and longest compared end, least identity.
CLIP_SHORTEST, CLIP_LONGEST, CLIP_IDENTITY = 50, 300, 0.85


def clip_concordance(segments: DataFrame, fragments: DataFrame) -> DataFrame:
    """segments (event, left, right, passed, insert) with full_insert, left_clip and right_clip (distinct reads), left_identity and right_identity (the highest), concordant and concordance.

    fragments: event, read (those that support the event), source (insertion,
    split, clip_left, clip_right), sequence, junction, low_complexity and
    low_anchor. A clip agrees if its first 50 to 300 bases are like the insert's
    beginning (clip_left) or ending; insertions and splits count from 50 bases
    on. It passes with such a read and clips on both sides, or two on one.
    """
    ins = F.upper(F.coalesce("insert", F.lit("")))
    usable = F.coalesce(F.col("passed"), F.lit(False)) & (ins != "")
    e = segments.where(usable & (F.length(ins) >= CLIP_SHORTEST)).select("event", "left", "right", ins.alias("ins"))
    f = fragments.where(F.col("read").isNotNull() & (F.col("read").cast("string") != "")).select("event", "read", "source", F.upper(F.coalesce("sequence", F.lit(""))).alias("seq"), "junction", "low_complexity", "low_anchor")
    each = f.join(e, "event").where(P.local_fragment(F.col("junction"), F.col("left"), F.col("right")))
    n = F.least(F.length("seq"), F.length("ins"), F.lit(CLIP_LONGEST))
    whole = F.col("source").isin("insertion", "split") & (F.length("seq") >= CLIP_SHORTEST)
    clip = F.col("source").isin("clip_left", "clip_right") & ~F.coalesce("low_complexity", F.lit(False)) & ~F.coalesce("low_anchor", F.lit(False)) & (n >= CLIP_SHORTEST)
    piece = F.when(F.col("source") == "clip_left", F.left("ins", n)).otherwise(F.right("ins", n))
    least = F.floor((1 - CLIP_IDENTITY) * n + 1e-3).cast("int")  # more edits than these are below the least identity
    edits = F.call_function("levenshtein", F.left("seq", n), piece, least)
    each = A.once(each, __edits=F.when(clip, edits)).withColumn("identity", F.when(F.col("__edits") >= 0, 1 - F.col("__edits") / n)).where(whole | (F.col("identity") + 1e-9 >= CLIP_IDENTITY))
    of = lambda kind, c: F.when(F.col("source") == kind, F.col(c))
    got = each.groupBy("event").agg(
        F.count_distinct(F.when(F.col("source").isin("insertion", "split"), F.col("read"))).alias("full_insert"), F.count_distinct(of("clip_left", "read")).alias("left_clip"), F.count_distinct(of("clip_right", "read")).alias("right_clip"),
        F.max(of("clip_left", "identity")).alias("left_clip_identity"), F.max(of("clip_right", "identity")).alias("right_clip_identity"),
    )
    zero = {"full_insert": 0, "left_clip": 0, "right_clip": 0, "left_clip_identity": 0.0, "right_clip_identity": 0.0}
    out = segments.join(got, "event", "left").na.fill(zero)
    good = (F.col("full_insert") >= 1) & (((F.col("left_clip") >= 1) & (F.col("right_clip") >= 1)) | (F.greatest("left_clip", "right_clip") >= 2))
    label = (
        F.when(~usable, "NO_EVENT_SEGMENTATION_FOR_CLIP_INSERT_CONCORDANCE").when(F.length(ins) < CLIP_SHORTEST, "CLIP_INSERT_CONCORDANCE_INSERT_TOO_SHORT")
        .when(good, "PASS_CLIP_INSERT_CONCORDANCE").otherwise("NO_CLIP_INSERT_CONCORDANCE")
    )
    return out.withColumn("concordant", label == "PASS_CLIP_INSERT_CONCORDANCE").withColumn("concordance", label)
