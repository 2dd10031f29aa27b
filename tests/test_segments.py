"""Segmentation, consensus and alignment kernels against plain versions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomseq.functions import edits as E
from loomseq.functions.sequence import edit_identity
from loomseq.operators import consensus as K
from loomseq.operators import segmentation as S
from loomseq.operators import sequences as Q
from loomseq.operators.reads import reference_chunks


def matrix(a, b, free=False):
    d = [[0 if free else j for j in range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(d[-1][j - 1] + (x != y), d[-1][j] + 1, row[-1] + 1))
        d.append(row)
    return d


def bases(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def mutated(rng, s, share):
    out = []
    for c in s:
        x = rng.random()
        out.append("" if x < share / 3 else c + rng.choice("ACGT") if x < 2 * share / 3 else rng.choice("ACGT") if x < share else c)
    return "".join(out)


@pytest.mark.parametrize("seed", range(4))
def test_banded_prefixes_equal_the_full_matrix(seed):
    rng = random.Random(seed)
    pairs = [(a, mutated(rng, a, 0.2 * i / 10)) for i in range(12) for a in [bases(rng, rng.randint(1, 60))]]
    q, t = (E.stacked([E.codes(p[i]) for p in pairs], end, 60) for i, end in ((0, E.QUERY_END), (1, E.TARGET_END)))
    for band in (0, 3, 9):
        got = E.prefix_edits(q, t, band)
        for lane, (a, b) in enumerate(pairs):
            full = matrix(a, b)
            for n in range(min(len(a), len(b)) + 1):
                assert got[lane, n] == full[n][n] if full[n][n] <= band else got[lane, n] > band


def test_semiglobal_and_banded_columns(spark):
    rng = random.Random(9)
    rows = [(i, a, bases(rng, rng.randint(0, 9)) + mutated(rng, a, 0.3) + bases(rng, rng.randint(0, 200))) for i in range(60) for a in [bases(rng, rng.randint(1, 40))]]
    rows += [(100, None, "A"), (101, "", "ACG"), (102, "ACGT", ""), (103, "ACGT" * 600, "ACGT" * 700), (104, "A" * 50, "C" * 3)]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    got = {r.id: (r.s, r.f) for r in Q.semiglobal_identity(df, "a", "b", "s").withColumn("f", edit_identity(F.col("a"), F.col("b"), 0.7)).collect()}
    for i, a, b in rows:
        if i == 103:
            assert got[i][0] == 1
            continue
        want = max(0.0, 1 - min(matrix(a, b, True)[-1]) / len(a)) if a and b else 0.0
        assert got[i][0] == pytest.approx(want)
        d, n = (matrix(a, b)[-1][-1], max(len(a), len(b))) if a and b else (0, 0)
        assert got[i][1] == (pytest.approx(1 - d / n) if n and d <= math.floor(0.3 * n + 1e-9) else None)


def plain_chain(hits, length, k):
    hits = sorted(hits)
    best, came = [h[2] for h in hits], [-1] * len(hits)
    for i, (q, t, w) in enumerate(hits):
        for j in range(i):
            dq, dt = q - hits[j][0], t - hits[j][1]
            if dq > 0 and dt > 0 and best[j] + w - (0.01 * abs(dq - dt) + 0.005 * abs(dq - dt)) > best[i]:
                best[i], came[i] = best[j] + w - (0.01 * abs(dq - dt) + 0.005 * abs(dq - dt)), j
    at = best.index(max(best))
    score, spots = best[at], set()
    while at >= 0:
        spots |= set(range(hits[at][0], hits[at][0] + k))
        at = came[at]
    return score, min(1.0, len(spots) / length)


def test_chains_equal_plain_ones(spark):
    rng = random.Random(2)
    rows = [(g, rng.randint(0, 80), rng.randint(0, 80), rng.choice([0.5, 1.0, 2.0])) for g in range(12) for _ in range(rng.randint(1, 40))]
    got = {r.g: (r.score, r.coverage) for r in Q.chain_scores(spark.createDataFrame(rows, "g int, query_pos int, target_pos int, weight double").withColumn("query_len", F.lit(90)), ["g"], 7).collect()}
    for g in range(12):
        assert got[g] == pytest.approx(plain_chain([r[1:] for r in rows if r[0] == g], 90, 7))
    scores = spark.createDataFrame([(1, 1, 4.0, 0.5), (1, 1, 2.0, 0.9), (1, 2, 4.0, 0.5), (1, 3, 1.0, 1.0), (2, 9, 1.0, 0.1)], "q int, f int, s double, c double").withColumn("w", F.lit(8.0))
    best = [(r.q, r.f, round(r.prefilter, 6)) for r in Q.family_prefilter(scores, "q", "f", "w", "s", "c", 2).orderBy("q", "f").collect()]
    assert best == [(1, 1, 0.45), (1, 2, 0.4), (2, 9, 0.095)]
    assert E.chain(np.array([]), np.array([]), np.array([]), 5, 3) == (0.0, 0.0)


def plain_placements(seq, left, bp, window, start, longest, slack):
    """Every placement by the whole matrix of every pair of ends."""
    size, end = len(seq), min(longest + slack, len(seq))
    probe = seq[:end] if left else seq[size - end :]
    bins = {}
    for i, j in itertools.product(range(len(probe) - 10), range(len(window) - 10)):
        if probe[i : i + 11] == window[j : j + 11] and set(probe[i : i + 11]) <= set("ACGT"):
            at = start + j - i
            key = int(at / 8) * 8
            n, d = bins.get(key, (0, 10**9))
            bins[key] = (n + 1, min(d, abs(at + (len(probe) if left else 0) - bp)))
    top = sorted(bins, key=lambda b: (-bins[b][0], bins[b][1], b))[:8]
    found = {}
    for skip, b, o in itertools.product(range(slack + 1), top, range(8)):
        fixed = b + o + (skip if left else end - skip)
        i = fixed - start
        if not 0 <= i <= len(window):
            continue
        q = seq[skip : skip + longest] if left else seq[: size - skip][::-1][:longest]
        t = window[i : i + longest] if left else window[max(0, i - longest) : i][::-1]
        d = matrix(q, t)
        for n in range(50, min(len(q), len(t)) + 1):
            ends = fixed + n if left else fixed - n
            if d[n][n] <= math.floor(0.1 * n + 1e-9) and max(0, bp - 200) <= ends <= bp + 200:
                qs, rs = (skip, fixed) if left else (size - skip - n, fixed - n)
                found.setdefault(n, []).append((-(1 - d[n][n] / n), abs(ends - bp), skip, -n, rs, rs + n, qs, qs + n))
    return sorted(p for ps in found.values() for p in ps if -p[0] + 0.02 >= max(-x[0] for x in ps))


@pytest.mark.parametrize("seed", range(5))
def test_placements_equal_all_pairs_of_ends(seed):
    rng = random.Random(seed)
    ref = bases(rng, 700)
    ref = ref[:330] + ref[250:330] + ref[410:]  # a repeat beside the breakpoint
    for left in (True, False):
        flank = ref[230:330] if left else ref[330:430]
        junk = bases(rng, 20 if seed % 2 else 0)
        seq = junk + mutated(rng, flank, 0.05) + bases(rng, 60) if left else bases(rng, 60) + mutated(rng, flank, 0.05) + junk
        s = S.Search(seq, left, 333, ref[20:640], 20, min(70, len(seq) - 51))
        (got,) = S.place([s])
        want = plain_placements(seq, left, 333, ref[20:640], 20, s.longest, 0) or plain_placements(seq, left, 333, ref[20:640], 20, s.longest, 32)
        assert [(-p["identity"], p["delta"], p["offset"], -p["length"], p["ref_start"], p["ref_end"], p["query_start"], p["query_end"]) for p in got] == want


def test_best_pairs_equal_all_pairs():
    rng = np.random.default_rng(1)
    for _ in range(60):
        sides = []
        for shift in (0, 20):
            p = np.zeros(rng.integers(0, 12), S._PLACEMENT)
            p["query_start"] = rng.integers(0, 30, len(p)) + shift
            p["length"] = rng.integers(5, 8, len(p))
            p["query_end"] = p["query_start"] + p["length"]
            p["ref_start"] = rng.integers(90, 110, len(p))
            p["ref_end"] = p["ref_start"] + p["length"]
            p["identity"], p["delta"] = rng.choice([0.9, 0.95, 1.0], len(p)), rng.integers(0, 3, len(p))
            sides.append(p)
        for canonical in (False, True):
            best = None
            for (i, a), (j, b) in itertools.product(enumerate(sides[0]), enumerate(sides[1])):
                gap = int(b["ref_start"] - a["ref_end"])
                if a["query_end"] + 1 > b["query_start"] or (canonical and not (-50 <= gap <= -3 or 0 <= gap <= 50)):
                    continue
                key = (-min(a["identity"], b["identity"]), -0.5 * (a["identity"] + b["identity"]), a["delta"] + b["delta"], -(a["length"] + b["length"]), a["ref_start"], b["ref_start"], i, j)
                best = min(best, key) if best else key
            assert S.best_pair(*sides, canonical) == (best[-2:] if best else None)


COUNTS = {"input_reads": 0, "left_anchor": 0, "right_anchor": 0, "partial": 0, "alt": 0, "ref_span": 0}


def test_whole_flow_on_planted_events(spark):
    rng = random.Random(4)
    ref = bases(rng, 4000)
    ins = bases(rng, 70)
    rc = lambda s: s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    e = [  # name, left, right, consensus, passed, counts
        ("pair", 1000, 1000, ref[910:1000] + ins + ref[1000:1090], True, {}),
        ("duplicated", 1500, 1490, ref[1410:1500] + ins + ref[1490:1580], True, {}),
        ("turned", 2000, 2000, rc(ref[1910:2000] + ins + ref[2000:2090]), True, {}),
        ("left only", 2500, 2500, ref[2410:2500] + bases(rng, 150), True, {}),
        ("right only", 2600, 2600, bases(rng, 150) + ref[2600:2690], True, {}),
        ("tethered", 3000, 3600, ref[2910:3000] + ins + ref[3000:3090], True, {}),  # the right flank lies at the left breakpoint
        ("skipped", 3300, 3300, bases(rng, 20) + ref[3215:3300] + ins + ref[3300:3390], True, {}),
        ("nothing", 1200, 1200, bases(rng, 200), True, {}),
        ("unplaced", 1200, 1200, bases(rng, 200), True, {"alt": 8, "input_reads": 4, "left_anchor": 2, "right_anchor": 2, "partial": 4}),
        ("opposed", 1200, 1200, bases(rng, 200), True, {"alt": 8, "input_reads": 4, "left_anchor": 2, "right_anchor": 2, "partial": 4, "ref_span": 1}),
        ("short", 1200, 1200, "ACGT" * 12, True, {}),
        ("failed", 1200, 1200, ref[:200], False, {}),
        ("null", 1200, 1200, None, True, {}),
        ("before", -1, 1200, ref[:200], True, {}),
        ("unknown", None, 1200, ref[:200], True, {}),
        ("beyond", 90_000, 90_000, ref[:200], True, {}),
        ("start", 60, 60, ref[0:60] + ins + ref[60:150], True, {}),
    ]
    rows = [(n, "c", a, b, s, ok, *(COUNTS | k).values(), "x") for n, a, b, s, ok, k in e]
    df = spark.createDataFrame(rows, "event string, contig string, left long, right long, consensus string, consensus_passed boolean, " + ", ".join(f"{c} long" for c in COUNTS) + ", lane string")
    chunks = reference_chunks(spark.createDataFrame([("c", ref)], "contig string, sequence string"), 256)
    got = {r.event: r for r in S.segment_events(df, chunks, 256).collect()}
    label = {n: got[n].qc for n in got}
    assert label == {
        "pair": "PASS_EVENT_SEGMENTATION", "duplicated": "PASS_EVENT_SEGMENTATION", "turned": "PASS_EVENT_SEGMENTATION", "left only": "PASS_EVENT_SEGMENTATION_ONE_SIDED_LEFT", "right only": "PASS_EVENT_SEGMENTATION_ONE_SIDED_RIGHT",
        "tethered": "PASS_EVENT_SEGMENTATION_TETHERED_FLANK", "skipped": "PASS_EVENT_SEGMENTATION", "nothing": "NO_TRIPARTITE_EVENT_SEGMENTATION", "unplaced": "PASS_EVENT_SEGMENTATION_UNPLACED_INSERT", "opposed": "NO_TRIPARTITE_EVENT_SEGMENTATION",
        "short": "EVENT_CONSENSUS_TOO_SHORT", "failed": "NO_EVENT_CONSENSUS_TO_SEGMENT", "null": "NO_EVENT_CONSENSUS_TO_SEGMENT", "before": "INVALID_EVENT_BREAKPOINTS", "unknown": "INVALID_EVENT_BREAKPOINTS", "beyond": "REFERENCE_WINDOW_FETCH_FAILED", "start": "PASS_EVENT_SEGMENTATION",
    }
    r = got["pair"]
    assert (r.left_ref_start, r.left_ref_end, r.right_ref_start, r.right_ref_end, r.insert, r.strand, r.left_identity) == (910, 1000, 1000, 1090, ins, 1, 1.0)
    assert (got["turned"].insert, got["turned"].strand) == (ins, -1)
    assert (got["tethered"].left_ref_end, got["tethered"].right_ref_start, got["tethered"].insert) == (3000, 3000, ins)
    assert got["skipped"].left_flank == ref[3215:3300]
    assert (got["unplaced"].insert, got["unplaced"].left_ref_start, got["unplaced"].right_ref_end) == (e[8][3], 1200, 1200)
    assert (got["left only"].right_ref_start, got["left only"].right_length, got["nothing"].left_ref_start, got["nothing"].passed) == (2500, 0, -1, False)
    assert S.segment_events(df.limit(0), chunks, 256).count() == 0


def test_clips_agree_with_inserts(spark):
    rng = random.Random(8)
    ins, other = bases(rng, 120), bases(rng, 120)
    seg = spark.createDataFrame([(1, 100, 100, True, ins), (2, 100, 100, True, ins), (3, 100, 100, True, ins[:40]), (4, 100, 100, False, ins), (5, 100, 100, True, None)], "event int, left long, right long, passed boolean, insert string")
    f = [
        (1, "a", "split", ins, 100, False, False), (1, "b", "clip_left", ins[:80], 90, False, False), (1, "c", "clip_right", ins[-60:], 110, False, False), (1, "d", "clip_left", other, 100, False, False), (1, None, "split", ins, 100, False, False),
        (1, "e", "clip_left", ins, 200, False, False), (1, "f", "clip_left", ins, 100, True, False), (2, "a", "insertion", ins[:49], 100, False, False), (2, "b", "clip_left", ins, 100, False, False), (2, "c", "clip_left", ins[:50], 100, None, None),
    ]
    got = {r.event: r for r in S.clip_concordance(seg, spark.createDataFrame(f, "event int, read string, source string, sequence string, junction long, low_complexity boolean, low_anchor boolean")).collect()}
    assert [(got[i].full_insert, got[i].left_clip, got[i].right_clip, got[i].concordant) for i in (1, 2)] == [(1, 1, 1, True), (0, 2, 0, False)]
    # a right clip is compared by its first bases, as the operator is defined
    assert [got[i].concordance for i in (3, 4, 5)] == ["CLIP_INSERT_CONCORDANCE_INSERT_TOO_SHORT", "NO_EVENT_SEGMENTATION_FOR_CLIP_INSERT_CONCORDANCE", "NO_EVENT_SEGMENTATION_FOR_CLIP_INSERT_CONCORDANCE"]


class Plain:
    """The partial-order graph by the definitions: nodes in a list, every score by recursion over a table."""

    def __init__(self):
        self.base, self.edge, self.twin = {}, {}, {}

    def preds(self, v):
        return [a for (a, b) in self.edge if b == v]

    def order(self):
        done, out = {"s"}, []
        while len(out) < len(self.base):
            v = min(v for v in self.base if v not in done and all(p in done for p in self.preds(v)))
            done.add(v)
            out.append(v)
        return out

    def add(self, text, weight):
        h = {("s", j): -4 * j for j in range(len(text) + 1)}
        for v in self.order():
            for j in range(len(text) + 1):
                c = [h[p, j] - 4 for p in self.preds(v)]
                if j:
                    c += [h[p, j - 1] + (2 if self.base[v] == text[j - 1] else -4) for p in self.preds(v)] + [h[v, j - 1] - 4]
                h[v, j] = max(c)
        path, j = [None] * len(text), len(text)
        ends = self.preds("e")
        at = max(ends, key=lambda p: (h[p, j], -ends.index(p))) if ends else "s"
        while at != "s" or j:
            moves = []
            if at != "s":
                moves += [("on", p) for p in self.preds(at) if j and h[p, j - 1] + (2 if self.base[at] == text[j - 1] else -4) == h[at, j]]
                moves += [("skip", p) for p in self.preds(at) if h[p, j] - 4 == h[at, j]]
            kind, p = moves[0] if moves else ("between", at)
            if kind == "on":
                path[j - 1] = at
            at, j = p, j - (kind != "skip")
        at = "s"
        for c, v in zip(text, path, strict=True):
            if v is None:
                v = len(self.base)
                self.base[v], self.twin[v] = c, {v}
            elif self.base[v] != c:
                same = [u for u in self.twin[v] if self.base[u] == c]
                if same:
                    v = same[0]
                else:
                    u = len(self.base)
                    self.base[u], self.twin[u] = c, self.twin[v]
                    self.twin[v].add(u)
                    v = u
            self.edge[at, v] = self.edge.get((at, v), 0) + weight
            at = v
        self.edge[at, "e"] = self.edge.get((at, "e"), 0) + weight

    def consensus(self):
        total, came = {"s": 0}, {}
        for v in [*self.order(), "e"]:
            p = max(self.preds(v), key=lambda p: (self.edge[p, v], total[p], -(-1 if p == "s" else p)))
            came[v], total[v] = p, self.edge[p, v] + total[p]
        out, at = "", came["e"]
        while at != "s":
            out, at = self.base[at] + out, came[at]
        return out


@pytest.mark.parametrize("seed", range(12))
def test_consensus_equals_the_plain_graph(seed):
    rng = random.Random(seed)
    truth = bases(rng, rng.randint(1, 30))
    texts = [t for t in (mutated(rng, truth, 0.3) for _ in range(rng.randint(2, 7))) if t]
    texts += texts[:1]
    texts.sort(key=lambda t: (-len(t), t))
    plain = Plain()
    for t in dict.fromkeys(texts):
        plain.add(t, texts.count(t))
    assert K.consensus_of(texts) == plain.consensus()


def test_consensus_recovers_what_reads_share(spark):
    rng = random.Random(1)
    truth = {i: bases(rng, 200) for i in range(5)}
    rows = [(i, r, True, mutated(rng, truth[i], 0.04)) for i in truth for r in range(60 if i == 4 else 12)]
    rows += [(7, 1, True, "ACGT"), (8, 1, False, "ACGT"), (9, 1, False, "ACGTA"), (9, 2, False, "ACGTA"), (9, 3, True, None), (10, 1, True, "AC"), (10, 2, False, "GGGGG"), (None, 1, True, "A")]
    df = spark.createDataFrame(rows, "event long, read long, full boolean, text string")
    got = {r.event: r for r in K.consensus(df).collect()}
    assert all(got[i].consensus == t for i, t in truth.items())
    assert [(got[i].consensus, got[i].input_reads, got[i].qc) for i in (7, 8, 9, 10)] == [("ACGT", 1, "PASS_EVENT_CONSENSUS"), ("", 1, "INSUFFICIENT_EVENT_READS"), ("ACGTA", 2, "PASS_EVENT_CONSENSUS"), ("AC", 1, "PASS_EVENT_CONSENSUS")]
    part = {r.event: r.qc for r in K.consensus(df, partial_only=True).collect()}
    assert (part[7], part[9], part[10]) == ("NO_EVENT_STRING_READS", "PASS_EVENT_CONSENSUS_PARTIAL_RETRY", "INSUFFICIENT_EVENT_READS")
    assert K.consensus(df.limit(0)).count() == 0


def test_inputs_of_a_consensus(spark):
    read = "A" * 100 + "C" * 60 + "G" * 100
    events = spark.createDataFrame([(1, 500, 510)], "event int, left long, right long")
    support = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (1, "d")], "event int, read string")
    f = [(1, "a", 1, "insertion", "C" * 60, 100, 60, 500), (1, "a", 2, "insertion", "C" * 60, 90, 60, 500), (1, "b", 3, "clip_left", "A" * 100, 0, 100, 520), (1, "c", 4, "clip_right", "G" * 40, 220, 40, 505), (1, "d", 5, "split", "C" * 60, 30, 60, 500), (1, "a", 6, "split", "C", 100, 1, 700), (1, "z", 7, "split", "C" * 60, 100, 60, 500)]
    fragments = spark.createDataFrame(f, "event int, read string, fragment int, source string, sequence string, start long, length long, junction long")
    records = spark.createDataFrame([(1, n, i, read if i else "ACG", i == 1) for n in "abcdz" for i in range(2)], "event int, read string, record int, sequence string, primary boolean")
    got = K.consensus_inputs(events, support, fragments, records)
    assert sorted((r.read, r.full, r.text) for r in got.collect()) == [("a", True, "A" * 80 + "C" * 60 + "G" * 80), ("b", False, "A" * 100 + "C" * 60 + "G" * 20), ("c", False, read[140:220] + "G" * 40)]
    c = K.input_counts(got).first()
    assert (c.full_reads, c.partial_reads, c.left_anchor, c.right_anchor, c.input_reads) == (1, 2, 2, 2, 1)


def test_seed_offsets_count_every_pair_of_equal_kmers():
    """Repeats on both sides, letters other than bases, and sequences too short for a k-mer."""
    rng = np.random.default_rng(5)
    for n in range(40):
        window = "".join(rng.choice(list("ACGTN" if n % 2 else "AC"), 90))
        query = window[20:60] + "".join(rng.choice(list("ACGT"), 30)) if n % 3 else window[:8]
        hits = [40 + j - i for i in range(len(query) - 10) for j in range(len(window) - 10) if query[i : i + 11] == window[j : j + 11] and set(query[i : i + 11]) <= set("ACGT")]
        found = {}
        for x in hits:
            b = int(x / 8) * 8
            found.setdefault(b, []).append(abs(x + len(query) - 70))
        want = sorted(found, key=lambda b: (-len(found[b]), min(found[b]), b))[:8]
        assert S.seed_offsets(query, window, 40, 70, True).tolist() == want
