"""Choices among hypotheses and explanations against plain sequential rules."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomseq.functions import explanation as X
from loomseq.operators import families as M
from loomseq.operators import hypotheses as H

ROWS = "component string, index int, rank int, left long, right long, center long, names array<string>, alt int, split int, indel int, feasible boolean, precise int, full int, left_anchor int, right_anchor int, anchor long, support int, priority int, score int"


def rows_of(seed, n=400):
    rng, rows = random.Random(seed), []
    for i in range(n):
        a = rng.choice((1000, 1030, 1500, 2300)) + rng.randint(-20, 50)
        b = a + rng.choice((0, 0, 10, 31, 200))
        names = None if rng.random() < 0.05 else [f"r{j}" for j in rng.sample(range(7), rng.randint(0, 7))]
        rows.append((rng.choice("abcd"), i, i, a, b, (a + b) // 2, names, rng.randint(0, 3), rng.randint(0, 2), rng.randint(0, 2), rng.random() < 0.8, rng.randint(0, 2), rng.randint(0, 2), rng.randint(0, 2), rng.randint(0, 2), rng.choice((1010, 1010, 5000)), rng.randint(1, 3), rng.randint(0, 5), rng.randint(0, 20)))
    return rows


def grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(dict(zip([c.split()[0] for c in ROWS.split(", ")], r, strict=True)))
    return out


def like(a, b):
    a, b = set(a or ()), set(b or ())
    return len(a & b) / len(a | b) if a | b else 0.0


def plain_collapse(rows):
    kept = []
    for r in rows:
        for i, k in enumerate(kept):
            if abs(r["left"] - k["left"]) <= 30 and abs(r["right"] - k["right"]) <= 30 and like(r["names"], k["names"]) >= 0.8:
                rank = lambda x: (-x["alt"], -x["split"] - x["indel"], abs(x["right"] - x["left"]), x["index"])
                kept[i] = min(r, k, key=rank)
                break
        else:
            kept.append(r)
    return [k["index"] for k in kept]


def plain_shortlist(rows):
    rows = sorted((r for r in rows if r["feasible"]), key=lambda r: (-r["precise"], -r["full"], -min(r["left_anchor"], r["right_anchor"]), r["right"] - r["left"], min(abs(r["left"] - r["anchor"]), abs(r["right"] - r["anchor"])), -r["alt"], r["index"]))
    out = []
    for r in rows:
        if all(abs(r["left"] - k["left"]) > 60 or abs(r["right"] - k["right"]) > 60 or like(r["names"], k["names"]) < 0.5 for k in out):
            out.append(r)
    best = None
    for r in rows:
        if r["support"] == 1 and r["priority"] < 2 and r["left"] == r["right"] and r not in out and all((r["left"], r["right"]) != (k["left"], k["right"]) and abs(r["left"] - k["left"] - (k["right"] - k["left"]) // 2) >= 500 for k in out):
            if best is None or (r["priority"], -r["score"], r["left"]) < (best["priority"], -best["score"], best["left"]):
                best = r
    return [r["index"] for r in out + ([best] if best else [])]


def plain_diverse(rows, k):
    if not k or len(rows) <= k:
        return [r["index"] for r in rows]
    out = []
    for r in rows:
        if len(out) < k and all(abs(r["left"] - o["left"]) > 30 or abs(r["right"] - o["right"]) > 30 for o in out):
            out.append(r)
    same = lambda r: any((r["left"], r["right"]) == (o["left"], o["right"]) for o in out)
    away = lambda r: abs(r["center"] - r["anchor"])
    if all(away(o) > 100 for o in out):
        near = sorted((r for r in rows if not same(r) and r["score"] >= 8), key=lambda r: (away(r), -r["score"], -r["support"], r["priority"], r["left"], r["right"]))
        if not near:
            return [r["index"] for r in out]
        out = (out if len(out) < k else out[:-1]) + near[:1]
    lone = sorted((r for r in rows if not same(r) and r["priority"] < 2 and r["left"] == r["right"] and r["support"] <= 1 and all(abs(r["center"] - o["center"]) >= 500 for o in out)), key=lambda r: (away(r), r["priority"], r["center"]))
    return [r["index"] for r in out + lone[:1]]


def places(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.component, r.place)):
        out.setdefault(r.component, []).append(r["index"])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_choices_equal_the_plain_ones(spark, seed):
    rows = rows_of(seed) + [("lone", 1, 1, 5, 5, 5, [], 0, 0, 0, True, 0, 0, 0, 0, 9000, 1, 5, 1)]
    df = spark.createDataFrame(rows + [(None, *rows[0][1:])], ROWS).repartition(5)
    by = grouped(rows)
    assert places(H.collapse_hypotheses(df)) == {c: plain_collapse(r) for c, r in by.items()}
    assert places(H.shortlist(df)) == {c: s for c, r in by.items() if (s := plain_shortlist(r))}
    for k in (0, 1, 3, 1000):
        assert places(H.diverse_hypotheses(df, k)) == {c: plain_diverse(r, k) for c, r in by.items()}
    assert H.collapse_hypotheses(df.limit(0)).count() == H.shortlist(df.limit(0)).count() == H.diverse_hypotheses(df.limit(0), 2).count() == 0


def test_enumeration_of_planted_positions(spark):
    comps = spark.createDataFrame([(1, 1000, 1000, 1000), (2, 500, 500, 500), (3, -5, 0, 0)], "component long, anchor long, left long, right long")
    frag = [(1, "split", "left", p) for p in (990, 995, 1000)] + [(1, "split", "right", 1020)] * 2 + [(1, "insertion", "unknown", 1700)] * 2 + [(1, "insertion", "unknown", 2500), (1, "clip_left", "left", 1200), (1, "split", "unknown", 1001), (1, "clip_right", "right", None)]
    sig = spark.createDataFrame([(1, 997, 1010, None, None, -1), (2, None, None, 520, 900, None)], "component long, split_left long, split_right long, clip_left long, clip_right long, insertion long")
    got = H.enumerate_hypotheses(comps, spark.createDataFrame([(1, -1)], "component long, pos long"), spark.createDataFrame(frag, "component long, source string, side string, junction long"), sig)
    assert sorted((r.component, r["rank"], r.left, r.right, r.support, r.priority, r.score) for r in got.collect()) == [
        (1, 1, 995, 1020, 5, 0, 40), (1, 2, 1700, 1700, 2, 1, 16), (1, 3, 997, 997, 1, 2, 7), (1, 4, 1200, 1200, 1, 3, 1), (2, 1, 520, 520, 1, 5, 1), (3, 1, 0, 0, 1, H.NONE, 1),
    ]
    assert {r.component: r["rank"] for r in H.enumerate_hypotheses(comps, spark.createDataFrame([], "component long, pos long"), spark.createDataFrame(frag, "component long, source string, side string, junction long"), sig, 1).collect()} == {1: 1, 2: 1, 3: 1}


E_TYPE = "array<struct<kind:int," + ",".join(f"{f}:int" for f in (*X.PRIMARY, *X.TIES)) + ",family:string,subfamily:string>>"


def plain_decide(es, closed):
    if not es:
        return ("NO_CALL_INCOMPLETE", False, False, False)
    dom = lambda a, b: all(a[f] <= b[f] for f in X.PRIMARY) and any(a[f] < b[f] for f in X.PRIMARY)
    ranked = sorted(es, key=lambda e: (sum(e[f] for f in X.PRIMARY), sum(e[f] for f in X.TIES), -e["kind"]))
    best = ranked[0]
    alone = all(dom(best, e) for e in ranked[1:])
    if best["missing_required_components"] > 0 or best["structural_conflicts"] > 0:
        return ("NO_CALL_INCOMPLETE", False, False, False)
    if best["kind"] == 2:
        if not alone:
            return ("TE_AMBIGUOUS", False, False, False)
        return ("PASS_TE_CLOSED" if closed else "PASS_TE_IMPRECISE", True, not closed, not closed or best["subfamily"] in (None, "", "UNKNOWN") or best["family"] == "UNKNOWN")
    return ("PASS_NONTE_INSERTION" if best["kind"] == 1 and alone else "REFERENCE_OR_ARTIFACT", False, False, False)


def test_decisions_equal_the_plain_rule(spark):
    rng, rows = random.Random(0), [(10_000, None, True), (10_001, [], False)]
    for i in range(600):
        kinds = rng.sample(range(4), rng.randint(1, 4))
        low = rng.random() < 0.6
        es = [{"kind": k, **{f: (0 if low and k == kinds[0] else rng.randint(0, 2)) for f in (*X.PRIMARY, *X.TIES)}, "family": rng.choice(("L1", "UNKNOWN", None)), "subfamily": rng.choice(("P", "UNKNOWN", "", None))} for k in kinds]
        rows.append((i, es, rng.random() < 0.5))
    df = spark.createDataFrame(rows, f"id int, es {E_TYPE}, closed boolean")
    got = {r.id: r.d for r in df.select("id", X.decide(F.col("es"), F.col("closed")).alias("d")).collect()}
    want = {i: plain_decide(es, c) for i, es, c in rows}
    assert {i: (d.qc, d.emit, d.evidence_only, d.unknown) for i, d in got.items()} == want and len(set(want.values())) >= 7
    assert got[0].residuals.startswith("structural=") and got[0].residuals.count(";") == 8


def test_ties_go_to_the_later_kind_and_paths_are_written(spark):
    zero = dict.fromkeys((*X.PRIMARY, *X.TIES), 0)
    es = [{"kind": 0, **zero, "family": "a", "subfamily": "b"}, {"kind": 2, **zero, "family": "L1", "subfamily": "P"}]
    d = spark.createDataFrame([(es, True)], f"es {E_TYPE}, c boolean").select(X.decide(F.col("es"), F.col("c")).alias("d")).first().d
    assert (d.kind, d.qc, d.order) == ("TE", "TE_AMBIGUOUS", ["TE", "REFERENCE"])
    p = spark.createDataFrame([([(0, 5, "L1"), (5, 9, "x")],), ([],), (None,)], "p array<struct<start:int,end:int,label:string>>").select(X.path_line(F.col("p")).alias("t")).collect()
    assert [r.t for r in p] == ["0-5:L1,5-9:x", "NA", "NA"]


def test_posteriors_equal_a_plain_sum(spark):
    rng, rows = random.Random(5), []
    for i in range(60):
        rows.append((i, [(rng.choice((-1, None)) if rng.random() < 0.1 else rng.randint(100, rng.choice((130, 400, 9000))), *rng.choice(((True, False, True), (False, True, False), (False, False, True), (False, False, False)))) for _ in range(rng.randint(1, 9))]))
    rows += [(100, []), (101, None), (102, [(-1, True, False, False), (5, True, False, False)])]
    df = spark.createDataFrame(rows, "id int, s array<struct<pos:long,split:boolean,insertion:boolean,clip:boolean>>")
    for r in df.select("id", "s", X.breakpoint_posterior(F.col("s")).alias("p")).collect():
        good = [(s.pos, 2.0 if s.split else 3.0 if s.insertion else 6.0 if s.clip else 8.0) for s in r.s or [] if s.pos is not None and s.pos >= 0]
        if len(good) < 2:
            assert (r.p.width, r.p.entropy, r.p.mode) == (0.0, 0.0, None)
            continue
        lo = min(g[0] for g in good) - 20
        hi = min(max(g[0] for g in good) + 20, lo + 2000)
        x = np.arange(lo, hi + 1)
        d = sum(np.exp(-0.5 * ((x - p) / w) ** 2) / w for p, w in good)
        d /= d.sum()
        cum = np.cumsum(d)
        assert r.p.mass == pytest.approx(1) and r.p.entropy == pytest.approx(-(d[d > 0] * np.log(d[d > 0])).sum() / np.log(len(x)))
        assert abs(r.p.width - (np.searchsorted(cum, 0.95) - np.searchsorted(cum, 0.05))) <= 1 and d[r.p.mode - lo] == pytest.approx(d.max())


def test_picks_of_many_keys_leave_in_few_batches():
    keys = [k for k in range(3000) for _ in range(k % 4 + 1)]
    table = pa.table({"key": keys, "x": list(range(len(keys))), "names": [[k] * (k % 3) for k in keys]})
    for size in (1, 7, 1000, len(keys)):
        batches = table.to_batches(max_chunksize=size)
        got = list(H.picked(iter(batches), [0, 1, 2], lambda rows: [i for i, r in enumerate(rows) if r[0] % 2 == 0 and len(r[1]) != 1], "place"))
        assert len(got) <= len(batches) + 1
        want, place = [], {}
        for k, x in zip(keys, range(len(keys)), strict=True):
            if x % 2 == 0 and k % 3 != 1:
                place[k] = place.get(k, 0) + 1
                want.append((k, x, place[k]))
        assert [(r["key"], r["x"], r["place"]) for b in got for r in b.to_pylist()] == want
    assert list(H.picked(iter([]), [0, 1], lambda rows: [0], "place")) == []


@pytest.mark.parametrize("block", [2, 5, 64])
def test_likeness_of_members_in_blocks_equals_all_pairs(spark, block):
    rng = random.Random(3)
    rows = [(f, o, sorted({"".join(rng.choices("ACG", k=2)) for _ in range(rng.randint(0, 6))})) for f, n in ((1, 1), (2, 2), (3, 40), (4, 7)) for o in range(n)]
    got = {(r.family, r.order): r.close for r in M.likeness(spark.createDataFrame(rows, "family long, order long, mins array<string>").repartition(3), block).collect()}
    want = {(f, o): sum(like(m, x) for g, p, x in rows if g == f and p != o) for f, o, m in rows}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_posteriors_of_many_events_equal_those_alone(spark):
    rng = random.Random(5)
    rows = [(i, [(rng.choice((-1, 5, 40, 2600, rng.randint(0, 300))), rng.random() < 0.3, rng.random() < 0.3, rng.random() < 0.3) for _ in range(rng.randint(0, 5))]) for i in range(700)] + [(700, None)]
    df = spark.createDataFrame(rows, "id long, s array<struct<pos:long,split:boolean,insertion:boolean,clip:boolean>>").coalesce(1)
    out = df.select("id", X.breakpoint_posterior(F.col("s")).alias("p"))
    assert "ArrowEvalPython" in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.id: r.p for r in out.collect()}
    for i, s in rows:
        good = [(p, 2.0 if a else 3.0 if b else 6.0 if c else 8.0) for p, a, b, c in s or () if p >= 0]
        if len(good) < 2:
            assert tuple(got[i]) == (0.0, 0.0, None, 0.0)
            continue
        lo = min(p for p, _ in good) - 20
        hi = min(max(p for p, _ in good) + 20, lo + 2000)
        f = np.array([sum(np.exp(-0.5 * ((x - p) / w) ** 2) / w for p, w in good) for x in range(lo, hi + 1)])
        d = f / f.sum()
        c = np.cumsum(d)
        first = lambda v: int(np.argmax(c >= v)) if (c >= v).any() else len(c) - 1
        assert got[i].width == first(0.95) - first(0.05) and got[i].mode == lo + int(np.argmax(d >= d.max() * (1 - 1e-9)))
        assert abs(got[i].entropy + (d[d > 0] * np.log(d[d > 0])).sum() / np.log(len(d))) < 1e-9 and abs(got[i].mass - 1) < 1e-9
