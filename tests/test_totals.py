"""Overlaps counted without their pairs, and joins that keep out of the driver."""

import random

from pyspark.sql import functions as F

from loomseq.jobs import catalog, places
from loomseq.operators import intervals as I
from loomseq.operators import reads as R


def test_overlap_totals_are_those_of_the_pairs(spark):
    rnd = random.Random(3)
    some = lambda n: [(rnd.choice("ab"), s, s + rnd.choice([0, 0, 1, 5, 30, -4])) for s in (rnd.randrange(60) for _ in range(n))] + [(None, 1, 9), ("a", None, 4), ("a", 3, None)]
    spans, wanted = some(80), [(i, *w) for i, w in enumerate(some(60))] + [(99, "b", 10, 20), (98, "b", 10, 20), (97, "c", 1, 50)]
    a, b = spark.createDataFrame(spans, "contig string, l_start long, l_end long"), spark.createDataFrame(wanted, "id long, contig string, r_start long, r_end long")
    want = set()
    for i, c, rs, re in wanted:
        hit = [(s, e) for k, s, e in spans if c is not None and k == c and None not in (s, e, rs, re) and e > rs and s < re]
        if hit:
            want.add((i, len(hit), sum(min(e, re) - max(s, rs) for s, e in hit), min(s for s, _ in hit), max(e for _, e in hit)))
    rows = I.overlap_totals(a, b, block=16).collect()
    assert {(r.id, r.n, r.shared, r["first"], r["last"]) for r in rows} == want and len(rows) == len(want)
    pairs = I.overlap_join(a, b).groupBy("id").agg(F.count("*").alias("n")).collect()
    assert {(r.id, r.n) for r in pairs} == {(i, n) for i, n, *_ in want}


def _pairs(df) -> bool:
    """Whether the plan builds pairs of intervals: overlap_join's classes are there."""
    return "__l" in df._jdf.queryExecution().optimizedPlan().toString()


def test_totals_of_orders_and_regions_build_no_pairs(spark):
    sf = "/root/testdata/sf0.001"
    assert not _pairs(catalog.j1_interval_overlap(spark, sf)) and not _pairs(places.s2_regions(spark, sf)) and _pairs(places.a5_event_evidence(spark, sf))


def test_regions_see_the_reads_of_every_order(spark):
    assert "%" not in places.ORACLES["s2_regions"].split(" JOIN ")[1] and "contig" not in places.ORACLES["a5_event_evidence"].split(" JOIN ")[1].split("GROUP")[0]


def test_hypotheses_at_one_place_are_judged_once(spark):
    h = spark.createDataFrame([("c", i, 100, 105) for i in range(40)] + [("c", 90, 105, 100), (None, 91, 100, 105)], "contig string, hypothesis long, left long, right long")
    s = spark.createDataFrame([("c", r, 90 + k, kind, 7 + k) for r in range(3) for k, kind in enumerate(("split", "left_clip", "split"))], "contig string, read long, pos long, kind string, length long")
    got = R.event_evidence(h, s)
    assert {r.hypothesis: (r.alt, r.split, r.left_clip, r.longest, r.names) for r in got.collect()} == {i: (3, 3, 3, 9, [0, 1, 2]) for i in [*range(40), 90]} | {91: (0, 0, 0, 0, None)}
    joined = [n for n in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "bucket" in n]
    assert joined and not any("hypothesis" in n for n in joined)


def test_seeds_are_not_broadcast(spark):
    d = spark.createDataFrame([(1, "ACGTACGTA", "TTACGTACGTA")], "id long, query string, target string").coalesce(1)
    got = R.seed_bins(d, k=5)
    assert got.count() and "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_equal_intervals_at_a_cut_stay_in_one_run(spark):
    iv = spark.createDataFrame([("a", 10, 20), ("a", 60, 80), ("a", 60, 80), ("a", 60, 80), ("a", 62, 90)], "k string, s long, e long").repartition(4)
    assert {tuple(r) for r in I.merge_intervals(iv, "k", "s", "e", 8).collect()} == {("a", 10, 20, 1), ("a", 60, 90, 4)}


def test_split_reads_are_spelt_once(spark):
    from loomseq.jobs import events

    plan = events.f11_split(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert max(n.count("md5(") for n in plan.splitlines()) == 1 and "RepartitionByExpression" in plan


def test_signatures_are_found_once(spark):
    plan = places.f6_signatures(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum(n.count("regexp_extract_all(") for n in plan) <= 9 and max(map(len, plan)) < 8000


def test_reference_reads_are_those_of_each_pair(spark):
    rnd = random.Random(5)
    hyps = [(rnd.choice("ab"), i, p, p + rnd.choice([0, 0, 0, 1, 3, -2, 40])) for i, p in enumerate(rnd.randrange(100) for _ in range(60))]
    hyps += [("a", 100, 40, 41), ("b", 100, 42, 44), ("a", 100, 40, 41), ("a", 101, 50, 50), ("a", 101, 50, 50), (None, 102, 5, 5), ("a", None, 50, 50), ("a", 103, None, 50), ("a", 104, None, None)]
    reads = [(rnd.choice("ab"), rnd.choice([None, *range(25)]), p, p + rnd.choice([0, 4, 20, 60, 90]), rnd.choice([0, 0, 0, 16, 2048, 4]), rnd.choice([None, 5, 19, 20, 60]), rnd.choice([None, [], [p + 3], [rnd.randrange(100), None, rnd.randrange(100)]])) for p in (rnd.randrange(100) for _ in range(150))]
    reads += [(None, 1, 0, 99, 0, 60, []), ("a", 1, None, 99, 0, 60, []), ("a", 1, 0, None, 0, 60, []), ("a", 1, 0, 99, None, 60, [])]
    named = [(i, rnd.choice([None, *range(25)])) for i in [*range(60), 100, 100, 101] for _ in range(2)]
    h, named_df = spark.createDataFrame(hyps, "contig string, hypothesis long, left int, right int"), spark.createDataFrame(named, "hypothesis long, read int")
    s = spark.createDataFrame(reads, "contig string, read int, pos int, ref_end int, flag int, mapq int, signals array<long>")
    for margin, near in ((1, 2), (0, 3), (2, -2), (-3, 1)):
        best = {}
        for c, i, a, b in hyps:
            lo, hi = min(x for x in (a, b, 1e9) if x is not None), max(x for x in (a, b, -1e9) if x is not None)
            for k, r, p, e, flag, q, signals in reads:
                if None in (c, i, p, e, flag, q) or c != k or flag & 0x904 or lo > hi or not (p <= hi and e > lo and p <= lo - margin and e >= hi + margin):
                    continue
                if (r is None or (i, r) not in named) and not any(x is not None and lo - near <= x <= hi + near for x in signals or []):
                    best[i, r] = max(q, best.get((i, r), 0))
        want = sorted((str(i), sum(j == i and q >= 20 for (j, _), q in best.items()), sum(j == i and q < 20 for (j, _), q in best.items())) for _, i, _, _ in hyps)
        got = R.reference_reads(h, s, named_df, margin=margin, near=near).collect()
        assert sorted((str(r.hypothesis), r.ref, r.ref_low) for r in got) == want and sum(w[1] for w in want) > 30 and sum(w[2] for w in want) > 10
    assert R.reference_reads(h.limit(0), s, named_df).count() == 0 and {(r.ref, r.ref_low) for r in R.reference_reads(h, s.limit(0), named_df).collect()} == {(0, 0)}


def test_reference_reads_build_no_pairs(spark, monkeypatch):
    pairs, join = [], R.overlap_join
    monkeypatch.setattr(R, "overlap_join", lambda a, b: (got := join(a, b), pairs.append(got.count()))[0])
    h = spark.range(600).selectExpr("'c' AS contig", "id AS hypothesis", "1000 + id % 50 AS left", "1003 + id % 50 AS right")
    s = spark.range(800).selectExpr("'c' AS contig", "id AS read", "id % 300 AS pos", "2000 + id AS ref_end", "0 AS flag", "60 AS mapq", "array(id % 900 * 4) AS signals")
    got = R.reference_reads(h, s, h.selectExpr("hypothesis", "hypothesis AS read"), margin=5, near=20).collect()
    assert len(got) == 600 and sum(r.ref for r in got) > 400_000 and sum(pairs) < 1400  # fewer than there are rows
