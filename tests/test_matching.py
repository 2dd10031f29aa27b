"""One-to-one matches against the rules in plain order."""

import random
import time
from bisect import bisect_left

import pytest

from loomseq.operators.matching import match_one_to_one, match_unused

CALLS, TRUTH = "contig string, call long, pos long", "contig string, truth long, pos long"


def plain_greedy(calls, truth, radius):
    pairs = {}
    for k, c, p in calls:
        for m, t, q in truth:
            if None not in (k, c, p, t, q) and k == m and abs(p - q) <= radius:
                pairs[c, t] = min(pairs.get((c, t), radius), abs(p - q))
    out, used = [], (set(), set())
    for d, c, t in sorted((d, c, t) for (c, t), d in pairs.items()):
        if c not in used[0] and t not in used[1]:
            used[0].add(c)
            used[1].add(t)
            out.append((c, t, d))
    return sorted(out)


def plain_unused(calls, truth, radius):
    spots, used, out = {}, {}, []
    for k, _, q in truth:
        if k is not None and q is not None:
            spots.setdefault(k, set()).add(q)
    for k, c, p in sorted((r for r in calls if None not in r), key=lambda r: (r[1], r[2])):
        ps, best = sorted(spots.get(k, ())), None
        i = bisect_left(ps, p)
        for q in ps[max(0, i - 2) : i + 2]:
            if q not in used.setdefault(k, set()) and abs(p - q) <= radius and (best is None or abs(p - q) < abs(p - best)):
                best = q
        if best is not None:
            used[k].add(best)
            out.append((c, best, abs(p - best)))
    return sorted(out)


@pytest.mark.parametrize("seed, repeats", [(0, False), (1, False), (2, True)])
def test_matches_equal_the_plain_rules(spark, seed, repeats):
    rng = random.Random(seed)
    place = lambda: (rng.choice("ab"), rng.randint(0, 900))
    calls = [(k, i % 60 if repeats else i, p) for i in range(150) for k, p in [place()]] + [(None, 900, 5), ("a", 901, None)]
    truth = [(k, i % 70 if repeats else i, p) for i in range(120) for k, p in [place()]] + [("a", None, 5), ("a", 800, None)]
    c, t = spark.createDataFrame(calls, CALLS), spark.createDataFrame(truth, TRUTH)
    for radius in (0, 7, 40):
        assert sorted(tuple(r) for r in match_one_to_one(c, t, radius).collect()) == plain_greedy(calls, truth, radius)
        if not repeats:
            assert sorted((r.call, r.truth_pos, r.distance) for r in match_unused(c, t, radius).collect()) == plain_unused(calls, truth, radius)


def test_input_order_differs_from_distance_order(spark):
    calls, truth = [("a", 1, 10), ("a", 2, 12)], [("a", 1, 12), ("a", 2, 30)]
    c, t = spark.createDataFrame(calls, CALLS), spark.createDataFrame(truth, TRUTH)
    assert [tuple(r)[:2] for r in match_one_to_one(c, t, 5).collect()] == [(2, 1)]
    assert [(r.call, r.truth_pos) for r in match_unused(c, t, 5).collect()] == [(1, 12)]
    assert match_one_to_one(c.limit(0), t, 5).count() == 0 and match_unused(c, t.limit(0), 5).count() == 0


def test_evenly_spaced_rows_take_one_pass(spark):
    n = 5000  # each call lies 10 from the truth on either side: a chain without an end
    calls, truth = [("a", i, 20 * i + 10) for i in range(n)], [("a", i, 20 * i) for i in range(n)]
    at = time.time()
    got = match_one_to_one(spark.createDataFrame(calls, CALLS), spark.createDataFrame(truth, TRUTH), 10).collect()
    assert sorted(tuple(r) for r in got) == [(i, i, 10) for i in range(n)] and time.time() - at < 60
