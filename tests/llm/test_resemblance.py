import itertools
import random

import corpus_pipeline as P
from conftest import DOCS, SF
from loomseq.llm.resemblance import keep_one


def plain_kept(rows):
    """Smallest id of each class of (id, text), by all pairs."""
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {find(i) for i in sets}


def test_stage_equals_all_pairs(spark, docs):
    want = plain_kept([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert {r.doc_id for r in P.near_duplicates(spark, docs, SF).collect()} == want


def test_changed_words_chains_and_copies(spark):
    rng = random.Random(3)
    rows, n = [], 0
    for _ in range(12):
        text = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        for _ in range(12):  # each copy changes two more words: far ends are linked through those between
            rows.append((n, " ".join(text), "en", "a", 0))
            n += 1
            for at in rng.sample(range(200), 2):
                text[at] = f"w{rng.randrange(10**6)}"
        rows.append((n, " ".join(x if k % 9 else "z" for k, x in enumerate(text)), "en", "a", 0))  # too far
        n += 1
    rows += [(n, rows[5][1].upper(), "en", "a", 0)]
    want = plain_kept([r[:2] for r in rows])
    assert len(want) == 24
    assert {r.doc_id for r in keep_one(spark.createDataFrame(rows, DOCS)).collect()} == want


def test_a_large_group_whose_members_are_half_alike(spark, monkeypatch):
    """Most pairs share a key and few are links, so that cells of blocks decide."""
    import loomseq.llm.resemblance as R

    monkeypatch.setattr(R, "BLOCK_ROWS", 16)
    rng = random.Random(8)
    base, rows = [f"b{k}" for k in range(150)], []
    for n in range(150):
        text = list(base)
        for at in rng.sample(range(150), rng.choice([1, 2, 2, 3, 3, 4])):
            text[at] = f"x{rng.randrange(10**6)}"
        rows.append((n, " ".join(text), "en", "a", 0))
    want = plain_kept([r[:2] for r in rows])
    assert 1 < len(want) < 150
    assert {r.doc_id for r in keep_one(spark.createDataFrame(rows, DOCS)).collect()} == want


def test_equal_ids_and_rows(spark):
    rows = [(1, "a b c d e f", "en", "z", 1), (1, "a b c d e f", "en", "y", 1), (1, "a b c d e f", "en", "z", 1), (None, "a b c d e f", "en", "a", 1), (None, None, None, None, None), (2, "", None, None, None)]
    got = [{tuple(r) for r in keep_one(spark.createDataFrame(x, DOCS)).collect()} for x in (rows, rows[::-1])]
    assert got[0] == got[1] and {r[0] for r in got[0]} == {1, 2} and len(got[0]) == 2
