import math
import re
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from loomseq.llm import lexical as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall(text.translate(LOWER)) if text else []


def plain(docs, items, k=10):
    counts = [(i, Counter(words(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n, total = len(counts), sum(c[2] for c in counts)
    df = Counter(w for _, c, _ in counts for w in c)
    out = set()
    for item, text in items:
        scored = []
        for i, c, size in counts:
            m = 100 - 90 + 90 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in set(words(text)) if c[w])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out |= {(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])}
    return out


def got(df):
    rows = df.collect()
    assert len({(r.item_id, r["rank"], r.doc_id, r.score) for r in rows}) == len(rows)
    return {(r.item_id, r["rank"], r.doc_id, r.score) for r in rows}


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert got(L.op13_ranked_search(spark, SF)) == plain(docs, items)


@pytest.mark.parametrize("shard, item_bytes, depth", [(8192, 1 << 20, 64), (7, 60, 1), (64, 1, 2)])
def test_ties_nulls_repeats_and_common_terms(spark, monkeypatch, shard, item_bytes, depth):
    monkeypatch.setattr(L, "DEPTH", depth)  # of the first round: in the driver's process only, tasks keep theirs
    rng = np.random.default_rng(4)
    vocabulary = ["the", "of", "Éa", "b2", "zz", "Q"] + [f"w{i}" for i in range(40)]
    p = 1 / np.arange(1, len(vocabulary) + 1)
    docs = [(i, " ".join(rng.choice(vocabulary, rng.integers(1, 60), p=p / p.sum()))) for i in range(300)]
    docs += [(i, docs[7][1]) for i in range(300, 340)] + [(7, docs[7][1]), (None, docs[9][1]), (400, None), (401, ""), (402, " .,! "), (403, "the " * 30_000), (-5, "A-the_of;É\x00q")]
    items = [(1, "The OF zz"), (2, docs[7][1]), (3, None), (4, "..."), (5, "unknown"), (6, "the"), (7, " ".join(vocabulary)), (1, "The OF zz"), (None, "b2")]
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, term int, n int").repartition(3)
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int")
    assert got(L.ranked_search(d, b, shard=shard, item_bytes=item_bytes)) == plain(docs, items)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([("x", "a")], "item_id string, text string")
    assert L.ranked_search(d.limit(0), b).count() == 0
    assert L.ranked_search(d, b.limit(0)).count() == 0
    assert [r.item_id for r in L.ranked_search(d, b).collect()] == ["x"]


@pytest.mark.parametrize("seed", range(20))
def test_rounds_equal_full_reading(seed):
    rng = np.random.default_rng(seed)
    size, n = 200, 6
    score = np.where(rng.random((n, size)) < rng.random((n, 1)), rng.integers(1, 6, (n, size)) * rng.integers(1, 50, (n, 1)), 0)
    term, doc = np.nonzero(score)
    s = L.Shard(doc, term, score[term, doc], size, n)
    total = score.sum(0)
    for k, floor in ((1, 0), (5, 0), (10, int(np.sort(total)[-15])), (5, 10**6)):
        rows, found = s.best(np.arange(n), k, floor)
        assert (total[rows] == found).all()
        need = max(np.sort(total)[-k], floor, 1)
        assert set(np.flatnonzero(total >= need)) <= set(rows.tolist())


def test_reading_stops_before_the_end_of_long_lists():
    size = 100_000
    impact = np.full(size, 5)
    impact[:20] = 1_000_000 - np.arange(20)
    s = L.Shard(np.arange(size), np.zeros(size, np.int64), impact, size, 1)
    rows, found = s.best(np.array([0]), 10, 0)
    assert len(rows) <= L.DEPTH and set(rows[found >= 1_000_000 - 9].tolist()) == set(range(10))


def test_pieces_of_long_texts(monkeypatch):
    monkeypatch.setattr(L, "_PIECE", 5)
    text = ("Abc  defghijklmno-p " * 7 + "é" * 30).encode()
    assert [w.decode() for part in L.terms(text) for w in part] == words(text.decode())
