import random
import re

from conftest import SF
from loomseq.llm.decontamination import decontaminate, op7_decontamination


def words(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def plain(docs, items):
    wins = [(str(i), words(t)) for i, t in items]
    wins = [(i, tuple(w[s : s + min(10, len(w))])) for i, w in wins if w for s in range(len(w) - min(10, len(w)) + 1)]
    out = {}
    for d, t in docs:
        w = words(t)
        hit, names = set(), set()
        for i, win in wins:
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    names.add(i)
        out[d] = (len(w), len(hit), sorted(names))
    return out


def test_random_texts_with_small_vocabulary_and_many_blocks(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("ab cé d É 7 x".split()) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 6, 9, 10, 12, 30]))) for i in range(14)] + [(3, "ab ab ab"), (None, None)]
    docs = []
    for d in range(60):
        t = text(rng.choice([0, 2, 11, 40]))
        for _ in range(rng.randrange(3)):
            w = words(rng.choice(items)[1])
            a = rng.randrange(len(w) + 1)
            t += " q " + " ".join(w[a : a + rng.randrange(20)]) + " " + text(3)
        docs.append((d, t))
    docs.append((60, None))
    want = plain(docs, items)
    d = spark.createDataFrame([(*x, 5) for x in docs], "doc_id long, text string, n_hit int")
    b = spark.createDataFrame([(*x, 5) for x in items], "item_id long, text string, doc_id int")
    for block in (1 << 24, 200):
        rows = decontaminate(d, b, keep=["doc_id"], block_bytes=block).collect()
        assert len(rows) == len(docs)
        for r in rows:
            n, hit, names = want[r.doc_id]
            assert (r.n_words, sum(s.end - s.first for s in r.hit_spans), sorted(r.hit_items)) == (n, hit, names)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    r = decontaminate(d, b, keep=["doc_id"]).collect()
    assert [(x.n_words, x.hit_spans, x.hit_items) for x in r] == [(2, [], [])]
    assert decontaminate(d.limit(0), d.withColumnRenamed("doc_id", "item_id"), keep=["doc_id"]).count() == 0
    assert op7_decontamination(spark, SF).where("contaminated").count() > 0


def test_long_repeated_texts_take_their_length():
    import time

    from loomseq.llm.decontamination import Index

    at = time.time()
    index = Index([("a", b"la " * 400), ("b", b"la lu " * 300), ("c", b"la"), ("d", b"x y z")] + [(f"e{i}", b"la " * 50) for i in range(300)])
    n, spans, names = index.scan([b"la " * 100_000, b"lu " + b"la lu " * 50_000, b"x y z " * 100_000, b"q " * 10])
    assert time.time() - at < 20
    assert n == [100_000, 100_001, 300_000, 10]
    assert spans == [[(0, 100_000)], [(0, 100_001)], [(0, 300_000)], []]
    assert names[0] == sorted(["a", "c", *(f"e{i}" for i in range(300))]) and names[1] == ["b", "c"] and names[2] == ["d"] and names[3] == []


def test_repeats_equal_brute_force(spark):
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice(["la", "la", "lu", "x"]) for _ in range(n))
    docs = [(i, text(rng.choice([3, 12, 60, 200]))) for i in range(60)]
    items = [(i, text(rng.choice([1, 2, 9, 10, 11, 40]))) for i in range(40)]
    got = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), keep=["doc_id"]).collect()
    want = plain(docs, items)
    for r in got:
        n, hit, names = want[r.doc_id][0], want[r.doc_id][1], want[r.doc_id][2]
        assert (r.n_words, sum(s.end - s.first for s in r.hit_spans), set(r.hit_items)) == (n, hit if isinstance(hit, int) else len(hit), set(names))
