import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from loomseq.llm import lm
from loomseq.llm.lm import END, LEVELS, STEPS, Mixer, edge_grams, op10_lm_score, score, word_grams


def tokens(t):
    return [*(t or "").encode().lower().split(), END]


def plain(docs, training):
    c = Counter(w for t in training for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return {i: (len(w := tokens(t)), sum(x in c for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for i, t in docs}


def test_query_base_and_held_out_score(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows}
    want = plain([tuple(r) for r in rows], [r.text for r in rows if not held[r.doc_id]])
    got = op10_lm_score(spark, SF).toPandas().set_index("doc_id")
    assert len(got) == len(rows)
    for i, (n, known, total, base) in want.items():
        g = got.loc[i]
        assert (g.n_tokens, g.n_known, g.train_tokens, g.held_out) == (n, known, total, held[i]) and g.base_score == pytest.approx(base)
    out = got[got.held_out]
    letters = Counter(b for r in rows for w in tokens(r.text) for b in w + b" ")
    order0 = -sum(n * math.log2(n / sum(letters.values())) for n in letters.values()) / sum(letters.values())
    assert out.bits_per_byte.mean() < 0.85 * order0  # bytes alone, without context
    assert (got.score < 0).all()


def test_predictions_are_probabilities():
    """The costs of all bytes after any context are those of a distribution, whatever was learned."""
    rng = np.random.default_rng(0)
    mixer = Mixer(rng.integers(0, 50, (2, 1 << 18)).astype(np.uint8))
    mixer.weights = rng.normal(size=mixer.weights.shape).astype(np.float32)
    for before in (0x2020202020, 0x2074686520, int.from_bytes("äöé"[:2].encode() + b"x", "big")):
        cost = mixer.costs((before << 8) | np.arange(256))
        assert (2.0**-cost).sum() == pytest.approx(1, abs=1e-6)


def test_grams():
    g, first = word_grams([b"ab", b"abc", END, "é".encode() * 4])
    assert first.tolist() == [0, 0, 1, 1] and len(g) == 1 + 6
    text = lambda x, n=6: int(x).to_bytes(n, "big")
    assert text(g[0]) == b"  abc " and text(g[1]) == b"  " + "é".encode() * 2 and text(g[-1]) == "é".encode()[1:] + "é".encode() * 2 + b" "
    g, many = edge_grams([[b"a", b"bcd", END], [END], [b"xy", END]])
    assert [text(x, 5) for x in g] == [b"    a", b"   a ", b"  a b", b" a bc", b"a bcd", b"bcd \n", b"    \n", b"    x", b"   xy", b"  xy ", b" xy \n"]
    assert many.tolist() == [6, 1, 4]


def plain_bits(mixer, text):
    """A text's bits, one bit after the other in order, with a context read from the bytes coded so far."""
    words = (text or "").encode().lower().split()
    stream = b"     " + b"".join(w + b" " for w in words) + b"\n"
    total = 0.0
    for i in range(5, len(stream)):
        word = b""
        for c in reversed(stream[:i]):
            if c == 32 or len(word) == 5:
                break
            word = bytes([c]) + word
        ctx = [int.from_bytes(stream[i - k : i], "big") for k in range(1, 5)] + [int.from_bytes(word.rjust(5), "big")]
        node = 1
        for j in range(8):
            bit = (stream[i] >> (7 - j)) & 1
            n, x = [], []
            for k, c in enumerate(ctx):
                h = lm.mix64(np.array([c + (k << 48)], np.uint64))[0]
                at = ((int(h) ^ (node * 0x9E3779B97F4A7C15 % 2**64)) * 0xD6E8FEB86659FD93 % 2**64) >> (64 - mixer.bits)
                zero, one = (float(lm.COUNT[mixer.counts[b, at]]) for b in (0, 1))
                n.append(zero + one)
                x.append(math.log(one + 0.4) - math.log(zero + 0.4))
            seen = sum(v > 0 for v in n)
            level = sum(v <= n[max(seen - 1, 0)] for v in LEVELS)
            w = mixer.weights[(seen * (len(LEVELS) + 1) + level) * 8 + j]
            mixed = min(15, max(-15, sum(float(a) * b for a, b in zip(w, x, strict=True))))
            place = min(STEPS - 1.001, max(0, mixed * 2 + STEPS // 2))
            row, lo = mixer.map[stream[i - 1]], int(place)
            refined = row[lo] * (1 - (place - lo)) + row[lo + 1] * (place - lo)
            p = min(1 - 1e-5, max(1e-5, (1 / (1 + math.exp(-mixed)) + 3 * refined) / 4))
            total -= math.log2(p if bit else 1 - p)
            node = node * 2 | bit
    return total


def test_scores_equal_a_plain_coder_and_do_not_depend_on_partitions(spark, docs, monkeypatch):
    kept = {}
    train = lm.train
    monkeypatch.setattr(lm, "train", lambda *a: kept.setdefault("mixer", train(*a)))
    some = docs.where("doc_id < 60")
    train_rows = docs.where("doc_id % 7 <> 0")
    rows = {r.doc_id: r for r in score(some, train_rows, keep=["doc_id", "text"]).collect()}
    for r in sorted(rows.values(), key=lambda r: len(r.text or ""))[:25]:
        want = plain_bits(kept["mixer"], r.text)
        assert -r.score / math.log10(2) == pytest.approx(want, rel=1e-4)
    kept.clear()
    again = {r.doc_id: r.score for r in score(some.repartition(5), train_rows.repartition(9, "source"), keep=["doc_id"]).collect()}
    assert again == pytest.approx({i: r.score for i, r in rows.items()}, rel=1e-12)


def test_order_of_words_counts(spark):
    train = spark.createDataFrame([("new york city hall",), ("new york",)] * 50, "text string")
    a, b = (r.score for r in sorted(score(spark.createDataFrame([(0, "new york city"), (1, "york new city")], "doc_id long, text string"), train, keep=["doc_id"]).collect()))
    assert a > b + 0.5


@pytest.mark.parametrize("heavy", [1, 500_000])
def test_repeats_nulls_rare_words_and_clashing_columns(spark, heavy):
    rng = random.Random(1)
    word = lambda: rng.choice(["the", "of", "Zürich", "x" * 80, "q%d" % rng.randrange(300)])
    texts = [(i, " ".join(word() for _ in range(40)), 7) for i in range(100)] + [(200, None, 7), (201, "", 7), (202, "\x0b \x1c", 7), (5, "the the", 7), (None, "the", 7), (203, "abc " * 40_000, 7)]
    df = spark.createDataFrame(texts, "doc_id long, text string, score long")
    train = df.where("doc_id < 60")
    got = score(df, train, keep=["doc_id", "text"], heavy=heavy).collect()
    want = plain([(t, t) for _, t, _ in texts], [t for i, t, _ in texts if i is not None and i < 60])
    assert len(got) == len(texts)
    for g in got:
        n, known, total, base = want[g.text]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (n, known, total) and g.base_score == pytest.approx(base)
    assert len({g.score for g in got if g.text in (None, "")}) == 1
    assert score(df.limit(0), train, keep=["doc_id"]).count() == 0
    assert all(g.n_known == 0 and g.score < 0 for g in score(df, train.limit(0), keep=["doc_id"]).collect())
