import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from loomseq.llm.common import viterbi
from loomseq.llm.language import ALPHA, LANGUAGES, SCRIPTS, SHARE, SLOTS, SWITCH, identify, op4_language_id, words_of


def script_of(word):
    first = ord(word.decode()[0])
    return next(n for s, n in reversed(SCRIPTS) if s <= (97 if first < 128 else first))


def test_held_out_accuracy(spark, docs):
    got = op4_language_id(spark, SF).toPandas().merge(docs.toPandas()[["doc_id", "lang", "text"]], on="doc_id")
    assert len(got) == docs.count()
    held = got[got.held_out & got.lang.notna() & got.text.str.contains("[a-z]", na=False)]
    assert len(held) > 30 and (held.lang == held.lang_pred).mean() > 0.97


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(0)
    lengths = np.array([0, 1, 4, 6, 0, 3])
    emit = rng.normal(size=(lengths.sum(), 3)).astype(np.float32)
    trans = rng.normal(size=(3, 3)).astype(np.float32)
    path, at = viterbi(emit, lengths, trans), 0
    for n in lengths:
        e = emit[at : at + n]
        score = lambda p: sum(e[i, s] for i, s in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
        if n:
            assert tuple(path[at : at + n]) == max(itertools.product(range(3), repeat=n), key=score)
        at += n


def test_mixed_text_scripts_and_nulls(spark):
    en = "the house that they have with this other thing and then some water"
    de = "und das haus die nicht auch eine schöne straße wieder zwischen über"
    ru = "это дом который они имеют вместе с другой вещью и потом вода"
    train = spark.createDataFrame([(en, "en"), (de, "de"), (ru, "ru"), ("x", None), (None, "de")] * 3, "text string, lang string")
    rows = [en, de.upper(), ru, f"{en}. {de}! {en}", "12 34 …", "", None, "ψψψ", "這是", de * 3000]
    df = spark.createDataFrame([(i, t, "q", "w") for i, t in enumerate(rows)] + [(None, en, "q", "w")] * 2, "doc_id long, text string, lang string, lang_pred string")
    got = {r.doc_id: r for r in identify(df, train, keep=["doc_id"]).collect()}
    assert [got[i].lang_pred for i in range(7)] == ["en", "de", "ru", "en", "und", "und", "und"]
    assert [s.lang for s in got[3].lang_spans] == ["en", "de", "en"] and got[9].lang_pred == "de"
    assert got[4].lang_score == 0 and got[7].lang_score == 0 and got[7].lang_pred in {"de", "en", "ru"}
    assert identify(df, train, keep=["doc_id"]).count() == len(rows) + 2
    assert identify(df.limit(0), train, keep=["doc_id"]).count() == 0
    assert {r.lang_pred for r in identify(df, train.limit(0), keep=["doc_id"]).collect()} == {"und"}


def test_words():
    assert words_of("L’été, ÉTÉ… 3x".encode()) == ["l".encode(), "été".encode(), "été".encode(), b"x"]


def test_query_equals_plain_scores(spark, docs):
    """Counts, word scores and the best path of every document, one by one in plain Python."""
    rows = docs.select("doc_id", "text", "lang").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows}
    slot = lambda g: (((g[0] << 16 | g[1] << 8 | g[2]) * 0x9E3779B1) >> 7) % SLOTS
    grams = lambda w: [slot((b" " + w + b" ")[i : i + 3]) for i in range(len(w))]
    count, scripts = {}, {}
    for r in rows:
        if not held[r.doc_id] and r.lang is not None and r.text is not None:
            c, k = count.setdefault(r.lang, Counter()), scripts.setdefault(r.lang, Counter())
            for w in words_of(r.text.encode()):
                c.update(grams(w))
                k[script_of(w)] += 1
    langs = sorted(count)
    total = {x: sum(count[x].values()) + SLOTS * ALPHA for x in langs}
    uses = {x: {k for k, n in scripts[x].items() if n / sum(scripts[x].values()) >= SHARE} for x in langs}
    used = set().union(*uses.values())

    def score(w, x):
        out = 0 if script_of(w) in uses[x] or script_of(w) not in used else -60
        return out + sum(math.log((count[x][g] + ALPHA) / total[x]) for g in grams(w))

    got = {r.doc_id: r for r in op4_language_id(spark, SF).collect()}
    off = 0
    for r in rows:
        words = words_of((r.text or "").encode())
        best, back = None, []
        for w in words:
            e = [score(w, x) for x in langs]
            if best is None:
                best = e
                continue
            top = max(range(len(langs)), key=lambda i: (best[i], -i))
            came = [i if best[i] >= best[top] - SWITCH else top for i in range(len(langs))]
            back.append(came)
            best = [best[c] - SWITCH * (c != i) + e[i] for i, c in enumerate(came)]
        g = got[r.doc_id]
        if not words:
            assert (g.lang_pred, g.score, g.spans) == ("und", 0, "")
            continue
        path = [max(range(len(langs)), key=lambda i: (best[i], -i))]
        for came in reversed(back):
            path.append(came[path[-1]])
        held_by = [0] * len(langs)
        for w, p in zip(words, reversed(path), strict=True):
            held_by[p] += len(w.decode()) * (script_of(w) in used)
        want = max(range(len(langs)), key=lambda i: (held_by[i], -i))
        off += g.lang_pred != langs[want] or abs(g.score - held_by[want] / sum(len(w.decode()) for w in words)) > 1e-9
    assert off <= 1  # single precision may turn a tie


def test_too_many_languages_are_refused(spark):
    train = spark.range(LANGUAGES + 1).selectExpr("'some words' AS text", "cast(id AS string) AS lang")
    with pytest.raises(ValueError):
        identify(train, train, keep=["lang"])


def test_hundreds_of_languages(spark):
    word = lambda i: "".join(chr(97 + (i * k) % 26) for k in (3, 7, 11, 17, 19)) + chr(97 + i % 26) + chr(97 + i // 26)
    train = spark.createDataFrame([(f"{word(i)} " * 20, f"l{i:03}") for i in range(300)], "text string, lang string")
    got = identify(train, train, keep=["lang"]).collect()
    assert all(r.lang == r.lang_pred for r in got)
