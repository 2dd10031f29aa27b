import math
import re
from collections import Counter, defaultdict

from conftest import DOCS, SF
import corpus_pipeline as P
from test_decontamination import plain as plain_hits
from test_language import script_of
from test_mixing import plain_targets
from test_resemblance import plain_kept
from loomseq.llm.language import ALPHA, SHARE, SLOTS, SWITCH, words_of
from loomseq.llm.mixing import offset
from loomseq.llm.secrets import KINDS


def as_rows(df):
    return {r.doc_id: r for r in df.collect()}


def plain_language(docs):
    """Language and share of letters of each (id, text, lang), learned from all of them, in plain Python."""
    slot = lambda g: (((g[0] << 16 | g[1] << 8 | g[2]) * 0x9E3779B1) >> 7) % SLOTS
    grams = lambda w: [slot((b" " + w + b" ")[i : i + 3]) for i in range(len(w))]
    count, scripts = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang in docs:
        if text is not None and lang is not None:
            for w in words_of(text.encode()):
                count[lang].update(grams(w))
                scripts[lang][script_of(w)] += 1
    langs = sorted(count)
    total = {x: sum(count[x].values()) + SLOTS * ALPHA for x in langs}
    uses = {x: {k for k, n in scripts[x].items() if n / sum(scripts[x].values()) >= SHARE} for x in langs}
    used = set().union(*uses.values())
    score = lambda w, x: (0 if script_of(w) in uses[x] or script_of(w) not in used else -60) + sum(math.log((count[x][g] + ALPHA) / total[x]) for g in grams(w))
    out = {}
    for i, text, _ in docs:
        best, back, words = None, [], words_of((text or "").encode())
        for w in words:
            e = [score(w, x) for x in langs]
            if best is None:
                best = e
                continue
            top = max(range(len(langs)), key=lambda k: (best[k], -k))
            came = [k if best[k] >= best[top] - SWITCH else top for k in range(len(langs))]
            back.append(came)
            best = [best[c] - SWITCH * (c != k) + e[k] for k, c in enumerate(came)]
        if not words:
            out[i] = ("und", 0.0)
            continue
        path = [max(range(len(langs)), key=lambda k: (best[k], -k))]
        for came in reversed(back):
            path.append(came[path[-1]])
        held = [0] * len(langs)
        for w, p in zip(words, reversed(path), strict=True):
            held[p] += len(w.decode()) * (script_of(w) in used)
        k = max(range(len(langs)), key=lambda k: (held[k], -k))
        out[i] = (langs[k], held[k] / sum(len(w.decode()) for w in words))
    return out


def plain_redacted(text):
    """Every expression at every place, left to right and without overlap for each kind; no keywords."""
    spans = []
    for order, (kind, (_, expression, valid)) in enumerate(KINDS.items()):
        pattern = re.compile(r"(eyJ[A-Za-z0-9_-]{8,})\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}") if kind == "jwt" else expression
        spans += [(m.start(), order, m.end(), kind) for m in pattern.finditer(text or "") if valid is None or valid(m)]
    out, at = "", 0
    for a, _, b, kind in sorted(spans):
        if a >= at:
            out += text[at:a] + f"[{kind}]"
        at = max(at, b)
    return text if not spans else out + text[at:]


def plain_mix(docs):
    """Copies of each (id, text, source) from one running sum a source, in the operator's order."""
    import hashlib

    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in docs}
    per, mine = Counter(), defaultdict(list)
    for i, _, s in docs:
        per[s] += size[i]
        mine[s].append(i)
    want, out = plain_targets(per), {}
    for s, ids in mine.items():
        cell = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) % 512
        ids.sort(key=lambda i: (size[i].bit_length(), cell(i), size[i], str(i)))
        rate = want[s] / per[s] if per[s] else 0
        for n, i in enumerate(ids):
            k = math.floor((n + 1) * rate + offset(7)) - math.floor(n * rate + offset(7))
            out[i] = min(k, 3) if size[i] else 0
    return out


def test_each_stage_against_brute_force_on_what_the_one_before_kept(spark, docs):
    before = docs
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in P.STAGES[:-1]:
        after = P.cut(stage(spark, before, SF), name)
        assert after.dtypes == docs.dtypes
        a, b = as_rows(before), as_rows(after)
        if name == "language_id":
            found = plain_language([(i, r.text, r.lang) for i, r in a.items()])
            assert set(b) == {i for i, (lang, share) in found.items() if lang != "und" and share >= P.LANGUAGE_SHARE}
            assert all(r.text == a[i].text and r.lang == (a[i].lang if a[i].lang is not None else found[i][0]) for i, r in b.items())
        elif name == "near_duplicates":
            assert set(b) == plain_kept([(i, r.text) for i, r in a.items()]) and all(r == a[i] for i, r in b.items())
        elif name == "benchmark_passages":
            hits = plain_hits([(i, r.text) for i, r in a.items()], items)
            assert set(b) == {i for i, (_, n, _) in hits.items() if not n} and len(b) < len(a)
        else:
            assert set(a) == set(b) and all(r.text == plain_redacted(a[i].text) for i, r in b.items())
        before = after
    last = {r.doc_id: r.copies for r in P.source_mix(spark, before, SF).collect()}
    want = plain_mix([(i, r.text, r.source) for i, r in b.items()])
    assert last == {i: k for i, k in want.items() if k}


def test_nulls_repeats_and_empty(spark):
    rows = [(1, "the house and the garden", "en", "a", 5), (1, "the house and the garden", "en", "a", 5), (None, "the house and the garden", "en", None, None), (2, None, None, None, None), (3, "", None, "a", 0), (4, "das haus und der garten dort", "de", None, None), (None, "other words that stand alone here", None, "b", None)]
    df = spark.createDataFrame(rows, DOCS)
    kept = P.near_duplicates(spark, P.cut(P.language(spark, df, SF), "x"), SF).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, rows[6][1]), (1, rows[0][1]), (4, rows[5][1])]
    assert next(r.lang for r in kept if r.doc_id is None) in {"en", "de"}
    for _, stage in P.STAGES:
        assert stage(spark, df.limit(0), SF).count() == 0
