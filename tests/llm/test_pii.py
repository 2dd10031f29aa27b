import hashlib
import random
import re

from conftest import SF
from loomseq.llm.pii import Field, base_spans, find_pii, luhn, op9_pii, spans

EXPRESSIONS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15),
}


def plain(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, (e, ok) in EXPRESSIONS.items() for m in re.finditer(e, text or "") if ok(m)]


def joined(found):
    return [f"{k}:{a}:{b}" for a, b, k in sorted(found, key=lambda s: (list(EXPRESSIONS).index(s[2]), s[0]))]


ODD = [None, "", "@", "a@b", "a@b.c@d.e", "é@b.c x.@y.z", "1.2.3.4.5.6.7.8", "256.1.1.1 01.002.0003.4", "4111 1111 1111 1111", "4111-1111 1111--1111", "+1 (212) 555-0188 +1", "+12345678" + " " * 50 + "9", "٣.٣.٣.٣ 9", "+" * 99 + "49 30 901820", "a" * 9000 + "@" + "b." * 900]


def test_base_spans_equal_plain_regex(spark, docs):
    rng = random.Random(4)
    noise = ["".join(rng.choice("a1.@+- ()é9") for _ in range(60)) for _ in range(3000)]
    texts = [*ODD, *noise, *(r.text for r in docs.select("text").collect())]
    for t in texts:
        assert joined(base_spans(t)) == plain(t)
    rows = {r.doc_id: r for r in op9_pii(spark, SF).collect()}
    for r in docs.collect():
        want = plain(r.text)
        assert rows[r.doc_id].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [rows[r.doc_id][f"n_{k}"] for k in EXPRESSIONS] == [sum(x.startswith(k) for x in want) for k in EXPRESSIONS]
        assert set(want) <= set(rows[r.doc_id].spans.split(",")) | {""}


def test_field_adds_spans_and_leaves_clean_text_alone():
    field = Field()
    found = spans(field, [b"please call (415) 555-0199, or 078-05-1120 and DE89370400440532013000 ok", b"The year 1987 saw 12,000 ships; see 3-4 and 1.2.3 for 415 more."])
    assert [k for k, *_ in found[0]] == ["phone", "ssn", "iban"] and found[1] == []


def test_shapes_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)] + [(None, "x a@b.cd", 1)] * 2 + [(99, "word 12 " * 100_000, 1)], "doc_id long, text string, spans int")
    rows = find_pii(df, keep=["doc_id", "spans"]).collect()
    assert len(rows) == df.count() and rows[0].pii == [] and [s.kind for s in rows[-2].pii] == ["email"]
    assert find_pii(df.limit(0), keep=["doc_id"]).count() == 0


def test_added_spans_precision_and_recall():
    """Planted spans of the added kinds and forms in sentences that the labelled table does not have."""
    rng = random.Random(9)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def iban():
        body = "DE00" + digits(18)
        check = 98 - int("".join(str(int(c, 36)) for c in body[4:] + body[:4])) % 97
        return f"DE{check:02}" + body[4:]

    kinds = {
        "ssn": lambda: f"{rng.randrange(100, 600)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}",
        "iban": iban,
        "phone": lambda: rng.choice(["({}) {}-{}", "{}-{}-{}"]).format(rng.randrange(200, 999), rng.randrange(200, 999), digits(4)),
        "email": lambda: f"user{digits(2)}(at)mail{digits(1)}.org",
    }
    carriers = ["please note {} for later", "he gave {} to the clerk", "we found {} in the file, then left", "{} was on the form", "ask about {}."]
    clean = ["The 12 ships of 1843 carried 2,400 tons, see 3-4.", "Chapter 7, verse 21; page 118-120", "a price of 19.99 for 3 items (set 40-2)", "Version 4.10.2, build 20210405", "room 12-34-56 is closed"]
    texts, want = [], []
    for _ in range(200):
        kind = rng.choice(list(kinds))
        value, carrier = kinds[kind](), rng.choice(carriers)
        at = carrier.index("{}")
        texts.append(carrier.format(value).encode())
        want.append((kind, at, at + len(value)))
    found = spans(Field(), texts + [c.encode() for c in clean])
    hit = sum(w in {s[:3] for s in f} for w, f in zip(want, found))
    extra = sum(s[:3] != w for w, f in zip(want, found) for s in f) + sum(len(f) for f in found[len(texts) :])
    assert hit / len(texts) >= 0.8 and extra / max(1, hit + extra) <= 0.05, (hit, extra)


def test_decoded_tags_equal_a_plain_viterbi():
    from loomseq.llm.pii import _SHAPE, TAGS, _features

    field = Field()
    texts = [b"call (415) 555-0199 or write to x.y@z.org now", b"", None, b"card 4111 1111 1111 1111, ssn 219-09-9998 and DE89370400440532013000 end", b"one"]
    tags, lengths = field.decode(texts)
    at, n = 0, len(TAGS)
    get, last = field.index.get, len(field.index)
    for t, size in zip(texts, lengths.tolist(), strict=True):
        shapes = [w.translate(_SHAPE) for w in (t or b"").split()]
        assert size == len(shapes)
        part = lambda i, side: sum(field.w[get(side + f, last)] for f in _features(shapes[i]))  # noqa: B023, E731
        best, back = None, []
        for i in range(size):
            e = part(i, "0") + (part(i - 1, "-") if i else 0) + (part(i + 1, "+") if i + 1 < size else 0)
            if best is None:
                best = list(e)
                continue
            came = [max(range(n), key=lambda a: (best[a] + field.trans[a, b], -a)) for b in range(n)]  # noqa: B023
            best = [best[came[b]] + field.trans[came[b], b] + e[b] for b in range(n)]
            back.append(came)
        if size:
            path = [max(range(n), key=lambda a: (best[a], -a))]  # noqa: B023
            for came in reversed(back):
                path.append(came[path[-1]])
            assert tags[at : at + size].tolist() == path[::-1]
        at += size


def test_many_spans_in_one_text_take_linear_time():
    import time

    parts = ["call (212) 555-0188 or mail jo.doe@mail.example.com now", "ssn 123-45-6789 host 10.0.0.1 done", "mail jo.doe (at) mail.example.com please"]
    field = Field()
    small = " ".join(parts * 40)
    found = spans(field, [small.encode()])[0]
    base = [s for s in found if s[3]]
    assert all(hi <= x or lo >= y for _, lo, hi, own in found if not own for _, x, y, _ in base) and len(found) > len(base)
    at = time.time()
    (long,) = spans(field, [(" ".join(parts * 7000)).encode()])
    assert len(long) >= 20_000 and time.time() - at < 40
