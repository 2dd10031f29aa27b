import hashlib
import re

from conftest import SF
from loomseq.llm.secrets import _62, KINDS, Scanner, find_secrets, op2_secret_scan, redact_secrets
import zlib

PLAIN = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 6),
    "access": (r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 20),
    "hex": (r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 24),
}


def plain(text):
    out = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, (e, f, ok)) in enumerate(PLAIN.items()) for m in re.finditer(e, text or "", f) if ok(m)]
    return [x[2] for x in sorted(out)]


ODD = [
    None, "", "token=abc", "TOKEN : 'abcdef", "tokentoken=abcdefg", 'passwd"=secret=abcdef token=zzzzzz', "api_key=apikey=abcdefgh", "é AKIA" + "A" * 16 + "é", "AKIAAKIA" + "B" * 30,
    "xAKIAB AKIA" + "9" * 17, "0" * 24 + "g" + "a" * 23, "İtoken=ſecretK " + "f" * 50, "secret" * 5000 + "=" + "x" * 9, "token  = " + " " * 3000 + "abcdefg", "ſecret=abcdef", "\U0001f600 token=abcdef",
]


def test_base_spans_equal_plain_regex(spark, docs):
    scan = Scanner()
    for t in [*ODD, *(r.text for r in docs.select("text").collect())]:
        assert [f"{k}:{a}:{b}" for a, b, k in scan.spans(t) if k in PLAIN] == plain(t)
    rows = {r.doc_id: r for r in op2_secret_scan(spark, SF).collect()}
    for r in docs.collect():
        want = plain(r.text)
        got = rows[r.doc_id]
        assert got.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [got.n_assign, got.n_access, got.n_hex] == [sum(x.startswith(k) for x in want) for k in PLAIN]


def test_checksums_decide():
    body = "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5"
    n, tail = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        tail = _62[r] + tail
    scan = Scanner()
    assert [k for _, _, k in scan.spans(f"x ghp_{body}{tail} y")] == ["github"]
    assert scan.spans(f"x ghp_{body}000000 y") == []
    assert [k for _, _, k in scan.spans("eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.abcdefghij")] == ["jwt"]
    assert scan.spans("eyJxxxxxxxxxxxxx.eyJzdWIiOiIxMjM0In0.abcdefghij") == []


def test_shapes_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(i, t, "s", i) for i, t in enumerate(ODD)] + [(None, "token=abcdef", "s", 1)] * 2, "doc_id long, text string, spans string, n_hex long")
    rows = find_secrets(df, keep=["doc_id", "spans"]).collect()
    assert len(rows) == df.count() and rows[0].secrets == []
    out = redact_secrets(df, keep=["doc_id"]).collect()
    assert out[0].redacted is None and out[-1].redacted == "[assign]"
    assert find_secrets(df.limit(0), keep=["doc_id"]).count() == 0


def test_header_runs_take_linear_time_and_equal_the_expression():
    import random
    import time

    plain_jwt = re.compile(r"(eyJ[A-Za-z0-9_-]{8,})\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
    at = time.time()
    assert Scanner().spans("eyJ" * 350_000) == [] and Scanner().redact("eyJ" * 350_000) == "eyJ" * 350_000
    assert time.time() - at < 10
    rng, token = random.Random(2), KINDS["jwt"][1]
    for _ in range(3000):
        text = "".join(rng.choice(["eyJ", "abcdefgh", "a", ".", ".", " "]) for _ in range(30))
        token.begin()
        for i in range(len(text)):
            want, got = plain_jwt.match(text, i), token.match(text, i)
            assert (want and (want.start(), want.end(), want[1])) == (got and (got.start(), got.end(), got[1]))


def test_bytes_that_are_not_utf8(spark):
    df = spark.sql("SELECT 1 AS doc_id, cast(unhex('FF20746F6B656E3D61626364656667') AS string) AS text")
    assert [(s.kind, s.start, s.end) for s in find_secrets(df, keep=["doc_id"]).first().secrets] == [("assign", 2, 15)]
