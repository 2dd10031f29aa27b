"""Operator 2, secret scans.

One Aho-Corasick pass over the lower-cased text finds the keywords of all
kinds. Only at a hit is the kind's regular expression tried, anchored there.
Kinds that carry a checksum or an encoded header are then validated, and fall
out if it fails. Hexadecimal runs have no keyword: their prefilter is the run
itself, taken by one linear scan for runs that are long enough.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomseq.llm.common import decoded, map_text, sha_of, table

BASE = ("assign", "access", "hex")
_62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _crc_62(m: re.Match) -> bool:
    """The last six characters are the CRC-32 of the 30 before them, in base 62."""
    body, tail = m[1][:-6], m[1][-6:]
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = _62[r] + out
    return out == tail


def _jwt(m: re.Match) -> bool:
    """The header decodes to a JSON object that names an algorithm."""
    try:
        head = json.loads(base64.urlsafe_b64decode(m[1] + "=" * (-len(m[1]) % 4)))
    except (ValueError, binascii.Error):
        return False
    return isinstance(head, dict) and "alg" in head


class Token:
    """match() of (eyJ[A-Za-z0-9_-]{8,})\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}, in time linear in a text however often it begins anew.

    All beginnings within one run of its characters go on alike after the run,
    so what follows a run is looked at once.
    """

    run = re.compile(r"[A-Za-z0-9_-]+")
    rest = re.compile(r"\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}")

    class Found:
        def __init__(self, text: str, at: int, first: int, end: int):
            self.text, self.at, self.first, self.last = text, at, first, end

        def start(self) -> int:
            return self.at

        def end(self) -> int:
            return self.last

        def __getitem__(self, n: int) -> str:
            return self.text[self.at : self.first if n else self.last]

    def begin(self) -> None:
        self.upto, self.after = -1, None

    def match(self, text: str, at: int) -> Token.Found | None:
        if not text.startswith("eyJ", at):
            return None
        if at >= self.upto:
            self.upto = self.run.match(text, at).end()
            self.after = self.rest.match(text, self.upto)
        return self.Found(text, at, self.upto, self.after.end()) if self.after and self.upto - at >= 11 else None


#: kind: keywords in lower case, expression anchored at a keyword's start, validation. Fixed formats; the first two are the contract's.
KINDS = {
    "assign": (("password", "passwd", "secret", "token", "apikey", "api_key"), re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    "access": (("akia",), re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": ((), re.compile(r"[0-9a-f]{24,}"), None),
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), _crc_62),
    "npm": (("npm_",), re.compile(r"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), _crc_62),
    "jwt": (("eyj",), Token(), _jwt),
    "slack": (("xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-"), re.compile(r"xox[bpars]-[0-9]{8,}-[A-Za-z0-9-]{16,}"), None),
    "stripe": (("sk_live_", "rk_live_"), re.compile(r"[sr]k_live_[A-Za-z0-9]{24,}"), None),
    "google": (("aiza",), re.compile(r"AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])"), None),
    "pem": (("-----begin",), re.compile(r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"), None),
}


class Scanner:
    def __init__(self) -> None:
        import ahocorasick

        self.keywords = ahocorasick.Automaton()
        for kind, (words, *_) in KINDS.items():
            for w in words:
                self.keywords.add_word(w, (kind, len(w)))
        self.keywords.make_automaton()
        self.order = {k: i for i, k in enumerate(KINDS)}

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, kind) by start, then kind in the order of KINDS."""
        if not text:
            return []
        found = [(m.start(), m.end(), "hex") for m in KINDS["hex"][1].finditer(text)]
        low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # A-Z only, so places stay
        hits = sorted((end + 1 - n, kind) for end, (kind, n) in self.keywords.iter(low))
        done: dict[str, int] = {}
        KINDS["jwt"][1].begin()
        for at, kind in hits:
            if at < done.get(kind, 0):  # inside the kind's match before
                continue
            _, expression, valid = KINDS[kind]
            if m := expression.match(text, at):
                done[kind] = m.end()
                if valid is None or valid(m):
                    found.append((m.start(), m.end(), kind))
        found.sort(key=lambda x: (x[0], self.order[x[2]]))
        return found

    def redact(self, text: str | None) -> str | None:
        """The text with each span (overlapping ones together) replaced by its first kind in brackets."""
        out, at = [], 0
        for a, b, kind in self.spans(text):
            if a >= at:
                out += [text[at:a], f"[{kind}]"]
            at = max(at, b)
        return "".join([*out, text[at:]]) if out else text


_SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find_secrets(docs: DataFrame, *, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep` and secrets array<struct<kind,start,end>> (code points, end exclusive; by start, then kind as in KINDS).

    Null and empty texts have none. A byte that is not UTF-8 counts as one code
    point, U+FFFD. One output row for each row; `keep` must not name secrets.
    """

    def begin():
        scan = Scanner().spans
        return lambda texts: [[[(k, a, b) for a, b, k in scan(decoded(t))] for t in texts]]

    return map_text(docs, text, keep, [T.StructField("secrets", _SPAN)], begin)


def redact_secrets(docs: DataFrame, *, keep: list[str], text: str = "text", out: str = "redacted") -> DataFrame:
    """Columns `keep` and `out`: the text with every secret replaced by its kind in brackets. Null stays null; a byte that is not UTF-8 becomes U+FFFD."""

    def begin():
        redact = Scanner().redact
        return lambda texts: [[redact(decoded(t)) for t in texts]]

    return map_text(docs, text, keep, [T.StructField(out, T.StringType())], begin)


def span_text(spans: Column) -> Column:
    """Array of kind:start:end."""
    return F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(count, BASE), sha_of(span_text(base)).alias("base_sha256"), F.array_join(span_text(F.col("secrets")), ",").alias("spans"))
