"""Operator 9, personal data by a linear-chain conditional random field.

A token's features are its word shape, parts of it, and the shapes beside it.
The field is trained by gradient ascent on a small labelled table (LABELLED, or
any table of the same form) and decoded by Viterbi in numpy batches over all
tokens of all texts. A decoded span is kept if its kind's form and checksum
hold. The base spans, which plain expressions define, are found beside it and
always stay; a decoded span that touches one adds nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomseq.llm.common import WORD, decoded, map_text, sha_of, table, viterbi

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "ssn", "iban")
TAGS = ("O", *KINDS)
#: The labelled table: marked lines. What stands in <kind: ...> is a span, the rest is not.
LABELLED = (
    "Write to <email: anna.k@mail.example.org> before noon.",
    "mail me at <email: j.doe99@example.com> or call <phone: +1 (212) 555-0188>",
    "contact: <email: sales@shop-example.co.uk>, thanks",
    "reach <email: bob(at)example.org> for help",
    "send it to <email: info[at]example[dot]net> today",
    "the host <ip: 10.1.22.254> did not answer",
    "from <ip: 192.168.0.7> at 12:30 on port 8080",
    "ping <ip: 8.8.4.4> and <ip: 172.16.31.9>.",
    "card <card: 4111 1111 1111 1111> was charged 25.00",
    "paid with <card: 5500005555555559> yesterday",
    "number <card: 3782-822463-10005>, thanks",
    "use <card: 4012-8888-8888-1881> for the order",
    "call <phone: +44 20 7946 0958> after six",
    "phone <phone: (415) 555-2671> or come by",
    "Tel <phone: 415-555-2671>.",
    "my number is <phone: 555-867-5309> thanks",
    "dial <phone: +49 (30) 901820> now",
    "call <phone: (212) 555-0123>, then wait",
    "his number <ssn: 078-05-1120> is void",
    "SSN <ssn: 219-09-9999>, born 1950",
    "id <ssn: 457-55-5462>.",
    "transfer to <iban: DE89370400440532013000> please",
    "account <iban: GB82WEST12345698765432>, ref 12",
    "pay <iban: FR1420041010050500013M02606> now",
    "In 1999 about 2,500 people lived there, 3.5 percent more than in 1990.",
    "Version 1.2.3 was released on 2021-04-05 at 10:15:30 .",
    "The order 83921 has 12 items, total 1,299.00 dollars (tax 19%).",
    "see pages 12-15 and 130-142 of volume 3",
    "room 415, floor 4; seats 5555",
    "http://www.example.com/a/b?c=1 is a link, so is example.org",
    "key = \"3f2a9c\" and hash 9bcd12ef00a1b2c3",
    "@home and #tag and a@b are no addresses",
    "The quick brown fox, and the lazy dog. Then it rained;",
    "Es war einmal ein kleiner Hund. Und dann?",
    "la casa | el perro | dos gatos",
    "x = y + 2 * (z - 1) / 3",
    "$$$ 12*** and%%% so&&& on### 7",
    "12345 678 90 1 22 333 4444",
    "10-20-30 and 1/2/2003 and 12.5.99",
    "A B C D. 1) 2) 3) (4) [5]",
)
#: A-Z and 0-9 become X and d, a-z and all non-ASCII bytes x.
_SHAPE = bytes(88 if 65 <= b <= 90 else 100 if 48 <= b <= 57 else 120 if 97 <= b <= 122 or b >= 128 else b for b in range(256))
EPOCHS, RATE, DECAY = 400, 0.5, 1e-3


def _features(shape: bytes) -> list[str]:
    """Of a token's shape (letters and digits folded): the parts the field sees, with run lengths up to 4."""
    s = shape.decode("latin-1")
    s = re.sub(r"x+", "x", re.sub(r"X+", lambda m: "X" if len(m[0]) < 3 else "W", s))
    core = s.strip(".,;:!?*#%&$|\"'")
    digits = s.count("d")
    brief = re.sub(r"d{5,}", "D", core)
    return [f"s={brief[:24]}", f"c={re.sub('d+', 'd', core)[:24]}", f"n={min(digits, 20)}", f"@={'@' in s or '[x]' in s or '(x)' in s}", f"p={brief[:2]}", f"e={s[-1:] if not s[-1:].isalnum() else ''}", f"k={''.join(sorted(set(core) - set('xXWd')))[:6]}"]


class Field:
    """The trained field: feature weights for each tag, for a token itself, for the one before and for the one after it."""

    def __init__(self, lines: tuple[str, ...] = LABELLED):
        data = [self._parse(x) for x in lines]
        data = [d for d in data if len(d[1])]
        names = sorted({f for shapes, _ in data for s in shapes for f in self._all(s)})
        self.index = {f: i for i, f in enumerate(names)}
        self.w = np.zeros((len(names) + 1, len(TAGS)))  # the last row is of features not seen in training
        self.trans = np.zeros((len(TAGS), len(TAGS)))
        self._train(data)
        self.by_shape: dict[bytes, int] = {}
        self.by_features: dict[tuple[str, ...], int] = {}
        self.scores: list[np.ndarray] = []

    @staticmethod
    def _all(shape: bytes) -> list[str]:
        return [side + f for f in _features(shape) for side in ("0", "-", "+")]

    @staticmethod
    def _parse(line: str) -> tuple[list[bytes], np.ndarray]:
        tags: list[int] = []
        text = ""
        for part in re.split(r"(<\w+: .*?>)", line):
            m = re.fullmatch(r"<(\w+): (.*)>", part)
            tags += [TAGS.index(m[1]) if m else 0] * len(m[2] if m else part)
            text += m[2] if m else part
        tokens = list(re.finditer(WORD, text))
        return [m[0].encode().translate(_SHAPE) for m in tokens], np.array([max(tags[m.start() : m.end()]) for m in tokens], np.int64)

    def _train(self, data: list) -> None:
        dense = np.zeros((sum(len(y) for _, y in data), len(self.index)), np.float64)
        at, cuts = 0, []
        for shapes, _ in data:
            for t in range(len(shapes)):
                for side, near in (("0", t), ("-", t - 1), ("+", t + 1)):
                    if 0 <= near < len(shapes):
                        for f in _features(shapes[near]):
                            dense[at + t, self.index[side + f]] += 1
            cuts.append((at, at + len(shapes)))
            at += len(shapes)
        gold = np.concatenate([y for _, y in data])
        want = np.eye(len(TAGS))[gold]
        pairs = np.zeros_like(self.trans)
        for a, b in cuts:
            np.add.at(pairs, (gold[a : b - 1], gold[a + 1 : b]), 1)
        g2w, g2t = np.full_like(self.w[:-1], 1e-8), np.full_like(self.trans, 1e-8)
        for _ in range(EPOCHS):
            emit = dense @ self.w[:-1]
            have, moves = np.zeros_like(want), np.zeros_like(pairs)
            for a, b in cuts:
                p, m = self._marginals(emit[a:b])
                have[a:b], moves = p, moves + m
            gw, gt = dense.T @ (want - have) - DECAY * self.w[:-1], pairs - moves - DECAY * self.trans
            g2w, g2t = g2w + gw * gw, g2t + gt * gt
            self.w[:-1] += RATE * gw / np.sqrt(g2w)
            self.trans += RATE * gt / np.sqrt(g2t)

    def _marginals(self, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(emit)
        step, local = np.exp(self.trans), np.exp(emit - emit.max(1, keepdims=True))
        fore, back = local.copy(), np.ones_like(local)
        fore[0] /= fore[0].sum()
        for t in range(1, n):
            fore[t] = (fore[t - 1] @ step) * local[t]
            fore[t] /= fore[t].sum()
        for t in range(n - 2, -1, -1):
            back[t] = step @ (local[t + 1] * back[t + 1])
            back[t] /= back[t].sum()
        p = fore * back
        p /= p.sum(1, keepdims=True)
        moves = np.zeros_like(self.trans)
        for t in range(n - 1):
            m = fore[t][:, None] * step * (local[t + 1] * back[t + 1])[None]
            moves += m / m.sum()
        return p, moves

    def _number(self, shape: bytes) -> int:
        """Number of a shape, scored when first seen. Shapes that differ in nothing the field sees share a number."""
        features = tuple(_features(shape))
        if (n := self.by_features.get(features)) is None:
            get, last = self.index.get, len(self.index)
            self.scores.append(np.stack([self.w[[get(side + f, last) for f in features]].sum(0) for side in ("0", "-", "+")]).astype(np.float32))
            n = self.by_features[features] = len(self.scores) - 1
        return n

    def decode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Tag of every token of all texts, and how many tokens each text has."""
        if len(self.by_shape) > 500_000 or len(self.scores) > 100_000:  # bounds a worker's memory
            self.by_shape.clear(), self.by_features.clear(), self.scores.clear()
        ids, lengths = [], []
        for t in texts:
            shapes = t.translate(_SHAPE).split() if t else []
            for s in set(shapes).difference(self.by_shape):
                self.by_shape[s] = self._number(s)
            ids.append(np.fromiter(map(self.by_shape.__getitem__, shapes), np.int64, len(shapes)))
            lengths.append(len(shapes))
        all_ids, n = np.concatenate(ids) if ids else np.zeros(0, np.int64), np.array(lengths, np.int64)
        if not len(all_ids):
            return np.zeros(0, np.int32), n
        table_ = np.stack(self.scores)
        emit = table_[all_ids, 0]
        end = np.cumsum(n)
        inner = np.ones(len(all_ids), bool)
        inner[(end - n)[n > 0]] = False  # a text's first token has none before it
        emit[inner] += table_[all_ids[np.flatnonzero(inner) - 1], 1]
        inner = np.ones(len(all_ids), bool)
        inner[(end - 1)[n > 0]] = False
        emit[inner] += table_[all_ids[np.flatnonzero(inner) + 1], 2]
        return viterbi(emit, n, self.trans.astype(np.float32)), n


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # from a run's start: no later start in the run fits where this one does not
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(WORD)


def _emails(text: str):
    """Each @ with the longest local part before it and the domain after it. Equal to scanning by the whole expression, but linear."""
    done, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            yield a, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    if not text:
        return []
    out = [(a, b, "email") for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append((m.start(), m.end(), "card"))
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return out


def _iban(s: str) -> bool:
    return bool(re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", s)) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _valid(kind: str, s: str) -> bool:
    """Whether a decoded span has its kind's form; checksums where there are some."""
    d = re.sub("[^0-9]", "", s)
    if kind == "email":
        return bool(re.fullmatch(r"[\w.%+-]+\s?(@|\(at\)|\[at\])\s?[\w-]+((\.|\[dot\]|\(dot\))[\w-]+)+", s, re.A))
    if kind == "ip":
        return False  # every such form is a base span
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return bool(re.fullmatch(r"(\+?[0-9]{1,3}[ .-]?)?(\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-]?[0-9]{3,4}", s)) and 9 <= len(d) <= 15
    if kind == "ssn":
        return bool(re.fullmatch(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}", s))
    return _iban(s)


def spans(field: Field, texts: list[bytes | None]) -> list[list[tuple[str, int, int, bool]]]:
    """(kind, start, end, whether it is a base span) of each text, by kind as in KINDS, then start."""
    tags, lengths = field.decode(texts)
    out, at = [], 0
    for t, n in zip(texts, lengths.tolist(), strict=True):
        text = decoded(t)
        base = base_spans(text)
        found = [(k, a, b, True) for a, b, k in base]
        starts = sorted((a, b) for a, b, _ in base)
        reach = list(accumulate((b for _, b in starts), max))  # the farthest end of the base spans up to each
        mine, at = tags[at : at + n], at + n
        if mine.any():
            tokens = list(_WORD.finditer(text))
            cuts = np.r_[np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]]), n].tolist()
            for a, b in zip(cuts, cuts[1:]):
                kind = TAGS[mine[a]]
                if kind == "O":
                    continue
                lo, hi = tokens[a].start(), tokens[b - 1].end()
                piece = text[lo:hi]
                lo += len(piece) - len(piece.lstrip(".,;:!?*#%&$|\"'<>"))
                hi = lo + len(text[lo:hi].rstrip(".,;:!?*#%&$|\"'<>"))
                before = bisect_left(starts, (hi, 0))  # base spans that begin before hi
                if (not before or reach[before - 1] <= lo) and _valid(kind, text[lo:hi]):
                    found.append((kind, lo, hi, False))
        out.append(sorted(found, key=lambda s: (KINDS.index(s[0]), s[1])))
    return out


_SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))


def find_pii(docs: DataFrame, *, keep: list[str], text: str = "text", labelled: tuple[str, ...] = LABELLED) -> DataFrame:
    """Columns `keep` and pii array<struct<kind,start,end,base>> (code points, end exclusive; by kind as in KINDS, then start).

    Null and empty texts have none. A byte that is not UTF-8 counts as one code
    point, U+FFFD. One output row for each row; `keep` must not name pii.
    """
    field = docs.sparkSession.sparkContext.broadcast(Field(labelled))

    def begin():
        return lambda texts: [spans(field.value, texts)]

    return map_text(docs, text, keep, [T.StructField("pii", _SPAN)], begin)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"), keep=["doc_id"])
    text = lambda s: F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"]))
    base = F.filter("pii", lambda s: s["base"])
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, BASE), sha_of(text(base)).alias("base_sha256"), F.array_join(text(F.col("pii")), ",").alias("spans"))
