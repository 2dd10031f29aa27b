"""Operator 1, toxicity by weak supervision.

Voters: lexicon units (whole words and word beginnings that the labelled rows
set apart), a few patterns, and the label itself. A generative label model
estimates by expectation-maximization, for either class, how often each voter
fires and how voters depend on each other: within a class, a voter's chance
depends on whether the voter fires that it is most correlated with (a tree over
all voters, of the largest mutual information given the class). A voter that
only repeats another therefore adds nothing. The model's posteriors are the
labels of a linear classifier over the voters' counts, which scores every
document.

Only the labelled sample (LABELLED rows at most, the first by a hash of the id
among texts up to LONGEST bytes: 320 MB at most) is fitted on the driver; the
scoring is one map over all documents and whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomseq.llm.common import fold, map_text, slices, table
from loomseq.sources.shared import cut

#: Bounds, all parameters of learn(): labelled rows fitted, the longest text among them (bytes), lexicon units tried and taken, and the least number of labelled documents that hold a unit.
LABELLED, LONGEST, TRIED, UNITS, SUPPORT = 20_000, 1 << 14, 50_000, 512, 4
STEMS = (4, 5, 6)
#: Patterns that vote beside the lexicon: address in the second person, shouting, masked words.
PATTERNS = (
    rb"\b(you|du|ihr|tu|vous|t\xc3\xba|usted) (are|bist|seid|es|\xc3\xaates|eres)\b",
    rb"[A-Z]{4,}[^a-z]*!",
    rb"!{2,}",
    rb"\b[a-z]\*{2,}[a-z]*",
    rb"\b(hate|kill|shut up|hasse|d\xc3\xa9teste|odio)\b",
)
_PATTERNS = [re.compile(p) for p in PATTERNS]
_RUN, _CAPITALS = re.compile(rb"(?<![^a-z])[^a-z!]*+![^a-z]*+"), re.compile(rb"[A-Z]{4}")  # a whole run without small letters that holds a mark, from its beginning on
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_LETTERS).split() if text else []


def _shouts(text: bytes) -> int:
    """Matches of the second pattern: such a match ends at the last mark of a run without small letters, so a run has one if four capitals stand before that mark. Linear, as each run is read once."""
    return sum(1 for m in _RUN.finditer(text) if _CAPITALS.search(text, m.start(), text.rfind(b"!", m.start(), m.end())))


def _units(word: bytes) -> set[bytes]:
    """A word and its beginnings; a beginning ends in *."""
    return {word, *(word[:n] + b"*" for n in STEMS if len(word) >= n)}


def _unit_counts(sample: DataFrame) -> DataFrame:
    """unit, toxic, docs: in how many sample documents of each label a unit occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                held: Counter = Counter()
                for y, t in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    held.update({(u, y) for w in set(words_of(t)) for u in _units(w)})
                yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in held], pa.binary()), pa.array([y for _, y in held], pa.int32()), pa.array(list(held.values()), pa.int64())], names=["unit", "toxic", "docs"])

    return sample.select("toxic", "text").mapInArrow(run, "unit binary, toxic int, docs long")


def _cover(texts: list[bytes | None], odds: dict[bytes, float], most: int) -> list[bytes]:
    """Units that explain the toxic texts, the best first.

    A text counts half after each unit chosen that it holds, so that a large
    group of copies, all of whose words look telling, yields few units.
    """
    where: dict[bytes, list[int]] = {}
    for d, t in enumerate(texts):
        for u in {u for w in set(words_of(t)) for u in _units(w)} & odds.keys():
            where.setdefault(u, []).append(d)
    names = sorted(where)
    docs = [np.array(where[u]) for u in names]
    weight, chosen = np.ones(len(texts)), []
    gain = np.array([len(d) * odds[u] for u, d in zip(names, docs, strict=True)])
    while len(chosen) < most and len(gain):
        i = int(gain.argmax())
        fresh = weight[docs[i]].sum() * odds[names[i]]  # gains only fall, so a stale best is renewed until one stays
        if fresh < gain[i] - 1e-9:
            gain[i] = fresh
            continue
        if fresh < 2:
            break
        chosen.append(names[i])
        weight[docs[i]] /= 2
        gain[i] = -1
    return chosen


class Votes:
    """Counts of every voter in a text: lexicon units, then patterns."""

    def __init__(self, units: list[bytes]):
        self.units = units
        self.place = {u: i for i, u in enumerate(units)}
        self.first = {u[: STEMS[0]].rstrip(b"*") for u in units}
        self.n = len(units) + len(PATTERNS)

    def count(self, text: bytes | None) -> tuple[dict[int, int], int]:
        """(voter: how often, number of words)."""
        words, found = words_of(text), {}
        first, place = self.first, self.place
        for w in words:
            if w[:4] in first:  # few words pass
                for u in _units(w):
                    if (i := place.get(u)) is not None:
                        found[i] = found.get(i, 0) + 1
        for j, p in enumerate(_PATTERNS, len(self.units)):
            if text and (n := _shouts(text) if p is _PATTERNS[1] else sum(1 for _ in p.finditer(text))):
                found[j] = n
        return found, len(words)

    def features(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Votes (0 or 1) and classifier inputs, a row for each text."""
        x = np.zeros((len(texts), self.n + 3), np.float32)
        lexicon = len(self.units)
        for row, t in enumerate(texts):
            found, n = self.count(t)
            for i, c in found.items():
                x[row, i] = c
            hits = sum(1 for i in found if i < lexicon)
            total = sum(c for i, c in found.items() if i < lexicon)
            x[row, -3:] = hits > 0, np.log1p(total), np.log1p(1000 * total / max(1, n))
        votes = (x[:, : self.n] > 0).astype(np.float32)
        x[:, : self.n] = np.log1p(x[:, : self.n])
        return votes, x


class LabelModel:
    """Generative model of binary votes given the class: a tree of voters, each depending on its parent and the class.

    hit and false: how often a voter fires in the toxic and the other class;
    parent: the voter it depends on (-1 at the root); given[c, a, i]: how often
    voter i fires in class c when its parent does (a = 1) or does not. trust: how
    often the label agrees with the class, estimated too.
    """

    def __init__(self, votes: np.ndarray, labels: np.ndarray, steps: int = 40, trust: float = 0.95):
        self.trust, self.parent = trust, np.full(votes.shape[1], -1)
        post = np.where(labels == 1, trust, 1 - trust)
        for step in range(steps):
            on, off = post.sum(), (1 - post).sum()
            self.prior = float(np.clip(on / max(1.0, on + off), 1e-3, 1 - 1e-3))
            agree = post[labels == 1].sum() + (1 - post)[labels != 1].sum()
            self.trust = float(np.clip((agree + 9.5) / (len(votes) + 10), 0.6, 0.99))
            if step in (0, 3):  # the tree follows the first posteriors, then its numbers go on alone
                self.parent = self._tree(self._gain(votes, post))
            self._fit(votes, post)
            post = self._posterior(votes, labels)
        self.posterior = post

    def _gain(self, votes: np.ndarray, post: np.ndarray) -> np.ndarray:
        """Mutual information of each pair of voters given the class, over the four outcomes."""
        gain = np.zeros((votes.shape[1],) * 2)
        for p in (1 - post, post):
            mass, one = p.sum() + 1, p @ votes + 0.1
            both = votes.T @ (votes * p[:, None]) + 0.02
            np.fill_diagonal(both, one)
            edge = (one / mass, 1 - one / mass)
            for k, c in enumerate((both, one[:, None] - both, one[None] - both, mass - one[:, None] - one[None] + both)):
                q = np.maximum(c, 1e-9) / mass
                gain += mass * q * np.log(q / np.maximum(edge[k >> 1][:, None] * edge[k & 1][None], 1e-12))
        np.fill_diagonal(gain, -np.inf)
        return gain

    def _fit(self, votes: np.ndarray, post: np.ndarray) -> None:
        up = np.where(self.parent < 0, 0, votes[:, np.maximum(self.parent, 0)])
        rate, given = [], []
        for p in (1 - post, post):
            mass, one, parents, both = p.sum() + 1, p @ votes + 0.1, p @ up + 0.1, p @ (votes * up) + 0.02
            rate.append(one / mass)
            quiet = np.where(self.parent < 0, one / mass, (one - both) / np.maximum(mass - parents, 1e-9))
            given.append(np.stack([quiet, np.where(self.parent < 0, one / mass, both / parents)]))
        self.false, self.hit = rate
        self.given = np.stack(given).clip(1e-4, 1 - 1e-4)

    @staticmethod
    def _tree(gain: np.ndarray) -> np.ndarray:
        """Parents in the spanning tree of the largest total gain."""
        n = len(gain)
        parent, best, near = np.full(n, -1), np.full(n, -np.inf), np.full(n, -1)
        left, at = np.ones(n, bool), 0
        for _ in range(n):
            left[at] = False
            parent[at] = near[at]
            closer = left & (gain[at] > best)
            best[closer], near[closer] = gain[at][closer], at
            if not left.any():
                break
            at = int(np.where(left, best, -np.inf).argmax())
        return parent

    def _posterior(self, votes: np.ndarray, labels: np.ndarray) -> np.ndarray:
        s = np.log(self.prior / (1 - self.prior)) + np.where(labels == 1, 1, -1) * np.log(self.trust / (1 - self.trust))
        up = np.where(self.parent < 0, 0, votes[:, np.maximum(self.parent, 0)])
        for a in (0, 1):
            p0, p1 = self.given[0, a], self.given[1, a]
            fire, quiet = np.log(p1 / p0), np.log((1 - p1) / (1 - p0))
            mine = up if a else 1 - up
            s = s + (mine * votes) @ fire + (mine * (1 - votes)) @ quiet
        return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


class Scorer:
    """The linear classifier over the voters' counts."""

    def __init__(self, units: list[bytes], texts: list[bytes | None], labels: np.ndarray, steps: int = 300, l2: float = 1e-3):
        self.voters = Votes(units)
        self.w, self.b = np.zeros(self.voters.n + 3), 0.0
        if not len(texts):
            return
        votes, x = self.voters.features(texts)
        self.model = LabelModel(votes.astype(np.float64), labels)
        y = self.model.posterior
        if y.max() - y.min() < 1e-9:
            self.b = float(np.log(np.clip(y.mean(), 1e-3, 1 - 1e-3) / (1 - np.clip(y.mean(), 1e-3, 1 - 1e-3))))
            return
        x = x.astype(np.float64)
        heavy = np.where(y > 0.5, 0.5 / max((y > 0.5).mean(), 1e-6), 0.5 / max((y <= 0.5).mean(), 1e-6))  # both classes weigh the same
        heavy /= heavy.mean()
        g2w, g2b = np.full_like(self.w, 1e-8), 1e-8
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ self.w + self.b, -30, 30)))
            e = (y - p) * heavy
            gw, gb = x.T @ e / len(y) - l2 * self.w, e.mean()
            g2w, g2b = g2w + gw * gw, g2b + gb * gb
            self.w += 0.5 * gw / np.sqrt(g2w)
            self.w[: self.voters.n] = np.maximum(self.w[: self.voters.n], 0)  # voters vote for toxicity or not at all
            self.b += 0.5 * gb / np.sqrt(g2b)
        del self.model, votes, x

    def score(self, texts: list[bytes | None]) -> list[np.ndarray]:
        _, x = self.voters.features(texts)
        s = 1 / (1 + np.exp(-np.clip(x @ self.w + self.b, -30, 30)))
        return [s, (s >= 0.5).astype(np.int32)]


def learn(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = LABELLED, longest: int = LONGEST, tried: int = TRIED, units: int = UNITS, support: int = SUPPORT) -> Scorer:
    """Fit on at most `most` labelled rows of texts up to `longest` bytes (lowest hash of the id first).

    Labels other than 0 and 1 and null ids are passed over; an id labelled more
    than once counts as toxic if any label says so, a document more than once by its
    smallest text. Without labelled rows, the
    scorer gives 0.5 to all.
    """
    marked = labels.where(F.col(label).isin(0, 1) & F.col(id).isNotNull()).groupBy(F.col(id).alias("__id")).agg(F.max(label).cast("int").alias("toxic"))
    fitted = docs.select(F.col(id).alias("__id"), F.col(text).cast("string").alias("text")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= longest)
    few = fitted.select("__id").join(marked, "__id").distinct().orderBy(F.xxhash64("__id"), "__id").limit(most)  # bounded by `most`: small enough to send to every task
    sample = cut(fitted.join(F.broadcast(few), "__id").groupBy("__id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")), "labelled")
    n = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    if not n:
        return Scorer([], [], np.zeros(0))
    counts = _unit_counts(sample).groupBy("unit").agg(F.sum(F.when(F.col("toxic") == 1, F.col("docs")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("docs")).otherwise(0)).alias("b"))
    pos, neg = n.get(1, 0) + 1, n.get(0, 0) + 1
    odds = F.log((F.col("a") + 0.5) / pos) - F.log((F.col("b") + 0.5) / neg)
    spread = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    best = counts.where(F.col("a") + F.col("b") >= support).withColumns({"odds": odds, "z": odds / spread}).where("z > 2 AND odds > 2").orderBy(F.desc("z"), "unit").limit(tried)
    rows = sample.orderBy("__id").toPandas()
    texts = [None if t is None else t.encode() for t in rows.text]
    toxic = [t for t, y in zip(texts, rows.toxic, strict=True) if y == 1]
    return Scorer(_cover(toxic, {bytes(r.unit): r.odds for r in best.select("unit", "odds").collect()}, units), texts, rows.toxic.to_numpy())


def score_toxicity(docs: DataFrame, scorer: Scorer, *, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep`, then score (0 to 1) and predicted (1 if score >= 0.5, else 0).

    Null and empty texts have no votes and get the score of such. One output row
    for each row; `keep` must not name the new columns.
    """
    sent = docs.sparkSession.sparkContext.broadcast(scorer)
    return map_text(docs, text, keep, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], lambda: sent.value.score)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scorer = learn(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    return score_toxicity(docs.withColumn("held_out", fold(F.col("doc_id"), 5) == 0), scorer, keep=["doc_id", "held_out"])
