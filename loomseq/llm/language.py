"""Operator 4, language identification of mixed-language text.

Learning counts hashed byte trigrams of lower-cased words, and words by script,
for each language over all training rows. A word's script (ranges of code
points) narrows the candidates to languages that use it; each candidate scores
the word by its trigrams' log probabilities. Viterbi with a penalty for
switching then labels every word, so a passage in another language becomes a
span of its own. The document's language is the one that holds most letters,
and its score is their share of all letters; words in a script that no learned
language uses count for no language.

The model is at most SLOTS + scripts numbers for each language, of LANGUAGES
languages at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomseq.llm.common import fold, map_text, slices, table, viterbi
from loomseq.sources.shared import cut

SLOTS, SWITCH, ALPHA, SHARE = 1 << 16, 12.0, 0.05, 0.01
#: Languages that a model may have; more are refused. Word scores (words x languages) that a task holds at once, beyond a single text.
LANGUAGES, SCORES = 1024, 1 << 24
#: Letters of a script: first code point of each range, in order; a range ends where the next begins.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Indic"),
    (0x0E00, "Thai"), (0x0E80, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"),
    (0x2C80, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xA640, "Cyrillic"), (0xA6A0, "Other"), (0xA720, "Latin"), (0xA800, "Other"),
    (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB07, "Other"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFF21, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Other"), (0x20000, "Han"), (0x323B0, "Other"),
)
_STARTS = np.array([s for s, _ in SCRIPTS])
_NAMES = sorted({n for _, n in SCRIPTS})
_SCRIPT_OF = np.array([_NAMES.index(n) for _, n in SCRIPTS])
_LATIN = _NAMES.index("Latin")
#: Lower-cased ASCII letters and all non-ASCII bytes stay; the rest separates words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of letters, lower-cased. Non-ASCII characters that are no letters separate as well."""
    if not text:
        return []
    if not text.isascii():
        low = text.decode("utf-8", "replace").lower()
        odd = {c for c in set(low) if ord(c) > 127 and not c.isalpha()}
        if odd:
            low = low.translate({ord(c): 32 for c in odd})
        text = low.encode()
    return text.translate(_WORDS).split()


class Words:
    """Distinct words of a batch: their scripts and trigram slots."""

    def __init__(self, words: list[bytes]):
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.letters = np.fromiter((len(w) if w.isascii() else len(w.decode("utf-8", "replace")) for w in words), np.int64, len(words))
        flat = np.frombuffer(b" " + b" ".join(words) + b"  ", np.uint8).astype(np.int64)
        self.start = np.cumsum(self.size + 1) - self.size - 1
        gram = flat[:-2] << 16 | flat[1:-1] << 8 | flat[2:]
        self.slot = ((gram * 0x9E3779B1) >> 7) % SLOTS
        self.real = np.ones(len(self.slot), bool)
        self.real[self.start + self.size] = False  # begins at a word's last byte and reaches the next word
        if len(words):
            self.real[int(self.start[-1] + self.size[-1]) :] = False
        first = np.array([ord(w.decode("utf-8", "replace")[0]) if w[0] > 127 else 97 for w in words], np.int64)
        self.script = _SCRIPT_OF[np.searchsorted(_STARTS, first, "right") - 1] if len(words) else np.zeros(0, np.int64)

    def sums(self, per_slot: np.ndarray) -> np.ndarray:
        """Of each word, the sum of its trigrams' rows of per_slot."""
        if not len(self.size):
            return np.zeros((0, per_slot.shape[1]), per_slot.dtype)
        rows = per_slot[self.slot] * self.real[:, None]
        return np.add.reduceat(rows, self.start, axis=0)


def numbered(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Word numbers of all texts one after another, how many each text has, and the words."""
    vocab: dict[bytes, int] = {}
    ids, lengths = [], []
    for t in texts:
        words = words_of(t)
        for w in set(words).difference(vocab):
            vocab[w] = len(vocab)
        ids.append(np.fromiter(map(vocab.__getitem__, words), np.int64, len(words)))
        lengths.append(len(words))
    return (np.concatenate(ids) if ids else np.zeros(0, np.int64)), np.array(lengths, np.int64), list(vocab)


def counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """lang, slot, n: trigram counts (slots below SLOTS) and words by script (SLOTS + script) over all rows with a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def rows():
            for name, c in held.items():
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(c[at])], names=["lang", "slot", "n"])
            held.clear()

        for batch in batches:
            for part in slices(batch):
                names = np.array(part.column(0).to_pylist(), object)
                texts = part.column(1).cast(pa.binary()).to_pylist()
                for name in sorted(set(names)):
                    ids, _, vocab = numbered([texts[i] for i in np.flatnonzero(names == name)])
                    if not vocab:
                        continue
                    w, n = Words(vocab), np.bincount(ids, minlength=len(vocab))
                    per_gram = np.repeat(n, np.diff(np.r_[w.start, len(w.slot)])) * w.real
                    c = held.setdefault(name, np.zeros(SLOTS + len(_NAMES), np.int64))
                    c[:SLOTS] += np.bincount(w.slot, weights=per_gram, minlength=SLOTS).astype(np.int64)
                    c[SLOTS:] += np.bincount(w.script, weights=n, minlength=len(_NAMES)).astype(np.int64)
                if len(held) > 64:
                    yield from rows()
        yield from rows()

    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))


class Model:
    def __init__(self, learned: DataFrame):
        """learned: lang, slot, n; at most SLOTS + scripts rows for each language."""
        self.langs = sorted(r[0] for r in learned.select("lang").distinct().limit(LANGUAGES + 1).collect())
        if len(self.langs) > LANGUAGES:
            raise ValueError(f"more than {LANGUAGES} languages to learn")
        t = learned.toPandas()
        c = np.zeros((SLOTS + len(_NAMES), max(1, len(self.langs))))
        for i, name in enumerate(self.langs):
            of = t[t.lang == name]
            c[of.slot.to_numpy(), i] = of.n.to_numpy()
        grams, scripts = c[:SLOTS] + ALPHA, c[SLOTS:]
        self.log_p = np.log(grams / grams.sum(0)).astype(np.float32)
        uses = scripts / np.maximum(scripts.sum(0), 1) >= SHARE
        self.used = uses.any(1)
        self.shut_out = np.where(uses | ~self.used[:, None], 0, -60).astype(np.float32)  # of a script that no language uses, all stay

    def label(self, texts: list[bytes | None]) -> tuple[list[str], list[float], list[list[tuple[int, int, str]]]]:
        """Of each text: language or und, the share of its letters in it, and its spans (first word, end, language)."""
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
        out: tuple[list, list, list] = ([], [], [])
        group, room = [], SCORES // len(self.langs)
        for t in texts:
            if group and sum(map(len, group)) + len(t or b"") > 4 * room:  # a word has its letters and a space; most have more than three
                self._label(group, out)
                group = []
            group.append(t or b"")
        self._label(group, out)
        return out

    def _label(self, texts: list[bytes], out: tuple[list, list, list]) -> None:
        langs, scores, spans = out
        ids, lengths, vocab = numbered(texts)
        w = Words(vocab)
        per_word = w.sums(self.log_p) + self.shut_out[w.script]
        path = viterbi(per_word[ids], lengths, SWITCH)
        size, fits, at = w.letters[ids], self.used[w.script][ids], 0
        for n in lengths.tolist():
            p = path[at : at + n]
            if not n:
                langs.append("und"), scores.append(0.0), spans.append([])
                continue
            held = np.bincount(p, weights=size[at : at + n] * fits[at : at + n], minlength=len(self.langs))
            best = int(held.argmax() if held.any() else np.bincount(p).argmax())
            langs.append(self.langs[best])
            scores.append(float(held[best] / size[at : at + n].sum()))
            ends = np.r_[np.flatnonzero(np.r_[True, p[1:] != p[:-1]]), n].tolist()
            spans.append([(a, b, self.langs[p[a]]) for a, b in zip(ends, ends[1:])])
            at += n


_FIELDS = [
    T.StructField("lang_pred", T.StringType()),
    T.StructField("lang_score", T.DoubleType()),
    T.StructField("lang_spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())]))),
]


def identify(docs: DataFrame, training: DataFrame, *, keep: list[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """Columns `keep`, then lang_pred, lang_score (share of the letters, 0 to 1) and lang_spans (word numbers, end exclusive).

    Learns from all rows of `training` with a text and a language. A text that is
    null or has no letter is und, score 0, no spans; so is every text if nothing
    was learned. A text wholly in scripts that no learned language uses still gets
    a language, with score 0. Equal languages: the first by name. More than
    LANGUAGES languages are refused. One output row for each row; `keep` must not
    name the new columns.
    """
    model = docs.sparkSession.sparkContext.broadcast(Model(cut(counts(training, text, lang), "grams")))
    return map_text(docs, text, keep, _FIELDS, lambda: model.value.label)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold(F.col("doc_id"), 3) == 1)
    found = identify(docs, docs.where("NOT held_out"), keep=["doc_id", "held_out"])
    spans = F.transform("lang_spans", lambda s: F.concat_ws(":", s["lang"], s["first"], s["end"]))
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.array_join(spans, ",").alias("spans"))
