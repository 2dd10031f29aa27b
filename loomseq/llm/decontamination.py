"""Operator 7, benchmark decontamination by winnowing.

Both sides keep the smallest k-gram hash of each run of w = window - k + 1
consecutive k-grams. Two texts that share `window` words share that choice, so
joining the chosen fingerprints misses no shared span of `window` words. Each
fingerprint hit is then extended to both sides: every window that holds it is
looked up among the items' distinct windows and compared word by word, and
windows that follow each other are one span, so the result is exact. A text
that repeats itself costs what any text of its length does, as equal windows
of the items are one. An item shorter than the window has no full run: its one
window, the whole item, is found by the hash of as many words.

The documents' side is a map without a shuffle. The benchmark goes to the
tasks in blocks whose size is checked (BLOCK_BYTES); each further block is one
more map over the documents, so a benchmark of any size works.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomseq.llm.common import map_text, mix64, sha_of, table

WINDOW, K = 10, 5
BLOCK_BYTES = 16 << 20
#: A-Z lower-cased; bytes of words stay (0-9, a-z, and all of 0x80 on), the rest are spaces.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_P = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORDS).split() if text else []


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words that begin at each position."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        g = h[:n].copy()
        for j in range(1, k):
            g *= _P
            g += h[j : j + n]
    return mix64(g)


def _chosen(g: np.ndarray, w: int) -> np.ndarray:
    """Positions whose hash is the smallest of some w consecutive ones."""
    n = len(g) - w + 1
    if n <= 0:
        return np.arange(len(g))
    m = g[:n].copy()
    for j in range(1, w):
        np.minimum(m, g[j : j + n], out=m)
    keep = np.zeros(len(g), bool)
    for j in range(w):
        keep[j : j + n] |= g[j : j + n] == m
    return np.flatnonzero(keep)


class Windows:
    """The distinct windows of `size` words in the items, and which items hold each."""

    def __init__(self, ids: np.ndarray, h: np.ndarray, at: np.ndarray, owner: np.ndarray, size: int):
        """at: where windows begin in ids."""
        g = _grams(h, size)[at]
        self.size, self.ids = size, ids
        words = ids[at[:, None] + np.arange(size)] if len(at) else np.zeros((0, size), np.int64)
        o = np.lexsort((*words.T[::-1], g))
        g, at, words = g[o], at[o], words[o]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (words[1:] != words[:-1]).any(1)
        self.hash, self.at = g[new], at[new]
        group = np.cumsum(new) - 1
        pairs = np.unique(np.stack([group, owner[at]]), axis=1) if len(at) else np.zeros((2, 0), np.int64)
        # Windows of the same items share a set of them.
        cuts = np.flatnonzero(np.r_[True, pairs[0, 1:] != pairs[0, :-1]]) if len(at) else np.zeros(0, np.int64)
        seen: dict[bytes, int] = {}
        self.sets: list[np.ndarray] = []
        self.set_of = np.zeros(len(self.at), np.int64)
        for n, held in enumerate(np.split(pairs[1], cuts[1:]) if len(at) else []):
            key = held.tobytes()
            if key not in seen:
                seen[key] = len(self.sets)
                self.sets.append(held)
            self.set_of[n] = seen[key]

    def find(self, ids: np.ndarray, g: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the windows that begin at `at` (g: their hashes): where one of the items begins, and the set of its items."""
        lo, hi = np.searchsorted(self.hash, g, "left"), np.searchsorted(self.hash, g, "right")
        out, live, n = [], np.flatnonzero(hi > lo), lo
        while len(live):  # more than one round only for windows whose 64-bit hashes collide
            where = self.at[n[live]]
            same = np.ones(len(live), bool)
            for j in range(self.size):
                same &= ids[at[live] + j] == self.ids[where + j]
            out.append((at[live[same]], self.set_of[n[live[same]]]))
            n = n + 1
            live = live[~same & (n[live] < hi[live])]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2  # type: ignore[return-value]


class Index:
    """Fingerprints of one block of benchmark items: (item id, text as bytes)."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW, k: int = K):
        k = min(k, window)
        self.window, self.k, self.w = window, k, window - k + 1
        self.vocab: dict[bytes, int] = {}
        ids, owner, self.names = [], [], []
        short: dict[int, list[int]] = {}
        for name, text in items:
            words = words_of(text)
            if not words:
                continue
            if len(words) < window:
                short.setdefault(len(words), []).append(len(ids))
            ids += [self.vocab.setdefault(x, len(self.vocab) + 1) for x in words]
            owner += [len(self.names)] * len(words)
            ids.append(-1)  # ends an item; equals no word of a document
            owner.append(-1)
            self.names.append(name)
        self.ids, owner = np.array(ids, np.int64), np.array(owner, np.int64)
        self.hash = mix64(np.arange(len(self.vocab) + 1, dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D))
        h = self.hash[self.ids]  # -1 takes the last word's hash; those grams go out below
        g = _grams(h, k)
        self.prints = np.unique(g[self._whole(_chosen(g, self.w), k)])
        self.long = Windows(self.ids, h, self._whole(np.arange(max(0, len(h) - window + 1)), window), owner, window)
        self.short = [Windows(self.ids, h, np.array(v), owner, m) for m, v in short.items()]

    def _whole(self, at: np.ndarray, k: int) -> np.ndarray:
        end = np.r_[0, np.cumsum(self.ids == -1)]
        return at[end[at + k] == end[at]] if len(at) else at

    def hits(self, ids: np.ndarray) -> list[tuple[Windows, np.ndarray, np.ndarray]]:
        """Windows hit, by length: their first words (in the concatenated documents) and the sets of items that hold them. ids: 0 is a word of no item or an end."""
        seen = np.r_[0, np.cumsum(ids > 0)]
        h = self.hash[ids]
        out = []
        g = _grams(h, self.k)
        whole = np.flatnonzero(seen[self.window :] - seen[: -self.window] == self.window) if len(ids) >= self.window else np.zeros(0, np.int64)
        if len(whole) and len(self.prints):
            at = _chosen(g, self.w)
            at = at[seen[at + self.k] - seen[at] == self.k]
            at = at[self.prints[np.minimum(np.searchsorted(self.prints, g[at]), len(self.prints) - 1)] == g[at]]
            near = np.zeros(len(ids) + self.w, bool)  # windows that hold a fingerprint of the items
            for j in range(self.w):
                near[at + self.w - 1 - j] = True
            at = whole[near[whole + self.w - 1]]
            out.append((self.long, *self.long.find(ids, _grams(h, self.window)[at], at)))
        for short in self.short:
            m = short.size
            at = np.flatnonzero(seen[m:] - seen[:-m] == m) if len(ids) >= m else np.zeros(0, np.int64)
            out.append((short, *short.find(ids, _grams(h, m)[at], at)))
        return out

    def scan(self, texts: list[bytes | None]) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]]]:
        """Of each text: its number of words, the spans hit (first word, end), the names of the items that hit."""
        get, n_words, parts = self.vocab.get, [], []
        for t in texts:
            words = words_of(t)
            n_words.append(len(words))
            parts.append(np.fromiter((get(x, 0) for x in words), np.int64, len(words)))
            parts.append(np.zeros(1, np.int64))
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        names: list[list[str]] = [[] for _ in texts]
        if parts:
            start = np.cumsum(np.array(n_words) + 1) - np.array(n_words) - 1
            found: list[set[int]] = [set() for _ in texts]
            covered: list[tuple[np.ndarray, int]] = []
            for windows, first, which in self.hits(np.concatenate(parts)):
                covered.append((first, windows.size))
                doc = np.searchsorted(start, first, "right") - 1
                for d, s in np.unique(np.stack([doc, which]), axis=1).T.tolist() if len(first) else []:
                    found[d].update(windows.sets[s].tolist())
            names = [sorted({self.names[i] for i in x}) for x in found]
            step = np.zeros(sum(n_words) + len(texts) + 1, np.int64)
            for first, size in covered:
                np.add.at(step, first, 1)
                np.add.at(step, first + size, -1)
            inside = np.cumsum(step) > 0
            edge = np.flatnonzero(np.diff(np.r_[False, inside].astype(np.int8)))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                d = int(np.searchsorted(start, a, "right") - 1)
                spans[d].append((a - int(start[d]), b - int(start[d])))
        return n_words, spans, names


def _blocks(items: DataFrame, item_id: str, text: str, most: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of at most `most` bytes (an item longer than that is a block alone)."""
    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("i"), F.col(text).cast("string").alias("t")).where(F.length("t") > 0)
    size = F.octet_length("t") + 64
    total = rows.agg(F.coalesce(F.sum(size), F.lit(0)), F.count("*")).first()
    n = max(1, -(-total[0] // most))
    while n > 1:
        part = F.pmod(F.xxhash64("i", "t"), F.lit(n))
        if rows.groupBy(part.alias("b")).agg(F.sum(size).alias("s"), F.count("*").alias("n")).where((F.col("s") > most) & (F.col("n") > 1)).isEmpty() or n > 4 * total[1]:
            break
        n *= 2
    for b in range(n):
        of = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)
        yield [(r[0], r[1].encode()) for r in of.orderBy("i", "t").collect()]


def decontaminate(docs: DataFrame, items: DataFrame, *, keep: list[str], text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Columns `keep` of docs, then n_words long, hit_spans array<struct<first,end>> (words, end exclusive, disjoint, ascending) and hit_items array<string> (distinct).

    Null and empty texts have no words and no hits. Repeated documents are
    judged each; items with the same id count as one; a null item id is called
    "null". Without items, nothing is hit. docs may hold any further columns;
    `keep` must not name n_words, hit_spans or hit_items.
    """
    spark = docs.sparkSession
    fields = [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("hit_items", T.ArrayType(T.StringType())),
    ]
    out = None
    for i, block in enumerate(_blocks(items, item_id, item_text, block_bytes)):
        sent = spark.sparkContext.broadcast(Index(block, window, k))

        def begin(sent=sent):
            index = sent.value
            return lambda texts: [[*x] for x in index.scan(texts)]

        if out is None:
            more = [] if text in keep else [text]
            out = map_text(docs, text, [*keep, *more], fields, begin)
            continue
        was = [f"__{f.name}" for f in fields]
        out = map_text(out.withColumnsRenamed(dict(zip((f.name for f in fields), was, strict=True))), text, [*keep, *more, *was], fields, begin)
        out = out.withColumns({"hit_spans": _union(F.concat("__hit_spans", "hit_spans")), "hit_items": F.concat("__hit_items", "hit_items")}).drop(*was)
    return out.withColumn("hit_items", F.array_distinct("hit_items")).select(*keep, *(f.name for f in fields))


def _union(spans):
    """Overlapping or touching spans made one."""
    empty = F.expr("cast(array() as array<struct<first:bigint,end:bigint>>)")
    return F.aggregate(
        F.array_sort(spans),
        empty,
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["first"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["first"].alias("first"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["first"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), sha_of(F.array_sort("hit_items")).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


#: Every window of the items against every word position, by definition.
ORACLE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
il AS (SELECT item_id, w, least(len(w), 10) AS m FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS s FROM (SELECT *, unnest(generate_series(1, len(w) - m + 1)) AS i FROM il)),
lens AS (SELECT DISTINCT m FROM win),
dpos AS (SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS s FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM dw, lens WHERE len(w) >= m)),
hit AS (SELECT d.doc_id, d.i, d.m, win.item_id FROM dpos d JOIN win ON d.m = win.m AND d.s = win.s),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, coalesce(len(dw.w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
