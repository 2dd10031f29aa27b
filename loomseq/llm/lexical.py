"""Operator 13, ranked lexical search by NRA over impact-sorted lists.

One pass over the texts keeps, of each document, the counts of those terms that
the items ask for; the numbers of documents and terms and the documents that
hold a term are sums over all of it. Then every task turns its documents, SHARD
at a time, into lists sorted by impact, and answers all items on them without
random access: each round reads on in every list, a document's lower bound is
what was read of it, its upper bound adds the next unread impact of every list
that it was not read in. Documents whose upper bound falls below the k-th lower
bound go; reading ends when no unread document can reach it and all that are
left are exact, so membership, ties and scores are whole. A task's k-th score is
where its next shard starts, and about SHARD documents, drawn by hash and
searched first, give all tasks a start. Only the best k of a task and item are shuffled.

Items go out in blocks of ITEM_BYTES of text, one pass each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomseq.llm.common import map_text, table
from loomseq.sources.shared import cut

K, SHARD, DEPTH, ITEM_BYTES = 10, 8192, 64, 8 << 20
#: Bytes of a term: digits, letters and all beyond ASCII; A-Z become a-z, all else a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_PIECE = 1 << 20


def terms(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text, in pieces, so that a very long text is not one list."""
    if not text:
        return
    folded, at = text.translate(_FOLD), 0
    while at < len(folded):
        to = at + _PIECE
        if to < len(folded):
            to = folded.find(b" ", to)
            to = len(folded) if to < 0 else to
        yield folded[at:to].split()
        at = to


def weight(n_docs: int, df: int) -> int:
    return int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))))


class Shard:
    """Documents as one impact-sorted list for each term."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, size: int, n_terms: int):
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact, self.size = doc[order], impact[order], size
        self.start = np.searchsorted(term[order], np.arange(n_terms + 1))

    def best(self, wanted: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and exact scores of all documents that may be among the k best with a score of `floor` or more (ties at the k-th all stay)."""
        lists = [(int(self.start[t]), int(self.start[t + 1])) for t in wanted]
        lists = [(a, b) for a, b in lists if a < b]
        n = len(lists)
        at, end = (np.array([x[i] for x in lists], np.int64) for i in range(2)) if n else (np.zeros(0, np.int64),) * 2
        high = self.impact[at] if n else np.zeros(0, np.int64)  # the next unread impact of each list
        floor = max(floor, 1)
        if not n or high.sum() < floor:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lower = np.zeros(self.size, np.int64)
        read = np.zeros((n, self.size), bool)
        alive, closed, depth = None, False, DEPTH
        while True:
            for i in range(n):
                to = min(int(end[i]), int(at[i]) + depth)
                if at[i] < to:
                    docs = self.doc[at[i] : to]
                    lower[docs] += self.impact[at[i] : to]
                    read[i, docs] = True
                    at[i] = to
                high[i] = self.impact[to] if to < end[i] else 0
            depth *= 4
            rest = int(high.sum())  # the most that a document not read yet can score
            seen = np.flatnonzero(lower) if alive is None else alive
            if len(seen) >= k:
                floor = max(floor, int(np.partition(lower[seen], len(seen) - k)[len(seen) - k]))
            closed = closed or rest < floor
            upper = lower[seen] + rest - high @ read[:, seen]
            seen = seen[upper >= floor]
            if closed:
                alive = seen
            if rest == 0 or (closed and not (high @ ~read[:, seen]).any()):
                seen = seen[lower[seen] >= floor]
                return seen, lower[seen]


def _search(batches: Iterator[pa.RecordBatch], model, k: int, shard: int) -> Iterator[pa.RecordBatch]:
    """Batches of (doc_id, length, terms, counts): the best documents of each item over all of them."""
    items, weights, n_docs, length, floors = model
    floors = floors.copy()
    best: list[tuple[list, list]] = [([], []) for _ in items]
    held: list[pa.RecordBatch] = []

    def answer():
        ids = pa.concat_arrays([b.column(0) for b in held]).to_pylist()
        sizes = np.concatenate([b.column(1).to_numpy() for b in held])
        m = np.array([10 + 90 * int(n) * n_docs // length for n in sizes], np.int64)
        term = np.concatenate([b.column(2).flatten().to_numpy() for b in held])
        tf = np.concatenate([b.column(3).flatten().to_numpy() for b in held])
        doc = np.repeat(np.arange(len(ids)), np.concatenate([np.diff(b.column(2).offsets.to_numpy()) for b in held]))
        s = Shard(doc, term, weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc])), len(ids), len(weights))
        for i, wanted in enumerate(items):
            rows, scores = s.best(wanted, k, int(floors[i]))
            if len(rows):
                have = sorted(zip(best[i][0] + [-x for x in scores.tolist()], best[i][1] + [(ids[r] is None, ids[r]) for r in rows.tolist()], strict=True), key=lambda x: (x[0], x[1][0], x[1][1] or 0))[:k]
                best[i] = ([h[0] for h in have], [h[1] for h in have])
                if len(have) == k:
                    floors[i] = max(floors[i], -have[-1][0])

    rows = 0
    for b in batches:
        for at in range(0, b.num_rows, shard):
            part = b.slice(at, shard)
            if rows + part.num_rows > shard and held:
                answer()
                held, rows = [], 0
            held.append(part)
            rows += part.num_rows
    if held:
        answer()
    out = [(i, d[1], -s) for i, (scores, docs) in enumerate(best) for s, d in zip(scores, docs, strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array([o[f] for o in out], t) for f, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["item", "doc_id", "score"])


_FOUND = "item int, doc_id long, score long"


def _block(docs: DataFrame, texts: list[bytes], k: int, shard: int, id: str, text: str) -> DataFrame:
    """Columns item (place in texts), doc_id, score and rank."""
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    items = [np.array(sorted({vocabulary.setdefault(w, len(vocabulary)) for part in terms(t) for w in part}), np.int64) for t in texts]
    known = spark.sparkContext.broadcast(vocabulary)

    def begin():
        words = known.value

        def run(found: list[bytes | None]):
            size, term, count = [], [], []
            for t in found:
                n, c = 0, Counter()
                for part in terms(t):
                    n += len(part)
                    c.update(part)
                hits = sorted((words[w], c[w]) for w in words.keys() & c.keys())
                size.append(n)
                term.append([h[0] for h in hits])
                count.append([h[1] for h in hits])
            return size, term, count

        return run

    fields = [T.StructField("n", T.LongType()), T.StructField("term", T.ArrayType(T.LongType())), T.StructField("tf", T.ArrayType(T.LongType()))]
    named = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    counts = cut(map_text(named, "text", ["doc_id"], fields, begin), "counts")
    n_docs, length = counts.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in counts.select(F.explode("term").alias("t")).groupBy("t").count().collect():  # a row for each term of the items
        df[r.t] = r["count"]
    weights = np.array([weight(n_docs, int(d)) for d in df], np.int64)
    held = counts.where(F.size("term") > 0)
    start = spark.sparkContext.broadcast((items, weights, n_docs, length, np.zeros(len(items), np.int64)))
    ranked = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))

    def best(docs: DataFrame, model) -> DataFrame:
        found = docs.mapInArrow(lambda b: _search(b, model.value, k, shard), _FOUND)
        return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)

    some = held.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(max(1, n_docs // shard))) == 0)
    floors = np.zeros(len(items), np.int64)
    for r in best(some, start).where(F.col("rank") == k).collect():  # a row for each item
        floors[r["item"]] = r.score
    return best(held, spark.sparkContext.broadcast((items, weights, n_docs, length, floors)))


def ranked_search(docs: DataFrame, items: DataFrame, *, k: int = K, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", shard: int = SHARD, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k documents of the highest score above 0, ties by the smaller doc_id (a null one last).

    A null or empty text has no term: such an item has no rows, such a document
    none either and does not count. Repeated documents are documents each;
    repeated items count once, one id with different texts is ranked for each.
    Empty tables give an empty result.
    """
    spark = docs.sparkSession
    kind = items.schema[item_id].dataType
    schema = T.StructType([T.StructField("item_id", kind), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where(F.col("text").isNotNull()).distinct().orderBy("item_id", "text")
    out, texts, ids, size = spark.createDataFrame([], schema), [], [], 0

    def flush():
        names = spark.createDataFrame(list(enumerate(ids)), T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", kind)]))
        return out.union(_block(docs, texts, k, shard, id, text).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))

    for r in asked.toLocalIterator():
        t = r.text.encode("utf-8", "replace")
        if texts and size + len(t) > item_bytes:
            out, texts, ids, size = flush(), [], [], 0
        texts.append(t)
        ids.append(r.item_id)
        size += len(t)
    return flush() if texts else out


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS t FROM documents),
s AS (SELECT r, doc_id, len(t) AS n FROM d WHERE len(t) > 0),
g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM s),
i AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark)),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, g GROUP BY term, docs),
p AS (SELECT tf.r, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * s.n * docs) // total)))) AS impact FROM tf JOIN w USING (term) JOIN s USING (r), g),
z AS (SELECT item_id, s.doc_id, sum(impact)::BIGINT AS score FROM i JOIN p USING (term) JOIN s USING (r) GROUP BY item_id, p.r, s.doc_id),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS n, doc_id, score FROM z WHERE score > 0)
SELECT item_id, n::INTEGER AS rank, doc_id, score FROM k WHERE n <= 10
"""
