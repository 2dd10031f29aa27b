"""Operator 10, language-model scores by logistic context mixing.

A text is coded bit by bit in order: the bytes of its words, a space after each
word, and a line feed at the end. Five predictors hash contexts with the bits of
the byte so far into a table of bit counts: the last 1 to 4 bytes, across words,
and the last 5 bytes of the word. Their predictions meet in the logistic domain,
weighted by a set of weights that a gate chooses (how many contexts have been
seen, how often the longest has, and the bit's place); an adaptive map, indexed
by the last byte and the mixed prediction, refines the result. Weights and map
learn online.

A byte's cost depends on its gram alone: the bytes before it that a context
reads, and the byte. From a word's fourth byte on, these lie within the word, so
such costs are a property of the word; the first three bytes of each word, and
the end, are coded from the text's own sequence.

Learning is two steps, both over all training rows:
 1. One pass over the texts counts words and grams, and Spark adds them up. The
    bit table made of them has a slot or more for each distinct gram, so it
    grows with what the corpus holds (up to MOST_BITS, a parameter).
 2. The gram table streams through the mixer in SHARDS fixed parts, each in a
    fixed order, the occurrence itself left out of what predicts it; the parts'
    weights are averaged. Neither depends on how rows are partitioned.
Scoring is one pass: common grams are coded once for all tasks, each other word
and gram that a task meets once by the task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomseq.llm.common import fold, map_text, mix64, slices, table
from loomseq.sources.shared import cut

ORDERS, LONG = 5, 64
#: Slots of the bit table for each distinct gram, and its least and largest size as powers of two.
SPACE, LEAST_BITS, MOST_BITS = 4, 18, 28
#: Words that make up at least 1 / HEAVY of all tokens number at most HEAVY; those of up to LONG bytes go to the tasks with their counts.
HEAVY = 1_000_000
#: Grams that make up at least 1 / COMMON of all grams number at most COMMON; their costs are computed once, by Spark, and go to the tasks.
COMMON = 2_000_000
SHARDS, CACHE, WORDS, TEXTS = 64, 4_000_000, 300_000, 2 << 20
LEVELS = np.array([2, 4, 16, 128], np.float32)  # how often the longest context was seen
GATES, MAPS, STEPS = (ORDERS + 1) * (len(LEVELS) + 1) * 8, 256, 33
RATE, PRIOR = 0.05, 200.0  # step of the weights; occurrences that a cell's first value counts for
END = b"\n"
#: Counts are held as bytes: exact up to 15, beyond in steps of 8 %.
COUNT = np.array([*range(16), *(16 * 2 ** ((q - 16) / 9) for q in range(16, 256))], np.float32)
OWN = 3  # a word's bytes before this one are coded from the sequence


# ---------------------------------------------------------------- grams


def word_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Grams of the words' bytes from place OWN on, a space after each word included (48 bits: five bytes before, of the word only, then the byte), and where each word's begin. END has none."""
    words = [b"" if w == END else w for w in words]
    size = np.fromiter((max(0, len(w) + 1 - OWN) for w in words), np.int64, len(words))
    start = np.cumsum(size) - size
    flat = b"     " + b" ".join(words) + b" "
    x = np.frombuffer(flat, np.uint8).astype(np.int64)
    length = np.fromiter(map(len, words), np.int64, len(words))
    first = np.cumsum(length + 1) - length - 1 + 5
    place = np.arange(int(size.sum())) - np.repeat(start, size) + OWN
    at = np.repeat(first, size) + place
    g = x[at]
    for k in range(1, 6):
        g = g | np.where(place >= k, x[np.maximum(at - k, 0)], 32) << (8 * k)
    return g, start


def edge_grams(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Grams of the first OWN bytes of each word (with the space after it) and of the ends, in order (40 bits: four bytes before, then the byte), and how many each text has. texts: words, END last. Spaces stand before a text."""
    flat = b"".join(b"    " + b" ".join(words) for words in texts)
    x = np.frombuffer(flat, np.uint8).astype(np.int64)
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    length = np.fromiter((len(w) for words in texts for w in words), np.int64, int(n.sum()))
    last = np.cumsum(n) - 1
    step = length + 1
    step[last] += 3  # END has no space after it; four spaces begin the next text
    first = np.cumsum(step) - step + 4
    size = np.minimum(length + 1, OWN)
    size[last] = 1
    at = np.repeat(first, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    g = x[at]
    for k in range(1, 5):
        g |= x[at - k] << (8 * k)
    return g, np.add.reduceat(size, np.cumsum(n) - n) if len(n) else n


def contexts_of(gram: np.ndarray) -> list[np.ndarray]:
    """The contexts of each gram: the last 1 to 4 bytes, and the five within the word (bytes up to a space count as spaces)."""
    before = gram >> 8
    out = [before & ((1 << (8 * k)) - 1) for k in range(1, 5)]
    inner, live = np.zeros_like(before), np.ones(len(before), bool)
    for k in range(5):
        b = (before >> (8 * k)) & 255
        live = live & (b != 32) & (b != 0)
        inner |= np.where(live, b, 32) << (8 * k)
    return [*out, inner]


def slots_of(order: np.ndarray | int, context: np.ndarray, byte: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(8, n) table slots and (8, n) bits of each byte in its context, most significant first."""
    bit = (byte >> np.arange(7, -1, -1)[:, None]) & 1
    node = (1 << np.arange(8)[:, None]) | (byte >> (8 - np.arange(8))[:, None])  # the byte's bits so far under a leading 1
    h = mix64(context.astype(np.uint64) + (np.asarray(order).astype(np.uint64) << np.uint64(48)))
    with np.errstate(over="ignore"):
        at = (h ^ (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - bits)
    return at.astype(np.int32), bit.astype(np.int8)


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


# ---------------------------------------------------------------- model


class Mixer:
    """Bit counts, gated weights and the refining map."""

    def __init__(self, counts: np.ndarray):
        """counts: (2, slots) bytes, places in COUNT."""
        self.counts, self.bits = counts, int(counts.shape[1]).bit_length() - 1
        # At first the longest context seen decides, the more the oftener it was seen; the one below has the rest.
        self.weights = np.zeros((ORDERS + 1, len(LEVELS) + 1, 8, ORDERS), np.float32)
        for s in range(1, ORDERS + 1):
            for level in range(len(LEVELS) + 1):
                own = 0.6 + 0.4 * level / len(LEVELS)
                self.weights[s, level, :, s - 1] = own
                self.weights[s, level, :, max(s - 2, 0)] += 1 - own
        self.weights = self.weights.reshape(GATES, ORDERS)
        self.map = np.tile(_squash((np.arange(STEPS) - STEPS // 2) / 2.0).astype(np.float32), (MAPS, 1))
        self._speed = np.full((GATES, ORDERS), 1e-6)  # squared steps so far: often-used weights settle
        self._mass, self._ones = np.full(MAPS * STEPS, PRIOR), PRIOR * self.map.ravel().astype(np.float64)

    def slots(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(orders, 8, n) slots and (8, n) bits."""
        found = [slots_of(k, c, gram & 255, self.bits) for k, c in enumerate(contexts_of(gram))]
        return np.stack([s for s, _ in found]), found[0][1]

    def predict(self, slots: np.ndarray, last: np.ndarray, j: int, own: bool, bit: np.ndarray):
        """Of bit j: inputs, gate, mixed logit, the map's cell and place in it, and the probability of a one."""
        n0, n1 = COUNT[self.counts[0, slots]], COUNT[self.counts[1, slots]]
        if own:  # the occurrence itself
            n1 = np.maximum(n1 - bit, 0)
            n0 = np.maximum(n0 - (1 - bit), 0)
        n = n0 + n1
        x = np.log(n1 + 0.4) - np.log(n0 + 0.4)  # the logit of a smoothed share, finite for any count
        seen = (n > 0).sum(0)
        level = np.searchsorted(LEVELS, n[np.maximum(seen - 1, 0), np.arange(n.shape[1])], "right")
        gate = (seen * (len(LEVELS) + 1) + level) * 8 + j
        mixed = np.clip((self.weights[gate].T * x).sum(0), -15, 15)
        place = np.clip(mixed * 2 + STEPS // 2, 0, STEPS - 1.001)
        lo = place.astype(np.int64)
        part = (place - lo).astype(np.float32)
        refined = self.map[last, lo] * (1 - part) + self.map[last, lo + 1] * part
        p = np.clip((_squash(mixed) + 3 * refined) / 4, 1e-5, 1 - 1e-5)
        return x, gate, mixed, lo, part, p

    def costs(self, gram: np.ndarray, block: int = 1 << 14) -> np.ndarray:
        """Bits that each gram's byte costs."""
        out = np.zeros(len(gram))
        for at in range(0, len(gram), block):
            g = gram[at : at + block]
            slots, bits = self.slots(g)
            last = (g >> 8) & 255
            for j in range(8):
                p = self.predict(slots[:, j], last, j, False, bits[j])[-1]
                out[at : at + block] -= np.log2(np.where(bits[j] == 1, p, 1 - p))
        return out

    def learn(self, gram: np.ndarray, n: np.ndarray, block: int = 1024) -> None:
        """Stream the grams (n of each) through the mixer, a block at a time, updating weights and map after each bit."""
        for at in range(0, len(gram), block):
            g, heavy = gram[at : at + block], n[at : at + block].astype(np.float32)
            slots, bits = self.slots(g)
            last = (g >> 8) & 255
            for j in range(8):
                x, gate, mixed, lo, part, _ = self.predict(slots[:, j], last, j, True, bits[j])
                miss = (bits[j] - _squash(mixed)) * heavy
                step = np.stack([np.bincount(gate, weights=miss * x[k], minlength=GATES) for k in range(ORDERS)], 1)
                self._speed += step * step
                self.weights += (RATE * step / np.sqrt(self._speed)).astype(np.float32)
                cell = last * STEPS + lo
                for c, w in ((cell, heavy * (1 - part)), (cell + 1, heavy * part)):
                    self._mass += np.bincount(c, weights=w, minlength=MAPS * STEPS)
                    self._ones += np.bincount(c, weights=w * bits[j], minlength=MAPS * STEPS)
                self.map = (self._ones / self._mass).astype(np.float32).reshape(MAPS, STEPS)


class Costs:
    """Costs of grams: of common ones as given (sorted), of others computed once while they are among the last CACHE or so that a task has met."""

    def __init__(self, mixer: Mixer, gram: np.ndarray, cost: np.ndarray):
        self.mixer = mixer
        self.common = self.gram, self.cost = gram, cost

    def of(self, gram: np.ndarray) -> np.ndarray:
        codes, g = pd.factorize(gram)
        order = np.argsort(g)
        g, inverse = g[order], np.argsort(order)[codes]
        at = np.searchsorted(self.gram, g)
        known = self.gram[np.minimum(at, len(self.gram) - 1)] == g if len(self.gram) else np.zeros(len(g), bool)
        cost = np.zeros(len(g))
        cost[known] = self.cost[at[known]]
        fresh = ~known
        cost[fresh] = self.mixer.costs(g[fresh])
        if len(self.gram) + int(fresh.sum()) > CACHE:
            self.gram, self.cost = self.common
            at = np.searchsorted(self.gram, g)
            fresh = self.gram[np.minimum(at, len(self.gram) - 1)] != g if len(self.gram) else np.ones(len(g), bool)
        self.gram, self.cost = np.insert(self.gram, at[fresh], g[fresh]), np.insert(self.cost, at[fresh], cost[fresh])
        return cost[inverse]


# ---------------------------------------------------------------- learning


def _tokens(text: bytes | None) -> list[bytes]:
    words = (text or b"").lower().split()
    words.append(END)
    return words


def tally(training: DataFrame, text: str, most: int = 200_000) -> DataFrame:
    """word, gram, n: partial counts of all tokens (END included; gram is null) and of all grams (word is null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        edges: list[tuple[np.ndarray, np.ndarray]] = []  # grams and their counts

        def merged() -> None:
            edges[:] = [_add(*(np.concatenate(x) for x in zip(*edges, strict=True)))]

        def rows():
            names, n = list(words), np.fromiter(words.values(), np.int64, len(words))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.nulls(len(names), pa.int64()), pa.array(n)], names=["word", "gram", "n"])
            g, first = word_grams(names)
            edges.append((g, np.repeat(n, np.diff(np.r_[first, len(g)]))))
            merged()
            g, n = edges.pop()
            words.clear()
            yield pa.RecordBatch.from_arrays([pa.nulls(len(g), pa.binary()), pa.array(g), pa.array(n)], names=["word", "gram", "n"])

        for batch in batches:
            for part in slices(batch, TEXTS):
                texts = [_tokens(t) for t in part.column(0).cast(pa.binary()).to_pylist()]
                for t in texts:
                    words.update(t)
                codes, g = pd.factorize(edge_grams(texts)[0])
                edges.append((g, np.bincount(codes, minlength=len(g))))
                if sum(len(g) for g, _ in edges) > 5 * most:
                    merged()
                if len(words) > most or len(edges[0][0]) > 4 * most:
                    yield from rows()
        if words:
            yield from rows()

    return training.select(F.col(text).cast("string").alias("t")).mapInArrow(run, "word binary, gram long, n long")


def _add(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    o = np.argsort(keys, kind="stable")
    keys, n = keys[o], n[o]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def bit_counts(grams: DataFrame, bits: int) -> np.ndarray:
    """(2, slots) counts of zeros and ones, as places in COUNT, over all grams.

    Spark adds up each context's bytes, then each slot's bits. The driver takes
    one byte for each of the slots x 2 numbers.
    """
    width = int(grams.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1 << 16):
                g, n = (b.column(i).slice(at, 1 << 16).to_numpy() for i in range(2))
                for k, c in enumerate(contexts_of(g)):
                    key = (np.int64(k) << np.int64(48)) | c
                    both, m = _add(key << 8 | (g & 255), n) if k < 2 else (None, n)  # the shortest contexts meet again and again
                    key, byte = (both >> 8, both & 255) if both is not None else (key, g & 255)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(byte.astype(np.int32)), pa.array(m)], names=["context", "byte", "n"])

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1 << 16):
                key, byte, n = (b.column(i).slice(lo, 1 << 16).to_numpy() for i in range(3))
                at, bit = slots_of(key >> 48, key & ((1 << 48) - 1), byte.astype(np.int64), bits)
                slot, m = _add((at.astype(np.int64) * 2 + bit).ravel(), np.broadcast_to(n, bit.shape).ravel())
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(m)], names=["slot", "n"])

    each = grams.select("gram", "n").mapInArrow(contexts, "context long, byte int, n long")
    each = each.groupBy("context", "byte").agg(F.sum("n").alias("n")).repartition(width, "context").sortWithinPartitions("context", "byte")
    summed = each.mapInArrow(nodes, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    code = F.when(F.col("n") < 16, F.col("n")).otherwise(F.least(F.lit(255), F.round(16 + 9 * F.log2(F.col("n") / 16)))).cast("int")
    packed = summed.groupBy(F.shiftright("slot", bits - 9).alias("p")).agg(F.collect_list(F.struct(F.col("slot"), code.alias("c"))).alias("s")).select(F.col("s.slot").alias("slot"), F.col("s.c").alias("c"))
    counts = np.zeros(2 << bits, np.uint8)
    for r in packed.toLocalIterator():
        counts[np.array(r.slot)] = r.c
    return np.ascontiguousarray(counts.reshape(-1, 2).T)


def train(grams: DataFrame, counts: np.ndarray) -> Mixer:
    """Weights and map: learned online by each of SHARDS parts of the gram table, then averaged by what each has seen."""
    spark = grams.sparkSession
    sent = spark.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, seen, shard = None, 0, -1
        held: list[tuple[np.ndarray, np.ndarray]] = []  # less than a block is left over: blocks do not depend on batches

        def learn(last: bool) -> None:
            g, n = (np.concatenate(x) for x in zip(*held, strict=True))
            to = len(g) if last else len(g) // 1024 * 1024
            mixer.learn(g[:to], n[:to])
            held[:] = [(g[to:], n[to:])]

        def rows():
            if mixer is not None:
                learn(True)
                held.clear()
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([seen], pa.int64()), pa.array([np.r_[mixer.weights.ravel(), mixer.map.ravel()].astype(np.float64)], pa.list_(pa.float64()))], names=["shard", "n", "x"])

        for b in batches:
            of, g, n = (b.column(i).to_numpy() for i in range(3))
            for part in np.split(np.arange(len(of)), np.flatnonzero(of[1:] != of[:-1]) + 1) if len(of) else []:
                if of[part[0]] != shard:
                    yield from rows()
                    mixer, seen, shard = Mixer(sent.value), 0, int(of[part[0]])
                held.append((g[part], n[part]))
                learn(False)
                seen += int(n[part].sum())
        yield from rows()

    h = F.xxhash64("gram")
    dealt = grams.select(F.pmod(h, F.lit(SHARDS)).cast("int").alias("shard"), "gram", "n", h.alias("h"))
    width = min(SHARDS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = dealt.repartition(width, "shard").sortWithinPartitions("shard", "h").select("shard", "gram", "n").mapInArrow(run, "shard int, n long, x array<double>").collect()  # SHARDS rows
    mixer = Mixer(counts)
    if rows:
        rows.sort(key=lambda r: r.shard)
        x = sum(np.array(r.x) * r.n for r in rows) / sum(r.n for r in rows)
        mixer.weights = x[: GATES * ORDERS].reshape(GATES, ORDERS).astype(np.float32)
        mixer.map = np.clip(x[GATES * ORDERS :], 1e-4, 1 - 1e-4).reshape(MAPS, STEPS).astype(np.float32)
    return mixer


# ---------------------------------------------------------------- scoring


def common_costs(grams: DataFrame, mixer: Mixer, total: int, common: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """The grams (sorted) with at least 1 / `common` of all occurrences, and their costs: at most `common` rows come to the driver."""
    sent = grams.sparkSession.sparkContext.broadcast(mixer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sent.value.costs(b.column(0).to_numpy()))], names=["gram", "cost"])

    got = grams.where(F.col("n") * common >= total).select("gram").mapInArrow(run, "gram long, cost double").toArrow()
    sent.unpersist()
    gram, cost = (np.array(got.column(c).to_numpy()) for c in ("gram", "cost"))
    order = np.argsort(gram)
    return gram[order], cost[order]


def score(docs: DataFrame, training: DataFrame, *, keep: list[str], text: str = "text", heavy: int = HEAVY, most_bits: int = MOST_BITS) -> DataFrame:
    """Columns `keep`, then n_tokens, n_known, train_tokens, base_score, score (log10) and bits_per_byte.

    Texts are A-Z lower-cased; tokens are words and one end. Null counts as empty
    (its one token is the end). base_score is the add-one unigram sum of log10;
    score is the mixing model's log10 probability of the words and the end, and
    bits_per_byte its bits by the bytes coded (words, a byte after each, the end).
    The bit table has SPACE slots or more for each distinct gram, 2^most_bits at
    most; contexts share slots without check bits.
    Without training rows every bit costs what an empty table predicts. One
    output row for each row, repeated rows too; `keep` must not name the new
    columns.
    """
    spark = docs.sparkSession
    parts = cut(tally(training, text), "tally")
    grams = cut(parts.where("gram IS NOT NULL").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    words = cut(parts.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("c")), "words")
    seen, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    kinds, total = grams.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = min(most_bits, max(LEAST_BITS, (SPACE * kinds - 1).bit_length()))
    mixer = train(grams, bit_counts(grams, bits))
    common = common_costs(grams, mixer, total)
    often = F.octet_length("word") <= LONG
    often = often & (F.col("c") * heavy >= seen)
    head = words.where(often).toPandas()  # at most `heavy` words of at most LONG bytes
    sent = spark.sparkContext.broadcast((mixer, [(bytes(w), int(c)) for w, c in zip(head.word, head.c, strict=True)], common))
    rest_type = T.ArrayType(T.StructType([T.StructField("word", T.BinaryType()), T.StructField("k", T.LongType())]))
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("__known", T.LongType()), T.StructField("__sum", T.DoubleType()), T.StructField("__bits", T.DoubleType()), T.StructField("__bytes", T.LongType()), T.StructField("__rest", rest_type)]

    def begin():
        mixer, head, common = sent.value
        logs = {w: float(np.log10(c + 1)) for w, c in head}
        costs = Costs(mixer, *common)
        # Of each word met, up to WORDS or so: its number, and by number the word, the bits of its rest, its log10 (nan: not in the head) and its bytes.
        place: dict[bytes, int] = {}
        names: list[bytes] = []
        facts = np.zeros((3, 0))

        def fn(texts):
            nonlocal facts
            docs_ = [_tokens(t) for t in texts]
            edges, many = edge_grams(docs_)
            edge_bits = np.add.reduceat(costs.of(edges), np.cumsum(many) - many)
            flat = list(chain.from_iterable(docs_))
            size = np.fromiter(map(len, docs_), np.int64, len(docs_))
            first = np.cumsum(size) - size
            fresh = list(set(flat).difference(place))
            if len(place) + len(fresh) > WORDS:
                place.clear()
                names.clear()
                facts, fresh = np.zeros((3, 0)), list(set(flat))
            g, begins = word_grams(fresh)
            sums = np.r_[0.0, np.cumsum(costs.of(g))] if len(g) else np.zeros(1)
            new = sums[np.r_[begins[1:], len(g)]] - sums[begins] if fresh else np.zeros(0)
            facts = np.concatenate([facts, [new, [logs.get(w, np.nan) for w in fresh], list(map(len, fresh))]], axis=1)
            place.update(zip(fresh, range(len(names), len(names) + len(fresh))))
            names.extend(fresh)
            at = np.fromiter(map(place.__getitem__, flat), np.int64, len(flat))
            log = facts[1, at]
            rare = np.isnan(log)
            # Words of a document that are not in the head, with how often.
            each, k = np.unique(np.repeat(np.arange(len(docs_)), size)[rare] << 32 | at[rare], return_counts=True)
            which, inverse = np.unique(each & 0xFFFFFFFF, return_inverse=True)
            words_ = pa.array([names[i] for i in which.tolist()], pa.binary()).take(pa.array(inverse.reshape(-1)))
            rest = pa.ListArray.from_arrays(pa.array(np.searchsorted(each >> 32, np.arange(len(docs_) + 1)).astype(np.int32)), pa.StructArray.from_arrays([words_, pa.array(k.astype(np.int64))], names=["word", "k"]))
            total = lambda x: np.add.reduceat(x, first)
            return [size, size - total(rare.astype(np.int64)), total(np.where(rare, 0.0, log)), edge_bits + total(facts[0, at]), total(facts[2, at].astype(np.int64)) + size - 1, rest]

        return fn

    scored = map_text(docs, text, keep, fields, begin, most=TEXTS)
    row = "__row"
    scored = cut(scored.withColumns({row: F.monotonically_increasing_id()}), "scored")  # the number of a row is fixed once written
    rest = scored.select(row, F.explode("__rest").alias("r")).select(row, "r.word", "r.k")
    rare = rest.join(words.where(~often), "word").groupBy(row).agg(F.sum("k").alias("__k"), F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("__s"))
    whole = scored.drop("__rest").join(rare, row, "left")
    base = F.col("__sum") + F.coalesce("__s", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(seen + distinct + 1)))
    return whole.select(
        *keep,
        "n_tokens",
        (F.col("__known") + F.coalesce("__k", F.lit(0))).alias("n_known"),
        F.lit(seen).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (-F.col("__bits") * float(np.log10(2))).alias("score"),
        (F.col("__bits") / F.col("__bytes")).alias("bits_per_byte"),
    )


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold(F.col("doc_id"), 7) == 2)
    return score(docs, docs.where("NOT held_out"), keep=["doc_id", "held_out"])
