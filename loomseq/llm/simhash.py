"""Operator 8, SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints that differ in at most `distance` = 2 of 64 bits agree in two of
their four 16-bit blocks. Each distinct fingerprint therefore goes to six
groups, one for each pair of blocks, keyed by their bits (the shared masked
pattern at the top of the index). Within a group, fingerprints are sorted by
Gray rank and packed, eight to a node, into a tree whose nodes hold the bits
on which all below agree. Pairs of nodes are descended together; the bits in
which two nodes surely differ add up on the way down, and a pair beyond the
distance is pruned with all that is below it.

A group of more than HOT fingerprints is divided once more in the same way by
its 32 free bits, which leaves 16 free bits: no task ever holds a group of more
than 65,536. A group emits a star for each local component, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomseq.llm.common import map_text, table
from loomseq.operators.components import components
from loomseq.sources.shared import cut

SEED, SHINGLE, DISTANCE, HOT, FAN = 42, 3, 2, 4096, 8
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)  # bits of a byte, lowest first
_BYTE = (np.arange(8) * 256).astype(np.int64)


def shingle_hashes(text: bytes | None, size: int, xxh) -> list[int]:
    """XXH64 of each shingle of `size` words, repeats included; of fewer words, of the whole sequence; none without a word."""
    words = text.lower().split() if text else []  # bytes: A-Z only, and white space as the contract has it
    if not words:
        return []
    line = b" ".join(words)
    n = len(words) - size + 1
    if n <= 1:
        return [xxh(line, SEED)]
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    return [xxh(line[a:b], SEED) for a, b in zip([0, *end[: n - 1].tolist()], (end[size - 1 :] - 1).tolist(), strict=True)]


def majority(h: np.ndarray) -> int:
    """The bits that more than half of the hashes (uint64) have, as a signed integer; of none: 0."""
    if not len(h):
        return 0
    octets = h.view(np.uint8).reshape(-1, 8)
    counts = np.bincount((octets + _BYTE).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(np.packbits(counts.ravel() * 2 > len(h), bitorder="little").view(np.int64)[0])


def fingerprint(text: bytes | None, xxh, size: int = SHINGLE) -> int:
    """SimHash as a signed 64-bit integer; no words: 0."""
    return majority(np.array(shingle_hashes(text, size, xxh), np.uint64))


def gray_rank(f: np.ndarray) -> np.ndarray:
    """Place of each fingerprint in the reflected Gray code's order."""
    f = f.astype(np.uint64, copy=True)
    for s in (1, 2, 4, 8, 16, 32):
        f ^= f >> np.uint64(s)
    return f


class Forest:
    """One tree for each group of fingerprints, all built and searched together."""

    def __init__(self, group: np.ndarray, prints: np.ndarray):
        """group: ascending; prints: uint64, by Gray rank within each group."""
        ones = np.uint64(0xFFFFFFFFFFFFFFFF)
        self.levels = [(prints, np.full(len(prints), ones), np.arange(len(prints)), np.arange(len(prints)))]  # pattern, mask, first child, end
        while True:
            bits, mask, *_ = self.levels[-1]
            first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            if len(first) == len(group):
                break
            place = np.arange(len(group)) - np.repeat(first, np.diff(np.r_[first, len(group)]))
            head = np.flatnonzero(place % FAN == 0)
            all_and, all_or = np.bitwise_and.reduceat(bits, head), np.bitwise_or.reduceat(bits, head)
            self.levels.append((all_and, np.bitwise_and.reduceat(mask, head) & ~(all_and ^ all_or), head, np.r_[head[1:], len(group)]))
            group = group[head]

    def links(self, most: int, chunk: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of leaves that differ in at most `most` bits, a < b, in pieces."""
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top][0]))
        stack = [(top, roots[i : i + chunk], roots[i : i + chunk]) for i in range(0, len(roots), chunk)]
        while stack:
            level, a, b = stack.pop()
            if level == 0:
                far = a != b
                if far.any():
                    yield a[far], b[far]
                continue
            _, _, first, end = self.levels[level]
            na, nb = end[a] - first[a], end[b] - first[b]
            n = na * nb
            pair = np.repeat(np.arange(len(a)), n)
            k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            x, y = first[a][pair] + k // nb[pair], first[b][pair] + k % nb[pair]
            bits, mask, *_ = self.levels[level - 1]
            ok = (x <= y) & (np.bitwise_count((bits[x] ^ bits[y]) & mask[x] & mask[y]) <= most)
            x, y = x[ok], y[ok]
            stack += [(level - 1, x[i : i + chunk], y[i : i + chunk]) for i in range(0, len(x), chunk)]


def local_roots(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest row of each row's component."""
    root = np.arange(n)
    for a, b in links:
        while len(a):
            a, b = root[a], root[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
    return root


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (k1, k2, fp) sorted by key: links (fp, fp of its local component's head). Handles whole groups only; carries the last over."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        k1, k2, fp = (t.column(i).to_numpy() for i in range(3))
        group = np.cumsum(np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
        size = np.bincount(group)
        full = size[group] > 1
        group, f = group[full], fp[full].astype(np.uint64)
        o = np.lexsort((gray_rank(f), group))
        group, f = group[o], f[o]
        root = local_roots(len(f), Forest(group, f).links(DISTANCE)) if len(f) else np.zeros(0, np.int64)
        moved = root != np.arange(len(f))
        s = f.astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(s[moved]), pa.array(s[root[moved]])], names=["a", "b"])

    kept: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        last = int(np.flatnonzero((k1 != k1[-1]) | (k2 != k2[-1]))[-1]) + 1 if ((k1 != k1[-1]) | (k2 != k2[-1])).any() else 0
        if last and rows + last >= 50_000:
            yield solve(pa.Table.from_batches([*kept, batch.slice(0, last)]))
            kept, rows = [batch.slice(last)], batch.num_rows - last
        else:
            kept.append(batch)
            rows += batch.num_rows
    if rows:
        yield solve(pa.Table.from_batches(kept))


def _block_keys(fp: Column, width: int, shift: Column | None = None) -> Column:
    """Array of (pair number, bits of both blocks) for the six pairs of four blocks of `width` bits."""
    mask = (1 << width) - 1
    block = [F.shiftrightunsigned(fp, i * width).bitwiseAND(F.lit(mask)) for i in range(4)]
    return F.array(*[F.struct(F.lit(n).alias("n"), F.shiftleft(block[i], width).bitwiseOR(block[j]).alias("bits")) for n, (i, j) in enumerate(combinations(range(4), 2))])


def near_links(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """Links a, b that join all distinct fingerprints (long column fp) within DISTANCE bits: stars of each group's local components."""
    six = prints.where("fp IS NOT NULL").select("fp", F.explode(_block_keys(F.col("fp"), 16)).alias("k")).select("fp", "k.n", F.shiftleft(F.col("k.bits"), 3).bitwiseOR(F.col("k.n")).alias("k1"))
    big = six.groupBy("k1").agg(F.count("*").alias("size")).where(F.col("size") > hot)
    six = six.join(big, "k1", "left")
    cold = six.where("size IS NULL").select("k1", F.lit(-1).cast("long").alias("k2"), "fp")
    # The free blocks of a hot group's pair, side by side, are divided again.
    pairs = list(combinations(range(4), 2))
    free = F.lit(None).cast("long")
    for n, p in enumerate(pairs):
        i, j = (x for x in range(4) if x not in p)
        take = lambda x: F.shiftrightunsigned("fp", x * 16).bitwiseAND(F.lit(0xFFFF))
        free = F.when(F.col("n") == n, F.shiftleft(take(i), 16).bitwiseOR(take(j))).otherwise(free)
    hot_rows = six.where("size IS NOT NULL").select("k1", "fp", F.explode(_block_keys(free, 8)).alias("k")).select("k1", F.shiftleft(F.col("k.bits"), 3).bitwiseOR(F.col("k.n")).cast("long").alias("k2"), "fp")
    rows = cold.unionByName(hot_rows)
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "k1", "k2").sortWithinPartitions("k1", "k2").mapInArrow(_stars, "a long, b long")


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep` and fp long."""

    def begin():
        import xxhash

        return lambda texts: [[fingerprint(t, xxhash.xxh64_intdigest) for t in texts]]

    return map_text(docs, text, keep, [T.StructField("fp", T.LongType())], begin)


def classes(rows: DataFrame) -> DataFrame:
    """From rows (id, fp): for each distinct fp its class root, the smallest id of its rows (low) and of its class (component_id)."""
    prints = rows.groupBy("fp").agg(F.min("id").alias("low"))
    comp = components(near_links(prints.select("fp")), "a", "b")
    named = prints.join(comp, prints.fp == comp.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    low = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return named.join(low, "root")


def near_duplicates(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's `id`, its fingerprint (fp long) and component_id: the smallest id reachable over links of at most DISTANCE bits.

    Null, empty and blank texts have fingerprint 0 and link like any other.
    Repeated rows are each returned. A null id joins its component but never
    names it (a component of null ids alone has a null component_id).
    """
    rows = cut(fingerprints(docs, [id], text).select(F.col(id).alias("id"), "fp"), "prints")
    return rows.join(classes(rows).select("fp", "component_id"), "fp").select(F.col("id").alias(id), "fp", "component_id")


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
