"""Operator 5, exact top-k inner-product search by a dual cover tree.

A cover tree is built over a bounded sample (eight vectors a leaf; its nets halve
their radius from level to level). It has a leaf for each CHUNK rows, 256 to
MOST_LEAVES. Every data row goes to its nearest leaf, so
the index holds all rows, in chunks of CHUNK along the order of the leaves. A
query goes to the chunks of those leaves that may hold one of its k best: with
the leaf's covering radius r, <q, c> + |q| r is the most that a row of leaf c
can score, and the worst k-th score so far starts from the sample, which is part
of the data. A task holds one chunk at a time while the queries that aim at it
stream by, sorted behind it, so no row of the index is copied; QUERIES of them at
once hang into the tree beside the chunk, and the task descends pairs (query node, data node) from the best bound on; it
prunes a pair when
    <a, b> + |a| rb + |b| ra + ra rb
(centres a and b, covering radii ra and rb) is below the worst k-th score that
the node's queries have so far. Tasks send what may still be in a query's top k,
and a last ranking takes the best.

The driver holds the sample, its tree, and one row for each leaf.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomseq.llm.common import table
from loomseq.operators.running import running_sums
from loomseq.sources.shared import cut

LEAVES, MOST_LEAVES, QUERIES, CHUNK = 256, 1024, 2048, 4096


class CoverTree:
    """Nets of halving radius over sample points; nodes are (centre, children), leaves are numbered."""

    def __init__(self, points: np.ndarray, leaves: int = LEAVES):
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        x = points.astype(np.float64)
        far = np.sqrt(((x - x[0]) ** 2).sum(1))
        level, nodes, radius = [0], [self._node(x[0])], float(far.max())
        while len(level) < leaves and radius > 0:
            radius /= 2
            net = list(level)
            near = self._near(x, x[net]).min(1)
            if near.max() <= 1e-3:  # the net holds every distinct point (components are integers)
                break
            if near.max() <= radius:  # the level would repeat the one above
                continue
            while near.max() > radius and len(net) < leaves:
                net.append(int(near.argmax()))
                near = np.minimum(near, np.sqrt(((x - x[net[-1]]) ** 2).sum(1)))
            parent = self._near(x[net], x[level]).argmin(1)
            below = [self._node(x[p]) for p in net]
            for n, p in zip(below, parent.tolist(), strict=True):
                self.children[nodes[p]].append(n)
            level, nodes = net, below
        self.leaf_nodes = nodes
        self.leaf_centres = x[level]

    def _node(self, centre: np.ndarray) -> int:
        self.centres.append(centre)
        self.children.append([])
        return len(self.centres) - 1

    @staticmethod
    def _near(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T, 0))

    def dots(self) -> np.ndarray:
        """Inner products of all centres, computed once in a process."""
        if "_dots" not in self.__dict__:
            c = np.array(self.centres)
            self._dots = c @ c.T
        return self._dots

    def assign(self, x: np.ndarray) -> np.ndarray:
        return self._near(x, self.leaf_centres).argmin(1)


class Side:
    """Rows of one side hung into the tree: at each node the covering radius of the rows below it."""

    def __init__(self, tree: CoverTree, leaf: np.ndarray, x: np.ndarray):
        self.tree, self.rows = tree, {}
        n = len(tree.centres)
        self.radius, self.count = np.full(n, -1.0), np.zeros(n, np.int64)
        order = np.argsort(leaf, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(leaf[order]) != 0]) if len(order) else []
        for part in np.split(order, cuts[1:]) if len(order) else []:
            self.rows[tree.leaf_nodes[leaf[part[0]]]] = part
        for node in range(n - 1, -1, -1):  # children have larger numbers
            below = [self.rows[node]] if node in self.rows else [self.rows_of(c) for c in tree.children[node]]
            ids = np.concatenate(below) if below else np.zeros(0, np.int64)
            self.__dict__.setdefault("_all", {})[node] = ids
            if len(ids):
                self.count[node] = len(ids)
                self.radius[node] = np.sqrt(np.maximum(((x[ids] - tree.centres[node]) ** 2).sum(1), 0)).max()
        self.norm = np.array([np.sqrt((c * c).sum()) for c in tree.centres])

    def rows_of(self, node: int) -> np.ndarray:
        return self.__dict__["_all"][node]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where they cannot lose a digit, else in 64-bit integers (which wrap as a long does)."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Search:
    """A block of queries with their tree, and for each query the best scores so far."""

    def __init__(self, tree: CoverTree, ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray):
        self.tree, self.ids, self.q, self.k = tree, ids, q, k
        self.floor = floor  # no smaller score is in the query's top k
        self.side = Side(tree, tree.assign(q.astype(np.float64)), q.astype(np.float64))

    def run(self, ds: Side, vec_id: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Candidates (query row, vec_id, score) of one chunk of data rows, whose side of the tree is `ds`."""
        tree, qs = self.tree, self.side
        dots = tree.dots()
        centres = tree.centres
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        worst = np.array([self.floor[qs.rows_of(n)].min() if qs.count[n] else 0 for n in range(len(centres))], dtype=np.float64)

        def bound(a, b):
            return dots[a, b] + qs.norm[a] * ds.radius[b] + ds.norm[b] * qs.radius[a] + qs.radius[a] * ds.radius[b]

        stack = [(0, 0)]
        while stack:
            a, b = stack.pop()
            most = bound(a, b)
            if most + 1e-6 * abs(most) + 1e-3 < worst[a]:
                continue  # nothing below b can enter the top k of any query below a
            ca, cb = tree.children[a], tree.children[b]
            if not ca and not cb:
                rq, rd = qs.rows_of(a), ds.rows_of(b)
                score = _products(self.q[rq], x[rd])
                own = self.ids[rq][:, None] == vec_id[rd][None]
                if len(rd) > self.k:
                    least = np.where(own, np.iinfo(np.int64).min, score)
                    kth = np.partition(least, len(rd) - self.k, axis=1)[:, len(rd) - self.k]
                    self.floor[rq] = np.maximum(self.floor[rq], kth)
                    worst[a] = max(worst[a], float(self.floor[rq].min()))
                i, j = np.nonzero((score >= self.floor[rq][:, None]) & ~own)
                out.append((rq[i], vec_id[rd][j], score[i, j]))
                continue
            pairs = [(p, b) for p in ca] if not cb or (ca and qs.radius[a] > ds.radius[b]) else [(a, p) for p in cb]
            pairs = [(p, c) for p, c in pairs if qs.count[p] and ds.count[c]]
            stack += sorted(pairs, key=lambda pc: bound(*pc))  # the best is taken first
        if not out:
            return (np.zeros(0, np.int64),) * 3
        row, vec, score = (np.concatenate(c) for c in zip(*out, strict=True))
        return self._best(row, vec, score)

    def _best(self, row: np.ndarray, vec: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        o = np.lexsort((vec, -score, row))
        row, vec, score = row[o], vec[o], score[o]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
        place = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
        top = place < self.k
        return row[top], vec[top], score[top]


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Rows of equal or smaller length, padded with zeros."""
    out = np.zeros((len(col), dim), np.int64)
    size = np.diff(col.offsets.to_numpy())
    out[np.arange(dim)[None] < size[:, None]] = col.flatten().to_numpy()
    return out


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 20, id: str = "vec_id", vector: str = "embedding", most: int = QUERIES, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest inner products with rows of another id, ties to the smaller id.

    Both tables hold an integer id and a vector of integers (array<bigint>); rows
    with a null id or vector take no part; a shorter vector counts as padded
    with zeros. Repeated data rows are candidates each; repeated query ids with
    equal vectors count once, with different vectors each has its own ranking.
    Empty tables give an empty result.
    """
    spark = vectors.sparkSession
    data = vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    asked = queries.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL").dropDuplicates()
    dim = data.union(asked).agg(F.max(F.size("v"))).first()[0] or 0
    leaves = max(LEAVES, min(MOST_LEAVES, data.count() // chunk))
    sample = data.orderBy(F.xxhash64("vec_id", "v")).limit(8 * leaves).collect()
    if not dim or not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pad = np.zeros((len(sample), dim), np.int64)
    for i, r in enumerate(sample):
        pad[i, : len(r.v)] = r.v
    tree = CoverTree(pad, leaves)
    sent = spark.sparkContext.broadcast((tree, pad, np.array([r.vec_id for r in sample])))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = sent.value[0]
        for b in batches:
            x = _matrix(b.column(1), dim).astype(np.float64)
            leaf = tree.assign(x)
            far = np.sqrt(((x - tree.leaf_centres[leaf]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), pa.array(far), *b.columns], names=["leaf", "far", "vec_id", "v"])

    placed = data.mapInArrow(place, "leaf int, far double, vec_id long, v array<long>")
    index = running_sums(placed, [], [F.asc("leaf"), F.xxhash64("vec_id", "v").asc()], {"n": F.lit(1).cast("long")})
    index = cut(index.withColumn("chunk", F.expr(f"(n - 1) div {chunk}")).select("chunk", "leaf", "far", "vec_id", "v"), "vectors")
    leaves = index.groupBy("leaf").agg(F.max("far").alias("r"), F.min("chunk").alias("first"), F.max("chunk").alias("last")).orderBy("leaf").collect()  # MOST_LEAVES rows at most
    bounds = spark.sparkContext.broadcast((np.array([r.leaf for r in leaves]), np.array([r.r for r in leaves]), np.array([r["first"] for r in leaves]), np.array([r["last"] for r in leaves])))

    def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, sample, sample_ids = sent.value
        leaf, radius, first, last = bounds.value
        centres = tree.leaf_centres[leaf]
        for b in batches:
            for at in range(0, b.num_rows, most):
                part = b.slice(at, most)
                ids, q = part.column(0).to_numpy(), _matrix(part.column(1), dim)
                score = np.where(ids[:, None] == sample_ids[None], np.iinfo(np.int64).min, _products(q, sample))
                floor = np.sort(score, 1)[:, -k].copy() if len(sample) >= k else np.full(len(ids), np.iinfo(np.int64).min)
                x = q.astype(np.float64)
                bound = x @ centres.T + np.sqrt((x * x).sum(1))[:, None] * radius
                near = bound + 1e-6 * np.abs(bound) + 1e-3 >= floor[:, None]
                for c in range(int(first.min()), int(last.max()) + 1):  # leaves follow each other in the chunks
                    some = np.flatnonzero(near[:, (first <= c) & (last >= c)].any(1))
                    if len(some):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), c)), part.column(0).take(pa.array(some)), part.column(1).take(pa.array(some)), pa.array(floor[some])], names=["chunk", "query_id", "q", "floor"])

    aimed = asked.mapInArrow(aim, "chunk long, query_id long, q array<long>, floor long")
    held = index.select("chunk", F.lit(0).alias("role"), "vec_id", "v", "leaf", F.lit(0).cast("long").alias("floor"), F.lit(0).cast("long").alias("h"))
    asks = aimed.select("chunk", F.lit(1).alias("role"), F.col("query_id").alias("vec_id"), F.col("q").alias("v"), F.lit(-1).alias("leaf"), "floor", F.xxhash64("q").alias("h"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = held.union(asks).repartition(width, "chunk").sortWithinPartitions("chunk", "role")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = sent.value[0]
        now, parts, side = None, [], None  # the chunk held, its rows, its side of the tree
        for b in batches:
            chunks, roles = b.column(0).to_numpy(), b.column(1).to_numpy()
            edge = np.flatnonzero(np.r_[True, (np.diff(chunks) != 0) | (np.diff(roles) != 0)]) if b.num_rows else []
            for lo, hi in zip(edge, [*edge[1:], b.num_rows], strict=True):
                if chunks[lo] != now:
                    now, parts, side = chunks[lo], [], None
                p = b.slice(lo, hi - lo)
                if not roles[lo]:
                    parts.append((p.column(2).to_numpy(), _matrix(p.column(3), dim), p.column(4).to_numpy()))
                    continue
                if not parts:
                    continue
                if side is None:
                    ids, x, leaf = (np.concatenate(c) for c in zip(*parts, strict=True))
                    parts, side = [(ids, x, leaf)], Side(tree, leaf, x.astype(np.float64))
                ids, x, _ = parts[0]
                for at in range(0, p.num_rows, most):
                    q = p.slice(at, most)
                    run = Search(tree, q.column(2).to_numpy(), _matrix(q.column(3), dim), k, q.column(5).to_numpy().copy())
                    row, vec, score = run.run(side, ids, x)
                    keep = score >= run.floor[row]
                    row = row[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(run.ids[row]), pa.array(q.column(6).to_numpy()[row]), pa.array(vec[keep]), pa.array(score[keep])], names=["query_id", "h", "vec_id", "score"])

    found = met.mapInArrow(search, "query_id long, h long, vec_id long, score long")
    ranked = Window.partitionBy("query_id", "h").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantized(embeddings: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id and embedding as floor(64 x), x as double; rows with a null vector, or a null or non-finite component, are left out."""
    x = F.transform(vector, lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return embeddings.where(F.col(vector).isNotNull() & fine).select(id, F.transform(x, lambda c: F.floor(c * 64).cast("long")).alias(vector))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = quantized(table(spark, sf_dir, "embeddings"))
    return top_k(v, v.where(F.pmod("vec_id", F.lit(20)) == 0))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND vec_id IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 20
"""
