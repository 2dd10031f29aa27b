"""Operator 12, k-means over whole numbers by subvector dictionaries.

Vectors are cut into blocks of dimensions, and each block of a chunk of rows
(CHUNK) is stored without loss as a dictionary of its distinct subvectors and
one code for each row. In a round the distance of every distinct subvector to
every centroid is computed once, and a row's distance is the sum of what its
codes stand for; a cluster's sum is its codes' counts times the dictionary.
Both are exact whole numbers. Chunks are written once in the shared folder;
a round is one pass over them that sends one row for each chunk, cluster and
dimension, so neither rows nor codes move. The driver holds the centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseq.llm.common import table
from loomseq.sources.shared import cut

DIM, SCALE, CLUSTERS, ROUNDS, SEED = 64, 1024, 8, 10, 3
#: Dimensions of a block, and rows of a chunk. With one dimension a block's dictionary has no more entries than the components have values.
WIDTH, CHUNK = 1, 16384
LONG = (1 << 63) - 1
#: Components up to this size are summed and squared in 64 bits; beyond it in Python's whole numbers.
SMALL = 1 << 24


class Chunk:
    """Rows of equal length as codes into dictionaries of their blocks' distinct subvectors."""

    def __init__(self, dictionaries: list[np.ndarray], codes: np.ndarray):
        self.dictionaries, self.codes = dictionaries, codes  # (entries, width) a block; (blocks, rows)

    @classmethod
    def encode(cls, x: np.ndarray, width: int = WIDTH) -> Chunk:
        dictionaries, codes = [], []
        for at in range(0, x.shape[1], width):
            entries, code = np.unique(x[:, at : at + width], axis=0, return_inverse=True)
            dictionaries.append(entries)
            codes.append(code.reshape(-1).astype(np.int32))
        return cls(dictionaries, np.array(codes, np.int32).reshape(len(codes), len(x)))

    def decode(self) -> np.ndarray:
        return np.concatenate([d[c] for d, c in zip(self.dictionaries, self.codes, strict=True)], axis=1)

    def _exact(self, centroids: list[list[int]]) -> type:
        most = max([abs(v) for c in centroids for v in c] + [int(f) for d in self.dictionaries if d.size for f in (d.max(), -int(d.min()))], default=0)
        wide = sum(d.shape[1] for d in self.dictionaries)
        return np.int64 if most <= SMALL and wide * 4 * SMALL * SMALL < LONG and self.codes.shape[1] * SMALL < LONG else object

    def nearest(self, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid (ties: the smaller) and squared distance of every row."""
        kind = self._exact(centroids)
        total = np.zeros((len(centroids), self.codes.shape[1]), kind)
        at = 0
        for entries, code in zip(self.dictionaries, self.codes, strict=True):
            width = entries.shape[1]
            c = np.array([row[at : at + width] for row in centroids], kind)
            apart = entries.astype(kind)[None] - c[:, None]
            total += (apart * apart).sum(2)[:, code]  # once for each distinct subvector and centroid, then by code
            at += width
        near = total.argmin(0)
        return near, total[near, np.arange(total.shape[1])]

    def sums(self, near: np.ndarray, clusters: int) -> list[list[int]]:
        """Componentwise sums of each cluster's rows: counts of codes times the dictionary."""
        out: list[list[int]] = [[] for _ in range(clusters)]
        for entries, code in zip(self.dictionaries, self.codes, strict=True):
            count = np.bincount(near * len(entries) + code, minlength=clusters * len(entries)).reshape(clusters, -1)
            small = not entries.size or max(abs(int(entries.max())), abs(int(entries.min()))) * int(count.sum()) < LONG
            kind = np.int64 if small else object
            for k, row in enumerate((count.astype(kind) @ entries.astype(kind)).tolist()):
                out[k] += row
        return out


_CHUNK = "ids array<long>, entries array<array<long>>, codes array<binary>"


def _encode(batches: Iterator[pa.RecordBatch], width: int, chunk: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def write():
        ids = pa.concat_arrays([b.column(0) for b in held])
        flat = np.concatenate([b.column(1).flatten().to_numpy() for b in held])
        c = Chunk.encode(flat.reshape(len(ids), -1), width)
        return pa.RecordBatch.from_arrays(
            [pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([[d.reshape(-1).tolist() for d in c.dictionaries]], pa.list_(pa.list_(pa.int64()))), pa.array([[k.tobytes() for k in c.codes]], pa.list_(pa.binary()))],
            names=["ids", "entries", "codes"],
        )

    for b in batches:
        at = 0
        while at < b.num_rows:
            part = b.slice(at, chunk - sum(h.num_rows for h in held))
            held.append(part)
            at += part.num_rows
            if sum(h.num_rows for h in held) == chunk:
                yield write()
                held = []
    if held:
        yield write()


def _chunks(batches: Iterator[pa.RecordBatch], width: int, dim: int) -> Iterator[tuple[pa.Array, Chunk]]:
    for b in batches:
        for i in range(b.num_rows):
            sizes = [min(width, dim - at) for at in range(0, dim, width)]
            entries = [np.array(e, np.int64).reshape(-1, s) for e, s in zip(b.column(1)[i].as_py(), sizes, strict=True)]
            codes = np.array([np.frombuffer(c, np.int32) for c in b.column(2)[i].as_py()])
            yield b.column(0)[i].values, Chunk(entries, codes)


def cluster(vectors: DataFrame, starts: list[list[int]], *, rounds: int = ROUNDS, id: str = "vec_id", vector: str = "v", width: int = WIDTH, chunk: int = CHUNK) -> tuple[DataFrame, list[list[int]]]:
    """Columns vec_id, cluster and distance of every row after `rounds` rounds from `starts`, and the last centroids.

    vectors holds an integer id (null: kept) and a vector of as many whole
    numbers as a start has (array<bigint>). A distance beyond a long is the
    largest long; all comparisons before are exact.
    """
    spark, k, dim = vectors.sparkSession, len(starts), len(starts[0])
    stored = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("v")).mapInArrow(lambda b: _encode(b, width, chunk), _CHUNK)
    stored = cut(stored, "dictionaries")
    centroids = [list(c) for c in starts]
    for _ in range(rounds):

        def add(batches: Iterator[pa.RecordBatch], centroids=centroids) -> Iterator[pa.RecordBatch]:
            for _ids, c in _chunks(batches, width, dim):
                near, _ = c.nearest(centroids)
                n = np.bincount(near, minlength=k).tolist()
                rows = [(i, j, n[i], str(s)) for i, row in enumerate(c.sums(near, k)) if n[i] for j, s in enumerate(row)]
                yield pa.RecordBatch.from_arrays([pa.array([r[f] for r in rows], t) for f, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.string()))], names=["cluster", "part", "n", "s"])

        sums = stored.mapInArrow(add, "cluster int, part int, n long, s string").groupBy("cluster", "part").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
        for r in sums.collect():  # clusters x dimensions rows
            centroids[r.cluster][r.part] = int(r.s) // r.n  # rounds down, below zero too
        centroids = [list(c) for c in centroids]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, c in _chunks(batches, width, dim):
            near, far = c.nearest(centroids)
            if far.dtype == object:
                far = np.array([min(d, LONG) for d in far.tolist()], np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(near.astype(np.int32)), pa.array(far)], names=["vec_id", "cluster", "distance"])

    return stored.mapInArrow(assign, "vec_id long, cluster int, distance long"), centroids


def whole_numbers(embeddings: DataFrame, *, dim: int = DIM, scale: int = SCALE, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and v (floor(scale * x), x as double) of the vectors with exactly `dim` finite components. A value beyond a long is the nearest long."""
    x = F.transform(vector, lambda c: c.cast("double"))
    fine = (F.size(vector) == dim) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    low, high = F.lit(-float(1 << 63)), F.lit(float((1 << 63) - 1024))  # doubles that a long holds
    whole = F.transform(x, lambda c: F.floor(F.greatest(low, F.least(high, c * scale))).cast("long"))
    return embeddings.where(F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id).cast("long").alias("vec_id"), whole.alias("v"))


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    """The vectors whose id has the smallest SHA-256 of `seed:id`; rows with a null id are none of them, ties go by vector."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    return [list(r.v) for r in vectors.where("vec_id IS NOT NULL").orderBy(key, "v").limit(clusters).select("v").collect()]


def centroid_clusters(embeddings: DataFrame, *, clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, id: str = "vec_id", vector: str = "embedding", width: int = WIDTH, chunk: int = CHUNK) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector.

    Kept are vectors of exactly `dim` finite components; others, null ones
    included, have no row. Fewer kept ids than clusters give as many clusters.
    A row with a null id is assigned and counted, but starts no cluster; if all
    ids are null the result is empty. Repeated rows count each. Inertia beyond a
    long is the largest long.
    """
    spark = embeddings.sparkSession
    kept = whole_numbers(embeddings, dim=dim, scale=scale, id=id, vector=vector)
    starts = first_centroids(kept, clusters)
    if not starts:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    assigned, centroids = cluster(kept, starts, rounds=rounds, width=width, chunk=chunk)
    assigned = cut(assigned, "clusters")
    spread = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row a cluster
    facts = [(i, min(spread[i], LONG), min(sum(spread.values()), LONG), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids) if i in spread]
    return assigned.join(F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    ctes = [
        """v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        """c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, e) - 1)::INTEGER AS k, e FROM (SELECT sha256('3:' || vec_id) AS h, e FROM v WHERE vec_id IS NOT NULL ORDER BY h, e LIMIT 8))""",
    ]
    near = """a{i} AS MATERIALIZED (SELECT r, vec_id, e, arg_min(k, (d, k)) AS k, min(d) AS d FROM (
              SELECT v.r, v.vec_id, v.e, c.k, list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v CROSS JOIN c{i} c) GROUP BY r, vec_id, e)"""
    move = """m{i} AS (SELECT k, j, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(e) AS x, unnest(range(64)) AS j FROM a{i}) GROUP BY k, j),
              c{n} AS MATERIALIZED (SELECT c.k, coalesce(g.e, c.e) AS e FROM c{i} c LEFT JOIN (
                SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS e FROM m{i} GROUP BY k) g ON g.k = c.k)"""
    for i in range(ROUNDS):
        ctes += [near.format(i=i), move.format(i=i, n=i + 1)]
    ctes.append(near.format(i=ROUNDS))
    return "WITH " + ",\n".join(ctes) + f"""
SELECT a.vec_id, a.k AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.k = a.k"""


ORACLE = _oracle()
