"""Operator 11, near-duplicate embeddings by spherical k-means cells and blocked cosine products.

Exact copies are counted first, so that a vector of any number of rows is one.
Cells are fitted by spherical k-means on a bounded sample of the distinct
vectors; their number grows with the table (one for each CELL of them, at most
MODEL_BYTES of centres), and centres closer than APART are one, so a dense
group lies in one cell. Every vector lives in the cell of its nearest centre and
visits the next nearest ones (PROBES and log2 of the number of cells), but not
those that no vector within the threshold can live in. This is the index; two
linked vectors that neither visit each other's cell are missed.

Vectors nearer to their centre than half the threshold's angle (the core of a
cell) are all linked with each other: their links are counted, not compared, and
so are those of an outer vector that the whole core is near to. All other pairs
of a cell are compared by products of blocks: a cell is dealt over blocks of
BLOCK rows; a block is held by its task while visitors stream by, sorted behind
it, so memory does not depend on a cell's size. A block gives one row for each
vector (how many links, and one of them), never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseq.llm.common import table
from loomseq.operators.components import components
from loomseq.sources.shared import cut

THRESHOLD, CELL, BLOCK, PROBES, ROUNDS, APART = 0.9, 1024, 1024, 4, 3, 0.8
#: Bytes of the centres (and eight times as many of the sample that they are fitted on).
MODEL_BYTES = 8 << 20
#: Bytes of products that a task holds at once.
PRODUCTS = 32 << 20
#: Cosines this near to the threshold are computed once more, from the vectors as they are.
ROUNDING = 1e-11


def unit(rows: list | pa.Array, dim: int) -> np.ndarray:
    """Rows as doubles of length one, padded with zeros."""
    col = rows if isinstance(rows, (pa.Array, pa.ChunkedArray)) else pa.array(rows, pa.list_(pa.float64()))
    size = np.diff(col.offsets.to_numpy())
    out = np.zeros((len(col), dim))
    out[np.arange(dim)[None] < size[:, None]] = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _unit(out)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fit(x: np.ndarray, most: int, rounds: int = ROUNDS, apart: float = APART) -> np.ndarray:
    """At most `most` centres of unit vectors x by spherical k-means; no two with a cosine of `apart` or more. Starts are the first rows that lie apart."""
    c = _spread(x, most, apart)
    for _ in range(rounds):
        home = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        size = np.bincount(home, minlength=len(c))
        full = (size > 0) & (np.abs(sums).max(1) > 1e-9)
        c[full] = _unit(sums[full])
        c = _spread(c[np.argsort(-size, kind="stable")], most, apart)
    return c


def _spread(x: np.ndarray, most: int, apart: float) -> np.ndarray:
    """Rows of x in order, without those that lie within `apart` of one taken before."""
    taken = x[:1]
    for i in range(1, len(x), 1024):
        if len(taken) >= most:
            break
        part = x[i : i + 1024]
        part = part[(part @ taken.T).max(1) < apart]
        near, free, picks = part @ part.T >= apart, np.ones(len(part), bool), []
        for j in range(len(part)):
            if free[j]:
                picks.append(j)
                free &= ~near[j]
        taken = np.concatenate([taken, part[picks]])
    return taken[:most].copy()


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite the sets of a[i] and b[i]; root[x] <= x leads to the set's smallest member, in one step."""
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


class Block:
    """The vectors that live in one block of a cell; counts links and unites the linked."""

    FIELDS = ("node", "w", "home", "core", "cover", "own")

    def __init__(self, key: tuple[int, int], parts: list[dict], dim: int, threshold: float):
        self.cell, self.block = key
        self.threshold = threshold
        for f in self.FIELDS:
            setattr(self, f, np.concatenate([p[f] for p in parts]))
        self.x = np.concatenate([p["x"] for p in parts])
        self.probes = [q for p in parts for q in p["probes"]]
        self.visits: dict[int, np.ndarray] = {}
        self.links = np.zeros(len(self.node), np.int64)
        self.root = np.arange(len(self.node))
        self.step = max(1, PRODUCTS // 8 // max(1, len(self.node)))

    def within(self) -> None:
        """Pairs of the block's own rows."""
        at = np.arange(len(self.node))
        for i in range(0, len(at), self.step):
            rows = slice(i, i + self.step)
            near = self._near(self.x[rows]) & (at[rows, None] < at[None])
            near &= self._open(self.core[rows], self.cover[rows])
            self.links[rows] += near @ self.w
            self.links += self.w[rows] @ near
            a, b = np.nonzero(near)
            _join(self.root, a + i, b)

    def meet(self, v: dict) -> tuple[np.ndarray, np.ndarray]:
        """Links of visitors with the block's rows, and the place of one linked row (-1: none)."""
        links, one = np.zeros(len(v["node"]), np.int64), np.full(len(v["node"]), -1)
        for i in range(0, len(links), self.step):
            rows = slice(i, i + self.step)
            near = self._near(v["x"][rows])
            home = v["home"][rows]
            own = home == self.cell
            if own.any():  # an outer row of another block of this cell: the later block's turn with outer rows, any block's with the core
                first = self.core[None] | (v["own"][rows] < self.block)[:, None]
                near &= ~own[:, None] | (first & self._open(v["core"][rows], v["cover"][rows]))
            for a in np.unique(home[~own]):
                if a > self.cell:  # the pair's other row visits that cell too: counted there
                    near[home == a] &= ~self._visits(int(a))
            links[rows] = near @ self.w
            self.links += v["w"][rows] @ near
            some = near.any(1)
            first_of = near.argmax(1)
            one[rows] = np.where(some, first_of, -1)
            a, b = np.nonzero(near)
            _join(self.root, first_of[a], b)
        return links, one

    def _visits(self, cell: int) -> np.ndarray:
        if cell not in self.visits:
            self.visits[cell] = np.array([cell in p for p in self.probes], bool)
        return self.visits[cell]

    def _open(self, core: np.ndarray, cover: np.ndarray) -> np.ndarray:
        """Pairs that are not counted already: core with core, and core with a row that is near to all of it."""
        return ~((core[:, None] & self.core[None]) | (cover[:, None] & self.core[None]) | (core[:, None] & self.cover[None]))

    def _near(self, x: np.ndarray) -> np.ndarray:
        c = x @ self.x.T
        near = c >= self.threshold
        a, b = np.nonzero(np.abs(c - self.threshold) < ROUNDING)
        if len(a):
            p, q = x[a], self.x[b]
            near[a, b] = (p * q).sum(1) / (np.sqrt((p * p).sum(1)) * np.sqrt((q * q).sum(1))) >= self.threshold
        return near


def _compare(batches: Iterator[pa.RecordBatch], dim: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell, block and role: those that live there (role 0) are held, then visitors stream by."""

    def out(node, links, root):
        keep = (links != 0) | (root != node)
        return pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(links[keep]), pa.array(root[keep])], names=["node", "links", "root"])

    key, parts, held = None, [], None

    def close():
        h = held or (Block(key, parts, dim, threshold) if parts else None)
        if h is None:
            return None
        if held is None:
            h.within()
        return out(h.node, h.links, h.node[h.root])

    for b in batches:
        cells, blocks, roles = (b.column(i).to_numpy() for i in range(3))
        edge = np.flatnonzero(np.r_[True, (np.diff(cells) != 0) | (np.diff(blocks) != 0) | (np.diff(roles) != 0)]) if b.num_rows else []
        for lo, hi in zip(edge, [*edge[1:], b.num_rows], strict=True):
            now = (int(cells[lo]), int(blocks[lo]))
            if now != key:
                if key is not None and (last := close()) is not None:
                    yield last
                key, parts, held = now, [], None
            p = b.slice(lo, hi - lo)
            v = {f: p.column(3 + i).to_numpy(zero_copy_only=False) for i, f in enumerate(Block.FIELDS)} | {"probes": p.column(9).to_pylist(), "x": unit(p.column(10), dim)}
            if roles[lo] == 0:
                parts.append(v)
            elif parts or held:  # a block without rows of its own has nothing to meet
                if held is None:
                    held, parts = Block(key, parts, dim, threshold), []
                    held.within()
                links, one = held.meet(v)
                yield out(v["node"], links, np.where(one >= 0, held.node[one], v["node"]))
    if key is not None and (last := close()) is not None:
        yield last


def near_duplicates(vectors: DataFrame, *, threshold: float = THRESHOLD, id: str = "vec_id", vector: str = "embedding", cell: int = CELL, block: int = BLOCK, probes: int = PROBES, model_bytes: int = MODEL_BYTES) -> DataFrame:
    """One row for each row of vectors: vec_id, n_links (other rows with a cosine of `threshold` or more that the index finds), component_id (smallest vec_id reachable by links), kept.

    Rows whose vector is null, empty, zero or holds a null or non-finite
    component, and rows with a null id, link with nothing: n_links 0, a component
    of their own, kept (null and false with a null id). A shorter vector counts
    as padded with zeros. Copies of a vector link with each other; a repeated id
    is a row of its own. Empty tables give an empty result.
    """
    spark = vectors.sparkSession
    if not 0 < threshold < 1:
        raise ValueError("the threshold must lie between 0 and 1")
    rows = vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    x = F.transform("v", lambda c: c.cast("double"))
    fine = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists(x, lambda c: c != 0)
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    copies = rows.where("fine").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w"))
    copies = cut(copies.withColumn("node", F.monotonically_increasing_id()), "distinct")  # written, so that a node keeps its number
    n, total, dim = copies.agg(F.count("*"), F.coalesce(F.sum("w"), F.lit(0)), F.max(F.size("v"))).first()
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))

    most = max(1, min(-(-n // cell), model_bytes // (8 * dim)))
    sample = copies.where(F.pmod(F.xxhash64("v"), F.lit(max(1, n // (8 * most)))) == 0).select("v").orderBy(F.xxhash64("v", F.lit(1))).limit(16 * most).collect()
    sample = sample or copies.select("v").limit(1).collect()
    centres = fit(unit([list(map(float, r.v)) for r in sample], dim), most)
    wide = max(1, min(len(centres), probes + math.ceil(math.log2(len(centres)) if len(centres) > 1 else 0)))
    delta = math.acos(threshold)
    sent = spark.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        between = np.sqrt(np.maximum(2 - 2 * c @ c.T, 1e-12)) if len(c) <= 2048 else None
        step = max(1, PRODUCTS // 8 // max(len(c), dim))
        for b in batches:
            for at in range(0, b.num_rows, step):
                p = b.slice(at, step)
                s = unit(p.column(2), dim) @ c.T
                top = np.argpartition(-s, wide - 1, axis=1)[:, :wide] if wide < len(c) else np.tile(np.arange(len(c)), (len(s), 1))
                near = np.take_along_axis(s, top, 1)
                o = np.argsort(-near, axis=1, kind="stable")
                top, near = np.take_along_axis(top, o, 1), np.take_along_axis(near, o, 1)
                home = top[:, 0]
                apart = between[home[:, None], top] if between is not None else np.sqrt(np.maximum(((c[home][:, None] - c[top]) ** 2).sum(2), 1e-12))
                # a linked vector that lives in cell t lies beyond the plane between t and home, within the threshold's angle
                can = (near[:, :1] - near) <= (math.sin(delta) + 1e-9) * apart
                visits = [t[k][1:].tolist() for t, k in zip(top.astype(np.int32), can, strict=True)]
                yield pa.RecordBatch.from_arrays([p.column(0), p.column(1), p.column(2), pa.array(home.astype(np.int32)), pa.array(np.arccos(np.clip(near[:, 0], -1, 1))), pa.array(visits, pa.list_(pa.int32()))], names=["node", "w", "v", "home", "angle", "probes"])

    kind = copies.schema["v"].dataType.simpleString()
    placed = copies.select("node", "w", "v").mapInArrow(place, f"node long, w long, v {kind}, home int, angle double, probes array<int>")
    placed = cut(placed.withColumn("core", F.col("angle") <= delta / 2 - 1e-7), "placed")
    inner = F.when(F.col("core"), F.col("node"))
    cells = placed.groupBy("home").agg(
        F.greatest(F.lit(1), F.ceil(F.count("*") / block)).cast("int").alias("blocks"), F.sum(F.when(F.col("core"), F.col("w"))).alias("core_w"), F.min(inner).alias("core_node"), F.max(F.when(F.col("core"), F.col("angle"))).alias("radius"),
    )
    cells = F.broadcast(cut(cells, "cells"))  # a row for each centre, which model_bytes bounds
    known = placed.join(cells, "home").withColumn("cover", F.coalesce(~F.col("core") & (F.col("angle") + F.col("radius") <= delta - 1e-7), F.lit(False)))
    covers = F.broadcast(known.where("cover").groupBy("home").agg(F.sum("w").alias("cover_w")))
    counted = known.join(covers, "home", "left").select(
        "node",
        (F.col("w") - 1 + F.when(F.col("core"), F.col("core_w") - F.col("w") + F.coalesce("cover_w", F.lit(0))).when(F.col("cover"), F.col("core_w")).otherwise(0)).alias("links"),
        F.when(F.col("core") | F.col("cover"), F.col("core_node")).otherwise(F.col("node")).alias("root"),
    )

    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    lives = known.withColumn("own", own)
    cols = ["node", "w", "home", "core", "cover", "own", "probes", "v"]
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    here = lives.select(F.col("home").alias("cell"), F.col("own").alias("block"), F.lit(0).alias("role"), *cols)
    around = lives.where("NOT core AND blocks > 1").select(F.col("home").alias("cell"), every.alias("block"), F.lit(1).alias("role"), *cols).where("block <> own")
    rooms = F.broadcast(cells.select(F.col("home").alias("cell"), "blocks"))
    away = lives.drop("blocks").withColumn("cell", F.explode("probes")).join(rooms, "cell").select("cell", every.alias("block"), F.lit(1).alias("role"), *cols)
    met = here.union(around).union(away).repartition("cell", "block").sortWithinPartitions("cell", "block", "role")
    found = met.mapInArrow(lambda batches: _compare(batches, dim, threshold), "node long, links long, root long")
    found = cut(found.union(counted), "links")

    links = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    roots = components(found.where("root <> node"), "root", "node")
    result = copies.join(links, "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = result.groupBy("root").agg(F.min("rep").alias("component_id"))
    result = cut(result.select("v", "w", "n_links", "root").join(smallest, "root").select("v", "w", "n_links", "component_id"), "classes")

    # A vector of very many rows is looked up by broadcast (at most 64 such vectors), the others by join.
    hot = F.col("w") > max(1000, total // 64)
    frequent = F.broadcast(result.where(hot).select("v", "n_links", "component_id", F.lit(True).alias("hot")))
    first = rows.where("fine").join(frequent, "v", "left")
    rest = first.where("hot IS NULL").select("vec_id", "v").join(result.where(~hot), "v")
    alone = rows.where("NOT fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = first.where("hot").select("vec_id", "n_links", "component_id").union(rest.select("vec_id", "n_links", "component_id")).union(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
reach AS (SELECT a AS node, b AS seen FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a),
roots AS (SELECT node, min(seen) AS root FROM reach GROUP BY node),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(r.root, e.vec_id)) AS component_id,
       coalesce(e.vec_id = least(e.vec_id, coalesce(r.root, e.vec_id)), false) AS kept
FROM embeddings e LEFT JOIN roots r ON r.node = e.vec_id LEFT JOIN degree d ON d.a = e.vec_id
"""
