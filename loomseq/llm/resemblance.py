"""Near-duplicates by resemblance: texts whose sets of word shingles have a Jaccard similarity of at least a bound.

This is the near-duplicate operator's form for whole classes of copies. Texts
with equal sets are one from the start. Candidates come from its SimHash index
(fingerprints of the same shingles within its distance), and, as pairs at a
similarity of 0.8 lie five to ten bits and more apart, beyond what that index
can hold, also from BANDS keys of ROWS minima each (a pair at 0.8 shares no key
with probability (1 - 0.8^5)^30 = 7e-6). Every candidate is compared by its
exact sets before it counts as a link.

Within a group of one key all are compared with its head first, and parts that
are linked by then are one. In what is still apart, small groups compare pairs;
larger ones go to tasks in cells of two blocks each, so that a set travels once
for each block and not once for each pair, and a cell returns stars, not pairs.
No link of a group is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomseq.llm import simhash
from loomseq.llm.common import map_text, mix64, slices
from loomseq.operators.components import components
from loomseq.sources.shared import cut

SEED, WORDS, SIMILARITY, BANDS, ROWS = simhash.SEED, 5, 0.8, 30, 5
#: Pairs up to which a group that is still apart is compared pair by pair; rows and hashes of a block of a larger one.
FEW, BLOCK_ROWS, BLOCK_HASHES = 64, 256, 1 << 17
#: Bits of the filter that keeps texts without a candidate out of the comparison; a wrong bit costs a row, never a link.
FILTER_BITS = 25
_ODD = mix64(np.arange(1, BANDS * ROWS + 1)) | np.uint64(1)
_ADD = mix64(np.arange(1001, BANDS * ROWS + 1001))


def shingles(text: bytes | None, words: int, xxh) -> np.ndarray:
    """Distinct hashes of the text's shingles, ascending (uint64). A text of fewer words is one shingle; no words: none."""
    return np.unique(np.array(simhash.shingle_hashes(text, words, xxh), np.uint64))


def band_keys(h: np.ndarray) -> np.ndarray:
    """BANDS keys (int64) of a set of hashes; none of an empty one."""
    if not len(h):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(h), 2048):
            least = np.minimum(least, (_ODD[:, None] * h[None, at : at + 2048] + _ADD[:, None]).min(1))
        key = np.arange(BANDS, dtype=np.uint64)
        for r in range(ROWS):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) ^ least[r::ROWS])
    return key.view(np.int64)


def _signed(h: np.ndarray, xxh) -> int:
    x = xxh(h.tobytes(), SEED) if len(h) else 0
    return x - (1 << 64) if x >> 63 else x


def sketches(docs: DataFrame, keep: list[str], text: str, words: int) -> DataFrame:
    """Columns `keep`, fp (hash of the text's set; 0 of an empty one), sim (SimHash of the set), size (of the set) and keys."""

    def begin():
        import xxhash

        def fn(texts):
            sets = [shingles(t, words, xxhash.xxh64_intdigest) for t in texts]
            return [[_signed(h, xxhash.xxh64_intdigest) for h in sets], [simhash.majority(h) for h in sets], [len(h) for h in sets], [band_keys(h) for h in sets]]

        return fn

    return map_text(docs, text, keep, [T.StructField("fp", T.LongType()), T.StructField("sim", T.LongType()), T.StructField("size", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))], begin)


def _sets_of(rows: DataFrame, text: str, wanted: DataFrame, words: int) -> DataFrame:
    """fp and its set (array of longs), of every wanted fp (and few others): read from the texts by a bounded filter, so that texts are not shuffled."""
    bit = F.shiftrightunsigned("fp", 64 - FILTER_BITS)
    bits = wanted.select(bit.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("m")).toPandas()
    held = np.zeros((1 << FILTER_BITS) // 8 + 4096, np.uint8)
    for k, m in zip(bits.k, bits.m, strict=True):  # bucket k holds the numbers from (k - 1) * 32768 + 1, bucket 0 those up to 0
        at = int(k) * 4096
        held[at : at + len(m)] = np.frombuffer(bytes(m), np.uint8)
    sent = rows.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for part in slices(batch):
                fp = part.column(0).to_numpy()
                b = (fp.view(np.uint64) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                place = np.where(b > 0, (b - 1) % 32768, 0)
                bucket = np.where(b > 0, (b - 1) // 32768 + 1, 0)
                ok = np.flatnonzero(sent.value[bucket * 4096 + place // 8] >> (place % 8).astype(np.uint8) & 1)
                ok = ok[np.unique(fp[ok], return_index=True)[1]]
                texts = part.column(1).take(pa.array(ok)).cast(pa.binary()).to_pylist()
                sets = [shingles(t, words, xxhash.xxh64_intdigest).view(np.int64) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(fp[ok]), pa.array(sets, pa.list_(pa.int64()))], names=["fp", "set"])

    return rows.select("fp", F.col(text).cast("string")).mapInArrow(run, "fp long, set array<long>").groupBy("fp").agg(F.first("set").alias("set"))


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b whose sets are similar enough."""
    both = F.size(F.array_intersect("sa", "sb"))
    joined = pairs.join(sets.select(F.col("fp").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("fp").alias("b"), F.col("set").alias("sb")), "b")
    return joined.where(both >= similarity * (F.size("sa") + F.size("sb") - both) - 1e-9).select("a", "b")


def _simhash_stars(sets: DataFrame) -> DataFrame:
    """Candidates a, b from the SimHash index: all sets of one fingerprint meet the first of them, and the first ones of two linked fingerprints meet."""
    first = cut(sets.groupBy("sim").agg(F.min("fp").alias("f")), "prints")
    same = sets.join(first, "sim").select(F.col("fp").alias("a"), F.col("f").alias("b"))
    links = simhash.near_links(first.select(F.col("sim").alias("fp")))
    firsts = lambda c: first.select(F.col("sim").alias(c), F.col("f").alias(f"f_{c}"))
    near = links.join(firsts("a"), "a").join(firsts("b"), "b").select(F.col("f_a").alias("a"), F.col("f_b").alias("b"))
    return same.unionByName(near).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _compared(cells: DataFrame, similarity: float) -> DataFrame:
    """Links a, b from rows (key, i, j, side, fp, root, set): in each cell, sets of side 0 against sets of side 1."""

    def compare(rows):
        import pandas as pd

        x, y = rows[rows.side == 0], rows[rows.side == 1]
        if not len(x) or not len(y):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        sx, sy = x.set.map(len).to_numpy(), y.set.map(len).to_numpy()
        fx, fy = np.concatenate(x.set.to_list()), np.concatenate(y.set.to_list())
        shared = np.intersect1d(fx, fy)
        both = np.zeros((len(x), len(y)), np.float32)
        px, py = np.searchsorted(shared, fx), np.searchsorted(shared, fy)
        rx, ry = np.repeat(np.arange(len(x)), sx), np.repeat(np.arange(len(y)), sy)
        okx = (px < len(shared)) & (shared[np.minimum(px, len(shared) - 1)] == fx) if len(shared) else np.zeros(len(fx), bool)
        oky = (py < len(shared)) & (shared[np.minimum(py, len(shared) - 1)] == fy) if len(shared) else np.zeros(len(fy), bool)
        px, rx, py, ry = px[okx], rx[okx], py[oky], ry[oky]
        for at in range(0, len(shared), 4096):
            mx, my = np.zeros((len(x), 4096), np.float32), np.zeros((len(y), 4096), np.float32)
            inx, iny = (px >= at) & (px < at + 4096), (py >= at) & (py < at + 4096)
            mx[rx[inx], px[inx] - at] = 1
            my[ry[iny], py[iny] - at] = 1
            both += mx @ my.T
        alike = both >= similarity * (sx[:, None] + sy[None] - both) - 1e-9
        alike &= x.root.to_numpy()[:, None] != y.root.to_numpy()[None]
        i, j = np.nonzero(alike)
        names = np.concatenate([x.fp.to_numpy(), y.fp.to_numpy()])
        order, place = np.unique(names, return_inverse=True)
        root = simhash.local_roots(len(order), iter([(place[i], place[len(x) + j])]))
        moved = np.flatnonzero(root != np.arange(len(order)))
        return pd.DataFrame({"a": order[moved], "b": order[root[moved]]})

    return cells.groupBy("key", "i", "j").applyInPandas(compare, "a long, b long")


def near_links(rows: DataFrame, sets: DataFrame, text: str, words: int, similarity: float) -> DataFrame:
    """Links a, b that join all distinct sets (fp) of candidates with at least the similarity. rows: fp and text; sets: fp, sim, size, keys of each fp once."""
    bands = sets.select("fp", F.explode("keys").alias("key"))
    heads = bands.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("h")).where("n > 1").select("key", "h")
    group = cut(bands.join(heads, "key").join(sets.select("fp", "size"), "fp").select("key", "fp", "size", "h"), "group")
    stars = group.where(F.col("fp") != F.col("h")).select(F.col("fp").alias("a"), F.col("h").alias("b"))
    stars = cut(stars.unionByName(_simhash_stars(sets)).distinct(), "stars")
    wanted = group.select("fp").unionByName(stars.select(F.explode(F.array("a", "b")).alias("fp")))
    found = cut(_sets_of(rows, text, wanted, words), "sets")
    first = cut(_alike(stars, found, similarity), "first")
    # What a group's head does not join may still be close to another of the group: those outside its largest part meet all of other parts.
    root = components(first, "a", "b")
    parts = group.join(root, F.col("fp") == F.col("node"), "left").select("key", "fp", "size", F.coalesce("root", "fp").alias("root"))
    part = parts.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    most = part.groupBy("key").agg(F.count("*").alias("roots"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("n").alias("top")).where("roots > 1")
    main = part.join(most.select("key", "top"), "key").where("n = top").groupBy("key").agg(F.min("root").alias("main"), F.min("n").alias("mn"), F.min("s").alias("ms"))
    most = most.join(main, "key").withColumns({"xn": F.col("n") - F.col("mn"), "xs": F.col("s") - F.col("ms")})
    parts = cut(parts.join(most.select("key", "main", "n", "s", "xn", "xs"), "key"), "parts")
    few = F.col("xn") * F.col("n") <= FEW
    x = parts.where(few & (F.col("root") != F.col("main"))).select("key", F.col("fp").alias("x"), F.col("size").alias("xsize"), F.col("root").alias("xr"))
    y = parts.where(few).select("key", F.col("fp").alias("y"), F.col("size").alias("ysize"), F.col("root").alias("yr"))
    fit = F.least("xsize", "ysize") >= similarity * F.greatest("xsize", "ysize") - 1e-9
    across = x.join(y, "key").where((F.col("xr") != F.col("yr")) & fit).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
    links = first.unionByName(_alike(across.join(stars, ["a", "b"], "left_anti"), found, similarity))
    blocks = lambda n, s: F.greatest(F.ceil(F.col(n) / BLOCK_ROWS), F.ceil(F.col(s) / BLOCK_HASHES), F.lit(1)).cast("int")
    large = parts.where(~few).withColumns({"bx": blocks("xn", "xs"), "by": blocks("n", "s")})
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda n: F.pmod(F.xxhash64("fp", "key"), F.col(n)).cast("int")
    xs = large.where("root <> main").withColumn("j", every("by")).select("key", place("bx").alias("i"), "j", F.lit(0).alias("side"), "fp", "root")
    ys = large.withColumn("i", every("bx")).select("key", "i", place("by").alias("j"), F.lit(1).alias("side"), "fp", "root")
    return links.unionByName(_compared(xs.unionByName(ys).join(found, "fp"), similarity))


def keep_one(docs: DataFrame, *, id: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, one of each class of texts linked by the similarity: that of the smallest id (null ids last; of equal ids, the smallest hash of the row; of equal rows, any).

    Null, empty and blank texts have the empty set and are one class.
    """
    names = {c: f"c_{i}" for i, c in enumerate(docs.columns)}  # so that a column called fp cannot clash
    rows = sketches(docs.withColumnsRenamed(names), list(names.values()), names[text], words)
    rows = rows.withColumns({"rid": F.monotonically_increasing_id(), "hash": F.xxhash64(*(F.col(n) for n in names.values()))})
    rows = cut(rows, "sketches")  # the number of a row is fixed once written
    best = F.min(F.struct(F.col(names[id]).isNull().alias("none"), F.col(names[id]).alias("low"), "hash", "rid")).alias("r")
    sets = cut(rows.groupBy("fp").agg(best, F.first("sim").alias("sim"), F.first("size").alias("size"), F.first("keys").alias("keys")), "distinct")
    comp = components(near_links(rows, sets, names[text], words, similarity), "a", "b")
    named = sets.join(comp, F.col("fp") == F.col("node"), "left").select("r", F.coalesce("root", "fp").alias("root"))
    first = named.groupBy("root").agg(F.min("r").alias("r")).select("r.rid")
    return rows.join(first, "rid", "left_semi").select(*(F.col(n).alias(c) for c, n in names.items()))
