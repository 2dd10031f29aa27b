"""What the corpus operators share: text mapping, cut tables, batch Viterbi.

Every operator takes DataFrames and column names, reads only the columns it
names, and returns the columns it names, so that further columns of the input
(whatever they are called) never clash with its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the word contracts: space and U+0009 to U+000D. It is what bytes.split() splits at.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a task handles at once; a longer text is a batch of its own.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n. A null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def fold_of(key: object, n: int) -> int:
    return zlib.crc32(("" if key is None else str(key)).encode()) % n


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive pieces of at most about `most` bytes of its last column; one longer text is a piece alone."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at, done = 0, 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(size, done + most, side="right")))
        yield batch.slice(at, to - at)
        at, done = to, int(size[to - 1])


def decoded(text: bytes | None) -> str | None:
    """A byte that is not UTF-8 becomes U+FFFD."""
    return None if text is None else text.decode("utf-8", "replace")


def map_text(df: DataFrame, text: str, keep: list[str], fields: list[T.StructField], begin: Callable, *, most: int = SLICE_BYTES) -> DataFrame:
    """Columns `keep` of df and the new `fields`, one output row for each input row, without a shuffle.

    begin() runs once in each task and returns fn(texts), which gives one list
    (or array) for each field. texts are bytes; a null text is None. Batches are
    cut to `most` bytes, so memory is bounded by the longest text.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([df.schema[c] for c in keep] + fields)
    kinds = [f.type for f in to_arrow_schema(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = begin()
        for batch in batches:
            for part in slices(batch, most):
                new = fn(part.column(part.num_columns - 1).cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(i).cast(kinds[i]) for i in range(len(keep))] + [x.cast(t) if isinstance(x, pa.Array) else pa.array(x, type=t) for x, t in zip(new, kinds[len(keep):], strict=True)],
                    names=schema.names,
                )

    return df.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def viterbi(emit: np.ndarray, lengths: np.ndarray, trans: np.ndarray | float) -> np.ndarray:
    """Best state of every position of many sequences at once (int32).

    emit: (N, S) scores of all sequences, one after another; lengths: how long
    each is; trans: (S, S) score of going from a state to another, or one
    penalty that every change of state costs: then a state comes from itself or
    from the best one, S steps instead of S x S. The loop is over positions; all
    sequences that are long enough move together. Ties go to the smaller state,
    and with a penalty to staying.
    """
    n, s = emit.shape
    path = np.zeros(n, np.int32)
    if not n:
        return path
    order = np.argsort(-lengths, kind="stable")
    long = lengths[order]
    start = (np.cumsum(lengths) - lengths)[order]
    top = int(long[0])
    active = np.searchsorted(-long, -np.arange(top), side="left")  # sequences longer than t
    alike = np.isscalar(trans)
    back = np.zeros((n, s), bool if alike else np.uint8 if s <= 256 else np.int32)  # with a penalty: whether the state was changed to
    source = np.zeros(n, np.int32)  # and the state that all changes at a position come from
    best = emit[start[: active[0]]].astype(np.float32)
    last = np.zeros((len(long), s), np.float32)
    last[: active[0]] = best
    for t in range(1, top):
        k = active[t]
        at = start[:k] + t
        if alike:
            b = last[:k].argmax(1)
            most = np.take_along_axis(last[:k], b[:, None], 1) - np.float32(trans)
            back[at] = most > last[:k]
            source[at] = b
            last[:k] = np.maximum(last[:k], most) + emit[at]
        else:
            cand = last[:k, :, None] + trans[None]
            b = cand.argmax(1)
            back[at] = b
            last[:k] = np.take_along_axis(cand, b[:, None, :], 1)[:, 0] + emit[at]
        last[:k] -= last[:k].max(1, keepdims=True)  # the path is the same, and single precision lasts for any length
    state = last.argmax(1)
    for t in range(top - 1, -1, -1):
        k = active[t]
        at = start[:k] + t
        path[at] = state[:k]
        if t:
            came = back[at, state[:k]]
            state[:k] = np.where(came, source[at], state[:k]) if alike else came
    return path


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, vectorized: spreads integers over all bits."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
    return x


def sha_of(items: Column) -> Column:
    """Lowercase hex SHA-256 of the strings of an array, joined by commas."""
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)
