"""Alignments of pairs and chains of seeds, a kernel over each Arrow batch or group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomseq.functions.edits import QUERY_END, TARGET_END, chain, codes, semiglobal_edits, stacked

#: Bases (query by target) that a step of the batch kernel may pad to.
PADDED = 1 << 24


def semiglobal_identity(df: DataFrame, query: str, target: str, out: str) -> DataFrame:
    """df with `out`: 1 - fewest edits of the query against any piece of the target, by the query's length, 0 at least; 0 for an empty or null side. Pairs of like size are computed together, so padding stays small."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])
    names = to_arrow_schema(schema).names
    at = [df.columns.index(c) for c in (query, target)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, t = ([codes(s or "") for s in b.column(i).to_pylist()] for i in at)
            n, m = (np.array([len(x) for x in side], np.int64) for side in (q, t))
            value = np.zeros(b.num_rows)
            todo = np.flatnonzero((n > 0) & (m > 0))
            todo = todo[np.lexsort((n[todo], m[todo]))]
            while len(todo):
                k = 1
                while k < len(todo) and (k + 1) * max(int(n[todo[: k + 1]].max()), 1) * int(m[todo[k]]) <= PADDED and m[todo[k]] <= 2 * m[todo[0]]:
                    k += 1
                part, todo = todo[:k], todo[k:]
                d = semiglobal_edits(stacked([q[i] for i in part], QUERY_END), stacked([t[i] for i in part], TARGET_END), n[part], m[part])
                value[part] = np.clip(1 - d / np.maximum(1, n[part]), 0, 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(value)], names=names)

    return df.mapInArrow(run, schema)


def chain_scores(hits: DataFrame, keys: list[str], k: int) -> DataFrame:
    """keys, score and coverage of the best chain of a group's seeds. hits: keys, query_pos, target_pos, weight, query_len. A group is the seeds of two sequences; its time is the square of their number."""
    kinds = ", ".join(f"`{c}` {hits.schema[c].dataType.simpleString()}" for c in keys)
    rows = hits.where(F.col("query_pos").isNotNull() & F.col("target_pos").isNotNull() & F.col("weight").isNotNull()).select(*keys, "query_pos", "target_pos", "weight", "query_len")

    def run(g):
        import pandas as pd

        score, covered = chain(g.query_pos.to_numpy(), g.target_pos.to_numpy(), g.weight.to_numpy(), int(g.query_len.iloc[0] or 0), k)
        return pd.DataFrame({**{c: g[c].iloc[:1].to_numpy() for c in keys}, "score": [score], "coverage": [covered]})

    return rows.groupBy(*keys).applyInPandas(run, f"{kinds}, score double, coverage double")


def family_prefilter(scores: DataFrame, query: str, family: str, total: str, score: str, coverage: str, most: int) -> DataFrame:
    """query, family and prefilter: 0.6 of the best normed chain score of a family's representatives, 0.2 of the second, 0.2 of the best one's coverage; the best `most` families of a query (one at least), ties to the smaller family."""
    from pyspark.sql import Window

    norm = F.col(score) / F.col(total)
    best = F.slice(F.sort_array(F.collect_list(F.struct(norm.alias("n"), F.col(coverage).alias("c"))), asc=False), 1, 2)  # representatives of a family are few
    got = scores.where(F.col(total) > 0).groupBy(query, family).agg(best.alias("b"))
    value = 0.60 * F.get("b", F.lit(0))["n"] + 0.20 * F.coalesce(F.get("b", F.lit(1))["n"], F.lit(0.0)) + 0.20 * F.get("b", F.lit(0))["c"]
    w = Window.partitionBy(query).orderBy(F.desc("prefilter"), F.asc(family))
    return got.select(query, family, value.alias("prefilter")).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= max(1, most)).drop("__n")
