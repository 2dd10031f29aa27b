import hashlib
import math

import numpy as np
import pytest
from conftest import SF
from loomseq.llm import clustering as C


def plain(rows, clusters, rounds, dim, scale):
    """rows: (id, vector). The contract, in Python's whole numbers."""
    kept = [(i, [max(-(1 << 63), min(C.LONG, math.floor(min(max(c * scale, -float(1 << 63)), float((1 << 63) - 1024))))) for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    cents = [v for _, v in first[:clusters]]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in cents]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        near = [a for a, _ in assign()]
        for k in range(len(cents)):
            mine = [v for (_, v), a in zip(kept, near, strict=True) if a == k]
            if mine:
                cents[k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    near = [(a, min(d, C.LONG)) for a, d in assign()] if cents else []
    spread = {}
    for a, d in near:
        spread[a] = spread.get(a, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted([(i, a, d, min(spread[a], C.LONG), min(sum(spread.values()), C.LONG), sha[a]) for (i, _), (a, d) in zip(kept, near, strict=False)], key=str)


@pytest.mark.parametrize("width, chunk", [(1, 16384), (3, 17), (8, 64)])
def test_equals_plain_clusters(spark, width, chunk):
    rng = np.random.default_rng(2)
    rows = [(int(i), rng.normal(i % 5, 0.4, 8).tolist()) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 360)] + [(5, [0.5] * 8), (None, [0.1] * 8), (901, None), (902, [1.0] * 7), (903, [None] + [1.0] * 7), (904, [float("nan")] * 8), (905, [float("-inf")] * 8), (906, [])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, id string")
    got = sorted([tuple(r) for r in C.centroid_clusters(df, clusters=4, rounds=5, dim=8, width=width, chunk=chunk).collect()], key=str)
    assert got == plain(rows, 4, 5, 8, 1024)


def test_sizes_beyond_a_long_stay_exact(spark):
    rows = [(0, [1e15, 1.0]), (1, [1e15, 2.0]), (2, [-1e300, 3.0]), (3, [1e300, 4.0]), (4, [0.001, -7.0]), (5, [2.0, 1e9])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted([tuple(r) for r in C.centroid_clusters(df, clusters=3, rounds=3, dim=2).collect()], key=str)
    assert got == plain(rows, 3, 3, 2, 1024)


def test_empty_few_and_without_ids(spark):
    df = spark.createDataFrame([(1, [0.5] * 64), (2, [0.25] * 64)], "vec_id long, embedding array<float>")
    assert C.centroid_clusters(df.limit(0)).count() == 0
    assert sorted((r.vec_id, r.distance) for r in C.centroid_clusters(df).collect()) == [(1, 0), (2, 0)]
    assert C.centroid_clusters(df.selectExpr("CAST(NULL AS BIGINT) AS vec_id", "embedding")).count() == 0


@pytest.mark.parametrize("width", [1, 2, 5])
def test_dictionaries_lose_nothing(width):
    x = np.random.default_rng(0).integers(-3, 4, (200, 11))
    c = C.Chunk.encode(x, width)
    assert (c.decode() == x).all() and sum(len(d) for d in c.dictionaries) < x.size
    near, far = c.nearest([[0] * 11, [1] * 11])
    assert (far == np.minimum((x**2).sum(1), ((x - 1) ** 2).sum(1))).all()
    assert c.sums(near, 2) == [x[near == k].sum(0).tolist() for k in range(2)]


def test_query_equals_plain_clusters(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted([tuple(r) for r in C.op12_centroid_clusters(spark, SF).collect()], key=str) == plain(rows, 8, 10, 64, 1024)
