import numpy as np
import pandas as pd
import pytest
from conftest import SF
from loomseq.llm.topk import CoverTree, Search, Side, op5_exact_top_k, quantized, top_k


def plain(ids, vecs, q_ids, q_vecs, k):
    out = set()
    for i, q in zip(q_ids, q_vecs, strict=True):
        s = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in zip(ids, vecs, strict=True) if j != i)
        out |= {(i, r + 1, j, -x) for r, (x, j) in enumerate(s[:k])}
    return out


def test_query_equals_brute_force(spark):
    rows = quantized(spark.read.parquet(f"{SF}/embeddings.parquet")).collect()
    ids, vecs = [r.vec_id for r in rows], [r.embedding for r in rows]
    own = [i for i, x in enumerate(ids) if x % 20 == 0]
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in op5_exact_top_k(spark, SF).collect()}
    assert got == plain(ids, vecs, [ids[i] for i in own], [vecs[i] for i in own], 20)


@pytest.mark.parametrize("block, chunk", [(7, 50), (10_000, 4096)])
def test_clusters_ties_short_and_odd_vectors(spark, block, chunk):
    rng = np.random.default_rng(1)
    centre = rng.normal(0, 3, (5, 6))
    vecs = [(centre[rng.integers(5)] + rng.normal(0, 0.05, 6)).tolist() for _ in range(400)]
    vecs += [vecs[0]] * 60 + [[1.0], [], [5000.0] * 6]
    odd = [None, [None, 1.0], [float("nan")] * 6, [float("inf")] * 6]
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(len(vecs) + 4), "embedding": vecs + odd, "rank": 1, "score": 2}), "vec_id long, embedding array<double>, rank int, score int")
    v = quantized(df)
    assert v.count() == len(vecs)
    whole = [[int(np.floor(64 * c)) for c in x] for x in vecs]
    q = list(range(0, len(vecs), 20)) + [401]
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(v, v.where(v.vec_id.isin(q)), k=9, most=block, chunk=chunk).collect()}
    assert got == plain(range(len(vecs)), whole, q, [whole[i] for i in q], 9)


def test_empty_and_fewer_than_k(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, -1.0]), (None, [1.0, 1.0])], "vec_id long, embedding array<float>")
    v = quantized(df)
    assert {(r.query_id, r["rank"], r.vec_id) for r in top_k(v, v).collect()} == {(0, 1, 1), (1, 1, 0)}
    assert top_k(v.limit(0), v).count() == 0 and top_k(v, v.limit(0)).count() == 0


def test_pruning_skips_far_nodes():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(-5, 5, (500, 8)) + c for c in (-2000, 0, 2000)]).astype(np.int64)
    tree = CoverTree(x[::7])
    run = Search(tree, np.array([-1]), x[-1:], 3, np.array([np.sort(x[::7] @ x[-1])[-3]]))
    row, vec, score = run.run(Side(tree, tree.assign(x.astype(float)), x.astype(float)), np.arange(len(x)), x)
    assert sorted(score.tolist()) == sorted((x @ x[-1]).tolist())[-3:]


def test_a_query_id_with_two_vectors_has_two_rankings(spark):
    data = spark.createDataFrame([(i, [i, 1]) for i in range(10)], "vec_id long, embedding array<long>")
    asked = spark.createDataFrame([(0, [1, 0]), (0, [-1, 0]), (0, [1, 0])], "vec_id long, embedding array<long>")
    got = sorted((r["rank"], r.vec_id, r.score) for r in top_k(data, asked, k=2).collect())
    assert got == [(1, 1, -1), (1, 9, 9), (2, 2, -2), (2, 8, 8)]


def test_very_wide_vectors_and_many_blocks_of_queries(spark):
    rng = np.random.default_rng(8)
    vecs = rng.integers(-5, 6, (30, 6000)).tolist() + [[7] * 9000]
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(31), "embedding": vecs}), "vec_id long, embedding array<long>")
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(df, df.where("vec_id % 3 = 0"), k=4, most=2, chunk=5).collect()}
    q = [i for i in range(31) if i % 3 == 0]
    assert got == plain(range(31), vecs, q, [vecs[i] for i in q], 4)
