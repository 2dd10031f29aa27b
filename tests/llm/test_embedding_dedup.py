import numpy as np
import pandas as pd
import pytest
from conftest import SF
from loomseq.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<double>, node int, cell int, w int, rep int, root string"


def plain(ids, vecs, threshold=0.9):
    """n_links and component of every row, by all pairs."""
    fine = [i for i, v in enumerate(vecs) if ids[i] is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    dim = max((len(vecs[i]) for i in fine), default=1)
    x = np.array([np.pad(np.array(vecs[i], float) / np.abs(vecs[i]).max(), (0, dim - len(vecs[i]))) for i in fine]).reshape(len(fine), dim)
    x /= np.sqrt((x * x).sum(1))[:, None]
    near = x @ x.T >= threshold
    root = {i: i for i in fine}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in zip(*np.nonzero(near), strict=True):
        root[max(top(fine[a]), top(fine[b]))] = min(top(fine[a]), top(fine[b]))
    links = {i: int(near[n].sum()) - 1 for n, i in enumerate(fine)}
    least = {}
    for i in fine:
        least[top(i)] = min(least.get(top(i), ids[i]), ids[i])
    return sorted(((ids[i], links.get(i, 0), least[top(i)] if i in root else ids[i]) for i in range(len(ids))), key=str)


def rows_of(df):
    got = df.collect()
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str)


def frame(spark, vecs, ids=None):
    ids = list(range(len(vecs))) if ids is None else ids
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], 1, 2, 3, 4, "x") for i, v in zip(ids, vecs, strict=True)]
    return spark.createDataFrame(rows, SCHEMA), ids


@pytest.mark.parametrize("cell, block", [(1024, 1024), (40, 16)])
def test_groups_of_all_widths_equal_all_pairs(spark, cell, block):
    rng = np.random.default_rng(3)
    vecs = []
    for size, spread in ((120, 0.01), (90, 0.045), (60, 0.08), (40, 0.12)):  # a tight group, one about the threshold's angle wide, looser ones
        c = rng.normal(size=16)
        vecs += (c / np.linalg.norm(c) + rng.normal(0, spread, (size, 16))).tolist()
    vecs += rng.normal(size=(150, 16)).tolist() + [vecs[0]] * 70 + [[c * 1e-200 for c in vecs[3]], [c * 1e200 for c in vecs[3]]]
    order = rng.permutation(len(vecs))
    df, ids = frame(spark, [vecs[i] for i in order])
    got = rows_of(E.near_duplicates(df, cell=cell, block=block, probes=100))
    assert got == plain(ids, [vecs[i] for i in order])


def test_recall_of_the_index_with_production_probes(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6000, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    z = rng.normal(size=(2000, 64))
    z -= (z * base[:2000]).sum(1)[:, None] * base[:2000]
    z /= np.linalg.norm(z, axis=1)[:, None]
    cos = rng.uniform(0.9, 0.99, 2000)[:, None]
    x = np.concatenate([base, cos * base[:2000] + np.sqrt(1 - cos**2) * z])
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(len(x)), "embedding": x.tolist()}), "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in E.near_duplicates(df, cell=200).collect()}
    true = ((x / np.linalg.norm(x, axis=1)[:, None]) @ (x / np.linalg.norm(x, axis=1)[:, None]).T >= 0.9).sum(1) - 1
    assert all(got[i] <= t for i, t in enumerate(true.tolist()))
    assert sum(got.values()) >= 0.95 * true.sum() > 3000


def test_odd_vectors_ids_and_widths(spark):
    vecs = [None, [], [0.0, -0.0], [None, 1.0], [float("nan"), 1.0], [float("inf")], [1.0, 0.0], [2.0], [1.0, 0.0], [0.9, 0.43588989], [0.9, -0.43588990], [-1.0, 0.0], [5.0, 0.1], [1.0] * 3000, [1.0] * 2990, [0.0, 1.0]]
    ids = [*range(12), None, 12, 13, 3]
    df, ids = frame(spark, vecs, ids)
    assert rows_of(E.near_duplicates(df)) == plain(ids, vecs)


def test_repeated_ids_are_rows_of_their_own(spark):
    df, ids = frame(spark, [[1.0, 0.0], [0.0, 1.0], [1.0, 0.01], [1.0, 0.0]], [5, 5, 7, 5])
    assert rows_of(E.near_duplicates(df)) == sorted([(5, 2, 5), (5, 0, 5), (7, 2, 5), (5, 2, 5)])


def test_empty_tables_and_tables_without_vectors(spark):
    df, _ = frame(spark, [[1.0]])
    assert E.near_duplicates(df.limit(0)).count() == 0
    df, _ = frame(spark, [None, [0.0]])
    assert rows_of(E.near_duplicates(df)) == [(0, 0, 0), (1, 0, 1)]


def test_query_equals_all_pairs(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    assert rows_of(E.op11_embedding_dedup(spark, SF)) == plain([r.vec_id for r in rows], [r.embedding for r in rows])


def test_centres_lie_apart():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 8))
    x = np.concatenate([x, x[:1] + rng.normal(0, 1e-3, (500, 8))])
    c = E.fit(E._unit(x), 64)
    assert len(c) <= 64 and (np.triu(c @ c.T, 1) < 0.8).all()
