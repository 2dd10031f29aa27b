import numpy as np
from conftest import SF
from loomseq.llm.toxicity import LabelModel, learn, op1_toxicity, score_toxicity


def test_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.1")
    got = op1_toxicity(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert len(held) > 500
    assert ((held.predicted == 1) & (held.toxic == 1)).sum() >= 0.9 * (held.toxic == 1).sum()  # some labelled texts hold nothing that tells
    assert ((held.predicted == 1) & (held.toxic == 0)).sum() <= 0.02 * (held.toxic == 0).sum()
    assert held.score.between(0, 1).all()


def test_label_model_recovers_accuracies_and_discounts_copies():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    votes = np.stack([rng.random(4000) < np.where(y, a, b) for a, b in ((0.8, 0.1), (0.5, 0.2), (0.6, 0.05))], 1).astype(float)
    votes = np.c_[votes, votes[:, 1], votes[:, 1]]  # a voter three times
    noisy = np.where(rng.random(4000) < 0.9, y, ~y).astype(int)
    m = LabelModel(votes, noisy)
    assert abs(m.hit[0] - 0.8) < 0.1 and abs(m.false[0] - 0.1) < 0.06
    assert sorted(m.parent[[1, 3, 4]].tolist())[1:] != [-1, -1] and sum(p in (1, 3, 4) for p in m.parent[[1, 3, 4]]) == 2  # copies hang on each other
    once = LabelModel(votes[:, :3], noisy)
    assert np.abs(m.posterior - once.posterior).mean() < 0.02 and 0.85 < m.trust < 0.97
    assert ((m.posterior > 0.5) == y).mean() > 0.92


def test_shapes_nulls_and_clashing_columns(spark):
    rows = [(i, "a fine day " * 5 + ("you utter zork" if i % 4 == 0 else "with some tea"), 0.1) for i in range(80)] + [(90, None, 0.1), (91, "", 0.1), (None, "zork", 0.1), (92, "ZORK! " * 30_000, 0.1), (1, "a day", 0.1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), None) for i in range(80)] + [(None, 1, 2), (5, None, 1), (91, 7, 1)], "doc_id long, toxic int, quality int")
    got = score_toxicity(df, learn(df, labels), keep=["doc_id"]).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r.predicted for r in got}
    assert by_id[0] == 1 and by_id[3] == 0 and by_id[None] == 1 and by_id[92] == 1 and by_id[90] == 0 and by_id[91] == 0
    assert {r.score for r in score_toxicity(df, learn(df, labels.limit(0)), keep=["doc_id"]).collect()} == {0.5}
    assert score_toxicity(df.limit(0), learn(df.limit(0), labels), keep=["doc_id"]).count() == 0


def test_query_equals_plain_scores(spark):
    """The query's scores from the fitted units and weights, each text by itself in plain Python."""
    import math
    import re

    from loomseq.llm.common import fold
    from loomseq.llm.toxicity import PATTERNS
    from pyspark.sql import functions as F

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    s = learn(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    got = {r.doc_id: r for r in op1_toxicity(spark, SF).collect()}
    assert len(got) == docs.count() and s.voters.units
    for r in docs.collect():
        text = (r.text or "").encode()
        words = re.findall(rb"[a-z\x80-\xff]+", text.lower())
        counts = [sum(w.startswith(u[:-1]) if u.endswith(b"*") else w == u for w in words) for u in s.voters.units]
        hits, total = sum(c > 0 for c in counts), sum(counts)
        counts += [len(list(re.finditer(p, text))) for p in PATTERNS]
        x = [math.log1p(c) for c in counts] + [float(hits > 0), math.log1p(total), math.log1p(1000 * total / max(1, len(words)))]
        want = 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(x, s.w.tolist(), strict=True)) + float(s.b)))))
        g = got[r.doc_id]
        assert abs(g.score - want) < 1e-4 and g.predicted == int(g.score >= 0.5)


def test_texts_too_long_for_the_fit_do_not_shrink_the_sample(spark):
    docs = spark.createDataFrame([(i, ("zork " if i % 2 else "tea ") + "x " * (3000 if i < 40 else 3)) for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    s = learn(docs, labels, most=40, longest=1000)
    assert len(s.voters.units) and {r.predicted for r in score_toxicity(docs.where("doc_id % 2 = 1 AND doc_id >= 40"), s, keep=[]).collect()} == {1}


def test_shouts_are_counted_in_linear_time_as_the_pattern_counts_them():
    import random
    import re
    import time

    from loomseq.llm.toxicity import PATTERNS, _shouts

    rng = random.Random(3)
    for _ in range(4000):
        t = "".join(rng.choice("ABCDEFab! é1") for _ in range(rng.randint(0, 40))).encode()
        assert _shouts(t) == len(re.findall(PATTERNS[1], t))
    at = time.time()
    assert [_shouts(t) for t in (b"A" * 1_000_000, b"ABCD " * 200_000, b"A" * 1_000_000 + b"!", b"ABC! " * 200_000, b"aABCD!" * 100_000)] == [0, 0, 1, 0, 100_000]
    assert time.time() - at < 5
