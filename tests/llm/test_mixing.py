import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from conftest import DOCS, SF
from loomseq.llm.mixing import mix, op3_mixing


def plain_targets(size):
    names = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in size)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    full = set()
    while True:
        left = sum(size.values()) - sum(3 * size[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        want = {s: 3 * size[s] if s in full else left * weight[s] / share for s in names}
        over = {s for s in names if want[s] > 3 * size[s] * (1 + 1e-12)}
        if not over:
            return want
        full |= over


def check(rows, texts, near):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in texts}
    per = defaultdict(int)
    for i, _, s in texts:
        per[s] += size[i]
    want, took = plain_targets(per), defaultdict(int)
    for r in rows:
        s = r.source
        assert (r.size, r.source_size) == (size[r.doc_id], per[s]) and r.target == pytest.approx(want[s])
        assert 0 <= r.copies <= 3
        took[s] += r.copies * r.size
    for s in per:
        assert abs(took[s] - want[s]) <= near * want[s] + 2 * max(size[i] for i, _, x in texts if x == s)


def test_targets_and_taken_words(spark, docs):
    texts = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    rows = mix(docs, keep=["doc_id", "source"]).collect()
    check(rows, texts, 0.02)
    again = mix(docs.repartition(7), keep=["doc_id", "source"]).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    assert op3_mixing(spark, SF).count() == len(texts)


def test_caps_nulls_empty_and_hot_source(spark):
    texts = [(i, "w " * (i % 50 + 1), "hot") for i in range(3000)]
    texts += [(4000 + i, "a\x0bb c d e", s) for i, s in enumerate(["a", "b", None, "é", "\U0001f600", "￮"] * 40)]
    texts += [(5000, None, "b"), (5001, "", "zero"), (5002, " \n", "zero")]
    df = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in texts], DOCS)
    check(mix(df, keep=["doc_id", "source"]).collect(), texts, 0.02)


def test_empty_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", "x", 9)] * 4 + [(None, "a b", None, 9)], "doc_id long, text string, source string, size int")
    rows = mix(df, keep=["doc_id"]).collect()
    assert len(rows) == 5 and all(r["size"] == 2 for r in rows)
    assert mix(df.limit(0), keep=["doc_id"]).count() == 0
    assert len(mix(df.limit(1).withColumn("text", df.text.substr(9, 1)), keep=["doc_id"]).collect()) == 1


def test_null_ids_and_equal_ids_do_not_depend_on_the_order_of_rows(spark):
    rows = [(None if i % 2 else 7, "w " * (i % 5 + 1) + f"t{i}", "en", "a" if i % 3 else "b", 0) for i in range(600)] + [(1, "long " * 300_000, "en", "c", 0)]
    df = spark.createDataFrame(rows, DOCS)
    got = sorted((r.text, r.copies) for r in mix(df, keep=["text", "source"]).collect())
    assert got == sorted((r.text, r.copies) for r in mix(df.orderBy(F.desc("text")).repartition(3), keep=["text", "source"]).collect())
    assert max(r["size"] for r in mix(df, keep=[]).collect()) == 300_000
