import numpy as np
import pandas as pd
import xxhash
from conftest import DOCS, SF
from loomseq.llm.simhash import fingerprint, near_duplicates, near_links, op8_simhash_dedup


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - 2)
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, prints):
    root = dict(zip(ids, ids, strict=True))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                p, q = find(a), find(ids[j])
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def test_query_equals_brute_force(spark, docs):
    got = op8_simhash_dedup(spark, SF).toPandas().set_index("doc_id")
    rows = docs.toPandas().sort_values("doc_id")
    prints = [plain_print(t) for t in rows.text]
    assert [f"{p:016x}" for p in prints] == got.loc[rows.doc_id, "fingerprint"].tolist()
    assert plain_components(rows.doc_id.tolist(), prints) == got.component_id.to_dict()


def test_nulls_ties_empty_and_extra_columns(spark):
    rows = [(3, None), (1, ""), (2, " \t"), (5, "a b c d"), (4, "A  B c d"), (4, "a b c d"), (None, "zz"), (7, "zz")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, fp int, component_id string")
    got = near_duplicates(df).toPandas()
    assert len(got) == len(rows)
    assert set(got[got.fp == 0].component_id) == {1}
    assert sorted(got[got.component_id == 4].doc_id) == [4, 4, 5]
    assert set(got[got.doc_id.isna()].component_id) == {7}
    assert near_duplicates(df.limit(0)).count() == 0


def test_links_lose_nothing_in_hot_groups(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    prints = set()
    for b in base:
        for _ in range(150):
            x = int(b)
            for bit in rng.choice(64, rng.integers(0, 4), replace=False):
                x ^= 1 << int(bit)
            prints.add(x)
    prints = sorted(prints)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    df = spark.createDataFrame(pd.DataFrame({"fp": signed}))
    want = plain_components(list(range(len(prints))), prints)
    for hot in (4096, 10):  # both the plain and the divided groups
        links = near_links(df, hot).toPandas()
        index = {s: i for i, s in enumerate(signed)}
        root = list(range(len(prints)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links.itertuples(index=False):
            assert (prints[index[a]] ^ prints[index[b]]).bit_count() < 64
            p, q = find(index[a]), find(index[b])
            root[max(p, q)] = min(p, q)
        assert {i: find(i) for i in range(len(prints))} == want


def test_long_text():
    text = ("lorem ipsum dolor " * 50_000).encode()
    assert fingerprint(text, xxhash.xxh64_intdigest) == (lambda p: p - 2**64 if p >= 2**63 else p)(plain_print(text.decode()))
    assert DOCS
