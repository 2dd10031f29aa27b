"""Operators over calls, loci, controls and tables: brute force, nulls, ties, repeats, empty tables."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomseq.functions import alignment as A
from loomseq.functions import flanks as K
from loomseq.functions import mechanism as M
from loomseq.functions import support as P
from loomseq.operators import conformal, loci, matching, naming, sets
from loomseq.operators import reads as R
from loomseq.sources import tables

C = F.col
READS = "contig string, pos long, flag int, mapq int, cigar string, length long, sa string"


def test_signatures(spark):
    rows = [
        ("c", 1000, 0, 60, "60M80I60M", 200, None),  # an insertion
        ("c", 1000, 0, 59, "60M80I60M", 200, None),  # not sure of its place: nothing, as there is no clip
        ("c", 1000, 0, 60, "70M130S", 200, "c,1071,+,140S60M,60,1;"),  # split: 70 between the two
        ("c", 1000, 16, 60, "70M130S", 200, "c,1071,+,140S60M,60,1;"),  # the other strand: clips only
        ("c", 1000, 0, 60, "70M130S", 200, "d,1071,+,140S60M,60,1;;c,1071,+,140S60M,60,1;"),  # behind an empty record
        ("c", 2000, 0, 60, "5H30S170M19S", 219, None),  # one clip is long enough
        ("c", 2000, 2048, 60, "60M80I60M", 200, None),
        ("c", None, None, None, None, None, None),
    ]
    got = [[tuple(s) for s in r.signatures] for r in A.with_signatures(spark.createDataFrame(rows, READS)).collect()]
    assert got == [[(1060, 80, "cigar")], [], [(1070, 70, "split")], [(1070, 130, "clip")], [(1070, 130, "clip")], [(2000, 30, "clip")], [], []]


def test_query_intervals(spark):
    d = spark.createDataFrame([("30S70M", 100), ("70M30S", 100), ("100M", 100), ("90M", 100), ("20S90M", 100), (None, 100), ("10H30S60M10S", 100)], "c string, n long")
    assert [r.q and tuple(r.q) for r in d.select(A.query_interval(C("c"), C("n")).alias("q")).collect()] == [(30, 100), (0, 70), (0, 100), None, None, None, (30, 90)]


def by_definition(pos, length, intra, least):
    n = len(pos)
    near = [[(2 * (pos[i] - pos[j]) ** 2 + (length[i] - length[j]) ** 2) ** 0.5 < (loci.NEAR if intra[i] and intra[j] else loci.FAR) for j in range(n)] for i in range(n)]
    core = [sum(r) >= least for r in near]
    first = list(range(n))
    changed = True
    while changed:
        changed = False
        for i, j in itertools.product(range(n), repeat=2):
            if core[i] and core[j] and near[i][j] and first[i] != first[j]:
                first[i] = first[j] = min(first[i], first[j])
                changed = True
    number = {f: k + 1 for k, f in enumerate(sorted({first[i] for i in range(n) if core[i]}))}
    return [number[first[i]] if core[i] else max([number[first[j]] for j in range(n) if core[j] and near[i][j]], default=0) for i in range(n)]


def test_density_labels_equal_their_definition():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randrange(1, 40)
        pos = np.array(sorted(rng.randrange(3000) for _ in range(n)), float)
        length, intra = np.array([rng.randrange(50, 700) for _ in range(n)], float), np.array([rng.random() < 0.7 for _ in range(n)])
        for least in (1, 3, 5):
            assert loci.density_labels(pos, length, intra, least).tolist() == by_definition(pos, length, intra, least)


def test_density_clusters_blocks_nulls_and_empty(spark, monkeypatch):
    schema = "contig string, pos long, length long, source string, read string"
    rows = [("a", 100 + i, 90, "cigar", f"r{i}") for i in range(6)] + [("a", 90_000, 400, "split", "x"), ("b", 100, 90, "cigar", "y"), ("a", None, 1, "cigar", "z"), (None, 1, 1, "cigar", "z"), ("a", 100, 90, "cigar", "r0")]
    found = loci.density_clusters(spark.createDataFrame(rows, schema), "contig", "pos", "length", "source", "read")
    got = {(r.contig, r.start, r.end, r.anchor, r.signals, r.reads, r.split_reads) for r in loci.describe_clusters(found, "contig", "pos", "length", "source", "read").collect()}
    assert got == {("a", 100, 106, 102, 7, 6, 0), ("a", 90_000, 90_001, 90_000, 1, 1, 1), ("b", 100, 101, 100, 1, 1, 0)}
    monkeypatch.setattr(loci, "MOST", 3)  # seven signals are three blocks then
    assert loci.density_clusters(spark.createDataFrame(rows, schema), "contig", "pos", "length", "source", "read").where("contig = 'a' AND pos < 1000").select("block").distinct().count() == 3
    assert loci.density_clusters(spark.createDataFrame([], schema), "contig", "pos", "length", "source", "read").count() == 0


def test_loci_grow_from_their_head(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), x := rng.randrange(3000), x + rng.choice([0, 0, 30, 90]), rng.randrange(9)) for i in range(400)] + [(900, None, 1, 2, 3), (901, "a", None, 2, 3), (902, "a", 100, 40, 99)]
    d = spark.createDataFrame(rows, "id long, contig string, l long, r long, score long")
    want = set()
    for contig in "ab":
        head = best = None
        for i, _, x, y, s in sorted((r for r in rows if r[1] == contig and r[2] is not None), key=lambda r: (r[2], r[3], r[0])):
            x, y = min(x, y), max(x, y)
            if head is None or max(0, x - head[1], head[0] - y) > (0 if head[1] > head[0] and y > x else 50):
                if best:
                    want.add(best[1])
                head, best = (x, y), None
            if best is None or s > best[0]:
                best = (s, i)
        want.add(best[1])
    got = loci.one_of_each_locus(d, "contig", "l", "r", ["l", "r", "id"], [C("score")])
    assert {r.id for r in got.collect()} == want and got.columns == d.columns
    assert loci.one_of_each_locus(d.limit(0), "contig", "l", "r", ["l", "r", "id"], [C("score")]).count() == 0


def test_one_to_one_matches_equal_the_greedy_order(spark):
    rng = random.Random(3)
    calls = [(rng.choice("ab"), i, rng.randrange(400)) for i in range(80)] + [("a", 500, None), (None, 501, 5)]
    truth = [(rng.choice("ab"), i, rng.randrange(400)) for i in range(60)]
    pairs = sorted((abs(p - q), i, j) for c, i, p in calls for d, j, q in truth if c == d and p is not None and abs(p - q) <= 12)
    used, taken, want = set(), set(), set()
    for d, i, j in pairs:
        if i not in used and j not in taken:
            used.add(i), taken.add(j), want.add((i, j, d))
    a, b = spark.createDataFrame(calls, "contig string, call long, pos long"), spark.createDataFrame(truth, "contig string, truth long, pos long")
    got = matching.match_one_to_one(a, b, 12)
    assert {tuple(r) for r in got.collect()} == want
    empty = matching.match_one_to_one(a.limit(0), b, 12)
    assert empty.count() == 0
    s = matching.call_scores(a.limit(0).withColumn("family", F.lit("x")), b.withColumn("family", F.lit("x")), empty).first()
    assert (s.emitted, s.tp, s.fn, s.precision, s.f1, s.concordance, s.median_error) == (0, 0, 60, 0.0, 0.0, None, None)


def test_undominated_equals_all_pairs(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("ab"), x := rng.randrange(800), x + rng.choice([0, 40]), rng.randrange(4), rng.randrange(4), rng.random() < 0.3) for i in range(150)]
    d = spark.createDataFrame(rows, "id long, contig string, l long, r long, score long, cost long, promoted boolean")

    def beats(b, a):
        apart = max(0, b[2] - a[3], a[2] - b[3])
        same = a[1] == b[1] and a[0] != b[0] and apart <= (0 if a[3] > a[2] and b[3] > b[2] else 50)
        return same and b[4] >= a[4] and b[5] <= a[5] and (b[4] > a[4] or b[5] < a[5]) and not (b[6] and not a[6])

    want = {a[0] for a in rows if not any(beats(b, a) for b in rows)}
    assert {r.id for r in loci.undominated(d, "id", "contig", "l", "r", ["score"], ["cost"], "promoted").collect()} == want


FEATURES = "id long, a double, b double, cost double, ctx int"


def test_null_p_values(spark, monkeypatch):
    nulls = spark.createDataFrame([(i, float(i % 6), 0.5, 4.0, 1) for i in range(24)] + [(99, float("nan"), 1.0, 1.0, 1), (98, None, 1.0, 1.0, 1)], FEATURES)
    cands = spark.createDataFrame([(1, 20.0, 0.9, 0.0, 1), (2, 3.0, 0.5, 4.0, 2), (3, float("inf"), 0.1, 0.0, 1), (4, 3.0, 0.6, 4.0, 1)], FEATURES)
    want = {1: (24, 1 / 25), 2: (24, 13 / 25), 3: (24, 1.0), 4: (24, 13 / 25)}
    for block in (100_000, 5):
        monkeypatch.setattr(conformal, "BLOCK", block)
        assert {r.id: (r.n_null, r.p) for r in conformal.null_p_values(cands, nulls, ["a", "b"], "cost", "ctx").collect()} == want
    got = {r.id: (r.selected, r.reason) for r in conformal.conformal_select(cands, nulls, ["a", "b"], "cost", "ctx", 0.4).collect()}
    assert got[1] == (True, "PASS_CONFORMAL") and got[3] == (False, "CONFORMAL_REJECT")
    bare = conformal.conformal_select(cands, nulls.limit(0), ["a", "b"], "cost", "ctx", 0.9).collect()
    assert {(r.p, r.selected, r.reason) for r in bare} == {(1.0, False, "CONFORMAL_NULL_INSUFFICIENT")}


def test_boundaries_and_thresholds(spark):
    d = spark.createDataFrame([(0, 100, 90, 150), (0, 100, 100, 150), (0, 100, 130, 190), (0, 100, 160, 190), (0, 100, 98, 150), (-1, 5, 6, 9), (9, 9, 10, 12)], "a int, b int, c int, d int")
    got = [r.x for r in d.select(M.boundary_evidence(C("a"), C("b"), C("c"), C("d"), F.lit(70)).alias("x")).collect()]
    assert [(x.type, x.length, x.canonical, x.consistent) for x in got] == [("TSD", 10, True, True), ("BLUNT", 0, True, True), ("SMALL_DEL", 30, True, True), ("NONCANONICAL", 60, False, True), ("NONCANONICAL", 2, False, True), (None, None, False, False), (None, None, False, False)]
    assert [round(x.score, 3) for x in got] == [1.166, 1.0, 0.425, 0.25, 0.25, -2.0, -2.0]


def test_support_with_nulls(spark):
    d = spark.createDataFrame([(None, None, None, None)], "a int, b int, c int, d int")
    r = d.select(P.in_ledger(C("a")).alias("x"), P.validator_reason(C("a"), C("b"), C("c"), C("d"), C("a"), C("b")).alias("y"), P.insertion_mapq(C("a")).alias("z"), P.partial_context(C("a"), C("b"), C("c"), C("d")).alias("w")).first()
    assert tuple(r) == (False, "VALIDATOR_NO_BILATERAL_ANCHOR", False, False)


def test_flanks(spark):
    d = spark.createDataFrame([("GGGAAAATAA", "TTTACGTA", "ACGTACC", "TTACGTAACGTA"), ("", "A", "C", "")], "tail string, left string, right string, region string")
    r, e = d.select(K.pure_tail(C("tail"), "A").alias("n"), K.duplication(C("left"), C("right"), C("region"), F.lit(7)).alias("d"), K.occurrence_fraction(C("region"), C("right")).alias("f")).collect()
    assert (r.n, r.d.type, r.d.length) == (7, "UNCERTAIN", 5) and r.d.p == pytest.approx(2 / 8)
    assert (e.n, e.d.type, e.d.length, e.f) == (0, "DEL", 7, 1.0)


def test_stabbing_nearest_and_sweeps(spark):
    points = spark.createDataFrame([("c", 1, 50, "x"), ("c", 2, 51, None), (None, 3, 50, "x")], "contig string, point long, at long, family string")
    spans = spark.createDataFrame([("c", 40, 50, "x"), ("c", 50, 60, None), ("c", 51, 51, "y")], "contig string, start long, end long, family string")
    assert sorted(tuple(r)[1:] for r in matching.stabbed(points, spans).collect()) == [(1, 50, "x", 2, True), (2, 51, None, 2, False), (3, 50, "x", 0, False)]
    windows = spark.createDataFrame([("c", 1, 100, 120), ("c", 2, 900, 900)], "contig string, window long, start long, end long")
    rows = spark.createDataFrame([("c", 7, 90, 95), ("c", 5, 125, 130), ("c", 9, 110, 300)], "contig string, row long, start long, end long")
    assert sorted(tuple(r)[1:] for r in matching.nearest_rows(windows, rows, 5).collect()) == [(1, 100, 120, 3, 1, 9, 0), (2, 900, 900, 0, 0, None, None)]
    got = matching.threshold_sweep(spark.createDataFrame([(0.1, True), (0.2, False), (0.3, None), (None, True)], "s double, t boolean"), "s", "t", spark.createDataFrame([(0.05,), (0.1,), (0.3,)], "threshold double"))
    assert sorted((r.threshold, r.emitted, r.tp, r.recall) for r in got.collect()) == [(0.1, 1, 1, 0.5), (0.3, 3, 1, 0.5)]


def test_naming(spark):
    d = spark.createDataFrame([(100, [(0, 30), (20, 50), (90, 90), (60, 70)]), (0, []), (10, [(0, 20)])], "n long, s array<struct<start:long,end:long>>")
    assert [r[0] for r in d.select(naming.covered(C("n"), C("s"))).collect()] == [0.6, 0.0, 1.0]
    h = spark.createDataFrame([("q", "L1", "a", 0.9), ("q", "L1", "b", 0.9), ("q", "Alu", "c", 0.5), ("p", "Alu", None, 0.1), (None, "x", "y", 1.0)], "query string, family string, subfamily string, score double")
    got = {r["query"]: (r.family, r.subfamily, r.second_family, round(r.margin, 9), r.ambiguous) for r in naming.best_family(h).collect()}
    assert got == {"q": ("L1", "a", "Alu", 0.4, True), "p": ("Alu", None, None, 0.1, False)}


def test_reads_and_windows(spark):
    ref = R.reference_chunks(spark.createDataFrame([("c", "acgtacgtac"), ("d", ""), ("e", None)], "contig string, sequence string"), 4)
    w = spark.createDataFrame([("c", 1, 2, 7), ("c", 2, -5, 3), ("c", 3, 8, 99), ("c", 4, 4, 4), ("z", 5, 0, 4), ("d", 6, 0, 4)], "contig string, window long, start long, end long")
    assert {r.window: r.bases for r in R.windows_of(ref, w, 4).collect()} == {1: "GTACG", 2: "ACG", 3: "AC", 4: "", 5: "", 6: ""}
    names = spark.createDataFrame([("chr1",), ("1",), ("M",), ("x",)], "contig string")
    found = {r.contig: r.found for r in R.alias_of(names, "contig", spark.createDataFrame([("1",), ("chrMT",)], "r string"), "r").collect()}
    assert found == {"chr1": "1", "1": "1", "M": "chrMT", "x": None}


def lines(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1)


def test_tables(spark, tmp_path):
    t = lines(spark, "# made", "version\t2", "#contig\tpos\tFilter\textra", "c\t5\tPASS\tx", "c\t6", "c\tbad\tPASS\ty\tz", "")
    got = tables.parse_table(t, ["contig", "Filter"])
    assert got.columns == ["contig", "pos", "Filter", "extra"] and {tuple(r) for r in got.collect()} == {("c", "5", "PASS", "x"), ("c", "bad", "PASS", "y")}
    assert {tuple(r) for r in tables.parse_summary(t).collect()} >= {("version", "2")}
    with pytest.raises(ValueError):
        tables.parse_table(t, ["nothing"])
    hits = tables.best_hits(lines(spark, "a|1\tL1:P1\t0.5\t1", "b\tAlu\tx\t", "a|2\tSVA\t0.25\tNA", "short"))
    assert {tuple(r) for r in hits.collect()} == {("a", "SVA", "SVA", 0.25, None), ("b", "Alu", "Alu", None, None)}
    d = spark.createDataFrame([(1, 0.5, True, [1, 2], "a\tb"), (None, float("nan"), None, None, None)], "i long, x double, b boolean, a array<int>, s string")
    tables.write_table(d, str(tmp_path / "t"), ["s", "x", "i", "b", "a"], {"rows": 2})
    assert {tuple(r) for r in tables.read_back(spark, str(tmp_path / "t"), ["s", "x", "i", "b", "a"]).collect()} == {("a b", "0.500000", "1", "1", "2"), ("NA", "NA", "NA", "NA", "NA")}
    with pytest.raises(ValueError):
        tables.manifest(spark.createDataFrame([("s", "", "d")], "sample_id string, bam string, run_dir string"))
    assert spark.createDataFrame([("A" * 170,)], "s string").select(tables.wrapped(C("s"))).first()[0].split("\n") == ["A" * 80, "A" * 80, "A" * 10]
    vcf = lines(spark, "##x", "c\t9\ti\tN\tA\t.\tPASS\tSVTYPE=INS;n_hits=2;SVLEN=-90;repeat_ids=L1,Alu;matching_classes=LINE,SINE", "c\t9\ti\tN\tA\t.\tPASS\tSVTYPE=INS;n_hits=0;SVLEN=90", "c\t9\ti\tN\tA\t.\tPASS\tSVTYPE=DEL;n_hits=2;SVLEN=90")
    assert [tuple(r) for r in tables.assembly_truth(vcf).collect()] == [("c", 9, 90, "L1", "LINE")]
    fa = spark.createDataFrame([("i7|chr2:55|x", "acg"), ("bad", "a")], "header string, sequence string")
    assert [tuple(r) for r in tables.insert_headers(fa).collect()] == [("i7", "chr2", 55, "ACG")]
    assert tables.veto_rows(spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "id long, veto_reads array<string>")).count() == 2


def test_sets(spark):
    r = spark.createDataFrame([([" b", "a", None, ""], ["a", "c"]), (None, [])], "x array<string>, y array<string>").select(sets.names_union(C("x"), C("y")).alias("u"), sets.jaccard(sets.names_union(C("x")), C("y")).alias("j")).collect()
    assert [(x.u, round(x.j, 6)) for x in r] == [(["a", "b", "c"], round(1 / 3, 6)), ([], 0.0)]
    d = spark.range(100).withColumn("t", F.concat(F.lit("x"), C("id")))
    s = sets.seeded_sample(d, "id", 5, 7).collect()
    assert [x.label for x in s] == ["S01", "S02", "S03", "S04", "S05"] and {x.id for x in s} == {x.id for x in sets.seeded_sample(d.repartition(3), "id", 5, 7).collect()}
    with pytest.raises(ValueError):
        sets.seeded_sample(d, "id", 101, 7)
    assert [x.t for x in sets.longest_texts(d.withColumn("k", F.lit(1)), "k", "t", 3).orderBy("place").collect()] == ["x10", "x11", "x12"]


def test_event_evidence_needs_precise_support_or_both_sides(spark):
    h = spark.createDataFrame([("c", 1, 100, 102), ("c", 2, 500, 500), ("c", 3, 900, 900), ("c", 4, 5000, 5000)], "contig string, hypothesis long, left long, right long")
    s = spark.createDataFrame([("c", "r", 75, "split", 60), ("c", "s", 127, "left_clip", 90), ("c", "s", 128, "indel", 90), ("c", "t", 500, "left_clip", 30), ("c", "t", 501, "left_clip", 30), ("c", "u", 900, "left_clip", 30), ("c", "v", 910, "right_clip", 40)], "contig string, read string, pos long, kind string, length long")
    got = {r.hypothesis: (r.alt, r.split, r.left_clip, r.right_clip, r.longest, r.names) for r in R.event_evidence(h, s).collect()}
    assert got == {1: (2, 1, 1, 0, 90, ["r", "s"]), 2: (0, 0, 1, 0, 30, ["t"]), 3: (2, 0, 1, 1, 40, ["u", "v"]), 4: (0, 0, 0, 0, 0, None)}


def test_undominated_with_repeated_ids_nulls_and_dense_loci(spark):
    """Rows of one id do not beat each other, negative starts are in no locus, nulls beat nothing; few pairs are left where many calls share a cell."""
    rng = random.Random(6)
    pick = lambda x: None if rng.random() < 0.03 else x
    rows = [(pick(rng.randrange(300)), pick("a"), x := rng.randrange(-30, 120), x + rng.choice([0, 0, 7, 40, 300]), pick(rng.randrange(6)), pick(rng.randrange(4)), pick(rng.random() < 0.3)) for _ in range(400)]
    d = spark.createDataFrame(rows, "id long, contig string, l long, r long, score long, cost long, promoted boolean")

    def beats(b, a):
        if None in (*a, *b[:6]) and not (None not in (*a[:6], *b[:6]) and (b[6] is False or a[6] is True)):
            return False
        apart = max(0, b[2] - a[3], a[2] - b[3])
        same = a[1] == b[1] and a[0] != b[0] and min(a[2], b[2]) >= 0 and apart <= (0 if a[3] > a[2] and b[3] > b[2] else 50)
        return same and b[4] >= a[4] and b[5] <= a[5] and (b[4] > a[4] or b[5] < a[5]) and (b[6] is False or a[6] is True)

    lost = {a[0] for a in rows if a[0] is not None and any(b[0] is not None and beats(b, a) for b in rows)}
    want = sorted(str(a) for a in rows if a[0] is None or a[0] not in lost)
    seen = []
    whole, loci.near_pairs = loci.near_pairs, lambda a, b, gap: seen.append((a.count(), b.count())) or whole(a, b, gap)
    try:
        got = sorted(str(tuple(r)) for r in loci.undominated(d, "id", "contig", "l", "r", ["score"], ["cost"], "promoted").collect())
    finally:
        loci.near_pairs = whole
    assert got == want
    assert seen[0][0] < seen[0][1] / 2


def test_windows_of_one_place_and_of_one_name(spark):
    """Windows that share a place are cut once, and those that share a name keep their own bases; a null name has none."""
    ref = R.reference_chunks(spark.createDataFrame([("c", "acgtacgtac"), ("e", ""), ("n", None)], "contig string, sequence string"), 4)
    assert sorted(map(tuple, ref.collect())) == [("c", 0, "ACGT"), ("c", 1, "ACGT"), ("c", 2, "AC")]
    w = spark.createDataFrame([(1, "c", 2, 7), (1, "c", 5, 9), (2, "c", 2, 7), (None, "c", 2, 7), (3, "e", 0, 4)], "window int, contig string, start long, end long")
    got = R.windows_of(ref, w, 4)
    assert got.columns == [*w.columns, "bases"]
    assert sorted((r.window or 0, r.start, r.bases) for r in got.collect()) == [(0, 2, ""), (1, 2, "GTACG"), (1, 5, "CGTA"), (2, 2, "GTACG"), (3, 0, "")]
