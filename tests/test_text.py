"""Readers, the read gate and the operators' edge cases on small inputs."""

import pytest
from pyspark.sql import functions as F

from loomseq.functions import reads as R
from loomseq.operators import evidence as E
from loomseq.operators import intervals as I
from loomseq.operators import selection as L
from loomseq.operators.running import running_sums, running_total
from loomseq.sources import text as X
from loomseq.sources.shared import shared_dir


def lines(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_sam(spark):
    got = X.parse_sam(lines(spark, "@HD\tVN:1.6", "r1\t16\tchr4\t501\t33\t40M55I45M\t*\t0\t0\t" + "C" * 140 + "\t*\tNM:i:7\tSA:Z:chr4,640,-,90S50M,33,2;", "r2\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*", "", None)).collect()
    assert [tuple(r) for r in got] == [("r1", 16, "chr4", 500, 33, "40M55I45M", "C" * 140, 7, "chr4,640,-,90S50M,33,2;"), ("r2", 4, None, -1, 0, None, None, None, None)]


def test_vcf(spark):
    got = X.parse_vcf_insertions(lines(spark, "##fileformat=VCFv4.2", "chr7\t345\tv.9\tN\tGATTACA\t41\tPASS\tSVTYPE=INS;SVLEN=7;END=346;SUPPORT=3", "chr1\t200\t.\tN\t<INS>\t.\t.\tPRECISE;SVTYPE=INS", "chr1\t9\tx\tN\t<DEL>\t60\tPASS\tSVTYPE=DEL", "short"))
    assert [tuple(r) for r in got.collect()] == [("v.9", "chr7", 345, 346, 7, 3, "PASS", 41.0, "GATTACA"), ("chr1:200:INS", "chr1", 200, 200, None, None, "PASS", None, None)]


def test_fasta(spark, tmp_path):
    (tmp_path / "lib.fa").write_text(">Fam:Sub a > b\nTTTacg\nTACG\n>empty\n>L1HS#LINE/L1\r\nAC\r\nGT\r\n>\nAAA\n")
    got = X.read_fasta(spark, str(tmp_path / "lib.fa"))
    assert {tuple(r) for r in got.collect()} == {("Fam:Sub", "TTTACGTACG"), ("L1HS#LINE/L1", "ACGT")}
    f = got.select(X.family_of(F.col("name")).alias("n")).collect()
    assert {tuple(r.n) for r in f} == {("Fam", "Sub"), ("L1", "L1HS")}


def test_names_and_regions(spark):
    d = lines(spark, "chr1", "2", "chrM").select(X.contig_aliases(F.col("value")).alias("a"))
    assert [r.a for r in d.collect()] == [["chr1", "1"], ["2", "chr2"], ["chrM", "M", "MT", "chrMT"]]
    assert X.region("chr1:1-10") == ("chr1", 0, 10) and X.region("chr1") == ("chr1", 0, None)
    for bad in ("chr1:0-5", "chr1:9-5", "chr1:-5", ":1-2", "chr1:1-2147483648"):
        with pytest.raises(ValueError):
            X.region(bad)


@pytest.mark.parametrize(
    "flag, mapq, n, cigar, nm, sa, kept",
    [
        (0, 20, 300, "300M", 0, None, False), (0, 21, 300, "300M", 0, None, True), (4, 60, 300, "300M", 0, None, False), (0x100, 60, 300, "300M", 0, None, False),
        (0, 60, 49, "49M", 0, None, False), (0, 0, 500, "150M50I200M", 300, None, True), (0, 60, 500, "150M50I150M", 0, None, False), (0, 60, 400, "120S280M", 0, None, True),
        (0, 60, 400, "100S119M1D250M", 0, None, False), (0, 60, 400, "5H100S120M1D250M", 0, None, True), (0, 60, 400, "250M2D119M100S3H", 0, None, False),
        (0, 60, 300, "300M", 61, "chr1,1,+,1M,60,0;", False), (0, 0, 300, "300M", None, "chr1,1,+,1M,60,0;", True), (0x800, 0, 300, "100M100=100X", 60, None, True),
        (None, None, None, None, None, None, False),
    ],
)
def test_gate(spark, flag, mapq, n, cigar, nm, sa, kept):
    d = spark.createDataFrame([(flag, mapq, n, cigar, nm, sa)], "flag int, mapq int, n int, cigar string, nm long, sa string")
    assert d.select(R.informative(*map(F.col, d.columns))).first()[0] is kept


def test_running_sums_are_exact_in_either_direction(spark):
    d = spark.range(0, 5000, numPartitions=7).select((F.col("id") * 37 % 5003).cast("double").alias("x"), (F.col("id") % 11).alias("c"))
    want = sorted((r.x, r.c) for r in d.collect())
    for down in (False, True):
        s, expect = 0, {}
        for x, c in reversed(want) if down else want:
            s += c
            expect[x] = s
        assert {r.x: r.k for r in running_total(d, "x", "c", "k", descending=down).collect()} == expect
    keyed = running_sums(d.withColumn("g", F.when(F.col("c") > 2, F.col("c") % 2)), ["g"], [F.asc("x")], {"n": F.lit(1), "s": F.col("c")})
    seen = {}
    for r in sorted(keyed.collect(), key=lambda r: r.x):
        n, s = seen.get(r.g, (0, 0))
        seen[r.g] = (n + 1, s + r.c)
        assert (r.n, r.s) == seen[r.g]


def test_step_up_thresholds_ties_and_nulls(spark):
    d = spark.createDataFrame([(p,) for p in (0.001, 0.01, 0.01, 0.9, None)], "p double")
    got = sorted(((r.p or 0, r.selected, r.threshold) for r in L.step_up(d, "p", 0.1).collect()))
    h = 1 + 1 / 2 + 1 / 3 + 1 / 4
    assert [(p, s) for p, s, _ in got] == [(0, False), (0.001, True), (0.01, True), (0.01, True), (0.9, False)]
    assert got[0][2] is None and all(abs(t - 0.3 / (4 * h)) < 1e-12 for _, s, t in got if s) and abs(got[-1][2] - 0.1 / h) < 1e-12


def test_overlap_of_very_long_and_empty_intervals(spark):
    a = spark.createDataFrame([("c", 0, 250_000_000, 1), ("c", 100, 100, 2), ("c", 90, 130, 3), (None, 0, 9, 4), ("d", 5, 6, 5)], "contig string, l_start long, l_end long, a int")
    b = spark.createDataFrame([("c", 99, 101, 1), ("c", 249_999_999, 250_000_001, 2), ("c", 128, 70_000, 3), ("c", None, 9, 4), ("d", 6, 7, 5)], "contig string, r_start long, r_end long, b int")
    got = {(r.a, r.b) for r in I.overlap_join(a, b).collect()}
    want = {(x.a, y.b) for x in a.collect() for y in b.collect() if x.contig and x.contig == y.contig and y.r_start is not None and x.l_end > y.r_start and x.l_start < y.r_end}
    assert got == want and I.overlap_join(a, b).count() == len(want) and I.overlap_join(a.limit(0), b).count() == 0


def test_checkpoint_folder_is_needed_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf = Conf()

        class sparkContext:
            master = "spark://x:7077"

    with pytest.raises(RuntimeError):
        shared_dir(Cluster())


def test_letter_runs_of_special_letters(spark):
    d = spark.createDataFrame([(1, "^^a^"), (2, None), (3, "")], "k long, s string")
    assert [tuple(r) for r in E.letter_runs(d, "k", "s", "^").collect()] == [(1, 0, 2, 2), (1, 3, 4, 1)]


def test_empty_tables(spark):
    iv = spark.createDataFrame([], "k string, s long, e long")
    assert I.merge_intervals(iv, "k", "s", "e", 5).count() == 0 and I.gap_clusters(iv, "k", "s", 5).count() == 0 and I.nearest(iv, iv, "k", "s", 5).count() == 0
    p = spark.createDataFrame([], "p double")
    assert L.step_up(p, "p", 0.1).count() == 0 and L.e_values(p, "p", 0.1).count() == 0 and L.empirical_tail(p, p, "p").count() == 0
    assert E.communities(spark.createDataFrame([], "o long, x long"), "o", "x").count() == 0


def test_merge_across_blocks(spark):
    d = spark.createDataFrame([("a", 0, 1000), ("a", 5, 6), ("a", 990, 995), ("a", 1003, 1010), ("a", 1020, 1021), ("b", 7, 8), ("b", 7, 8), (None, 1, 2), ("a", None, 3)], "k string, s long, e long")
    got = {tuple(r) for r in I.merge_intervals(d, "k", "s", "e", 5, block=16).collect()}
    assert got == {("a", 0, 1010, 4), ("a", 1020, 1021, 1), ("b", 7, 8, 2)}


def test_nearest_across_blocks_and_ties(spark):
    calls = spark.createDataFrame([("a", 50), ("a", 50), ("a", 100), ("b", 1), (None, 50), ("a", None)], "k string, p long")
    truth = spark.createDataFrame([("a", 40), ("a", 60), ("a", 1), ("a", 109)], "k string, p long")
    got = sorted((r.k or "", r.p or 0, r.truth_position, r.distance) for r in I.nearest(calls, truth, "k", "p", 10, block=8).collect())
    assert got == [("", 50, None, None), ("a", 0, None, None), ("a", 50, 40, 10), ("a", 50, 40, 10), ("a", 100, 109, 9), ("b", 1, None, None)]


def test_communities_of_large_owners(spark, monkeypatch):
    rows = [(1, x) for x in range(10)] + [(2, 3), (2, 4), (3, 4), (4, 4), (4, 99), (5, 77), (6, 9), (6, 50), (7, 50), (7, 9), (7, 9), (None, 1), (8, None)]
    d = spark.createDataFrame(rows, "o long, x long")
    want = {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 6}
    assert {r.o: r.community for r in E.communities(d, "o", "x").collect()} == want
    monkeypatch.setattr(E, "PAIRED", 3)
    assert {r.o: r.community for r in E.communities(d, "o", "x").collect()} == want


def test_letter_runs_leave_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(E, "SPANS", 3)
    rows = [(1, "nnANaNNNan"), (2, ""), (3, None), (4, "n"), (5, "NANANANAN"), (6, "ACGT")]
    got = sorted((r.k, r.start, r.end, r.length) for r in E.letter_runs(spark.createDataFrame(rows, "k long, s string").coalesce(1), "k", "s").collect())
    assert got == [(1, 0, 2, 2), (1, 3, 4, 1), (1, 5, 8, 3), (1, 9, 10, 1), (4, 0, 1, 1), *((5, i, i + 1, 1) for i in (0, 2, 4, 6, 8))]


@pytest.mark.parametrize("shared,jaccard", [(2, 0.5), (3, 0.3), (2, 1.0), (1, 0.5)])
def test_edges_by_pairs_of_names_equal_all_pairs(spark, monkeypatch, shared, jaccard):
    import itertools
    import random

    monkeypatch.setattr(L, "PAIRED", 4)
    rng = random.Random(shared)
    sets = {o: {rng.randint(0, 14) for _ in range(rng.choice((1, 1, 2, 3, 4, 7)))} for o in range(70)}
    rows = [(o, x) for o, xs in sets.items() for x in xs for _ in range(rng.randint(1, 2))] + [(None, 1), (1, None)]
    got = sorted((r.a, r.b, r.n_shared, round(r.jaccard, 9)) for r in L.support_edges(spark.createDataFrame(rows, "o long, x long"), "o", "x", shared, jaccard).collect())
    want = []
    for a, b in itertools.combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        like = n / len(sets[a] | sets[b])
        if n and (n >= shared or like >= jaccard):
            want.append((a, b, n, round(like, 9)))
    assert got == want and want
