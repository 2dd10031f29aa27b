from loomseq.operators.evidence import kmer_votes


def test_votes_of_both_strands(spark):
    library = spark.createDataFrame([("a", "AACCGTAC"), ("b", "TTGGATTT"), ("c", "GGGCATC")], "entry string, s string")
    # q1 is entry a's reverse complement; AACC is forward in a, and CCAA of q2 is TTGG of b reversed; GATG is c's CATC reversed.
    queries = spark.createDataFrame([(1, "GTACGGTT"), (2, "CCAA"), (3, "GATG"), (4, "nn")], "query int, s string")
    got = {(r.query, r.entry): r.hits for r in kmer_votes(queries, "query", "s", library, "entry", "s", 4).collect()}
    assert got == {(1, "a"): 5, (2, "b"): 1, (3, "c"): 1}


def test_kmer_forward_in_one_entry_and_reverse_in_another_is_ambiguous(spark):
    library = spark.createDataFrame([("a", "AACC"), ("b", "GGTT")], "entry string, s string")
    queries = spark.createDataFrame([(1, "AACC")], "query int, s string")
    assert kmer_votes(queries, "query", "s", library, "entry", "s", 4).count() == 0
