"""Evidence gathered over many rows: overdispersion, communities, k-mer frequencies, scores of matched calls."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomseq.functions.sequence import kmers, reverse_complement
from loomseq.operators.components import components
from loomseq.sources.shared import cut

#: Owners of more names than this are linked through counts rather than pairs of names.
PAIRED = 64
#: Runs of letters that a task gives out at a time.
SPANS = 1 << 14


def overdispersion(df: DataFrame, alt: str, depth: str, fallback: float = 0.05) -> DataFrame:
    """One row: n, rho. Intra-class correlation of alt / depth by analysis of variance.

    Rows of depth 4 or more whose fraction is within (0.15, 0.85) count; fewer
    than 20 of them, or no variance, give the fallback. One pass of sums.
    """
    x, n = F.col(alt).cast("double"), F.col(depth).cast("double")
    s = df.where((n >= 4) & (x / n > 0.15) & (x / n < 0.85)).agg(
        F.count("*").alias("m"), F.sum(x).alias("x"), F.sum(n).alias("n"), F.sum(n * n).alias("n2"), F.sum(x * x / n).alias("x2"), F.sum(x * (n - x) / n).alias("inner")
    )
    c = F.col
    between = (c("x2") - c("x") * c("x") / c("n")) / (c("m") - 1)
    within = c("inner") / (c("n") - c("m"))
    typical = (c("n") - c("n2") / c("n")) / (c("m") - 1)
    s = s.select("m", F.when(c("m") >= 20, between).alias("b"), F.when(c("m") >= 20, within).alias("w"), F.when(c("m") >= 20, typical).alias("t"))
    denom = c("b") + (c("t") - 1) * c("w")
    rho = F.when(denom > 1e-9, F.least(F.greatest((c("b") - c("w")) / denom, F.lit(0.0)), F.lit(0.5))).otherwise(F.lit(fallback))
    return s.select(c("m").alias("n"), rho.alias("rho"))


def communities(df: DataFrame, owner: str, name: str) -> DataFrame:
    """owner (long), community: the smallest owner reachable, over owners that share two names, or one at a Jaccard similarity of one half.

    No pairs of owners are built. Owners that share two names meet at a pair of
    names, and each pair's owners become a star. An owner of more than PAIRED
    names is linked to all that share two of its names by counting. One shared
    name gives one half only between an owner of that name alone and owners of
    at most two names, so it is a star too. Nulls and repeats are ignored;
    owners without a partner are their own community.
    """
    sets = df.where(F.col(owner).isNotNull() & F.col(name).isNotNull()).select(F.col(owner).alias("o"), F.col(name).alias("x")).distinct()
    sets = cut(sets.join(sets.groupBy("o").agg(F.count("*").alias("n")), "o"), "sets")
    small = sets.where(F.col("n") <= PAIRED)
    names = small.groupBy("o").agg(F.array_sort(F.collect_list("x")).alias("xs"))  # at most PAIRED
    pairs = F.flatten(F.transform("xs", lambda a: F.transform(F.filter("xs", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    two = names.select("o", F.explode(pairs).alias("k"))
    heads = two.groupBy("k").agg(F.min("o").alias("h"))
    links = two.join(heads, "k").select(F.col("o").alias("a"), F.col("h").alias("b"))
    big = sets.where(F.col("n") > PAIRED).select(F.col("o").alias("a"), "x")
    counted = big.join(sets.select(F.col("o").alias("b"), "x"), "x").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("s")).where("s >= 2").select("a", "b")
    lone = sets.where("n = 1").groupBy("x").agg(F.min("o").alias("b"))
    one = sets.where("n <= 2").join(lone, "x").select(F.col("o").alias("a"), "b")
    found = components(links.where("a <> b").distinct().unionByName(counted).unionByName(one.where("a <> b")), "a", "b")
    owners = sets.select("o").distinct()
    return owners.join(found, F.col("o") == F.col("node"), "left").select(F.col("o").alias(owner), F.coalesce("root", "o").alias("community"))


def kmer_document_frequency(df: DataFrame, group: str, sequence: str, k: int) -> DataFrame:
    """kmer, n_groups, weight (1 / n_groups): in how many groups each valid k-mer occurs."""
    each = df.where(F.col(group).isNotNull()).select(group, F.explode(F.array_distinct(kmers(F.col(sequence), k))).alias("kmer")).distinct()
    return each.groupBy("kmer").agg(F.count("*").alias("n_groups")).withColumn("weight", 1 / F.col("n_groups"))


def kmer_votes(queries: DataFrame, query: str, sequence: str, library: DataFrame, entry: str, entry_sequence: str, k: int) -> DataFrame:
    """query, entry, hits: distinct k-mers of a query that one library entry alone holds, on either strand. k-mers of two or more entries are ambiguous and left out."""
    forward = F.array_distinct(kmers(F.col(entry_sequence), k))
    lib = library.select(F.col(entry).alias("__e"), F.explode(F.array_union(forward, F.transform(forward, reverse_complement))).alias("kmer")).groupBy("kmer").agg(F.count_distinct("__e").alias("n"), F.min("__e").alias("__e")).where("n = 1")
    q = queries.select(query, F.explode(F.array_distinct(kmers(F.col(sequence), k))).alias("kmer"))
    return q.join(lib, "kmer").groupBy(query, F.col("__e").alias(entry)).agg(F.count_distinct("kmer").alias("hits"))


def match_scores(matched: DataFrame, truth_count: DataFrame, group: str) -> DataFrame:
    """group, tp, fp, fn, precision, recall, f1, median_distance from calls with `truth_position` and `distance`, and truth_count (group, n_truth). A ratio without a denominator is 0. A truth matched by many calls is found once."""
    hit = F.col("truth_position").isNotNull()
    got = matched.groupBy(group).agg(F.count_if(hit).alias("tp"), F.count_if(~hit).alias("fp"), F.percentile("distance", F.lit(0.5)).alias("median_distance"))
    found = matched.where(hit).select(group, "truth_position").distinct().groupBy(group).agg(F.count("*").alias("found"))
    rows = truth_count.join(got, group, "full").join(found, group, "left").na.fill(0, ["tp", "fp", "n_truth", "found"])
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("n_truth") > 0, F.col("found") / F.col("n_truth")).otherwise(0.0)
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return rows.select(group, "tp", "fp", (F.col("n_truth") - F.col("found")).alias("fn"), p.alias("precision"), r.alias("recall"), "median_distance").withColumn("f1", f1)


def letter_runs(df: DataFrame, key: str, sequence: str, letter: str = "N") -> DataFrame:
    """key, start, end, length: maximal runs of a letter, either case, half-open from 0. One pass over each sequence, without a shuffle; a null or empty one has none."""
    find = re.compile(f"[{re.escape(letter.upper())}{re.escape(letter.lower())}]+").finditer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, spans = [], []
            for i in range(b.num_rows):  # one text at a time is a Python string
                for m in find(b.column(1)[i].as_py() or ""):
                    at.append(i)
                    spans.append(m.span())
                    if len(spans) == SPANS:
                        yield found(b.column(0), at, spans)
                        at, spans = [], []
            if spans:
                yield found(b.column(0), at, spans)

    def found(keys: pa.Array, at: list[int], spans: list[tuple[int, int]]) -> pa.RecordBatch:
        start, end = (pa.array([s[j] for s in spans], pa.int64()) for j in (0, 1))
        return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), start, end], names=[key, "start", "end"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, sequence).mapInArrow(run, f"`{key}` {kind}, start long, end long").withColumn("length", F.col("end") - F.col("start"))
