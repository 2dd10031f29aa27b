"""Names of inserted sequences from alignments to a library, summaries of parents' reads, and of communities of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def covered(length: Column, spans: Column) -> Column:
    """Share of a length that half-open spans (array<struct<start, end>>) cover together, overlaps counted once; 0 without a length."""
    clean = F.array_sort(F.filter(spans, lambda s: s["end"] > s["start"]))
    begin = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-(1 << 62)).cast("long").alias("reach"))
    total = F.aggregate(
        clean,
        begin,
        lambda a, s: F.struct((a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["reach"]), F.lit(0))).cast("long").alias("n"), F.greatest(a["reach"], s["end"]).cast("long").alias("reach")),
        lambda a: a["n"],
    )
    return F.when(length > 0, F.least(total / length, F.lit(1.0))).otherwise(0.0)


def subject_hits(hsps: DataFrame, lengths: DataFrame) -> DataFrame:
    """query, subject, identity, coverage, score, bits, e_value, start, end: segments (query, subject, identity, q_start, q_end, length, bits, e_value; half-open) of one subject put together. identity is weighted by length, score is identity x coverage. lengths: query, query_length."""
    h = hsps.where(F.col("query").isNotNull() & F.col("subject").isNotNull()).groupBy("query", "subject").agg(
        (F.sum(F.col("identity") * F.col("length")) / F.nullif(F.sum("length"), F.lit(0))).alias("identity"), F.collect_set(F.struct(F.col("q_start").cast("long").alias("start"), F.col("q_end").cast("long").alias("end"))).alias("spans"),
        F.sum("bits").alias("bits"), F.min("e_value").alias("e_value"), F.min("q_start").alias("start"), F.max("q_end").alias("end"),
    )
    h = h.join(lengths, "query").withColumn("coverage", covered(F.col("query_length"), F.col("spans")))
    return h.select("query", "subject", "identity", "coverage", (F.col("identity") * F.col("coverage")).alias("score"), "bits", "e_value", "start", "end")


def best_family(hits: DataFrame) -> DataFrame:
    """query, family, subfamily, score, second_family, second_score, margin, ambiguous: the family of the highest score (ties to the first name), how far the next one is, and whether another subfamily of it is as good. hits: query, family, subfamily, score."""
    each = hits.where(F.col("query").isNotNull() & F.col("family").isNotNull()).groupBy("query", "family", "subfamily").agg(F.max("score").alias("score"))
    top = each.groupBy("query", "family").agg(F.max("score").alias("score"), F.min_by("subfamily", F.struct((-F.col("score")).alias("s"), "subfamily")).alias("subfamily"))
    ranked = top.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "family"))).where("n <= 2")
    pick = lambda n, c: F.max(F.when(F.col("n") == n, F.col(c)))
    best = ranked.groupBy("query").agg(pick(1, "family").alias("family"), pick(1, "subfamily").alias("subfamily"), pick(1, "score").alias("score"), pick(2, "family").alias("second_family"), F.coalesce(pick(2, "score"), F.lit(0.0)).alias("second_score"))
    same = each.select("query", "family", F.col("subfamily").alias("sf"), F.col("score").alias("sc"))
    rivals = best.join(same, ["query", "family"]).groupBy("query").agg((F.count_if(F.col("sc") >= F.col("score")) > 1).alias("ambiguous"))
    return best.join(rivals, "query").withColumn("margin", F.greatest(F.col("score") - F.col("second_score"), F.lit(0.0)))


def weighted_votes(queries: DataFrame, library: DataFrame, ks: tuple[int, ...] = (9, 11, 13)) -> DataFrame:
    """query, entry, score: over several k, k times the share of a query's k-mers that an entry has on either strand, divided by the sum of all k. queries: query, s; library: entry, s."""
    from loomseq.functions.sequence import kmers, reverse_complement

    parts = None
    for k in ks:
        q = queries.select("query", kmers(F.col("s"), k).alias("x")).where(F.size("x") > 0).select("query", F.size("x").alias("total"), F.explode("x").alias("kmer"))
        forward = kmers(F.col("s"), k)
        lib = library.select("entry", F.explode(F.array_union(forward, F.transform(forward, reverse_complement))).alias("kmer")).distinct()
        hit = q.join(lib, "kmer").groupBy("query", "entry", "total").agg(F.count("*").alias("hits"))
        part = hit.select("query", "entry", (F.lit(float(k)) * F.col("hits") / F.col("total")).alias("v"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("query", "entry").agg((F.sum("v") / float(sum(ks))).alias("score"))


def parent_summary(reads: DataFrame) -> DataFrame:
    """candidate, exact, family, ambiguous, sources: of each read of a source (file) the best class counts: exact, then family, then ambiguous, then the longer piece. reads: candidate, source, read, class, length."""
    place = F.when(F.col("class") == "exact", 3).when(F.col("class") == "family", 2).when(F.col("class") == "ambiguous", 1).otherwise(0)
    best = reads.groupBy("candidate", "source", "read").agg(F.max(F.struct(place.alias("p"), "length")).alias("b"))
    n = lambda p: F.count_if(F.col("b.p") == p)
    return best.groupBy("candidate").agg(n(3).alias("exact"), n(2).alias("family"), n(1).alias("ambiguous"), F.array_sort(F.collect_set(F.when(F.col("b.p") > 0, F.col("source")))).alias("sources"))


def community_rows(rows: DataFrame, community: str, margin: int = 50) -> DataFrame:
    """One row for each community of two rows or more: alt (distinct names), ref (upper median), start and end with a margin, best identity, coverage and least lfdr, the longest insert (the first of equals). rows: community, names array<string>, ref, left, right, identity, coverage, lfdr, insert."""
    middle = F.element_at(F.array_sort(F.collect_list("ref")), (F.floor(F.count("ref") / 2) + 1).cast("int"))
    names = rows.select(community, F.explode("names").alias("n")).where(F.col("n").isNotNull()).groupBy(community).agg(F.count_distinct("n").alias("alt"))
    got = rows.groupBy(community).agg(
        F.count("*").alias("rows"), middle.alias("ref"), F.greatest(F.min("left") - margin, F.lit(0)).alias("start"), (F.max("right") + margin).alias("end"), F.max("identity").alias("identity"), F.max("coverage").alias("coverage"),
        F.min("lfdr").alias("lfdr"), F.min(F.struct((-F.length("insert")).alias("n"), "insert")).alias("i"),
    ).where("rows >= 2")
    return got.join(names, community, "left").select(community, "rows", F.coalesce("alt", F.lit(0)).alias("alt"), "ref", "start", "end", "identity", "coverage", "lfdr", F.col("i.insert").alias("insert"))


def local_counters(sites: DataFrame, reads: DataFrame, window: int = 100, low: int = 20) -> DataFrame:
    """sites (contig, site, pos) with depth, reverse, inserted, longest, clipped, spanning and spanning_low, over the reads (contig, start, end, flag, mapq, insertion, clip) that reach within `window` of the position."""
    from loomseq.operators.intervals import overlap_join

    a = sites.where(F.col("site").isNotNull()).select("contig", "site", (F.col("pos") - window).alias("l_start"), (F.col("pos") + window + 1).alias("l_end"))
    b = reads.select("contig", F.col("start").alias("r_start"), F.col("end").alias("r_end"), "flag", "mapq", "insertion", "clip")
    span = (F.col("r_start") <= F.col("l_start")) & (F.col("r_end") >= F.col("l_end"))
    got = overlap_join(a, b).groupBy("site").agg(
        F.count("*").alias("depth"), F.count_if(F.col("flag").bitwiseAND(F.lit(16)) != 0).alias("reverse"), F.count_if(F.col("insertion") > 0).alias("inserted"), F.max("insertion").alias("longest"),
        F.count_if(F.col("clip") > 0).alias("clipped"), F.count_if(span).alias("spanning"), F.count_if(span & (F.col("mapq") < low)).alias("spanning_low"),
    )
    return sites.join(got, "site", "left").na.fill(0, ["depth", "reverse", "inserted", "longest", "clipped", "spanning", "spanning_low"])
