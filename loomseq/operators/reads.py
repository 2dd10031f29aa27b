"""Reads and references by place: region scans, windows of a chunked reference, bins with their context, reads that speak for the reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomseq.functions.reads import SECONDARY, UNMAPPED
from loomseq.operators.intervals import overlap_join, overlap_totals
from loomseq.operators.running import running_sums
from loomseq.sources.shared import cut
from loomseq.sources.text import contig_aliases


def scanned(reads: DataFrame) -> DataFrame:
    """Mapped primary and supplementary records."""
    return reads.where(F.coalesce(F.col("flag"), F.lit(0)).bitwiseAND(F.lit(UNMAPPED | SECONDARY)) == 0)


def in_region(reads: DataFrame, contig: str, start: int, end: int | None) -> DataFrame:
    """Scanned reads (contig, pos, ref_end) that reach into a half-open region; an end of None or 0 and less is the contig's end."""
    got = scanned(reads).where((F.col("contig") == contig) & (F.col("ref_end") > start))
    return got.where(F.col("pos") < max(end, start + 1)) if end is not None and end > 0 else got


def fetched(regions: DataFrame, reads: DataFrame) -> DataFrame:
    """region and the reads that overlap it, of scanned reads; an empty region is one base wide. regions: region, contig, start, end."""
    a = regions.select("region", "contig", F.col("start").alias("l_start"), F.greatest("end", F.col("start") + 1).alias("l_end"))
    b = scanned(reads).withColumnsRenamed({"pos": "r_start", "ref_end": "r_end"})
    return overlap_join(a, b).withColumnsRenamed({"r_start": "pos", "r_end": "ref_end"}).drop("l_start", "l_end")


def fetched_totals(regions: DataFrame, reads: DataFrame) -> DataFrame:
    """region with n, first and last: how many scanned reads overlap it (as in fetched), the smallest pos and the largest ref_end among them. Regions without reads are left out, and no pair is built."""
    a = regions.select("region", "contig", F.col("start").alias("r_start"), F.greatest("end", F.col("start") + 1).alias("r_end"))
    b = scanned(reads).select("contig", F.col("pos").alias("l_start"), F.col("ref_end").alias("l_end"))
    return overlap_totals(b, a).select("region", "n", "first", "last")


def alias_of(names: DataFrame, contig: str, present: DataFrame, reference: str) -> DataFrame:
    """names with `found`: the first alias of a contig that the reference has, or null. Contigs and references are few, and the join is by name."""
    each = names.select(contig).distinct().select(contig, F.posexplode(contig_aliases(F.col(contig))).alias("i", "alias"))
    hit = each.join(present.select(F.col(reference).alias("alias")).distinct(), "alias").groupBy(contig).agg(F.min_by("alias", "i").alias("found"))
    return names.join(hit, contig, "left")


def reference_chunks(reference: DataFrame, size: int) -> DataFrame:
    """contig, chunk, piece: sequences in chunks of `size` bases, cut in one pass. reference: contig, sequence."""
    pieces = F.regexp_extract_all(F.upper("sequence"), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return reference.select("contig", F.posexplode(pieces).alias("chunk", "piece"))


def windows_of(chunks: DataFrame, windows: DataFrame, size: int) -> DataFrame:
    """windows (window, contig, start, end) with `bases`: the half-open window of the chunked reference, cut at its ends; empty where there is none. Windows at one place are cut once."""
    place = ["contig", "start", "end"]
    lo = F.greatest("start", F.lit(0))
    last = F.greatest(F.col("end") - 1, lo)
    places = windows.where((F.col("end") > lo) & F.col("window").isNotNull()).select(place).distinct()
    each = places.select(*place, lo.alias("lo"), F.explode(F.sequence(F.floor(lo / size).cast("int"), F.floor(last / size).cast("int"))).alias("chunk"))
    from_, to = F.greatest(F.col("lo") - F.col("chunk").cast("long") * size, F.lit(0)), F.col("end") - F.col("chunk").cast("long") * size
    cut = each.join(chunks, ["contig", "chunk"]).select(*place, "chunk", F.substr("piece", (from_ + 1).cast("int"), F.greatest(F.least(to, F.lit(size)) - from_, F.lit(0)).cast("int")).alias("s"))
    got = cut.groupBy(place).agg(F.array_sort(F.collect_list(F.struct("chunk", "s"))).alias("p")).select(*place, F.array_join(F.transform("p", lambda x: x["s"]), "").alias("bases"))
    return windows.join(got, place, "left").select(*windows.columns, F.when(F.col("window").isNotNull() & F.col("bases").isNotNull(), F.col("bases")).otherwise("").alias("bases"))


def bin_context(reads: DataFrame, size: int, around: int = 2, slack: int = 5000) -> DataFrame:
    """bin and each read that its task sees: the bin's own, and those of the bins within `around` that reach to within `slack` of its start. Bins without own reads have no task. reads: contig, read, pos, ref_end."""
    rows = reads.where(F.col("contig").isNotNull() & F.col("pos").isNotNull()).withColumn("own", F.greatest(F.floor(F.col("pos") / size), F.lit(0)))
    bins = rows.select("contig", F.col("own").alias("bin")).distinct()
    each = rows.withColumn("bin", F.explode(F.sequence(F.greatest(F.col("own") - around, F.lit(0)), F.col("own") + around)))
    each = each.where((F.col("own") == F.col("bin")) | (F.col("ref_end") >= F.col("bin") * size - slack))
    return each.join(bins, ["contig", "bin"], "left_semi")


def reference_reads(hypotheses: DataFrame, reads: DataFrame, named: DataFrame, margin: int = 25, near: int = 75, quality: int = 20) -> DataFrame:
    """hypotheses (contig, hypothesis, left, right) with ref and ref_low: how many primary reads span both breakpoints with a margin, are not named for the hypothesis, and have no signal near it; by mapping quality.

    reads: contig, read, pos, ref_end, flag, mapq, signals array<long>; named:
    hypothesis, read. A read counts once for a hypothesis.

    No pair is built. A read speaks for the breakpoints within the stretches
    between its signals; those stretches are laid into one order with the
    hypotheses, and ref is a difference of running sums there, less the reads
    named. Only stretches that lie wholly between two breakpoints meet them, and
    the reads of a hypothesis that stands at several places.
    """
    lo, hi = F.least("left", "right"), F.greatest("left", "right")
    at = hypotheses.where(F.col("hypothesis").isNotNull() & F.col("contig").isNotNull() & lo.isNotNull()).select("hypothesis", F.struct("contig", lo.cast("long").alias("lo"), hi.cast("long").alias("hi")).alias("p"))
    places = cut(at.groupBy("hypothesis").agg(F.min("p").alias("p"), F.max("p").alias("q")), "places")
    alone = (F.col("p") == F.col("q")) & F.lit(margin >= 0)
    primary = reads.where((F.col("flag").bitwiseAND(F.lit(0x904)) == 0) & F.col("contig").isNotNull() & F.col("pos").isNotNull() & F.col("ref_end").isNotNull() & F.col("mapq").isNotNull())
    # Positions are doubled: breakpoints at one place reach one half further, so that a margin of 0 leaves out those at a read's end.
    one = places.where(alone).select("hypothesis", "p.contig", (2 * F.col("p.lo")).alias("lo"), (2 * F.col("p.hi") + (F.col("p.lo") == F.col("p.hi")).cast("long")).alias("hi"))
    spans = _speaking(primary, named, one, margin, near, quality)
    stretches = spans.where("hypothesis IS NULL").select("contig", F.inline(_once(F.col("lo"), F.col("hi"))))
    totals = _within(stretches, one).unionByName(spans.where("hypothesis IS NOT NULL").select("hypothesis", (-(F.col("before") >= F.col("hi")).cast("long")).alias("n"), (-(F.col("before_high") >= F.col("hi")).cast("long")).alias("n_high")))
    best = totals.groupBy("hypothesis").agg(*(F.sum(F.coalesce(n, F.lit(0))).alias(n) for n in ("n", "n_high"))).select("hypothesis", F.col("n_high").alias("ref"), (F.col("n") - F.col("n_high")).alias("ref_low"))
    several = places.where(~alone)
    if not several.isEmpty():
        best = best.unionByName(_reference_pairs(at.join(several.select("hypothesis"), "hypothesis", "left_semi"), primary, named, margin, near, quality))
    return hypotheses.join(best, "hypothesis", "left").na.fill(0, ["ref", "ref_low"])


def _speaking(primary: DataFrame, named: DataFrame, places: DataFrame, margin: int, near: int, quality: int) -> DataFrame:
    """Stretches of reads between their signals (contig, lo, hi, high) and the places that name a read (hypothesis too), each with how far the read's stretches that begin before it reach: before, and before_high for those of good quality. A stretch holds the breakpoints for which the read speaks."""
    first, last = 2 * (F.col("pos").cast("long") + margin), 2 * (F.col("ref_end").cast("long") - margin) + int(margin > 0)
    marks = F.array_sort(F.filter(F.coalesce("signals", F.array().cast("array<bigint>")), lambda s: s.isNotNull()))
    los = F.concat(F.array(first), F.transform("marks", lambda s: F.greatest(first, 2 * (s + near + 1))))
    his = F.concat(F.transform("marks", lambda s: F.least(last, 2 * (s - near) - 1)), F.array(last))
    high = (F.col("mapq") >= quality).alias("high")
    stretches = primary.withColumn("marks", marks).select("contig", "read", high, F.inline(F.arrays_zip(los.alias("lo"), his.alias("hi")))).where("lo <= hi")
    asked = named.select("hypothesis", "read").where("read IS NOT NULL").distinct().join(places, "hypothesis")
    rows = stretches.unionByName(asked, allowMissingColumns=True)
    stretch = F.col("hypothesis").isNull()
    up_to = Window.partitionBy("contig", "read").orderBy("lo", (~stretch), F.desc("hi")).rowsBetween(Window.unboundedPreceding, -1)
    reach = lambda which: F.max(F.when(which, F.col("hi"))).over(up_to)
    return cut(rows.select("contig", "lo", "hi", "high", "hypothesis", reach(stretch).alias("before"), reach(stretch & F.col("high")).alias("before_high")), "spans")


def _once(lo: Column, hi: Column) -> Column:
    """Stretches with the weights n and n_high that count a read once wherever its stretches overlap: those that reach beyond all before add one, and what they share with the one before takes one off."""
    new = F.col("before").isNull() | (hi > F.col("before"))
    new_high = F.col("high") & (F.col("before_high").isNull() | (hi > F.col("before_high")))
    part = lambda end, n, n_high: F.struct(lo.alias("lo"), end.alias("hi"), n.cast("long").alias("n"), n_high.cast("long").alias("n_high"))
    parts = F.array(part(hi, new, new_high), part(F.col("before"), -new.cast("long"), F.lit(0)), part(F.col("before_high"), F.lit(0), -new_high.cast("long")))
    return F.filter(parts, lambda x: (x["lo"] <= x["hi"]) & ((x["n"] != 0) | (x["n_high"] != 0)))


def _within(stretches: DataFrame, places: DataFrame) -> DataFrame:
    """hypothesis, n and n_high, to be summed: the weight of the stretches (contig, lo, hi, n, n_high) that hold a place (hypothesis, contig, lo, hi). It is that of those which begin up to lo, less those which end before hi, and again those that do both after lo and before hi."""
    none, zero = F.lit(None), F.lit(0).cast("long")
    end = lambda side, order: F.struct(F.lit(side).alias("side"), F.col("hi" if side else "lo").alias("at"), F.lit(order).alias("turn"))
    points = stretches.select("n", "n_high", "contig", F.inline(F.array(end(0, 0), end(1, 1)))).groupBy("contig", "side", "at", "turn").agg(F.sum("n").alias("n"), F.sum("n_high").alias("n_high"))
    asked = places.select("hypothesis", "contig", F.inline(F.array(end(0, 1), end(1, 0)))).withColumns({"n": zero, "n_high": zero})
    rows = points.withColumn("hypothesis", none).unionByName(asked)
    found = running_sums(rows, ["contig", "side"], [F.col("at"), F.col("turn"), F.col("hypothesis")], {"s": F.col("n"), "s_high": F.col("n_high")}).where("hypothesis IS NOT NULL")
    sign = 1 - 2 * F.col("side")
    out = found.select("hypothesis", (sign * F.col("s")).alias("n"), (sign * F.col("s_high")).alias("n_high"))
    longest = places.agg(F.max(F.col("hi") - F.col("lo"))).first()[0] or 0
    if longest < 2:
        return out
    wide = places.where(F.col("hi") - F.col("lo") > 1).select("hypothesis", "contig", (F.col("lo") + 1).alias("l_start"), F.col("hi").alias("l_end"))
    short = stretches.where(F.col("hi") - F.col("lo") <= longest - 2).select("contig", F.col("lo").alias("r_start"), (F.col("hi") + 1).alias("r_end"), "n", "n_high")
    inside = overlap_join(wide, short).where((F.col("r_start") >= F.col("l_start")) & (F.col("r_end") <= F.col("l_end")))
    return out.unionByName(inside.select("hypothesis", "n", "n_high"))


def _reference_pairs(places: DataFrame, primary: DataFrame, named: DataFrame, margin: int, near: int, quality: int) -> DataFrame:
    """hypothesis, ref and ref_low of reference_reads, by pairs of a place (hypothesis, p) and a read: a read counts once for all places of a hypothesis."""
    a = places.select("hypothesis", "p.contig", F.col("p.lo").alias("l_start"), (F.col("p.hi") + 1).alias("l_end"))
    b = primary.select("contig", "read", F.col("pos").alias("r_start"), F.col("ref_end").alias("r_end"), "mapq", "signals")
    span = (F.col("r_start") <= F.col("l_start") - margin) & (F.col("r_end") >= F.col("l_end") - 1 + margin)
    quiet = ~F.coalesce(F.exists("signals", lambda s: s.between(F.col("l_start") - near, F.col("l_end") - 1 + near)), F.lit(False))
    got = overlap_join(a, b).where(span & quiet).join(named.select("hypothesis", "read").distinct(), ["hypothesis", "read"], "left_anti")
    return got.groupBy("hypothesis", "read").agg(F.max("mapq").alias("mapq")).groupBy("hypothesis").agg(F.count_if(F.col("mapq") >= quality).alias("ref"), F.count_if(F.col("mapq") < quality).alias("ref_low"))


def event_evidence(hypotheses: DataFrame, signals: DataFrame, slack: int = 25) -> DataFrame:
    """hypotheses (contig, hypothesis, left, right) with alt, split, indel, left_clip, right_clip (distinct reads), longest and names.

    Signals (contig, read, pos, kind: split, indel, left_clip or right_clip,
    length) count within `slack` of the breakpoints. alt is split and indel
    reads, and clipped ones only beside such a read or with both sides there.
    A row is a hypothesis; those at one place are judged once, from a read's
    signals at a position taken together.
    """
    here = ["contig", "l_start", "l_end"]
    h = hypotheses.withColumns({"l_start": F.least("left", "right") - slack, "l_end": F.greatest("left", "right") + slack + 1})
    kinds = ("split", "indel", "left_clip", "right_clip")
    b = signals.withColumnRenamed("pos", "r_start").groupBy("contig", "read", "r_start").agg(*(F.bool_or(F.col("kind") == k).alias(k) for k in kinds), F.max("length").alias("length")).withColumn("r_end", F.col("r_start") + 1)
    each = overlap_join(h.select(here).distinct(), b).groupBy(*here, "read").agg(*(F.bool_or(k).alias(k) for k in kinds), F.max("length").alias("length"))
    both = each.groupBy(here).agg(*(F.count_if(F.col(k)).alias(k) for k in kinds), F.max("length").alias("longest"), F.count_if(F.col("split") | F.col("indel")).alias("precise"), F.count("*").alias("every"), F.array_sort(F.collect_set("read")).alias("names"))
    clips = (F.col("precise") > 0) | ((F.col("left_clip") > 0) & (F.col("right_clip") > 0))
    got = both.select(*here, F.when(clips, F.col("every")).otherwise(F.col("precise")).alias("alt"), *kinds, "longest", "names")
    return h.join(got.hint("merge"), here, "left").select(*hypotheses.columns, "alt", *kinds, "longest", "names").na.fill(0, ["alt", *kinds, "longest"])


def windows_of_reads(windows: DataFrame, read: str, window: str) -> DataFrame:
    """read and the windows that name it, in order: how one union of reads is dealt out again."""
    return windows.groupBy(read).agg(F.array_sort(F.collect_set(window)).alias("windows"))


def best_records(reads: DataFrame, read: str, length: str, primary: str, order: str) -> DataFrame:
    """The record of each read name that stands for it: the longest, then a primary one, then the first in order."""
    best = reads.where(F.col(read).isNotNull()).groupBy(read).agg(F.min_by(F.struct(*reads.columns), F.struct((-F.col(length)).alias("n"), (~F.col(primary)).alias("p"), F.col(order).alias("o"))).alias("r"))
    return best.select("r.*")


def parent_reads(candidates: DataFrame, reads: DataFrame, fetch: int = 500) -> DataFrame:
    """candidate, source, read, pos, ref_end and inside: parents' reads that reach to within `fetch` of a child's event, and whether one reaches into the window that counts, half the event's span on either side but 30 to 100 bases. candidates: contig, candidate, start, end; reads: contig, source, read, pos, ref_end."""
    span = F.col("end") - F.col("start")
    w = F.least(F.greatest(F.floor(span / 2), F.lit(30)), F.lit(100))
    a = candidates.select("contig", "candidate", (F.col("start") - fetch).alias("l_start"), (F.col("end") + fetch).alias("l_end"), (F.col("start") - w).alias("lo"), (F.col("end") + w).alias("hi"))
    got = overlap_join(a, reads.select("contig", "source", "read", F.col("pos").alias("r_start"), F.col("ref_end").alias("r_end")))
    return got.select("candidate", "source", "read", F.col("r_start").alias("pos"), F.col("r_end").alias("ref_end"), ((F.col("r_end") > F.col("lo")) & (F.col("r_start") < F.col("hi"))).alias("inside"))


def seed_bins(pairs: DataFrame, k: int = 11, width: int = 8, most: int = 8) -> DataFrame:
    """id, bin, support, start: how many k-mers of a query stand in its window at one offset, by bins of the offset (truncated toward zero); the best `most` bins by support, then the smaller offset. pairs: id, query, target."""
    from loomseq.functions.sequence import kmers

    at = lambda c: F.posexplode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - k + 1, F.lit(1))), lambda i: F.substr(F.col(c), i, F.lit(k))))
    valid = F.rlike("kmer", F.lit(f"^[ACGT]{{{k}}}$"))
    q = pairs.where(F.col("id").isNotNull()).select("id", at("query").alias("i", "kmer")).where(valid)
    t = pairs.where(F.col("id").isNotNull()).select("id", at("target").alias("j", "kmer")).where(valid)
    # By the size of the files one side would be broadcast, and its k-mers, many times that, would pass through the driver.
    hits = q.join(t.hint("merge"), ["id", "kmer"]).withColumn("d", F.col("j") - F.col("i"))
    b = (F.signum("d") * F.floor(F.abs("d") / width)).cast("long")
    each = hits.groupBy("id", b.alias("bin")).agg(F.count("*").alias("support"), F.min("j").alias("start"))
    ranked = each.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("support"), F.abs("bin"), "bin", "start")))
    return ranked.where(F.col("n") <= most).select("id", "bin", "support", "start")


def best_flanks(flanks: DataFrame, key: str) -> DataFrame:
    """The flank of each key with the highest anchor less its mismatches and five times its large indels; then the longer anchor, the higher mapping quality, fewer mismatches, primary, the smaller start and distance. flanks: key, anchor, nm, large_indels, mapq, primary, start, distance and more."""
    score = F.col("anchor") - F.col("nm") - 5 * F.col("large_indels")
    rank = F.struct((-score).alias("a"), (-F.col("anchor")).alias("b"), (-F.col("mapq")).alias("c"), F.col("nm").alias("d"), (~F.col("primary")).alias("e"), F.col("start").alias("f"), F.col("distance").alias("g"))
    return flanks.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*flanks.columns), rank).alias("r")).select("r.*")
