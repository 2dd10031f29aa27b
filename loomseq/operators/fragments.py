"""Pieces of reads that may be inserted: clips and insertions of an alignment string, and what lies between split alignments.

All of a read stands in one row, with arrays over its own few alignments; the
only shuffle is the join of a read with its supplementary records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomseq.functions import alignment as A
from loomseq.functions.sequence import cigar_length, reference_end

#: Least clip, insertion and split piece, the insertions kept of a read and near its component, reach of the component.
LEAST, LONGEST_KEPT, MOST_KEPT, LOCAL = 50, 2, 4, 1000
#: Fixed values of split pieces: supplementary records reported, reach of a flank, of its anchor, of the piece; overlap of two alignments, trimmed ends, positions that count as equal.
MOST_SPLIT, FLANK_REACH, PIECE, OVERLAP, TRIM, NEAR = 3, 5000, 100, 20, 12, 5
#: How far a read's supplementary record may differ from its tag: shared part of both, and either end.
SHARED, ENDS = 0.9, 5

_long = lambda c: c.cast("long")
_INS = "cast(array() as array<struct<start:bigint,length:bigint,pos:bigint,left:bigint,right:bigint>>)"


def insertion_floor(split_or_indel: Column, clipped: Column, least: int = LEAST, short: int = 35, reads: int = 2) -> Column:
    """Least insertion of a component: `short` (10 at least) where two reads or more are split or hold an insertion and no fewer than are clipped."""
    return F.when((split_or_indel > 0) & (split_or_indel >= clipped) & (split_or_indel >= max(1, reads)), min(least, max(10, short))).otherwise(least)


def long_insertions(cigar: Column, pos: Column, least: Column) -> Column:
    """array<struct<start (on the read), length, pos, left, right>>: insertions with the runs of matches right before and behind them."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,pos:bigint,left:bigint,right:bigint>")
    zero = _long(F.lit(0))
    begin = F.struct(zero.alias("q"), zero.alias("run"), F.lit(False).alias("open"), none.alias("now"), F.expr(_INS).alias("done"))

    def step(s: Column, n: Column, op: Column, at: Column) -> Column:
        match, new = op.isin("M", "=", "X"), (op == "I") & (n >= least)
        now = s["now"]
        grown = F.struct(now["start"].alias("start"), now["length"].alias("length"), now["pos"].alias("pos"), now["left"].alias("left"), (now["right"] + n).alias("right"))
        fresh = F.struct(s["q"].alias("start"), n.alias("length"), at.alias("pos"), s["run"].alias("left"), zero.alias("right"))
        return F.struct(
            (s["q"] + F.when(op.isin("M", "I", "S", "=", "X"), n).otherwise(zero)).alias("q"), F.when(match, s["run"] + n).otherwise(zero).alias("run"), (new | (match & s["open"])).alias("open"),
            F.when(new, fresh).when(match & s["open"], grown).otherwise(now).alias("now"), F.when(new & now.isNotNull(), F.concat(s["done"], F.array(now))).otherwise(s["done"]).alias("done"),
        )

    s = A.walk(cigar, pos, begin, step)
    return F.transform(F.array(s), lambda x: F.when(x["now"].isNotNull(), F.concat(x["done"], F.array(x["now"]))).otherwise(x["done"]))[0]


_ID = ("contig", "anchor", "read", "record")


def _name(source: str, *parts: tuple[str, Column]) -> Column:
    """The fragment's name: place, read, record, strand, source and what sets it apart."""
    token = F.replace(F.regexp_replace(F.col("read").cast("string"), r"\s", "_"), F.lit("|"), F.lit("/"))
    head = F.concat(F.col("contig"), F.lit(":"), F.col("anchor"), F.lit("|read="), token, F.lit("|idx="), F.col("record"), F.lit("|strand="), F.when(F.col("flag").bitwiseAND(F.lit(16)) != 0, "-").otherwise("+"), F.lit(f"|src={source}"))
    return F.concat(head, *(F.concat(F.lit(f"|{n}="), c.cast("string")) for n, c in parts))


def clip_and_insertion_fragments(reads: DataFrame, least: Column | int = LEAST) -> DataFrame:
    """component, contig, anchor, read, record, source (clip_left, clip_right, insertion), start, length, anchor_len, side, junction, nm, sequence, name: long clips of every record, and of records at the highest mapping quality the long insertions (the two longest, and up to four with those near the component).

    reads: component, contig, anchor, read, record (its number), flag, mapq, pos,
    cigar, sequence, nm. A null sequence or alignment string gives none.
    """
    c, seq = F.col, F.coalesce("sequence", F.lit(""))
    n = _long(F.length(seq))
    rows = reads.withColumns({
        "__lead": A.lead_clip(c("cigar")), "__trail": A.trail_clip(c("cigar")), "__anchors": A.clip_anchors(c("cigar")),
        "__ins": F.when(c("mapq") == A.INSERTION_MAPQ, long_insertions(c("cigar"), c("pos"), least if isinstance(least, Column) else F.lit(least))).otherwise(F.expr(_INS)),
    })
    ordered = F.sort_array(F.transform(F.array_distinct("__ins"), lambda x: F.struct((-x["length"]).alias("n"), x["pos"].alias("p"), x["start"].alias("s"), x.alias("x"))))
    kept = F.slice(F.filter(ordered, lambda x, i: (i < LONGEST_KEPT) | (F.abs(x["p"] - c("anchor")) <= LOCAL)), 1, MOST_KEPT)

    def piece(source: str, start: Column, length: Column, anchor: Column, side: str, junction: Column, *parts: tuple[str, Column], tag: str = "") -> Column:
        return F.struct(F.lit(source).alias("source"), _long(start).alias("start"), _long(length).alias("length"), _long(anchor).alias("anchor_len"), F.lit(side).alias("side"), _long(junction).alias("junction"), _name(tag, *parts, ("rj", junction), ("len", length)).alias("name"))

    end = reference_end(c("pos"), F.coalesce("cigar", F.lit("")))
    clips = F.array(
        F.when(c("__lead") >= LEAST, piece("clip_left", F.lit(0), c("__lead"), c("__anchors.left"), "left", c("pos"), tag="clipRefL")),
        F.when(c("__trail") >= LEAST, piece("clip_right", F.greatest(n - c("__trail"), F.lit(0)), c("__trail"), c("__anchors.right"), "right", end, tag="clipRefR")),
    )
    inner = F.transform(kept, lambda k: piece("insertion", k["x"]["start"], k["x"]["length"], F.least(k["x"]["left"], k["x"]["right"]), "unknown", k["x"]["pos"], ("start", k["x"]["start"]), tag="ins"))
    each = rows.select("component", *_ID, F.coalesce("nm", F.lit(-1)).alias("nm"), seq.alias("__seq"), F.explode(F.filter(F.concat(clips, inner), lambda f: f.isNotNull())).alias("f"))
    text = F.substr("__seq", (c("f.start") + 1).cast("int"), c("f.length").cast("int"))
    return each.select("component", *_ID, "f.source", "f.start", "f.length", "f.anchor_len", "f.side", "f.junction", "nm", text.alias("sequence"), "f.name").where("sequence <> ''")


def own_interval(cigar: Column, length: Column) -> Column:
    """Struct start, end on the read of a record that holds its whole sequence: between its clips, else from the leading clip as far as its operations go; null where neither fits."""
    parts = F.struct(A.lead_clip(cigar).alias("a"), A.trail_clip(cigar).alias("b"), cigar_length(F.coalesce(cigar, F.lit("")), "MI=X").alias("n"))

    def decide(p: Column) -> Column:
        end = F.when(length - p["b"] > p["a"], length - p["b"]).otherwise(p["a"] + p["n"])
        return F.when((length > 0) & (p["n"] > 0) & (end > p["a"]) & (end <= length), F.struct(_long(p["a"]).alias("start"), _long(end).alias("end")))

    return F.transform(F.array(parts), decide)[0]


def _overlap(a: Column, b: Column) -> Column:
    return F.greatest(F.least(a["qe"], b["qe"]) - F.greatest(a["qs"], b["qs"]), _long(F.lit(0)))


def _insert_between(a: Column, b: Column) -> Column:
    """Bases between two alignments of a contig and strand on the read, beyond those between them on the reference; -1 otherwise."""
    first = b["qs"] < a["qs"]
    gap = F.when(first, a["qs"] - b["qe"] - F.greatest(a["rs"] - b["re"], _long(F.lit(0)))).otherwise(b["qs"] - a["qe"] - F.greatest(b["rs"] - a["re"], _long(F.lit(0))))
    return F.when((a["contig"] == b["contig"]) & (a["rev"] == b["rev"]), gap).otherwise(-1)


def split_fragments(reads: DataFrame) -> DataFrame:
    """component, contig, anchor, read, record, start, length, anchor_len, side, junction, nm, reliable, sequence, name: what a split read holds beside its flank at the component, and else each supplementary alignment behind an insertion.

    reads: as above, with sa (the supplementary tag). Primary records with a tag
    give pieces. A tag's alignment is reliable if a supplementary record of the
    read in the component agrees with it on strand and place on the read, or if
    the read has no such record. The flank is the best alignment at the
    component, its mate the reliable one that it overlaps least; a pair without
    an insertion of 50 bases between gives nothing.
    """
    c, zero = F.col, _long(F.lit(0))
    flag = F.coalesce("flag", F.lit(0))
    seq = F.coalesce("sequence", F.lit(""))
    n = _long(F.length(seq))
    reverse = flag.bitwiseAND(F.lit(16)) != 0
    rows = A.once(reads.withColumns({"flag": flag, "sequence": seq, "__rev": reverse}), __q=own_interval(c("cigar"), _long(F.length("sequence")))).where("__q IS NOT NULL")
    extra = rows.where((flag.bitwiseAND(F.lit(0x800)) != 0) & (flag.bitwiseAND(F.lit(0x100)) == 0)).groupBy("component", "read").agg(F.array_sort(F.collect_list(F.struct("record", c("__rev").alias("rev"), c("__q.start").alias("qs"), c("__q.end").alias("qe")))).alias("__supp"))  # a read's own records
    main = rows.where((flag.bitwiseAND(F.lit(0x900)) == 0) & (F.coalesce("sa", F.lit("")) != "")).join(extra, ["component", "read"], "left")

    def candidate(contig, rs, re, q, rev, mapq, nm, primary, reliable, cigar, idx) -> Column:
        return A.let(A.anchor_near(cigar, rs, c("anchor")), lambda near: F.struct(contig.alias("contig"), _long(rs).alias("rs"), _long(re).alias("re"), q["start"].alias("qs"), q["end"].alias("qe"), rev.alias("rev"), F.coalesce(mapq, F.lit(0)).cast("int").alias("mapq"), F.coalesce(nm, F.lit(-1)).cast("int").alias("nm"), primary.alias("primary"), reliable.alias("reliable"), near["length"].alias("anchor"), near["large_indel"].alias("indel"), idx.alias("idx")))

    def agrees(m: Column) -> Column:
        begin = F.struct(F.lit(0.0).alias("iou"), F.lit(1 << 40).alias("a"), F.lit(1 << 40).alias("b"))

        def step(s: Column, x: Column) -> Column:
            union = F.greatest(x["qe"], m["q"]["end"]) - F.least(x["qs"], m["q"]["start"])
            iou = F.when(union > 0, F.greatest(F.least(x["qe"], m["q"]["end"]) - F.greatest(x["qs"], m["q"]["start"]), zero) / union).otherwise(0.0)
            better = (x["rev"] == m["rev"]) & (iou > s["iou"])
            return F.when(better, F.struct(iou.alias("iou"), _long(F.abs(x["qs"] - m["q"]["start"])).alias("a"), _long(F.abs(x["qe"] - m["q"]["end"])).alias("b"))).otherwise(s)

        return F.aggregate("__supp", begin, step, lambda s: (s["iou"] >= SHARED) & (s["a"] <= ENDS) & (s["b"] <= ENDS))

    entries = F.transform(A.supplementary(c("sa")), lambda m: F.struct(m["contig"].alias("contig"), _long(F.greatest(m["pos"], F.lit(0))).alias("rs"), A.query_interval(m["cigar"], n).alias("q"), (m["strand"] == "-").alias("rev"), m["mapq"].alias("mapq"), m["nm"].alias("nm"), m["cigar"].alias("cigar"), (m["pos"] + 1).alias("told")))
    main = A.once(main, __tags=F.filter(entries, lambda m: m["q"].isNotNull() & (m["q"]["end"] - m["q"]["start"] >= LEAST)))
    all_ = F.transform("__tags", lambda m, i: candidate(m["contig"], m["rs"], reference_end(m["rs"], m["cigar"]), m["q"], m["rev"], m["mapq"], m["nm"], F.lit(False), F.when(c("__supp").isNull(), F.lit(True)).otherwise(F.coalesce(agrees(m), F.lit(False))), m["cigar"], i + 1))
    main = A.once(main, __all=all_, __own=candidate(c("contig"), c("pos"), reference_end(c("pos"), c("cigar")), c("__q"), c("__rev"), c("mapq"), c("nm"), F.lit(True), F.lit(True), c("cigar"), F.lit(0)))
    main = main.withColumn("__core", F.concat(F.array("__own"), F.filter("__all", lambda x: x["reliable"])))

    away = lambda x: F.greatest(x["rs"] - c("anchor"), c("anchor") - x["re"], zero)
    there = F.filter("__core", lambda x: (x["contig"] == c("contig")) & (away(x) <= FLANK_REACH))
    score = lambda x: x["anchor"] - (F.greatest(x["nm"], F.lit(0)) + 5 * x["indel"].cast("int"))
    ranked = F.transform(there, lambda x: F.struct((-score(x)).alias("a"), (-x["anchor"]).alias("b"), (-x["mapq"]).alias("c"), x["nm"].alias("d"), (~x["primary"]).alias("e"), x["rs"].alias("f"), away(x).alias("g"), x["idx"].alias("h"), x.alias("x")))
    main = A.once(main, __flank=F.array_min(ranked)["x"])
    alone = lambda x: x["qe"] - x["qs"] - _overlap(x, c("__flank"))
    mates = F.transform(F.filter("__core", lambda x: x["idx"] != c("__flank.idx")), lambda x: F.struct((-alone(x)).alias("a"), x["idx"].alias("b"), x.alias("x")))
    main = A.once(main, __mate=F.array_min(mates))
    f, m = c("__flank"), c("__mate")["x"]
    paired = F.coalesce(f.isNotNull() & (-c("__mate")["a"] >= LEAST), F.lit(False))
    main = A.once(main, __paired=paired).where(~paired | (_insert_between(f, m) >= LEAST))
    shared = _overlap(f, m)
    junction = (
        F.when(f["qe"] <= m["qs"] + OVERLAP, f["qe"]).when(m["qe"] <= f["qs"] + OVERLAP, f["qs"])
        .when(shared <= OVERLAP, F.floor((F.greatest(f["qs"], m["qs"]) + F.least(f["qe"], m["qe"])) / 2))
    )
    main = A.once(main, __j=F.when(c("__paired"), _long(junction)))
    j = c("__j")
    trimmed = f["qe"] - TRIM > f["qs"] + TRIM
    lo, hi = F.when(trimmed, f["qs"] + TRIM).otherwise(f["qs"]), F.when(trimmed, f["qe"] - TRIM).otherwise(f["qe"])
    a, b = F.greatest(j - PIECE, zero), F.least(j + PIECE, n)
    meets = (a < hi) & (b > lo)
    left_longer = F.greatest(lo - a, zero) >= F.greatest(b - hi, zero)
    start = F.when(meets & (j > lo) & (j >= hi), F.greatest(a, hi)).when(meets & (j > lo) & (j < hi) & ~left_longer, hi).otherwise(a)
    stop = F.when(meets & (j <= lo), F.least(b, lo)).when(meets & (j > lo) & (j < hi) & left_longer, lo).otherwise(b)
    on_left = F.abs(j - f["qe"]) <= F.abs(j - f["qs"])
    place = F.when(on_left == f["rev"], f["rs"]).otherwise(f["re"])
    left, right = place <= c("anchor") + NEAR, place >= c("anchor") - NEAR
    side = F.when(left & ~right, "left").when(right & ~left, "right").otherwise("unknown")
    robust = F.struct(start.alias("start"), (stop - start).alias("length"), f["anchor"].alias("anchor_len"), side.alias("side"), place.alias("junction"), f["nm"].alias("nm"), (f["reliable"] & m["reliable"]).alias("reliable"), _name("splitSA", ("qj", j), ("rj", place), ("len", stop - start)).alias("name"))
    main = A.once(main, __robust=F.when(j.isNotNull() & (stop - start >= LEAST), robust))

    behind = F.filter("__all", lambda x: (x["qs"] >= 0) & (x["qe"] <= n) & (_insert_between(c("__own"), x) >= LEAST))
    behind = F.slice(behind, F.lit(1), F.when(c("__robust").isNotNull(), MOST_SPLIT - 1).otherwise(MOST_SPLIT))
    told = lambda x: F.get("__tags", x["idx"] - 1)
    others = F.transform(behind, lambda x: F.struct(
        x["qs"].alias("start"), (x["qe"] - x["qs"]).alias("length"), x["anchor"].alias("anchor_len"), F.lit("unknown").alias("side"), _long(F.lit(-1)).alias("junction"), x["nm"].alias("nm"), x["reliable"].alias("reliable"),
        _name("splitSA", ("sa_idx", x["idx"]), ("sa", F.concat(F.replace(F.regexp_replace(x["contig"], r"\s", "_"), F.lit("|"), F.lit("/")), F.lit(":"), told(x)["told"], F.when(x["rev"], "-").otherwise("+"))), ("qlen", x["qe"] - x["qs"])).alias("name"),
    ))
    each = main.select("component", *_ID, "sequence", F.explode(F.concat(F.filter(F.array("__robust"), lambda x: x.isNotNull()), others)).alias("f"))
    text = F.substr("sequence", (c("f.start") + 1).cast("int"), c("f.length").cast("int"))
    return each.select("component", *_ID, "f.start", "f.length", "f.anchor_len", "f.side", "f.junction", "f.nm", "f.reliable", text.alias("text"), "f.name").where("text <> ''").withColumnRenamed("text", "sequence")
