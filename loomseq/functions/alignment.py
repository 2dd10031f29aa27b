"""Columns over alignment strings and supplementary-alignment tags: intervals, insertions, clips, split signals. All built-in expressions.

What needs positions walks an alignment string once and keeps only what it looks
for, so strings of very many operations take their length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomseq.functions.sequence import cigar_length, reference_end

#: Operations that advance on the reference. Fixed value.
REFERENCE = "MDN=X"
#: Least insertion that is a signal, least clip that is a hint, and the mapping quality that insertions need. Fixed values.
LONG_INSERTION, CLIP_HINT, INSERTION_MAPQ = 50, 20, 60
_HITS = "cast(array() as array<struct<pos:bigint,length:bigint>>)"
_SIGNALS = "cast(array() as array<struct<pos:bigint,length:bigint,source:string>>)"


def _long(c: Column) -> Column:
    return c.cast("long")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once, however often later ones name them: the optimizer moves neither expressions nor conditions across a generator."""
    packed = F.struct(*(c.alias(n) for n, c in columns.items()))
    return df.withColumn("__packed", F.explode(F.array(packed))).select(*df.columns, "__packed.*")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.transform(F.array(value), then)[0]


def walk(cigar: Column, pos: Column, begin: Column, step: Callable[[Column, Column, Column, Column], Column]) -> Column:
    """The state after all operations of an alignment string, from step(state, length, operation, position on the reference)."""
    parts = F.regexp_extract_all(F.coalesce(cigar, F.lit("")), F.lit("([0-9]+[MIDNSHP=X])"), 1)
    ops = F.transform(parts, lambda p: F.struct(F.substring(p, 1, F.length(p) - 1).cast("long").alias("n"), F.right(p, F.lit(1)).alias("op")))
    on = lambda x: F.when(F.contains(F.lit(REFERENCE), x["op"]), x["n"]).otherwise(_long(F.lit(0)))
    return F.aggregate(ops, F.struct(_long(pos).alias("at"), begin.alias("s")), lambda a, x: F.struct((a["at"] + on(x)).alias("at"), step(a["s"], x["n"], x["op"], a["at"]).alias("s")), lambda a: a["s"])


def lead_clip(cigar: Column) -> Column:
    """Soft-clipped bases at the start, behind hard clips; 0 without."""
    return F.coalesce(F.regexp_extract(F.coalesce(cigar, F.lit("")), r"^(?:[0-9]+H)*([0-9]+)S", 1).try_cast("long"), _long(F.lit(0)))


def trail_clip(cigar: Column) -> Column:
    """Soft-clipped bases at the end, before hard clips; 0 without, and where the whole string is one clip."""
    return F.coalesce(F.regexp_extract(F.coalesce(cigar, F.lit("")), r"[MIDNP=X]([0-9]+)S(?:[0-9]+H)*$", 1).try_cast("long"), _long(F.lit(0)))


def query_interval(cigar: Column, length: Column) -> Column:
    """Struct start, end on the read of what is aligned, from the clips: after the leading one, else before the trailing one, else the whole read; null where these do not fit."""
    parts = F.struct(lead_clip(cigar).alias("lead"), trail_clip(cigar).alias("trail"), cigar_length(F.coalesce(cigar, F.lit("")), "MI=X").alias("n"))

    def decide(p: Column) -> Column:
        start = F.when(p["lead"] > 0, p["lead"]).when(p["trail"] > 0, length - p["trail"] - p["n"]).when(p["n"] == length, _long(F.lit(0)))
        return F.when((length > 0) & (p["n"] > 0) & (start >= 0) & (start + p["n"] <= length), F.struct(_long(start).alias("start"), _long(start + p["n"]).alias("end")))

    return F.transform(F.array(parts), decide)[0]  # one element, so that the parts are found once


def insertions(cigar: Column, pos: Column, least: int) -> Column:
    """array<struct<pos, length>> of the insertions of at least this length."""
    return walk(cigar, pos, F.expr(_HITS), lambda s, n, op, at: F.when((op == "I") & (n >= least), F.concat(s, F.array(F.struct(at.alias("pos"), n.alias("length"))))).otherwise(s))


def supplementary(sa: Column) -> Column:
    """array<struct<contig, pos (from 0), strand, cigar, mapq, nm>> of a supplementary-alignment tag, up to its first empty record; records of fewer than four fields are left out."""
    upto = F.substring_index(F.concat(F.lit(";"), F.coalesce(sa, F.lit(""))), ";;", 1)
    records = F.filter(F.transform(F.split(upto, ";"), lambda r: F.split(r, ",")), lambda f: F.size(f) >= 4)
    number = lambda f, i, kind: F.get(f, F.lit(i)).try_cast(kind)
    return F.transform(
        records,
        lambda f: F.struct(F.get(f, F.lit(0)).alias("contig"), (number(f, 1, "long") - 1).alias("pos"), F.get(f, F.lit(2)).alias("strand"), F.get(f, F.lit(3)).alias("cigar"), number(f, 4, "int").alias("mapq"), number(f, 5, "int").alias("nm")),
    )


def with_signatures(reads: DataFrame, out: str = "signatures") -> DataFrame:
    """reads with `out`, array<struct<pos, length, source>>: every long insertion of a read's alignment (`cigar`), the longest insertion by a supplementary alignment of the same contig and strand (`split`); only without either, its long clips (`clip`). None for a supplementary read.

    reads: contig, pos, flag, mapq, cigar, length, sa. An insertion between two
    alignments is the gap on the read less the gap on the reference, after the
    one that comes first on the read.
    """
    c = F.col
    flag, strand = F.coalesce("flag", F.lit(0)), F.when(F.coalesce("flag", F.lit(0)).bitwiseAND(F.lit(16)) != 0, "-").otherwise("+")
    text = lambda x: F.coalesce(x, F.lit(""))
    rows = reads.withColumns({
        "__own": F.struct(_long(c("pos")).alias("from"), _long(reference_end(c("pos"), text(c("cigar")))).alias("to"), query_interval(c("cigar"), c("length")).alias("q")),
        "__mates": F.filter(supplementary(c("sa")), lambda m: (m["contig"] == c("contig")) & (m["strand"] == strand)),
    })
    rows = rows.withColumn("__mates", F.transform("__mates", lambda m: F.struct(_long(m["pos"]).alias("from"), _long(reference_end(m["pos"], text(m["cigar"]))).alias("to"), query_interval(m["cigar"], c("length")).alias("q"))))

    def gap(m: Column) -> Column:
        o = c("__own")
        first = m["q"]["start"] < o["q"]["start"]
        after = F.when(first, o["q"]["start"] - m["q"]["end"] - F.greatest(o["from"] - m["to"], F.lit(0))).otherwise(m["q"]["start"] - o["q"]["end"] - F.greatest(m["from"] - o["to"], F.lit(0)))
        return F.struct(after.alias("length"), F.when(first, m["to"]).otherwise(o["to"]).alias("pos"))

    best = F.aggregate(F.transform("__mates", gap), F.struct(_long(F.lit(LONG_INSERTION - 1)).alias("length"), _long(F.lit(-1)).alias("pos")), lambda a, x: F.when(x["length"] > a["length"], x).otherwise(a))
    rows = rows.withColumns({"__split": best, "__in": F.when(c("mapq") == INSERTION_MAPQ, insertions(c("cigar"), c("pos"), LONG_INSERTION)).otherwise(F.expr(_HITS))})
    signal = lambda p, n, source: F.struct(_long(p).alias("pos"), _long(n).alias("length"), F.lit(source).alias("source"))
    both = F.concat(F.transform("__in", lambda x: signal(x["pos"], x["length"], "cigar")), F.when(c("__split.pos") >= 0, F.array(signal(c("__split.pos"), c("__split.length"), "split"))).otherwise(F.expr(_SIGNALS)))
    clips = F.filter(F.array(signal(c("pos"), lead_clip(c("cigar")), "clip"), signal(c("__own.to"), trail_clip(c("cigar")), "clip")), lambda x: x["length"] >= CLIP_HINT)
    rows = once(rows, __both=both)
    found = F.when(flag.bitwiseAND(F.lit(0x800)) != 0, F.expr(_SIGNALS)).when(F.size("__both") > 0, c("__both")).otherwise(clips)
    return once(rows, **{out: found}).drop("__own", "__mates", "__split", "__in", "__both")


def anchor_near(cigar: Column, pos: Column, breakpoint: Column, reach: int = 150, indel: int = 20) -> Column:
    """Struct length, large_indel: bases of the alignment within `reach` of a breakpoint (matched, deleted, and inserted there), and whether an insertion or deletion of `indel` touches that window."""
    lo, hi = breakpoint - reach, breakpoint + reach + 1

    def step(s: Column, n: Column, op: Column, at: Column) -> Column:
        shared = F.greatest(F.least(at + n, hi) - F.greatest(at, lo), _long(F.lit(0)))
        inside = (op == "I") & (at >= lo) & (at < hi)
        gone = op.isin("D", "N") & (shared > 0)
        more = F.when(op.isin("M", "=", "X", "D", "N"), shared).when(inside, n).otherwise(_long(F.lit(0)))
        return F.struct((s["length"] + more).alias("length"), (s["large_indel"] | ((n >= indel) & (inside | gone))).alias("large_indel"))

    return walk(cigar, pos, F.struct(_long(F.lit(0)).alias("length"), F.lit(False).alias("large_indel")), step)


def clip_anchors(cigar: Column) -> Column:
    """Struct left, right: matched bases in one run beside the leading and the trailing soft clip; 0 without the clip."""
    total = lambda runs: F.aggregate(F.regexp_extract_all(runs, F.lit("([0-9]+)[M=X]"), 1), F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))
    c = F.coalesce(cigar, F.lit(""))
    left = F.regexp_extract(c, r"^(?:[0-9]+H)*[0-9]+S((?:[0-9]+[M=X])+)", 1)
    right = F.regexp_extract(c, r"(?<![0-9])((?:[0-9]+[M=X])+)[0-9]+S(?:[0-9]+H)*$", 1)
    return F.struct(total(left).alias("left"), total(right).alias("right"))


def event_signal(cigar: Column, pos: Column, lo: Column, hi: Column, clip: int = CLIP_HINT, insertion: int = LONG_INSERTION) -> Column:
    """Struct left_clip, right_clip, nearest_insertion (position), longest_insertion within a closed window of the reference."""
    end = reference_end(pos, F.coalesce(cigar, F.lit("")))
    far = _long(F.lit(1 << 62))

    def step(s: Column, n: Column, op: Column, at: Column) -> Column:
        here = (op == "I") & at.between(lo, hi)
        d = F.abs(2 * at - lo - hi)
        near = here & (n >= insertion) & (d < s["d"])
        return F.struct(F.when(near, d).otherwise(s["d"]).alias("d"), F.when(near, at).otherwise(s["at"]).alias("at"), F.when(here & (n > s["longest"]), n).otherwise(s["longest"]).alias("longest"))

    found = walk(cigar, pos, F.struct(far.alias("d"), F.lit(None).cast("long").alias("at"), _long(F.lit(0)).alias("longest")), step)
    side = lambda n, p: (n >= clip) & p.between(lo, hi)
    return F.struct(side(lead_clip(cigar), pos).alias("left_clip"), side(trail_clip(cigar), end).alias("right_clip"), found["at"].alias("nearest_insertion"), found["longest"].alias("longest_insertion"))
