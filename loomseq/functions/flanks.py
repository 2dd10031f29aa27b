"""Columns over the sequences around a breakpoint: tails, duplications, windows, controls. All built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pure_tail(s: Column, base: str, least: float = 0.8) -> Column:
    """Length of the longest ending of s that is at least `least` of one base; 0 if none is. One pass from the end."""
    letters = F.filter(F.split(F.reverse(s), ""), lambda x: x != "")
    begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("hit"), F.lit(0).alias("best"))

    def step(a, x):
        n, hit = a["n"] + 1, a["hit"] + (x == base).cast("int")
        return F.struct(n.alias("n"), hit.alias("hit"), F.when(hit >= least * n - 1e-9, n).otherwise(a["best"]).alias("best"))

    return F.coalesce(F.aggregate(letters, begin, step, lambda a: a["best"]), F.lit(0))


def fixed_identity(a: Column, b: Column) -> Column:
    """1 - edits / longer length; null for two empty sequences."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer > 0, 1 - F.levenshtein(a, b) / longer)


def occurrence_fraction(region: Column, motif: Column) -> Column:
    """Overlapping occurrences of a motif by the places where it could stand; 1 where it cannot."""
    places = F.length(region) - F.length(motif) + 1
    hits = F.size(F.filter(F.sequence(F.lit(1), F.greatest(places, F.lit(1))), lambda i: F.substr(region, i, F.length(motif)) == motif))
    return F.when((F.length(motif) > 0) & (places > 0), hits / places).otherwise(1.0)


def duplication(left: Column, right: Column, region: Column, gap: Column, longest: int = 50, shortest: int = 3, rare: float = 0.05) -> Column:
    """Struct type, length, p: the longest ending of the left flank that begins the right one (A, C, G, T only): DUP if it is rare in the region, else UNCERTAIN. Without one DEL of a gap from 1 to `longest`, else NONE."""
    same = F.filter(
        F.sequence(F.lit(longest), F.lit(shortest), F.lit(-1)),
        lambda n: (F.length(left) >= n) & (F.length(right) >= n) & (F.right(left, n) == F.left(right, n)) & F.rlike(F.left(right, n), F.lit("^[ACGT]+$")),
    )
    n = F.get(same, F.lit(0))
    p = F.when(n.isNotNull(), occurrence_fraction(region, F.left(right, n)))
    kind = F.when(n.isNotNull(), F.when(p <= rare, "DUP").otherwise("UNCERTAIN")).when(gap.between(1, longest), "DEL").otherwise("NONE")
    return F.struct(kind.alias("type"), F.coalesce(n, F.when(kind == "DEL", gap), F.lit(0)).cast("int").alias("length"), p.alias("p"))


def shift_controls(left: Column, right: Column, lo: Column, hi: Column, step: int, most: int) -> Column:
    """array<struct<left, right>>: the breakpoints moved by -step, +step, -2 step and so on, within a closed window; `most` at most."""
    moves = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(most)), lambda i: F.array(-i * step, i * step)))
    moved = F.transform(moves, lambda m: F.struct((left + m).alias("left"), (right + m).alias("right")))
    return F.slice(F.filter(moved, lambda x: (x["left"] >= lo) & (x["right"] <= hi)), 1, most)


def event_length(lengths: Column) -> Column:
    """Median of the lengths above 0 (the mean of the middle two, truncated); null without any."""
    x = F.array_sort(F.filter(lengths, lambda v: v > 0))
    n = F.size(x)
    return F.when(n > 0, F.floor((F.get(x, F.floor((n - 1) / 2).cast("int")) + F.get(x, F.floor(n / 2).cast("int"))) / 2))


def genotype_proxy(alt: Column, ref: Column) -> Column:
    """Quality from the balance of counts, 0 to 99, half to even."""
    return F.bround(F.least(F.greatest(20 + 20 * F.ln((alt + 1.0) / (ref + 1.0)), F.lit(0.0)), F.lit(99.0)), 0).cast("int")
