"""Permissive parsing and clean-up of text fields, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_or(value: Column, default: int) -> Column:
    """The whole text as an integer, else the default."""
    return F.coalesce(F.when(F.rlike(F.trim(value), F.lit(r"^[+-]?[0-9]+$")), F.trim(value).try_cast("long")), F.lit(default).cast("long"))


def float_or(value: Column, default: float | None) -> Column:
    """The whole text as a finite number, else the default."""
    x = F.trim(value).try_cast("double")
    return F.coalesce(F.when(F.rlike(F.trim(value), F.lit(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")), x), F.lit(default).cast("double"))


def k_list(value: Column, fallback: int, least: int = 7, most: int = 31) -> Column:
    """Distinct k of a comma list within bounds, ascending; the fallback alone if there is none."""
    ks = F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda x: int_or(x, -1)), lambda k: k.between(least, most))
    return F.when(F.size(ks) > 0, F.array_sort(F.array_distinct(ks))).otherwise(F.array(F.lit(fallback).cast("long")))


def token(value: Column) -> Column:
    """A name fit for a file or a column: trimmed, other characters than letters, digits, dot, dash and underscore as underscores; NA if empty."""
    t = F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), r"[^A-Za-z0-9._\-]", "_")
    return F.when(t == "", "NA").otherwise(t)


def with_token(tokens: Column, new: Column, sep: str = "|") -> Column:
    """The tokens with one more, unless they hold it already as a substring."""
    have = F.coalesce(tokens, F.lit(""))
    return F.when(new.isNull() | (new == "") | F.contains(have, new), have).when(have == "", new).otherwise(F.concat(have, F.lit(sep), new))


def key_values(line: Column) -> Column:
    """Map of the k=v words of a log line; other words go, and the last of a repeated key counts."""
    words = F.filter(F.split(F.coalesce(line, F.lit("")), r"\s+"), lambda w: F.instr(w, "=") > 1)
    pairs = F.transform(words, lambda w: F.struct(F.substring_index(w, "=", 1).alias("k"), F.regexp_replace(w, "^[^=]*=", "").alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]))
