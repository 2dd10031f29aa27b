"""Text formats of sequencing as DataFrames. The parse_* functions take a DataFrame with a string column `value`, a line each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of plain or gzip text files."""
    return spark.read.text(path)


def _fields(lines: DataFrame, comment: str) -> DataFrame:
    return lines.where(F.col("value").isNotNull() & (F.length("value") > 0) & ~F.col("value").startswith(comment)).select(F.split("value", "\t").alias("f"))


def _f(i: int) -> Column:
    return F.get("f", F.lit(i))


def parse_sam(lines: DataFrame) -> DataFrame:
    """qname, flag, contig, pos (from 0), mapq, cigar, seq, nm, sa. Headers go; `*` is null; a number that does not parse is null."""
    rows = _fields(lines, "@")
    star = lambda c: F.when(c != "*", c)
    tag = lambda name, kind: F.get(F.filter(F.slice("f", 12, 1 << 20), lambda x: x.startswith(f"{name}:{kind}:")), F.lit(0)).substr(6, 1 << 30)
    return rows.select(
        _f(0).alias("qname"), _f(1).try_cast("int").alias("flag"), star(_f(2)).alias("contig"), (_f(3).try_cast("int") - 1).alias("pos"), _f(4).try_cast("int").alias("mapq"),
        star(_f(5)).alias("cigar"), star(_f(9)).alias("seq"), tag("NM", "i").try_cast("long").alias("nm"), tag("SA", "Z").alias("sa"),
    )


def parse_vcf_insertions(lines: DataFrame, passed_only: bool = False, min_quality: float | None = None, min_length: int = 0) -> DataFrame:
    """id, contig, pos (from 1), end, length, support, filter, quality, alt of the records with SVTYPE=INS.

    A symbolic or breakend alternative is null, an empty filter PASS, a missing
    id contig:pos:INS. The length floor applies to lengths other than 0.
    """
    rows = _fields(lines, "#").withColumn("info", F.str_to_map(_f(7), F.lit(";"), F.lit("=")))
    info = lambda k: F.try_element_at("info", F.lit(k))
    named = lambda c, other: F.when(c.isNull() | c.isin("", "."), other).otherwise(c)
    contig, pos = _f(0), _f(1).try_cast("int")
    out = rows.where(info("SVTYPE") == "INS").select(
        named(_f(2), F.concat_ws(":", contig, _f(1), F.lit("INS"))).alias("id"), contig.alias("contig"), pos.alias("pos"), F.coalesce(info("END").try_cast("int"), pos).alias("end"),
        F.abs(info("SVLEN").try_cast("int")).alias("length"), info("SUPPORT").try_cast("int").alias("support"), named(_f(6), F.lit("PASS")).alias("filter"), _f(5).try_cast("double").alias("quality"),
        F.when(~F.rlike(_f(4), F.lit(r"[<>\[\]*.]")), _f(4)).alias("alt"),
    )
    if passed_only:
        out = out.where(F.col("filter") == "PASS")
    if min_quality is not None:
        out = out.where(F.col("quality") >= min_quality)
    return out.where(F.coalesce(F.col("length"), F.lit(0)).isin(0) | (F.col("length") >= min_length))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name (first word of the header), sequence (upper case, lines joined). Records without a name or a sequence go. A record is one row; it is split at `>` that begins a line, not read with its file."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>|\r", "").alias("v"))
    head = F.substring_index("v", "\n", 1)
    body = F.when(F.instr("v", "\n") > 0, F.regexp_replace(F.expr("substring(v, instr(v, '\n') + 1)"), r"\s", ""))
    return raw.select(F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.upper(body).alias("sequence")).where((F.col("name") != "") & (F.col("sequence") != ""))


def family_of(name: Column) -> Column:
    """Struct family, subfamily of a library name: sub#Class/Family, Family:sub, or the bare name for both."""
    hashed, colon = F.instr(name, "#") > 0, F.instr(name, ":") > 0
    sub = F.when(hashed, F.substring_index(name, "#", 1)).when(colon, F.substring_index(name, ":", -1)).otherwise(name)
    fam = F.when(hashed, F.substring_index(F.substring_index(name, "#", -1), "/", -1)).when(colon, F.substring_index(name, ":", 1)).otherwise(name)
    return F.struct(fam.alias("family"), sub.alias("subfamily"))


def contig_aliases(contig: Column) -> Column:
    """Array of names for a contig, itself first: chr added or taken away, and the spellings of the mitochondrion."""
    bare = F.regexp_replace(contig, "^(?i)chr", "")
    mito = F.upper(bare).isin("M", "MT")
    other = F.when(contig != bare, bare).otherwise(F.concat(F.lit("chr"), contig))
    more = F.when(mito, F.array(*map(F.lit, ("M", "MT", "chrM", "chrMT")))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(contig, other), more))


def region(text: str) -> tuple[str, int, int | None]:
    """contig, start, end (half-open from 0; None: the contig's end) of `contig` or `contig:first-last` (from 1, both included)."""
    contig, colon, span = text.rpartition(":")
    if not colon:
        return text, 0, None
    first, dash, last = span.partition("-")
    if not (contig and dash and first.isdigit() and last.isdigit()) or not 1 <= int(first) <= int(last) < 1 << 31:
        raise ValueError(f"not a region: {text!r}")
    return contig, int(first) - 1, int(last)
