"""Tab-separated tables of calls, truth and controls: readers with a preamble, and sinks with a fixed column order.

Readers take lines (a DataFrame with a string column `value`); rows that do not
parse are nulls in the fields concerned, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING = ("", ".", "NA", "na", "N/A", "None", "none", "nan", "NaN")


def known(c: Column) -> Column:
    """The text, trimmed; null for a missing mark."""
    t = F.trim(c)
    return F.when(~t.isin(*MISSING), t)


def number(c: Column, kind: str = "double") -> Column:
    return known(c).try_cast(kind)


def parse_table(lines: DataFrame, required: list[str]) -> DataFrame:
    """The rows below the header, each field a string column of the header's name. Lines that begin with # and what stands before the header go.

    The header is the first line that names all required columns (a table
    without one is an error). Short rows have nulls, further fields go.
    """
    has = F.lit(True)
    cells = F.split(F.regexp_replace("value", "^#", ""), "\t")
    for c in required:
        has = has & F.array_contains(cells, c)
    head = lines.where(has).select("value").first()
    if head is None:
        raise ValueError(f"no header with {required}")
    names = head[0].lstrip("#").split("\t")
    rows = lines.where((F.col("value") != head[0]) & ~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.split("value", "\t").alias("f"))
    rows = rows.where(F.size("f") > 2) if len(names) > 2 else rows  # key and value lines of a summary
    return rows.select(*(F.get("f", F.lit(i)).alias(n) for i, n in enumerate(names)))


def parse_summary(lines: DataFrame) -> DataFrame:
    """key, value of the two-field lines of a table's preamble."""
    f = lines.where(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("f")).where(F.size("f") == 2)
    return f.select(F.get("f", F.lit(0)).alias("key"), F.get("f", F.lit(1)).alias("value"))


def best_hits(lines: DataFrame) -> DataFrame:
    """key, family, subfamily, identity, coverage of rows query, hit, identity, coverage: the key is the query up to a bar, the hit is family:subfamily (one name is both), and the last row of a key counts."""
    f = lines.where(F.size(F.split("value", "\t")) >= 2).withColumn("__n", F.monotonically_increasing_id()).select("__n", F.split("value", "\t").alias("f"))
    hit = F.get("f", F.lit(1))
    rows = f.select("__n", F.substring_index(F.get("f", F.lit(0)), "|", 1).alias("key"), F.substring_index(hit, ":", 1).alias("family"), F.when(hit.contains(":"), F.substring_index(hit, ":", -1)).otherwise(hit).alias("subfamily"), number(F.get("f", F.lit(2))).alias("identity"), number(F.get("f", F.lit(3))).alias("coverage"))
    last = rows.groupBy("key").agg(F.max_by(F.struct("family", "subfamily", "identity", "coverage"), "__n").alias("r"))
    return last.select("key", "r.*")


def truth_rows(table: DataFrame, keep: str, min_length: int = 0) -> DataFrame:
    """contig, start, end, family, length of rows whose Filter is `keep`: start and end ordered, lengths under the floor out (unknown ones too, with a floor)."""
    start, end, n = number(F.col("start"), "long"), number(F.col("end"), "long"), number(F.col("length"), "long")
    rows = table.where(F.col("Filter") == keep).select(known(F.col("contig")).alias("contig"), F.least(start, end).alias("start"), F.greatest(start, end).alias("end"), known(F.col("family")).alias("family"), n.alias("length"))
    rows = rows.where("contig IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL")
    return rows.where(F.col("length") >= min_length) if min_length > 0 else rows


def assembly_truth(lines: DataFrame, min_length: int = 50, filtered: bool = False) -> DataFrame:
    """contig, pos, length, family, class of an assembly's insertions with one hit or more: the first name of a list counts."""
    f = lines.where(~F.col("value").startswith("#") & (F.col("value") != "")).select(F.split("value", "\t").alias("f")).withColumn("info", F.str_to_map(F.get("f", F.lit(7)), F.lit(";"), F.lit("=")))
    info = lambda k: F.try_element_at("info", F.lit(k))
    first = lambda k: known(F.substring_index(info(k), ",", 1))
    ok = (info("SVTYPE") == "INS") & (info("n_hits").try_cast("int") >= 1)
    if filtered:
        ok = ok & (info("mam_filter_1") != "None")
    n = F.abs(info("SVLEN").try_cast("long"))
    return f.where(ok & (n >= min_length)).select(F.get("f", F.lit(0)).alias("contig"), F.get("f", F.lit(1)).try_cast("long").alias("pos"), n.alias("length"), first("repeat_ids").alias("family"), first("matching_classes").alias("class"))


def insert_headers(fasta: DataFrame) -> DataFrame:
    """id, contig, pos, sequence of FASTA records (header, sequence) whose header is id|contig:pos|..."""
    at = F.split("header", r"\|")
    place = F.get(at, F.lit(1))
    return fasta.select(F.get(at, F.lit(0)).alias("id"), F.regexp_extract(place, r"^(.+):[0-9]+$", 1).alias("contig"), F.regexp_extract(place, r":([0-9]+)$", 1).try_cast("long").alias("pos"), F.upper("sequence").alias("sequence")).where("pos IS NOT NULL")


def child_candidates(table: DataFrame, min_support: int, window: int) -> DataFrame:
    """contig, pos, family, support, start, end of a child's calls with an element's name and support: the span of the breakpoints, or, where one is unknown, a window around the position."""
    pos, left, right = number(F.col("pos"), "long"), number(F.col("bp_left"), "long"), number(F.col("bp_right"), "long")
    both = (left >= 0) & (right >= 0)
    rows = table.select(
        F.col("contig"), pos.alias("pos"), known(F.col("family")).alias("family"), number(F.col("support"), "long").alias("support"), F.when(both, F.least(left, right)).otherwise(F.greatest(pos - window, F.lit(0))).alias("start"),
        F.when(both, F.greatest(left, right)).otherwise(pos + window).alias("end"),
    )
    return rows.where((F.col("family").isNotNull()) & (F.col("support") >= min_support))


def manifest(table: DataFrame) -> DataFrame:
    """sample_id, bam, run_dir of a batch; a row with an empty one is an error. A batch is a few rows, and the check is one aggregate."""
    rows = table.select(*(F.trim(c).alias(c) for c in ("sample_id", "bam", "run_dir")))
    bad = F.lit(False)
    for c in rows.columns:
        bad = bad | (F.coalesce(F.col(c), F.lit("")) == "")
    if not rows.where(bad).isEmpty():
        raise ValueError("a row of the manifest has an empty field")
    return rows


# ---------------------------------------------------------------- sinks


def as_text(df: DataFrame, columns: list[str], missing: str = "NA", digits: int = 6) -> DataFrame:
    """One string column for each of `columns`, in that order: reals with fixed digits, booleans as 1 and 0, arrays as their sizes, nulls as `missing`, tabs and line ends as spaces."""
    out = []
    for c in columns:
        kind, x = df.schema[c].dataType, F.col(f"`{c}`")
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            t = F.when(F.isnan(x), None).otherwise(F.format_string(f"%.{digits}f", x.cast("double")))
        elif isinstance(kind, T.BooleanType):
            t = x.cast("int").cast("string")
        elif isinstance(kind, T.ArrayType):
            t = F.when(x.isNotNull(), F.size(x)).cast("string")
        else:
            t = F.regexp_replace(x.cast("string"), "[\t\r\n]", " ")
        out.append(F.coalesce(F.when(x.isNotNull(), t), F.lit(missing)).alias(c))
    return df.select(*out)


def write_table(df: DataFrame, path: str, columns: list[str], summary: dict[str, object] | None = None, missing: str = "NA") -> None:
    """Tab-separated files with a header in the folder `path`/rows, in the given column order; the summary as key and value lines in `path`/summary."""
    as_text(df, columns, missing).write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("escape", "").csv(f"{path}/rows")
    if summary is not None:
        lines = [(f"{k}\t{v}",) for k, v in summary.items()]
        df.sparkSession.createDataFrame(lines, "value string").coalesce(1).write.mode("overwrite").text(f"{path}/summary")


def read_back(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", "").option("escape", "").csv(f"{path}/rows")


def coverage_rows(ledger: DataFrame, left: str, right: str) -> DataFrame:
    """Rows of a ledger with both ends known, ends ordered, as coverage_start and coverage_end."""
    return ledger.where((F.col(left) >= 0) & (F.col(right) >= 0)).withColumns({"coverage_start": F.least(left, right), "coverage_end": F.greatest(left, right)})


def control_rows(nulls: DataFrame, calls: DataFrame, kind: str, score: str) -> DataFrame:
    """Null rows (labelled by their kind) and calls (`final_call`) together, each with the empirical upper tail of its score among the nulls."""
    from loomseq.operators.selection import empirical_tail

    both = nulls.select("id", F.col(kind).alias("row_kind"), score).unionByName(calls.select("id", F.lit("final_call").alias("row_kind"), score))
    return empirical_tail(both, nulls, score)


def veto_rows(calls: DataFrame, reads: str = "veto_reads") -> DataFrame:
    """One row for each read that speaks against a call; calls without such reads give none."""
    return calls.select("id", F.explode(reads).alias("read"))


def wrapped(sequence: Column, width: int = 80) -> Column:
    """The sequence with a line end after every `width` letters."""
    return F.regexp_replace(F.regexp_replace(sequence, f"(.{{{width}}})", "$1\n"), "\n$", "")
