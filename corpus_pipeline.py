"""A training corpus in five stages: language, near-duplicates, benchmark passages, secrets, source mix.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps,
in the columns of documents; the last returns the mix. Between stages the rows
are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseq.llm.common import table
from loomseq.llm.decontamination import decontaminate
from loomseq.llm.language import identify
from loomseq.llm.mixing import mix
from loomseq.llm.resemblance import keep_one
from loomseq.llm.secrets import redact_secrets
from loomseq.sources.shared import cut

#: Share of a text's letters that its language must hold.
LANGUAGE_SHARE = 0.5
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in which no language holds half of the letters, go. A null lang becomes the language found."""
    found = identify(docs, docs, keep=COLUMNS)
    kept = found.where((F.col("lang_pred") != "und") & (F.col("lang_score") >= LANGUAGE_SHARE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, that of the smallest doc_id. Texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more are linked; candidates come from the SimHash index and from minima, and are compared exactly."""
    return keep_one(docs.select(*COLUMNS))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS)
    return found.where(F.size("hit_items") == 0).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in it become their kind in brackets, and n_chars follows."""
    found = redact_secrets(docs, keep=COLUMNS)
    changed = ~F.col("redacted").eqNullSafe(F.col("text"))
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.when(changed, F.length("redacted").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how often (copies), their words (size) and their source's words and target."""
    return mix(docs, keep=COLUMNS).where("copies > 0")


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("secret_scan", secrets),
    ("source_mix", source_mix),
]
#: Shingle sets and language scores are beyond SQL; tests/llm/test_pipeline.py compares the rows of each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
