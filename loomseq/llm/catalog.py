"""The corpus operators' queries, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from loomseq.llm import clustering, decontamination, embedding_dedup, language, lexical, lm, mixing, pii, secrets, simhash, topk, toxicity, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        toxicity.op1_toxicity,
        secrets.op2_secret_scan,
        mixing.op3_mixing,
        language.op4_language_id,
        topk.op5_exact_top_k,
        url_filter.op6_url_filter,
        decontamination.op7_decontamination,
        simhash.op8_simhash_dedup,
        pii.op9_pii,
        lm.op10_lm_score,
        embedding_dedup.op11_embedding_dedup,
        clustering.op12_centroid_clusters,
        lexical.op13_ranked_search,
    )
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_mixing": mixing.ORACLE,
        "op5_exact_top_k": topk.ORACLE,
        "op6_url_filter": url_filter.ORACLE,
        "op7_decontamination": decontamination.ORACLE,
        "op11_embedding_dedup": embedding_dedup.ORACLE,
        "op12_centroid_clusters": clustering.ORACLE,
        "op13_ranked_search": lexical.ORACLE,
    }
