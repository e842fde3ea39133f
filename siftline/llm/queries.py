"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontam, embed_dedup, html_crf, langid, ngram_join, pii, sp_scan, toxicity, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": langid.op1_language_id,
        "op2_ngram_jaccard_join": ngram_join.op2_ngram_jaccard_join,
        "op3_sentencepiece": sp_scan.op3_sentencepiece,
        "op4_embedding_near_dedup": embed_dedup.op4_embedding_near_dedup,
        "op5_personal_data": pii.op5_personal_data,
        "op6_url_filter": url_filter.op6_url_filter,
        "op7_chat_format": chat_format.op7_chat_format,
        "op8_html_extraction": html_crf.op8_html_extraction,
        "op9_benchmark_decontamination": decontam.op9_benchmark_decontamination,
        "op10_toxicity": toxicity.op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_url_filter": url_filter.OP6_SQL, "op7_chat_format": chat_format.OP7_SQL}
