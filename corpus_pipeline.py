"""The corpus pipeline: language ID, near-duplicate removal, decontamination, PII, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns a DataFrame; run() writes each as Parquet into the shared folder and
reads it back as the next one's docs. All but the last return the columns of
documents. Rows with null text count as without letters and go in the first stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import decontam, langid, ngram_join, pii, sp_scan
from siftline.llm.common import forget, save, table, temporary, tune

#: The standard deviation of two unrelated vectors' cosine: a text that comes no nearer to any language, whatever its length, is of none.
LEAST_COSINE = langid.DIM**-0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Set lang to the identified language; drop texts without letters and those that resemble no language more than chance does."""
    columns = docs.columns
    profiles = langid.learn(docs)
    found = langid.identify(docs, profiles)
    return found.where((F.col("lang_pred") != langid.UND) & (F.col("score") >= LEAST_COSINE)).withColumn("lang", F.col("lang_pred")).select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each class of near copies."""
    tune(spark)
    return ngram_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, literally or re-parameterised."""
    tune(spark)
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the text by its kind in brackets; n_chars follows."""
    tune(spark)
    clean = pii.redact(pii.find_personal_data(docs)).withColumn("n_chars", F.length("text").cast("bigint"))
    return clean.select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and token_ids of every remaining text."""
    tune(spark)
    return sp_scan.encode(docs.select("doc_id", "lang", "source", "text")).select("doc_id", "lang", "source", F.size("token_ids").cast("bigint").alias("n_tokens"), "token_ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]
#: Not expressible in SQL: language profiles, MinHash, slot alignment, the pattern graph and the lattice are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        with temporary():
            docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
        forget(before)
    return docs
