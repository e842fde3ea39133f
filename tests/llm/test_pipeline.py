"""The corpus pipeline and the registered queries."""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftline.llm import queries, sp_scan

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not (os.path.isdir(SF) and os.path.exists(sp_scan.MODEL)), reason="no test tables or tokenizer files")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df, found = queries.queries()[name](spark, SF), c.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=repr) == sorted((tuple(r) for r in found.fetchall()), key=repr)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10_001, None, "en", "s", 0), (10_002, "", None, "s", 0), (10_003, "12 34 !!", "en", "s", 8), (None, "mail to bob@x.org for the and with that from this", "en", "s", 48)], docs.schema)
    now = docs.union(odd).union(docs.limit(3))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == docs.columns, name
    rows = now.collect()
    assert not {10_001, 10_002, 10_003} & {r.doc_id for r in rows} and all("@x.org" not in r.text for r in rows)
    assert len({r.doc_id for r in rows}) == len(rows) > 0.8 * docs.count() and any("[EMAIL]" in r.text for r in rows)
    items = [t for (t,) in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    assert not any(t in r.text for t in items for r in rows)
    assert stage is not None and corpus_pipeline.STAGES[-1][1](spark, now, SF).count() == len(rows)


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert "token_ids" in got.columns and got.where("n_tokens > 0").count() == got.count() > 0


def test_more_columns(spark):
    """Columns that the operators use inside stay as they are."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40).withColumns({c: F.lit("clash") for c in ("lang_pred", "node", "key", "base", "spans", "words", "out_id_", "out_key_", "id_", "key_", "text_key_", "found_key_", "pii_key_", "span_key_", "copy_key_")})
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == docs.columns, name
    assert {r.key for r in now.collect()} == {"clash"}


def test_empty_corpus(spark):
    now = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
    assert now.count() == 0
