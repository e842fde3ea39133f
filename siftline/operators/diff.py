"""Comparison with an earlier scan."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["file", "line_number", "detection"]
_SCHEMA = "file string, line_number int, detection string"


def load_previous(spark: SparkSession, path: str | None) -> DataFrame:
    """Keys of an earlier scan log; missing or malformed logs are empty, missing fields take their defaults."""
    try:
        found = json.loads(Path(path).read_text(encoding="utf-8")).get("detections", []) if path else []
        rows = [(str(d.get("file", "")), int(d.get("line_number", 0)), str(d.get("detection", ""))) for d in found if isinstance(d, dict)]
    except (OSError, ValueError, AttributeError, TypeError):
        rows = []
    return spark.createDataFrame(rows, _SCHEMA).distinct()


def previous_from_json(spark: SparkSession, path: str) -> DataFrame:
    """The same through Spark's reader, for logs in a store or of many scans."""
    log = spark.read.schema(f"detections array<struct<{_SCHEMA.replace(' ', ':').replace(',:', ',')}>>").json(path, multiLine=True)
    d = log.select(F.explode("detections").alias("d"))
    return d.select(F.coalesce("d.file", F.lit("")).alias("file"), F.coalesce("d.line_number", F.lit(0)).alias("line_number"), F.coalesce("d.detection", F.lit("")).alias("detection")).distinct()


def new_detections(detections: DataFrame, previous: DataFrame) -> DataFrame:
    return detections.join(previous.select(*KEY).distinct(), KEY, "left_anti").select(*detections.columns)


def unchanged_detections(detections: DataFrame, previous: DataFrame) -> DataFrame:
    return detections.join(previous.select(*KEY).distinct(), KEY, "left_semi").select(*detections.columns)


def removed_detections(detections: DataFrame, previous: DataFrame) -> DataFrame:
    return previous.select(*KEY).distinct().join(detections.select(*KEY), KEY, "left_anti")
