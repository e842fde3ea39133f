"""Scanning as files arrive (an extension): the same plan over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.severity import meets
from ..functions.text import as_text, file_extension, normal_path
from ..operators.match import match_files
from ..operators.rules import RuleSet


def stream_files(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """New files under a path as a stream of (file, ext, content, arrived)."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(path)
    name = normal_path(F.col("path"))
    return raw.where("length > 0").select(name.alias("file"), file_extension(name).alias("ext"), as_text(F.col("content")).alias("content"), F.col("modificationTime").alias("arrived"))


def stream_detections(files: DataFrame, rules: RuleSet | None = None, min_severity: str = "low", forget_after: str | None = "1 day") -> DataFrame:
    """Detections of a stream of files; stateless but for repeats of (file, line, detection), forgotten after a while."""
    timed = "arrived" in files.columns
    if timed and forget_after:
        files = files.withWatermark("arrived", forget_after)
    found = match_files(files, rules or RuleSet.shipped()).where(meets(F.col("severity"), min_severity))
    keys = ["file", "line_number", "detection"]
    return found.dropDuplicatesWithinWatermark(keys) if timed and forget_after else found.dropDuplicates(keys)


def stream_counts(detections: DataFrame, window: str = "1 hour") -> DataFrame:
    """Counts by severity in windows of arrival; late files within the watermark still count."""
    return detections.groupBy(F.window("arrived", window), "severity").agg(F.count(F.lit(1)).alias("detections"))
