"""Statistics of a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def severity_counts() -> list[Column]:
    """All four counts, 0 where a severity is absent."""
    return [F.count_if(F.col("severity") == s).cast("int").alias(s) for s in ("critical", "high", "medium", "low")]


def statistics(kept: DataFrame) -> DataFrame:
    """Counts by severity after the threshold, as one row."""
    return kept.agg(*severity_counts())


def counts_by(detections: DataFrame, *keys: str) -> DataFrame:
    return detections.groupBy(*keys).agg(F.count(F.lit(1)).alias("detections"), *severity_counts())


def member_offsets(entries: DataFrame, group: str, order: str, size: str) -> DataFrame:
    """Exclusive running sum of sizes in each group."""
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return entries.withColumn("offset", F.coalesce(F.sum(size).over(w), F.lit(0)).cast("bigint"))
