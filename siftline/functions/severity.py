"""Severities of labels, and their threshold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANKS = {"low": 0, "medium": 1, "high": 2, "critical": 3}


def severity_of(label: str) -> str:
    return next((s for s in ("critical", "high", "medium") if f"[{s.upper()}]" in label), "low")


def severity(label: Column) -> Column:
    return F.when(F.contains(label, F.lit("[CRITICAL]")), "critical").when(F.contains(label, F.lit("[HIGH]")), "high").when(F.contains(label, F.lit("[MEDIUM]")), "medium").otherwise("low")


def rank(severity_: Column) -> Column:
    return F.when(severity_ == "critical", 3).when(severity_ == "high", 2).when(severity_ == "medium", 1).otherwise(0)


def meets(severity_: Column, least: str) -> Column:
    """Whether a severity reaches a threshold; an unknown threshold lets everything pass."""
    return rank(severity_) >= RANKS.get(least, 0)
