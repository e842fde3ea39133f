"""The whole scan as one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import djb2
from ..functions.severity import meets
from ..functions.text import as_text
from ..operators.diff import new_detections
from ..operators.known import LABEL
from ..operators.match import match_files
from ..operators.rules import Rule, RuleSet
from ..operators.summary import severity_counts
from ..sources.files import read_directory_tree

#: The type that files on the blocklist get in the plan.
KNOWN = "#known"
COLUMNS = ["file", "severity", "detection", "line_number", "line_text", "decoded_content", "hash", "ext", "rule_id"]


@dataclass
class ScanResult:
    """detections: past the threshold (and the diff); hits: all rule hits and known files, before it; scanned: the files."""

    detections: DataFrame
    hits: DataFrame
    scanned: DataFrame
    errors: DataFrame

    def persist(self) -> ScanResult:
        """Keep the hits, so that reports and statistics don't scan the files anew."""
        self.hits.persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def summary_row(self) -> DataFrame:
        """files_processed, detections_found and the counts by severity, as one row."""
        files = self.scanned.agg(F.count(F.lit(1)).cast("int").alias("files_processed"))
        found = self.hits.agg(F.count(F.lit(1)).cast("int").alias("detections_found"))
        return files.join(found).join(self.detections.agg(*severity_counts()))

    def summary(self) -> dict:
        r = self.summary_row().first().asDict()
        return {"files_processed": r["files_processed"], "detections_found": r["detections_found"], "statistics": {s: r[s] for s in ("critical", "high", "medium", "low")}}


def scan_files(files: DataFrame, rules: RuleSet, min_severity: str = "low", bad_hashes: DataFrame | None = None, previous: DataFrame | None = None, hash_members: bool = False, bits: int = 32, prefilter: bool = True) -> ScanResult:
    """Scan a relation of files.

    files: file, ext, content (string or binary), and optionally archive and
    error. A listed hash makes one critical detection and ends the file's scan;
    past any threshold, as it is critical; archive members are not hashed unless hash_members. The threshold hides rows
    and their severity counts, not detections_found. With `previous` only new
    detections remain. Nothing is hashed without a blocklist.
    """
    for name in ("archive", "error"):
        if name not in files.columns:
            files = files.withColumn(name, F.lit(None).cast("string"))
    errors = files.where("error is not null").select("file", "error")
    scanned = files.where(F.col("error").isNull() & F.col("content").isNotNull() & (F.length("content") > 0) & F.col("ext").isin(rules.types))
    text = as_text(F.col("content")) if dict(files.dtypes)["content"] == "binary" else F.col("content")
    if bad_hashes is None:
        content = scanned.select("file", "ext", text.alias("content"), F.lit(None).cast("string").alias("hash"))
    else:
        # One pass: a listed file becomes a one-line file of a type of its own, which one rule always hits.
        raw = F.col("content") if dict(files.dtypes)["content"] == "binary" else F.encode("content", "UTF-8")
        hashed = scanned.withColumn("hash", djb2(raw if hash_members else F.when(F.col("archive").isNull(), raw), bits))
        listed = F.col("listed_").isNotNull()
        flagged = hashed.join(bad_hashes.select("hash").distinct().withColumn("listed_", F.lit(True)), "hash", "left")
        content = flagged.select("file", F.when(listed, KNOWN).otherwise(F.col("ext")).alias("ext"), F.when(listed, F.concat(F.lit("File hash: "), F.col("hash"))).otherwise(text).alias("content"), F.when(listed, F.col("hash")).alias("hash"))
        rules = RuleSet((*rules.rules, Rule(KNOWN, 0, "", LABEL)))
    known = F.col("ext") == KNOWN
    hits = match_files(content, rules, prefilter).withColumns({"line_number": F.when(known, 0).otherwise(F.col("line_number")), "ext": F.when(~known, F.col("ext"))}).select(*COLUMNS)
    kept = hits.where(meets(F.col("severity"), min_severity))
    if previous is not None:
        kept = new_detections(kept, previous)
    return ScanResult(kept, hits, scanned.select("file", "ext"), errors)


def scan(spark: SparkSession, source: str | DataFrame, rules: RuleSet | None = None, min_severity: str = "low", hashes: DataFrame | None = None, previous: DataFrame | None = None, **how) -> ScanResult:
    """Scan a directory or a relation of files."""
    files = read_directory_tree(spark, source) if isinstance(source, str) else source
    return scan_files(files, rules or RuleSet.shipped(), min_severity, hashes, previous, **how)
