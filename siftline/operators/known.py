"""The blocklist of whole-file hashes."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import djb2

LABEL = "[CRITICAL] Known Backdoor (Hash Match)"


def parse_hashes(text: str) -> list[str]:
    """Distinct hashes: before ';;;' or the whole line; empty lines and comments are skipped."""
    return sorted({line.removesuffix("\r").split(";;;", 1)[0] for line in text.split("\n") if line.removesuffix("\r") and not line.startswith("#")})


def load_hashes(spark: SparkSession, path: str | None) -> DataFrame | None:
    """The blocklist as a relation; None if there is no file or no hash in it, so that nothing is hashed."""
    found = parse_hashes(Path(path).read_text(encoding="utf-8", errors="replace")) if path and Path(path).is_file() else []
    return spark.createDataFrame([(h,) for h in found], "hash string") if found else None


def hash_relation(raw: DataFrame, line: str = "value") -> DataFrame:
    """The same from a relation of lines."""
    text = F.col(line)
    return raw.where((text != "") & ~F.startswith(text, F.lit("#"))).select(F.split(text, ";;;", 2)[0].alias("hash")).distinct()


def with_hash(files: DataFrame, content: str = "content", bits: int = 32) -> DataFrame:
    return files.withColumn("hash", djb2(F.col(content), bits))


def known_bad(hashed: DataFrame, bad: DataFrame) -> DataFrame:
    """Files whose hash is listed."""
    return hashed.join(bad.select("hash").distinct(), "hash", "left_semi")


def not_known(hashed: DataFrame, bad: DataFrame) -> DataFrame:
    return hashed.join(bad.select("hash").distinct(), "hash", "left_anti")


def known_detections(known: DataFrame) -> DataFrame:
    """Detections of listed files: line 0, always critical, past any threshold."""
    return known.select(
        "file", F.lit("critical").alias("severity"), F.lit(LABEL).alias("detection"), F.lit(0).alias("line_number"), F.concat(F.lit("File hash: "), F.col("hash")).alias("line_text"), F.lit(None).cast("string").alias("decoded_content"), "hash"
    )
