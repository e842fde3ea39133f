"""Rules: loading, validating, and as a relation."""

from __future__ import annotations

import logging
import os
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..functions.dialect import compiles, guard, risky, to_java
from ..functions.severity import severity_of
from ..rulesets import PACKS

log = logging.getLogger(__name__)
FILES = {".lua": "lua_patterns.txt", ".vmt": "vmt_patterns.txt", ".vtf": "vtf_patterns.txt", ".ttf": "ttf_patterns.txt"}


@dataclass(frozen=True)
class Rule:
    """One rule; rule_id is its line in its file."""

    file_type: str
    rule_id: int
    pattern: str
    detection: str

    @property
    def severity(self) -> str:
        return severity_of(self.detection)

    @property
    def java(self) -> str:
        return to_java(self.pattern)

    @property
    def guard(self) -> str | None:
        return guard(self.pattern)

    @property
    def decodes(self) -> str:
        """'codes', 'base64' or '': what the label asks to be decoded."""
        if "CharCode" in self.detection or "Obfuscation" in self.detection:
            return "codes"
        return "base64" if "Base64" in self.detection else ""


def parse(text: str, file_type: str, spark: SparkSession | None = None) -> list[Rule]:
    """Rules of a file's text: pattern, ';;;', label. Lines without both and patterns that don't compile are skipped with a warning."""
    out = []
    for k, line in enumerate(text.split("\n"), 1):
        line = line.removesuffix("\r")
        pattern, mark, label = line.partition(";;;")
        if not mark:
            if line:
                log.warning("%s rules, line %d: no ';;;'", file_type, k)
            continue
        rule = Rule(file_type, k, pattern, label)
        try:
            ok = spark is None or compiles(spark, rule.java)
            rule.java  # noqa: B018  raises if brackets don't close
        except ValueError:
            ok = False
        if not ok:
            log.warning("%s rules, line %d: the pattern does not compile", file_type, k)
            continue
        if risky(pattern):
            log.warning("%s rules, line %d: a repeated group may exhaust the stack on very long matches", file_type, k)
        out.append(rule)
    return out


@dataclass(frozen=True)
class RuleSet:
    rules: tuple[Rule, ...]

    def of(self, file_type: str) -> tuple[Rule, ...]:
        return tuple(r for r in self.rules if r.file_type == file_type)

    @property
    def types(self) -> list[str]:
        return list(dict.fromkeys(r.file_type for r in self.rules))

    @classmethod
    def shipped(cls) -> RuleSet:
        return cls(tuple(r for t, text in PACKS.items() for r in parse(text.strip("\n"), t)))

    @classmethod
    def load(cls, directory: str | os.PathLike, spark: SparkSession | None = None) -> RuleSet:
        """All four rule files of a directory; every one must give a rule."""
        found: list[Rule] = []
        missing = []
        for file_type, name in FILES.items():
            path = Path(directory, name)
            rules = parse(path.read_text(encoding="utf-8", errors="replace"), file_type, spark) if path.is_file() else []
            found += rules
            if not rules:
                missing.append(name)
        if missing:
            raise ValueError(f"no rules in {', '.join(missing)}")
        return cls(tuple(found))

    def write(self, directory: str | os.PathLike) -> None:
        """Write the set as rule files."""
        for file_type, name in FILES.items():
            Path(directory, name).write_text("".join(f"{r.pattern};;;{r.detection}\n" for r in self.of(file_type)), encoding="utf-8")

    def relation(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(r.file_type, r.rule_id, r.pattern, r.detection, r.severity) for r in self.rules], "file_type string, rule_id int, pattern string, detection string, severity string")
