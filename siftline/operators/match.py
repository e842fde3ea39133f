"""Lines and rules meet.

The rules of a type are unrolled into one array expression: a literal guard and a
literal RLIKE each, so patterns are compiled once per task and no join is needed.
The array is exploded where it is made; named first, each rule would run twice.
A file that no rule can hit is dropped before it is split into lines.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.decode import base64_payload, char_codes
from ..functions.dialect import line_bound
from ..functions.text import collapse_space, lines
from .rules import Rule, RuleSet


def hits(rule: Rule, text: Column) -> Column:
    found = F.rlike(text, F.lit(rule.java))
    return F.contains(text, F.lit(rule.guard)) & found if rule.guard else found


def may_hit(rules: tuple[Rule, ...], content: Column) -> Column:
    """Whether any rule can hit a line: its guard is somewhere in the content, or, without one, its pattern matches there.

    A match in a line is a match in the content unless the pattern is bound to
    the line; such rules without a guard count as possible.
    """
    guards = sorted({r.guard for r in rules if r.guard})
    tests = [F.contains(content, F.lit(g)) for g in guards]
    tests += [F.lit(True) if line_bound(r.pattern) else F.rlike(content, F.lit(r.java)) for r in rules if not r.guard]
    return reduce(or_, tests, F.lit(False))


def by_type(rules: RuleSet, ext: Column, make) -> Column:
    """CASE over the file types: a row evaluates its own type's branch alone."""
    out = None
    for t in rules.types:
        out = (F.when if out is None else out.when)(ext == t, make(rules.of(t)))
    return out


def number_lines(files: DataFrame) -> DataFrame:
    """(…, line_number, line) of files with content (text); other columns stay. Line numbers are positions, not ranks."""
    keep = [c for c in files.columns if c != "content"]
    return files.select(*keep, F.posexplode(lines(F.col("content"))).alias("p_", "line")).select(*keep, (F.col("p_") + 1).cast("int").alias("line_number"), "line")


def match_lines(numbered: DataFrame, rules: RuleSet, ext: str = "ext", line: str = "line") -> DataFrame:
    """One row per line and rule that hits it: rule_id, detection, severity, line_text, decoded_content are added."""
    text = F.col(line)

    def row(r: Rule) -> Column:
        decoded = char_codes(text, r.java) if r.decodes == "codes" else base64_payload(text) if r.decodes == "base64" else None
        found = F.nullif(decoded, F.lit("")) if decoded is not None else F.lit(None).cast("string")
        return F.when(hits(r, text), F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.detection).alias("detection"), F.lit(r.severity).alias("severity"), found.alias("decoded_content")))

    def branch(of_type: tuple[Rule, ...]) -> Column:
        return F.array_compact(F.array(*[row(r) for r in of_type]))

    out = numbered.select("*", F.explode(by_type(rules, F.col(ext), branch)).alias("h_"))
    return out.select(*numbered.columns, "h_.*", collapse_space(text).alias("line_text"))


def match_files(files: DataFrame, rules: RuleSet, prefilter: bool = True) -> DataFrame:
    """match_lines() over the lines of files (file, ext, content)."""
    possible = files.where(F.col("ext").isin(rules.types))
    if prefilter:
        possible = possible.where(F.coalesce(by_type(rules, F.col("ext"), lambda of_type: may_hit(of_type, F.col("content"))), F.lit(False)))
    return match_lines(number_lines(possible), rules)


def match_by_join(numbered: DataFrame, relation: DataFrame) -> DataFrame:
    """The same as a join with a rule relation (file_type, rule_id, java, detection, severity), for rules that are data.

    The relation is small by nature but not by proof, so no broadcast is forced:
    Spark picks one by size, else sorts both sides by type.
    """
    r = relation.select(F.col("file_type").alias("ext"), "rule_id", "java", "detection", "severity")
    found = numbered.join(r, (numbered["ext"] == r["ext"]) & F.expr("rlike(line, java)")).drop(r["ext"]).drop("java")
    return found.withColumn("line_text", collapse_space(F.col("line")))
