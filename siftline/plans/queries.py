"""The registered queries of the engine, each with the SQL that gives the same rows.

The tables hold no code, so the corpus is `documents` with a line appended that
is known to hit rules (or none): which one depends on doc_id modulo their number.
"""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decode, hashing, severity, text
from ..functions.dialect import to_java
from ..operators import diff, known, match, summary
from ..operators.rules import FILES, Rule, RuleSet
from ..sources.archive import archive_members
from . import report
from .scan import scan, scan_files
from .witnesses import WITNESSES

Query = Callable[[SparkSession, str], DataFrame]
RULES = RuleSet.shipped()
N = len(WITNESSES)
#: User rules for raw text: long tokens, IP addresses, mail addresses, licence lines.
CUSTOM = RuleSet(tuple(Rule(".txt", k, p, d) for k, (p, d) in enumerate([
    (r"\b[0-9a-f]{40}\b", "[HIGH] Long Hex Token"),
    (r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", "[MEDIUM] IP Address"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]+", "[CRITICAL] Mail Address"),
    (r"All rights reserved", "Licence Line"),
], 1)))
_DOT = (".vmt", ".vtf", ".ttf")


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _pick(key: Column) -> tuple[Column, Column]:
    """Extension and witness line for a key."""
    w = F.element_at(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(line).alias("line")) for t, line, _ in WITNESSES]), (key % N + 1).cast("int"))
    other = F.element_at(F.array(*map(F.lit, _DOT)), (F.floor(key / N) % 3 + 1).cast("int"))
    return F.when(w["t"] == "lua", ".lua").otherwise(other), w["line"]


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, source, file, ext, content."""
    ext, line = _pick(F.col("doc_id"))
    d = read(spark, sf, "documents").select("doc_id", "source", ext.alias("ext"), F.concat("text", F.lit("\n"), line).alias("content"))
    return d.select("doc_id", "source", F.concat(F.lit("src/"), "source", F.lit("/"), F.col("doc_id").cast("string"), "ext").alias("file"), "ext", "content")


def injected(spark: SparkSession, sf: str, table: str, key: str, body: str) -> DataFrame:
    """Another table as files, with witness lines."""
    ext, line = _pick(F.col(key))
    return read(spark, sf, table).select(F.concat(F.lit(f"{table}/"), F.col(key).cast("string"), ext).alias("file"), ext.alias("ext"), F.concat(F.col(body), F.lit("\n"), line).alias("content"))


# ---- the same in SQL


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else q(x) for x in r) + ")" for r in rows)


def _rules_sql(rules: RuleSet) -> str:
    return f"r(file_type, rule_id, pattern, detection, severity) AS (VALUES {_values((r.file_type, r.rule_id, r.pattern, r.detection, r.severity) for r in rules.rules)})"


_W = f"w(id, t, wline) AS (VALUES {_values((k, t, line) for k, (t, line, _) in enumerate(WITNESSES))})"


def _ext_sql(key: str) -> str:
    return f"CASE WHEN w.t = 'lua' THEN '.lua' ELSE ['.vmt', '.vtf', '.ttf'][({key} // {N}) % 3 + 1] END"


_CORPUS = f"""{_W}, c0 AS (SELECT doc_id, source, {_ext_sql('doc_id')} AS ext, text || chr(10) || w.wline AS content FROM documents JOIN w ON w.id = doc_id % {N}),
corpus AS (SELECT doc_id, source, 'src/' || source || '/' || doc_id || ext AS file, ext, content FROM c0)"""


def _lines_sql(src: str, cols: str) -> str:
    return f"""p_ AS (SELECT *, string_split(content, chr(10)) AS sp FROM {src}), l_ AS (SELECT *, CASE WHEN content = '' OR ends_with(content, chr(10)) THEN sp[1:len(sp) - 1] ELSE sp END AS parts FROM p_),
lines AS (SELECT {cols}, CAST(line_number AS INT) AS line_number, line FROM (SELECT {cols}, unnest(parts) AS line, generate_subscripts(parts, 1) AS line_number FROM l_))"""


_WS = r"regexp_replace(line, '([ \t\n\x0b\f\r])[ \t\n\x0b\f\r]+', '\1', 'g')"
_CODES = "array_to_string(list_transform(list_filter(list_transform(regexp_extract_all(line, '([0-9]{2,3})(?:,[0-9]{2,3}){6,}', 1), lambda x: CAST(x AS INT)), lambda v: v <= 255), lambda v: chr(v)), '')"
_RUN = "regexp_extract(line, '[A-Za-z0-9+/]{40,}={0,2}', 0)"
_CORE = f"rtrim({_RUN}, '=')"
_B64 = f"from_base64(rpad(left({_CORE}, length({_CORE}) - CASE WHEN length({_CORE}) % 4 = 1 THEN 1 ELSE 0 END), CAST(ceil((length({_CORE}) - CASE WHEN length({_CORE}) % 4 = 1 THEN 1 ELSE 0 END) / 4.0) * 4 AS INT), '='))"
_TEXTUAL = f"(regexp_matches(left(hex({_B64}), 100), '^(0[9AD]|[2-7][0-9A-F])+$') AND octet_length({_B64}) > 5)"
#: Decoded content of a hit; NULs and bytes outside ASCII do not occur in the corpus.
_DECODED = f"""CASE WHEN contains(detection, 'CharCode') OR contains(detection, 'Obfuscation') THEN
  CASE WHEN starts_with(pattern, '[0-9]') THEN nullif({_CODES}, '') WHEN starts_with(pattern, '0[xX]') THEN repeat(chr(0), len(regexp_extract_all(line, pattern))) END
 WHEN contains(detection, 'Base64') THEN CASE WHEN {_RUN} <> '' AND {_TEXTUAL} THEN decode({_B64}) END END"""


def _hits_sql(src: str = "corpus", cols: str = "doc_id, source, file, ext", rules: RuleSet = RULES) -> str:
    plain = ", ".join(f"lines.{c.strip()}" for c in cols.split(","))
    return f"""{_rules_sql(rules)}, {_lines_sql(src, cols)},
hits AS (SELECT {plain}, line_number, line, rule_id, pattern, detection, severity, {_WS} AS line_text FROM lines JOIN r ON r.file_type = lines.ext AND regexp_matches(line, pattern))"""


_BASE = f"WITH {_CORPUS}, {_hits_sql()}"
_HIT = "file, ext, line_number, rule_id, detection, severity, line_text"


def detections(spark: SparkSession, sf: str) -> DataFrame:
    return scan_files(corpus(spark, sf), RULES).hits


def _matched(types: tuple[str, ...] | None = None) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        files = corpus(spark, sf)
        rules = RULES if types is None else RuleSet(tuple(r for t in types for r in RULES.of(t)))
        return match.match_files(files.select("file", "ext", "content"), rules).select(*_HIT.split(", "))

    return run


def rule_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return RULES.relation(spark)


def rule_counts_by_severity(spark: SparkSession, sf: str) -> DataFrame:
    return RULES.relation(spark).groupBy("file_type", "severity").agg(F.count(F.lit(1)).alias("rules"))


def file_extension(spark: SparkSession, sf: str) -> DataFrame:
    paths = read(spark, sf, "pages").select("url").union(corpus(spark, sf).select(F.col("file").alias("url")))
    return paths.select("url", text.file_extension(F.col("url")).alias("file_ext"), text.member_extension(F.col("url")).alias("member_ext"))


def path_normalize(spark: SparkSession, sf: str) -> DataFrame:
    back = F.translate("url", "/", "\\")
    return read(spark, sf, "pages").select("page_id", back.alias("raw"), text.normal_path(back).alias("path"))


def line_split(spark: SparkSession, sf: str) -> DataFrame:
    return match.number_lines(corpus(spark, sf).select("doc_id", "content")).select("doc_id", "line_number", F.length("line").alias("n_chars"), F.md5("line").alias("line_md5"))


def line_split_pages(spark: SparkSession, sf: str) -> DataFrame:
    numbered = match.number_lines(read(spark, sf, "pages").select("page_id", F.replace("html", F.lit("<p>"), F.lit("\n<p>")).alias("content")))
    return numbered.groupBy("page_id").agg(F.count(F.lit(1)).alias("lines"), F.max("line_number").alias("last"), F.max(F.length("line")).alias("longest"))


def match_custom_rules(spark: SparkSession, sf: str) -> DataFrame:
    files = read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("file"), F.lit(".txt").alias("ext"), F.col("text").alias("content"))
    return match.match_files(files, CUSTOM).select("file", "line_number", "rule_id", "severity", "line_text")


def match_by_join(spark: SparkSession, sf: str) -> DataFrame:
    rel = spark.createDataFrame([(r.file_type, r.rule_id, to_java(r.pattern), r.detection, r.severity) for r in RULES.rules], "file_type string, rule_id int, java string, detection string, severity string")
    return match.match_by_join(match.number_lines(corpus(spark, sf).select("file", "ext", "content")), rel).select(*_HIT.split(", "))


def severity_counts(spark: SparkSession, sf: str) -> DataFrame:
    return summary.statistics(detections(spark, sf))


def _least(level: str) -> Query:
    return lambda spark, sf: scan_files(corpus(spark, sf), RULES, level).detections.select(*_HIT.split(", "))


def scan_summary(spark: SparkSession, sf: str) -> DataFrame:
    return scan_files(corpus(spark, sf), RULES, "high").summary_row()


def _by(*keys: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        found = detections(spark, sf)
        if "source" in keys:
            found = found.withColumn("source", F.split("file", "/")[1])
        return summary.counts_by(found, *keys)

    return run


def ws_collapse(spark: SparkSession, sf: str) -> DataFrame:
    spaced = F.replace(F.replace("text", F.lit(" "), F.lit(" \t ")), F.lit("\n"), F.lit("\n\n "))
    return read(spark, sf, "documents").select("doc_id", F.md5(text.collapse_space(spaced)).alias("collapsed"), F.length(text.collapse_space(spaced)).alias("n"))


def tab_escape(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "conversations").select("conv_id", "turn", F.md5(text.escape_tabs(F.replace("text", F.lit(" "), F.lit("\t")))).alias("escaped"))


def detection_key(spark: SparkSession, sf: str) -> DataFrame:
    return detections(spark, sf).select(text.detection_key(F.col("file"), F.col("line_number"), F.col("detection")).alias("key"))


def _with_decoded(where: str) -> Query:
    return lambda spark, sf: detections(spark, sf).where(where).select("file", "line_number", "rule_id", F.coalesce("decoded_content", F.lit("")).alias("decoded_content"))


def charcode_over_255(spark: SparkSession, sf: str) -> DataFrame:
    """Lists of numbers made of the numeric columns of lineitem; numbers over 255 are left out."""
    n = lambda c: (F.col(c).cast("int") % 990 + 10).cast("string")
    line = F.concat(F.lit("x "), F.array_join(F.array(*[n(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_orderkey")]), ","), F.lit(" y"))
    java = to_java(r"[0-9]{2,3}(,[0-9]{2,3}){6,}")
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", decode.char_codes(line, java).alias("decoded"), decode.full_char_codes(line).alias("decoded_full"))


def hex_obfuscation_decode(spark: SparkSession, sf: str) -> DataFrame:
    return detections(spark, sf).where("ext = '.lua' and rule_id = 26").select("file", "line_number", F.hex("decoded_content").alias("decoded_hex"))


def _base64_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that hold the Base64 of a document's text; of every third, with a byte that is no text before it."""
    d = read(spark, sf, "documents")
    data = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(b"\x07"), F.encode("text", "UTF-8"))).otherwise(F.encode("text", "UTF-8"))
    run = F.replace(F.replace(F.base64(data), F.lit("\r\n"), F.lit("")), F.lit("\n"), F.lit(""))
    return d.select("doc_id", F.concat(F.lit('x = "'), run, F.lit('"')).alias("line"))


def base64_extract(spark: SparkSession, sf: str) -> DataFrame:
    numbered = match.number_lines(read(spark, sf, "documents").select("doc_id", F.col("text").alias("content")))
    run = F.regexp_extract("line", decode.PAYLOAD, 0)
    return numbered.where(run != "").select("doc_id", "line_number", run.alias("run"), decode.base64_payload(F.col("line")).alias("payload"))


def base64_decode(spark: SparkSession, sf: str) -> DataFrame:
    return _base64_lines(spark, sf).select("doc_id", F.hex(decode.base64_bytes(F.regexp_extract("line", decode.PAYLOAD, 0))).alias("bytes"))


def base64_binary_rejected(spark: SparkSession, sf: str) -> DataFrame:
    return _base64_lines(spark, sf).select("doc_id", F.md5(decode.base64_payload(F.col("line"))).alias("payload_md5"))


def djb2_hash(spark: SparkSession, sf: str) -> DataFrame:
    return corpus(spark, sf).select("file", hashing.djb2(F.encode("content", "UTF-8")).alias("hash"))


def djb2_hash_lines(spark: SparkSession, sf: str) -> DataFrame:
    return match.number_lines(read(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("content"))).select("conv_id", "turn", "line_number", hashing.djb2_sql(F.col("line")).alias("hash"))


def _hash_list(spark: SparkSession, sf: str) -> DataFrame:
    """Every eleventh file is listed."""
    return known.with_hash(corpus(spark, sf).where("doc_id % 11 = 0").withColumn("content", F.encode("content", "UTF-8"))).select("hash")


def known_hash_hits(spark: SparkSession, sf: str) -> DataFrame:
    hashed = known.with_hash(corpus(spark, sf).withColumn("content", F.encode("content", "UTF-8")))
    return known.known_detections(known.known_bad(hashed, _hash_list(spark, sf))).select("file", "severity", "detection", "line_number", "line_text", "hash")


def skip_known(spark: SparkSession, sf: str) -> DataFrame:
    """A scan with a blocklist: listed files give one detection, the others their rules' hits."""
    found = scan_files(corpus(spark, sf), RULES, bad_hashes=_hash_list(spark, sf))
    return found.detections.select("file", "severity", "detection", "line_number", "rule_id", "line_text")


_HASH_LINES = ["# known files", "", "a1b2c3d4e5f67890;;;first", "1234567890abcdef", "a1b2c3d4e5f67890", " spaced ;;;x", "b;;;c;;;d"]


def hash_list_parse(spark: SparkSession, sf: str) -> DataFrame:
    return known.hash_relation(spark.createDataFrame([(x,) for x in _HASH_LINES], "value string"))


def _earlier(spark: SparkSession, sf: str) -> DataFrame:
    """The baseline: a scan of the even documents, and one file that is gone."""
    gone = spark.createDataFrame([("src/gone.lua", 3, "[HIGH] Gone")], "file string, line_number int, detection string")
    return scan_files(corpus(spark, sf).where("doc_id % 2 = 0"), RULES).detections.select("file", "line_number", "detection").union(gone)


_KEYS = ["file", "line_number", "detection", "rule_id"]


def diff_new(spark: SparkSession, sf: str) -> DataFrame:
    return scan_files(corpus(spark, sf), RULES, previous=_earlier(spark, sf)).detections.select(*_KEYS)


def diff_unchanged(spark: SparkSession, sf: str) -> DataFrame:
    return diff.unchanged_detections(detections(spark, sf), _earlier(spark, sf)).select(*_KEYS)


def diff_removed(spark: SparkSession, sf: str) -> DataFrame:
    return diff.removed_detections(detections(spark, sf), _earlier(spark, sf))


def prefix_offsets(spark: SparkSession, sf: str) -> DataFrame:
    sizes = read(spark, sf, "conversations").select("conv_id", "turn", F.octet_length("text").cast("bigint").alias("size"))
    return summary.member_offsets(sizes, "conv_id", "turn", "size")


def console_lines(spark: SparkSession, sf: str) -> DataFrame:
    return detections(spark, sf).select(report.console_line().alias("line"))


def html_fragment(spark: SparkSession, sf: str) -> DataFrame:
    return detections(spark, sf).select(report.html_fragment().alias("fragment"))


def json_entry(spark: SparkSession, sf: str) -> DataFrame:
    return detections(spark, sf).select(report.json_entry().alias("entry"))


def _scan_of(table: str, key: str, body: str) -> Query:
    return lambda spark, sf: scan_files(injected(spark, sf, table, key, body), RULES).detections.select(*_HIT.split(", "))


def archive_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's file packed into an archive of its own, read back and scanned."""
    data = F.encode("content", "UTF-8")

    def little(n: Column, size: int) -> Column:
        return F.concat(*[F.unhex(F.lpad(F.hex(F.shiftright(n, 8 * k).bitwiseAND(255)), 2, "0")) for k in range(size)])

    name = F.encode(F.concat(F.lit("src/"), F.col("doc_id").cast("string"), "ext"), "UTF-8")
    size = F.octet_length("content").cast("bigint")
    whole = F.concat(F.lit(b"GMAD\x03" + bytes(16) + b"\0name\0about\0author\0\x01\0\0\0\x01\0\0\0"), name, F.lit(b"\0"), little(size, 8), F.lit(bytes(8)), data)
    packed = corpus(spark, sf).select(F.concat(F.lit("addons\\"), F.col("doc_id").cast("string"), F.lit(".gma")).alias("path"), whole.alias("content"))
    return scan_files(archive_members(packed), RULES).detections.select(*_HIT.split(", "))


def rule_files(spark: SparkSession, sf: str) -> DataFrame:
    """The shipped rules written as rule files, with lines that are no rules after them, and loaded again."""
    with tempfile.TemporaryDirectory() as folder:
        RULES.write(folder)
        for name in FILES.values():
            with open(os.path.join(folder, name), "a", encoding="utf-8") as f:
                f.write("no mark here\n\n(not closed;;;[LOW] x\n")
        return RuleSet.load(folder, spark).relation(spark)


_LOG = [("a.lua", 3, "[HIGH] x"), ("a.lua", 3, "[HIGH] x"), ("", 0, ""), ("b/c.vmt", 0, "[LOW] 'y'")]


def previous_scan(spark: SparkSession, sf: str) -> DataFrame:
    """An earlier scan's log with repeated detections and missing fields, loaded as keys."""
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "last_scan.json")
        report.write_json({"detections": [{k: v for k, v in zip(diff.KEY, row, strict=True) if v} for row in _LOG], "start_time": 0}, path)
        return diff.load_previous(spark, path)


def scan_log(spark: SparkSession, sf: str) -> DataFrame:
    """Critical detections written as the log document, and that read again."""
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "scan_log.json")
        report.write_log(report.entries(detections(spark, sf).where("severity = 'critical'")), {"start_time": 0, "end_time": 1}, path)
        with open(path, encoding="utf-8") as f:
            found = json.load(f)["detections"]
    names = ["file", "severity", "detection", "line_number", "line_text", "decoded_content"]
    return spark.createDataFrame([tuple(d.get(k) for k in names) for d in found], "file string, severity string, detection string, line_number int, line_text string, decoded_content string")


def summary_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of a scan's summary, numbered, without its duration."""
    text = report.summary_text(scan_files(corpus(spark, sf), RULES, "high").summary(), 0.0)
    return spark.createDataFrame([(k, line) for k, line in enumerate(text.split("\n")) if not line.startswith("Duration")], "place int, line string")


def known_count(spark: SparkSession, sf: str) -> DataFrame:
    return hash_list_parse(spark, sf).agg(F.count(F.lit(1)).alias("hashes"))


_fixture: list[str] = []


def directory_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The witness lines as a directory tree, with hidden names, read by the data source (driver and executors on one machine)."""
    if not _fixture:
        _fixture.append(tempfile.mkdtemp(prefix="siftline-tree-"))
        for k, (t, line, _) in enumerate(WITNESSES):
            folder = os.path.join(_fixture[0], ("_under", ".hid", "plain")[k % 3])
            os.makedirs(folder, exist_ok=True)
            with open(os.path.join(folder, f"{'_' if k % 2 else ''}{k}.{t.upper() if k % 5 == 0 else t}"), "wb") as f:
                f.write(f"first\r\n{line}\r\n".encode())
    found = scan(spark, _fixture[0], RULES).detections
    return found.select(F.regexp_extract("file", r"([0-9]+)\.[^.]*$", 1).cast("int").alias("witness"), "line_number", "rule_id", "detection", "line_text")


def entry(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: a scan's detections by type and severity."""
    return summary.counts_by(detections(spark, sf), "ext")


QUERIES: dict[str, Query] = {
    "rule_catalog": rule_catalog, "rule_counts_by_severity": rule_counts_by_severity, "file_extension": file_extension, "path_normalize": path_normalize,
    "line_split": line_split, "line_split_pages": line_split_pages, "match_lua": _matched((".lua",)), "match_vmt": _matched((".vmt",)), "match_vtf": _matched((".vtf",)),
    "match_ttf": _matched((".ttf",)), "match_all": _matched(), "match_by_join": match_by_join, "match_custom_rules": match_custom_rules, "severity_counts": severity_counts,
    "min_severity_medium": _least("medium"), "min_severity_high": _least("high"), "min_severity_critical": _least("critical"), "min_severity_unknown": _least("HIGH"),
    "scan_summary": scan_summary, "detections_by_rule": _by("ext", "rule_id", "detection"), "detections_by_file": _by("file"), "detections_by_source": _by("source"), "detections_by_type": entry,
    "ws_collapse": ws_collapse, "tab_escape": tab_escape, "detection_key": detection_key, "charcode_decode": _with_decoded("detection like '%CharCode%'"), "charcode_over_255": charcode_over_255,
    "hex_obfuscation_decode": hex_obfuscation_decode, "base64_payload": _with_decoded("detection like '%Base64%'"), "base64_extract": base64_extract, "base64_decode": base64_decode,
    "base64_binary_rejected": base64_binary_rejected, "djb2_hash": djb2_hash, "djb2_hash_lines": djb2_hash_lines, "known_hash_hits": known_hash_hits, "skip_known": skip_known,
    "hash_list_parse": hash_list_parse, "diff_new": diff_new, "diff_unchanged": diff_unchanged, "diff_removed": diff_removed, "prefix_offsets": prefix_offsets, "console_lines": console_lines,
    "html_fragment": html_fragment, "json_entry": json_entry, "scan_conversations": _scan_of("conversations", "conv_id", "text"), "scan_event_props": _scan_of("events", "event_id", "props"),
    "scan_pages": _scan_of("pages", "page_id", "html"), "rule_files": rule_files, "previous_scan": previous_scan, "scan_log": scan_log, "known_count": known_count, "summary_lines": summary_lines, "archive_scan": archive_scan, "directory_scan": directory_scan,
}


# ---- oracle SQL


def _sev(prefix: str = "") -> str:
    return ", ".join(f"CAST(count(CASE WHEN severity = '{s}' THEN 1 END) AS INT) AS {s}" for s in ("critical", "high", "medium", "low"))


def _match_sql(where: str = "true") -> str:
    return f"{_BASE} SELECT {_HIT} FROM hits WHERE {where}"


def _counts_sql(keys: str) -> str:
    return f"{_BASE} SELECT {keys}, count(*) AS detections, {_sev()} FROM hits GROUP BY {keys}"


def _scan_sql(table: str, key: str, body: str) -> str:
    src = f"{_W}, src AS (SELECT '{table}/' || {key} || {_ext_sql(key)} AS file, {_ext_sql(key)} AS ext, {body} || chr(10) || w.wline AS content FROM {table} JOIN w ON w.id = {key} % {N})"
    return f"WITH {src}, {_hits_sql('src', 'file, ext')} SELECT {_HIT} FROM hits"


def _bytes_sql(col: str) -> str:
    h = f"hex(encode({col}))"
    return f"list_transform(generate_series(1, length({h}) - 1, 2), lambda i: CAST('0x' || substr({h}, i, 2) AS BIGINT))"


def _djb2_sql(col: str) -> str:
    return f"lpad(lower(to_hex(list_reduce(list_concat([CAST(5381 AS BIGINT)], {_bytes_sql(col)}), lambda a, b: (a * 33 + b) % 4294967296))), 16, '0')"


_EARLIER = "e AS (SELECT file, line_number, detection FROM hits WHERE doc_id % 2 = 0 UNION ALL SELECT 'src/gone.lua', 3, '[HIGH] Gone')"
_EXT_SQL = {"file_ext": r"lower(regexp_extract(regexp_extract(url, '([^/]*)$', 1), '^.+(\.[^.]*)$', 1))", "member_ext": r"lower(regexp_extract(url, '(\.[^.]*)$', 1))"}
_HASHED = f"hashed AS (SELECT *, {_djb2_sql('content')} AS hash FROM corpus), bad AS (SELECT DISTINCT hash FROM hashed WHERE doc_id % 11 = 0)"
_B64LINE = "b AS (SELECT doc_id, 'x = \"' || to_base64(CASE WHEN doc_id % 3 = 0 THEN '\\x07'::BLOB || encode(text) ELSE encode(text) END) || '\"' AS line FROM documents)"
_CODE_LINE = "'x ' || " + " || ',' || ".join(f"CAST(CAST({c} AS INT) % 990 + 10 AS VARCHAR)" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "trunc(l_quantity)", "trunc(l_extendedprice)", "l_orderkey")) + " || ' y'"
_NODEC = "(SELECT *, " + _DECODED + " AS decoded_content FROM hits)"


def _esc(c: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = f"replace({c}, {q(a)}, {q(b)})"
    return c


ORACLES: dict[str, str] = {
    "rule_catalog": f"WITH {_rules_sql(RULES)} SELECT file_type, rule_id, pattern, detection, severity FROM r",
    "rule_counts_by_severity": f"WITH {_rules_sql(RULES)} SELECT file_type, severity, count(*) AS rules FROM r GROUP BY ALL",
    "file_extension": f"WITH {_CORPUS}, u AS (SELECT url FROM pages UNION ALL SELECT file FROM corpus) SELECT url, {_EXT_SQL['file_ext']} AS file_ext, {_EXT_SQL['member_ext']} AS member_ext FROM u",
    "path_normalize": "SELECT page_id, replace(url, '/', '\\') AS raw, url AS path FROM pages",
    "line_split": f"WITH {_CORPUS}, {_lines_sql('corpus', 'doc_id')} SELECT doc_id, line_number, CAST(length(line) AS INT) AS n_chars, md5(line) AS line_md5 FROM lines",
    "line_split_pages": f"WITH s AS (SELECT page_id, replace(html, '<p>', chr(10) || '<p>') AS content FROM pages), {_lines_sql('s', 'page_id')} SELECT page_id, count(*) AS lines, max(line_number) AS last, CAST(max(length(line)) AS INT) AS longest FROM lines GROUP BY page_id",
    **{f"match_{t}": _match_sql(f"ext = '.{t}'") for t in ("lua", "vmt", "vtf", "ttf")},
    "match_all": _match_sql(),
    "match_by_join": _match_sql(),
    "match_custom_rules": f"WITH s AS (SELECT CAST(doc_id AS VARCHAR) AS file, '.txt' AS ext, text AS content FROM documents), {_hits_sql('s', 'file, ext', CUSTOM)} SELECT file, line_number, rule_id, severity, line_text FROM hits",
    "severity_counts": f"{_BASE} SELECT {_sev()} FROM hits",
    "min_severity_medium": _match_sql("severity <> 'low'"),
    "min_severity_high": _match_sql("severity IN ('high', 'critical')"),
    "min_severity_critical": _match_sql("severity = 'critical'"),
    "min_severity_unknown": _match_sql(),
    "scan_summary": f"{_BASE}, f AS (SELECT CAST(count(*) AS INT) AS files_processed FROM corpus WHERE content <> ''), h AS (SELECT CAST(count(*) AS INT) AS detections_found FROM hits), k AS (SELECT {_sev()} FROM hits WHERE severity IN ('high', 'critical')) SELECT * FROM f, h, k",
    "detections_by_rule": _counts_sql("ext, rule_id, detection"),
    "detections_by_file": _counts_sql("file"),
    "detections_by_source": _counts_sql("source"),
    "detections_by_type": _counts_sql("ext"),
    "ws_collapse": f"WITH s AS (SELECT doc_id, replace(replace(text, ' ', ' ' || chr(9) || ' '), chr(10), chr(10) || chr(10) || ' ') AS line FROM documents), c AS (SELECT doc_id, {_WS} AS t FROM s) SELECT doc_id, md5(t) AS collapsed, CAST(length(t) AS INT) AS n FROM c",
    "tab_escape": "SELECT conv_id, turn, md5(replace(replace(text, ' ', chr(9)), chr(9), '\\t')) AS escaped FROM conversations",
    "detection_key": f"{_BASE} SELECT file || ':' || line_number || ':' || detection AS key FROM hits",
    "charcode_decode": f"{_BASE} SELECT file, line_number, rule_id, coalesce({_DECODED}, '') AS decoded_content FROM hits WHERE contains(detection, 'CharCode')",
    "charcode_over_255": f"WITH s AS (SELECT l_orderkey, l_linenumber, {_CODE_LINE} AS line FROM lineitem) SELECT l_orderkey, l_linenumber, {_CODES} AS decoded, array_to_string(list_transform(list_filter(list_transform(string_split(regexp_extract(line, '[0-9]{{2,3}}(?:,[0-9]{{2,3}}){{6,}}', 0), ','), lambda x: TRY_CAST(x AS INT)), lambda v: v <= 255), lambda v: chr(v)), '') AS decoded_full FROM s",
    "hex_obfuscation_decode": f"{_BASE} SELECT file, line_number, hex({_DECODED}) AS decoded_hex FROM hits WHERE ext = '.lua' AND rule_id = 26",
    "base64_payload": f"{_BASE} SELECT file, line_number, rule_id, coalesce({_DECODED}, '') AS decoded_content FROM hits WHERE contains(detection, 'Base64')",
    "base64_extract": f"WITH s AS (SELECT doc_id, text AS content FROM documents), {_lines_sql('s', 'doc_id')} SELECT doc_id, line_number, {_RUN} AS run, CASE WHEN {_TEXTUAL} THEN decode({_B64}) ELSE '' END AS payload FROM lines WHERE {_RUN} <> ''",
    "base64_decode": f"WITH {_B64LINE} SELECT doc_id, coalesce(CASE WHEN {_RUN} <> '' THEN hex({_B64}) END, '') AS bytes FROM b",
    "base64_binary_rejected": f"WITH {_B64LINE} SELECT doc_id, md5(CASE WHEN {_RUN} <> '' AND {_TEXTUAL} THEN decode({_B64}) ELSE '' END) AS payload_md5 FROM b",
    "djb2_hash": f"WITH {_CORPUS} SELECT file, {_djb2_sql('content')} AS hash FROM corpus",
    "djb2_hash_lines": f"WITH s AS (SELECT conv_id, turn, text AS content FROM conversations), {_lines_sql('s', 'conv_id, turn')} SELECT conv_id, turn, line_number, {_djb2_sql('line')} AS hash FROM lines",
    "known_hash_hits": f"WITH {_CORPUS}, {_HASHED} SELECT file, 'critical' AS severity, {q(known.LABEL)} AS detection, 0 AS line_number, 'File hash: ' || hash AS line_text, hash FROM hashed JOIN bad USING (hash)",
    "skip_known": f"{_BASE}, {_HASHED}, k AS (SELECT file, hash FROM hashed JOIN bad USING (hash)) SELECT file, severity, detection, line_number, rule_id, line_text FROM hits WHERE file NOT IN (SELECT file FROM k) UNION ALL SELECT file, 'critical', {q(known.LABEL)}, 0, 0, 'File hash: ' || hash FROM k",
    "hash_list_parse": f"SELECT DISTINCT split_part(x, ';;;', 1) AS hash FROM (VALUES {_values((x,) for x in _HASH_LINES)}) v(x) WHERE x <> '' AND NOT starts_with(x, '#')",
    "diff_new": f"{_BASE}, {_EARLIER} SELECT file, line_number, detection, rule_id FROM hits h WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.file = h.file AND e.line_number = h.line_number AND e.detection = h.detection)",
    "diff_unchanged": f"{_BASE}, {_EARLIER} SELECT file, line_number, detection, rule_id FROM hits h WHERE EXISTS (SELECT 1 FROM e WHERE e.file = h.file AND e.line_number = h.line_number AND e.detection = h.detection)",
    "diff_removed": f"{_BASE}, {_EARLIER} SELECT DISTINCT file, line_number, detection FROM e EXCEPT SELECT file, line_number, detection FROM hits",
    "prefix_offsets": 'SELECT conv_id, turn, CAST(strlen(text) AS BIGINT) AS size, CAST(coalesce(sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM conversations',
    "console_lines": f"{_BASE} SELECT file || ' | ' || detection || ' in a ' || upper(substr(ext, 2)) || ' @ Line #' || line_number || ' | ' || line_text || CASE WHEN coalesce(decoded_content, '') <> '' THEN ' -> Decoded: ' || CASE WHEN contains(detection, 'Base64') AND length(decoded_content) > 100 THEN left(decoded_content, 100) || '...' ELSE decoded_content END ELSE '' END AS line FROM {_NODEC}",
    "html_fragment": f"{_BASE} SELECT '<section class=\"hit ' || severity || '\"><b>' || severity || '</b> ' || {_esc('detection')} || '<br><i>' || {_esc('file')} || '</i> line ' || line_number || '<pre>' || {_esc('line_text')} || '</pre>' || CASE WHEN coalesce(decoded_content, '') <> '' THEN '<pre class=decoded>' || {_esc('decoded_content')} || '</pre>' ELSE '' END || '</section>' AS fragment FROM {_NODEC}",
    "json_entry": f"{_BASE} SELECT CASE WHEN coalesce(decoded_content, '') <> '' THEN CAST(json_object('decoded_content', decoded_content, 'detection', detection, 'file', file, 'line_number', line_number, 'line_text', line_text, 'severity', severity) AS VARCHAR) ELSE CAST(json_object('detection', detection, 'file', file, 'line_number', line_number, 'line_text', line_text, 'severity', severity) AS VARCHAR) END AS entry FROM {_NODEC}",
    "rule_files": f"WITH {_rules_sql(RULES)} SELECT file_type, rule_id, pattern, detection, severity FROM r",
    "previous_scan": f"SELECT DISTINCT file, CAST(line_number AS INT) AS line_number, detection FROM (VALUES {_values(_LOG)}) v(file, line_number, detection)",
    "scan_log": f"{_BASE} SELECT file, severity, detection, line_number, line_text, nullif(decoded_content, '') AS decoded_content FROM {_NODEC} WHERE severity = 'critical'",
    "summary_lines": f"{_BASE}, f AS (SELECT count(*) AS files FROM corpus WHERE content <> ''), h AS (SELECT count(*) AS found FROM hits), k AS (SELECT {_sev()} FROM hits WHERE severity IN ('high', 'critical')), "
    "l AS (SELECT unnest(['Scan complete', NULL, 'Files scanned: ' || files, repeat('-', 32), ' CRITICAL: ' || critical, '     HIGH: ' || high, '   MEDIUM: ' || medium, '      LOW: ' || low, repeat('-', 32), 'TOTAL: ' || found]) AS line, unnest(range(10)) AS place FROM f, h, k) SELECT CAST(place AS INT) AS place, line FROM l WHERE line IS NOT NULL",
    "known_count": f"SELECT count(DISTINCT split_part(x, ';;;', 1)) AS hashes FROM (VALUES {_values((x,) for x in _HASH_LINES)}) v(x) WHERE x <> '' AND NOT starts_with(x, '#')",
    "scan_conversations": _scan_sql("conversations", "conv_id", "text"),
    "scan_event_props": _scan_sql("events", "event_id", "props"),
    "scan_pages": _scan_sql("pages", "page_id", "html"),
    "archive_scan": f"WITH {_CORPUS}, a AS (SELECT 'addons/' || doc_id || '.gma/src/' || doc_id || ext AS file, ext, content FROM corpus), {_hits_sql('a', 'file, ext')} SELECT {_HIT} FROM hits",
    "directory_scan": f"WITH {_W}, a AS (SELECT CAST(id AS INT) AS witness, '.' || t AS ext, 'first' || chr(10) || wline || chr(10) AS content FROM w), {_hits_sql('a', 'witness, ext')} SELECT witness, line_number, rule_id, detection, line_text FROM hits",
}
