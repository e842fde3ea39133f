"""Reports: console lines, the JSON log, the HTML page, the summary."""

from __future__ import annotations

import html
import json
import os
import textwrap
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import type_label

#: Text that the console shows of what was decoded.
CONSOLE_CHARS = 100
DETECTION = ("file", "severity", "detection", "line_number", "line_text", "decoded_content", "hash")


def console_line() -> Column:
    """path | label in a TYPE @ Line #n | text, and what was decoded. Of known files only path and hash."""
    decoded = F.col("decoded_content")
    # Only payloads are cut: character codes are shown whole.
    shown = F.when(F.contains(F.col("detection"), F.lit("Base64")) & (F.length(decoded) > CONSOLE_CHARS), F.concat(F.left(decoded, F.lit(CONSOLE_CHARS)), F.lit("..."))).otherwise(decoded)
    line = F.concat(F.col("file"), F.lit(" | "), F.col("detection"), F.lit(" in a "), type_label(F.col("ext")), F.lit(" @ Line #"), F.col("line_number").cast("string"), F.lit(" | "), F.col("line_text"), F.when(decoded.isNotNull() & (decoded != ""), F.concat(F.lit(" -> Decoded: "), shown)).otherwise(F.lit("")))
    return F.when(F.col("line_number") == 0, F.concat(F.lit("[KNOWN BACKDOOR] "), F.col("file"), F.lit(" (Hash: "), F.col("hash"), F.lit(")"))).otherwise(line)


def json_entry() -> Column:
    """A detection as a JSON object with its keys in order; absent optional keys are left out."""
    return F.to_json(F.struct(*[F.nullif(F.col("decoded_content"), F.lit("")).alias("decoded_content") if c == "decoded_content" else F.col(c) for c in sorted(DETECTION)]))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def html_fragment() -> Column:
    """A detection as an HTML block, everything escaped."""
    e = lambda c: escape_html(F.col(c))
    return F.concat(
        F.lit('<section class="hit '), e("severity"), F.lit('"><b>'), e("severity"), F.lit("</b> "), e("detection"), F.lit("<br><i>"), e("file"), F.lit("</i> line "), F.col("line_number").cast("string"), F.lit("<pre>"), e("line_text"), F.lit("</pre>"),
        F.when(F.coalesce(F.col("decoded_content"), F.lit("")) != "", F.concat(F.lit("<pre class=decoded>"), e("decoded_content"), F.lit("</pre>"))).otherwise(F.lit("")), F.lit("</section>"),
    )


def ordered(detections: DataFrame) -> DataFrame:
    """By file, line and rule."""
    keys = ["file", "line_number", *(["rule_id"] if "rule_id" in detections.columns else []), "detection"]
    return detections.orderBy(*keys)


def entries(detections: DataFrame) -> Iterator[dict]:
    """Detections in order as the log holds them, one at a time."""
    for r in ordered(detections).toLocalIterator():
        d = r.asDict()
        yield {k: d[k] for k in DETECTION if d.get(k) not in (None, "") or k not in ("decoded_content", "hash")}


def log_document(detections: DataFrame, summary: dict, start: int, end: int) -> dict:
    """The whole log as one document, for results that fit the driver; write_log() streams it."""
    return {"detections": list(entries(detections)), "start_time": start, "end_time": end, **summary}


def _json(value) -> str:
    return json.dumps(value, indent=4, sort_keys=True, ensure_ascii=False)


def write_log(found: Iterable[dict], rest: dict, path: str | os.PathLike) -> None:
    """The log document as a file, detection by detection, with its keys in order; written beside the target and moved over it."""
    part = Path(f"{path}.part")
    with open(part, "w", encoding="utf-8") as f:
        f.write('{\n    "detections": [')
        some = False
        for d in found:
            f.write((",\n" if some else "\n") + textwrap.indent(_json(d), " " * 8))
            some = True
        f.write("\n    ]" if some else "]")
        f.writelines(",\n" + textwrap.indent(f"{_json(k)}: {_json(rest[k])}", "    ") for k in sorted(rest))
        f.write("\n}\n")
    os.replace(part, path)


def write_json(document: dict, path: str | os.PathLike) -> None:
    """Written beside the target and moved over it, so that a reader never sees half a log."""
    write_log(document["detections"], {k: v for k, v in document.items() if k != "detections"}, path)


def write_log_store(detections: DataFrame, path: str) -> None:
    """Detections as JSON lines in a store, one file per partition: for scans of any size."""
    detections.select(*[c for c in DETECTION if c in detections.columns]).write.mode("overwrite").json(path)


_STYLE = "body{font:15px sans-serif;margin:2em;background:#fbfbf8;color:#222}table td{padding:.4em 1.2em;text-align:center}.hit{border-left:5px solid #999;margin:1em 0;padding:.6em 1em;background:#fff}.critical{border-color:#b00020}.high{border-color:#e06000}.medium{border-color:#c9a400}.low{border-color:#2e7d32}pre{white-space:pre-wrap;background:#f1f1ec;padding:.5em}.decoded{color:#0a5c36}"


def write_html(document: dict, path: str | os.PathLike, title: str = "Content scan report") -> None:
    """A page of severity counts, files scanned and detections; everything is escaped."""
    e = lambda x: html.escape(str(x))
    stats = document["statistics"]
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>{e(title)}</title><style>{_STYLE}</style></head><body>\n<h1>{e(title)}</h1>\n<table><tr>')
        f.write("".join(f"<td class={s}><b>{stats[s]}</b><br>{s.capitalize()}</td>" for s in ("critical", "high", "medium", "low")))
        f.write(f"</tr></table>\n<p>Files scanned: {document['files_processed']}</p>\n")
        for d in document["detections"]:
            f.write(f'<section class="hit {e(d["severity"])}"><b>{e(d["severity"])}</b> {e(d["detection"])}<br><i>{e(d["file"])}</i> line {d["line_number"]}<pre>{e(d["line_text"])}</pre>')
            if d.get("decoded_content"):
                f.write(f"<pre class=decoded>{e(d['decoded_content'])}</pre>")
            f.write("</section>\n")
        f.write("</body></html>\n")


def summary_text(summary: dict, seconds: float) -> str:
    stats, bar = summary["statistics"], "-" * 32
    rows = [f"Duration: {seconds:.2f} s", f"Files scanned: {summary['files_processed']}", bar, *(f"{s.upper():>9}: {stats[s]}" for s in ("critical", "high", "medium", "low")), bar, f"TOTAL: {summary['detections_found']}"]
    return "\n".join(["Scan complete", *rows])
