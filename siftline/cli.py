"""Command line: scan a directory and write the reports."""

from __future__ import annotations

import os
import sys
import time
from collections.abc import Iterator

from pyspark.sql import functions as F

from .functions.severity import meets
from .functions.text import ARCHIVE
from .operators.diff import load_previous
from .operators.known import load_hashes
from .operators.rules import RuleSet
from .plans.report import console_line, entries, ordered, summary_text, write_html, write_log
from .plans.scan import scan
from .sources.archive import read_directory
from .sources.files import extension, list_files

USAGE = """Usage: python -m siftline [options]

  -d <directory>   directory to scan (asked for if missing)
  -s <severity>    least severity: low, medium, high or critical
  -q, --quiet      only the summary
  --html           also write scan_report.html
  --diff           only detections that last_scan.json does not hold
  --rules <dir>    rule files to use instead of the shipped ones
  -h, --help       this text

Reads known_hashes.txt and last_scan.json, writes scan_log.json and last_scan.json,
all in the working directory."""


def parse(argv: list[str]) -> dict:
    """Options; unknown ones, and those without their value, are ignored."""
    out = {"directory": "", "severity": "low", "quiet": False, "html": False, "diff": False, "rules": None, "help": False}
    k = 0
    while k < len(argv):
        a = argv[k]
        if a in ("-d", "-s", "--rules") and k + 1 < len(argv):
            k += 1
            out[{"-d": "directory", "-s": "severity", "--rules": "rules"}[a]] = argv[k]
        elif a in ("-q", "--quiet", "--html", "--diff", "-h", "--help"):
            out[{"-q": "quiet", "--quiet": "quiet", "--html": "html", "--diff": "diff", "-h": "help", "--help": "help"}[a]] = True
        k += 1
    return out


def parse_answer(line: str, options: dict) -> dict:
    """The interactive answer: a path, then options; words that are no option belong to the path."""
    words = line.split()
    out, path, k = dict(options), words[:1], 1
    while k < len(words):
        w = words[k]
        if w in ("--html", "--diff"):
            out[w[2:]] = True
        elif w in ("-q", "--quiet"):
            out["quiet"] = True
        elif w == "-s" and k + 1 < len(words):
            k += 1
            out["severity"] = words[k]
        elif not w.startswith("-") and "--" not in w:
            path.append(w)
        k += 1
    return out | {"directory": " ".join(path)}


def unquote(path: str) -> str:
    """A path without the quotes around it."""
    if path.startswith('"'):
        end = path.find('"', 1)
        return path[1:end] if end > 0 else path
    return path


def archive_lines(root: str) -> Iterator[str]:
    """Title and number of entries of every archive that can be read; only their headers are."""
    for path, _, error in list_files(root):
        if not error and extension(path) == ARCHIVE:
            try:
                with open(path, "rb") as f:
                    archive = read_directory(f)
            except OSError:
                continue
            if archive.valid:
                yield f"Archive {path}: {archive.name} ({len(archive.entries)} files)"


def main(argv: list[str] | None = None, spark=None, ask=input) -> int:
    """Exit code 1: no rules, no such directory or a log that can't be written; else 0, whatever is found."""
    options = parse(sys.argv[1:] if argv is None else argv)
    if options["help"]:
        print(USAGE)
        return 0
    if not options["directory"]:
        options = parse_answer(ask("Enter path [options]: "), options)
    root = unquote(options["directory"])
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("siftline").getOrCreate()
    try:
        rules = RuleSet.load(options["rules"], spark) if options["rules"] else RuleSet.shipped()
    except ValueError as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    previous = None
    if options["diff"]:
        previous = load_previous(spark, "last_scan.json")
        n = previous.count()
        print(f"Comparing with {n} earlier detections." if n else "No earlier scan: all detections are shown.")
    if not root or not os.path.isdir(root):
        print("Error: no such directory.", file=sys.stderr)
        return 1
    try:
        open("scan_log.json", "a", encoding="utf-8").close()
    except OSError as e:
        print(f"Error: the log can't be written: {e}", file=sys.stderr)
        return 1
    hashes = load_hashes(spark, "known_hashes.txt")
    if hashes is not None:
        print(f"Known hashes: {hashes.count()}.")
    if not options["quiet"]:
        for line in archive_lines(root):
            print(line)
    began, start = time.perf_counter(), int(time.time())
    result = scan(spark, root, rules, options["severity"], hashes, previous).persist()
    summary = result.summary()
    seconds = time.perf_counter() - began
    if not options["quiet"]:
        for row in ordered(result.hits).select(console_line().alias("line")).toLocalIterator():
            print(row.line)
        for row in result.errors.toLocalIterator():
            print(f"{row.file}: {row.error}", file=sys.stderr)
    rest = {"start_time": start, "end_time": int(time.time()), **summary}
    write_log(entries(result.detections), rest, "scan_log.json")
    # The next comparison is with all of this scan, not with what was new in it; its hits are kept, so nothing is scanned twice.
    write_log(entries(result.hits.where(meets(F.col("severity"), options["severity"]))), rest, "last_scan.json")
    if options["html"]:
        write_html({"detections": entries(result.detections), **rest}, "scan_report.html")
    result.hits.unpersist()
    print(summary_text(summary, seconds))
    return 0
