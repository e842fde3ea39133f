"""Directories, archives, blocklists, reports, the command line and streams."""

from __future__ import annotations

import io
import json
import os
import struct

import pytest
from pyspark.sql import functions as F

from siftline import cli
from siftline.functions.hashing import djb2_bytes
from siftline.operators import diff, known, match
from siftline.operators.rules import Rule, RuleSet, parse
from siftline.plans import report
from siftline.plans.scan import scan, scan_files
from siftline.plans.witnesses import WITNESSES
from siftline.sources.archive import archive_directory, archive_members, read_directory
from siftline.sources.files import read_directory_tree, scan_store

RULES = RuleSet.shipped()
HIT = b'RunString("x")\n'


def gmad(entries, version=3, magic=b"GMAD", required=(b"need",)):
    out = magic + bytes([version]) + struct.pack("<QQ", (1 << 64) - 1, 7)
    out += b"".join(r + b"\0" for r in required) + b"\0" + b"n\0d\0a\0" + struct.pack("<i", 1)
    for k, (name, data, *size) in enumerate(entries, 1):
        out += struct.pack("<I", k) + name + b"\0" + struct.pack("<qI", size[0] if size else len(data), 99)
    return out + struct.pack("<I", 0) + b"".join(e[1] for e in entries)


@pytest.fixture()
def tree(tmp_path):
    files = {
        "a/A.LUA": b'RunString("x")\r\nfoo\n', "a/_init.lua": HIT, "_under/u.lua": HIT, "a/.hid/h.lua": HIT, "a/.lua": HIT, "a/empty.lua": b"", "a/t.txt": HIT,
        "a/bin.vtf": b"\xff\xfe\x00RunString(\n\x1a\nSendLua(\n", "a/known.lua": HIT + b"known\n", "ü/x.ttf": HIT, "p.gma": gmad([(b"lua/x.lua", b"a\r\n" + HIT), (b"mat/y.vmt", HIT), (b"readme.txt", HIT), (b"e.lua", b""), (b".lua", HIT), (b"in.gma", HIT)]),
        "bad.gma": b"GMAX", "cut.gma": gmad([(b"x.lua", HIT)])[:20],
    }
    for name, data in files.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    return tmp_path


def test_directory(spark, tree):
    bad = spark.createDataFrame([(djb2_bytes(HIT + b"known\n"),)], "hash string")
    r = scan(spark, str(tree), hashes=bad)
    rows = {(x.file.removeprefix(str(tree) + "/"), x.line_number, x.rule_id): x for x in r.detections.collect()}
    assert set(rows) == {
        ("a/A.LUA", 1, 1), ("a/_init.lua", 1, 1), ("_under/u.lua", 1, 1), ("a/.hid/h.lua", 1, 1), ("a/bin.vtf", 1, 1), ("a/bin.vtf", 3, 8), ("a/known.lua", 0, 0), ("ü/x.ttf", 1, 3),
        ("p.gma/lua/x.lua", 2, 1), ("p.gma/mat/y.vmt", 1, 3), ("p.gma/.lua", 1, 1),
    }
    assert rows["a/A.LUA", 1, 1].line_text == 'RunString("x")'
    assert rows["a/known.lua", 0, 0].line_text == "File hash: " + rows["a/known.lua", 0, 0].hash
    s = r.summary()
    assert s["files_processed"] == 10 and s["detections_found"] == 11 and s["statistics"]["critical"] == 11
    assert {e.file.removeprefix(str(tree) + "/") for e in r.errors.collect()} == {"bad.gma", "cut.gma"}


def test_store_reader_hides_names(spark, tree):
    names = {r.file.rsplit("/", 1)[1] for r in scan_store(spark, str(tree)).collect()}
    assert "A.LUA" in names and "_init.lua" not in names and "empty.lua" not in names
    whole = scan(spark, scan_store(spark, str(tree)), RULES)
    assert {r.file.split(str(tree) + "/")[1] for r in whole.detections.where("file like '%p.gma/%'").collect()} == {"p.gma/lua/x.lua", "p.gma/mat/y.vmt", "p.gma/.lua"}
    assert {r.file.rsplit("/", 1)[1] for r in whole.errors.collect()} == {"bad.gma", "cut.gma"}


def test_archive_damage():
    whole = gmad([(b"x.lua", HIT)])
    assert read_directory(io.BytesIO(whole)).valid and read_directory(io.BytesIO(gmad([(b"x.lua", HIT)], version=4))).valid
    assert not read_directory(io.BytesIO(gmad([], magic=b"GMAX"))).valid
    directory = len(whole) - len(HIT)
    for n in range(directory):
        assert not read_directory(io.BytesIO(whole[:n])).valid
    assert not read_directory(io.BytesIO(gmad([(b"x.lua", HIT, -5)]))).valid
    a = read_directory(io.BytesIO(gmad([(b"a.lua", b"12345"), (b"b.lua", b"123"), (b"c.lua", b"1")])))
    assert [e.offset for e in a.entries] == [0, 5, 8] and a.steam_id == (1 << 64) - 1


def test_archive_relation(spark):
    df = spark.createDataFrame([("d\\a.gma", bytearray(gmad([(b"m/x.lua", HIT), (b"n.txt", HIT), (b"y.VMT", HIT)]))), ("b.gma", bytearray(b"no")), ("c.gma", None)], "path string, content binary")
    rows = {r.path: r for r in archive_directory(df).collect()}
    assert rows["d\\a.gma"].valid and len(rows["d\\a.gma"].entries) == 3 and not rows["b.gma"].valid and not rows["c.gma"].valid
    got = archive_members(df).collect()
    assert {(r.file, r.ext, bytes(r.content)) for r in got if not r.error} == {("d/a.gma/m/x.lua", ".lua", HIT), ("d/a.gma/y.VMT", ".vmt", HIT)}
    assert {r.file for r in got if r.error} == {"b.gma", "c.gma"} and archive_members(df.where("false")).count() == 0


def test_damaged_archives_beside_sound_ones(spark):
    """Members that claim gigabytes cost what the archive holds; repeated paths stay apart."""
    sound = gmad([(b"x.lua", HIT)])
    rows = [("s.gma", sound), ("s.gma", sound), ("i.gma", gmad([(b"a.lua", HIT, (1 << 31) - 100)])), ("l.gma", gmad([(b"a.lua", HIT, 1 << 33), (b"b.lua", HIT)])), ("n.gma", gmad([(b"a.lua", HIT, -1)])), ("t.gma", sound[:-3])]
    df = spark.createDataFrame([(p, bytearray(d)) for p, d in rows], "path string, content binary")
    got = [(r.file, r.content and len(r.content), r.error is None) for r in archive_members(df).collect()]
    assert got.count(("s.gma/x.lua", len(HIT), True)) == 2 and ("t.gma/x.lua", len(HIT), True) in got and ("n.gma", None, False) in got
    assert all(n is None or n <= 3 * len(sound) for _, n, _ in got) and {f for f, _, ok in got if ok} >= {"i.gma/a.lua", "l.gma/a.lua"}
    r = scan_files(archive_members(df), RULES)
    assert r.detections.where("file like 's.gma%'").count() == 2 and r.errors.count() == 1


def test_rules_loading(spark, tmp_path):
    rules = parse("a+;;;[HIGH] x;;;y\n\nno mark\nbad(;;;[LOW] z\n;;;empty\n", ".lua", spark)
    assert [(r.rule_id, r.pattern, r.detection, r.severity) for r in rules] == [(1, "a+", "[HIGH] x;;;y", "high"), (5, "", "empty", "low")]
    with pytest.raises(ValueError):
        RuleSet.load(tmp_path)
    RULES.write(tmp_path)
    assert RuleSet.load(tmp_path, spark) == RULES
    empty = RuleSet((Rule(".lua", 1, "", "all"),))
    df = spark.createDataFrame([("f", ".lua", "a\n\nb")], "file string, ext string, content string")
    assert scan_files(df, empty).detections.count() == 3


def test_each_rule_runs_once(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    df = spark.createDataFrame([("f", ".lua", "x")], "file string, ext string, content string")
    plan = match.match_lines(match.number_lines(df), RuleSet(RULES.of(".lua")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 62 + 2  # and the test of decoded bytes, in one rule


def test_prefilter_and_join_agree(spark):
    rows = [(str(k), "." + (t if t == "lua" else o), "first\n" + line) for k, (t, line, _) in enumerate(WITNESSES) for o in ("vmt", "vtf", "ttf")]
    df = spark.createDataFrame(rows, "file string, ext string, content string").distinct()
    cols = ["file", "ext", "line_number", "rule_id"]
    a = {tuple(r) for r in match.match_files(df, RULES).select(cols).collect()}
    b = {tuple(r) for r in match.match_files(df, RULES, prefilter=False).select(cols).collect()}
    rel = spark.createDataFrame([(r.file_type, r.rule_id, r.java, r.detection, r.severity) for r in RULES.rules], "file_type string, rule_id int, java string, detection string, severity string")
    c = {tuple(r) for r in match.match_by_join(match.number_lines(df), rel).select(cols).collect()}
    assert a == b == c and a
    for bound in ("^foo$", "(x|^foo$)", r"fo+(?!\s*baz)", "[f]oo$"):
        df = spark.createDataFrame([("f", ".lua", "bar\nfoo\nbaz")], "file string, ext string, content string")
        assert [r.line_number for r in match.match_files(df, RuleSet((Rule(".lua", 1, bound, "x"),))).collect()] == [2]


def test_threshold_and_summary(spark):
    df = spark.createDataFrame([("a", ".lua", WITNESSES[26][1] + "\n" + WITNESSES[0][1])], "file string, ext string, content string")
    r = scan_files(df, RULES, "critical")
    assert r.summary() == {"files_processed": 1, "detections_found": 2, "statistics": {"critical": 1, "high": 0, "medium": 0, "low": 0}}
    assert r.detections.count() == 1
    none = scan_files(df.where("false"), RULES).summary()
    assert none == {"files_processed": 0, "detections_found": 0, "statistics": {"critical": 0, "high": 0, "medium": 0, "low": 0}}


def test_diff(spark, tmp_path):
    log = tmp_path / "last.json"
    log.write_text('{"detections":[{"file":"a.lua","line_number":1,"detection":"[CRITICAL] Code Execution (RunString)"},{}]}')
    df = spark.createDataFrame([("a.lua", ".lua", 'RunString("x")\nRunString("x")')], "file string, ext string, content string")
    got = scan_files(df, RULES, previous=diff.load_previous(spark, str(log))).detections.collect()
    assert [r.line_number for r in got] == [2]
    assert {tuple(r) for r in diff.previous_from_json(spark, str(log)).collect()} == {tuple(r) for r in diff.load_previous(spark, str(log)).collect()}
    log.write_text("{broken")
    assert diff.load_previous(spark, str(log)).count() == 0 and diff.load_previous(spark, None).count() == 0


def test_hash_lists(spark):
    text = "# c\n\nabc;;;x\nabc\r\ndef\n"
    assert known.parse_hashes(text) == ["abc", "def"]
    assert {r.hash for r in known.hash_relation(spark.createDataFrame([(x,) for x in text.replace("\r", "").split("\n")], "value string")).collect()} == {"abc", "def"}
    assert known.load_hashes(spark, "/nowhere") is None


def test_html_is_escaped(tmp_path):
    d = {"detections": [{"file": "<f>", "severity": "high", "detection": "[HIGH] <x>", "line_number": 1, "line_text": "<script>", "decoded_content": "a&b"}], "files_processed": 1, "statistics": {"critical": 0, "high": 1, "medium": 0, "low": 0}}
    report.write_html(d, tmp_path / "r.html")
    page = (tmp_path / "r.html").read_text()
    assert "<script>" not in page and "&lt;script&gt;" in page and "a&amp;b" in page


def test_command_line(spark, tree, tmp_path_factory, monkeypatch, capsys):
    work = tmp_path_factory.mktemp("work")
    monkeypatch.chdir(work)
    assert cli.main(["-h"]) == 0
    assert cli.main(["-d", str(tree / "nowhere")], spark) == 1
    assert cli.main(["-d", str(tree), "--rules", str(work)], spark) == 1
    assert cli.main(["-d", str(tree), "--html", "-x"], spark) == 0
    out = capsys.readouterr().out
    assert " in a LUA @ Line #1 | RunString" in out and "Scan complete" in out and "p.gma: n (6 files)" in out and "bad.gma" not in out and "Known hashes" not in out
    log = json.loads((work / "scan_log.json").read_text())
    assert log == json.loads((work / "last_scan.json").read_text()) and len(log["detections"]) == 11 and log["files_processed"] == 10
    assert list(log) == sorted(log) and "decoded_content" not in log["detections"][0]
    assert (work / "scan_report.html").exists()
    (tree / "new.lua").write_bytes(HIT)
    (work / "known_hashes.txt").write_text("aa;;;x\nbb\n")
    assert cli.main(["-q", "--diff"], spark, ask=lambda _: f'"{tree}" -s high') == 0
    log = json.loads((work / "scan_log.json").read_text())
    assert [os.path.basename(d["file"]) for d in log["detections"]] == ["new.lua"]
    out = capsys.readouterr().out
    assert " in a " not in out and "files)" not in out and "Known hashes: 2." in out
    assert len(json.loads((work / "last_scan.json").read_text())["detections"]) == 12
    options = cli.parse_answer("some dir -q --diff -s high more --x", cli.parse([]))
    assert (options["directory"], options["quiet"], options["diff"], options["severity"]) == ("some dir more", True, True, "high")


def test_stream(spark, tmp_path):
    from siftline.streaming.scan_stream import stream_detections, stream_files

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.lua").write_bytes(HIT + HIT)
    run = stream_detections(stream_files(spark, str(src))).writeStream.format("memory").queryName("hits").option("checkpointLocation", str(tmp_path / "cp")).start()
    run.processAllAvailable()
    (src / "b.vmt").write_bytes(HIT)
    run.processAllAvailable()
    run.stop()
    assert {(os.path.basename(r.file), r.line_number, r.rule_id) for r in spark.table("hits").collect()} == {("a.lua", 1, 1), ("a.lua", 2, 1), ("b.vmt", 1, 3)}


def test_reader_splits_by_size(spark, tree):
    df = read_directory_tree(spark, str(tree))
    assert df.where(F.col("error").isNull()).count() == 10
