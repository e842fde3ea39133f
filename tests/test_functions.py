"""Scalar functions against their vectors."""

from __future__ import annotations

import base64
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftline.functions import decode, dialect, hashing, text
from siftline.functions.severity import meets, severity, severity_of
from siftline.operators.rules import RuleSet
from siftline.plans.witnesses import WITNESSES

RULES = RuleSet.shipped()


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


@pytest.mark.parametrize("data, h32, h64", [(b"abc", "000000000b885c8b", "000000000b885c8b"), (b"", "0000000000001505", "0000000000001505"), (b"z" * 40, "0000000025b86815", "22e8e87225b86815"), (b"\xc3\xa9", "0000000000598411", "0000000000598411"), (b'RunString("x")\nfoo\n', "00000000c927c976", "f7bd758ac927c976"), (b"\xff" * 20, "000000008bace5b1", "e85205f78bace5b1")])
def test_djb2(spark, data, h32, h64):
    assert hashing.djb2_bytes(data) == h32
    assert hashing.djb2_bytes(data, 64) == h64
    assert one(spark, bytearray(data), hashing.djb2(F.col("x")), "binary") == h32
    assert one(spark, bytearray(data), hashing.djb2(F.col("x"), 64), "binary") == h64


def test_djb2_sql_and_null(spark):
    assert one(spark, "abc", hashing.djb2_sql(F.col("x"))) == "000000000b885c8b"
    assert one(spark, "", hashing.djb2_sql(F.col("x"))) == "0000000000001505"
    assert one(spark, None, hashing.djb2(F.col("x")), "binary") is None


@pytest.mark.parametrize("content, want", [("a\n\nb\n", ["a", "", "b"]), ("\n", [""]), ("", []), ("a\r\nb", ["a\r", "b"])])
def test_lines(spark, content, want):
    assert one(spark, content, text.lines(F.col("x"))) == want


@pytest.mark.parametrize("path, disk, member", [("a/.lua", "", ".lua"), ("a.lua/b", "", ".lua/b"), ("x.tar.lua", ".lua", ".lua"), ("a/b.LUA", ".lua", ".lua"), ("a/b.", ".", ".")])
def test_extensions(spark, path, disk, member):
    assert one(spark, path, text.file_extension(F.col("x"))) == disk
    assert one(spark, path, text.member_extension(F.col("x"))) == member


def test_space_tabs_paths_keys(spark):
    assert one(spark, "\t\t a \v\r b  ", text.collapse_space(F.col("x"))) == "\ta b "
    assert one(spark, "a\tb", text.escape_tabs(F.col("x"))) == "a\\tb"
    assert one(spark, "a\\b", text.normal_path(F.col("x"))) == "a/b"
    assert one(spark, "f", text.detection_key(F.col("x"), F.lit(3), F.lit("[HIGH] y"))) == "f:3:[HIGH] y"
    assert one(spark, ".vtf", text.type_label(F.col("x"))) == "VTF"
    assert one(spark, bytearray(b"a\xffb"), text.as_text(F.col("x")), "binary") == "a�b"


LIST = dialect.to_java("[0-9]{2,3}(,[0-9]{2,3}){6,}")


@pytest.mark.parametrize("line, want", [("97,98,99,100,101,102,103", "a"), ("x 97,98,99,100,101,102,103 y 300,10,10,10,10,10,10 z 65,66,67,68,69,70,71", "aA"), ("72,10,10,10,10,10,1234,66,10,10,10,10,10,10", "HB"), ("1234,10,10,10,10,10,10", "ê"), ("97,98,99", "")])
def test_char_codes(spark, line, want):
    assert one(spark, line, decode.char_codes(F.col("x"), LIST)) == want


def test_char_codes_of_other_rules(spark):
    hexed = next(r for r in RULES.of(".lua") if r.rule_id == 26).java
    assert one(spark, "0x0123456789abcdef 0XFFFFFFFFFFFFFFFF0", decode.char_codes(F.col("x"), hexed)) == "\0\0"
    chars = next(r for r in RULES.of(".lua") if r.rule_id == 50).java
    assert one(spark, "string.char(82,117,110,83,116)", decode.char_codes(F.col("x"), chars)) == ""
    assert one(spark, " 65; -66; 67; x", decode.char_codes(F.col("x"), r" -?[0-9]+")) == "AC"
    assert one(spark, "97,98,99,100,101,102,103", decode.full_char_codes(F.col("x"))) == "abcdefg"
    assert decode.leading_codes(["65", "99999999999", "66"]) == "A"


PAYLOAD = b'print("hello from a base64 payload that is long enough to count, really")'


def test_base64(spark):
    b = base64.b64encode(PAYLOAD).decode()
    got = lambda line: one(spark, line, decode.base64_payload(F.col("x")))
    assert got(f'x = "{b}"') == PAYLOAD.decode()
    assert got(f"x = {b.rstrip('=')} ") == PAYLOAD.decode()
    assert got(b.rstrip("=")[:-1]).startswith(PAYLOAD.decode()[:-2])
    assert got("a=" + "A" * 44 + f' b="{b}"') == ""
    assert got(base64.b64encode(bytes(range(128, 200))).decode()) == ""
    assert got(base64.b64encode(b"z" * 60 + b"\x00\xff").decode()) == "z" * 60 + "\0�"
    assert got("QUJD" * 9) == ""


def test_severity(spark):
    assert [severity_of(x) for x in ("[CRITICAL] a", "x [HIGH]", "[MEDIUM]", "[high]")] == ["critical", "high", "medium", "low"]
    assert one(spark, "[MEDIUM] [HIGH]", severity(F.col("x"))) == "high"
    df = spark.createDataFrame([("low",), ("medium",), ("high",), ("critical",)], "s string")
    count = lambda level: df.where(meets(F.col("s"), level)).count()
    assert [count(x) for x in ("low", "medium", "high", "critical", "HIGH")] == [4, 3, 2, 1, 4]


def test_witnesses_in_java(spark):
    """Every rule's hit-list, by the rewritten patterns in the JVM."""
    rows = [(k, "." + t, line) for k, (t, line, _) in enumerate(WITNESSES)]
    from siftline.operators.match import match_lines

    found = match_lines(spark.createDataFrame(rows, "k int, ext string, line string"), RULES).groupBy("k").agg(F.sort_array(F.collect_list("rule_id")).alias("ids")).collect()
    assert {r.k: r.ids for r in found} == {k: ids for k, (_, _, ids) in enumerate(WITNESSES) if ids}


def test_dialect(spark):
    assert dialect.to_java(r"\bload") == r"(?<![A-Za-z0-9_])load"
    assert dialect.to_java(r"load\b") == r"load(?![A-Za-z0-9_])"
    assert dialect.to_java("[a[b&&c]") == r"[a\[b&\&c]"
    assert dialect.to_java("[[:alpha:]_]+$") == r"[\p{Alpha}_]+\z"
    assert dialect.to_java("a.b") == r"a[^\n\r]b"
    assert dialect.to_java("[0-9]{2}(,[0-9]{2,3}){6,}9") == "[0-9]{2}(,[0-9]{2,3}){6,}9"  # what follows may need digits back
    assert one(spark, "éloadstring(", F.rlike(F.col("x"), F.lit(dialect.to_java(r"\bloadstring\s*\("))))
    assert one(spark, ",".join(["97"] * 20000), F.rlike(F.col("x"), F.lit(LIST)))
    assert dialect.guard(r"http\.Fetch\s*\([^)]*function[^)]*RunString") == "http.Fetch"
    assert dialect.guard("(_G|_R)x") is None and dialect.guard("abcd|efgh") is None and dialect.guard("abcde*") == "abcd"
    assert dialect.risky("(ab|c)+") and not any(dialect.risky(r.pattern) for r in RULES.rules)
    assert dialect.compiles(spark, "a+") and not dialect.compiles(spark, "a(")
    with pytest.raises(ValueError):
        dialect.to_java("[abc")


def test_every_guard_is_in_every_witness():
    for t, line, ids in WITNESSES:
        for r in RULES.of("." + t):
            if r.rule_id in ids and r.guard:
                assert r.guard in line


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet='RunStringCompile(_G[k] =functiodebug.0123456789,x"\\\t é', max_size=60), min_size=1, max_size=15))
def test_matching_equals_a_plain_model(spark, lines):
    from siftline.operators.match import match_lines

    df = spark.createDataFrame([(k, ".lua", x) for k, x in enumerate(lines)], "k int, ext string, line string")
    got = {(r.k, r.rule_id) for r in match_lines(df, RULES).select("k", "rule_id").collect()}
    assert got == {(k, r.rule_id) for k, x in enumerate(lines) for r in RULES.of(".lua") if re.search(r.pattern, x, re.A)}


def test_djb2_over_blocks(monkeypatch):
    from siftline.functions import hashing

    data = bytes(range(256)) * 9
    want = 5381
    for b in data:
        want = (want * 33 + b) % (1 << 64)
    hashing._powers.cache_clear()
    monkeypatch.setattr(hashing, "BLOCK", 100)
    assert hashing.djb2_bytes(data, 64) == f"{want:016x}" and hashing.djb2_bytes(data) == f"{want % (1 << 32):016x}" and hashing.djb2_bytes(b"") == f"{5381:016x}"
    hashing._powers.cache_clear()
