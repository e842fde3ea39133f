"""What obfuscated lines hide: Base64 payloads and character codes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAYLOAD = r"[A-Za-z0-9+/]{40,}={0,2}"


def base64_bytes(text: Column) -> Column:
    """Decode up to the first '=' or foreign character; a lone last character is dropped."""
    s = F.regexp_extract(text, r"^[A-Za-z0-9+/]*", 0)
    even = F.substring(s, F.lit(1), F.length(s) - F.when(F.length(s) % 4 == 1, 1).otherwise(0))
    return F.unbase64(even)


def printable(data: Column) -> Column:
    """Whether the first 50 bytes are printable ASCII, tabs or line ends."""
    return F.rlike(F.hex(F.substring(data, 1, 50)), F.lit("^(?:0[9AD]|[2-7][0-9A-F])+$"))


def base64_payload(line: Column) -> Column:
    """The text of a line's first long Base64 run; empty if there is none or it is not text."""
    data = base64_bytes(F.regexp_extract(line, PAYLOAD, 0))
    return F.when(F.coalesce(printable(data) & (F.length(data) > 5), F.lit(False)), F.make_valid_utf8(data.cast("string"))).otherwise(F.lit(""))


#: A pattern that begins with a decimal number whose length varies: it is the first group of the capturing form.
_LEADING = re.compile(r"^\[0-9\]\{\d+,\d+\}")


def char_codes(line: Column, java: str) -> Column:
    """For each match of the rule's pattern its leading integer as a character, if it is at most 255.

    Patterns that begin with digits take the built-in path; matches that begin
    with '0x' give a NUL each; those that begin with a letter give nothing; any
    other pattern runs in an Arrow UDF.
    """
    if m := _LEADING.match(java):
        found = F.regexp_extract_all(line, F.lit(f"({m[0]}){java[m.end():]}"), F.lit(1))
        numbers = F.filter(F.transform(found, lambda x: x.cast("int")), lambda v: v <= 255)
        return F.array_join(F.transform(numbers, lambda v: F.chr(v)), "")
    if java.startswith("0[xX]"):
        return F.repeat(F.chr(F.lit(0)), F.size(F.regexp_extract_all(line, F.lit(java), F.lit(0))))
    if re.match(r"[A-Za-z_]", java):
        return F.lit("")
    return _any_codes(F.regexp_extract_all(line, F.lit(java), F.lit(0)))


def leading_codes(matches: list[str]) -> str:
    """Characters of the leading integers of matches; the first match without one, or over an int, ends it."""
    out = ""
    for text in matches:
        m = re.match(r"[ \t\n\v\f\r]*([+-]?[0-9]+)", text)
        if not m or not -(1 << 31) <= int(m[1]) < 1 << 31:
            break
        if 0 <= int(m[1]) <= 255:
            out += chr(int(m[1]))
    return out


@F.pandas_udf(T.StringType())
def _any_codes(found: pd.Series) -> pd.Series:
    return found.map(lambda x: None if x is None else leading_codes(list(x)))


def full_char_codes(line: Column) -> Column:
    """All numbers of every list of seven or more, as characters (an extension: the rules show the first alone)."""
    runs = F.regexp_extract_all(line, F.lit(r"[0-9]{2,3}(?:,[0-9]{2,3}+){6,}+"), F.lit(0))
    numbers = F.filter(F.transform(F.flatten(F.transform(runs, lambda r: F.split(r, ","))), lambda x: x.cast("int")), lambda v: v <= 255)
    return F.array_join(F.transform(numbers, lambda v: F.chr(v)), "")
