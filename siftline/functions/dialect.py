"""Rule patterns (ECMAScript over bytes) rewritten for Java, and the literals that guard them."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Literals shorter than this are no guard: they occur everywhere.
GUARD_CHARS = 4
_WORD = "A-Za-z0-9_"
_POSIX = {"alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "space": r"\s", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "punct": r"\p{Punct}", "xdigit": r"\p{XDigit}", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "print": r"\p{Print}", "graph": r"\p{Graph}"}
#: A bounded class after a separator that the class excludes, repeated: Java recurses for each turn of such a group.
_LIST = re.compile(r"\((?:\?:)?([^\\\[\](){}.*+?^$|])(\[[^\]]+\])\{(\d+),(\d*)\}\)(\{\d+,\d*\}|\*|\+)")


@dataclass(frozen=True)
class Atom:
    """A piece of a pattern: kind is literal, class, escape, any, open, close, or, anchor; with its quantifier."""

    kind: str
    text: str
    times: str = ""


def atoms(pattern: str) -> list[Atom]:
    """Cut a pattern into atoms. Raises ValueError where brackets don't close."""
    out: list[Atom] = []
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            n = 4 if pattern[i + 1 : i + 2] == "x" else 6 if pattern[i + 1 : i + 2] == "u" else 2
            kind, text = "escape", pattern[i : i + n]
            if len(text) < 2:
                raise ValueError("pattern ends in a backslash")
        elif c == "[":
            j = i + 2 if pattern[i + 1 : i + 2] in ("]", "^") else i + 1
            while j < len(pattern) and pattern[j] != "]":
                j = pattern.find(":]", j) + 2 if pattern.startswith("[:", j) and pattern.find(":]", j) > 0 else j + 2 if pattern[j] == "\\" else j + 1
            if j >= len(pattern):
                raise ValueError("class without ]")
            kind, text = "class", pattern[i : j + 1]
        elif c == "(":
            m = re.match(r"\((?:\?[:=!])?", pattern[i:])
            kind, text = "open", m[0]
        else:
            kind, text = {")": "close", "|": "or", ".": "any", "^": "anchor", "$": "anchor"}.get(c, "literal"), c
        i += len(text)
        m = re.match(r"(?:[*+?]|\{\d+(?:,\d*)?\})\??", pattern[i:])
        times = m[0] if m and kind not in ("open", "or", "anchor") else ""
        i += len(times)
        out.append(Atom(kind, text, times))
    return out


def _word_like(a: Atom | None) -> bool | None:
    """Whether an atom is surely (True) or surely not (False) a word character."""
    if a is None or a.times[:1] in ("*", "?") or a.times.startswith("{0"):
        return None
    if a.kind == "literal":
        return bool(re.match(f"[{_WORD}]", a.text))
    if a.kind == "escape":
        return {"\\w": True, "\\d": True, "\\W": False, "\\s": False}.get(a.text, False if not a.text[1].isalnum() else None)
    return None


def _class(text: str) -> str:
    negated = text.startswith("[^")
    body = text[2 if negated else 1 : -1]
    body = re.sub(r"\[:(\w+):\]", lambda m: _POSIX.get(m[1], m[0]), body)
    body = re.sub(r"(\\.)|(\[)|(&&)", lambda m: ("\\x08" if m[1] == "\\b" else m[1]) if m[1] else "\\[" if m[2] else "&\\&", body)
    return f"[{'^' if negated else ''}{body}]"


def to_java(pattern: str) -> str:
    """The Java pattern that matches the same lines.

    ASCII word boundaries, '.' and '$' without Java's line terminators, literal
    '[' and '&&' in classes, POSIX classes; and lists such as (,[0-9]{2,3}){6,}
    possessive, as Java would recurse once for each element and overflow.
    """

    def possessive(m: re.Match) -> str:
        sep, cls, low, high, times = m.groups()
        if re.match(cls, sep) or m.end() < len(m.string):
            return m[0]
        return f"(?:{sep}{cls}{{{low},{high}}}+){times}+"

    pattern = _LIST.sub(possessive, pattern)
    found = atoms_java(pattern)
    out = []
    for k, a in enumerate(found):
        text = a.text
        if a.kind == "class":
            text = _class(text)
        elif a.kind == "any":
            text = r"[^\n\r]"
        elif a.kind == "anchor" and text == "$":
            text = r"\z"
        elif a.kind == "escape" and text in (r"\b", r"\B"):
            after, before = _word_like(found[k + 1] if k + 1 < len(found) else None), _word_like(found[k - 1] if k else None)
            if text == r"\b" and after:
                text = f"(?<![{_WORD}])"
            elif text == r"\b" and before:
                text = f"(?![{_WORD}])"
            else:
                yes, no = (f"(?<![{_WORD}])(?=[{_WORD}])", f"(?<=[{_WORD}])(?![{_WORD}])") if text == r"\b" else (f"(?<![{_WORD}])(?![{_WORD}])", f"(?<=[{_WORD}])(?=[{_WORD}])")
                text = f"(?:{yes}|{no})"
        out.append(text + a.times)
    return "".join(out)


def atoms_java(pattern: str) -> list[Atom]:
    """atoms(), also of possessive quantifiers."""
    out: list[Atom] = []
    for a in atoms(pattern):
        if a.kind == "literal" and a.text == "+" and out and out[-1].times:
            out[-1] = Atom(out[-1].kind, out[-1].text, out[-1].times + "+")
        else:
            out.append(a)
    return out


def guard(pattern: str, least: int = GUARD_CHARS) -> str | None:
    """The longest literal that every match contains, if it has `least` characters."""
    runs, run, depth = [], "", 0
    for a in atoms(pattern):
        plain = a.text if a.kind == "literal" else a.text[1] if a.kind == "escape" and not a.text[1].isalnum() else None
        optional = a.times[:1] in ("*", "?") or a.times.startswith("{0")
        if a.kind == "or" and depth == 0:
            return None
        if a.kind in ("open", "close"):
            depth += 1 if a.kind == "open" else -1
        if plain is not None and not depth and not optional:
            run += plain
            if not a.times:
                continue
        elif a.kind == "anchor" or (a.kind == "escape" and a.text in (r"\b", r"\B")):
            if not run:
                continue
        runs.append(run)
        run = ""
    best = max([*runs, run], key=len)
    return best if len(best) >= least else None


def line_bound(pattern: str) -> bool:
    """Whether a match in a line need not be one in the whole text: the pattern has anchors or looks around."""
    return any(a.kind == "anchor" or (a.kind == "open" and a.text in ("(?=", "(?!")) for a in atoms(pattern))


def risky(pattern: str) -> bool:
    """Whether Java may recurse for each turn of a repeated group: a long match could exhaust the stack."""
    found = atoms_java(_LIST.sub("x", pattern))
    return any(a.kind == "close" and a.times and a.times[:1] != "?" and not a.times.endswith("+" * 2) for a in found)


def compiles(spark, java: str) -> bool:
    """Whether the JVM compiles a pattern: a bad user rule is dropped, it must not fail the job."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    try:
        spark._jvm.java.util.regex.Pattern.compile(java)
    except (Py4JJavaError, PySparkException):
        return False
    return True
