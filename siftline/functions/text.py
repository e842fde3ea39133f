"""Columns of paths, lines and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File types that rules exist for.
SCANNABLE = (".lua", ".vmt", ".vtf", ".ttf")
ARCHIVE = ".gma"


def normal_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def file_extension(path: Column) -> Column:
    """Lower-case extension of a path's last part; none if its only dot leads."""
    return F.lower(F.regexp_extract(F.regexp_extract(path, r"([^/]*)$", 1), r"^.+(\.[^.]*)$", 1))


def member_extension(name: Column) -> Column:
    """Lower-case suffix of an archive member: from the last dot of the whole name."""
    return F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))


def type_label(ext: Column) -> Column:
    return F.upper(F.substring(ext, 2, 1 << 30))


def lines(content: Column) -> Column:
    """The lines of a text: split at line feeds, without an empty one after the last; carriage returns stay."""
    parts = F.split(content, "\n", -1)
    return F.when((content == "") | F.endswith(content, F.lit("\n")), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def collapse_space(text: Column) -> Column:
    """Each run of white space becomes its first character; ends are not trimmed."""
    return F.regexp_replace(text, r"(\s)\s+", "$1")


def escape_tabs(text: Column) -> Column:
    return F.replace(text, F.lit("\t"), F.lit("\\t"))


def detection_key(file: Column, line_number: Column, detection: Column) -> Column:
    return F.concat_ws(":", file, line_number.cast("string"), detection)


def as_text(content: Column) -> Column:
    """Bytes as text; invalid UTF-8 becomes replacement characters, never an error."""
    return F.make_valid_utf8(content.cast("string"))


def unix_lines(content: Column) -> Column:
    return F.replace(content, F.lit("\r\n"), F.lit("\n"))
