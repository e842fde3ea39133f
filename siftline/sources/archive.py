"""GMAD add-on archives: a bounded, single-pass reader.

Layout, little-endian: "GMAD", u8 version, u64 steam id, u64 timestamp, strings
until an empty one, name, description, author (all NUL-terminated), i32 addon
version, entries (u32 not 0, name, i64 size, u32 crc) until a u32 0, then the
contents end to end. Whatever is cut short or impossible gives valid = false;
nothing is read past the end. CRCs are not checked; versions over 3 are read too.
"""

from __future__ import annotations

import logging
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ARCHIVE, SCANNABLE

log = logging.getLogger(__name__)
#: A NUL-terminated string longer than this is taken for damage.
LONGEST = 1 << 20


class Damaged(ValueError):
    """The archive's directory can't be read."""


@dataclass
class Entry:
    filename: str
    size: int
    offset: int
    crc: int


@dataclass
class Archive:
    valid: bool = False
    name: str = ""
    description: str = ""
    author: str = ""
    steam_id: int = 0
    timestamp: int = 0
    version: int = 0
    entries: list[Entry] = field(default_factory=list)
    #: Where the first content begins.
    start: int = 0
    error: str | None = None


def _exactly(f: BinaryIO, n: int) -> bytes:
    data = f.read(n)
    if len(data) < n:
        raise Damaged("the archive ends early")
    return data


def _string(f: BinaryIO) -> str:
    out = bytearray()
    while True:
        at = f.tell()
        piece = f.read(256)
        if not piece:
            raise Damaged("the archive ends inside a string")
        k = piece.find(b"\0")
        if k >= 0:
            out += piece[:k]
            f.seek(at + k + 1)
            return out.decode("utf-8", "replace")
        out += piece
        if len(out) > LONGEST:
            raise Damaged("a string has no end")


def read_directory(f: BinaryIO) -> Archive:
    """The header and entries of an archive; never raises for its content."""
    a = Archive()
    try:
        if f.read(4) != b"GMAD":
            raise Damaged("not an archive of this kind")
        version = _exactly(f, 1)[0]
        if version > 3:
            log.warning("archive format version %d", version)
        a.steam_id, a.timestamp = struct.unpack("<QQ", _exactly(f, 16))
        while _string(f):  # required contents, in every version
            pass
        a.name, a.description, a.author = _string(f), _string(f), _string(f)
        a.version = struct.unpack("<i", _exactly(f, 4))[0]
        offset = 0
        while struct.unpack("<I", _exactly(f, 4))[0]:
            name = _string(f)
            size, crc = struct.unpack("<qI", _exactly(f, 12))
            if size < 0:
                raise Damaged("an entry has a negative size")
            a.entries.append(Entry(name, size, offset, crc))
            offset += size
        a.start = f.tell()
        a.valid = True
    except Damaged as e:
        a.error = str(e)
    return a


def member_suffix(name: str) -> str:
    """From the last dot of the whole name, in lower case."""
    k = name.rfind(".")
    return "" if k < 0 else name[k:].lower()


def members(f: BinaryIO, a: Archive, length: int) -> Iterator[tuple[Entry, bytes]]:
    """Scannable members with content; a content cut short is filled with NULs, but to no more than twice what the archive holds."""
    for e in a.entries:
        if member_suffix(e.filename) not in SCANNABLE or not e.size:
            continue
        at = a.start + e.offset
        there = max(0, min(e.size, length - at))
        f.seek(at)
        data = f.read(there) if there else b""
        if e.size - there > length:
            log.warning("member %s claims more than its archive holds", e.filename)
            yield e, data
        else:
            yield e, data.ljust(e.size, b"\0")


DIRECTORY = "path string, valid boolean, name string, description string, author string, steam_id decimal(20,0), timestamp bigint, version int, entries array<struct<filename:string,size:bigint,offset:bigint,crc:bigint>>, content_start bigint, error string"


def archive_directory(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """One row per archive with its header and entries, from a relation of whole archives."""
    import decimal
    import io

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a = read_directory(io.BytesIO(data or b""))
                stamp = a.timestamp if a.timestamp < 1 << 63 else None
                rows.append((p, a.valid, a.name, a.description, a.author, decimal.Decimal(a.steam_id), stamp, a.version, [{"filename": e.filename, "size": e.size, "offset": e.offset, "crc": e.crc} for e in a.entries], a.start, a.error))
            entry = pa.struct([("filename", pa.string()), ("size", pa.int64()), ("offset", pa.int64()), ("crc", pa.int64())])
            kinds = [pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.decimal128(20, 0), pa.int64(), pa.int32(), pa.list_(entry), pa.int64(), pa.string()]
            names = [x.split()[0] for x in DIRECTORY.replace("array<struct<filename:string,size:bigint,offset:bigint,crc:bigint>>", "a").split(", ")]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return files.select(F.col(path), F.col(content)).mapInArrow(run, DIRECTORY)


MEMBERS = "file string, ext string, content binary, archive string, error string"
#: Bytes of members that one batch holds, about.
BATCH_BYTES = 16 << 20


def archive_members(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(file, ext, content, archive, error) of the scannable members, in one pass over the archives.

    Nothing is joined or shuffled, and a member costs no more than its archive
    holds, whatever it claims. An archive whose directory can't be read gives one
    row with an error and no content; the others are not touched by that.
    """
    import io

    schema = pa.schema([("file", pa.string()), ("ext", pa.string()), ("content", pa.binary()), ("archive", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows.clear()
            return made

        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                whole = data.as_py() or b""
                f = io.BytesIO(whole)
                a = read_directory(f)
                plain = None if name is None else name.replace("\\", "/")
                size = 0
                if not a.valid:
                    rows.append((plain, ARCHIVE, None, name, a.error))
                for e, part in members(f, a, len(whole)) if a.valid else ():
                    rows.append((f"{plain}/{e.filename}", member_suffix(e.filename), part, name, None))
                    size += len(part)
                    if size > BATCH_BYTES:
                        yield out()
                        size = 0
                if rows:
                    yield out()

    return files.select(F.col(path), F.col(content)).mapInArrow(run, MEMBERS)
