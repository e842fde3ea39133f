"""Language identification with hyperdimensional profiles.

Every letter owns a pseudo-random +1/-1 vector. An n-gram is the product
(binding) of its letters' vectors, each rotated (permuted) by its place; a text
is the sum (bundle) of its n-grams; a language prototype is the bundle of its
training texts. A text gets the language whose prototype has the largest cosine.

The vectors come from a hash of the code point, so workers need no codebook and
every run gives the same integers. Training emits one bundle per language and
partition, and Spark sums them: shuffle and driver see languages x DIM numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_of, lean, mix64, runs, table, without

DIM, ORDER = 1024, 3
#: Prototypes go to the driver and to every worker, 8 KB each; more of them than this is an error, not a silent cut.
MAX_LANGUAGES = 2000
#: Letters handled at once; bounds the count matrix, not the text.
CHUNK_CHARS, CHUNK_CELLS = 300_000, 2_000_000
UND = "und"

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def letter_vectors(points: np.ndarray, dim: int = DIM) -> np.ndarray:
    """One row of +1/-1 for each code point."""
    with np.errstate(over="ignore"):
        bits = mix64(np.asarray(points, np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(dim, dtype=np.uint64)[None])
    return ((bits >> np.uint64(63)).astype(np.int8) * 2 - 1).astype(np.int8)


def _grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, n-gram number, letters of each n-gram number) of texts; runs of non-letters are one space."""
    parts = [f" {t.lower()} " if t else " " for t in texts]
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    points = np.where(_is_letter()[points], points, 32)
    blank = points == 32
    keep = np.ones(len(points), bool)
    keep[1:] = ~(blank[1:] & blank[:-1] & (doc[1:] == doc[:-1]))
    points, doc = points[keep], doc[keep]
    same = doc[: len(doc) - ORDER + 1] == doc[ORDER - 1 :]
    seen = np.zeros(0x110000, bool)
    seen[points] = True
    alphabet = np.flatnonzero(seen)
    place = np.cumsum(seen, dtype=np.int64) - 1
    code, a = place[points], len(alphabet)
    n = len(code) - ORDER + 1
    ids = np.zeros(max(n, 0), np.int64)
    for k in range(ORDER):
        ids = ids * a + code[k : k + len(ids)]
    ids, doc = ids[same[: len(ids)]], doc[: len(ids)][same[: len(ids)]]
    if a**ORDER <= 8_000_000:
        there = np.zeros(a**ORDER, bool)
        there[ids] = True
        uniq, inv = np.flatnonzero(there), (np.cumsum(there) - 1)[ids]
    else:
        uniq, inv = np.unique(ids, return_inverse=True)
    letters = np.stack([alphabet[(uniq // a ** (ORDER - 1 - k)) % a] for k in range(ORDER)], 1)
    return doc, inv, letters


def gram_vectors(letters: np.ndarray, dim: int = DIM) -> np.ndarray:
    """Bind the rotated letter vectors of each n-gram."""
    alphabet, inv = np.unique(letters, return_inverse=True)
    inv, base, out = inv.reshape(letters.shape), letter_vectors(alphabet, dim), None
    for k in range(letters.shape[1]):
        v = np.roll(base, letters.shape[1] - 1 - k, axis=1)[inv[:, k]]
        out = v if out is None else out * v
    return out


def bundles(texts: list[str | None], dim: int = DIM) -> np.ndarray:
    """The bundle of each text, float64; zero for texts without letters."""
    out = np.zeros((len(texts), dim))
    for a, b in runs([len(t or "") for t in texts], CHUNK_CHARS):
        doc, inv, letters = _grams(texts[a:b])
        if not len(letters):
            continue
        vectors, u = gram_vectors(letters, dim).astype(np.float32), len(letters)
        step = max(1, CHUNK_CELLS // u)
        for lo in range(0, b - a, step):
            hi = min(b - a, lo + step)
            i, j = np.searchsorted(doc, (lo, hi))
            counts = np.bincount((doc[i:j] - lo) * u + inv[i:j], minlength=(hi - lo) * u).reshape(hi - lo, u)
            exact = np.float32 if j - i < 1 << 24 else np.float64  # sums stay whole numbers
            out[a + lo : a + hi] = counts.astype(exact) @ vectors.astype(exact, copy=False)
    return out


@dataclass(frozen=True)
class Profiles:
    """Language prototypes: names, and unit rows."""

    langs: list[str]
    rows: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        got = bundles(texts, self.rows.shape[1])
        norm = np.sqrt((got**2).sum(1))
        if not self.langs:
            return [UND] * len(texts), np.zeros(len(texts))
        cos = got @ self.rows.T / np.where(norm, norm, 1)[:, None]
        best = cos.argmax(1)
        none = norm == 0
        return [UND if z else self.langs[k] for z, k in zip(none, best, strict=True)], np.where(none, 0.0, np.clip(cos[np.arange(len(texts)), best], 0, 1))


def learn(df: DataFrame, text: str = "text", lang: str = "lang", dim: int = DIM, most: int = MAX_LANGUAGES) -> Profiles:
    """Prototypes of all rows with text and a language. Rows with null or letterless text add nothing.

    Over `most` distinct languages raise a ValueError: such a column holds
    something else. An empty table gives no prototype.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in runs([len(t) for t in texts], CHUNK_CHARS):
                doc, inv, letters = _grams(texts[a:b])
                if not len(letters):
                    continue
                names = sorted(set(langs[a:b]))
                row = np.array([names.index(x) for x in langs[a:b]])[doc]
                counts = np.bincount(row * len(letters) + inv, minlength=len(names) * len(letters)).reshape(len(names), -1)
                part = counts.astype(np.float64) @ gram_vectors(letters, dim).astype(np.float64)
                for name, v in zip(names, part, strict=True):
                    sums[name] = sums[name] + v if name in sums else v
        yield pa.RecordBatch.from_pydict({"lang": list(sums), "v": [v.astype(np.int64).tolist() for v in sums.values()]}, pa.schema([("lang", pa.string()), ("v", pa.list_(pa.int64()))]))

    rows = df.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    parts = rows.mapInArrow(lean(add), "lang string, v array<bigint>").select("lang", F.posexplode("v").alias("i", "x"))
    summed = parts.groupBy("lang", "i").agg(F.sum("x").alias("x"))
    per = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    found = sorted(((r.lang, [y.x for y in r.v]) for r in per.limit(most + 1).toLocalIterator()), key=lambda r: r[0])
    if len(found) > most:
        raise ValueError(f"over {most} languages: the language column holds something else")
    found = [(name, np.array(v, float)) for name, v in found]
    found = [(name, v) for name, v in found if v.any()]
    rows_ = np.array([v / np.sqrt((v**2).sum()) for _, v in found]).reshape(len(found), dim)
    return Profiles([name for name, _ in found], rows_)


def identify(df: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """Add lang_pred and score (the cosine, 0 to 1) to every row; columns of these names are replaced.

    Null, empty and letterless texts get 'und' and 0. Equal cosines go to the
    language that sorts first. Repeated rows stay; an empty table stays empty.
    """
    df = without(df, ("lang_pred", "score"))
    schema = df.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = profiles.predict(batch.column(batch.schema.names.index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return df.mapInArrow(lean(tell), schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the folds 0 and 2 of crc32(doc_id) mod 3."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(fold_of("doc_id", 3) == 1, F.lit(False))
    profiles = learn(docs.where(fold_of("doc_id", 3) != 1))
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), profiles).drop("text")
