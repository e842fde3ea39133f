"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders; windows of five template
tokens are hashed and joined with the windows of the benchmark's items. Where
windows meet, the fillers of their slots are compared: along an alignment of item
and document, which may shift where a filler has more tokens, equal fillers of
the item must stay equal in the document and different ones different. So a
question with other numbers and names is found, and text that only shares a frame
of placeholders is not.

A capitalised word that opens a sentence may be a name or not, so a window with
one is hashed both ways. A window with fewer than LITERALS literal tokens is found
by its own words and fillers. Its bare frame counts too, but only along an
alignment that some other window has already found. Coverage is of all windows.

A pair that reaches the coverage must share one of the rarest windows of its item,
as many as it may miss and one more; only these make candidates, so a window that
many items and documents share joins none by itself. Nothing is lost by that.

The scan is byte arithmetic in numpy: only windows that hit leave it. The hashes
of the benchmark go to the workers in slices of at most SLICE, one scan for each
slice, so what is broadcast has a bound whatever the size of the benchmark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, lean, mix64, runs, save, table

WINDOW, LITERALS, COVERAGE = 5, 3, 0.5
#: Hashes broadcast at once (8 bytes each).
SLICE = 4_000_000
CHUNK_CHARS = 300_000

# Units and number words that count as slots.
UNITS = "km m cm mm mi miles mile feet foot ft inches inch yards yard kg g mg t tons lb lbs pounds pound oz ounces l ml litres liters gallons hours hour h minutes minute min seconds second s days day weeks week months month years year dollars dollar cents cent euros euro eur usd percent degrees mph kmh km/h kw kwh w v a hz mb gb tb"
NUMBER_WORDS = "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million"

_ONE_NUM = r"(?:" + "|".join(NUMBER_WORDS.split()) + r")\b"
_NUM = re.compile(r"\d+(?:[.,:/]\d+)*|\b" + _ONE_NUM + r"(?:[ -]" + _ONE_NUM + ")*", re.I)
_DIGITS = re.compile(r"\d+(?:[.,:/]\d+)*")
_DIGIT = re.compile(r"\d")
_UNIT = re.compile(r"(?<=\x01)(\s*)(?:[%€$£°]|(?:" + "|".join(map(re.escape, UNITS.split())) + r")\b)", re.I)
_UP, _LOW = "A-ZÀ-ÖØ-ÞĀĂĄĆĈČĎĐĒĖĘĚĜĞĠĢĤĪĮİĴĶĹĻĽŁŃŅŇŌŐŒŔŘŚŜŞŠŢŤŪŮŰŲŴŶŸŹŻŽΑ-ΩА-Я", "a-zß-öø-ÿāăąćĉčďđēėęěĝğġģĥīįıĵķĺļľłńņňōőœŕřśŝşšţťūůűųŵŷźżžα-ωа-я"
#: Names of one word or more, or the word that opens a sentence.
_TITLE = re.compile(f"[{_UP}][{_LOW}]+(?![{_UP}{_LOW}])(?: [{_UP}][{_LOW}]+(?![{_UP}{_LOW}]))*+")
#: Stands before a word that opens a sentence and may be a name.
OPENS = "\x04"
#: Punctuation beyond ASCII.
_MARKS = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0xA0, 0xA9), (0xAB, 0xB1), (0xB4, 0xB4), (0xB6, 0xB8), (0xBB, 0xBB), (0xBF, 0xBF), (0x2000, 0x206F), (0x3000, 0x303F), (0xFF00, 0xFF0F))) + "]")

_WORD = np.zeros(256, bool)
_WORD[[1, 2, 3, *range(48, 58), *range(97, 123), *range(128, 256)]] = True
_BYTES = mix64(np.arange(256) + 77)
_PLACES = mix64(np.arange(64) + 900) | np.uint64(1)
_BASE = 0xA24BAED4963EE407
_powers: list[np.ndarray] = []
#: The hash of a name slot as a token.
_NAME = mix64(_BYTES[2:3])[0]


@lru_cache(1)
def _number_words():
    import ahocorasick

    found = ahocorasick.Automaton()
    for w in NUMBER_WORDS.split():
        found.add_word(w, len(w))
    found.make_automaton()
    return found


def _has_number_word(low: str) -> bool:
    """Whether a number word stands alone somewhere; one pass, whatever the number of words."""
    n = len(low)
    return any((e + 1 == n or not low[e + 1].isalnum()) and (e - k < 0 or not low[e - k].isalnum()) for e, k in _number_words().iter(low))


def template(text: str) -> tuple[str, list[str], list[str], list[str]]:
    """The template of a text, and the fillers of its number, name and unit slots in order.

    A name is a run of capitalised words that goes on with a sentence, so after a
    letter, figure, comma or semicolon and one space. Where such a run opens a
    sentence its first word stays, marked by OPENS.
    """
    nums: list[str] = []
    units: list[str] = []
    names: list[str] = []
    if not text.isascii():
        text = _MARKS.sub(" ", text)
    for mark in "\x01\x02\x03\x04":
        if mark in text:
            text = text.replace(mark, " ")
    at, parts = 0, []
    for m in _TITLE.finditer(text):
        s, e = m.span()
        if s and text[s - 1].isalnum() or e < len(text) and text[e].isalnum():
            continue
        if not (s > 1 and text[s - 1] == " " and (text[s - 2].isalnum() or text[s - 2] in ",;")):
            parts += (text[at:s], OPENS)
            at = s
            s = text.find(" ", s, e) + 1
            if not s:
                continue
        names.append(text[s:e].lower())
        parts += (text[at:s], " \x02 ")
        at = e
    if parts:
        text = "".join((*parts, text[at:]))
    numbers = _NUM if _has_number_word(text.lower()) else _DIGITS if _DIGIT.search(text) else None
    if numbers:
        nums = [x.lower() for x in numbers.findall(text)]
        text = numbers.sub(" \x01", text)
        units = [m[0].strip().lower() for m in _UNIT.finditer(text)]
        text = _UNIT.sub(" \x03 ", text).replace("\x01", "\x01 ")
    return text.lower(), nums, names, units


@lru_cache(100_000)
def _filler(kind: int, word: str) -> int:
    return int.from_bytes(blake2b(bytes([kind]) + word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def windows(templates: list[str], sizes: list[int], fillers: tuple[list[str], ...] | None = None, weak: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each window size: hashes, texts, token positions, and whether words that open sentences are taken as names.

    A window's hash depends on its words only, not on what stands between them.
    Windows with too few literal tokens take the hash of their words and fillers
    (number, name and unit slots of all templates in order), or are left out
    without these; with `weak`, they alone come, by their frames. A window with a
    word that opens a sentence comes a second time with that as a name slot, if
    enough literal tokens remain.
    """
    b = np.frombuffer("\n".join(templates).encode("utf-8", "surrogatepass"), np.uint8)
    word = _WORD[b]
    start = np.flatnonzero(word & np.r_[True, ~word[:-1]]) if len(b) else np.zeros(0, int)
    end = np.flatnonzero(word & np.r_[~word[1:], True]) + 1 if len(b) else np.zeros(0, int)
    doc = np.searchsorted(np.cumsum([len(t.encode("utf-8", "surrogatepass")) + 1 for t in templates]), start, "right")
    n = len(b) + 1
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(n - 1, x, np.uint64)], dtype=np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
    prefix = np.r_[np.uint64(0), np.cumsum(_BYTES[b] * _powers[0][: len(b)], dtype=np.uint64)]
    h = mix64((prefix[end] - prefix[start]) * _powers[1][start])
    slot = (b[start] < 4).astype(np.int64) if len(start) else np.zeros(0, np.int64)
    slots, first = np.r_[0, np.cumsum(slot)], np.r_[0, np.cumsum(np.bincount(doc, minlength=len(templates)))]
    opens = (b[np.maximum(start - 1, 0)] == ord(OPENS)) & (start > 0) if len(start) else np.zeros(0, bool)
    opened = np.r_[0, np.cumsum(opens)]
    named = np.where(opens, _NAME, h)
    filled = None
    for size in sizes:
        m = max(0, len(h) - size + 1)
        total = np.zeros(m, np.uint64)
        for k in range(size):
            total += h[k : k + m] * _PLACES[k]
        ok = doc[:m] == doc[size - 1 : size - 1 + m] if m else np.zeros(0, bool)
        literal = size - (slots[size : size + m] - slots[:m]) >= min(LITERALS, size)
        keep = np.flatnonzero(ok & (literal ^ weak))
        out = mix64(total[keep] + np.uint64(size + (1 << 21) * weak))
        few = np.flatnonzero(ok & ~literal) if fillers is not None and not weak else keep[:0]
        if len(few):
            if filled is None:
                filled = h.copy()
                for kind, words in enumerate(fillers, 1):
                    filled[b[start] == kind] = np.array([_filler(kind, x) for x in words], np.uint64)
            exact = np.zeros(len(few), np.uint64)
            for k in range(size):
                exact += filled[few + k] * _PLACES[k]
            keep, out = np.r_[keep, few], np.r_[out, mix64(exact + np.uint64(size + (1 << 20)))]
        also = np.zeros(len(keep), bool)
        if not weak and opened[-1]:
            more = opened[size : size + m] - opened[:m]
            twice = np.flatnonzero(ok & (more > 0) & (size - (slots[size : size + m] - slots[:m]) - more >= min(LITERALS, size)))
            total = np.zeros(len(twice), np.uint64)
            for k in range(size):
                total += named[twice + k] * _PLACES[k]
            keep, out, also = np.r_[keep, twice], np.r_[out, mix64(total + np.uint64(size))], np.r_[also, np.ones(len(twice), bool)]
        yield size, out.view(np.int64), doc[keep], keep - first[doc[keep]], also


_HIT = pa.schema([("key", pa.binary()), ("hash", pa.int64()), ("pos", pa.int32()), ("slots", pa.list_(pa.string())), ("opens", pa.bool_()), ("length", pa.int32())])
_TOKEN = re.compile("\x04?(?:[\x01\x02\x03]|[0-9a-z\u0080-\U0010ffff]+)")


def _slots(text: str, positions: list[tuple[int, int, bool]]) -> list[list[str]]:
    """The typed slot fillers of windows (position, size, sentence-opening words as names) of a text."""
    t, nums, names, units = template(text)
    fill = {"\x01": iter(nums), "\x02": iter(names), "\x03": iter(units)}
    tokens = _TOKEN.findall(t)
    filled = [x.replace("\x01", "n:").replace("\x02", "p:").replace("\x03", "u:") + next(fill[x]) if x in fill else "o:" + x[1:] if x[0] == OPENS else None for x in tokens]
    return [[x.replace("o:", "p:", 1) for x in filled[p : p + size] if x is not None and (also or x[:2] != "o:")] for p, size, also in positions]


def _emit(keys: list, texts: list[str], sizes: list[int], wanted: np.ndarray | None, exact: bool = True, weak: bool = False) -> Iterator[pa.RecordBatch]:
    for a, b in runs([len(t) for t in texts], CHUNK_CHARS):
        made = [template(t) for t in texts[a:b]]
        templates = [t[0].replace("\n", " ") for t in made]
        fillers = tuple([x for t in made for x in t[kind]] for kind in (1, 2, 3)) if exact else None
        hits: dict[int, list[tuple[int, int, int, bool]]] = {}
        counts = [0] * (b - a)
        for size, h, doc, pos, also in windows(templates, sizes, fillers, weak):
            if size == WINDOW or len(sizes) == 1:
                counts = np.bincount(doc[~also], minlength=b - a).tolist()
            if wanted is not None:
                at = np.minimum(np.searchsorted(wanted, h), max(0, len(wanted) - 1))
                good = np.flatnonzero(wanted[at] == h) if len(wanted) else np.zeros(0, int)
                h, doc, pos, also = h[good], doc[good], pos[good], also[good]
            for x, d, p, o in zip(h.tolist(), doc.tolist(), pos.tolist(), also.tolist(), strict=True):
                hits.setdefault(d, []).append((x, p, size, o))
        rows = [(keys[a + d], x, p, s, o, counts[d]) for d, found in hits.items() for (x, p, _, o), s in zip(found, _slots(texts[a + d], [f[1:] for f in found]), strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _HIT, strict=True)], schema=_HIT)


def _tokens_of(text: str) -> int:
    return len(_TOKEN.findall(template(text)[0]))


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, hash, wpos, item_slots, opens, size, n_windows, weak) of the benchmark; an item under WINDOW tokens is one window.

    A window with too few literal tokens comes twice: by its fillers, and as a frame (weak).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = _tokens_of(t)
                size = min(WINDOW, tokens)
                if size < LITERALS:
                    continue
                for weak, out in ((weak, out) for weak in (False, True) for out in _emit([b""], [t], [size], None, weak=weak)):
                    n = out.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array([item] * n, pa.int64()), out.column(1), out.column(2), out.column(3), out.column(4), pa.array([size] * n, pa.int32()), pa.array([tokens - size + 1] * n, pa.int32()), pa.array([weak] * n)], ["item_id", "hash", "wpos", "item_slots", "opens", "size", "n_windows", "weak"])

    rows = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text).alias("text")).where("text is not null and item_id is not null").distinct()
    return rows.mapInArrow(lean(run), "item_id bigint, hash bigint, wpos int, item_slots array<string>, opens boolean, size int, n_windows int, weak boolean")


def matches(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """(key, item_id, n_matched, n_windows, coverage, exact_slots) by the md5 of the texts that hold an item."""
    spark = docs.sparkSession
    bench = save(item_windows(items, item_id, item_text), "bench")
    shape = {r.weak: r for r in bench.groupBy("weak").agg(F.approx_count_distinct("hash").alias("n"), F.collect_set("size").alias("sizes")).collect()}
    texts = docs.select(F.col(text).alias("t")).where("t is not null").select(F.unhex(F.md5("t")).alias("key"), "t")

    def scanned(texts: DataFrame, weak: bool) -> DataFrame:
        kind = "key binary, hash bigint, pos int, slots array<string>"
        hits = spark.createDataFrame([], kind)
        sizes, slices = (sorted(shape[weak].sizes), max(1, -(-int(shape[weak].n * 1.1) // SLICE))) if weak in shape else ([], 0)
        exact = True in shape and not weak
        for k in range(slices):
            part = bench.where(F.col("weak") == weak).where(F.pmod(F.col("hash"), F.lit(slices)) == k).select("hash").distinct()
            wanted = spark.sparkContext.broadcast(np.sort(np.fromiter((r.hash for r in part.toLocalIterator()), np.int64)))

            def run(batches: Iterator[pa.RecordBatch], wanted=wanted) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    yield from _emit(batch.column(0).to_pylist(), batch.column(1).to_pylist(), sizes, wanted.value, exact, weak)

            hits = hits.union(texts.mapInArrow(lean(run), kind + ", opens boolean, length int").drop("opens", "length"))
        return save(hits.distinct(), "hits")

    hits, firm = scanned(texts, False), bench.where("not weak")
    met = candidates(hits, bench, coverage).join(firm, "item_id").join(hits, ["key", "hash"]).withColumn("diag", F.col("pos") - F.col("wpos"))
    literal = F.col("size") - F.size("item_slots") >= F.least(F.lit(LITERALS), F.col("size"))
    met = met.select("key", "item_id", "diag", "wpos", "n_windows", "item_slots", "slots", F.when(F.col("opens"), 1).when(literal, 0).otherwise(2).alias("kind"))
    if True in shape:
        # Frames count only where an alignment is found, so a frame of figures alone finds nothing and joins with nothing.
        met = save(met, "met")
        frames = bench.where("weak").select("item_id", "hash", "wpos", "item_slots", "n_windows", F.lit(3).alias("kind"))
        due = met.select("key", "item_id", "diag").distinct().join(frames, "item_id").withColumn("pos", F.col("diag") + F.col("wpos"))
        found = scanned(texts.join(due.select("key").distinct(), "key", "left_semi"), True)
        met = met.union(due.join(found, ["key", "hash", "pos"]).select(*met.columns))
    # Windows of a later kind add to what those before cover; where their slots disagree, the others still stand.
    met = met.withColumn("kind", F.explode(F.sequence("kind", F.lit(3))))
    fills = F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d"))
    aligned = met.groupBy("key", "item_id", "diag", "kind").agg(
        F.collect_set("wpos").alias("wpos"), F.first("n_windows").alias("n_windows"), F.array_distinct(F.flatten(F.collect_set(fills))).alias("fills")
    )
    whole = aligned.groupBy("key", "item_id", "kind").agg(F.first("n_windows").alias("n_windows"), F.collect_list(F.struct("diag", "wpos", "fills")).alias("diags"))
    pairs = whole.mapInArrow(lean(_consistent), "key binary, item_id bigint, n_windows int, n_matched bigint, exact_slots boolean")
    best = F.max(F.struct("n_matched", "exact_slots")).alias("best")
    pairs = pairs.groupBy("key", "item_id").agg(F.first("n_windows").alias("n_windows"), best).select("key", "item_id", "best.n_matched", "n_windows", "best.exact_slots")
    return save(pairs.withColumn("coverage", F.col("n_matched") / F.col("n_windows")).where(F.col("coverage") >= coverage), "pairs")


def candidates(hits: DataFrame, bench: DataFrame, coverage: float) -> DataFrame:
    """(key, item_id) of texts and items that share one of the item's rarest windows; all that can reach the coverage are among them.

    Some places of an item can also be covered by a frame. Of the w others a pair
    needs at least m = coverage * n - (n - w), so it cannot miss all of any w - m + 1
    places; where m < 1, any window that is no frame will do.
    """
    firm, weak = bench.where("not weak"), bench.where("weak").select("item_id", "wpos").distinct().withColumn("framed", F.lit(True))
    items = firm.groupBy("hash").agg(F.count_distinct("item_id").alias("items"))
    seen = hits.groupBy("hash").agg(F.count(F.lit(1)).alias("hits"))
    cost = firm.join(items, "hash").join(seen, "hash", "left").withColumn("cost", F.col("items") * F.coalesce("hits", F.lit(0)))
    places = cost.groupBy("item_id", "wpos").agg(F.sum("cost").alias("cost"), F.first("n_windows").alias("n")).join(weak, ["item_id", "wpos"], "left")
    places = places.withColumn("framed", F.coalesce("framed", F.lit(False)))
    of = Window.partitionBy("item_id")
    ranked = places.withColumns({"w": F.sum(F.when(F.col("framed"), 0).otherwise(1)).over(of), "rank": F.row_number().over(of.orderBy("framed", "cost", "wpos"))})
    least = F.ceil(F.col("n") * coverage - 1e-9) - (F.col("n") - F.col("w"))
    anchors = ranked.where((least < 1) | (~F.col("framed") & (F.col("rank") <= F.col("w") - least + 1))).select("item_id", "wpos")
    return firm.join(anchors, ["item_id", "wpos"]).select("hash", "item_id").distinct().join(hits.select("hash", "key").distinct(), "hash").select("key", "item_id").distinct()


def _consistent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many windows of the item one alignment with one-to-one slots covers.

    It starts with the diagonal that covers most and takes up every other one
    whose fillers agree with those taken, so it may shift.
    """
    for batch in batches:
        n, same = [], []
        for diags in batch.column(batch.schema.names.index("diags")).to_pylist():
            there: dict[str, str] = {}
            back: dict[str, str] = {}
            covered: set[int] = set()
            for x in sorted(diags, key=lambda x: (-len(x["wpos"]), x["diag"])):
                new = {f["i"]: f["d"] for f in x["fills"]}
                old = {f["d"]: f["i"] for f in x["fills"]}
                if len(new) == len(old) == len(x["fills"]) and all(there.get(i, d) == d and back.get(d, i) == i for i, d in new.items()):
                    there |= new
                    back |= old
                    covered.update(x["wpos"])
            n.append(len(covered))
            same.append(all(i == d for i, d in there.items()))
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)) for c in ("key", "item_id", "n_windows")), pa.array(n, pa.int64()), pa.array(same, pa.bool_())], ["key", "item_id", "n_windows", "n_matched", "exact_slots"])


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(doc_id, item_id, n_matched, n_windows, coverage, exact_slots) of documents that hold a benchmark item.

    A pair is reported if the windows of one alignment with consistent slots cover
    at least `coverage` of the item's windows; exact_slots tells whether all their
    fillers are the item's own. Windows of figures, names and units count by
    their fillers, or as frames beside another window of the same alignment.
    Items of fewer than three template tokens have
    no window and are never found. Null and empty texts hold nothing, whole texts
    are read, however long. Repeated documents are all reported, repeated items
    once. Other columns are ignored, whatever their names; an empty table of
    documents or items gives an empty result.
    """
    pairs = matches(docs, items, text, **how)
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.md5(F.col(text))).alias("text_key_"))
    return keyed.join(pairs, F.col("text_key_") == F.col("key")).select("doc_id", "item_id", "n_matched", "n_windows", "coverage", "exact_slots")


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", **how) -> DataFrame:
    """The rows of docs that hold no benchmark item, with all their columns; null texts stay."""
    own, key = fresh(docs, "text_key_"), fresh(docs, "found_key_")
    found = matches(docs, items, text, **how).select(F.col("key").alias(key)).distinct()
    kept = docs.withColumn(own, F.unhex(F.md5(F.col(text)))).join(found, F.col(own) == F.col(key), "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item it holds, literally or re-parameterised."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
