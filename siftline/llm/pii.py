"""Personal data: fixed base patterns, and bootstrapped contextual extraction on top.

Base spans (e-mail, IP, card, phone) are the seeds. The word to the left and the
word to the right of a seed are lexical patterns. Spark scores the bipartite
graph of patterns and instances in rounds: a pattern's confidence for a kind is
the summed score of its instances of that kind over ALL occurrences of the word
in the corpus, smoothed. Unseen strings of the kind speak neither for nor against
it while they are no more than the known mass; those beyond count against it. An
identifier-like string that is no base span gets the noisy-or of the patterns
around it and, from `accept` on, counts as an instance of the kind itself, which
lets its other patterns rise in the next round.
A common word stands before anything and so never becomes a pattern; a cue such
as "tel:" does, whether a space follows it or not. Accepted occurrences become
added spans; base spans stay.

Identifier-like strings are looked for in the text outside base spans, not in
words, so numbers with inner spaces and spelled-out addresses ("jo (at) x.org")
are met as well.

Words are counted over the whole corpus (a table of words, summed in Spark); only
strings with a digit or "@" leave the scan as occurrences. Both count each distinct
text once: the words of a text with k equal copies weigh 1/k in every copy, so
copies change no confidence.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, fresh, lean, runs, save, table, without

KINDS = ("email", "ip", "card", "phone")
#: Rounds of scoring, seeds a pattern needs, smoothing of its confidence, score from which an instance counts.
ROUNDS, SUPPORT, SMOOTH, ACCEPT = 3, 5, 2.0, 0.8
WORDS_HELD = 200_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_WORD = re.compile(r"\S+")
#: Identifier-like strings by kind, looked for outside base spans. Every repetition is of one separator and one part, so a search is linear.
_LOOKS = (
    ("ip", re.compile(r"(?<![\w.:,-])(?:[0-9]{1,3}(?:[.:,-][0-9]{1,3}){3}|[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{0,4}){3,7})(?![\w:]|[.,-][0-9])")),
    ("card", re.compile(r"(?<![\w+.-])[0-9](?:[\x20.-]?[0-9])+(?![\w-])")),
    ("phone", re.compile(r"(?<![\w+.(-])(?:\+|\(\+?)?[0-9]+(?:(?:\)[\x20./-]?|[\x20./-]\(?)[0-9]+)*(?![\w(-])")),
)
#: An address's at sign, written out or not; its parts are read to both sides.
_AT = re.compile(r"\x20?(?:@|\(at\)|\[at\])\x20?")
_HOST = re.compile(r"[\w-]+(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?)[\w-]+)*")
_DIGITS = {"card": range(14, 20), "phone": range(7, 16)}
_DIGIT = re.compile("[0-9]")
#: A label inside a token.
_LABEL = re.compile(r"[^:=]+[:=]")
WORD_CHARS = 64
_EDGE = "\"'`.,;:!?()[]{}<>*#$&%|="


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, ordered by start, then kind. Linear in the text."""
    found: list[tuple[int, int, int]] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, 0, m.end()))
            end = m.end()
        else:
            end = max(end, at + 1)
        at = text.find("@", end)
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if len(d := m[0].replace(" ", "").replace("-", "")) in range(14, 20) and luhn(d):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((m.start(), 3, m.end()))
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


def cue(token: str) -> str:
    """A context word: lower case without outer quotes and commas; a closing ":" or "=" stays, it marks a label.

    A word over WORD_CHARS characters goes by its hash, so that no two of them are one.
    """
    mark = token[-1:] if token[-1:] in ":=" else ""
    word = token.lower().strip(_EDGE) + mark
    return word if len(word) <= WORD_CHARS else "#" + xxhash.xxh3_128_hexdigest(word.encode("utf-8", "surrogatepass"))


def cues(token: str) -> list[str]:
    """What a token counts as: itself, and the labels inside it ("tel:" of "tel:5551234")."""
    whole = cue(token)
    if ":" not in token[:-1] and "=" not in token[:-1]:
        return [whole]
    return [whole, *(c for x in _LABEL.findall(token) if (c := cue(x)) != whole)]


def looks(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """(kind, start, end) of identifier-like strings that touch no base span; linear in the text."""
    parts, at = [], 0
    for _, s, e in sorted(base, key=lambda x: x[1]):
        if e > at:
            parts += (text[at:s], "\0" * (e - max(at, s)))
            at = e
    text = "".join((*parts, text[at:]))
    out, edge = [], 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > edge and (text[start - 1] in _LOCAL_CHARS or text[start - 1].isalnum()):
            start -= 1
        edge = m.end()
        host = _HOST.match(text, m.end())
        plain = m[0] == "@"
        if start < m.start() and host and (plain or "." in host[0] or "dot" in host[0]):
            out.append(("email", start, host.end()))
            edge = host.end()
    if _DIGIT.search(text):
        for kind, form in _LOOKS:
            for m in form.finditer(text):
                if kind not in _DIGITS or sum(c.isdigit() for c in m[0]) in _DIGITS[kind]:
                    out.append((kind, *m.span()))
    return out


def occurrences(text: str, base: list[tuple[str, int, int]], tokens: list[re.Match]) -> list[tuple[str, str, int, int, str, str, bool]]:
    """(kind, instance, start, end, left cue, right cue, is base) of seeds and identifier-like strings."""
    starts = [t.start() for t in tokens]

    def around(s: int, e: int) -> tuple[str, str]:
        i = bisect_right(starts, s) - 1
        glued = text[starts[i] : s] if i >= 0 and starts[i] < s else ""
        label = _LABEL.findall(glued)[-1:] if glued[-1:] in (":", "=") else ()
        left = cue(label[0]) if label else "" if glued.strip(_EDGE) else cue(tokens[i - 1][0]) if i > 0 else ""
        j = bisect_right(starts, e - 1)
        return left, cue(tokens[j][0]) if j < len(tokens) else ""

    return [(kind, text[s:e], s, e, *around(s, e), seed) for found, seed in ((base, True), (looks(text, base), False)) for kind, s, e in found]


_SCAN = "key binary, base array<struct<kind:string,start:int,end:int>>, occ array<struct<kind:string,inst:string,start:int,end:int,left:string,right:string,seed:boolean>>, word string, n bigint, copies bigint"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the spans of each text, and rows with counts of words."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    occ = pa.struct([("kind", pa.string()), ("inst", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("left", pa.string()), ("right", pa.string()), ("seed", pa.bool_())])
    schema = pa.schema([("key", pa.binary()), ("base", pa.list_(span)), ("occ", pa.list_(occ)), ("word", pa.string()), ("n", pa.int64()), ("copies", pa.int64())])
    raw: dict[int, Counter[str]] = {}

    def words() -> pa.RecordBatch:
        counts: Counter[tuple[str, int]] = Counter()
        for copies, tokens in raw.items():
            for token, n in tokens.items():
                for word in cues(token):
                    counts[word, copies] += n
        raw.clear()
        k = len(counts)
        return pa.RecordBatch.from_arrays([pa.nulls(k, pa.binary()), pa.nulls(k, pa.list_(span)), pa.nulls(k, pa.list_(occ)), pa.array([w for w, _ in counts], pa.string()), pa.array(list(counts.values()), pa.int64()), pa.array([c for _, c in counts], pa.int64())], schema=schema)

    for batch in batches:
        keys, texts, copies = (batch.column(i).to_pylist() for i in range(3))
        for a, b in runs([len(t) for t in texts], 2_000_000):
            bases, occs = [], []
            for text, k in zip(texts[a:b], copies[a:b], strict=True):
                raw.setdefault(k, Counter()).update(text.split())
                base = base_spans(text)
                digit = base or _DIGIT.search(text) or _AT.search(text)
                occs.append([dict(zip(occ.names, x, strict=True)) for x in occurrences(text, base, list(_WORD.finditer(text)))] if digit else [])
                bases.append([dict(zip(span.names, x, strict=True)) for x in base])
            k = b - a
            yield pa.RecordBatch.from_arrays([pa.array(keys[a:b], pa.binary()), pa.array(bases, pa.list_(span)), pa.array(occs, pa.list_(occ)), pa.nulls(k, pa.string()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], schema=schema)
            if sum(map(len, raw.values())) > WORDS_HELD:
                yield words()
    yield words()


def score_graph(occ: DataFrame, words: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, smooth: float = SMOOTH, accept: float = ACCEPT) -> DataFrame:
    """(kind, inst, score) of the unseen instances that were accepted.

    occ: kind, inst, pattern, seed (one row per pattern of an occurrence, with its
    number n); words: pattern, total. Scores only rise from round to round.
    """
    edges = occ.groupBy("kind", "pattern", "inst").agg(F.sum("n").alias("n"), F.max("seed").alias("seed"))
    # Only a pattern that some kind's seeds or instances support can rise, and only its words' totals matter.
    edges = save(edges.join(words, "pattern").select("kind", "pattern", "inst", "n", "seed", "total"), "edges")
    scores = None
    for _ in range(rounds):
        known = edges.withColumn("s", F.col("seed").cast("double"))
        if scores is not None:
            known = edges.join(scores, ["kind", "inst"], "left").withColumn("s", F.greatest(F.col("seed").cast("double"), F.coalesce("score", F.lit(0.0))))
        mass, unseen = F.sum(F.col("s") * F.col("n")), F.sum(F.when(F.col("seed"), 0.0).otherwise((1 - F.col("s")) * F.col("n")))
        hits = known.groupBy("kind", "pattern").agg(mass.alias("mass"), unseen.alias("unseen"), F.count(F.when(F.col("s") > 0, 1)).alias("instances"), F.max("total").alias("total"))
        patterns = hits.where(F.col("instances") >= support).select("kind", "pattern", (F.col("mass") / (F.col("total") - F.least("unseen", "mass") + smooth)).alias("conf"))
        met = edges.where("not seed").join(patterns, ["kind", "pattern"])
        doubt = met.groupBy("kind", "inst").agg((1 - F.exp(F.sum(F.log(1 - F.least("conf", F.lit(0.999)))))).alias("score"))
        scores = save(doubt.where(F.col("score") >= accept), "scores")
    return scores


def find_personal_data(df: DataFrame, text: str = "text") -> DataFrame:
    """Add base and spans (arrays of kind, start, end in code points, by start, then kind) to every row.

    Null texts count as empty; both arrays are then empty. Offsets are code
    points, ends exclusive. An added span never overlaps a base span or an
    earlier added one. Columns of these names are replaced; repeated rows stay;
    an empty table gives an empty one. Whole texts are read, in time linear in
    their length; of words over 64 characters the hash is the pattern.
    """
    df = without(df, ("base", "spans"))
    t = F.coalesce(F.col(text), F.lit(""))
    own, key = fresh(df, "pii_key_"), fresh(df, "span_key_")
    keyed = df.withColumn(own, F.unhex(F.md5(t)))
    copies = save(keyed.groupBy(F.col(own).alias("copy_key_")).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "copies")
    counted = keyed.select(F.col(own).alias("text_key_"), t.alias("t")).join(copies, F.col("text_key_") == F.col("copy_key_"), "left")
    scan = save(counted.select("text_key_", "t", F.coalesce("copies", F.lit(1)).alias("copies")).mapInArrow(lean(_scan), _SCAN).withColumn("is_word", F.col("word").isNotNull()), "scan")
    words = save(scan.where("is_word and word != ''").groupBy(F.col("word").alias("pattern")).agg(F.round(F.sum(F.col("n") / F.col("copies"))).cast("bigint").alias("total")), "words")
    # Equal texts are one text to the graph: a copied seed is no further evidence.
    texts = scan.where("not is_word and size(occ) > 0").dropDuplicates(["key"]).select("key", F.explode("occ").alias("o")).select("key", "o.*")
    texts = save(texts, "occurrences")
    sides = texts.select("kind", "inst", "seed", F.explode(F.array(F.col("left"), F.col("right"))).alias("pattern")).where("pattern != ''")
    accepted = score_graph(sides.groupBy("kind", "inst", "seed", "pattern").agg(F.count(F.lit(1)).alias("n")), words)
    added = texts.where("not seed").join(accepted, ["kind", "inst"]).groupBy("key").agg(F.collect_set(F.struct("start", "end", "kind")).alias("more"))
    spans = scan.where("not is_word").select("key", "base").dropDuplicates(["key"]).join(added, "key", "left")
    spans = save(spans.mapInArrow(lean(_merged), "span_key_ binary, base array<struct<kind:string,start:int,end:int>>, spans array<struct<kind:string,start:int,end:int>>"), "spans")
    for t_ in (copies, words, texts, scan):
        forget(t_)
    return keyed.join(spans.withColumnRenamed("span_key_", key), F.col(own) == F.col(key)).drop(own, key)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base spans, and all spans by start, then kind; of added spans that overlap the one that starts first stays, then the shorter."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    rank = {k: i for i, k in enumerate(KINDS)}
    for batch in batches:
        base, more = batch.column(1), batch.column(2).to_pylist()
        out, filled = [], base.to_pylist() if any(more) else []
        for i, found in enumerate(more if filled else ()):
            end, kept = 0, list(filled[i])
            for x in sorted(found or (), key=lambda x: (x["start"], x["end"], rank[x["kind"]])):
                if x["start"] >= end:
                    kept.append(x)
                    end = x["end"]
            out.append(sorted(kept, key=lambda x: (x["start"], rank[x["kind"]])))
        yield pa.RecordBatch.from_arrays([batch.column(0), base, pa.array(out, span) if filled else base], ["span_key_", "base", "spans"])


def written(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redacted(text: str, spans: list[dict]) -> str:
    """The text with every span replaced by its kind; spans that overlap an earlier one merge into its mark."""
    out, at = [], 0
    for x in spans:
        if x["start"] >= at:
            out += (text[at : x["start"]], "[", x["kind"].upper(), "]")
        at = max(at, x["end"])
    return "".join((*out, text[at:]))


def redact(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Replace every span by its kind in brackets. Null texts stay null, texts without spans stay as they are."""
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = batch.schema.names.index(text), batch.column(batch.schema.names.index(spans))
            due = pc.greater(pc.fill_null(found.value_lengths(), 0), 0)
            if due.true_count:
                texts = batch.column(at).to_pylist()
                for i in due.to_numpy(zero_copy_only=False).nonzero()[0].tolist():
                    texts[i] = texts[i] and redacted(texts[i], found[i].as_py())
                batch = batch.set_column(at, text, pa.array(texts, pa.string()))
            yield batch

    return df.mapInArrow(lean(run), schema)


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text: counts by kind over all spans, a digest of the base spans, all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_personal_data(docs)
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), F.size("base").cast("bigint").alias("n_base"))
