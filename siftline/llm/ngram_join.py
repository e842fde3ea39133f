"""Jaccard self-join of word n-gram sets with Bayesian candidate pruning.

1. Texts with equal word sequences are one node; copies are counted, not paired.
2. A node gets 128 MinHash values. Nodes that agree on all four values of one of
   32 bands meet in a bucket (a pair of Jaccard 0.8 misses with 5e-8). Buckets
   are compared in pairs of blocks, so none of them is one task.
3. In a block the MinHash values of a pair are compared 16 at a time; the pair
   goes as soon as the posterior probability of Jaccard >= threshold, given the
   agreements so far and a uniform prior, is under `tolerance`, or when an
   earlier band turns out to hold it too. What remains leaves the block as a
   spanning forest, never as all pairs: a block hands out the forest of its own
   pairs, two blocks only the edges that join different trees of these.
4. The families these forests form are dealt to blocks by the weight of their
   shingle sets. Pairs are pruned by the same posterior; only those that survive
   are verified, by exact set intersection. A worker returns each node's number
   of linked texts and a spanning forest of the links; the components of these
   are the classes.

No bucket, family or partner list is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, fresh, lean, mix64, runs, save, small, table
from .components import TASK, Gathered, by_task, connected_components, deal, pairs_within, roots, whole_groups

WORDS, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
HASHES, ROWS, STEP = 128, 4, 16
BANDS = HASHES // ROWS
#: Nodes in a block of a bucket; shingles in a block of a family (8 bytes each).
BUCKET_BLOCK, FAMILY_WEIGHT = 1024, 1_000_000
CHUNK_BYTES, CHUNK_SHINGLES, CHUNK_COLUMNS = 500_000, 65_536, 4096
#: Groups of more rows than this are compared in square tiles of TILE rows.
SMALL_GROUP, TILE = 48, 512

_LAST = (1 << 63) - 1
_BASE = 0xD1342543DE82EF95
_BYTES = mix64(np.arange(256))
_A = mix64(np.arange(HASHES) + 1000) | np.uint64(1)
_B = mix64(np.arange(HASHES) + 5000)
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)], dtype=np.uint64) for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


def words_of(text: F.Column) -> F.Column:
    """Lower-case runs of letters and digits, joined by one space; null counts as empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def shingles(texts: list[str], k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the k-word shingles of texts from words_of(), and offsets by text.

    A text of fewer than k words is one shingle, an empty one has none. The
    hash of a shingle is a polynomial over its bytes, so no string is built.
    """
    b = np.frombuffer("\n".join(texts).encode("utf-8", "surrogatepass"), np.uint8)
    gap = (b == 32) | (b == 10)
    start = np.flatnonzero(~gap & np.r_[True, gap[:-1]]) if len(b) else np.zeros(0, int)
    end = np.flatnonzero(~gap & np.r_[gap[1:], True]) + 1 if len(b) else np.zeros(0, int)
    doc = np.cumsum(b == 10)[start] if len(start) else np.zeros(0, int)
    n_words = np.bincount(doc, minlength=len(texts))
    first = np.r_[0, np.cumsum(n_words)[:-1]]
    w, last = np.arange(len(start)), (first + n_words - 1)[doc]
    good = (w + k - 1 <= last) | ((w == first[doc]) & (n_words[doc] < k))
    s, e = start[good], end[np.minimum(w + k - 1, last)[good]]
    power, inverse = _power(len(b) + 1)
    prefix = np.r_[np.uint64(0), np.cumsum(_BYTES[b] * power[: len(b)], dtype=np.uint64)]
    h = mix64((prefix[e] - prefix[s]) * inverse[s])
    return h, np.r_[0, np.cumsum(np.bincount(doc[good], minlength=len(texts)))]


def minhash(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """HASHES 16-bit MinHash values of each text; zeros for texts without shingles."""
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), HASHES), np.uint16)
    full = np.flatnonzero(sizes)
    for a, b in runs(sizes[full].tolist(), CHUNK_SHINGLES):
        lo, hi = offsets[full[a]], offsets[full[b - 1] + 1]
        part, at = h[lo:hi], offsets[full[a:b]] - lo
        for k in range(HASHES):
            out[full[a:b], k] = np.minimum.reduceat(part * _A[k] + _B[k], at).astype(np.uint16)
    return out


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For 16, 32, ... compared values the fewest agreements with which a pair stays.

    With a uniform prior, m agreements of n leave a Beta(m+1, n-m+1) posterior;
    its part above t is the chance of at most m successes in n+1 trials of t.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def _add_signature(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        out: list[bytes | None] = []
        for a, b in runs([len(t) for t in texts], CHUNK_BYTES):
            h, offsets = shingles(texts[a:b])
            sig = minhash(h, offsets)
            out += [sig[i].tobytes() if n else None for i, n in enumerate(np.diff(offsets))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], [*batch.schema.names[:-1], "sig"])


def survivors(sig: np.ndarray, left: np.ndarray, right: np.ndarray, least: list[int], band: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose posterior stays above the tolerance, STEP values at a time.

    With the `band` of each row, pairs that agree on an earlier band go as well: they meet there.
    """
    agree = np.zeros(len(left), np.int64)
    for k, need in enumerate(least):
        part = slice(k * STEP, (k + 1) * STEP)
        same = sig[left, part] == sig[right, part]
        agree += same.sum(1)
        stay = agree >= need
        if band is not None:
            meet = np.minimum(band[left], band[right])
            if len(meet) and k * (STEP // ROWS) < meet.max():
                there = same.reshape(-1, STEP // ROWS, ROWS).all(2)
                stay &= ~(there & (np.arange(k * (STEP // ROWS), (k + 1) * (STEP // ROWS)) < meet[:, None])).any(1)
        left, right, agree = left[stay], right[stay], agree[stay]
    return left, right


def _family_edges(threshold: float, tolerance: float):
    least = least_matches(threshold, tolerance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Gathered(pa.binary())
        for t, offsets in whole_groups(batches, TASK):
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
            block, band, cross = t.column("block").to_numpy(), t.column("band").to_numpy(), t.column("lo").to_numpy() != t.column("hi").to_numpy()
            kept = [survivors(sig, left, right, least, band) for left, right in pairs_within(offsets)]
            if not kept:
                continue
            left, right = np.concatenate([x for x, _ in kept]), np.concatenate([x for _, x in kept])
            # Where two blocks meet, their own pairs only tell which edges between them are no news.
            inner = cross[left] & (block[left] == block[right])
            own = roots(t.num_rows, left[inner], right[inner])
            root = roots(t.num_rows, own[left[~inner]], own[right[~inner]])
            below = np.flatnonzero((own == np.arange(len(own))) & (root != np.arange(len(root))))
            node = t.column("node").combine_chunks()
            found.link(node.take(pa.array(below)), node.take(pa.array(root[below])))
            yield from (pa.RecordBatch.from_arrays(list(x), ["src", "dst"]) for x in found.forest())
        yield from (pa.RecordBatch.from_arrays(list(x), ["src", "dst"]) for x in found.forest(True))

    return run


class Sets:
    """Shingle sets by row, as a matrix whose equal columns are one, with a weight."""

    def __init__(self, h: np.ndarray, offsets: np.ndarray):
        self.size = np.diff(offsets)
        row = np.repeat(np.arange(len(self.size)), self.size)
        order = np.argsort(h, kind="stable")
        row, h = row[order], h[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, int)
        number = np.diff(np.r_[first, len(h)])
        # Columns with the same rows have the same sum of the rows' hashes; a column of one row links nothing.
        sums = np.add.reduceat(mix64(np.arange(len(self.size)) + 77)[row], first) if len(h) else np.zeros(0, np.uint64)
        shared = np.flatnonzero(number > 1)
        _, one, self.weight = np.unique(sums[shared], return_index=True, return_counts=True)
        first, number = first[shared[one]], number[shared[one]]
        self.column = np.repeat(np.arange(len(first)), number)
        ends = np.cumsum(number)
        self.row = row[np.repeat(first - (ends - number), number) + np.arange(len(self.column))]
        # The same by row, and as one sorted key for lookups.
        by = np.lexsort((self.column, self.row))
        self.by_row = self.column[by]
        self.at = np.searchsorted(self.row[by], np.arange(len(self.size) + 1))
        self.width = max(1, len(first))
        self.key = self.row[by] * np.int64(self.width) + self.by_row
        self.real = np.float32 if self.size.max(initial=0) < 1 << 24 else np.float64

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The size of each pair's intersection, by looking up the left row's columns in the right one."""
        out, n = np.zeros(len(left)), np.diff(self.at)
        if not len(self.key):
            return out
        for a, b in runs(n[left].tolist(), 2_000_000):
            count = n[left[a:b]]
            ends = np.cumsum(count)
            column = self.by_row[np.repeat(self.at[left[a:b]] - (ends - count), count) + np.arange(ends[-1])]
            want = np.repeat(right[a:b], count) * np.int64(self.width) + column
            hit = self.key[np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)] == want
            out[a:b] = np.bincount(np.repeat(np.arange(b - a), count), hit * self.weight[column], b - a)
        return out

    def tile(self, a: int, b: int, c: int, d: int) -> np.ndarray:
        """Intersections of rows a..b with rows c..d, as a product of matrices."""
        shared = np.zeros((b - a, d - c), self.real)
        for lo in range(0, self.width, CHUNK_COLUMNS):
            i, j = np.searchsorted(self.column, (lo, lo + CHUNK_COLUMNS))
            row, column = self.row[i:j], self.column[i:j] - lo
            sides = []
            for begin, end in ((a, b), (c, d)):
                m = np.zeros((end - begin, min(CHUNK_COLUMNS, self.width - lo)), self.real)
                inside = (row >= begin) & (row < end)
                m[row[inside] - begin, column[inside]] = 1
                sides.append(m)
            shared += (sides[0] * self.weight[lo : lo + CHUNK_COLUMNS].astype(self.real)) @ sides[1].T
        return shared


def _exact(threshold: float, tolerance: float):
    """Each node's linked copies, and forests of the links."""
    least = least_matches(threshold, tolerance)

    def verified(sets: Sets, sig: np.ndarray, left: np.ndarray, right: np.ndarray, tile: tuple[int, int, int, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        left, right = survivors(sig, left, right, least)
        if not len(left):
            return left, right
        # A dense tile is cheaper as a product, a few pairs are cheaper alone; both are exact.
        if tile and len(left) * np.diff(sets.at).mean() * 500 > (tile[1] - tile[0]) * (tile[3] - tile[2]) * sets.width:
            both = sets.tile(*tile)[left - tile[0], right - tile[2]].astype(float)
        else:
            both = sets.pairs(left, right)
        ok = both / (sets.size[left] + sets.size[right] - both) >= threshold
        return left[ok], right[ok]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Gathered(pa.binary())

        def out(last: bool = False) -> Iterator[pa.RecordBatch]:
            for src, dst in found.forest(last):
                yield pa.RecordBatch.from_arrays([src, dst, pa.nulls(len(src), pa.int64())], ["node", "root", "links"])
            for node, links in found.totals(last):
                yield pa.RecordBatch.from_arrays([node, pa.nulls(len(node), pa.binary()), links], ["node", "root", "links"])

        for t, offsets in whole_groups(batches, TASK, 256):
            block, cross = t.column("block").to_numpy(), t.column("lo").to_numpy() != t.column("hi").to_numpy()
            copies = t.column("copies").to_numpy()
            lists = t.column("shingles").combine_chunks()
            h = lists.flatten().to_numpy()
            sig = minhash(h.view(np.uint64), np.r_[0, np.cumsum(lists.value_lengths().to_numpy())])
            sets = Sets(h, np.r_[0, np.cumsum(lists.value_lengths().to_numpy())])
            links = []
            large = np.flatnonzero(np.diff(offsets) > SMALL_GROUP)
            few = offsets[:-1][np.diff(offsets) <= SMALL_GROUP], offsets[1:][np.diff(offsets) <= SMALL_GROUP]
            for left, right in pairs_in(*few):
                ok = ~cross[left] | (block[left] != block[right])
                links.append(verified(sets, sig, left[ok], right[ok]))
            for g in large:
                a, b = int(offsets[g]), int(offsets[g + 1])
                middle = a + int(np.count_nonzero(block[a:b] == block[a])) if cross[a] else b
                for x in range(a, middle, TILE):
                    for y in range(middle if cross[a] else x, b, TILE):
                        tile = (x, min(x + TILE, middle), y, min(y + TILE, b))
                        left, right = np.repeat(np.arange(tile[0], tile[1]), tile[3] - tile[2]), np.tile(np.arange(tile[2], tile[3]), tile[1] - tile[0])
                        if x == y:
                            left, right = left[left < right], right[left < right]
                        links.append(verified(sets, sig, left, right, tile))
                        if sum(len(x) for x, _ in links) > 2_000_000:
                            links = _fold(links, t, copies, found)
            _fold(links, t, copies, found)
            yield from out()
        yield from out(True)

    return run


def pairs_in(begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """pairs_within() for groups that do not lie side by side."""
    rows = np.concatenate([np.arange(a, b) for a, b in zip(begin, end, strict=True)]) if len(begin) else np.zeros(0, int)
    for left, right in pairs_within(np.r_[0, np.cumsum(end - begin)]):
        yield rows[left], rows[right]


def _fold(links: list[tuple[np.ndarray, np.ndarray]], t: pa.Table, copies: np.ndarray, found: Gathered) -> list:
    """Hand links over as sums and a forest; the list is empty again."""
    if links:
        left, right = np.concatenate([x for x, _ in links]), np.concatenate([x for _, x in links])
        count = np.bincount(left, copies[right], t.num_rows) + np.bincount(right, copies[left], t.num_rows)
        root = roots(t.num_rows, left, right)
        node = t.column("node").combine_chunks()
        some, below = np.flatnonzero(count), np.flatnonzero(root != np.arange(len(root)))
        found.add(node.take(pa.array(some)), count[some].astype(np.int64))
        found.link(node.take(pa.array(below)), node.take(pa.array(root[below])))
    return []


def _add_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        for a, b in runs([len(t) for t in texts], CHUNK_BYTES):
            h, offsets = shingles(texts[a:b])
            lists = pa.array([np.unique(h[offsets[i] : offsets[i + 1]]).view(np.int64) for i in range(b - a)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:-1]), lists], [*batch.schema.names[:-1], "shingles"])


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per input row: doc_id, node (of its word sequence), class_id, class_node and n_links.

    n_links counts the other rows whose shingle sets have Jaccard >= threshold
    with this row's, copies included; class_id is the smallest doc_id reachable
    by links. Null, empty and wordless texts link with nothing and are their own
    class (node null). Repeated rows are copies of each other. A null doc_id
    sorts last. Ties need no rule: classes are components. Other columns of the
    input are ignored, whatever their names. doc_id must be an integer column.
    Whole texts are compared, however long; an empty table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_key"), words_of(F.col(text)).alias("words"))
    keyed = rows.select("doc_id", "text_key", F.when(F.col("words") != "", F.unhex(F.md5("words"))).alias("node_"), "words")
    signed = save(keyed.mapInArrow(lean(_add_signature), "doc_id bigint, text_key bigint, node_ binary, sig binary"), "signed")
    # The key sorts by the smallest doc_id first, so that a component's smallest key names its class.
    order = F.unhex(F.lpad(F.hex(F.col("first.id").bitwiseXOR(F.lit(-_LAST - 1))), 16, "0"))
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("id"), F.col("text_key").alias("key"))).alias("first")
    nodes = signed.where("node_ is not null").groupBy("node_").agg(F.count(F.lit(1)).alias("copies"), first, F.first("sig").alias("sig"))
    nodes = save(nodes.select(F.concat(order, "node_").alias("node"), "node_", "first", "copies", "sig"), "nodes")

    numbered = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("sig", i * (2 * ROWS) + 1, F.lit(2 * ROWS)))))
    bands = nodes.select("node", numbered.alias("band", "bucket"))
    sizes = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_")).where("n_ > 1").select("bucket", F.ceil(F.col("n_") / BUCKET_BLOCK).alias("blocks_"))
    met = deal(bands.join(sizes, "bucket").join(nodes.select("node", "sig"), "node"), "bucket", "node")
    met = by_task(met.select("task", "node", "sig", "band", "block", "lo", "hi"))
    families = connected_components(met.mapInArrow(lean(_family_edges(threshold, tolerance)), "src binary, dst binary"))

    members = save(families.join(nodes.select("node", "first", "copies"), "node").select("node", F.col("component").alias("family"), F.col("first.id").alias("f_"), F.col("first.key").alias("k_"), "copies"), "members")
    # Texts are fetched by row before their words are made, so only members' texts are shuffled.
    texts = docs.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(_LAST)).alias("id_"), F.xxhash64(F.col(text)).alias("text_key"), F.col(text).alias("words"))
    texts = texts.join(small(members), (F.col("id_") == F.col("f_")) & (F.col("text_key") == F.col("k_"))).dropDuplicates(["node"])
    sets = texts.select("node", "family", "copies", words_of(F.col("words")).alias("words")).mapInArrow(lean(_add_shingles), "node binary, family binary, copies bigint, shingles array<bigint>")
    sets = save(sets, "sets")
    weights = sets.groupBy(F.col("family").alias("family_")).agg(F.count(F.lit(1)).alias("n_"), F.sum(F.size("shingles") + 64).alias("w_")).where("n_ > 1")
    weights = weights.select("family_", F.least(F.col("n_"), F.ceil(F.col("w_") / FAMILY_WEIGHT)).alias("blocks_"))
    met = deal(sets.join(weights, F.col("family") == F.col("family_")).drop("family_"), "family", "node").select("task", "node", "copies", "shingles", "block", "lo", "hi")
    found = save(by_task(met).mapInArrow(lean(_exact(threshold, tolerance)), "node binary, root binary, links bigint"), "links")
    forget(sets)
    links = found.where("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    classes = connected_components(found.where("root is not null").select(F.col("node").alias("src"), F.col("root").alias("dst")))

    known = nodes.select("node", "node_", "copies").join(links, "node", "left").join(classes, "node", "left")
    label = F.coalesce("component", "node")
    first = F.conv(F.hex(F.substring(label, 1, 8)), 16, -10).cast("bigint").bitwiseXOR(F.lit(-_LAST - 1))
    known = known.select("node_", F.nullif(first, F.lit(_LAST)).alias("class_id"), F.substring(label, 9, 16).alias("class_node"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    known = save(known, "classes")
    for t in (nodes, members, found):
        forget(t)
    out = signed.select("doc_id", "text_key", "node_").join(known, "node_", "left")
    return out.select("doc_id", "text_key", F.col("node_").alias("node"), F.when(F.col("node_").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "class_node", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how: float) -> DataFrame:
    """The rows of docs with the smallest doc_id of each class, one for each; texts without words all stay.

    All columns are kept. Of repeated rows with one doc_id and one text one stays.
    """
    id_, key = F.coalesce(F.col(doc_id).cast("bigint"), F.lit(_LAST)), F.xxhash64(F.col(text))
    found = near_duplicates(docs, doc_id, text, **how).where("node is not null").withColumn("doc_id", F.coalesce("doc_id", F.lit(_LAST)))
    chosen = F.col("doc_id").eqNullSafe(F.coalesce("class_id", F.lit(_LAST))) & (F.col("node") == F.col("class_node"))
    # What a class loses is far less than what stays; of one node several texts can share the smallest id, and rows can repeat.
    fate = found.groupBy("doc_id", "text_key", "node").agg(F.count(F.lit(1)).alias("n"), F.bool_and(chosen).alias("chosen"))
    one = fate.where("chosen").groupBy("node").agg(F.min("text_key").alias("first_key"))
    out_id, out_key, own_id, own_key = (fresh(docs, c) for c in ("out_id_", "out_key_", "id_", "key_"))
    fate = fate.join(one, "node", "left").select(F.col("doc_id").alias(out_id), F.col("text_key").alias(out_key), (F.col("chosen") & (F.col("text_key") == F.col("first_key"))).alias("keep"), "n")
    fate = save(fate.where("not keep or keep is null or n > 1"), "fate")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed, at = docs.withColumns({own_id: id_, own_key: key}), (F.col(own_id) == F.col(out_id)) & (F.col(own_key) == F.col(out_key))
    single = keyed.join(small(fate.select(out_id, out_key)), at, "left_anti").select(*columns)
    repeated = keyed.join(small(fate.where("keep").select(out_id, out_key)), at).dropDuplicates([own_id, own_key]).select(*columns)
    return single.union(repeated)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near copies (five words, Jaccard >= 0.8) and its number of links."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")
