"""Near-duplicate vectors by sorted projection passes.

Equal vectors with equal labels are one node. A pass hashes every node with
random hyperplanes, orders the nodes by (label, concatenated hash bits, id) and
compares each with the WINDOW nodes before it; a comparison is the exact cosine
in double precision. Passes use independent hyperplanes; the pairs they verify
leave as spanning forests and are united into families.

How many passes a node needs is measured. Whatever shares more leading bits with a
node than the nodes WINDOW places before and after it lies in its window, and a pair
at the threshold shares a bit with probability 1 - angle / pi. So each pass bounds
the chance to miss a partner of the node, whatever the size of its label and however
dense its place, and nodes whose bound is above MISS take part in PASSES more. Nodes
in places so dense that MOST_PASSES would not do are compared whole, label by label,
in pairs of blocks. Of a pair one node's bound is enough, so later rounds are small.

Each family is then compared whole, in pairs of blocks too, which gives every node
its exact number of links.

A range partition of a pass ends where others begin, so each also hands out its
first and last WINDOW rows, and a second step compares every partition's first rows
with the last WINDOW rows before it, from as many partitions as hold them.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, log, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, lean, mix64, save, table
from .components import TASK, Gathered, block_pairs, by_task, connected_components, roots, whole_groups

THRESHOLD = 0.98
PASSES, BITS, WINDOW, BLOCK = 12, 60, 64, 2048
#: The chance to miss a partner of a node that a bound may leave, and the passes a node may need before it counts as crowded.
MISS, MOST_PASSES = 1e-3, 60


def hyperplanes(n: int, dim: int, seed: int) -> np.ndarray:
    """n x dim numbers, about normal (the sum of four uniform ones), from a hash of their place."""
    with np.errstate(over="ignore"):
        at = np.uint64(seed) * np.uint64(1 << 40) + np.arange(n * dim * 4, dtype=np.uint64)
        x = mix64(at) >> np.uint64(11)
    return (x.astype(float) / (1 << 53) - 0.5).reshape(n, dim, 4).sum(2)


def unit_rows(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length, scaled to length 1, in double precision."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(float)
    m = flat.reshape(len(values), -1) if len(values) else flat.reshape(0, 1)
    m = m / np.abs(m).max(1, keepdims=True)  # no overflow in the squares
    return m / np.sqrt((m**2).sum(1, keepdims=True))


def cosines_over(m: np.ndarray, other: np.ndarray, threshold: float) -> np.ndarray:
    return m @ other.T >= threshold


def _project(first: int, passes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(batch.schema.names.index("v"))
            sizes = v.value_lengths().to_numpy()
            for size in np.unique(sizes):
                at = pa.array(np.flatnonzero(sizes == size))
                part = batch.take(at)
                m = unit_rows(part.column(batch.schema.names.index("v")))
                for p in range(first, first + passes):
                    bits = m @ hyperplanes(BITS, int(size), p).T > 0
                    key = bits @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), p, np.int32)), pa.array(key), *part.columns], ["pass", "key", *part.schema.names])

    return run


def _near(label: list, size: np.ndarray, flat: np.ndarray, offsets: np.ndarray, threshold: float, window: int, begin: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs of rows at most `window` apart in one label and length, the later row from `begin` on."""
    lefts, rights = [], []
    cut = [i for i in range(1, len(label)) if label[i] != label[i - 1] or size[i] != size[i - 1]]
    for a, b in zip([0, *cut], [*cut, len(label)], strict=True):
        m = flat[offsets[a] : offsets[b]].reshape(b - a, -1) if b > a else None
        for lo in range(0, b - a, window):
            hi, low = min(lo + window, b - a), max(0, lo - window)
            i, j = np.nonzero(cosines_over(m[lo:hi], m[low:hi], threshold))
            i, j = i + lo, j + low
            ok = (j < i) & (i - j <= window) & (a + i >= begin)
            lefts.append(a + j[ok])
            rights.append(a + i[ok])
    return (np.concatenate(lefts), np.concatenate(rights)) if lefts else (np.zeros(0, int), np.zeros(0, int))


def _normal(t: pa.Table) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Group of each row, length of its vector, unit vectors end to end, offsets."""
    v = t.column("v").combine_chunks()
    size = v.value_lengths().to_numpy()
    offsets = np.r_[0, np.cumsum(size)]
    flat = v.flatten().to_numpy(zero_copy_only=False).astype(float)
    flat = flat / np.repeat(np.maximum.reduceat(np.abs(flat), offsets[:-1]), size)
    flat = flat / np.repeat(np.sqrt(np.add.reduceat(flat**2, offsets[:-1])), size)
    return list(zip(t.column("pass").to_pylist(), t.column("label").to_pylist(), strict=True)), size, flat, offsets


_EDGE = "src bigint, dst bigint, miss double, rows int, part int, place int, head boolean, tail boolean, pass int, label string, node bigint, v array<double>"
_KINDS = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.int32(), pa.string(), pa.int64(), pa.list_(pa.float64())]
_NAMES = ["src", "dst", "miss", "rows", "part", "place", "head", "tail", "pass", "label", "node", "v"]


def _batch(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in zip(_NAMES, _KINDS, strict=True)], _NAMES)


def shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading bits that keys share, of BITS."""
    x = (a ^ b).astype(np.uint64)
    high = np.zeros(len(x), int)
    for k in (32, 16, 8, 4, 2, 1):  # the place of the highest set bit
        big = x >> np.uint64(k) > 0
        high[big] += k
        x = np.where(big, x >> np.uint64(k), x)
    return np.where(a == b, BITS, BITS - 1 - high)


def log_miss(group: np.ndarray, key: np.ndarray, window: int, threshold: float) -> np.ndarray:
    """Bound on the log of the chance to miss a partner, for rows in order of (group, key) that have `window` rows on both sides.

    Zero where that is unknown (the first and last rows) or the window holds equal keys alone.
    """
    out, n = np.zeros(len(key)), len(key) - 2 * window
    if n > 0:
        at = slice(window, window + n)
        need = np.zeros(n, int)
        for other in (slice(0, n), slice(2 * window, None)):
            need = np.maximum(need, np.where(group[at] == group[other], shared_bits(key[at], key[other]) + 1, 0))
        share = (1 - acos(threshold) / pi) ** need.astype(float)
        out[at] = np.where(need > BITS, 0.0, np.log1p(-np.minimum(share, 1 - 1e-9)))
    return out


def _windows(threshold: float, window: int):
    """Edges inside a sorted partition, bounds of its nodes, and its first and last `window` rows for the partitions beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, held, names = TaskContext.get().partitionId(), 0, None, ["pass", "label", "node", "v"]
        keys: list[pa.Table] = []
        found = Gathered(pa.int64())

        def rows(t: pa.Table, place: int, head: bool) -> pa.RecordBatch:
            n = t.num_rows
            return _batch(n, part=[part] * n, place=range(place, place + n), head=[head] * n, tail=[not head] * n, **{c: t.column(c).combine_chunks() for c in names})

        def bounds(last: bool = False) -> Iterator[pa.RecordBatch]:
            """Of the rows held: those of one stretch, and the last two windows stay for the next."""
            t = pa.concat_tables(keys).combine_chunks()
            miss = log_miss(t.column("group").to_numpy(), t.column("key").to_numpy(), window, threshold)
            some = np.flatnonzero(miss)
            keys[:] = [t.slice(max(0, t.num_rows - 2 * window))]
            if len(some):
                yield _batch(len(some), miss=miss[some], node=t.column("node").take(pa.array(some)).combine_chunks())

        for batch in batches:
            new = pa.Table.from_batches([batch])
            if not new.num_rows:
                continue
            if seen < window:
                yield rows(new.slice(0, window - seen), seen, True)
            group = np.array([hash(x) for x in zip(new.column("pass").to_pylist(), new.column("label").to_pylist(), strict=True)])
            keys.append(pa.table({"group": group, "key": new.column("key"), "node": new.column("node")}))
            if sum(k.num_rows for k in keys) > 20_000:
                yield from bounds()
            new = new.select(names)
            t = pa.concat_tables([held, new]) if held is not None else new
            left, right = _near(*_normal(t), threshold, window, t.num_rows - new.num_rows)
            root = roots(t.num_rows, left, right)
            far = np.flatnonzero(root != np.arange(t.num_rows))
            node = t.column("node").to_numpy()
            found.link(pa.array(node[far]), pa.array(node[root[far]]))
            for src, dst in found.forest():
                yield _batch(len(src), src=src, dst=dst)
            seen += new.num_rows
            held = t.slice(max(0, t.num_rows - window))
        if held is not None:
            yield from bounds(True)
            for src, dst in found.forest(True):
                yield _batch(len(src), src=src, dst=dst)
            last = held.slice(max(0, held.num_rows - min(window, seen)))
            yield rows(last, seen - last.num_rows, False)
            yield _batch(1, part=[part], rows=[seen])

    return run


def handed_on(counts: dict[int, int], window: int) -> list[tuple[int, int, int]]:
    """(seam, part, rows): how many last rows of which partitions make the `window` rows before each partition."""
    out, parts = [], sorted(p for p, n in counts.items() if n)
    for k, seam in enumerate(parts):
        want = window
        for part in reversed(parts[:k]):
            take = min(want, counts[part])
            out.append((seam, part, take))
            want -= take
            if not want:
                break
    return out


def _seams(threshold: float, window: int):
    """Forests of the links between a partition's first rows and the last rows before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Gathered(pa.int64())
        for t, offsets in whole_groups(batches, "seam"):
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                part = t.slice(a, b - a)
                begin = int(np.count_nonzero(part.column("tail").to_numpy(zero_copy_only=False)))
                left, right = _near(*_normal(part), threshold, window, begin)
                ok = left < begin
                root = roots(part.num_rows, left[ok], right[ok])
                far = np.flatnonzero(root != np.arange(part.num_rows))
                node = part.column("node").to_numpy()
                found.link(pa.array(node[far]), pa.array(node[root[far]]))
            yield from (pa.RecordBatch.from_arrays(list(x), ["src", "dst"]) for x in found.forest())
        yield from (pa.RecordBatch.from_arrays(list(x), ["src", "dst"]) for x in found.forest(True))

    return run


def _whole(threshold: float):
    """Forests of the links in tasks of block_pairs()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Gathered(pa.int64())
        for node, ok in _links(batches, threshold):
            left, right = np.nonzero(np.triu(ok, 1))
            root = roots(len(node), left, right)
            far = np.flatnonzero(root != np.arange(len(root)))
            found.link(pa.array(node[far]), pa.array(node[root[far]]))
            yield from (pa.RecordBatch.from_arrays(list(x), ["src", "dst"]) for x in found.forest())
        yield from (pa.RecordBatch.from_arrays(list(x), ["src", "dst"]) for x in found.forest(True))

    return run


def _links(batches: Iterator[pa.RecordBatch], threshold: float, copies: str | None = None) -> Iterator[tuple]:
    """Nodes of a task (with their copies) and which of them are linked, without the pairs that other tasks compare."""
    for t, offsets in whole_groups(batches, TASK, 1024):
        block, cross = t.column("block").to_numpy(), t.column("lo").to_numpy() != t.column("hi").to_numpy()
        node, vectors = t.column("node").to_numpy(), t.column("v").combine_chunks()
        sizes = vectors.value_lengths().to_numpy()
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            for size in np.unique(sizes[a:b]):
                at = a + np.flatnonzero(sizes[a:b] == size)
                m = unit_rows(vectors.take(pa.array(at)))
                ok = cosines_over(m, m, threshold) & ~np.eye(len(at), dtype=bool)
                if cross[a]:
                    ok &= block[at, None] != block[None, at]
                yield (node[at], ok, t.column(copies).to_numpy()[at]) if copies else (node[at], ok)


def _exact(threshold: float):
    """Each node's linked copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Gathered(pa.int64())
        for node, ok, copies in _links(batches, threshold, "copies"):
            count = ok @ copies
            some = np.flatnonzero(count)
            found.add(pa.array(node[some]), count[some])
            yield from (pa.RecordBatch.from_arrays(list(x), ["node", "links"]) for x in found.totals())
        yield from (pa.RecordBatch.from_arrays(list(x), ["node", "links"]) for x in found.totals(True))

    return run


def near_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, passes: int = PASSES, window: int = WINDOW, miss: float = MISS) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Two rows are linked if their labels are equal and not null and their cosine
    in double precision is at least `threshold`. Null, empty and zero vectors,
    and those with null or non-finite components, link with nothing. Vectors of
    different lengths are not compared. Repeated rows and equal vectors are
    linked copies of each other. Rows with a null vec_id link with nothing.
    Different vectors under one vec_id share its component. Other columns are ignored; an empty table gives an empty result.
    """
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    base = rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).cast("string").alias("label"), v.alias("v"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    base = base.withColumn("key", F.when(F.coalesce(sound, F.lit(False)), F.xxhash64("label", F.col("v").cast("string"))))
    base = save(base.withColumn("key2", F.when(F.col("key").isNotNull(), F.unhex(F.md5(F.concat_ws("|", "label", F.col("v").cast("string")))))).drop("key"), "vectors")
    nodes = base.where("key2 is not null").groupBy("key2").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    nodes = save(nodes, "nodes")

    edges = save(_pass_edges(nodes.select("node", "label", "v"), threshold, passes, window, miss), "edges")
    families = connected_components(edges)

    members = nodes.join(families, "node").select("node", "component", "copies", "v")
    met = by_task(block_pairs(members, "component", "node", BLOCK))
    links = met.select("task", "node", "copies", "v", "block", "lo", "hi").mapInArrow(lean(_exact(threshold)), "node bigint, links bigint").groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("key2", "node", "copies").join(families, "node", "left").join(links, "node", "left")
    known = save(known.select("key2", F.coalesce("component", "node").alias("component_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "known")
    forget(edges)
    forget(nodes)
    out = base.select("vec_id", "key2").join(known, "key2", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _pass_edges(left: DataFrame, threshold: float, passes: int, window: int, miss: float) -> DataFrame:
    """Edges (src, dst) of rounds of passes over (node, label, v), and of crowded nodes compared whole."""
    spark, done, rounds, before, crowded = left.sparkSession, 0, [], None, []
    cols = ["seam", "tail", "part", "place", "pass", "label", "node", "v"]
    while True:
        keyed = left.mapInArrow(lean(_project(done, passes)), "pass int, key bigint, node bigint, label string, v array<double>")
        order = ["pass", "label", "key", "node"]
        parts = max(passes, int(spark.conf.get("spark.sql.shuffle.partitions")))
        ordered = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        found = save(ordered.mapInArrow(lean(_windows(threshold, window)), _EDGE), "windows")
        done += passes
        # One row per partition, not per vector.
        seams = spark.createDataFrame(handed_on({r.part: r.rows for r in found.where("rows is not null").select("part", "rows").collect()}, window), "seam int, part int, take int")
        counts = found.where("rows is not null").select("part", F.col("rows").alias("n_"))
        tails = found.where("tail").join(F.broadcast(seams), "part").join(F.broadcast(counts), "part").where(F.col("place") >= F.col("n_") - F.col("take"))
        heads = found.where("head").withColumn("seam", F.col("part"))
        met = tails.select(*cols).union(heads.select(*cols)).repartition("seam").sortWithinPartitions("seam", F.desc("tail"), "part", "place")
        rounds.append(found.where("src is not null").select("src", "dst"))
        rounds.append(met.mapInArrow(lean(_seams(threshold, window)), "src bigint, dst bigint"))
        bound = found.where("miss is not null").groupBy("node").agg(F.sum("miss").alias("miss"))
        bound = left.join(bound, "node", "left").withColumn("miss", F.coalesce("miss", F.lit(0.0)))
        if before is not None:
            bound = bound.join(before, "node", "left").withColumn("miss", F.col("miss") + F.coalesce("so_far", F.lit(0.0)))
        # Passes that this node's mean bound asks for.
        need = F.when(F.col("miss") < 0, F.lit(log(miss)) * done / F.col("miss")).otherwise(F.lit(float("inf")))
        open_ = save(bound.withColumn("need", need).where(F.col("need") > done), "open")
        crowded.append(open_.where((F.col("need") > MOST_PASSES) | F.lit(done >= MOST_PASSES)).select("node", "label", "v"))
        open_ = open_.where((F.col("need") <= MOST_PASSES) & F.lit(done < MOST_PASSES))
        left, before = open_.select("node", "label", "v"), open_.select("node", F.col("miss").alias("so_far"))
        if left.isEmpty():
            break
    whole = crowded[0]
    for c in crowded[1:]:
        whole = whole.union(c)
    met = by_task(block_pairs(save(whole, "crowded"), "label", "node", BLOCK)).select("task", "node", "v", "block", "lo", "hi")
    out = met.mapInArrow(lean(_whole(threshold)), "src bigint, dst bigint")
    for r in rounds:
        out = out.union(r)
    return out


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding with its links (cosine >= 0.98, equal label) and component."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
