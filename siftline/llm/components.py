"""Connected components, and pairs of blocks for comparing a large group piece by piece."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, save


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) of every node on an edge; the component is its smallest node.

    Labels spread along edges and then jump to their label's label, so chains
    shrink by half or more in a round. Every round is a written table: nothing
    is collected, and a lost executor costs one round at most. Self-loops and
    null ends are ignored; an edge may occur often and in both directions.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a != b")
    both = _stars(save(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"))
    labels = save(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "b", "component": "c"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        spread = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "c").alias("c"))
        spread = save(spread, "labels")
        above = labels.select(F.col("node").alias("c"), F.col("component").alias("up"))
        moved = save(spread.join(above, "c").select("node", F.least("c", "up").alias("component"), (F.least("c", "up") != F.col("old")).alias("moved")), "labels")
        forget(spread)
        forget(labels)
        labels = moved
        if labels.where("moved").isEmpty():
            forget(both)
            return labels.select("node", "component")


def _stars(down: DataFrame) -> DataFrame:
    """Both directions of edges that connect the same nodes, without the multiplicity of `down` (a > b).

    Each node keeps its edge to its smallest neighbour below; its other
    neighbours below get an edge to that one. Block pairs link a node to one
    root each, and these roots are few, so equal edges fall together.
    """
    least = save(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = down.join(least, "a").where("b != m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
    out = save(least.select("a", F.col("m").alias("b")).union(moved).distinct(), "stars")
    forget(down)
    forget(least)
    return save(out.select("a", "b").union(out.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")


def block_pairs(members: DataFrame, group: str, node: str, size: int) -> DataFrame:
    """Deal each group's rows into blocks of about `size`, and each row to every pair of blocks it is in.

    Adds block, lo, hi and task: rows with the same task, lo and hi meet in one
    place, at most two blocks of them, so no group, however large, is one task.
    Groups of one row go. Two rows of one block meet where lo = hi, others where lo < hi.
    """
    counts = members.groupBy(group).agg(F.count(F.lit(1)).alias("n_")).where("n_ > 1").withColumnRenamed(group, "group_")
    rows = members.join(counts, F.col(group) == F.col("group_")).drop("group_")
    return deal(rows.withColumn("blocks_", F.ceil(F.col("n_") / size)).drop("n_"), group, node)


def deal(rows: DataFrame, group: str, node: str) -> DataFrame:
    """block_pairs() for rows that already have the number of their group's blocks in blocks_."""
    rows = rows.withColumn("blocks_", F.col("blocks_").cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(node), F.col("blocks_")).cast("int"))
    rows = rows.withColumn("other_", F.explode(F.sequence(F.lit(0), F.col("blocks_") - 1)))
    rows = rows.withColumns({"lo": F.least("block", "other_"), "hi": F.greatest("block", "other_")})
    return rows.withColumn("task", F.xxhash64(group, "lo", "hi")).drop("blocks_", "other_")


#: What names a task: should two groups' hashes meet, tasks of the same blocks become one, which loses no pair.
TASK = ("task", "lo", "hi")


def by_task(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows of deal() with each task's rows together, its blocks one after the other."""
    rows = rows.repartition("task") if parts is None else rows.repartition(parts, "task")
    return rows.sortWithinPartitions(*TASK, "block")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: str | tuple[str, ...], rows: int = 4096, size: int = 32 << 20) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from batches sorted by the keys, with the offsets of the groups (and the end).

    A table is given out from about `rows` rows or `size` bytes on.
    """
    held: list[pa.RecordBatch] = []
    n = 0
    keys = (keys,) if isinstance(keys, str) else keys

    def cut(last: bool) -> Iterator[tuple[pa.Table, np.ndarray]]:
        nonlocal held, n
        t = pa.Table.from_batches(held).combine_chunks()
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for key in keys:
            k = t.column(key).to_numpy()
            new[1:] |= k[1:] != k[:-1]
        starts = np.flatnonzero(new)
        if last:
            yield t, np.r_[starts, t.num_rows]
            held, n = [], 0
        else:
            if starts[-1]:
                yield t.slice(0, starts[-1]), starts
            rest = t.slice(starts[-1])
            held, n = rest.combine_chunks().to_batches(), rest.num_rows

    since = weight = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n, since, weight = n + batch.num_rows, since + batch.num_rows, weight + batch.nbytes
            if since >= rows or weight >= size:
                since = weight = 0
                yield from cut(False)
    if n:
        yield from cut(True)


def pairs_within(offsets: np.ndarray, most: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (left < right) inside each group, about `most` at a time; a large group's come in strips."""
    sizes = np.diff(offsets)
    lefts, rights, n = [], [], 0
    for size in np.unique(sizes[sizes > 1]):
        starts = offsets[:-1][sizes == size]
        if size * size > most:
            step = max(1, most // int(size))
            for base in starts:
                for lo in range(0, size - 1, step):
                    i = np.arange(lo, min(lo + step, size - 1))
                    after = size - 1 - i
                    left = np.repeat(i, after)
                    ends = np.cumsum(after)
                    yield base + left, base + left + 1 + np.arange(ends[-1]) - np.repeat(ends - after, after)
            continue
        i, j = np.triu_indices(size, 1)
        step = max(1, most // len(i))
        for k in range(0, len(starts), step):
            base = starts[k : k + step, None]
            lefts.append((base + i).ravel())
            rights.append((base + j).ravel())
            n += len(lefts[-1])
            if n >= most:
                yield np.concatenate(lefts), np.concatenate(rights)
                lefts, rights, n = [], [], 0
    if n:
        yield np.concatenate(lefts), np.concatenate(rights)


class Gathered:
    """What a worker's tasks find, merged before it leaves: a forest of edges, and sums by node.

    Both are given out from `most` rows on, so they are bounded; what is
    given out twice is merged by Spark.
    """

    def __init__(self, kind: pa.DataType, most: int = 400_000):
        self.kind, self.most = kind, most
        self.src, self.dst, self.edges = [], [], 0
        self.node, self.sums, self.nodes = [], [], 0

    def link(self, src: pa.Array, dst: pa.Array) -> None:
        self.src.append(src)
        self.dst.append(dst)
        self.edges += len(src)

    def add(self, node: pa.Array, sums: np.ndarray) -> None:
        self.node.append(node)
        self.sums.append(pa.array(sums, pa.int64()))
        self.nodes += len(node)

    def forest(self, last: bool = False) -> Iterator[tuple[pa.Array, pa.Array]]:
        """(src, dst) of a spanning forest of the edges so far."""
        if self.edges and (last or self.edges >= self.most):
            both = pa.chunked_array([*self.src, *self.dst], self.kind).combine_chunks().dictionary_encode()
            code = both.indices.to_numpy()
            root = roots(len(both.dictionary), code[: self.edges], code[self.edges :])
            below = np.flatnonzero(root != np.arange(len(root)))
            self.src, self.dst, self.edges = [], [], 0
            yield both.dictionary.take(pa.array(below)), both.dictionary.take(pa.array(root[below]))

    def totals(self, last: bool = False) -> Iterator[tuple[pa.Array, pa.Array]]:
        """(node, sum) of the sums so far."""
        if self.nodes and (last or self.nodes >= self.most):
            t = pa.table({"node": pa.chunked_array(self.node, self.kind), "n": pa.chunked_array(self.sums, pa.int64())}).group_by("node").aggregate([("n", "sum")])
            self.node, self.sums, self.nodes = [], [], 0
            yield t.column("node").combine_chunks(), t.column("n_sum").combine_chunks()


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index each index is connected with."""
    label = np.arange(n)
    while len(left):
        new = label.copy()
        np.minimum.at(new, left, label[right])
        np.minimum.at(new, right, label[left])
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label
