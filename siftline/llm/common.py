"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch: long texts must not meet in one batch by the ten thousand.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20

_own_dir: list[str] = []
#: What save() has written inside each open temporary().
_open: list[list] = []


def tune(spark: SparkSession) -> SparkSession:
    """Bound the size of the Arrow batches that go to Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session may go without it (tests); it gets a folder of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="siftline-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return "file://" + _own_dir[0]


def save(df: DataFrame, tag: str) -> DataFrame:
    """Write a table into the shared folder and read it back: this cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    for block in _open:
        block.append((spark, path))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._siftline_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def forget(df: DataFrame | None) -> None:
    """Delete a table written by save() that nothing reads any more."""
    path = getattr(df, "_siftline_path", None)
    if path:
        _delete(df.sparkSession, path)


@contextmanager
def temporary() -> Iterator[None]:
    """On the way out delete all tables saved inside but the last: for a block that ends by saving its result."""
    saved: list[tuple[SparkSession, str]] = []
    _open.append(saved)
    try:
        yield
    finally:
        _open.pop()
        for spark, path in saved[:-1]:
            _delete(spark, path)


#: Rows of keys that are sent to every executor, at most (some 20 MB).
SMALL_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """A written table of a few keys a row, marked for a broadcast if its counted rows allow that; else a shuffle joins it."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop input columns whose names (in any case) clash with those an operator adds."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold_of(doc_id: str, k: int) -> F.Column:
    """crc32 of the id as text, modulo k; null ids get null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(k)


_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element, modulo 2**64."""
    x = np.asarray(x, np.uint64) + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def int_lists(column: pa.ListArray) -> list[list[int] | None]:
    """The rows of a list column of numbers; to_pylist() would make a scalar object of every number."""
    flat = column.flatten()
    if flat.null_count:
        return column.to_pylist()
    values = flat.to_numpy(zero_copy_only=False).tolist()
    ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
    out: list[list[int] | None] = [values[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    if column.null_count:
        for i in np.flatnonzero(column.is_null().to_numpy(zero_copy_only=False)).tolist():
            out[i] = None
    return out


#: By module, how to drop what it keeps in a worker.
kept: dict[str, Callable[[], None]] = {}


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same step of mapInArrow, with a worker that gives freed memory back when a task ends.

    Workers are reused by all later stages; what their allocators hold on to
    would add up over a pipeline. What a module keeps between tasks (kept) goes
    when a task of another module begins.
    """

    def wrapped(batches: Iterator) -> Iterator:
        from siftline.llm.common import kept  # the worker's own, not a copy that came with this function

        for module in [m for m in kept if m != run.__module__]:
            kept.pop(module)()
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped


def runs(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Cut a list into consecutive slices of at most `most` in sum, or of one element."""
    out, begin, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            out.append((begin, i))
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        out.append((begin, len(sizes)))
    return out
