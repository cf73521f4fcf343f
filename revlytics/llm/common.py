"""Helpers shared by the training-data operators: scratch tables, columns carried along, Arrow text access, word hashes."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python helper handles at a time; a longer text is taken alone.
SLICE_BYTES = 1 << 18
#: Seconds between two collections of the driver's garbage, at least.
CLEAN_SECONDS = 5
#: Spark's setting by which a query's shuffle files are deleted at its end.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BASE = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_written: list[str] = []
_clears: list = []
_cleaned = [0.0]


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where it is unset, a temporary one, but only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="scratch-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared scratch folder and read it back: cuts lineage, survives lost executors.

    The write's own shuffle files go when it ends, not when the driver's garbage happens to be collected: nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.select("*").write.option("compression", "zstd").parquet(path)  # a frame of its own, which has the setting
    finally:
        spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)
    _written.append(path)
    clean(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def clean(spark: SparkSession) -> None:
    """Have Spark drop shuffle files, broadcasts and results that nothing refers to any more.

    Its cleaner learns of them only when the driver's garbage is collected (spark.cleaner.periodicGC.interval, 30 minutes, is
    fixed when the application starts). Many short jobs leave so much meanwhile that the driver's heap grows to its limit.
    """
    now = time.monotonic()
    if now - _cleaned[0] >= CLEAN_SECONDS:
        gc.collect()
        spark._jvm.System.gc()
        _cleaned[0] = time.monotonic()


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*staged: DataFrame) -> None:
    """Delete staged tables that no frame still in use reads."""
    for df in staged:
        path = getattr(df, "scratch_path", None)
        if path in _written:
            _written.remove(path)
            _delete(df.sparkSession, path)


@contextmanager
def passing(spark: SparkSession):
    """Tables staged inside are deleted at the end; those named in the list given back stay."""
    before, keep = set(_written), []
    try:
        yield keep
    finally:
        stay = {getattr(df, "scratch_path", None) for df in keep}
        for path in [p for p in _written if p not in before and p not in stay]:
            _written.remove(path)
            _delete(spark, path)


def holding(clear: Callable[[], None]) -> None:
    """Have `clear` called when another operator's task ends in this worker: for what is kept from task to task."""
    if clear not in _clears:
        _clears.append(clear)


def release() -> None:
    """Give freed memory back to the system; workers are used again by other operators."""
    _powers.clear()
    for clear in _clears:
        clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def at(name: str) -> Column:
    """A column by its exact name."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many _ as it takes to differ from the frame's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def carried(docs: DataFrame, text_col: str) -> Column:
    """All columns but the text in one struct, so that no name of theirs meets an operator's own."""
    rest = [at(c).alias(f"c{k}") for k, c in enumerate(docs.columns) if c != text_col]
    return F.struct(*(rest or [F.lit(None).cast("int").alias("none")]))


def restored(docs: DataFrame, text_col: str, text: Column, row: str = "row") -> list[Column]:
    """The columns of docs from what `carried` made, with a text of its own."""
    return [text.alias(c) if c == text_col else F.col(row)[f"c{k}"].alias(c) for k, c in enumerate(docs.columns)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column, without copying; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        wide = np.int32
    else:
        wide = np.int64
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + n + 1].astype(np.int64)
    if column.null_count:
        column = column.fill_null("" if wide is np.int32 and pa.types.is_string(column.type) else b"")
        return utf8(column)
    body = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes each (a longer row alone)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8; null is empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, at least n of each."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            _powers[size] = np.cumprod(up), np.cumprod(down)
    return _powers[size]


def word_hashes(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of a block of texts, and the word's text."""
    if not len(low):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    space = _SPACE[low]
    begin, end = ~space, ~space
    begin[1:] &= space[:-1]
    end[:-1] &= space[1:]
    filled = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][filled], offsets[1:][filled] - 1
    begin[first], end[last] = ~space[first], ~space[last]
    begin, end = np.flatnonzero(begin), np.flatnonzero(end)
    up, down = power_table(len(low) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(low)])])
        words = (total[end + 1] - total[begin]) * down[begin]
    return words, np.searchsorted(offsets, begin, side="right") - 1


def lower(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    return _LOWER[data]
