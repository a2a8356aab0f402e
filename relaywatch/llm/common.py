"""Helpers shared by the operators: scratch tables, byte-level text hashing.

Text leaves the JVM as Arrow buffers. The numpy helpers below work on those
buffers directly, a bounded run of documents at a time, so no Python string is
made per word and memory does not follow the batch size.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from relaywatch.session import checkpoint_dir

CHUNK_BYTES = 4 << 20
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the session's Python workers, once per application.

    The driver may have found it on a path that the workers do not have.
    """
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        name = os.path.join(tempfile.mkdtemp(prefix="relaywatch-py-"), "relaywatch.zip")
        with zipfile.ZipFile(name, "w") as z:
            for folder, _, files in os.walk(os.path.join(top, "relaywatch")):
                for f in files:
                    if f.endswith(".py"):
                        z.write(os.path.join(folder, f), os.path.relpath(os.path.join(folder, f), top))
        spark.sparkContext.addPyFile(name)
    return spark


class Scratch:
    """Tables written below ``spark.checkpoint.dir``, dropped when an operator ends.

    A written table cuts the lineage: a lost executor costs its running tasks
    only. A write that fails drops them too. :meth:`keep` returns the operator's (small)
    result as a reliable checkpoint; Spark removes its files once nothing refers to it
    where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set, else the
    owner of ``spark.checkpoint.dir`` does.
    """

    def __init__(self, spark: SparkSession):
        self.spark = ship(spark)
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
        self._n = 0

    def write(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}"
        with self.dropped_on_failure():
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, df: DataFrame) -> DataFrame:
        try:
            return df.checkpoint()
        finally:
            self.drop()

    @contextmanager
    def dropped_on_failure(self) -> Iterator[None]:
        try:
            yield
        except BaseException:
            self.drop()
            raise

    def drop(self) -> None:
        jvm, jsc = self.spark._jvm, self.spark._jsc
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)


def release_memory() -> None:
    """Hand freed memory back to the system, where its allocator can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(task: Callable) -> Callable:
    """A task function over batches that releases its memory at its end: a worker process lives on, idle or for other tasks."""
    @wraps(task)
    def run(batches, *args, **options):
        yield from task(batches, *args, **options)
        release_memory()
    return run


def unused(name: str, columns: Iterable[str]) -> str:
    """``name``, or the first longer one that no column has, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null reads as empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        kind, width = np.int64, 8
    else:
        column, kind, width = column.cast(pa.string()), np.int32, 4
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, kind, n + 1, column.offset * width).astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole documents of about ``limit`` bytes: (first, last, bytes, offsets).

    A document longer than the limit makes a run of its own; it is never cut.
    """
    data, offsets = text_buffers(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


_seed = np.random.default_rng(20240131)
BYTE_KEYS = _seed.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**k and its inverse modulo 2**64 for k below n (grown on demand)."""
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, 1 << 16)
        inv = np.uint64(pow(int(BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, BASE)], dtype=np.uint64)
            _inverse = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, inv)], dtype=np.uint64)
    return _powers, _inverse


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end); equal spans hash alike."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    p, inv = powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE_KEYS[data] * p[:len(data)], out=prefix[1:])
        return mix64((prefix[ends] - prefix[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


_upper = np.arange(256, dtype=np.uint8)
_upper[65:91] += 32
LOWER = _upper                    # byte table: A-Z to a-z, the rest unchanged
_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
SPACE = _space                    # byte table: true for the six ASCII spaces


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes with ``inside[byte]``, never across documents.

    Returns (starts, ends, document of each word), in order of position.
    """
    n = len(data)
    flag = np.zeros(n + 2, bool)
    flag[1:-1] = inside[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(flag[1:] & (~flag[:-1] | first))
    ends = np.flatnonzero(flag[:-1] & (~flag[1:] | first))
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1
