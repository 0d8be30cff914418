"""Storage, Arrow and hashing helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that one vectorised step handles; a longer single text is one step of its own.
STEP_BYTES = 1 << 20
#: Rows and bytes of one Arrow batch between the JVM and a Python worker, at most.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder URI below spark.checkpoint.dir, which driver and executors share.

    Only on a local master, where every task shares the driver's disk, a temporary folder takes the place of an absent setting.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='signalmesh-')}"
    if "://" not in base and not base.startswith("file:"):
        base = f"file://{base}"
    return f"{base.rstrip('/')}/signalmesh-{uuid.uuid4().hex}"


def settle(df: DataFrame, uri: str, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage and survives lost executors."""
    df.write.mode("overwrite").parquet(f"{uri}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{uri}/{name}")


def discard(spark: SparkSession, uri: str) -> None:
    """Remove an intermediate folder through Hadoop's file system, whatever the store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def open_store(uri: str):
    """(file system, path) for a folder or file URI, as executors reach it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by rows and bytes, as texts may be long; smaller settings stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        have = int(spark.conf.get(key, None) or 0)
        if not 0 < have <= most:
            spark.conf.set(key, most)


#: The C library's number of that setting.
_MMAP_THRESHOLD = -3
#: What clears the caches that this worker process keeps across tasks, by operator.
_kept: dict[str, Callable[[], None]] = {}


def keep_only(owner: str = "", clear: Callable[[], None] | None = None) -> None:
    """At the start of a Python task: drop the caches of other operators, which the worker ran before, and return memory that earlier tasks freed."""
    others = [k for k in _kept if k != owner]
    for k in others:
        _kept.pop(k)()
    if clear is not None:
        _kept[owner] = clear
    if others:
        gc.collect()  # models and their caches refer to each other
    pa.default_memory_pool().release_unused()
    try:
        c = ctypes.CDLL(None)
        c.mallopt(_MMAP_THRESHOLD, 4 << 20)  # freed arrays of this size return to the system at once
        c.malloc_trim(0)
    except AttributeError:  # a C library without them
        pass


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string or binary column without copying; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches cut to `rows` rows at most, without copying, so that what a task makes of one stays small."""
    keep_only()
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges that hold about `limit` bytes each, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), applied to each element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mix_int(x: int) -> int:
    return int(mix64(np.array([x & (2**64 - 1)], np.uint64))[0])


_MULT = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_MULT, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, STEP_BYTES * 5 // 4)
        for k, base in enumerate((_MULT, _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table, dtype=np.uint64)
    return _powers[0], _powers[1]


_bytes = np.arange(256, dtype=np.uint64)
_bytes[65:91] += np.uint64(32)
#: A pseudo-random value for each byte; A-Z share those of a-z.
BYTE_VALUES = mix64((_bytes + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[48:58] = NOT_ALNUM[65:91] = NOT_ALNUM[97:123] = NOT_ALNUM[128:] = False


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray, hashed: bool = True):
    """(start, end, row, hash) of each word of the rows, positions relative to offsets[0].

    Words are maximal runs of bytes outside `separator`, never across rows. The hash is a 64-bit
    polynomial over A-Z-folded bytes, the same in every process.
    """
    base = int(offsets[0])
    data, at = data[base : int(offsets[-1])], offsets - base
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    inside = ~separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    left = inside.copy()
    left[1:] &= ~inside[:-1] | edge[1:-1]
    right = inside.copy()
    right[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(left), np.flatnonzero(right) + 1
    row = np.searchsorted(at, start, "right") - 1
    if not hashed:
        return start, end, row, None
    power, inverse = _power_tables(len(data) + 1)
    total = BYTE_VALUES[data]
    total *= power[: len(data)]
    np.cumsum(total, out=total)
    h = total[end - 1]
    first = start > 0
    h[first] -= total[start[first] - 1]
    h *= inverse[start]
    h += (end - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return start, end, row, mix64(h)


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n consecutive elements, by doubling: len(h) - n + 1 of them."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    mult = np.uint64(0xFF51AFD7ED558CCD)
    out, size, power, have = None, 1, h, 0
    scale = mult
    while True:
        if n & size:
            if out is None:
                out, have = power, size
            else:  # what is held goes to the left, the next power to its right
                shift = np.uint64(pow(int(mult), size, 2**64))
                m = min(len(out), len(power) - have)
                out, have = out[:m] * shift + power[have : have + m], have + size
        if size * 2 > n:
            break
        power = power[:-size] * scale + power[size:]
        scale = np.uint64(pow(int(scale), 2, 2**64))
        size *= 2
    return mix64(out[: len(h) - n + 1])
