"""Helpers that several operators share: tables cut from lineage, and vectorised word hashing over Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a worker handles at once (one longer text is handled alone).
CHUNK_BYTES = 1 << 20
#: Bytes of an Arrow batch between Spark and its Python workers while a table is written.
BATCH_BYTES, _BATCH_BYTES = str(4 << 20), "spark.sql.execution.arrow.maxBytesPerBatch"
#: Tables that operators have written, by application; and its JVM and Hadoop settings, which outlive a stopped session.
_WRITTEN: dict[str, set[str]] = {}
_STORES: dict[str, tuple] = {}
#: What this worker process remembers between tasks, by operator: dicts that may be emptied.
CACHES: list[dict] = []
#: Rows below which a key list may be broadcast; beyond it, the same join is made by shuffling.
BROADCAST_ROWS = 500_000

#: Fixed value: the white space of the word pattern [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a temporary one only in local mode where none is set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="weftline-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(path)
    return path


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and lost executors cost nothing that is done."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/weftline/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_BATCH_BYTES)
    spark.conf.set(_BATCH_BYTES, BATCH_BYTES)
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(_BATCH_BYTES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._weftline_path = path
    written(spark, path)
    return out


def written(spark: SparkSession, path: str) -> None:
    """Note a folder that is to be deleted at the end of the driver."""
    app = spark.sparkContext.applicationId
    _WRITTEN.setdefault(app, set()).add(path)
    _STORES[app] = (spark._jvm, spark._jsc.hadoopConfiguration())


def _delete(app: str, paths) -> None:
    jvm, conf = _STORES[app]
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that `materialise` has written; nothing may read them any more."""
    for t in tables:
        app = t.sparkSession.sparkContext.applicationId
        _delete(app, [t._weftline_path])
        _WRITTEN[app].discard(t._weftline_path)


@atexit.register
def discard_all() -> None:
    """Delete what is left of the tables of this driver's applications, also of those whose session has been stopped."""
    for app in [*_WRITTEN]:
        with contextlib.suppress(Exception):  # the JVM may be gone already
            _delete(app, _WRITTEN.pop(app))


def forget_caches() -> None:
    """Give back what other operators' tasks have left in this worker process."""
    if any(CACHES):
        for cache in CACHES:
            cache.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # glibc only
            ctypes.CDLL(None).malloc_trim(0)


def most_frequent(counts: DataFrame, n: str, rows: int) -> DataFrame:
    """The rows of the largest n, up to about `rows` of them: a threshold from a histogram, so nothing is sorted.

    The histogram has eight classes to a doubling; classes come whole, so fewer rows than asked for may come.
    """
    level = F.floor(F.log2(n) * 8)
    total, least = 0, None
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):  # some hundred rows
        total += r["count"]
        if total > rows:
            break
        least = r["level"]
    return counts.filter("false") if least is None else counts.filter(level >= least)


def hashed_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The `rows` rows of df with the smallest hashes of a key (all, if it has no more; ties by the key)."""
    return df.orderBy(F.xxhash64(key), key).limit(rows)


def text_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets of rows in them) of pieces of a batch; a null text counts as empty."""
    col = batch.column(column)
    if col.null_count:
        col = pc.fill_null(col, "")
    if pa.types.is_string(col.type):
        kind = np.int32
    else:
        col, kind = col.cast(pa.large_string()), np.int64
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values (public constants of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        n = max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            _POWERS[k] = p
    return _POWERS[0], _POWERS[1]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of words, and for each row the number of words before it; no word crosses rows."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = edge[:-1].copy(), edge[1:].copy()
    first[1:] |= ~inside[:-1]
    last[:-1] |= ~inside[1:]
    starts, ends = np.flatnonzero(inside & first), np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of words (A-Z lowered if asked): a polynomial over a table of byte values, then a finaliser."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_TABLE[LOWER] if lower else _TABLE)[data] * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
