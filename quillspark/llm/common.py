"""Shared pieces: tables, registration, and byte arrays of text columns for vectorised work inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SLICE_BYTES = 3 << 18
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_TEXTS = 2000
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_MOST = 8 << 20


def for_long_texts(fn):
    """``fn(spark, ...)`` with Arrow batches of at most BATCH_TEXTS rows and about BATCH_MOST bytes from then on in the session.

    Texts are long, and the JVM and the Python worker both hold whole batches.
    """

    @wraps(fn)
    def run(spark, *args):
        if not 0 < int(spark.conf.get(BATCH_ROWS)) <= BATCH_TEXTS:
            spark.conf.set(BATCH_ROWS, BATCH_TEXTS)
        spark.conf.set(BATCH_BYTES, BATCH_MOST)
        return fn(spark, *args)

    return run


def query(name: str, sql: str | None = None):
    def register(fn):
        fn = for_long_texts(fn)
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its row offsets, from 0; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of at most ``most`` bytes (or one row), with their bytes and offsets."""
    data, offsets = buffers(column)
    start, rows = 0, len(offsets) - 1
    while start < rows:
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(max(end, start + 1), rows)
        yield start, end, data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
        start = end


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly; a bijection."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, count: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < count:
        grown = np.full(max(count, 1 << 16), base, dtype=np.uint64)
        grown[0] = 1
        have = np.cumprod(grown, dtype=np.uint64)
        if count <= 4 << 20:
            _POWERS[base] = have
    return have[:count]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of a slice and each row's first word; words never cross rows.

    A word is a run of bytes outside ``[\\x20\\x09-\\x0D]`` with A-Z lowered. The hash is a polynomial
    over 64-bit byte values, so it depends on the word alone and not on its place.
    """
    n = len(data)
    starts, ends = word_bounds(data, offsets)
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUES[LOWER[data]] * powers(INVERSE, n), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(BASE, n)[starts]), first


def word_bounds(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes not marked in ``outside``; runs never cross rows."""
    n = len(data)
    inside = ~outside[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends


def remainder(ids: np.ndarray, modulus: int) -> np.ndarray:
    """crc32 of the ids written as text, modulo ``modulus``."""
    import zlib

    return np.fromiter((zlib.crc32(str(i).encode()) % modulus for i in ids), dtype=np.int64, count=len(ids))
