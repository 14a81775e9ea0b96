"""What the operators of this subpackage share: tables, Arrow slices, and words as numpy arrays."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.session import configure

SLICE_BYTES = 2 << 20
"""Bytes of text that a task turns into arrays at a time."""

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Named columns of one of the given tables; others, whatever their names, are not read."""
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text")


def text_bytes(column: str = "text"):
    """The UTF-8 bytes of a text, none for a null."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows of at most SLICE_BYTES (one row at least) with the joined bytes of a binary column and their offsets."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        first = 0
        while first < batch.num_rows:
            base = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, base + SLICE_BYTES, side="right")))
            part = batch.slice(first, last - first)
            blob = np.frombuffer(b"".join(x or b"" for x in part.column(column).to_pylist()), np.uint8)
            yield part, blob, np.concatenate(([0], ends[first:last] - base))
            first = last


def tidy(run: Callable) -> Callable:
    """``run``, after which the worker gives freed memory back: workers outlive their tasks and share an executor's memory."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library; others give it back themselves
        if trim is not None:
            trim(0)

    return tidied


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(blob: np.ndarray, offsets: np.ndarray, between: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words (runs without 0x20 and 0x09-0x0D, or the bytes marked in ``between``) of joined texts."""
    if not len(blob):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    solid = ~between[blob]
    edge = np.zeros(len(blob) + 1, bool)
    edge[offsets[:-1]] = True
    before = np.concatenate(([False], solid[:-1]))
    after = np.concatenate((solid[1:], [False]))
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    edge[len(blob)] = True
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def hashes(blob: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, eight bytes at a time."""
    padded = np.concatenate((blob, np.zeros(8, np.uint8)))
    eights = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), shape=(len(blob) + 1,), strides=(1,), writeable=False)
    left = (ends - starts).astype(np.int64)
    out = mix(left.astype(np.uint64) + np.uint64((seed * 2 + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    at, live = starts.copy(), np.flatnonzero(left > 0)
    while len(live):
        n = np.minimum(left[live], 8).astype(np.uint64)
        chunk = eights[at[live]] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((np.uint64(8) - n) * np.uint64(8)))
        out[live] = mix(out[live] ^ chunk) + np.uint64(0x9E3779B97F4A7C15)
        at[live] += 8
        left[live] -= 8
        live = live[left[live] > 0]
    return out


CRC_SQL = """crc_steps AS (
  SELECT i, i AS c, 0 AS n FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM crc_steps WHERE n < 8
), crc_bytes AS (SELECT list(c ORDER BY i) AS crc_table FROM crc_steps WHERE n = 8)"""
"""CTEs of the usual CRC-32 (polynomial 0xEDB88320) for DuckDB, which has no such function; the query is WITH RECURSIVE."""


def crc_sql(text: str) -> str:
    """The CRC-32 of an expression of ASCII text, for a FROM list that holds ``crc_bytes``."""
    codes = f"list_transform(string_split({text}, ''), lambda s: CAST(ascii(s) AS BIGINT))"
    return f"xor(list_reduce(list_concat([4294967295], {codes}), lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295)"
