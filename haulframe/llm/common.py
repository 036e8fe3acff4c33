"""Helpers that several operators share: tables, row keys, Arrow text as numpy.

Texts reach the Python tasks as Arrow batches.  The helpers hand them on as one
byte array with offsets, so that the work on them is vectorised over a slice of
documents, and cut batches into slices of bounded size, so that memory does not
grow with the batch or the partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulframe.sources.scratch import broadcast_limit, materialize_measured

#: Bytes of text that a task works on at once (one longer text is worked on alone).
SLICE_BYTES = 2 << 20
#: Bytes of an Arrow batch where memory is short, and the setting for it.
BATCH_BYTES = 8 << 20
BATCH_BYTES_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"

_MASK = (1 << 64) - 1
_MULT = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_MULT, -1, 1 << 64)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the shared tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def row_key(*columns: Column) -> list[Column]:
    """A 128-bit key of a row as two non-null longs named ``k1`` and ``k2``.

    Equal rows share the key and so every result that is joined by it.
    """
    return [
        F.xxhash64(*columns).alias("k1"),
        F.xxhash64(F.lit(7), *columns).alias("k2"),
    ]


def by_row(rows: DataFrame, id: str, text: str, found: DataFrame, how: str) -> DataFrame:
    """Join results per row key (k1, k2) to the rows; their columns start with two lines.

    No column of the rows can clash with a name of the results.
    """
    k1, k2 = row_key(F.col(id), F.col(text))
    keys = {"k1": "__row_k1", "k2": "__row_k2"}
    keyed = rows.withColumns({"__row_k1": k1, "__row_k2": k2})
    joined = keyed.join(found.withColumnsRenamed(keys), list(keys.values()), how)
    return joined.drop(*keys.values())


def by_place(df: DataFrame, kept: list[str], *added: Column) -> DataFrame:
    """The kept columns, then the added ones, named c0, c1, ...

    Python tasks take them by place, so names may hold dots or clash.
    """
    columns = [*(F.col(f"`{name}`") for name in kept), *added]
    return df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)])


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> Iterator[None]:
    """While open, tables written get Arrow batches of at most ``size`` bytes into Python tasks.

    Spark's own bound is 64 MB, of which a task and its Python worker hold several.
    """
    before = spark.conf.get(BATCH_BYTES_KEY)
    spark.conf.set(BATCH_BYTES_KEY, str(size))
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES_KEY, before)


def bounded(df: DataFrame) -> DataFrame:
    """Write a table and mark it for copying if its measured size allows."""
    written, size = materialize_measured(df)
    return F.broadcast(written) if size <= broadcast_limit(df.sparkSession) else written


def ascii_lower(text: Column) -> Column:
    """Only A-Z in lower case; other letters stay as they are."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n+1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    size = int(at[-1] - at[0])
    raw = np.frombuffer(data, np.uint8, size, int(at[0])) if size else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, of one row at least."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end
        row = end


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising hash of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    """Another hash of the same values for each seed."""
    return mix(x + np.uint64((seed * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) & _MASK))


_BYTE = seeded(np.arange(256, dtype=np.uint64), 11) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(n, SLICE_BYTES + 1)
        known = np.full(size, base, np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        _powers[base] = known
    return known[:n]


class SpanHash:
    """64-bit hashes of any spans of a byte array, from one running sum."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _power(_MULT, len(data)), out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        back = _power(_INVERSE, len(self.sums))
        plain = (self.sums[ends] - self.sums[starts]) * back[starts]
        return mix(plain + (ends - starts).astype(np.uint64) * np.uint64(_MULT))


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes above white space and control codes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = data > 32
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
