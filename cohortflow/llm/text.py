"""Words of whole texts as numpy arrays, for the operators that read text in Arrow batches.

A batch is cut into runs of whole rows of about ``CHUNK`` bytes, so working memory follows the chunk (or the
longest single text), not the batch. Null text counts as empty everywhere.
"""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 21
BATCH_ROWS = 1000
BATCH_BYTES = 1 << 22
SMALL_BATCH = 1 << 20  # where little memory is left beside a batch
U64 = np.uint64
LAST_ID = 2**63 - 1

# Bytes that separate words
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

# Everything but ASCII letters, digits and bytes of longer characters separates bare words
NOT_BARE = np.ones(256, bool)
NOT_BARE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_BASE = 0x9E3779B97F4A7C15
_STEP = 13  # powers of a position: one for its last bits and one for the rest, so their tables stay short


class Powers(list):
    """Tables that every process makes for itself, once for all tasks: they do not travel with the functions that use them."""

    def __reduce__(self):
        return own_powers, ()


def own_powers() -> Powers:
    place = sys.modules.setdefault("_cohortflow_worker", types.ModuleType("_cohortflow_worker"))
    return place.__dict__.setdefault("powers", Powers([np.ones(1, U64) for _ in range(4)]))


_powers = own_powers()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits (a bijection)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def byte_table(seed: int = 0, fold_case: bool = False) -> np.ndarray:
    """A 64-bit value for each byte; with ``fold_case`` A-Z have those of a-z."""
    table = mix(np.arange(1, 257, dtype=U64) * U64(_BASE) + U64(seed))
    if fold_case:
        table[65:91] = table[97:123]
    return table


BYTES = byte_table()
FOLDED = byte_table(fold_case=True)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Powers 0 to 2^_STEP - 1 of the base and of its inverse, and those of its 2^_STEP-th power as far as ``n`` positions need."""
    for k, (size, base) in enumerate(((1 << _STEP, _BASE), (1 << _STEP, pow(_BASE, -1, 2**64)), *((1 + (n >> _STEP), pow(_BASE, e << _STEP, 2**64)) for e in (1, -1)))):
        if len(_powers[k]) < size:
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return tuple(_powers)


def prefix_hash(buf: np.ndarray, table: np.ndarray = BYTES) -> np.ndarray:
    """Running polynomial sums: the hash of any span of ``buf`` is one subtraction and one product."""
    low, _, high, _ = _power_tables(len(buf))
    out = np.zeros(len(buf) + 1, U64)
    for k, a in enumerate(range(0, len(buf), 1 << _STEP)):
        part = table[buf[a : a + (1 << _STEP)]]
        part *= low[: len(part)]
        part *= high[k]
        out[a + 1 : a + 1 + len(part)] = part
    return np.cumsum(out, out=out)


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of ``buf[start:end]`` for many spans; equal bytes give equal hashes wherever they stand."""
    _, low, _, high = _power_tables(len(prefix))
    out = prefix[end]
    out -= prefix[start]
    out *= low[start & ((1 << _STEP) - 1)]
    out *= high[start >> _STEP]
    out += (end - start).astype(U64) * U64(0xC2B2AE3D27D4EB4F)
    return mix(out)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column and the n + 1 offsets of its rows."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def runs(off: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes, one row at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, j
        i = j


def chunks(batch: pa.RecordBatch, text: int = 1, size: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batch in runs of rows, each with its bytes and offsets."""
    buf, off = flat(batch.column(text))
    for i, j in runs(off, size):
        yield batch.slice(i, j - i), buf[off[i] : off[j]], off[i : j + 1] - off[i]


def words(buf: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the n + 1 positions among the words at which rows begin."""
    word = ~space[buf]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < len(buf))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, off)


def row_of(counts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(counts)), counts)


def shingles(hashes: np.ndarray, begin: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words of each row, with the row; a shorter row gives its whole sequence as one."""
    count = np.diff(begin)
    each = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    row = row_of(each)
    at = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each) + begin[:-1][row]
    out = np.zeros(len(row), U64)
    end = begin[1:][row]
    for k in range(n):
        here = at + k
        inside = here < end
        out = mix(out * U64(_BASE) + np.where(inside, hashes[np.minimum(here, max(len(hashes) - 1, 0))] if len(hashes) else U64(0), U64(k + 1)))
    return out, row


def release() -> None:
    """Give memory that is no longer used back to the system, as a Python worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)


def bound_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Set the session's Arrow batches to ``BATCH_ROWS`` rows or about ``size`` bytes at most, one row at least: texts and
    payloads are long, and a batch is held as a whole, by the JVM and by the Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def rows_with(docs: DataFrame, key: str, text: str, *more: str, size: int = BATCH_BYTES) -> DataFrame:
    """Only the wanted columns, so extra ones can neither clash nor be shuffled. Bounds the session's Arrow batches."""
    bound_batches(docs.sparkSession, size)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *more)


def known(key: str | Column = "doc_id") -> Column:
    """The id, with rows that have none behind all others."""
    return F.coalesce(F.col(key) if isinstance(key, str) else key, F.lit(LAST_ID))


def shown(key: str | Column = "doc_id") -> Column:
    """Undo ``known``."""
    return F.nullif(F.col(key) if isinstance(key, str) else key, F.lit(LAST_ID))


def kept_rows(docs: DataFrame, text: str, wanted: Callable[[np.ndarray, np.ndarray, object], np.ndarray], model: object) -> DataFrame:
    """The rows of ``docs`` for which ``wanted(bytes, offsets, model)`` holds; the model is broadcast."""
    bound_batches(docs.sparkSession, SMALL_BATCH)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in chunks(batch, place):
                yield part.filter(pa.array(wanted(buf, off, shipped.value), pa.bool_()))
        release()

    return docs.mapInArrow(run, docs.schema)
