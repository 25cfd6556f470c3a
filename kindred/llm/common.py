"""Helpers shared by the training-data operators: tables, shared storage, folds and a vectorised word hasher."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.storage import discard, materialise, shared_dir

__all__ = ["WORD", "discard", "fold", "frugal", "hash_spans", "lowered", "materialise", "mix", "shared_dir", "shingles", "table", "text_chunks", "word_spans"]

#: Words are runs of anything but ASCII white space (one pattern for Java, Python and DuckDB).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``."""
    return F.pmod(F.crc32(key.cast("string")), F.lit(modulus))


def _give_back() -> None:
    """Return freed memory to the system: workers serve many tasks, and what one leaves is held against the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def frugal[**P, T](run: Callable[P, Iterator[T]]) -> Callable[P, Iterator[T]]:
    """A task's generator that leaves no freed memory behind in its worker."""

    @functools.wraps(run)
    def wrapped(*args: P.args, **kwargs: P.kwargs) -> Iterator[T]:
        try:
            yield from run(*args, **kwargs)
        finally:
            _give_back()

    return wrapped


# ---------------------------------------------------------------- text batches

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _odd_powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {"up": _odd_powers(_BASE, 1 << 16), "down": _odd_powers(_BASE_INV, 1 << 16)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        _powers[kind] = _odd_powers(_BASE if kind == "up" else _BASE_INV, 1 << (n - 1).bit_length())
    return _powers[kind]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def text_chunks(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Split an Arrow string column into runs of rows of about ``limit`` bytes: (first row, end row, bytes, offsets).

    A null reads as the empty text.  Rows are never cut, so one very long text makes one large run.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2] if len(column) else None
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every white-space-separated word of a chunk, in order."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = False, inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = False, inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes as they are."""
    return _LOWER[data]


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are in order and don't overlap."""
    if not len(start):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _power("up", len(data))[: len(data)], out=total[1:])
        value = (total[end] - total[start]) * _power("down", len(data))[start]
        return mix(value + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_STEP = np.random.default_rng(77).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of ``width`` words of each row: (row, hash), sorted by row, then hash.

    A row with fewer words has its whole sequence as one shingle; a row without words has none.
    """
    counts = np.bincount(rows, minlength=n_rows)
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    with np.errstate(over="ignore"):
        value = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
        for i in range(width):
            value += hashes[i : i + len(value)] * _STEP[i]
        full = rows[: len(value)] == rows[width - 1 :] if len(value) else np.zeros(0, bool)
        value, row = mix(value[full]), rows[: len(full)][full]
        short = np.flatnonzero((counts > 0) & (counts < width))
        few = np.zeros(len(short), np.uint64)
        for i in range(width - 1):
            more = counts[short] > i
            few[more] += hashes[first[short[more]] + i] * _STEP[i]
        few = mix(few ^ counts[short].astype(np.uint64))
    row, value = np.concatenate((row, short)), np.concatenate((value, few))
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    keep = np.ones(len(row), dtype=bool)
    keep[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[keep], value[keep]
