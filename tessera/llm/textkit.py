"""Vectorised text primitives shared by the corpus operators.

Texts arrive as Arrow batches; everything below works on their UTF-8 buffers
with numpy, so cost is per byte and never per Python object.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text handled at once by a worker; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
_RUN = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MULT = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)
_LENGTH = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def release() -> None:
    """Give freed memory back to the system: an idle worker stays alive beside the next stage's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def blocks(batches: Iterator[pa.RecordBatch], text: str, budget: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``budget`` bytes of text each, one row at least."""
    for batch in batches:
        _, off = utf8(batch.column(text))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + budget, side="right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi
    release()


def map_blocks(df: DataFrame, text: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, budget: int = BLOCK_BYTES) -> DataFrame:
    """``mapInArrow`` over text blocks of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text, budget):
            out = fn(block)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def words(data: np.ndarray, off: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of bytes other than ``gaps`` (space and 0x09-0x0D); rows never share a word."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    ink = ~gaps[data]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    edges = off[1:-1]
    edges = edges[edges < len(data)]
    first[edges] = ink[edges]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    edges = off[1:-1] - 1
    edges = edges[edges >= 0]
    last[edges] = ink[edges]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def _powers(n: int, base: int, cache: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    have = cache.get(base)
    if have is None or len(have) <= n:
        p = np.full(max(n, _RUN) + 1, base, np.uint64)
        p[0] = 1
        have = cache[base] = np.multiply.accumulate(p)
    return have


_INVERSE = pow(_MULT, -1, 2**64)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hash of each word, lower-cased (A-Z) if ``fold``: prefix sums of a byte polynomial, taken run by run."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + _RUN, side="right")))
        lo, hi = int(start[i]), int(end[j - 1])
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTES[LOWER[data[lo:hi]] if fold else data[lo:hi]] * _powers(hi - lo, _MULT)[: hi - lo], out=sums[1:])
        s, e = start[i:j] - lo, end[i:j] - lo
        out[i:j] = mix((sums[e] - sums[s]) * _powers(hi - lo, _INVERSE)[s] + (e - s).astype(np.uint64) * _LENGTH)
        i = j
    return out


def row_bounds(row: np.ndarray, n: int) -> np.ndarray:
    """Offsets of each row's entries in an array sorted by row."""
    return np.searchsorted(row, np.arange(n + 1))


def texts(column: pa.Array) -> list[bytes]:
    """Each row's UTF-8 bytes; null is empty."""
    data, off = utf8(column)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
