"""Vectorised helpers over the bytes of many texts at once.

A task reads Arrow batches; ``slices`` cuts them into runs of whole texts of a
few megabytes, so that the numpy arrays of a task stay small whatever the batch
size.  A single text longer than that makes a slice of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1_000_000
#: Base of the rolling hash and its inverse modulo 2**64 (any odd number has one).
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

_tables: dict[str, np.ndarray] = {}
#: What a worker keeps from task to task (encoders), by the name of what keeps it.
caches: dict[str, dict] = {}


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive runs of texts; a null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not len(column):
        return
    large = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(large)
    if column.null_count:
        column = pc.fill_null(column, b"" if large == pa.large_binary() else "")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), len(column))
        yield at, end, data[offsets[at]: offsets[end]], offsets[at: end + 1] - offsets[at]
        at = end


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n + 1:
        size = n + n // 4 + 1
        with np.errstate(over="ignore"):
            for name, b in (("up", BASE), ("down", INVERSE)):
                steps = np.full(size, b, np.uint64)
                steps[0] = 1
                _tables[name] = np.multiply.accumulate(steps)
    return _tables["up"], _tables["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising bit mixer on unsigned 64-bit integers (a bijection)."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(32))
        h = h * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running sums from which ``span_hash`` reads the hash of any byte range."""
    up, _ = _powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit content hash of each byte range [start, end), independent of its place."""
    _, down = _powers(len(prefix) - 1)
    with np.errstate(over="ignore"):
        h = (prefix[end] - prefix[start]) * down[start]
        return mix(h + np.asarray(end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of true values."""
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def words(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each run of bytes for which the table ``in_word`` is true; no word spans two texts."""
    mask = in_word[data]
    starts = np.zeros(len(data) + 1, bool)
    starts[offsets] = True
    first = mask & (starts[:-1] | ~np.concatenate(([False], mask[:-1])))
    last = mask & (starts[1:] | ~np.concatenate((mask[1:], [False])))
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(offsets, begin, side="right") - 1


def sums_by(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(group, weights=values, minlength=n)


def release(used: str = "") -> None:
    """Empties the tables and the caches but the one that this task uses, and gives freed memory back to the system: a worker outlives
    its task and its operator, and would keep both."""
    for name, cache in caches.items():
        if name != used:
            cache.clear()
    _tables.clear()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: nothing to give back
    pa.default_memory_pool().release_unused()
