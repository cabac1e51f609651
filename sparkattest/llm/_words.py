"""Vectorised word splitting and rolling hashes over Arrow text columns.

Every function works on a slice of rows at a time, so memory follows `SLICE_BYTES`
or the longest single text, whichever is larger, and never a whole partition.
A word is a maximal run of bytes outside 0x20 and 0x09-0x0D; in UTF-8 these values
never occur inside a longer character.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_BASES = {"byte": 0x9E3779B97F4A7C15, "word": 0xC2B2AE3D27D4EB4F}
_POWERS: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse."""
    have = _POWERS.get(kind)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES)
        base, inverse = _BASES[kind], pow(_BASES[kind], -1, 2**64)
        both = []
        for factor in (base, inverse):
            p = np.full(size, factor, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = (both[0], both[1])
        if size <= 8 * SLICE_BYTES:
            _POWERS[kind] = have
    return have[0][:n], have[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 output bits (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: str) -> np.ndarray:
    """Rabin-Karp hashes of values[start:end], by differences of prefix sums."""
    power, inverse = _powers(kind, max(len(values), 1))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=sums[1:])
    safe = np.minimum(starts, max(len(values) - 1, 0))
    return mix((sums[ends] - sums[starts]) * inverse[safe] + (ends - starts).astype(np.uint64))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a text column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
#: what operators keep between the tasks of a Python worker; workers are reused by later stages
WORKER_CACHES: list[dict] = []


def trim() -> None:
    """Give back what freed arrays still hold of this worker's memory."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def forget() -> None:
    """Give back the memory that other operators left in this worker."""
    for cache in WORKER_CACHES:
        cache.clear()
    trim()


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets from 0) of row ranges of about `limit` bytes, at least one row each."""
    if any(WORKER_CACHES):
        forget()
    data, at = text_buffers(column)
    row = 0
    while row < len(at) - 1:
        last = max(int(np.searchsorted(at, at[row] + limit, "right")) - 1, row + 1)
        yield row, data[at[row] : at[last]], at[row : last + 1] - at[row]
        row = last


def ranges(batch: pa.RecordBatch, text: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs whose texts, in column `text`, have about `limit` bytes; at least one row each."""
    _, at = text_buffers(batch.column(text))
    row = 0
    while row < batch.num_rows:
        last = max(int(np.searchsorted(at, at[row] + limit, "right")) - 1, row + 1)
        yield batch.slice(row, last - row)
        row = last


class Words:
    """Word positions of a slice: byte starts and ends, and the word range of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = LOWER[data] if lower else data
        inside = ~SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.rows = np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        return rolling(_BYTE_VALUES[self.data], self.starts, self.ends, "byte")

    def windows(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word and hash of every run of `size` words of one row."""
        at = np.arange(len(hashes))
        at = at[at + size <= self.first[1:][self.rows]]
        return at, rolling(hashes, at, at + size, "word")


def planes(values: np.ndarray, width: int) -> bytes:
    """Little-endian bytes, one byte position after another, so that equal high bytes compress."""
    raw = np.ascontiguousarray(values).astype("<u8").view(np.uint8).reshape(-1, 8)
    return raw[:, :width].T.tobytes()


def from_planes(blob: np.ndarray, n: int, width: int) -> np.ndarray:
    raw = np.zeros((n, 8), np.uint8)
    raw[:, :width] = blob[: n * width].reshape(width, n).T
    return raw.reshape(-1).view("<u8")


def binary_column(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
