"""Vectorised text kernels: words, word hashes and windows of whole Arrow batches.

Everything here works on slices of about SLICE bytes (or one text, if that is longer), so a
worker's memory follows the slice and its longest text, not the partition.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 19
_MUL = 0x9E3779B97F4A7C15 | 2  # = 3 modulo 4, so that exchanging two bytes loses one bit at most
_MASK = (1 << 64) - 1


def _table(seed: int, n: int = 256) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64)


BYTES = _table(11)
MUL = np.uint64(_MUL)
INV = np.uint64(pow(_MUL, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _pow(base: np.uint64, n: int, key: str) -> np.ndarray:
    if key not in _powers or len(_powers[key]) < n:
        steps = np.full(max(n, SLICE + 1024), base, dtype=np.uint64)
        steps[0] = 1
        _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers[key][:n]


def free_name(names: list[str], name: str) -> str:
    """name, or a longer one, that no column is called."""
    taken = {n.lower() for n in names}
    while name.lower() in taken:
        name += "_"
    return name


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def separators(word_bytes=None, space=False) -> np.ndarray:
    """Table of the bytes that stand between words."""
    sep = np.zeros(256, dtype=bool)
    if space:
        sep[[0x20, *range(0x09, 0x0E)]] = True
    else:
        sep[:] = True
        sep[list(word_bytes)] = False
    return sep


#: words [^\x20\x09-\x0D]+
SPACED = separators(space=True)
#: words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, after lower-casing A-Z
ALNUM = separators([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
ALNUM[0x41:0x5B] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column (null: empty)."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of consecutive rows with about `limit` bytes of text at most."""
    if batch.num_rows == 0:
        return
    raw, off = buffers(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        yield batch.slice(at, end - at), raw[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


class Words:
    """Words of a slice: byte spans, the row of each, and the words' range of each row."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, sep: np.ndarray, lower: bool = False):
        n = len(raw)
        self.raw = LOWER[raw] if lower else raw
        self._sums = None
        on = np.zeros(n + 2, dtype=np.int8)
        on[1 : n + 1] = ~sep[raw]
        step = on[1:] - on[:-1]
        begins, ends = step == 1, step == -1
        inner = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < n)]
        cut = inner[(on[inner] == 1) & (on[inner + 1] == 1)]  # a word of one text right before one of the next
        begins[cut] = True
        ends[cut] = True
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends)
        self.first = np.searchsorted(self.start, off)  # row i has the words first[i] : first[i + 1]
        self.count = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64 bits for each word, the same for the same bytes wherever they stand."""
        return self.spans(self.start, self.end)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hashes of any byte spans."""
        n = len(self.raw)
        if self._sums is None:
            self._sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(BYTES[self.raw] * _pow(MUL, n + 1, "mul")[:n], out=self._sums[1:])
        return mix((self._sums[end] - self._sums[start]) * _pow(INV, n + 1, "inv")[start] + (end - start).astype(np.uint64))

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def lengths(self) -> np.ndarray:
        """Code points of each word."""
        lead = np.zeros(len(self.raw) + 1, dtype=np.int64)
        np.cumsum((self.raw & 0xC0) != 0x80, out=lead[1:])
        return lead[self.end] - lead[self.start]


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; the last k - 1 positions have none."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    factor = 1
    for i in range(k):
        out += hashes[i : i + n] * np.uint64(factor)
        factor = factor * _MUL & _MASK
    return mix(out + np.uint64(k))


@functools.cache
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


def lean(run):
    """run, a function for mapInArrow, that gives freed memory back when its partition ends: workers live on, idle or not."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if (trim := _trim()) is not None:
            trim(0)

    return wrapped


def arrow_rows(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
