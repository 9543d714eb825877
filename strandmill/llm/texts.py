"""Task-side text helpers: words of UTF-8 columns as 64-bit hashes, without a Python loop per word.

A word hash is a polynomial over a random value per byte, read off one running sum per chunk, and
finished by a mixer.  Words of equal bytes have equal hashes everywhere; nothing depends on batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash: every input bit reaches every output bit (the constants are splitmix64's)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(name: str, n: int) -> np.ndarray:
    """``n`` odd 64-bit constants that belong to a name."""
    start = np.uint64(int.from_bytes(name.encode()[:8].ljust(8, b"."), "little"))
    steps = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(start + steps) | np.uint64(1)


def byte_table(separators: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(is separator, lower-cased byte) for all 256 bytes; only A-Z change case."""
    cut = np.zeros(256, dtype=bool)
    cut[np.frombuffer(separators, dtype=np.uint8)] = True
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    return cut, low


#: White space of the near-duplicate contract; the other words end at every ASCII non-alphanumeric.
BLANKS = bytes([0x20, *range(0x09, 0x0E)])
NON_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


class WordHasher:
    """Hashes of the words of texts; build one inside a task, its tables are shared by all batches."""

    def __init__(self, separators: bytes):
        self.cut, low = byte_table(separators)
        self.values = seeds("bytes", 256)[low]
        base = seeds("base", 1)[0]
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        self.up = np.cumprod(np.full(CHUNK, base, dtype=np.uint64))
        self.down = np.cumprod(np.full(CHUNK, inverse, dtype=np.uint64))

    def _grow(self, n: int) -> None:
        while len(self.up) < n:
            self.up = np.concatenate([self.up, self.up * self.up[-1]])
            self.down = np.concatenate([self.down, self.down * self.down[-1]])

    def _chunk(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, start bytes) of the words of a chunk; a word also ends at each of ``ends``."""
        self._grow(len(data) + 1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.values[data] * self.up[: len(data)], out=sums[1:])
        inside = ~self.cut[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        edge = ends[(ends > 0) & (ends < len(data))]
        first[edge] |= inside[edge]
        last[edge - 1] |= inside[edge - 1]
        at, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        return mix((sums[end] - sums[at]) * self.down[at] + (end - at).astype(np.uint64)), at

    def hashes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word hashes, word count per text) of texts that lie end to end in ``data``."""
        data = data[offsets[0]: offsets[-1]]
        offsets = offsets - offsets[0]
        found, starts, at = [], [], 0
        while at < len(data):
            end = min(at + CHUNK, len(data))
            if end < len(data):  # never inside a word, unless a text ends there
                stop = offsets[np.searchsorted(offsets, end, "right") - 1]
                if stop > at:
                    end = int(stop)
                else:
                    blank = np.flatnonzero(self.cut[data[at:end]])
                    while not len(blank) and end < len(data):
                        end = min(end + CHUNK, len(data))
                        blank = np.flatnonzero(self.cut[data[at:end]])
                    stop = offsets[np.searchsorted(offsets, at, "right")]
                    end = int(min(stop, at + blank[-1] + 1 if len(blank) else end))
            h, s = self._chunk(data[at:end], offsets[(offsets > at) & (offsets < end)] - at)
            found.append(h)
            starts.append(s + at)
            at = end
        words = np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)
        where = np.concatenate(starts) if starts else np.zeros(0, dtype=np.int64)
        edges = np.searchsorted(where, offsets)
        return words, np.diff(edges)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; a null is an empty text."""
    column = column.fill_null("").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8), offsets


def by_bytes(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cut a batch into runs of texts of about ``most`` bytes (a longer text stands alone)."""
    start = 0
    while start < len(offsets) - 1:
        stop = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
        stop = max(stop, start + 1)
        yield start, stop
        start = stop
