"""Vectorised byte kernels over Arrow string columns.

Every kernel works on a chunk of whole texts laid end to end (``data``) with
``offsets`` marking where each text starts, so memory is bounded by the chunk
size (one text at least) and no Python loop runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64

_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUE = _rng.integers(1, 2**63, size=256, dtype=np.uint64) * _U(2) + _U(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Runs of digits, ASCII letters and non-ASCII characters (lower-cased text).
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x41:0x5B] = True
ALNUM[0x80:] = True

#: Everything but ASCII white space.
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.n, self.up, self.down = 0, np.empty(0, np.uint64), np.empty(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, CHUNK_BYTES + 1024)
            inverse = pow(_BASE, -1, 1 << 64)
            self.up, self.down = (self._run(b, self.n) for b in (_BASE, inverse))
        return self.up[:n], self.down[:n]

    @staticmethod
    def _run(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


_POWERS = _Powers()


def column_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and its n+1 offsets; nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = pc.fill_null(array, "")
    array = array.cast(pa.large_string()) if not pa.types.is_large_string(array.type) else array
    n = len(array)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, off, body = array.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[array.offset : array.offset + n + 1]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.empty(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def chunks(array: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets) with at most ``limit`` bytes, or one text."""
    data, offsets = column_bytes(array)
    n, row = len(offsets) - 1, 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def find_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = ALNUM, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of the maximal runs of word bytes; runs end with their text."""
    n = len(data)
    if n == 0:
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    inside = table[data] if mask is None else mask
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    counts = np.searchsorted(start, offsets, side="left")
    return start, end, np.repeat(np.arange(len(offsets) - 1), np.diff(counts))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, value: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """A 64-bit hash of data[start:end] for every span, by prefix sums of a polynomial."""
    n = len(data)
    up, down = _POWERS.get(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(value[data] * up[:n], out=total[1:])
    return mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the windows h[i:i+k]; windows may span texts, see ``window_ok``."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out *= _U(0x9FB21C651E98DF25)
        out += h[j : j + n] ^ (h[j : j + n] >> _U(29))
    return mix64(out)


def text_hash(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every whole text."""
    return span_hashes(data, offsets[:-1], offsets[1:])


class HashIndex:
    """An open-addressing map from distinct 64-bit keys to their place, probed in bulk."""

    def __init__(self, keys: np.ndarray, room: int = 0) -> None:
        self.n = len(keys)
        bits = max(4, int(np.ceil(np.log2(max(1, room, self.n) * 2 + 1))))
        self.mask = _U((1 << bits) - 1)
        self.slot_key = np.zeros(1 << bits, dtype=np.uint64)
        self.slot_val = np.full(1 << bits, -1, dtype=np.int64)
        self.add(np.asarray(keys, np.uint64), np.arange(self.n, dtype=np.int64))

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Insert distinct keys that aren't there yet."""
        at = (keys & self.mask).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            free = self.slot_val[at[todo]] < 0
            self.slot_val[at[todo[free]]] = values[todo[free]]  # of rivals the last one wins
            self.slot_key[at[todo[free]]] = keys[todo[free]]
            done = (self.slot_val[at[todo]] == values[todo]) & (self.slot_key[at[todo]] == keys[todo])
            todo = todo[~done]
            at[todo] = (at[todo] + 1) & int(self.mask)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of every key, -1 where there is none."""
        at = (keys & self.mask).astype(np.int64)
        out = self.slot_val[at]
        wrong = np.flatnonzero((out >= 0) & (self.slot_key[at] != keys))
        spot = at[wrong]
        while len(wrong):
            spot = (spot + 1) & int(self.mask)
            got = self.slot_val[spot]
            out[wrong] = got
            keep = (got >= 0) & (self.slot_key[spot] != keys[wrong])
            wrong, spot = wrong[keep], spot[keep]
        return out


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from flat values and the number of them in each row."""
    ends = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, type=kind))
