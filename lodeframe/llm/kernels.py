"""Vectorised byte kernels shared by the Arrow-batched operators.

Words are maximal runs of bytes other than space and 0x09-0x0D.  These bytes are
single-byte in UTF-8, so splitting bytes equals splitting code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20

#: Items of a prefix sum: bounds the memory of texts of any length.
PIECE = 1 << 20

_U64 = np.uint64
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _tables(seed: int) -> tuple[np.ndarray, int]:
    rng = np.random.default_rng(seed)
    byte_values = rng.integers(1, 2**63, 256, dtype=np.uint64) * _U64(2) + _U64(1)
    base = int(rng.integers(1, 2**61)) * 8 + 3
    return byte_values, base


_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_POWERS: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte values, base**i and base**-i modulo 2**64 for i < n at least."""
    have = _POWERS.get(seed)
    if have is None or len(have[1]) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        values, base = _tables(seed)
        inverse = pow(base, -1, 2**64)

        def run(b: int) -> np.ndarray:
            out = np.full(size, b, dtype=np.uint64)
            out[0] = 1
            return np.cumprod(out)

        have = _POWERS[seed] = (values, run(base), run(inverse))
    return have


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the word."""
    x = x ^ (x >> _U64(33))
    x = x * _U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U64(33))
    x = x * _U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U64(33))


class Words:
    """Words of consecutive rows: byte spans, and row i owns words first[i]:first[i+1]."""

    __slots__ = ("data", "first", "offsets", "starts", "stops")

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        inside = ~_WHITE[data]
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        full = offsets[1:] > offsets[:-1]
        a, b = offsets[:-1][full], offsets[1:][full] - 1
        begin[a] = inside[a]
        end[b] = inside[b]
        self.starts = np.flatnonzero(begin)
        self.stops = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def hashes(self, seed: int = 1, lower: bool = False) -> np.ndarray:
        """64-bit polynomial hash of every word, independent of its place; bytes are taken PIECE at a time."""
        out = np.zeros(len(self.starts), dtype=np.uint64)
        values, power, inverse = _powers(seed, min(PIECE, max(1, len(self.data))))
        for lo in range(0, len(self.data), PIECE):
            data = self.data[lo : lo + PIECE]
            sums = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum(values[_LOWER[data] if lower else data] * power[: len(data)], out=sums[1:])
            a, b = np.searchsorted(self.starts, (lo, lo + len(data)))
            starts, stops = self.starts[a:b] - lo, np.minimum(self.stops[a:b] - lo, len(data))
            out[a:b] = (sums[stops] - sums[starts]) * inverse[starts]
            if a and self.stops[a - 1] > lo:  # a word that began in an earlier piece
                rest = int(sums[min(int(self.stops[a - 1]) - lo, len(data))])
                out[a - 1 : a] += _U64(rest * pow(int(power[1]), lo - int(self.starts[a - 1]), 2**64) % 2**64)
        return mix64(out + (self.stops - self.starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, width: int, seed: int = 1) -> np.ndarray:
    """Hash of each run of `width` consecutive word hashes, across row borders too."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    _, base = _tables(seed + 1000)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        out = out * _U64(base) + words[i : i + n]
    return mix64(out)


def window_hashes(words: np.ndarray, width: int, seed: int = 1) -> np.ndarray:
    """shingle_hashes() for long windows, by prefix sums: cost does not depend on width."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    _, power, inverse = _powers(seed + 2000, PIECE)
    out = np.empty(n, dtype=np.uint64)
    for lo in range(0, n, PIECE - width):
        part = words[lo : lo + PIECE - 1]
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * power[: len(part)], out=sums[1:])
        k = min(PIECE - width, n - lo)
        out[lo : lo + k] = (sums[width : width + k] - sums[:k]) * inverse[:k]
    return mix64(out)


def word_slices(text: bytes, size: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """The words of a text, about `size` bytes at a time."""
    at = 0
    while at < len(text):
        found = _SPACE.search(text, at + size)
        end = found.start() if found else len(text)
        yield text[at:end].split()
        at = end


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of a string column; null is empty."""
    if len(column) == 0:
        return
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64, count=len(column) + 1, offset=8 * column.offset)
    everything = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), len(column))
        lo, hi = int(offsets[row]), int(offsets[end])
        yield row, end, everything[lo:hi], offsets[row : end + 1] - lo
        row = end
