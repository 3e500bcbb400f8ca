"""Vectorised words and word hashes over Arrow text columns.

Texts are handled as UTF-8 bytes.  A word class is a set of bytes, so both
classes in use (everything but ASCII white space; digits, letters and
everything beyond ASCII) split texts exactly as their regular expressions do
on code points.  Hashes are polynomials over the bytes of a word, taken for a
whole slice of documents at once, then mixed.  A slice holds about a megabyte
of text; one longer document is read piece by piece, so memory stays a small
multiple of the longest document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20

#: Arrow batches sent to Python hold at most this many bytes.
BATCH_BYTES = 8 << 20

_PRIME = np.uint64(0x9E3779B97F4A7C15 | 1)
_PRIME2 = np.uint64(0xC2B2AE3D27D4EB4F | 1)


def _lut(words: bytes | None) -> np.ndarray:
    table = np.ones(256, bool)
    if words is None:
        table[[0x20, *range(0x09, 0x0E)]] = False
    else:
        table[:128] = False
        table[list(words)] = True
    return table


#: Words are runs of bytes other than ASCII white space.
SPACE = _lut(None)
#: Words are runs of digits, lower-case letters and bytes beyond ASCII (after lower-casing).
ALNUM = _lut(b"0123456789abcdefghijklmnopqrstuvwxyz")

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of an odd multiplier and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.inverse = int(base), pow(int(base), -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def __reduce__(self) -> tuple:
        return _Powers, (np.uint64(self.base),)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, PIECE + 4096)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (np.uint64(self.base), np.uint64(self.inverse)))
        return self.up[:n], self.down[:n]


_POWERS = (_Powers(_PRIME), _Powers(_PRIME2))


class Words:
    """Words of a slice of documents: byte spans, hashes and the first word of each document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word: np.ndarray, lower: bool, hashes: int) -> None:
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets
        n = len(data)
        self.is_word = inside = word[self.data]
        bound = np.zeros(n + 1, bool)
        bound[offsets] = True
        first = inside & bound[:-1]
        first[1:] |= inside[1:] & ~inside[:-1]
        last = inside & bound[1:]
        last[:-1] |= inside[:-1] & ~inside[1:]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.of = np.searchsorted(self.start, offsets)
        self.hashes = [np.zeros(len(self.start), np.uint64) for _ in range(hashes)]
        at = 0
        while hashes and at < len(self.start):
            begin = self.start[at]
            to = max(at + 1, int(np.searchsorted(self.end, begin + PIECE, "right")))
            piece = self.data[begin : self.end[to - 1]].astype(np.uint64) + np.uint64(1)
            a, b = self.start[at:to] - begin, self.end[at:to] - begin
            for out, powers in zip(self.hashes, _POWERS, strict=False):
                up, down = powers.get(len(piece) + 1)
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(piece * up[: len(piece)])])
                out[at:to] = mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
            at = to

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.of)

    @property
    def doc(self) -> np.ndarray:
        """The document of each word, as an index into the slice."""
        return np.repeat(np.arange(len(self.of) - 1), self.counts)

    def grams(self, n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Positions at which n words of one document start, and the hashes of those n words."""
        h = self.hashes[which]
        if len(h) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        left = np.repeat(self.of[1:], self.counts) - np.arange(len(h))
        at = np.flatnonzero(left >= n)
        return at, roll(h, n)[at]


def roll(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n values from each place on; the last n - 1 places hold what is left."""
    out = np.zeros(len(h), np.uint64)
    for k in range(n):
        out[: len(h) - k] += (h[k:] + np.uint64(k + 1)) * np.uint64((2 * k + 1) * 0xD6E8FEB86659FD93 % (1 << 64) | 1)
    return mix(out)


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null is empty."""
    values = pc.fill_null(batch.column(batch.schema.get_field_index(name)), "")
    kind = np.int64 if pa.types.is_large_string(values.type) else np.int32
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(values.buffers()[1], kind)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = values.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, name: str, most: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows with about `most` bytes of text."""
    data, offsets = column(batch, name)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, to, data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
        row = to


def words(data: np.ndarray, offsets: np.ndarray, word: np.ndarray = SPACE, lower: bool = False, hashes: int = 1) -> Words:
    return Words(data, offsets, word, lower, hashes)


def per_doc_sum(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Sums of the values between consecutive offsets."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[of[1:]] - total[of[:-1]]
