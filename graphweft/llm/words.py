"""Words and word shingles of whole texts as numpy arrays, for use inside tasks.

A word is a run of bytes other than space and 0x09-0x0D, A-Z lowered on
request. Words and shingles are held as 64-bit hashes: two different shingles
of one comparison are taken for equal once in about 10^13 comparisons of texts
of a thousand words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORD_CLASS = r"[^\x20\x09-\x0D]+"
SPACE_CLASS = r"[\x20\x09-\x0D]+"
#: Texts are taken up in slices of about so many bytes; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _STEP, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of some texts: hash, byte span, and the range of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True, space: np.ndarray = _SPACE):
        """data: UTF-8 bytes; offsets: where each text begins, and the end of the
        last; space: which bytes stand between words."""
        self.offsets = offsets
        n = len(data)
        solid = ~space[data]
        first, last = np.ones(n, bool), np.ones(n, bool)
        first[1:], last[:-1] = ~solid[:-1], ~solid[1:]
        first[offsets[offsets < n]] = True
        last[offsets[offsets > 0] - 1] = True
        self.starts = np.flatnonzero(solid & first)
        self.ends = np.flatnonzero(solid & last) + 1
        self.ranges = np.searchsorted(self.starts, offsets)
        lengths = self.ends - self.starts
        if len(lengths) == 0:
            self.hashes = np.empty(0, np.uint64)
            return
        letters = _BYTE[(_LOWER[data] if lower else data)[solid]]
        first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        place = np.arange(len(letters)) - np.repeat(first, lengths)
        letters *= _powers(int(lengths.max()))[place]
        self.hashes = mix(np.add.reduceat(letters, first) + lengths.astype(np.uint64))

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.ranges[i] : self.ranges[i + 1]]


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k words in order; a shorter text is one shingle, one without words none."""
    n = len(words)
    if n == 0:
        return words
    if n < k:
        return mix((words * _PLACE[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
    out = words[: n - k + 1] * _PLACE[0]
    for j in range(1, k):
        out += words[j : n - k + 1 + j] * _PLACE[j]
    return mix(out + np.uint64(k))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets) of runs of texts; nulls are empty texts."""
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return
    _, raw_offsets, raw = column.buffers()
    offsets = np.frombuffer(raw_offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def each_text(column: pa.Array, lower: bool = True) -> Iterator[tuple[int, np.ndarray, Words]]:
    """(index of the first text, bytes, words) of each slice of a text column."""
    for at, data, offsets in slices(column):
        yield at, data, Words(data, offsets, lower)
