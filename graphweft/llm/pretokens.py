"""Pre-tokens of blocks of texts, numbered once per block."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

from graphweft.llm.words import slices

#: Text of one block; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20
#: Pre-tokens whose result is carried on to the next block of a task; this changes no result.
KEPT = 300_000
#: Texts whose bytes stay at or below this lead byte hold code points under NARROW only.
NARROW, NARROW_BYTE = 0x240, 0xC8


@lru_cache(maxsize=4)
def splitters(pattern: str) -> tuple[Callable[[str], list[str]], Callable[[str], list[str]]]:
    """Two functions that give all matches of a pattern: for texts of code points
    under ``NARROW``, and for any. The first is the same pattern with its
    character classes written out, which the faster ``re`` can take."""
    spelled, depth = [], 0
    for part in re.findall(r"\\[pP]\{\w+\}|\\.|.", pattern, re.S):
        if part[0] == "\\" and part[1] in "pPsS":
            low = part[1].lower() + part[2:]
            chars = "".join(f"\\u{c:04x}" for c in range(NARROW) if regex.match("\\" + low, chr(c)))
            if part[1].isupper() and depth:
                return (regex.compile(pattern).findall,) * 2
            part = chars if depth else f"[{'^' * part[1].isupper()}{chars}]"
        depth += (part == "[") - (part == "]")
        spelled.append(part)
    return re.compile("".join(spelled)).findall, regex.compile(pattern).findall


def blocks(column: pa.Array, pattern: str) -> Iterator[tuple[int, np.ndarray, list[str], list[Callable[[str], list[str]]]]]:
    """(index of the first text, byte lengths, texts, the function that splits
    each) of each block; nulls are empty texts."""
    narrow, wide = splitters(pattern)
    for at, data, offsets in slices(column, BLOCK_BYTES):
        raw, sizes = data.tobytes(), np.diff(offsets)
        texts = [raw[x:y].decode() for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
        high = np.zeros(len(texts), bool)
        high[np.searchsorted(offsets, np.flatnonzero(data > NARROW_BYTE), "right") - 1] = True
        yield at, sizes, texts, [wide if h else narrow for h in high]


def numbered(found: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct pre-tokens of a block, the number of each occurrence, and occurrences per text."""
    numbers: dict[str, int] = {}
    lengths = np.array([len(x) for x in found], np.int64)
    # len(numbers) is the next number only for a pre-token not seen before
    code = np.fromiter((numbers.setdefault(p, len(numbers)) for x in found for p in x), np.int64, int(lengths.sum()))
    return list(numbers), code, lengths


class Memory:
    """Results by pre-token, made in one call for those not known, bounded by ``KEPT``."""

    def __init__(self, make: Callable[[list[str]], list]):
        self.make, self.known = make, {}

    def of(self, words: list[str]) -> list:
        known = self.known
        fresh = [w for w in words if w not in known]
        if len(known) + len(fresh) > KEPT:
            known = self.known = {w: known[w] for w in words if w in known}
        if fresh:
            known.update(zip(fresh, self.make(fresh), strict=True))
        return [known[w] for w in words]
