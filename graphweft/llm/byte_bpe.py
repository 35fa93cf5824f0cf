"""Byte-level BPE encoding and decoding.

Encoding has two tiers. A minimal perfect hash over the vocabulary resolves a
pre-token that is a token itself with one probe and one comparison. For the rest
the bytes are a linked list of segments, and a heap gives the adjacent pair of
lowest rank, leftmost first, until no pair is a token: n log n for a pre-token
of n bytes, however long. Decoding joins the bytes of the ids.

The vocabulary is a fixed file; its tables (a few MB) go out with the tasks. A
text is encoded whole where it lies; nothing is shuffled.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from graphweft.llm.pretokens import Memory, blocks, numbered


class VocabularyHash:
    """A minimal perfect hash of distinct byte strings, by hash and displace.

    Keys fall into buckets of about two; a bucket of several keys keeps the
    first displacement that sends all of them to free slots, a bucket of one key
    the slot itself. There are as many slots as keys.
    """

    def __init__(self, keys: list[bytes], values: list[int]):
        self.size, self.buckets = len(keys), len(keys) // 2 + 1
        self.moves = [0] * self.buckets
        self.keys: list[bytes | None] = [None] * self.size
        self.values = [0] * self.size
        filled: list[list[int]] = [[] for _ in range(self.buckets)]
        hashes = [xxhash.xxh3_128_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            filled[h % self.buckets].append(i)
        free = bytearray(b"\1") * self.size
        for bucket in sorted(range(self.buckets), key=lambda b: -len(filled[b])):
            own = filled[bucket]
            if not own:
                break
            if len(own) == 1:
                slots = [free.index(1)]
                self.moves[bucket] = -1 - slots[0]
            else:
                move = 0
                while True:
                    slots = [self._slot(hashes[i], move) for i in own]
                    if len(set(slots)) == len(slots) and all(free[s] for s in slots):
                        break
                    move += 1
                self.moves[bucket] = move
            for i, s in zip(own, slots, strict=True):
                free[s], self.keys[s], self.values[s] = 0, keys[i], values[i]

    def _slot(self, h: int, move: int) -> int:
        x = ((h >> 64) + move * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        x = (x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        return (x >> 32) * self.size >> 32

    def get(self, key: bytes) -> int | None:
        h = xxhash.xxh3_128_intdigest(key)
        move = self.moves[h % self.buckets]
        slot = -1 - move if move < 0 else self._slot(h, move)
        return self.values[slot] if self.keys[slot] == key else None


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token by merging its bytes, lowest rank and then leftmost first."""
    n, rank = len(piece), ranks.get
    end = list(range(1, n + 1))  # of the segment that begins here, 0 if none does
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, middle, j = heappop(heap)
        if end[i] != middle or end[middle] != j:
            continue  # one of the two has grown or gone
        end[i], end[middle] = j, 0
        if j < n:
            before[j] = i
            if (r := rank(piece[i : end[j]])) is not None:
                heappush(heap, (r, i, j, end[j]))
        if (p := before[i]) >= 0 and (r := rank(piece[p:j])) is not None:
            heappush(heap, (r, p, i, j))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[dict[bytes, int], VocabularyHash]:
    """Ranks by token of a rank file (base64 token, rank), and their perfect hash."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("every single byte must be a token")
    return ranks, VocabularyHash(list(ranks), list(ranks.values()))


_MEMORY: dict[int, Memory] = {}


def _encoding(ranks: dict[bytes, int], tokens: VocabularyHash, pattern: str):
    digest = xxhash.xxh3_128_intdigest(b"".join(b"%d %d " % (len(k), v) + k for k, v in ranks.items()))

    def resolve(words: list[str]) -> list[bytes]:
        """The ids of each pre-token as packed 32-bit integers."""
        out = []
        for w in words:
            piece = w.encode()
            whole = tokens.get(piece)
            out.append(array("i", merge(piece, ranks) if whole is None else [whole]).tobytes())
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # kept from task to task of one Python worker
        ids_of = _MEMORY.setdefault(digest, Memory(resolve))
        ids_of.make = resolve
        for batch in batches:
            rest = [i for i, name in enumerate(batch.schema.names) if name != "ids"]
            for at, _, texts, split in blocks(batch["text"], pattern):
                words, code, lengths = numbered([f(t) for f, t in zip(split, texts, strict=True)])
                known = ids_of.of(words)
                sizes = np.array([len(x) for x in known], np.int64) // 4
                flat = np.frombuffer(b"".join(known), np.int32)
                first = np.cumsum(sizes) - sizes
                ends = np.cumsum(sizes[code]) if len(code) else np.empty(0, np.int64)
                total = int(ends[-1]) if len(ends) else 0
                ids = flat[np.repeat(first[code] - (ends - sizes[code]), sizes[code]) + np.arange(total)] if total else flat[:0]
                stops = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(lengths)))]
                column = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(ids, pa.int32()))
                kept = [batch.column(i).slice(at, len(texts)) for i in rest]
                yield pa.RecordBatch.from_arrays([*kept, column], [*(batch.schema.names[i] for i in rest), "ids"])

    return run


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` with a column ids (array<int>), the token ids of the whole ``text``.

    path: a rank file, read on the driver; pattern splits a text into pre-tokens
    that are encoded separately; special strings are ordinary text. All other
    columns stay; a column named ids is replaced. Null and empty texts have no
    ids (an empty array); repeated rows stay; no rows give none.
    """
    ranks, tokens = vocabulary(path)
    docs = docs.drop("ids").withColumn("text", F.col("text").cast("string"))
    schema = StructType([*docs.schema.fields, StructField("ids", ArrayType(IntegerType()))])
    return docs.mapInArrow(_encoding(ranks, tokens, pattern), schema)


def _table(ranks: dict[bytes, int]) -> list[bytes]:
    """Tokens by rank."""
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def _decoding(table: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [i for i, name in enumerate(batch.schema.names) if name != "decoded"]
            ids = batch["ids"]
            stops, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).tolist()
            empty = ids.is_null().to_pylist()
            texts = [None if gone else b"".join([table[i] for i in flat[x:y]]) for gone, x, y in zip(empty, stops[:-1], stops[1:], strict=True)]
            columns = [*(batch.column(i) for i in rest), pa.array(texts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*(batch.schema.names[i] for i in rest), "decoded"])

    return run


def decode(coded: DataFrame, path: str) -> DataFrame:
    """``coded`` with a column decoded (binary), the bytes of its ``ids``.
    Null ids decode to null, an empty array to no bytes; an id that is not in
    the vocabulary is an error."""
    ranks, _ = vocabulary(path)
    coded = coded.drop("decoded")
    return coded.mapInArrow(_decoding(_table(ranks)), StructType([*coded.schema.fields, StructField("decoded", BinaryType())]))


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``decode(encode(docs, path, pattern), path)`` in one pass, so that a task needs one Python worker."""
    ranks, tokens = vocabulary(path)
    docs = docs.drop("ids", "decoded").withColumn("text", F.col("text").cast("string"))
    code, back = _encoding(ranks, tokens, pattern), _decoding(_table(ranks))
    schema = StructType([*docs.schema.fields, StructField("ids", ArrayType(IntegerType())), StructField("decoded", BinaryType())])
    return docs.mapInArrow(lambda batches: back(code(batches)), schema)
