"""Alignment of two tokenizers over the same bytes, and how often their ids go together.

Both tokenizations of a text cover the same bytes. Offsets at which a token of
either ends are shared cuts; tokens between two neighbouring cuts are a group.
The cuts are found by divide and conquer: an interval takes the common end
nearest to the middle of its tokens, found by bisection from the middle
outwards, and both halves go on; an interval without one is a leaf, a group. All
open intervals are taken at once, level by level.

Neither tokenizer joins what a single blank parts: where a blank stands between
two other characters, both have a token that ends before it. A text is divided
there first, and each different piece of a block is encoded and searched once.

A link is a token of A and one of B that end together. Links are summed by id
pair over the corpus. A block hands on its different pairs, not its links: they
are joined to their sums, come back as one list a block, and meet the texts of
the block. No pair of ids is on more rows than there are blocks.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.llm.words import slices
from graphweft.session import Scratch

#: The piece that stands for a blank in sentence pieces.
BLANK = "▁"
#: Both tokenizers end a token before such a blank.
_PIECES = re.compile(r"(?<=\S) (?=\S)").split
#: Pieces whose alignment is carried on from block to block, and their longest; this changes no result.
KEPT, KEPT_CHARS = 200_000, 40
#: Text of one block; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
#: An id pair as one number: A * WIDTH + B.
WIDTH = 1 << 24
_ALIGNED = (
    "block long, pairs array<long>, times array<long>, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, "
    "groups_sha256 array<string>, stops array<int>, pair array<int>, often array<int>"
)


def _byte_letters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: the
    printable ones themselves, the others from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Ids by a byte-level tokenizer file; special strings are plain text.

    The file's ids are merge ranks (which is checked), so the ranks encode as the
    file does, and all pieces of a block take one call.
    """

    def __init__(self, spec_text: str, pattern: str):
        import tiktoken

        spec = json.loads(spec_text)
        kind, model = spec["pre_tokenizer"] or {}, spec["model"]
        if kind.get("type") != "ByteLevel" or kind["add_prefix_space"] or spec["normalizer"] or not kind.get("use_regex", True):
            raise ValueError("A must be byte-level, without normalizer and prefix space")
        letters = _byte_letters()
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        if [model["vocab"][m] for m in merged] != list(range(256, 256 + len(merged))) or len(ranks) != 256 + len(merged):
            raise ValueError("the ids of A must be in the order of its merges")
        self.made = tiktoken.Encoding("A", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.table = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.table[i] = token
        self.sizes = np.array([len(x) for x in self.table], np.int64)

    def flat(self, pieces: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, each behind a blank, and where each piece's
        begin. Pieces are joined by their blanks, where a token begins in any case,
        but for those that begin or end with white space, which come last."""
        odd = np.array([p[:1].isspace() or p[-1:].isspace() for p in pieces], bool)
        joined = self.made.encode_to_numpy("".join([" " + p for p, o in zip(pieces, odd.tolist(), strict=True) if not o]), disallowed_special=())
        stops = np.concatenate(([0], np.cumsum(sizes[~odd])))
        at = np.searchsorted(np.concatenate(([0], np.cumsum(self.sizes[joined]))), stops)
        alone = {i: self.made.encode_ordinary(" " + pieces[i]) for i in np.flatnonzero(odd).tolist()}
        counts = np.zeros(len(pieces), np.int64)
        counts[~odd] = np.diff(at)
        for i, ids in alone.items():
            counts[i] = len(ids)
        ranges = np.concatenate(([0], np.cumsum(counts)))
        if not alone:
            return joined.astype(np.int64), ranges
        out = np.empty(int(ranges[-1]), np.int64)
        out[np.repeat(~odd, counts)] = joined
        for i, ids in alone.items():
            out[ranges[i] : ranges[i + 1]] = ids
        return out, ranges


class SentencePieces:
    """Ids by a sentence piece model that puts one blank before a text and changes nothing else."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.made = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.made.id_to_piece(i) for i in range(self.made.get_piece_size())]
        if any(BLANK in p.lstrip(BLANK) for p in pieces):
            raise ValueError("pieces of B must not reach over a blank")
        if self.made.encode("  ﬁ  x ", out_type=str) != self.made.encode("  ﬁ", out_type=str) + [BLANK] + self.made.encode("x", out_type=str) + [BLANK]:
            raise ValueError("B must put a blank before a text and keep it as it is")
        self.table = [bytes([int(m[1], 16)]) if (m := _BYTE_PIECE.fullmatch(p)) else p.replace(BLANK, " ").encode() for p in pieces]

        self.sizes = np.array([len(x) for x in self.table], np.int64)

    def flat(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, and where each piece's begin."""
        ids = self.made.encode(pieces, num_threads=1)
        ranges = np.concatenate(([0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))))
        return np.fromiter(chain.from_iterable(ids), np.int64, int(ranges[-1])), ranges


class Pieces:
    """Alignment by piece: (tokens of A, of B, id pairs of its links as packed
    64-bit numbers, its groups written out), or None where either changes bytes."""

    def __init__(self, spec_text: str, pattern: str, model: bytes):
        self.a, self.b = ByteLevel(spec_text, pattern), SentencePieces(model)
        ids = range(max(len(self.a.table), len(self.b.table)))
        self.written = [str(i).encode() + mark for i in ids for mark in (b",", b"|", b";", b"")]
        self.known: dict[str, tuple | None] = {}

    def of(self, pieces: list[str]) -> list[tuple | None]:
        known = self.known
        fresh = [p for p in pieces if p not in known]
        if len(known) + len(fresh) > KEPT:
            wanted = set(pieces)
            known = self.known = {p: x for p, x in known.items() if p in wanted}
        made = dict(zip(fresh, self._aligned(fresh), strict=True)) if fresh else {}
        found = [known[p] if p in known else made[p] for p in pieces]
        known.update((p, x) for p, x in made.items() if len(p) <= KEPT_CHARS)
        return found

    def _aligned(self, pieces: list[str]) -> list[tuple | None]:
        want = [(" " + p).encode() for p in pieces]
        lengths = np.fromiter(map(len, want), np.int64, len(want))
        flat, ranges = map(list, zip(self.a.flat(pieces, lengths), self.b.flat(pieces), strict=True))
        (raw_a, end_a), (raw_b, end_b) = [
            # the bytes of all pieces, with the end of each
            (b"".join(map(t.table.__getitem__, ids.tolist())), np.concatenate(([0], np.cumsum(t.sizes[ids])))[stops])
            for t, ids, stops in zip((self.a, self.b), flat, ranges, strict=True)
        ]
        stops = np.concatenate(([0], np.cumsum(lengths)))
        good = np.ones(len(pieces), bool)
        if raw_a != (joined := b"".join(want)) or raw_b != joined or (end_a != stops).any() or (end_b != stops).any():
            good = np.array([raw_a[end_a[i] : end_a[i + 1]] == w == raw_b[end_b[i] : end_b[i + 1]] for i, w in enumerate(want)], bool)
            for k in (0, 1):
                sizes = np.diff(ranges[k])
                flat[k], ranges[k] = flat[k][np.repeat(good, sizes)], np.concatenate(([0], np.cumsum(np.where(good, sizes, 0))))
        (ids_a, ids_b), (ranges_a, ranges_b) = flat, ranges
        cut_a, cut_b = common_ends(np.cumsum(self.a.sizes[ids_a]), np.cumsum(self.b.sizes[ids_b]), ranges_a, ranges_b)
        # tokens are not empty, so a cut is the end of one token on either side: a group and a link
        links = (ids_a[cut_a] * WIDTH + ids_b[cut_b]).tobytes()
        at = (np.searchsorted(cut_a, ranges_a) * 8).tolist()
        groups = _written(ids_a, ids_b, ranges_a, ranges_b, cut_a, cut_b, self.written)
        n_a, n_b = np.diff(ranges_a).tolist(), np.diff(ranges_b).tolist()
        return [(x, y, links[at[i] : at[i + 1]], g) if ok else None for i, (x, y, g, ok) in enumerate(zip(n_a, n_b, groups, good.tolist(), strict=True))]


@lru_cache(maxsize=2)
def _pieces(spec_text: str, pattern: str, model: bytes) -> Pieces:
    return Pieces(spec_text, pattern, model)


def common_ends(a: np.ndarray, b: np.ndarray, a_ranges: np.ndarray, b_ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in a and b of the ends they share, in order.

    a, b: ascending ends of tokens of several texts one after another, in one
    count of bytes; a_ranges, b_ranges: where the tokens of each text begin, and
    the end of the last. The last ends of a text are shared.
    """
    full = (np.diff(a_ranges) > 0) & (np.diff(b_ranges) > 0)
    found_a, found_b = [a_ranges[1:][full] - 1], [b_ranges[1:][full] - 1]
    # an open interval: tokens from lo up to, but without, the one that ends at its own end
    lo_a, hi_a, lo_b, hi_b = a_ranges[:-1][full], found_a[0], b_ranges[:-1][full], found_b[0]
    while True:
        going = (lo_a < hi_a) & (lo_b < hi_b)
        lo_a, hi_a, lo_b, hi_b = lo_a[going], hi_a[going], lo_b[going], hi_b[going]
        if not len(lo_a):
            break
        at, place = _near_middle(a, b, lo_a, hi_a, lo_b, hi_b)
        split = at >= 0
        lo_a, hi_a, lo_b, hi_b, at, place = (x[split] for x in (lo_a, hi_a, lo_b, hi_b, at, place))
        found_a.append(at)
        found_b.append(place)
        lo_a, hi_a = np.concatenate((lo_a, at + 1)), np.concatenate((at, hi_a))
        lo_b, hi_b = np.concatenate((lo_b, place + 1)), np.concatenate((place, hi_b))
    return np.sort(np.concatenate(found_a)), np.sort(np.concatenate(found_b))


def _near_middle(a: np.ndarray, b: np.ndarray, lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each interval the position in a, and in b, of a common end close to the
    middle of its tokens of a, or -1. Rings around the middle are searched, each
    as wide as all before it."""
    n = len(lo_a)
    at, place = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    middle, open_, inner, outer = (lo_a + hi_a) // 2, np.arange(n), 0, 1
    while len(open_):
        # the two sides of the ring [middle - outer + 1, middle - inner] and [middle + inner, middle + outer - 1]
        m, low, high = middle[open_], lo_a[open_], hi_a[open_]
        first = np.concatenate((np.maximum(m - outer + 1, low), np.maximum(m + max(inner, 1), low)))
        stop = np.concatenate((np.minimum(m - inner + 1, high), np.minimum(m + outer, high)))
        sizes = np.maximum(stop - first, 0)
        owner = np.repeat(np.concatenate((open_, open_)), sizes)
        tried = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        spot = np.searchsorted(b, a[tried])
        good = (spot >= lo_b[owner]) & (spot < hi_b[owner])
        good[good] = b[spot[good]] == a[tried[good]]
        owner, tried, spot = owner[good], tried[good], spot[good]
        nearest = np.lexsort((tried, np.abs(tried - middle[owner]), owner))
        owner, tried, spot = owner[nearest], tried[nearest], spot[nearest]
        first_of = np.ones(len(owner), bool)
        first_of[1:] = owner[1:] != owner[:-1]
        at[owner[first_of]], place[owner[first_of]] = tried[first_of], spot[first_of]
        open_ = open_[(at[open_] < 0) & ((m - outer + 1 > low) | (m + outer < high))]
        inner, outer = outer, 2 * outer
    return at, place


def _written(ids_a: np.ndarray, ids_b: np.ndarray, a_ranges: np.ndarray, b_ranges: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, numbers: list[bytes]) -> list[bytes]:
    """The groups of each piece, written out as ids of A, ``|``, ids of B, groups apart by ``;``."""
    n_a, n_b = np.diff(cut_a, prepend=-1), np.diff(cut_b, prepend=-1)
    order = np.empty(len(ids_a) + len(ids_b), np.int64)
    mark = np.zeros(len(order), np.int64)  # , | ; or nothing behind an id
    before_b = np.repeat(np.cumsum(n_b) - n_b, n_a)  # tokens of B in earlier groups
    upto_a = np.repeat(np.cumsum(n_a), n_b)  # tokens of A up to this group
    place_a, place_b = np.arange(len(ids_a)) + before_b, np.arange(len(ids_b)) + upto_a
    order[place_a], order[place_b] = ids_a, ids_b
    mark[place_a[cut_a]], mark[place_b[cut_b]] = 1, 2
    stops = a_ranges + b_ranges
    mark[stops[1:][np.diff(stops) > 0] - 1] = 3
    parts = list(map(numbers.__getitem__, (order * 4 + mark).tolist()))
    stops = stops.tolist()
    return [b"".join(parts[x:y]) for x, y in zip(stops[:-1], stops[1:], strict=True)]


def _numbered(found: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different pieces of a block, the number of each occurrence, and where each text's begin."""
    numbers = {p: i for i, p in enumerate(dict.fromkeys(chain.from_iterable(found)))}
    stops = np.concatenate(([0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))))
    return list(numbers), np.fromiter(map(numbers.__getitem__, chain.from_iterable(found)), np.int64, int(stops[-1])), stops


def _aligning(spec_text: str, pattern: str, model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _pieces(spec_text, pattern, model)
        number = (TaskContext.get().partitionId() << 32) if TaskContext.get() else 0
        for batch in batches:
            for at, data, offsets in slices(batch["text"], BLOCK_BYTES):
                raw = data.tobytes()
                found = [_PIECES(t) if (t := raw[x:y].decode()) else [] for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
                pieces, code, stops = _numbered(found)
                known = aligner.of(pieces)
                broken = np.array([k is None for k in known], bool)
                if broken.any():  # their texts have no tokens
                    lost = np.diff(np.concatenate(([0], np.cumsum(broken[code])))[stops]) > 0
                    keep = np.repeat(~lost, np.diff(stops))
                    code, stops = code[keep], np.concatenate(([0], np.cumsum(np.where(lost, 0, np.diff(stops)))))
                    used = np.unique(code)
                    code, known = np.searchsorted(used, code), [known[i] for i in used]
                n_a, n_b, links, groups = zip(*known, strict=True) if known else ((),) * 4
                sizes = np.fromiter(map(len, links), np.int64, len(links)) // 8
                pairs, link = np.unique(np.frombuffer(b"".join(links), np.int64), return_inverse=True)
                seen = np.bincount(code, minlength=len(known))
                times = np.bincount(link, np.repeat(seen, sizes), len(pairs)).astype(np.int64)
                total = lambda x: np.diff(np.concatenate(([0], np.cumsum(np.array(x, np.int64)[code])))[stops])  # noqa: B023, E731
                # the links of each text by pair: of its different pieces, as often as they occur
                own, often = np.unique(np.repeat(np.arange(len(found)), np.diff(stops)) * max(1, len(known)) + code, return_counts=True)
                text, piece = np.divmod(own, max(1, len(known)))
                first, each = (np.cumsum(sizes) - sizes)[piece], sizes[piece]
                spread = np.repeat(first - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
                of_text = np.repeat(text, each) * max(1, len(pairs)) + link[spread]
                sorter = np.argsort(of_text)
                of_text, often = of_text[sorter], np.repeat(often, each)[sorter]
                begins = np.flatnonzero(np.diff(of_text, prepend=-1))
                of_text, often = of_text[begins], np.add.reduceat(often, begins) if len(begins) else often
                order, spots = list(map(groups.__getitem__, code.tolist())), stops.tolist()
                yield pa.RecordBatch.from_pylist([{
                    "block": number, "pairs": pairs, "times": times, "doc_id": batch["doc_id"].slice(at, len(found)).to_pylist(),
                    "n_a": total(n_a), "n_b": total(n_b), "n_groups": total(sizes),
                    "groups_sha256": [hashlib.sha256(b";".join(order[x:y])).hexdigest() if y > x else "" for x, y in zip(spots[:-1], spots[1:], strict=True)],
                    "stops": np.searchsorted(of_text, np.arange(len(found) + 1) * max(1, len(pairs))).astype(np.int32),
                    "pair": (of_text % max(1, len(pairs))).astype(np.int32), "often": often.astype(np.int32),
                }], schema=_SCHEMA)
                number += 1

    return run


_LONGS, _INTS = pa.list_(pa.int64()), pa.list_(pa.int32())
_SCHEMA = pa.schema(
    [("block", pa.int64()), *((c, _LONGS) for c in ("pairs", "times", "doc_id", "n_a", "n_b", "n_groups")), ("groups_sha256", pa.list_(pa.string()))]
    + [(c, _INTS) for c in ("stops", "pair", "often")]
)


def _summing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the texts of each block, with the corpus-wide counts of their links."""
    for batch in batches:
        for r in range(batch.num_rows):
            get = lambda name: batch[name][r].values  # noqa: B023, E731
            held = batch["known"][r].is_valid
            place, count, best = (get("known").field(c).to_numpy(zero_copy_only=False) if held else np.empty(0, np.int64) for c in ("place", "count", "best"))
            counts, is_best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
            counts[place], is_best[place] = count, best
            pair, often, stops = (get(c).to_numpy() for c in ("pair", "often", "stops"))
            sums = [pa.array(np.diff(np.concatenate(([0], np.cumsum(often * x[pair])))[stops])) for x in (is_best, counts)]
            rows = [get(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_groups")]
            yield pa.RecordBatch.from_arrays([*rows, *sums, get("groups_sha256")], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def aligned(docs: DataFrame, path_a: str, pattern: str, path_b: str) -> DataFrame:
    """One row per row of ``docs`` (doc_id long, text; other columns are ignored):
    doc_id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose id pair has
    the highest count of all pairs with its B id, ties included), count_sum (over
    links) and groups_sha256 (of all groups, written out as decimal ids).

    path_a: a byte-level tokenizer file, which gets a blank before the text;
    pattern: its pre-token pattern; path_b: a sentence piece model, which adds the
    blank itself. Both are read on the driver. Special strings in a text are plain.

    Null and empty texts, and those whose bytes either tokenizer changes, have
    zeros and ''. Repeated rows and null ids stay, and their links count again;
    no rows give none. A text longer than a block is a block of its own; its
    row has its different id pairs, not its links.
    """
    spec_text, model = Path(path_a).read_text(encoding="utf-8"), Path(path_b).read_bytes()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scratch = Scratch(docs.sparkSession)
    # written, so that the numbers of blocks stay as they are when a task is run again
    made = scratch.write(docs.mapInArrow(_aligning(spec_text, pattern, model), _ALIGNED), "aligned")
    flat = made.select("block", F.posexplode(F.arrays_zip("pairs", "times")).alias("place", "own"))
    flat = flat.select("block", "place", F.col("own.pairs").alias("id_pair"), F.col("own.times").alias("times"))
    sums = scratch.write(flat.groupBy("id_pair").agg(F.sum("times").alias("count")), "sums")
    b = F.col("id_pair") % WIDTH
    # at most one row for each id of B
    highest = F.broadcast(sums.groupBy(b.alias("b")).agg(F.max("count").alias("highest")))
    judged = sums.withColumn("b", b).join(highest, "b").select("id_pair", "count", (F.col("count") == F.col("highest")).cast("int").alias("best"))
    known = flat.drop("times").join(judged, "id_pair").groupBy("block").agg(F.collect_list(F.struct("place", "count", "best")).alias("known"))
    rows = made.drop("pairs", "times").join(known, "block", "left")
    return rows.mapInArrow(_summing, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
