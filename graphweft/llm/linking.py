"""From shared cells to components of an exact set-similarity graph.

A candidate method puts sets into cells so that similar sets meet in at least
one. Here the pairs that meet are verified, without emitting the pairs of a cell:

1. Cells are shuffled once, as blocks of *words*: the upper bits of a word name the
   cell, the lower ``SKETCH_BITS`` are a sketch by which a method may tell members
   of a cell apart (see ``ngram_join``). A set stays in a cell with a member whose
   sketch is near its own.
2. Each set is compared with the smallest such member (one pair a set), then in
   further rounds with a member of another component of a cell of its. In a group
   of copies this already joins nearly all. Pairs are bounded by the parities of
   their sets, where these are given, before the sets themselves are fetched.
3. Cells whose members are still in more than one component are searched in
   blocks of at most ``BLOCK`` members by a packed R-tree over group counts.
   Only pairs of different components whose overlap bound, the sum of coordinate
   minima, reaches the threshold come out; they are verified exactly.

Links left out join sets that are already connected, so components are those of
the full graph over the candidate pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.llm.components import components
from graphweft.llm.words import mix
from graphweft.session import Scratch

#: Members of a cell that one task compares with one another; a larger cell is dealt over pairs of blocks.
BLOCK = 1024
#: Rounds of one comparison a set before cells are searched.
STARS = 3
#: Sets that one task compares with a copy of the same head.
HEAD_ROWS = 2048
#: Coordinates of a point at least.
LEAST_GROUPS = 64
#: Sets that a list of ids may name to have it sent to the texts; above, texts and list are shuffled.
BROADCAST_ROWS = 250_000
#: Entries of a leaf of the packed tree.
LEAF = 32
#: Lower bits of a word, and how many of them differ at most in members of a cell that are compared.
SKETCH_BITS, MOST_APART = 24, 4
#: Members of a cell whose sketches are compared with one another; in a larger cell all members stay.
SKETCHED = 2048
#: Words in a bucket, on average, and in the rows that a task holds before it sends them.
BUCKET_WORDS, SENT_WORDS = 1 << 20, 1 << 20
LEAST_BITS, MOST_BITS = 6, 16
#: Bits of the parities of a set at least.
LEAST_PARITIES = 64


def point(items: np.ndarray) -> np.ndarray:
    """How many members of a set fall into each group, as bytes. There are half as
    many groups as members or more, a power of two, so that sets of any size are
    told apart alike. Should a count not fit, all are 255, which bounds nothing."""
    groups = max(LEAST_GROUPS, 1 << max(0, len(items) // 2 - 1).bit_length())
    at = (mix(items ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(groups - 1)).astype(np.int64)
    counts = np.bincount(at, minlength=groups)
    return np.full(groups, 255, np.uint8) if counts.max(initial=0) > 255 else counts.astype(np.uint8)


def parities(items: np.ndarray) -> bytes:
    """Whether the members of a set in each group are odd in number, as bits. There are as many
    groups as members or more, a power of two. Two sets differ in as many members as bits, or more."""
    groups = max(LEAST_PARITIES, 1 << max(0, len(items) - 1).bit_length())
    at = (mix(items ^ np.uint64(0x3C79AC492BA7B653)) & np.uint64(groups - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=groups).astype(np.uint8) & 1, bitorder="little").tobytes()


def least_apart(x: bytes, y: bytes) -> int:
    """The least number of members in one of two sets only, from their parities."""
    groups = min(len(x), len(y)) * 8

    def fewer(p: bytes) -> int:
        bits, n = int.from_bytes(p, "little"), len(p) * 8
        while n > groups:
            n //= 2
            bits = (bits >> n) ^ (bits & ((1 << n) - 1))
        return bits

    return (fewer(x) ^ fewer(y)).bit_count()


def folded(points: list[bytes], groups: int) -> np.ndarray:
    """Points of as many coordinates or more, brought to ``groups`` by adding up."""
    rows = (np.frombuffer(p, np.uint8) for p in points)
    return np.stack([p if len(p) == groups else p.reshape(-1, groups).sum(0, dtype=np.uint16) for p in rows]).astype(np.uint16)


def least_overlap(total: np.ndarray, num: int, den: int) -> np.ndarray:
    """Smallest intersection of two sets of ``total`` members together that has den * both >= num * either."""
    return -(-num * total // (num + den))


def bounded_pairs(points: np.ndarray, sizes: np.ndarray, parts: np.ndarray, num: int, den: int) -> np.ndarray:
    """Index pairs (i < j in tree order) in different parts whose bound reaches
    the threshold: boxes of a packed tree first, then the points of their leaves.

    The tree packs points by size, then by their first coordinate, into leaves;
    a leaf's box is its largest value in each coordinate and its least size.
    """
    order = np.lexsort((points[:, 0], sizes))
    points, sizes, parts = points[order], sizes[order], parts[order]
    starts = np.arange(0, len(order), LEAF)
    tops = np.maximum.reduceat(points, starts)
    least, most = sizes[starts], np.maximum.reduceat(sizes, starts)
    found = []
    for x, at in enumerate(starts):
        bound = np.minimum(tops[x], tops[x:]).sum(1, dtype=np.int64)
        reach = (bound >= least_overlap(least[x] + least[x:], num, den)) & (den * most[x] >= num * least[x:])
        mine = slice(at, at + LEAF)
        for y in np.flatnonzero(reach) + x:
            other = slice(starts[y], starts[y] + LEAF)
            overlap = np.minimum(points[mine, None], points[None, other]).sum(2, dtype=np.int64)
            fits = overlap >= least_overlap(sizes[mine, None] + sizes[None, other], num, den)
            fits &= parts[mine, None] != parts[None, other]
            i, j = np.nonzero(np.triu(fits, 1) if x == y else fits)
            found.append(np.stack([order[i + at], order[j + starts[y]]], 1))
    return np.concatenate(found) if found else np.empty((0, 2), np.int64)


def _small_pairs(points: np.ndarray, sizes: np.ndarray, parts: np.ndarray, starts: np.ndarray, num: int, den: int) -> np.ndarray:
    """The same for many small groups at once; ``starts`` ends with the number of rows."""
    lengths = np.diff(starts)
    found = []
    for step in range(1, int(lengths.max(initial=0))):  # each row with the one ``step`` places on
        i = np.concatenate([np.arange(s, s + n - step) for s, n in zip(starts[:-1][lengths > step], lengths[lengths > step], strict=True)])
        j = i + step
        low, high = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
        fits = (parts[i] != parts[j]) & (den * low >= num * high)
        i, j = i[fits], j[fits]
        fits = np.minimum(points[i], points[j]).sum(1, dtype=np.int64) >= least_overlap(sizes[i] + sizes[j], num, den)
        found.append(np.stack([i[fits], j[fits]], 1))
    return np.concatenate(found) if found else np.empty((0, 2), np.int64)


def _sent(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Words and the sets that hold them, a row for each bucket: words with the same upper bits."""

    def rows(uids: list[np.ndarray], words: list[np.ndarray]) -> pa.RecordBatch:
        words, uids = np.concatenate(words), np.concatenate(uids)
        bucket = (words >> np.uint64(64 - bits)).astype(np.uint16)
        order = np.argsort(bucket, kind="stable")
        names, first = np.unique(bucket[order], return_index=True)
        parts = np.split(order, first[1:])
        # the bytes of the ids by their place: most are equal, which compresses well
        ids = [uids[p].view(np.uint8).reshape(-1, 8).T.tobytes() for p in parts]
        columns = [pa.array(names.astype(np.int32)), pa.array([words[p].tobytes() for p in parts], pa.binary()), pa.array(ids, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "words", "uids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uids, words, held = [], [], 0
        for batch in batches:
            own = batch["words"].flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            sizes = batch["words"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            uids.append(np.repeat(batch["uid"].to_numpy(zero_copy_only=False), sizes))
            words.append(own)
            held += len(own)
            if held >= SENT_WORDS:
                yield rows(uids, words)
                uids, words, held = [], [], 0
        if held:
            yield rows(uids, words)

    return run


def sharing(words: np.ndarray, uids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cell, set, smallest other set with a sketch near its own, whether there are more of
    these) for the words of whole cells. Members of a very large cell are all taken as near."""
    mask, top = np.uint64((1 << SKETCH_BITS) - 1), np.iinfo(np.int64).max
    order = np.argsort(words)
    words, uids = words[order], uids[order]
    cell = words >> np.uint64(SKETCH_BITS)
    n = np.diff(np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), len(cell))) if len(cell) else np.empty(0, np.int64)
    held = np.repeat(n > 1, n)
    cell, words, uids, n = cell[held], words[held] & mask, uids[held], n[n > 1]
    starts = np.cumsum(n) - n
    after = np.repeat(starts + n, n) - np.arange(len(uids)) - 1
    least, times = np.full(len(uids), top), np.zeros(len(uids), np.int64)
    whole = (n > SKETCHED) | (words[starts] == words[starts + n - 1])  # also where all sketches are equal
    rows, step = np.flatnonzero((after > 0) & ~np.repeat(whole, n)), 1
    while len(rows):  # each row with the one ``step`` places on
        near = (np.bitwise_count(words[rows] ^ words[rows + step]) <= MOST_APART) & (uids[rows] != uids[rows + step])
        for a, b in ((rows[near], rows[near] + step), (rows[near] + step, rows[near])):
            least[a] = np.minimum(least[a], uids[b])
            times[a] += 1
        step += 1
        rows = rows[after[rows] >= step]
    if whole.any():
        own, size = np.repeat(whole, n), n[whole]
        ids, begin = uids[own], np.cumsum(size) - size
        low = np.repeat(np.minimum.reduceat(ids, begin), size)
        second = np.repeat(np.minimum.reduceat(np.where(ids == low, top, ids), begin), size)
        least[own] = np.where(ids == low, second, low)
        times[own] = np.where(second < top, np.repeat(np.minimum(size - 1, 2), size), 0)
    keep = times > 0
    return cell[keep].view(np.int64), uids[keep], least[keep], times[keep] > 1


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; one bucket is held."""

    def rows(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        found = sharing(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(found, (*[pa.int64()] * 3, pa.bool_()), strict=True)], ["cell", "uid", "pivot", "more"])

    bucket, held = None, []
    for batch in batches:
        for own, words, uids in zip(batch["bucket"].to_pylist(), batch["words"], batch["uids"], strict=True):
            if own != bucket and held:
                yield rows(held)
                held = []
            bucket = own
            ids = np.frombuffer(uids.as_buffer(), np.uint8).reshape(8, -1).T.copy().view(np.int64).ravel()
            held.append((np.frombuffer(words.as_buffer(), np.uint64).copy(), ids))
    if held:
        yield rows(held)


def _within(num: int, den: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs whose parities allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch["n"].to_numpy() + batch["m"].to_numpy()
            apart = np.array([least_apart(x, y) for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True)], np.int64)
            keep = pa.array(apart <= total - 2 * least_overlap(total, num, den))
            yield pa.RecordBatch.from_arrays([batch["uid"], batch["head"]], ["uid", "head"]).filter(keep)

    return run


def _search(num: int, den: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come sorted by cell and block pair; a group, at most two blocks, is kept until it is whole."""

    def found(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        points = table["point"].to_pylist()
        uid, n, part = (table[c].to_numpy() for c in ("uid", "n", "part"))
        left, right = (table[c].to_numpy() for c in ("left", "right"))
        lengths = np.diff(starts)
        # all points of a group have the coordinates of its smallest
        groups = np.minimum.reduceat(np.array([len(p) for p in points]), starts[:-1])
        out = []
        for size in np.unique(groups):
            small = np.flatnonzero((lengths <= LEAF) & (groups == size))
            if len(small):
                rows = np.concatenate([np.arange(starts[g], starts[g + 1]) for g in small])
                ends = np.concatenate(([0], np.cumsum(lengths[small])))
                out.append(rows[_small_pairs(folded([points[r] for r in rows], size), n[rows], part[rows], ends, num, den)])
        for g in np.flatnonzero(lengths > LEAF):
            own = slice(starts[g], starts[g + 1])
            pairs = bounded_pairs(folded(points[own], groups[g]), n[own], part[own], num, den) + starts[g]
            if not (left[own] & right[own]).all():  # two blocks: pairs across them only
                pairs = pairs[left[pairs[:, 0]] != left[pairs[:, 1]]]
            out.append(pairs)
        pairs = uid[np.concatenate(out).reshape(-1, 2)] if out else np.empty((0, 2), np.int64)
        pairs = np.unique(np.sort(pairs, 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], ["a", "b"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if kept is None else pa.concat_tables([kept, table])
            keys = np.stack([table[c].to_numpy() for c in ("cell", "i", "j")], 1)
            starts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(1)))) if len(keys) else np.empty(0, np.int64)
            if not len(starts):
                continue
            kept = table.slice(starts[-1]).combine_chunks()
            if len(starts) > 1:
                yield found(table.slice(0, starts[-1]), starts)
        if kept is not None:
            yield found(kept, np.array([0, kept.num_rows]))

    return search


def _overlaps(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
    return den * both >= num * (len(x) + len(y) - both)


def _from_heads(num: int, den: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come sorted so that a head's set stands before those compared with it; one set is held."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, held = None, None
        for batch in batches:
            a, b = [], []
            for uid, own, items in zip(batch["uid"].to_pylist(), batch["head"].to_pylist(), batch["items"], strict=True):
                items = np.frombuffer(items.as_buffer(), np.uint64)
                if uid == own:
                    head, held = own, items.copy()
                elif own == head and _overlaps(held, items, num, den):
                    a.append(own)
                    b.append(uid)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return verify


def _pairs(num: int, den: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = ((np.frombuffer(x.as_buffer(), np.uint64) for x in batch[c]) for c in ("xs", "ys"))
            keep = pa.array([_overlaps(x, y, num, den) for x, y in zip(*sides, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(keep)

    return verify


def link(cells: DataFrame, fetch: Callable[[DataFrame, bool], DataFrame], num: int, den: int, scratch: Scratch) -> DataFrame:
    """(id, component) of the sets that are linked with another, from a row (cell, uid;
    longs) for each cell of each set. See ``link_words``."""
    mask = ~((1 << SKETCH_BITS) - 1)
    words = cells.select("uid", F.array(F.xxhash64("cell").bitwiseAND(F.lit(mask).cast("long"))).alias("words"))
    return link_words(words, cells.count(), fetch, num, den, scratch)


def link_words(
    words: DataFrame, total: int, fetch: Callable[..., DataFrame], num: int, den: int, scratch: Scratch, bounds: DataFrame | None = None, whole: bool = False
) -> DataFrame:
    """(id, component) of the sets that are linked with another.

    words: (uid, words), a long and an array of longs; two linked sets have a cell in
    common in which their sketches differ in ``MOST_APART`` bits at most. total: about
    how many words there are. fetch: adds to a table with columns uid, head and salt the
    column items, the set's members as sorted 64-bit hashes; repeated rows do no harm; its
    second argument says that the table has at most ``BROADCAST_ROWS`` rows, by count.
    whole: fetch takes a third argument, a function of the batches it makes and their
    columns, and returns its rows instead; a task then needs one Python worker, not two.
    bounds: (uid, n, parities) of the sets, if there are such. Sets x and y are linked
    when den * |x and y| >= num * |x or y|.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, (total // BUCKET_WORDS).bit_length()))
    sent = words.mapInArrow(_sent(bits), "bucket int, words binary, uids binary").repartition("bucket").sortWithinPartitions("bucket")
    met = scratch.write(sent.mapInArrow(_met, "cell long, uid long, pivot long, more boolean"), "met")

    def bounded(asked: DataFrame) -> DataFrame:
        if bounds is None:
            return asked
        both = asked.join(bounds.toDF("uid", "n", "x"), "uid").join(bounds.toDF("head", "m", "y"), "head")
        return both.mapInArrow(_within(num, den), "uid long, head long")

    near = met.select("uid", F.col("pivot").alias("head")).distinct()
    if bounds is not None:
        near = scratch.write(bounded(near), "near")
        held = met.join(near.select("uid", F.col("head").alias("pivot"), F.lit(True).alias("near")), ["uid", "pivot"], "left")
        met = scratch.write(held.where("more or near").select("cell", "uid"), "met")

    def fetched(roles: DataFrame, *then: tuple[Callable, str]) -> DataFrame:
        roles, rows, _ = scratch.write_counted(roles.select("uid", "head", "salt"), "roles")
        return fetch(roles, rows <= BROADCAST_ROWS, *then)

    def star(asked: DataFrame) -> DataFrame:
        """Links found by comparing each set with one head; a head of many is copied to several tasks."""
        asked = scratch.write(asked, "asked")
        heads = scratch.write(asked.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / HEAD_ROWS).alias("salts")), "heads")
        members = asked.join(heads, "head").withColumn("salt", F.pmod(F.xxhash64("uid"), "salts"))
        copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))
        own = heads.withColumn("salt", copies).withColumn("uid", F.col("head"))
        columns = ["uid", "head", "salt"]
        dealt = fetched(members.select(columns).unionByName(own.select(columns))).repartition("head", "salt")
        dealt = dealt.sortWithinPartitions("head", "salt", F.col("uid") != F.col("head")).select("uid", "head", "items")
        return scratch.write(dealt.mapInArrow(_from_heads(num, den), "a long, b long"), "links")

    links = star(near.groupBy("uid").agg(F.min("head").alias("head")))
    for turn in range(STARS):
        parts = scratch.write(components(links, scratch), "parts")
        seen = met.select("cell", "uid").join(parts.toDF("uid", "part"), "uid", "left")
        seen = scratch.write(seen.select("cell", "uid", F.coalesce("part", "uid").alias("part")), "seen")
        # cells that still hold several components
        open_ = seen.groupBy("cell").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count(F.lit(1)).alias("size"))
        open_ = open_.where("lo <> hi").select("cell", "lo", "hi", F.ceil(F.col("size") / BLOCK).alias("blocks"))
        left, rows, _ = scratch.write_counted(seen.join(open_, "cell"), "open")
        if not rows or turn == STARS - 1:
            break
        # again one comparison a set, with a head of the cell's last component, or its first for those in it
        ends = left.groupBy("cell").agg(
            F.min_by("uid", F.struct("part", F.xxhash64("uid", F.lit(turn)))).alias("first"),
            F.max_by("uid", F.struct("part", F.xxhash64("uid", F.lit(turn)))).alias("last"),
        )
        asked = left.join(ends, "cell").withColumn("head", F.when(F.col("part") == F.col("hi"), F.col("first")).otherwise(F.col("last")))
        links = links.unionByName(star(bounded(asked.groupBy("uid").agg(F.min("head").alias("head")).where("uid <> head"))))
    parts = parts.toDF("id", "component")
    if not rows:
        return parts

    alone = lambda uids: uids.select("uid", F.col("uid").alias("head"), F.lit(0).cast("long").alias("salt"))
    asked = alone(left.select("uid").distinct())
    points = fetched(asked, (_points, _POINT)) if whole else fetched(asked).select("uid", "items").mapInArrow(_points, _POINT)
    points = scratch.write(points.dropDuplicates(["uid"]), "points")
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    salted = left.withColumn("mine", F.pmod(F.xxhash64("uid"), "blocks")).withColumn("with", blocks)
    salted = salted.select(
        "cell", "uid", "part", F.least("mine", "with").alias("i"), F.greatest("mine", "with").alias("j"),
        (F.col("mine") <= F.col("with")).alias("left"), (F.col("mine") >= F.col("with")).alias("right"),
    ).join(points, "uid")
    dealt = salted.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    pairs = dealt.mapInArrow(_search(num, den), "a long, b long").distinct()
    pairs, rows, _ = scratch.write_counted(pairs, "pairs")
    if not rows:
        return parts
    asked = pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct()
    side = scratch.write(fetched(alone(asked)).select("uid", "items").dropDuplicates(["uid"]), "side")
    both = pairs.join(side.toDF("a", "xs"), "a").join(side.toDF("b", "ys"), "b").select("a", "b", "xs", "ys")
    more = scratch.write(both.mapInArrow(_pairs(num, den), "a long, b long"), "links")
    return components(links.unionByName(more), scratch).toDF("id", "component")


_POINT = "uid long, n long, point binary"
ITEMS = "uid long, head long, salt long, items binary"


def in_one_pass(found: DataFrame, make: Callable, then: tuple[Callable, str] | None) -> DataFrame:
    """``found`` through ``make``, whose columns are ITEMS, and through ``then`` in the same Python worker."""
    if then is None:
        return found.mapInArrow(make, ITEMS)
    after, columns = then
    return found.mapInArrow(lambda batches: after(make(batches)), columns)


def without_copies(rows: DataFrame, kinds: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """``rows`` that are the first of their kind (``key``, uid). The others are few as a
    rule and go to the rows by broadcast, so that the rows are not shuffled."""
    first = kinds.select(key, F.col("uid").alias("first"))
    copies = rows.select(key, "uid").join(first, key).where("uid <> first").select("uid")
    copies, n, _ = scratch.write_counted(copies, "copies")
    copies = copies.hint("broadcast" if n <= BROADCAST_ROWS else "shuffle_hash")
    return rows.where(F.col(key).isNotNull()).join(copies, "uid", "left_anti")


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch["items"]]
        points = pa.array([point(x).tobytes() for x in rows], pa.binary())
        yield pa.RecordBatch.from_arrays([batch["uid"], pa.array([len(x) for x in rows], pa.int64()), points], ["uid", "n", "point"])
