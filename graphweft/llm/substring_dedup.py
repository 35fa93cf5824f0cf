"""Substring de-duplication by paragraph MinHash banding.

Paragraphs are lines of ``LONG_LINE`` words or more, and runs of shorter lines up
to a blank line or a long one, of five words or more. Their five-word shingles get MinHash values in bands tuned for high recall at the threshold; paragraphs
that share a band are joined, verified by exact Jaccard similarity and clustered
by connected components (``linking``). Equal paragraphs are one from the start.

A passage that was put inside longer lines makes no paragraph of its own. So the
words of a text, lines aside, also have anchors: of every ``SPREAD`` runs of
``ANCHOR`` words in a row, the one of the least hash. A repeated passage of 30
words or more holds the same anchor wherever it stands. From an anchor that is
also in a smaller document, the match is followed word by word to both sides, to
the next anchor by a hash of the words between and else by the words themselves;
runs of ``LEAST_WORDS`` words or more are passages.

One member of each cluster stays, that of the smallest document, for paragraphs
and passages alike: whatever goes is kept, itself or nearly, by a smaller document.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft.llm.linking import SKETCH_BITS, in_one_pass, link_words, without_copies
from graphweft.llm.words import Words, _powers, each_text, mix, shingles
from graphweft.session import Scratch

#: Words of a passage at least.
LEAST_WORDS = 20
#: A line of so many words is a paragraph of its own.
LONG_LINE = 20
SHINGLE = 5
#: A pair at the threshold shares a band with this probability at least.
RECALL = 0.99
MOST_HASHES = 48
#: Words of an anchor, and how many runs of so many words in a row have one anchor at least: a
#: repeated passage of ANCHOR + SPREAD - 1 words or more holds one that is the same in each copy.
ANCHOR, SPREAD = 10, 21
#: Buckets of anchors, and anchors that a task holds before it sends them.
ANCHOR_BUCKETS, SENT_ANCHORS = 1024, 1 << 19
#: Words to either side of an anchor that are compared; the next anchor is not further away.
CONTEXT = 24


def tuned_bands(least: float, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows in a band that reach the recall with ``most`` hashes."""
    best = (1, 1)
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(least**rows)))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def _blocks(data: np.ndarray, words: Words, i: int, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, number of words) of the paragraphs of a text: long lines, and runs
    of short lines up to a line without words or a long one."""
    lo, hi = words.ranges[i], words.ranges[i + 1]
    if lo == hi:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    breaks = np.flatnonzero(data[offsets[i] : offsets[i + 1]] == 0x0A) + offsets[i]
    at, times = np.unique(np.searchsorted(words.starts[lo:hi], breaks) + lo, return_counts=True)
    inside = (at > lo) & (at < hi)
    cuts = np.append(lo, at[inside])
    short = np.diff(np.append(cuts, hi)) < LONG_LINE
    joined = short[1:] & short[:-1] & (times[inside] == 1)
    first = cuts[np.append(True, ~joined)]
    return first, np.diff(np.append(first, hi))


def _paragraphs(bands: int, rows: int):
    rng = np.random.default_rng(711)
    times = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    plus = rng.integers(1, 2**63, bands * rows, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, words in each_text(batch["text"]):
                offsets = words.offsets
                owner, first, count = [], [], []
                for i in range(len(offsets) - 1):
                    starts, n = _blocks(data, words, i, offsets)
                    keep = n >= SHINGLE
                    first.append(starts[keep])
                    count.append(n[keep])
                    owner.append(np.full(keep.sum(), i))
                owner, first, count = (np.concatenate(x).astype(np.int64) for x in (owner, first, count))
                if not len(owner):
                    continue
                # all shingles of all paragraphs, and where those of each begin
                grams = shingles(words.hashes, SHINGLE) if len(words.hashes) >= SHINGLE else np.empty(0, np.uint64)
                sizes = count - SHINGLE + 1
                begin = np.cumsum(sizes) - sizes
                grams = grams[np.repeat(first - begin, sizes) + np.arange(sizes.sum())]
                cells = np.zeros((len(owner), bands), np.uint64)
                for h in range(bands * rows):
                    least = np.minimum.reduceat((grams ^ plus[h]) * times[h], begin)
                    cells[:, h // rows] = mix(cells[:, h // rows] ^ least + np.uint64(h))
                keys = [hashlib.blake2b(words.hashes[a : a + n].tobytes(), digest_size=16).digest() for a, n in zip(first, count, strict=True)]
                cells = cells >> np.uint64(SKETCH_BITS) << np.uint64(SKETCH_BITS)
                pick = pa.array(owner + at)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].take(pick), batch["doc"].take(pick), pa.array(words.starts[first] - offsets[owner], pa.int64()),
                        pa.array(words.ends[first + count - 1] - offsets[owner], pa.int64()), pa.array(count), pa.array(keys, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(owner) + 1) * bands, pa.int32()), pa.array(cells.ravel().view(np.int64))),
                    ],
                    ["doc_id", "doc", "begin", "end", "n_words", "key", "words"],
                )

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingle sets of the paragraphs that stand wanted beside their text. Only these are split into words."""
    for batch in batches:
        raw, flat, owner = batch["text"].cast(pa.binary()), batch["wanted"].flatten(), batch["wanted"].value_parent_indices().to_pylist()
        spans = zip(owner, flat.field("begin").to_pylist(), flat.field("end").to_pylist(), strict=True)
        pieces = pa.array([memoryview(raw[i].as_buffer())[a:z].tobytes() for i, a, z in spans], pa.binary())
        for at, _, words in each_text(pieces):
            n = len(words.ranges) - 1
            items = [np.unique(shingles(words.of(i), SHINGLE)).tobytes() for i in range(n)]
            columns = [*(flat.field(c).slice(at, n) for c in ("uid", "head", "salt")), pa.array(items, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["uid", "head", "salt", "items"])


def _anchor_places(hashes: np.ndarray) -> np.ndarray:
    """First words of the anchors of a text: of every SPREAD runs of ANCHOR words in a row, the one of the least rank."""
    rank = mix(shingles(hashes, ANCHOR))
    if len(rank) <= SPREAD:
        return np.array([rank.argmin()])
    at = np.lib.stride_tricks.sliding_window_view(rank, SPREAD).argmin(1)
    return np.unique(at + np.arange(len(at)))


def _run_hashes(hashes: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A hash of each run of words, which may be empty."""
    n = stop - first
    ends = np.cumsum(n)
    place = np.arange(n.sum()) - np.repeat(ends - n, n)
    sums = np.zeros(len(place) + 1, np.uint64)
    np.cumsum(hashes[np.repeat(first, n) + place] * _powers(int(n.max()))[place], out=sums[1:])
    return mix(sums[ends] - sums[ends - n] + n.astype(np.uint64))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of each text. ``at``: first word, words since the anchor before began (or
    the text) and words until the next one ends (or the text); ``gap``: hashes of both runs."""
    for batch in batches:
        for at, _, words in each_text(batch["text"]):
            owner, first, before, after = [], [], [], []
            for i in range(len(words.ranges) - 1):
                own = words.of(i)
                if len(own) >= LEAST_WORDS:
                    places = _anchor_places(own) + words.ranges[i]
                    first.append(places)
                    before.append(np.append(words.ranges[i], places[:-1]))
                    after.append(np.append(places[1:] + ANCHOR, words.ranges[i + 1]))
                    owner.append(np.full(len(places), i))
            if not first:
                continue
            owner, first, before, after = (np.concatenate(x).astype(np.int64) for x in (owner, first, before, after))
            anchor = mix(_run_hashes(words.hashes, first, first + ANCHOR)).view(np.int64)
            left, right = _run_hashes(words.hashes, before, first), _run_hashes(words.hashes, first + ANCHOR, after)
            gap = ((left >> np.uint64(32) << np.uint64(32)) | (right >> np.uint64(32))).view(np.int64)
            place = (first - words.ranges[owner]) << 16 | (first - before) << 8 | (after - first - ANCHOR)
            pick = pa.array(owner + at)
            columns = [pa.array(anchor), batch["doc_id"].take(pick), batch["doc"].take(pick), pa.array(place), pa.array(gap)]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "doc_id", "doc", "at", "gap"])


_ANCHOR = ["anchor", "doc_id", "doc", "at", "gap"]


def _shared(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(an order of the rows by anchor, the group in it of each row), rows of anchors of
    one document left out."""
    anchor, doc = table["anchor"].to_numpy(), table["doc"].to_numpy()
    order = np.lexsort((doc, anchor))
    anchor, doc = anchor[order], doc[order]
    starts = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    n = np.diff(np.append(starts, len(anchor)))
    many = doc[starts] != doc[starts + n - 1]
    return order[np.repeat(many, n)], np.repeat(np.arange(many.sum()), n[many])


def _sent_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors, a row for each bucket of them. Of an anchor that two documents of this task
    share, two rows go to its bucket; the others, known to be shared, go to a bucket below 0
    that is drawn by place, so that a hot anchor is dealt over many tasks."""

    def rows(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        bucket = (table["anchor"].to_numpy().view(np.uint64) % np.uint64(ANCHOR_BUCKETS)).astype(np.int32)
        order, group = _shared(table)
        ends = np.append(True, group[1:] != group[:-1]) | np.append(group[1:] != group[:-1], True)
        rest = order[~ends] if len(order) else order
        bucket[rest] = -1 - np.arange(len(rest)) // 256 % ANCHOR_BUCKETS
        order = np.argsort(bucket, kind="stable")
        names, first = np.unique(bucket[order], return_index=True)
        stops = pa.array(np.append(first, len(order)), pa.int32())
        table = table.take(pa.array(order)).combine_chunks()
        lists = [pa.ListArray.from_arrays(stops, table[c].chunk(0)) for c in _ANCHOR]
        return pa.RecordBatch.from_arrays([pa.array(names), *lists], ["bucket", *_ANCHOR])

    held, n = [], 0
    for batch in _anchors(batches):
        held.append(batch)
        n += batch.num_rows
        if n >= SENT_ANCHORS:
            yield rows(held)
            held, n = [], 0
    if n:
        yield rows(held)


def _met_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; the anchors of one bucket are held, and those that are in
    several documents come out."""

    def rows(held: list[pa.Table]) -> list[pa.RecordBatch]:
        table = pa.concat_tables(held).combine_chunks()
        return table.take(pa.array(_shared(table)[0])).combine_chunks().to_batches()

    bucket, held = None, []
    for batch in batches:
        names = batch["bucket"].to_numpy()
        starts = np.flatnonzero(np.append(True, names[1:] != names[:-1])) if len(names) else []
        for a, z in zip(starts, np.append(starts, len(names))[1:], strict=True):
            part = batch.slice(int(a), int(z - a))
            table = pa.table({c: part[c].flatten() for c in _ANCHOR})
            if names[a] < 0:
                yield from table.to_batches()
                continue
            if names[a] != bucket and held:
                yield from rows(held)
                held = []
            bucket = names[a]
            held.append(table)
    if held:
        yield from rows(held)


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the anchors that stand wanted beside a text: where their run begins and ends
    if it is that of ``at``; where an end is open, the words there and their bytes, outwards."""
    for batch in batches:
        for at, _, words in each_text(batch["text"]):
            for i, wanted in enumerate(batch["wanted"].slice(at, len(words.ranges) - 1).to_pylist()):
                low, high = words.ranges[i], words.ranges[i + 1]
                rows = []
                for w in wanted:
                    a, l, r = low + (w["owner_at"] >> 16), w["owner_at"] >> 8 & 255, w["owner_at"] & 255
                    z = a + ANCHOR
                    inner, outer = slice(max(low, a - CONTEXT), a), slice(z, min(high, z + CONTEXT))
                    begins = words.starts[inner.start : a + 1][::-1] - words.offsets[i]
                    ends = words.ends[z - 1 : outer.stop] - words.offsets[i]
                    left = words.hashes[inner][::-1].tobytes() + begins.astype(np.int64).tobytes() if w["left_open"] else None
                    right = words.hashes[outer].tobytes() + ends.astype(np.int64).tobytes() if w["right_open"] else None
                    rows.append((w["owner_at"], words.starts[a - l] - words.offsets[i], words.ends[z + r - 1] - words.offsets[i], left, right))
                columns = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                owner = pa.array([batch["owner"][at + i].as_py()] * len(rows), pa.int64())
                yield pa.RecordBatch.from_arrays([owner, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["owner", "owner_at", "owner_begin", "owner_end", "left", "right"])


def _reach(own: np.ndarray, side: bytes) -> tuple[int, int]:
    """(equal words, the byte where they end) of own words and a side of ``_around``, both outwards."""
    both = np.frombuffer(side, np.uint64)
    n = len(both) // 2
    m = min(n, len(own))
    equal = own[:m] == both[:m]
    k = m if equal.all() else int(equal.argmin())
    return k, int(both[n:].view(np.int64)[k])


_SPANS = "doc long, doc_id long, begin long, end long, n_words long, cluster long, removed boolean"


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal words around shared anchors, in the copy and in the text that keeps them."""
    for batch in batches:
        for at, _, words in each_text(batch["text"]):
            rows = []
            for i, wanted in enumerate(batch["wanted"].slice(at, len(words.ranges) - 1).to_pylist()):
                doc, doc_id = batch["doc"][at + i].as_py(), batch["doc_id"][at + i].as_py()
                low, high = int(words.ranges[i]), int(words.ranges[i + 1])
                runs = []
                for w in wanted:
                    a, l, r = low + (w["at"] >> 16), w["at"] >> 8 & 255, w["at"] & 255
                    begin, end = w["owner_begin"], w["owner_end"]
                    if w["left_open"]:
                        l, begin = _reach(words.hashes[max(low, a - CONTEXT) : a][::-1], w["left"])
                    if w["right_open"]:
                        r, end = _reach(words.hashes[a + ANCHOR : min(high, a + ANCHOR + CONTEXT)], w["right"])
                    shift = (w["owner_at"] >> 16) - (w["at"] >> 16)
                    runs.append((w["owner"], shift, a - l, a + ANCHOR + r, begin, end, w["owner_id"]))
                whole = []
                for run in sorted(runs, key=lambda x: x[:4]):
                    if whole and whole[-1][:2] == list(run[:2]) and run[2] <= whole[-1][3]:
                        if run[3] > whole[-1][3]:
                            whole[-1][3], whole[-1][5] = run[3], run[5]
                    else:
                        whole.append(list(run))
                for owner, _, a, z, begin, end, owner_id in whole:
                    if z - a >= LEAST_WORDS:
                        rows.append((doc, doc_id, int(words.starts[a] - words.offsets[i]), int(words.ends[z - 1] - words.offsets[i]), z - a, owner, True))
                        rows.append((owner, owner_id, begin, end, z - a, owner, False))
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            kinds = (*[pa.int64()] * 6, pa.bool_())
            names = ["doc", "doc_id", "begin", "end", "n_words", "cluster", "removed"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _documents(docs: DataFrame) -> DataFrame:
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(doc_id.alias("doc_id"), text.alias("text")).withColumn("doc", F.xxhash64("doc_id", "text"))


def _passages(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc, doc_id, begin, end, n_words, cluster, removed) of runs of words that a smaller document has too."""
    # few anchors are shared; all are shuffled once, as blocks
    lists = ", ".join(f"{c} array<long>" for c in _ANCHOR)
    sent = docs.mapInArrow(_sent_anchors, f"bucket int, {lists}").repartition("bucket").sortWithinPartitions("bucket")
    shared = scratch.write(sent.mapInArrow(_met_anchors, ", ".join(f"{c} long" for c in _ANCHOR)), "shared")
    # written, so that the join has an exchange of its own and a hot anchor's rows can be split
    first = scratch.write(shared.groupBy("anchor").agg(F.min(F.struct("doc_id", "doc", "at", "gap")).alias("first")), "first")
    found = shared.join(first, "anchor").where("doc <> first.doc").select(
        "doc", "at", F.col("first.doc").alias("owner"), F.col("first.doc_id").alias("owner_id"), F.col("first.at").alias("owner_at"),
        F.expr("shiftright(gap, 32) <> shiftright(first.gap, 32)").alias("left_open"),
        F.expr("(gap & 4294967295) <> (first.gap & 4294967295)").alias("right_open"),
    ).distinct()
    found = scratch.write(found, "found")
    owners = found.groupBy("owner", "owner_at").agg(F.max("left_open").alias("left_open"), F.max("right_open").alias("right_open"))
    owners = owners.groupBy("owner").agg(F.collect_list(F.struct("owner_at", "left_open", "right_open")).alias("wanted"))
    texts = docs.select("doc", "doc_id", "text")
    sides = texts.select(F.col("doc").alias("owner"), "text").join(owners.hint("shuffle_hash"), "owner")
    sides = sides.mapInArrow(_around, "owner long, owner_at long, owner_begin long, owner_end long, left binary, right binary")
    # rows equal in id and text give their sides once
    sides = scratch.write(sides, "sides").dropDuplicates(["owner", "owner_at"])
    left, right = F.when(F.col("left_open"), F.col("left")), F.when(F.col("right_open"), F.col("right"))
    beside = found.join(sides, ["owner", "owner_at"]).withColumn("left", left).withColumn("right", right)
    wanted = F.collect_list(F.struct(*(c for c in beside.columns if c != "doc")))
    beside = beside.groupBy("doc").agg(wanted.alias("wanted"))
    return texts.join(beside.hint("shuffle_hash"), "doc").mapInArrow(_extended, _SPANS).distinct()


def _clusters(docs: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """(doc, doc_id, begin, end, n_words, cluster, removed) of paragraphs that have a like."""
    schema = "doc_id long, doc long, begin long, end long, n_words long, key binary, words array<long>"
    bands, rows = tuned_bands(num / den)
    made = docs.mapInArrow(_paragraphs(bands, rows), schema)
    lines, n, _ = scratch.write_counted(made.withColumn("uid", F.monotonically_increasing_id()), "paragraphs")
    place: Column = F.struct("doc_id", "doc", "begin")
    kinds = lines.groupBy("key").agg(F.min("uid").alias("uid"), F.min(place).alias("first"), F.count(F.lit(1)).alias("times"))
    kinds = scratch.write(kinds, "kinds")
    words = without_copies(lines, kinds, "key", scratch).select("uid", "words")

    def fetch(uids: DataFrame, few: bool, then=None) -> DataFrame:
        wanted = uids.join(lines.select("uid", "doc", "begin", "end"), "uid")
        wanted = wanted.groupBy("doc").agg(F.collect_list(F.struct("uid", "head", "salt", "begin", "end")).alias("wanted"))
        found = docs.select("doc", "text").join(wanted.hint("broadcast" if few else "shuffle_hash"), "doc")
        return in_one_pass(found.select("text", "wanted"), _sets, then)

    parts = link_words(words, n * bands, fetch, num, den, scratch, whole=True).toDF("uid", "part")
    whole = kinds.join(parts, "uid", "left").where("part is not null or times > 1").withColumn("part", F.coalesce("part", "uid"))
    kept = whole.groupBy("part").agg(F.min("first").alias("kept"))
    named = scratch.write(whole.join(kept, "part").select("key", "part", "kept"), "named")
    out = lines.drop("words", "uid").join(named, "key")
    return out.select("doc", "doc_id", "begin", "end", "n_words", F.col("part").alias("cluster"), (place != F.col("kept")).alias("removed"))


def repeated_spans(docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """Repeated spans of ``docs`` (doc_id long, text string; others are ignored):
    doc_id, kind, begin, end, n_words, cluster, removed.

    begin and end are byte offsets in the UTF-8 text. kind "paragraph": a long line
    or a run of short ones (five words or more) with a like of Jaccard similarity num / den or more over five-word shingles, itself
    included; cluster names the component. kind "passage": a run of words that the document
    ``cluster`` has too. removed is false for the one that stays.

    Null, empty and short texts have no spans. Rows equal in id and text are one
    document and its spans are given once; null ids are kept. No rows give no rows.
    """
    scratch = Scratch(docs.sparkSession)
    return _spans(_documents(docs), num, den, scratch).drop("doc")


def _spans(docs: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    lines = _clusters(docs, num, den, scratch).distinct()
    runs = _passages(docs, scratch)
    columns = ["doc", "doc_id", "kind", "begin", "end", "n_words", "cluster", "removed"]
    lines = lines.withColumn("kind", F.lit("paragraph")).select(columns)
    return lines.unionByName(runs.withColumn("kind", F.lit("passage")).select(columns))


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the spans that stand beside them; a line left empty goes as a whole."""
    for batch in batches:
        out, gone = [], []
        for text, spans in zip(batch["text"].to_pylist(), batch["spans"].to_pylist(), strict=True):
            if text is not None and spans:
                raw, at, parts = text.encode(), 0, []
                for s in sorted(spans, key=lambda s: (s["begin"], s["end"])):
                    if s["end"] > at:
                        parts.append(raw[at : max(at, s["begin"])])
                        at = s["end"]
                parts.append(raw[at:])
                kept = b"".join(parts).decode()
                text = "\n".join(x for x in kept.split("\n") if x.strip(" \t\n\x0b\x0c\r"))
            out.append(text)
            gone.append(bool(spans) and text == "")
        rest = [c for c in batch.schema.names if c not in ("text", "spans")]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in rest), pa.array(out, pa.string()), pa.array(gone, pa.bool_())], [*rest, "text", "gone"])


def without_repeats(docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with the removed spans cut out of ``text``; all columns stay. A
    text that had words and has none left goes with its row; rows equal in id
    and text are treated alike."""
    scratch = Scratch(docs.sparkSession)
    spans = _spans(_documents(docs), num, den, scratch).where("removed")
    spans = spans.groupBy("doc").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    names = docs.columns
    own = [f"c{i}" for i in range(len(names))]  # the columns of docs may have any name
    text, i = own[names.index("text")], names.index("text")
    held = docs.withColumn("\u0000doc", key).toDF(*own, "doc").join(spans, "doc", "left").drop("doc")
    held = held.withColumnRenamed(text, "text")
    order = [c for c in own if c != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema if f.name in order) + ", text string, gone boolean"
    cut = held.mapInArrow(_without, schema)
    return cut.where("not gone").select(*(F.col("text" if j == i else own[j]).alias(names[j]) for j in range(len(names))))
