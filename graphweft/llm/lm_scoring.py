"""Language-model scores of whole texts.

A text is its words (A-Z lowered) and one end. Two models score it:

- base: an add-one unigram model of words;
- the self-attention model (``attention``) over subword ids of the words, each
  with the blank before it, from a public rank file. Its class shares come from
  the counts of all ids in all texts learnt from; its weights are fitted to all
  windows of all of these texts, ``PASSES`` times. In a pass each task goes on
  from the same weights over the texts it holds, and the weights are averaged by
  shuffle: an embedding by the batches that saw its id, the others by windows.
  They therefore depend a little on how the ids lie in files.

Words are counted in the tasks, by slices, and then by shuffle. The ``FREQUENT``
most frequent words go out with the tasks with counts and ids; of a text, only
the other words are joined to their counts by shuffle. Words are matched by 64-bit
hashes. A text is encoded once, where it lies; its ids are kept for the passes and
the scores. Texts are scored whole.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.llm.attention import Fit, Model, Scorer, averaged, packed
from graphweft.llm.words import _LOWER, SLICE_BYTES, Words, slices
from graphweft.session import Scratch

FREQUENT = 100_000
PASSES = 2
#: Ids whose embeddings are averaged as one row.
CHUNK_IDS = 1024
FOLDS, HELD_OUT = 7, 2
_FIRST_BITS = 18
COUNT_SLICE = 8 << 20
_OTHER_SPACE = re.compile(r"\s")
_END_WORD = np.int64(np.uint64(0xE0D0E0D0E0D0E0D1).view(np.int64))


def held_out(doc_id: int | None) -> bool:
    """crc32 of the id as text, mod FOLDS; a null id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


@lru_cache(maxsize=2)
def _encoder(ranks_blob: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_blob.splitlines()) if a}
    return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Byte spans as a string array, A-Z lowered."""
    n = ends - starts
    stops = np.concatenate(([0], np.cumsum(n)))
    raw = _LOWER[data[np.repeat(starts - stops[:-1], n) + np.arange(stops[-1])]]
    return pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(stops.astype(np.int64)), pa.py_buffer(raw)).cast(pa.string())


def _different(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different hashes, where each is first, which of them each hash is)."""
    coded = pa.array(hashes).dictionary_encode()
    which, different = coded.indices.to_numpy(), coded.dictionary.to_numpy()
    first = np.empty(len(different), np.int64)
    first[which[::-1]] = np.arange(len(hashes))[::-1]
    return different, first, which


class Speller:
    """Ids of words, each with the blank before it."""

    def __init__(self, ranks: bytes, pattern: str):
        self.encoding = _encoder(ranks, pattern)
        self.begins = _begins(ranks)

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words, one after the other; how many each has). Words go as one
        text: a blank before another character begins a piece, so an id that begins
        with a blank begins a word. Words that hold space of other kinds go alone."""
        odd = [i for i, w in enumerate(words) if _OTHER_SPACE.search(w)]
        plain = [w for w in words if not _OTHER_SPACE.search(w)] if odd else words
        ids = np.array(self.encoding.encode_ordinary("".join(" " + w for w in plain)), np.int32)
        starts = np.flatnonzero(self.begins[ids])
        sizes = np.diff(np.append(starts, len(ids)))
        if odd:
            alone = [self.encoding.encode_ordinary(" " + words[i]) for i in odd]
            at = np.array(odd) - np.arange(len(odd))
            n = [len(x) for x in alone]
            ids = np.insert(ids, np.repeat(np.append(starts, len(ids))[at], n), np.concatenate(alone))
            sizes = np.insert(sizes, at, n)
        return ids, sizes


@lru_cache(maxsize=2)
def _begins(ranks_blob: bytes) -> np.ndarray:
    """Which ids begin with a blank."""
    ids = {int(b): base64.b64decode(a)[:1] == b" " for a, b in map(bytes.split, ranks_blob.splitlines()) if a}
    begins = np.zeros(1 + max(ids, default=0), bool)
    begins[[i for i, blank in ids.items() if blank]] = True
    return begins


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        learnt = np.array([not held_out(i) for i in batch["doc_id"].to_pylist()], bool)
        texts = batch["text"].filter(pa.array(learnt))
        for _, data, offsets in slices(texts, COUNT_SLICE):
            words = Words(data, offsets)
            hashes, first, which = _different(words.hashes)
            n = np.bincount(which, minlength=len(hashes))
            spelled = _strings(data, words.starts[first], words.ends[first])
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), spelled, pa.array(n, pa.int64())], ["hash", "word", "n"])
        ends = int(learnt.sum())
        yield pa.RecordBatch.from_arrays([pa.array([_END_WORD], pa.int64()), pa.array([None], pa.string()), pa.array([ends], pa.int64())], ["hash", "word", "n"])


class Subwords:
    """Ids of words by hash: a table of frequent words, and an encoder for others."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, ids: list[np.ndarray], ranks: bytes, pattern: str, end: int):
        order = np.argsort(hashes.view(np.uint64))
        self.hashes, self.counts = hashes.view(np.uint64)[order], counts[order]
        # the table by the first bits of hashes: where each begins, and how many share them at most
        self.first = np.searchsorted(self.hashes, np.arange(1 << _FIRST_BITS, dtype=np.uint64) << np.uint64(64 - _FIRST_BITS)).astype(np.int32)
        self.share = int(np.diff(self.first, append=len(hashes)).max())
        self.sizes = np.array([len(ids[i]) for i in order], np.int64)
        self.flat = np.concatenate([ids[i] for i in order]).astype(np.int32) if len(ids) else np.empty(0, np.int32)
        self.ranks, self.pattern, self.end = ranks, pattern, end
        self.kept_as = np.uint16 if end < 1 << 16 else np.int32

    def encoded(self, words: list[str]) -> list[np.ndarray]:
        ids, sizes = Speller(self.ranks, self.pattern).ids(words)
        return np.split(ids, np.cumsum(sizes)[:-1])

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Where the words are in the table, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        last = len(self.hashes) - 1
        place = np.minimum(self.first.take(hashes >> np.uint64(64 - _FIRST_BITS)), last)
        for _ in range(self.share - 1):
            place += self.hashes.take(place) < hashes
            np.minimum(place, last, out=place)
        return np.where(self.hashes.take(place) == hashes, place, -1)

    def of(self, data: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts with an end after each, ids of each text, place of each word in the table or -1, hashes)."""
        place = self.places(words.hashes)
        unknown = np.flatnonzero(place < 0)
        _, first, which = _different(words.hashes[unknown])
        at = unknown[first]
        made, made_sizes = Speller(self.ranks, self.pattern).ids(_strings(data, words.starts[at], words.ends[at]).to_pylist())
        # the end is a word of one id behind the others; a text is the ids of its words and one end
        sizes = np.concatenate([self.sizes, made_sizes, [1]])
        flat = np.concatenate([self.flat, made, np.array([self.end], np.int32)])
        row = place.copy()
        row[unknown] = len(self.sizes) + which
        row = np.insert(row, words.ranges[1:], len(sizes) - 1)
        n = sizes.take(row)
        ends = np.cumsum(n)
        ids = flat.take(np.repeat((np.cumsum(sizes) - sizes).take(row) - (ends - n), n) + np.arange(int(n.sum())))
        per_text = np.diff(np.concatenate(([0], ends)).take(words.ranges + np.arange(len(words.ranges))))
        return ids, per_text, place, words.hashes.view(np.int64)


def _before(ids: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[np.cumsum(sizes) - sizes] = end
    return out


def _encoded_words(ranks: bytes, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller(ranks, pattern)
        for batch in batches:
            given = batch["word"].is_valid().to_numpy(zero_copy_only=False)
            ids, sizes = speller.ids(batch["word"].drop_null().to_pylist())
            stops = np.zeros(len(given) + 1, np.int32)
            stops[1:][given] = sizes
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(stops, dtype=np.int32)), pa.array(ids), mask=pa.array(~given))
            yield pa.RecordBatch.from_arrays([batch["hash"], batch["n"], lists], ["hash", "n", "ids"])

    return run


_CHUNK = "chunk int, at binary, weight binary, value binary"


def _chunks(rows: list[tuple[int, bytes, bytes, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["chunk", "at", "weight", "value"])


def _kept_ids(table: Subwords, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, ids of each text) of slices of texts, as they were kept, or of texts not yet encoded."""
    if "ids" not in batch.schema.names:
        for _, data, offsets in slices(batch["text"]):
            yield table.of(data, Words(data, offsets))[:2]
        return
    stops = np.concatenate(([0], np.cumsum(batch["n_bytes"].to_numpy())))
    sizes = batch["n_ids"].to_numpy()
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(stops, stops[at] + SLICE_BYTES, "right")) - 1)
        ids = np.frombuffer(b"".join(batch["ids"].slice(at, to - at).to_pylist()), table.kept_as)
        yield ids.astype(np.int32), sizes[at:to]
        at = to


def _fitted(table: Subwords, model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = Fit(model)
        for batch in batches:
            for ids, sizes in _kept_ids(table, batch):
                fit.learn(_before(ids, sizes, table.end), ids, sizes)
        for row in packed(fit, CHUNK_IDS):
            yield _chunks([row])

    return run


def _averages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of weighted means for each chunk; a task holds all rows of its chunks."""
    sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            at, weight = np.frombuffer(row["at"], np.int64), np.frombuffer(row["weight"], np.float64)
            value = np.frombuffer(row["value"], np.float32).reshape(len(at), -1)
            if row["chunk"] not in sums:
                n = CHUNK_IDS if row["chunk"] >= 0 else 1
                sums[row["chunk"]] = np.zeros(n), np.zeros((n, value.shape[1]))
            total, held = sums[row["chunk"]]
            total[at] += weight
            held[at] += value * weight[:, None]
    for chunk, (total, held) in sums.items():
        at = np.flatnonzero(total)
        yield _chunks([(chunk, at.tobytes(), total[at].tobytes(), (held[at] / total[at, None]).astype(np.float32).tobytes())])


def _coded(table: Subwords, end_count: int):
    """Texts as ids, and what the base model gives them for the words of the table."""
    weight = np.log10(table.counts + 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in slices(batch["text"]):
                words, n = Words(data, offsets), len(offsets) - 1
                ids, sizes, place, hashes = table.of(data, words)
                counts = np.diff(words.ranges)
                text = np.repeat(np.arange(n), counts)
                known = place >= 0
                base = np.bincount(text[known], weight[place[known]], n) + np.log10(end_count + 1.0)
                n_known = np.bincount(text[known], minlength=n) + (end_count > 0)
                stops = np.concatenate(([0], np.cumsum(np.bincount(text[~known], minlength=n))))
                rare = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(hashes[~known]))
                doc_ids = batch["doc_id"].slice(at, n)
                out = pa.array([held_out(i) for i in doc_ids.to_pylist()], pa.bool_())
                kept = np.concatenate(([0], np.cumsum(sizes))) * np.dtype(table.kept_as).itemsize
                whole = ids.astype(table.kept_as).tobytes()
                held = pa.array([whole[a:b] for a, b in zip(kept[:-1].tolist(), kept[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [doc_ids, out, pa.array(counts + 1), pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(sizes), pa.array(np.diff(offsets)), held, rare],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base", "n_ids", "n_bytes", "ids", "rare"],
                )

    return run


def _scored(table: Subwords, scorer: Scorer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [np.empty(0)]
            for ids, sizes in _kept_ids(table, batch):
                logs = scorer.score(_before(ids, sizes, table.end), ids, sizes)
                score.append(np.add.reduceat(logs, np.cumsum(sizes) - sizes))
            yield batch.drop_columns(["ids", "n_bytes"]).append_column("score", pa.array(np.concatenate(score)))

    return run


def score(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per row of ``docs`` (doc_id long, text string; others are
    ignored): doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score (both log10), n_ids (subword ids with the end).

    Null texts are empty: one end. A null id counts as the empty text for the
    fold. Repeated rows are learnt from and scored as often as they come. Where
    nothing is learnt from, counts are 0. No rows give no rows.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    with open(path, "rb") as f:
        ranks = f.read()
    size = 1 + max(int(line.split()[1]) for line in ranks.splitlines() if line)
    counted = docs.mapInArrow(_word_counts, "hash long, word string, n long").groupBy("hash").agg(F.min("word").alias("word"), F.sum("n").alias("n"))
    counted = counted.where("n > 0").mapInArrow(_encoded_words(ranks, pattern), "hash long, n long, ids array<int>")
    words = scratch.write(counted, "words")
    total = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.sum(F.when(F.col("hash") == int(_END_WORD), F.col("n"))).alias("e")).first()
    n, v, ends = total["n"] or 0, total["v"], total["e"] or 0
    counts = np.zeros(size + 1, np.int64)
    counts[size] = ends
    by_id = words.select(F.explode("ids").alias("id"), "n").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # at most the vocabulary
    counts[by_id["id"].to_numpy()] = by_id["n"].to_numpy()
    top = words.where("ids is not null").orderBy(F.desc("n"), "hash").limit(FREQUENT).toArrow()
    ids = [np.array(x, np.int32) for x in top["ids"].to_pylist()]
    table = Subwords(top["hash"].to_numpy(), top["n"].to_numpy(), ids, ranks, pattern, size)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, n_ids long"
    coded = docs.mapInArrow(_coded(table, ends), schema + ", n_bytes long, ids binary, rare array<long>").withColumn("row", F.monotonically_increasing_id())
    coded = scratch.write(coded, "coded")
    model = Model.start(counts)
    for _ in range(PASSES):
        fitted = coded.where("not held_out").select("n_ids", "n_bytes", "ids").mapInArrow(_fitted(table, model), _CHUNK)
        means = fitted.repartition("chunk").mapInArrow(_averages, _CHUNK)
        model = averaged(model, (tuple(r.values()) for r in means.toArrow().to_pylist()), CHUNK_IDS)

    made = coded.drop("rare").mapInArrow(_scored(table, Scorer(model)), schema + ", row long, score double")
    made = scratch.write(made, "scored")
    rare = coded.select("row", F.explode("rare").alias("hash")).groupBy("row", "hash").agg(F.count(F.lit(1)).alias("times"))
    rare = rare.join(words.select("hash", "n"), "hash").groupBy("row")
    rare = rare.agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("plus"))
    out = made.join(rare, "row", "left")
    base = F.col("base") + F.coalesce("plus", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(n + v + 1))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score", "n_ids",
    )
