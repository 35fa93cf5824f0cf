"""N-gram Jaccard join by a count-vector R-tree.

The distinct n-word shingles of a text are hashed into groups; the counts of
the groups are the text's point. Two sets overlap by at most the sum of the
minima of their coordinates, so two texts that are similar enough lie within a
small sum of differences, D, which depends on their sizes only.

The upper level of the tree makes Spark's partitions. Within a class of sizes
the coordinates are cut into D + 1 ranges; two points with at most D
differences agree in one whole range, so they share its leaf: a *cell*, keyed by
class, range and the counts in it. Cells are long integers and are joined by
equality, which needs no pairs and no broadcast. Members of a cell are searched
by boxes and points with the bound, then verified exactly (``linking``).

With D differences in D + 1 ranges, one of the ranges two texts agree in also begins
a run of ``CHAIN`` ranges, the last followed by the first, with less than CHAIN
differences (else the runs that follow one another from there would count more than
D in all). So a cell carries the parities of its run in ``SKETCH_BITS`` groups, and
two members whose parities differ in more than ``MOST_APART`` bits need not meet there.

A range that is empty in both points says nothing and would gather unlike
texts; a text with an empty range takes part in a further grouping, drawn
anew, instead (``FAMILIES`` of them; one is enough for ``MANY_RANGES``). A pair is lost only if all ranges it
agrees in, with such a run, are empty in each grouping: under 10^-8 for the shortest texts.

Texts with equal sets are one class from the start and never compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.llm.linking import SKETCH_BITS, in_one_pass, link_words, parities, without_copies
from graphweft.llm.words import each_text, mix, shingles
from graphweft.session import Scratch

#: Sizes of one class differ by this factor at most.
CLASS_RATIO = 1.4
#: Coordinates in a range of the point.
RANGE = 64
FAMILIES = 7
#: Ranges whose parities stand beside a cell; ``MOST_APART`` is CHAIN - 1 or more.
CHAIN = 4
#: With so many ranges a pair agrees in ten or more, and not all of them are empty.
MANY_RANGES = 64


def _classes(limit: int) -> np.ndarray:
    """The least size of each class, up to the first above ``limit``."""
    out = [1]
    while out[-1] <= limit:
        out.append(max(out[-1] + 1, int(out[-1] * CLASS_RATIO)))
    return np.array(out, np.int64)


def _differences(most: int, num: int, den: int) -> int:
    """The largest |x| + |y| - 2 * overlap of two linked sets of at most ``most``
    members. It rises from every other total to the next, so the last two are asked."""
    return max(0, *(total - 2 * -(-num * total // (num + den)) for total in (2 * most - 1, 2 * most)))


def _runs(bits: np.ndarray) -> np.ndarray:
    """The parities of CHAIN ranges from each on; of all, if there are fewer."""
    if len(bits) <= CHAIN:
        return np.full(len(bits), np.bitwise_xor.reduce(bits))
    return np.bitwise_xor.reduce([np.roll(bits, -i) for i in range(CHAIN)])


def set_cells(items: np.ndarray, num: int, den: int) -> np.ndarray:
    """The cells of one set of distinct 64-bit hashes."""
    return set_words(items, num, den) >> np.uint64(SKETCH_BITS)


def set_words(items: np.ndarray, num: int, den: int) -> np.ndarray:
    """The cells of one set of distinct 64-bit hashes, each above the sketch of its run."""
    n = len(items)
    if n == 0:
        return np.empty(0, np.uint64)
    bounds = _classes(n * den // num + 1)
    own = int(np.searchsorted(bounds, n, "right")) - 1
    out = []
    for c in range(own, len(bounds) - 1):
        if c > own and den * n < num * bounds[c]:
            break
        most = int(bounds[c + 1]) - 1
        ranges = _differences(most, num, den) + 1
        for family in range(FAMILIES):
            place = mix(items + np.uint64(0x2545F4914F6CDD1D * (family + 1) % 2**64))
            at = ((place >> np.uint64(40)) * np.uint64(ranges) >> np.uint64(24)).astype(np.int64)
            group = mix((place % np.uint64(RANGE)) + np.uint64(1))
            counts = np.zeros(ranges, np.uint64)
            np.add.at(counts, at, group)
            filled = np.bincount(at, minlength=ranges) > 0
            key = (np.uint64(c) << np.uint64(40)) + (np.arange(ranges, dtype=np.uint64) << np.uint64(4)) + np.uint64(family)
            bits = np.zeros(ranges, np.uint64)
            np.bitwise_xor.at(bits, at, np.uint64(1) << ((place >> np.uint64(8)) % np.uint64(1 << 32) * np.uint64(SKETCH_BITS) >> np.uint64(32)))
            cells = mix(counts ^ mix(key)) >> np.uint64(SKETCH_BITS) << np.uint64(SKETCH_BITS)
            out.append((cells | _runs(bits))[filled])
            if filled.all() or ranges >= MANY_RANGES:
                break
    return np.concatenate(out)


def _features(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, _, words in each_text(batch["text"]):
                sizes, keys, cells, bits = [], [], [], []
                for i in range(len(words.ranges) - 1):
                    items = np.unique(shingles(words.of(i), k))
                    sizes.append(len(items))
                    keys.append(_key(items.tobytes()) if len(items) else None)
                    cells.append(set_words(items, num, den).view(np.int64))
                    bits.append(parities(items))
                ids, marks = batch["doc_id"].slice(at, len(sizes)), batch["mark"].slice(at, len(sizes))
                yield pa.RecordBatch.from_arrays(
                    [ids, marks, pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(cells, pa.list_(pa.int64())), pa.array(bits, pa.binary())],
                    ["doc_id", "mark", "n_shingles", "set_key", "words", "parities"],
                )

    return run


def _items(k: int):
    """Sets of texts that stand beside the key of the set that is wanted of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [n for n in batch.schema.names if n not in ("text", "set_key")]
            for at, _, words in each_text(batch["text"]):
                n = len(words.ranges) - 1
                sets = [np.unique(shingles(words.of(i), k)).tobytes() for i in range(n)]
                wanted = batch["set_key"].slice(at, n).to_pylist()
                right = pa.array([w == _key(x) for w, x in zip(wanted, sets, strict=True)], pa.bool_())
                rest = [batch[c].slice(at, n) for c in names]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(sets, pa.binary())], [*names, "items"]).filter(right)

    return run


def _key(items: bytes) -> bytes:
    return hashlib.blake2b(items, digest_size=16).digest()


def similar_texts(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """One row per row of ``docs`` (columns doc_id long, text string; others are
    ignored): doc_id, n_shingles, component_id, mark (xxhash64 of the text) and
    group (a number of the component within this result, null without shingles).

    Texts are linked when den * |x and y| >= num * |x or y| over their distinct
    k-word shingles; component_id is the smallest doc_id reachable by links.

    Null and empty texts, and texts of blanks, have n_shingles 0 and are linked
    with nothing; with fewer than k words the whole sequence is one shingle.
    Repeated rows are rows of their own in one component. Null ids are kept;
    they are never a component's id unless all its ids are null. No rows give no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = docs.withColumn("mark", F.xxhash64("text")).mapInArrow(_features(k, num, den), "doc_id long, mark long, n_shingles long, set_key binary, words array<long>, parities binary")
    texts = scratch.write(made.withColumn("uid", F.monotonically_increasing_id()), "texts")
    kinds = texts.where("set_key is not null").groupBy("set_key")
    kinds = scratch.write(kinds.agg(F.min("uid").alias("uid"), F.min("doc_id").alias("least")), "kinds")
    words = without_copies(texts, kinds, "set_key", scratch).select("uid", "words")
    total = texts.agg(F.sum(F.size("words"))).first()[0] or 0

    def fetch(uids: DataFrame, few: bool, then=None) -> DataFrame:
        wanted = uids.join(texts.select("uid", F.col("doc_id").alias("of"), "set_key"), "uid")
        found = docs.join(wanted.hint("broadcast" if few else "shuffle_hash"), docs["doc_id"].eqNullSafe(wanted["of"])).drop("doc_id", "of")
        return in_one_pass(found, _items(k), then)

    parts = link_words(words, total, fetch, num, den, scratch, texts.select("uid", "n_shingles", "parities"), whole=True).toDF("uid", "part")
    whole = kinds.join(parts, "uid", "left").select("set_key", "least", F.coalesce("part", "uid").alias("part"))
    least = whole.groupBy("part").agg(F.min("least").alias("component_id"))
    named = whole.join(least, "part").select("set_key", "component_id", "part")
    out = texts.select("doc_id", "mark", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), "mark", F.col("part").alias("group"))
