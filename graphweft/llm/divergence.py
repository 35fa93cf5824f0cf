"""Divergence of the sources of a language by the shares of its terms.

A term is a run of ASCII letters and non-ASCII characters, A-Z lowered. Tasks
count the terms of their texts in blocks; one shuffle sums them by (lang,
source, term), one more by (lang, term) finds the terms kept in a language.

Shares depend on a term only through its counts, so terms fall into cells:

- ``term``: cells of (count in the group, count in the language). The measure is
  evaluated once a cell; cells of equal value are merged, and a running sum of
  their sizes over the values in descending order tells which values reach the
  ranks asked for. Only these are expanded into terms.
- ``pair``: a term in one of the two groups only enters through its count there,
  so such terms are summed over cells of (group, count). What remains are the
  terms that two groups share, joined by term and summed in the map tasks.

All arithmetic is on whole numbers: decimals of 38 digits for the shares, 64-bit
numbers for shares and their sums.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweft.llm.words import slices
from graphweft.session import Scratch

#: A term is kept in a language if so many of its texts hold it.
LEAST_TEXTS = 30
#: Ranks of terms given for each group.
RANKS = 50
#: Shares are whole numbers out of SCALE; every kept term counts PRIOR times more than it was seen.
SCALE, PRIOR = 1_000_000_000, 5
#: A task hands on what it has counted at so many different terms.
HELD_TERMS = 200_000
#: A longer text is cut into pieces of about so many bytes between two terms.
PIECE_BYTES = 4 << 20

_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
_COUNTED = "lang string, source string, term string, n long, texts long"


def _pieces(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        to = data.find(b" ", at + PIECE_BYTES)
        to = len(data) if to < 0 else to
        yield data[at:to]
        at = to


def _flush(held: dict) -> pa.RecordBatch:
    rows = [(lang, source, term, n, texts[term]) for (lang, source), (seen, texts) in held.items() for term, n in seen.items()]
    columns = list(zip(*rows, strict=True)) or [()] * 5
    terms = pa.array(columns[2], pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), terms, pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())],
        ["lang", "source", "term", "n", "texts"],
    )


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple, tuple[Counter, Counter]] = {}
    for batch in batches:
        groups = list(zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), strict=True))
        for at, data, offsets in slices(batch["text"]):
            raw = data.tobytes()
            for i, (x, y) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                seen, texts = held.setdefault(groups[at + i], (Counter(), Counter()))
                folded, own = raw[x:y].translate(_FOLD), set()
                for piece in _pieces(folded):
                    found = piece.split()
                    seen.update(found)
                    own.update(found)
                texts.update(own)
            if sum(len(seen) for seen, _ in held.values()) > HELD_TERMS:
                yield _flush(held)
                held = {}
    yield _flush(held)


def _share(count: Column | str, total: str = "total", terms: str = "terms") -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)) as a whole number."""
    above = (F.col(count) if isinstance(count, str) else count).cast("decimal(19,0)") + F.lit(PRIOR).cast("decimal(2,0)")
    below = F.col(total).cast("decimal(19,0)") + F.col(terms).cast("decimal(17,0)") * F.lit(PRIOR).cast("decimal(1,0)")
    exact = F.lit(SCALE).cast("decimal(10,0)") * above
    return F.call_function("div", exact, below) + F.lit(1).cast("long")


def diverging(docs: DataFrame, least_texts: int = LEAST_TEXTS, ranks: int = RANKS) -> DataFrame:
    """How far the sources of a language lie apart: lang, source, part, item,
    value (long), rank (int from 1 in each group and part).

    docs: text, lang, source (strings; other columns are ignored). A (lang,
    source) group is any that occurs, even without terms. Of each group the part
    ``pair`` has every other source of its language with the sum of the
    differences of shares over all kept terms, the part ``term`` its terms whose
    share is above that of the language, to rank ``ranks``. Values descend, equal
    ones go by the bytes of the item.

    Null texts, languages and sources count as ''. A repeated row counts again. A
    language without kept terms has pairs of value 0 and no terms; no rows give
    none. A very long text is counted in pieces; a group may hold any share of
    all rows, since tasks hand on counts.
    """
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    scratch = Scratch(docs.sparkSession)
    counted = docs.mapInArrow(_counting, _COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))
    of_term = Window.partitionBy("lang", "term")
    kept = counted.select("lang", "source", "term", "n", F.sum("n").over(of_term).alias("lang_n"), F.sum("texts").over(of_term).alias("lang_texts"))
    kept = scratch.write(kept.where(F.col("lang_texts") >= least_texts).drop("lang_texts"), "kept")

    # (lang, source, count in the group, count in the language): how many terms
    cells = scratch.write(kept.groupBy("lang", "source", "n", "lang_n").agg(F.count(F.lit(1)).alias("cell")), "cells")
    groups = docs.select("lang", "source").distinct()
    sums = cells.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("cell")).alias("total"), F.sum("cell").alias("own_terms"))
    langs = kept.select("lang", "term", "lang_n").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    sized = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "own_terms", "terms", "lang_total"])
    sized = sized.withColumn("none", F.when(F.col("terms") > 0, _share(F.lit(0))).otherwise(F.lit(0)))
    sized = scratch.write(sized, "groups")  # one row a group
    return _pairs(kept, cells, sized).unionByName(_terms(kept, cells, sized, ranks))


def _terms(kept: DataFrame, cells: DataFrame, sized: DataFrame, ranks: int) -> DataFrame:
    key = ["lang", "source"]
    valued = cells.join(sized, key).withColumn("value", _share("n") - _share("lang_n", "lang_total"))
    valued = valued.where("value > 0").select(*key, "n", "lang_n", "value", "cell")
    merged = valued.groupBy(*key, "value").agg(F.sum("cell").alias("size"))
    down = Window.partitionBy(*key).orderBy(F.desc("value"))
    # every value has a term at least, so the highest values by number hold all ranks
    high = merged.withColumn("place", F.row_number().over(down)).where(F.col("place") <= ranks)
    before = F.sum("size").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    high = high.withColumn("before", before).where(F.col("before") < ranks).select(*key, "value")
    reached = valued.join(high, [*key, "value"]).select(*key, "n", "lang_n", "value")
    found = kept.join(reached, [*key, "n", "lang_n"])
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("value"), "term")).alias("rank")
    return found.select(*key, F.lit("term").alias("part"), F.col("term").alias("item"), "value", rank).where(F.col("rank") <= ranks)


def _pairs(kept: DataFrame, cells: DataFrame, sized: DataFrame) -> DataFrame:
    """Sums of |p - q|: over the terms of the one group with the other's share of
    a term it lacks, the same the other way round, over the terms that neither
    has, and for shared terms what they differ from the first two."""
    side = lambda of, s: of.select("lang", *(F.col(c).alias(c + s) for c in of.columns if c != "lang"))
    both = side(sized, "_a").join(side(sized.drop("terms", "lang_total"), "_b"), "lang").where("source_a <> source_b")

    counts = cells.groupBy("lang", "source", "n").agg(F.sum("cell").alias("cell")).join(sized, ["lang", "source"])
    counts = counts.select("lang", F.col("source").alias("source_a"), _share("n").alias("p"), "cell")
    lacking = sized.select("lang", F.col("source").alias("source_b"), F.col("none").alias("q"))
    # one row a (group, count) cell and other group: terms of a measured against the share of a term that b lacks
    apart = counts.join(lacking, "lang").where("source_a <> source_b").groupBy("lang", "source_a", "source_b").agg(F.sum(F.col("cell") * F.abs(F.col("p") - F.col("q"))).alias("apart"))

    shares = kept.join(sized, ["lang", "source"]).select("lang", "source", "term", _share("n").alias("p"), "none")
    a, b = (shares.select("lang", "term", *(F.col(c).alias(f"{c}_{s}") for c in ("source", "p", "none"))) for s in "ab")
    p, q, p0, q0 = (F.col(c) for c in ("p_a", "p_b", "none_a", "none_b"))
    shared = a.join(b, ["lang", "term"]).where("source_a < source_b").groupBy("lang", "source_a", "source_b").agg(
        F.count(F.lit(1)).alias("shared"), F.sum(F.abs(p - q) - F.abs(p - q0) - F.abs(q - p0)).alias("excess"),
    )
    turned = shared.select("lang", F.col("source_b").alias("source_a"), F.col("source_a").alias("source_b"), "shared", "excess")
    key = ["lang", "source_a", "source_b"]
    other = apart.select("lang", F.col("source_b").alias("source_a"), F.col("source_a").alias("source_b"), F.col("apart").alias("apart_b"))
    found = both.join(apart, key, "left").join(other, key, "left").join(shared.unionByName(turned), key, "left").na.fill(0, ["apart", "apart_b", "shared", "excess"])
    neither = F.col("terms_a") - F.col("own_terms_a") - F.col("own_terms_b") + F.col("shared")
    value = F.col("apart") + F.col("apart_b") + F.col("excess") + neither * F.abs(F.col("none_a") - F.col("none_b"))
    found = found.select("lang", F.col("source_a").alias("source"), F.lit("pair").alias("part"), F.col("source_b").alias("item"), value.alias("value"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
