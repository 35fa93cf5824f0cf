"""Mixing sources to target weights by a low-discrepancy schedule.

The points t * golden ratio (mod 1), t = 0, 1, .., fill the unit interval evenly
at every length. Each point is a slot of one block of words; the source whose
share of the cumulative targets holds the point fills it. The slots of a source
are ranked, its documents are put in an order drawn by hash and cut into blocks
of equal words, and block r fills its slot of rank r; a source that is taken more
than once starts over. So any stretch of the mix has the target shares.

All steps are joins by equality and sums. The two running counts over a source,
ranks of slots and offsets of documents, are made within chunks first and
then over the chunks, so no source is gathered in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweft.llm.words import WORD_CLASS
from graphweft.session import Scratch

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: A source, and so a document, is taken so many times at most.
MOST_TIMES = 3
#: Words of a block, unless the input is so small that this gives under ``LEAST_SLOTS`` slots.
BLOCK_WORDS, LEAST_SLOTS = 1024, 1 << 17
#: Cells of the unit interval by which points find their source.
CELLS = 1 << 14
CHUNK = 1 << 14
_GOLDEN = (math.sqrt(5) - 1) / 2
_STRIDE = 1 << 20
_GOLDEN_STRIDE = (_STRIDE * _GOLDEN) % 1.0


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, times: int = MOST_TIMES) -> DataFrame:
    """``sizes`` (source, source_size) with weight and target: shares of the
    total by weight, none above ``times`` its size, the excess going to the others
    by weight until none is above. Sources are weighed by code point, null last."""
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weighed = sizes.withColumn("weight", F.get(F.array(*map(F.lit, weights)), (place % len(weights)).cast("int")).cast("double"))
    limit = F.col("source_size") * times
    order = Window.orderBy((limit / F.col("weight")), F.col("source").isNull(), "source")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    # what each unit of weight gets if exactly the sources before this one are full
    level = (total - F.coalesce(F.sum(limit).over(before), F.lit(0))) / F.sum("weight").over(after)
    fits = weighed.withColumn("level", level).withColumn("at", F.row_number().over(order))
    fits = fits.withColumn("fits", limit >= F.col("level") * F.col("weight"))
    level = F.min_by("level", F.when(F.col("fits"), F.col("at"))).over(Window.partitionBy())
    out = fits.withColumn("level", level)
    return out.select("source", "source_size", "weight", F.least(limit.cast("double"), F.col("level") * F.col("weight")).alias("target"))


def _point(t: Column) -> Column:
    """Fraction of t * golden ratio, in two parts so that a large t loses no digits."""
    part = lambda x: x - F.floor(x)
    high, low = F.floor(t / _STRIDE), t % _STRIDE
    return part(part(high * F.lit(_GOLDEN_STRIDE)) + part(low * F.lit(_GOLDEN)))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, times: int = MOST_TIMES, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, targets, pieces) of a mix of ``docs`` (doc_id long, text,
    source; others are ignored).

    documents: row, doc_id, source, size (words of the text) and the columns of
    docs named in ``carry``; targets: source,
    source_size, weight, target; pieces: slot, source, row, turn, begin, end: words
    begin to end (0-based, end excluded) of a document fill a slot, for the turn-th
    time through its source. A slot may hold pieces of several documents, in the order of
    (turn, offset of the document). Null texts have size 0 and fill nothing; a null
    source is a source; repeated rows are documents of their own. No rows give no rows.
    """
    scratch = Scratch(docs.sparkSession)
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD_CLASS)), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), *carry)
    rows = scratch.write(rows.withColumn("row", F.monotonically_increasing_id()), "sizes")
    aims = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, times)
    aims = scratch.write(aims.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")).cast("long")), "targets")
    total = aims.agg(F.sum("source_size")).first()[0] or 0
    block = max(1, min(BLOCK_WORDS, total // LEAST_SLOTS))

    # The sources' ranges of the unit interval, by the cells they touch.
    upto = F.sum("target").over(Window.orderBy("sid"))
    ranges = aims.where("target > 0").withColumn("hi", upto / F.lit(float(total or 1))).withColumn("lo", F.lag("hi", 1, 0.0).over(Window.orderBy("sid")))
    ranges = ranges.withColumn("hi", F.when(F.lead("sid").over(Window.orderBy("sid")).isNull(), 2.0).otherwise(F.col("hi")))
    cells = F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))
    ranges = ranges.select("sid", "lo", "hi", F.explode(cells).alias("cell"))
    slots = docs.sparkSession.range(-(-total // block)).select(F.col("id").alias("slot"), _point(F.col("id")).alias("u"))
    slots = slots.withColumn("cell", F.floor(F.col("u") * CELLS)).join(ranges, "cell").where("u >= lo and u < hi")
    slots = scratch.write(slots.select("slot", "sid", F.floor(F.col("slot") / CHUNK).alias("chunk")), "slots")
    held = slots.groupBy("sid", "chunk").agg(F.count(F.lit(1)).alias("n"))
    held = held.withColumn("first", F.sum("n").over(Window.partitionBy("sid").orderBy("chunk")) - F.col("n")).drop("n")
    rank = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1
    slots = slots.withColumn("rank", rank).join(held, ["sid", "chunk"]).select("slot", "sid", (F.col("first") + F.col("rank")).alias("block"))

    # Where each document lies in its source's order.
    placed = rows.where("size > 0").join(aims.select("source", "sid", "source_size", "target"), rows["source"].eqNullSafe(aims["source"]))
    placed = placed.select("row", "size", "sid", "source_size", "target", F.coalesce("doc_id", F.lit(-1)).alias("doc"))
    placed = placed.withColumn("key", F.md5(F.col("doc").cast("string"))).withColumn("part", F.substring("key", 1, 3))
    parts = placed.groupBy("sid", "part").agg(F.sum("size").alias("n"))
    parts = parts.withColumn("first", F.sum("n").over(Window.partitionBy("sid").orderBy("part")) - F.col("n")).drop("n")
    inside = F.sum("size").over(Window.partitionBy("sid", "part").orderBy("key", "doc", "size", "row").rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumn("offset", inside - F.col("size")).join(parts, ["sid", "part"])
    # one row per turn through the source that the target can reach, and block that the document touches in it
    turns = F.least(F.lit(times - 1).cast("long"), F.ceil(F.col("target") / F.col("source_size")))
    placed = placed.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), turns)))
    begin = F.col("turn") * F.col("source_size") + F.col("first") + F.col("offset")
    placed = placed.select("sid", "row", "size", "turn", begin.alias("at"))
    touched = F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))
    pieces = placed.withColumn("block", F.explode(touched)).join(slots, ["sid", "block"])
    begin = F.greatest(F.col("block") * block - F.col("at"), F.lit(0))
    end = F.least((F.col("block") + 1) * block - F.col("at"), F.col("size"))
    pieces = pieces.select("slot", "sid", "row", "turn", begin.alias("begin"), end.alias("end"))
    return rows, aims.drop("sid"), pieces


def taken(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, and taken,
    the words of the document in the mix, repeats counted."""
    rows, aims, pieces = mix(docs)
    used = pieces.groupBy("row").agg(F.sum(F.col("end") - F.col("begin")).alias("taken"))
    out = rows.join(used, "row", "left").join(aims, rows["source"].eqNullSafe(aims["source"]))
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
