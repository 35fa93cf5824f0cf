"""Substring search over names by an inverted index of character trigrams.

An entity is listed under every trigram of its lower-case name and qualified
name. A text is looked up under its rarest trigram only, and what is listed
there is verified with ``contains``. A text of fewer than three characters is one
gram itself and is answered from the grams of its own length. A gram that very
many entities hold is listed in pieces, so no gram is one task's work. No text
passes the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweft.session import SEEK_KEYS, Scratch, rows_within

GRAM = 3
#: Entities listed in one piece of a gram, about.
PIECE = 100_000
SEARCH_COLUMNS = ["query_id", "name", "qualified_name", "kind", "score"]


def name_score(name: Column, qualified_name: Column, text: Column) -> Column:
    """1.0 for the whole name, 0.8 for its beginning, 0.5 for a match elsewhere
    in the name or the qualified name, null for none. Inputs are lower-case."""
    hit = F.coalesce(F.contains(name, text), F.lit(False)) | F.coalesce(F.contains(qualified_name, text), F.lit(False))
    return F.when(hit, F.when(name == text, 1.0).when(F.startswith(name, text), 0.8).otherwise(0.5))


def grams(text: Column, size: int) -> Column:
    """The different runs of ``size`` characters of a text."""
    if size == 0:
        return F.array(F.lit(""))
    last = F.length(text) - size + 1
    runs = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(size)))
    return F.when(last >= 1, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def _listed(folded: DataFrame, size: int) -> DataFrame:
    """(gram, entity) of every gram of ``size`` characters."""
    both = F.array_union(grams(F.coalesce("_n", F.lit("")), size), grams(F.coalesce("_q", F.lit("")), size))
    return folded.select(F.explode(both).alias("gram"), "entity")


def _folded(entities: DataFrame) -> DataFrame:
    key = F.xxhash64("kind", "qualified_name").alias("entity")
    return entities.select(key, "name", "qualified_name", "kind", F.lower("name").alias("_n"), F.lower("qualified_name").alias("_q"))


def _pieced(listed: DataFrame, counts: DataFrame) -> DataFrame:
    """Deal the entities of a gram over its pieces. Few grams have more than one."""
    split = counts.where("pieces > 1").select("gram", "pieces")
    return listed.join(split, "gram", "left").select("gram", F.pmod("entity", F.coalesce("pieces", F.lit(1))).alias("piece"), "entity")


def _counted(listed: DataFrame) -> DataFrame:
    return listed.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).withColumn("pieces", F.ceil(F.col("n") / PIECE))


@dataclass(frozen=True)
class NameIndex:
    """``counts``: (gram, n, pieces). ``postings``: (gram, piece, entity), sorted
    by gram at rest. Entities are listed by a hash of their key, which is only
    used to find rows: what is found is verified."""

    counts: DataFrame
    postings: DataFrame

    @classmethod
    def of(cls, entities: DataFrame, wanted: DataFrame | None = None) -> NameIndex:
        """The trigram lists of ``entities``, or those of the grams ``wanted``."""
        listed = _listed(_folded(entities), GRAM)
        if wanted is not None:
            listed = Scratch(entities.sparkSession).write(listed.join(wanted, "gram", "left_semi"), "listed")
        counts = _counted(listed)
        if wanted is not None:
            counts = Scratch(entities.sparkSession).write(counts, "counts")
        return cls(counts, _pieced(listed, counts))

    @classmethod
    def build(cls, entities: DataFrame, path: str) -> NameIndex:
        """Write the lists of all entities below ``path``."""
        spark = entities.sparkSession
        listed = _listed(_folded(entities), GRAM)
        _counted(listed).repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/counts")
        counts = spark.read.parquet(f"{path}/counts")
        ordered = _pieced(listed, counts).repartitionByRange("gram", "piece", "entity").sortWithinPartitions("gram", "piece", "entity")
        ordered.write.mode("overwrite").parquet(f"{path}/postings")
        return cls.load(spark, path)

    @classmethod
    def load(cls, spark, path: str) -> NameIndex:
        return cls(spark.read.parquet(f"{path}/counts"), spark.read.parquet(f"{path}/postings"))

    def candidates(self, texts: DataFrame) -> DataFrame:
        """(text, entity) listed under the rarest trigram of each text; a trigram
        that no entity holds rules a text out."""
        held = texts.select("text", F.explode(grams(F.col("text"), GRAM)).alias("gram"))
        rarest = held.join(self.counts, "gram", "left").groupBy("text").agg(
            F.min_by(F.struct("gram", "pieces"), F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("rarest")
        )
        rarest = rarest.select("text", "rarest.*").where("pieces > 0")
        rarest = Scratch(texts.sparkSession).write(rarest, "rarest")
        looked = rarest.select("text", "gram", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"))
        few = rows_within(rarest.select("gram").distinct(), SEEK_KEYS)
        # a few grams reach the scan as values, so files sorted by them are skipped
        lists = self.postings if few is None else self.postings.where(F.col("gram").isin(*(r[0] for r in few)))
        return lists.join(looked, ["gram", "piece"]).select("text", "entity")


def search_names(entities: DataFrame, queries: DataFrame, k: int, index: NameIndex | None = None) -> DataFrame:
    """Case-insensitive substring search over names and qualified names for any
    number of queries (query_id, text): the ``k`` best per query, by score, then
    qualified name, then kind. Columns: query_id, name, qualified_name, kind, score.

    Equal texts are searched once. A null text finds nothing, an empty one
    everything. ``index`` holds the trigram lists of these entities; without it
    the lists of the queried trigrams are made from one scan. Texts shorter than a
    trigram are answered from one more scan, made only if there are any.
    """
    scratch = Scratch(entities.sparkSession)
    asked = queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.lower("text").alias("text")).where("text IS NOT NULL")
    asked, rows, _ = scratch.write_counted(asked, "asked")
    short = F.length("text") < GRAM
    texts, _, shorts = scratch.write_counted(asked.select("text").distinct().withColumn("short", F.when(short, 1)), "texts", "short")
    folded, long_texts = _folded(entities), texts.where("short IS NULL").select("text")
    if index is None:
        index = NameIndex.of(entities, long_texts.select(F.explode(grams(F.col("text"), GRAM)).alias("gram")).distinct())
    found = [index.candidates(long_texts)]
    if shorts:
        few = texts.where("short = 1").select("text")
        # the grams of zero, one and two characters, each a whole text
        listed = reduce(DataFrame.unionByName, [_listed(folded, size) for size in range(GRAM)])
        found.append(listed.join(few.withColumnRenamed("text", "gram"), "gram").select(F.col("gram").alias("text"), "entity"))
    candidates = reduce(DataFrame.unionByName, found)
    score = name_score(F.col("_n"), F.col("_q"), F.col("text"))
    hits = folded.join(candidates, "entity").select("text", "name", "qualified_name", "kind", score.alias("score")).where("score IS NOT NULL")
    rank = Window.partitionBy("text").orderBy(F.desc("score"), "qualified_name", "kind")
    best = hits.withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= k).drop("_rank")
    return best.join(asked, "text").select(*SEARCH_COLUMNS)
