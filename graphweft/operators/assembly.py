"""Graph assembly: merging extracted parts into one graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Keep the row with the greatest ``order`` per key.

    A ``max_by`` aggregate rather than a ranking window: rows of one key shrink
    to one per task before the shuffle, however many copies the key has.
    """
    payload = [c for c in df.columns if c not in keys]
    latest = F.max_by(F.struct(*payload), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(latest).select(*keys, "_row.*").select(*df.columns)


def merge_entities(parts: list[DataFrame], order: list[Column] | None = None) -> DataFrame:
    """Union of entity tables in which a later part replaces an earlier one with
    the same qualified name. ``order`` ranks rows inside one part; without it
    the last by line, then kind, end and hash, so that no tie is left open."""
    tagged = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    union = reduce(DataFrame.unionByName, tagged)
    rank = [F.col("_part"), *(order or [F.col("line_start"), F.col("kind"), *(F.col(c) for c in ("line_end", "source_hash") if c in union.columns)])]
    return last_wins(union, ["qualified_name"], rank).drop("_part")


def merge_relationships(parts: list[DataFrame]) -> DataFrame:
    """Bag union: duplicates stay until the graph is stored."""
    return reduce(DataFrame.unionByName, parts)


def graph_counts(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """One row per measure: entities, relationships, distinct source hashes."""
    counted = entities.agg(F.count(F.lit(1)).alias("n")).select(F.lit("entities").alias("measure"), "n")
    edges = relationships.agg(F.count(F.lit(1)).alias("n")).select(F.lit("relationships").alias("measure"), "n")
    if "source_hash" not in entities.columns:
        return counted.unionByName(edges)
    hashes = (
        source_hashes(entities).agg(F.count(F.lit(1)).alias("n")).select(F.lit("source_hashes").alias("measure"), "n")
    )
    return counted.unionByName(edges).unionByName(hashes)


def source_hashes(entities: DataFrame) -> DataFrame:
    return entities.where(F.col("source_hash").isNotNull()).select("source_hash").distinct()


def group_sizes(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Rows per label and per edge type, the groups a store is partitioned by."""
    labels = entities.groupBy(F.lit("kind").alias("grouped_by"), F.col("kind").alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    types = relationships.groupBy(F.lit("rel_type").alias("grouped_by"), F.col("rel_type").alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return labels.unionByName(types)
