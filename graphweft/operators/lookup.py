"""Point lookup, name search and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.operators.names import SEARCH_COLUMNS, NameIndex, name_score, search_names
from graphweft.schema import kinds_dimension
from graphweft.session import seek


def get_entity(entities: DataFrame, keys: DataFrame) -> DataFrame:
    """First entity of any kind per requested qualified name, with score 1.0.
    ``keys`` holds a ``qualified_name`` column."""
    wanted = keys.select("qualified_name")
    candidates = seek(entities.select("qualified_name", "kind", "name"), ["qualified_name"], wanted)
    found = candidates.join(wanted, "qualified_name", "left_semi")
    return found.groupBy("qualified_name").agg(F.min(F.struct("kind", "name")).alias("first")).select(
        F.col("first.name").alias("name"), "qualified_name", F.col("first.kind").alias("kind"), F.lit(1.0).alias("score")
    )


def scan_kind(entities: DataFrame, kind: str) -> DataFrame:
    return entities.where(F.col("kind") == kind)


def name_search(entities: DataFrame, queries, k: int, index: NameIndex | None = None) -> DataFrame:
    """Case-insensitive substring search over names and qualified names.

    ``queries`` is a DataFrame of (query_id, text), joined to the entities by
    trigrams (``names.search_names``), or a list that the caller wrote: one text
    is a plain filter with a bounded heap for its top ``k``.
    """
    if isinstance(queries, DataFrame):
        return search_names(entities, queries, k, index)
    rows = [tuple(q) for q in queries]
    if len(rows) != 1:
        return search_names(entities, entities.sparkSession.createDataFrame(rows, "query_id bigint, text string"), k, index)
    query_id, text = rows[0]
    score = name_score(F.lower("name"), F.lower("qualified_name"), F.lower(F.lit(text)))
    hits = entities.select(F.lit(query_id).cast("bigint").alias("query_id"), *SEARCH_COLUMNS[1:4], score.alias("score"))
    return hits.where("score IS NOT NULL").orderBy(F.desc("score"), "qualified_name", "kind").limit(k)


def graph_stats(entities: DataFrame) -> DataFrame:
    """Entities per kind, kinds without any included, and the grand total under
    the kind ``Total``."""
    counts = entities.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    known = kinds_dimension(entities.sparkSession).select("kind")
    # ``known`` has 26 rows and ``counts`` one per kind: both sides stay tiny.
    full = known.join(counts, "kind", "full_outer").select("kind", F.coalesce("n", F.lit(0)).alias("n"))
    return full.rollup("kind").agg(F.sum("n").alias("n"), F.grouping("kind").alias("_total")).select(
        F.when(F.col("_total") == 1, "Total").otherwise(F.col("kind")).alias("kind"), "n"
    )


