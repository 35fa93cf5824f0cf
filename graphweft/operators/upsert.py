"""Write-side set semantics: upserts, endpoint resolution, stale deletion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.schema import STORED_EDGE_PROPERTIES, KnowledgeGraph

NODE_KEY = ["kind", "qualified_name"]
EDGE_KEY = ["from_kind", "from_qn", "to_kind", "to_qn", "rel_type"]
EDGE_COLUMNS = EDGE_KEY + list(STORED_EDGE_PROPERTIES)


def upsert_entities(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """MERGE of ``batch`` into ``stored`` on (kind, qualified_name).

    A matched row takes every property of the batch, nulls included. Embeddings
    are the exception: they are written only where the batch carries one, and to
    every stored row of that qualified name whatever its kind. ``batch`` must
    hold one row per key (``merge_entities`` sees to it).
    """
    columns = [c for c in stored.columns if c in batch.columns]
    properties = [c for c in columns if c not in NODE_KEY and c != "embedding"]
    new = batch.select(*NODE_KEY, F.struct(*properties).alias("_new"), F.lit(True).alias("_hit"))
    merged = stored.join(new, NODE_KEY, "full_outer").select(
        *NODE_KEY,
        *[F.when(F.col("_hit"), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in properties],
        *(["embedding"] if "embedding" in columns else []),
    )
    if "embedding" not in columns:
        return merged.select(*columns)
    vectors = (
        batch.where(F.col("embedding").isNotNull())
        .groupBy("qualified_name")
        .agg(F.max_by("embedding", "kind").alias("_vector"))
    )
    return (
        merged.join(vectors, "qualified_name", "left")
        .withColumn("embedding", F.coalesce("_vector", "embedding"))
        .select(*columns)
    )


def resolve(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """Turn an edge bag into stored edges: one row per (from, to, type) whose
    endpoints both exist, carrying the endpoints' kinds.

    Repeated edges collapse first, inside the map tasks, so that a name called
    from everywhere does not reach the joins once per call site. The kept
    properties are those of the greatest line, missing lines last. ``entities``
    holds one row per (kind, qualified_name), as a stored graph does.
    """
    last = F.max(F.struct(*STORED_EDGE_PROPERTIES)).alias("_last")
    unique = relationships.groupBy("from_qn", "to_qn", "rel_type").agg(last)
    keys = entities.select(*NODE_KEY)
    sources = keys.toDF("from_kind", "from_qn")
    targets = keys.toDF("to_kind", "to_qn")
    return (
        unique.join(sources, "from_qn")
        .join(targets, "to_qn")
        .select(*EDGE_KEY, *[F.col(f"_last.{c}").alias(c) for c in STORED_EDGE_PROPERTIES])
    )


def upsert_relationships(stored: DataFrame, batch: DataFrame, entities: DataFrame) -> DataFrame:
    """MERGE of an edge bag into the stored edges; properties are overwritten."""
    return merge_edges(stored, resolve(batch, entities))


def merge_edges(stored: DataFrame, edges: DataFrame) -> DataFrame:
    """MERGE of resolved edges, one per key, into the stored ones. A new edge takes
    the place of the stored one whole, so stored edges only need to be told apart
    from new ones; where these are few, the stored ones are not shuffled."""
    kept = stored.join(edges.select(*EDGE_KEY), EDGE_KEY, "left_anti")
    return kept.select(*EDGE_COLUMNS).unionByName(edges.select(*EDGE_COLUMNS))


def drop_stale_entities(entities: DataFrame, current_hashes: DataFrame) -> DataFrame:
    """Entities whose hash is among ``current_hashes``, and those without a hash.
    An empty set drops nothing."""
    if current_hashes.isEmpty():
        return entities
    hashes = current_hashes.select("source_hash").distinct()
    current = entities.where(F.col("source_hash").isNotNull()).join(hashes, "source_hash", "left_semi")
    return entities.where(F.col("source_hash").isNull()).unionByName(current.select(*entities.columns))


def delete_stale(graph: KnowledgeGraph, current_hashes: DataFrame) -> KnowledgeGraph:
    """Drop stale entities and every edge that touches one."""
    if current_hashes.isEmpty():
        return graph
    hashes = current_hashes.select("source_hash").distinct()
    hashed = graph.entities.where(F.col("source_hash").isNotNull())
    removed = hashed.join(hashes, "source_hash", "left_anti").select(*NODE_KEY)
    return KnowledgeGraph(
        drop_stale_entities(graph.entities, current_hashes), detach(graph.relationships, removed)
    )


def keep_attached(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges whose both endpoints exist."""
    keys = entities.select(*NODE_KEY)
    return (
        relationships.join(keys.toDF("from_kind", "from_qn"), ["from_kind", "from_qn"], "left_semi")
        .join(keys.toDF("to_kind", "to_qn"), ["to_kind", "to_qn"], "left_semi")
        .select(*relationships.columns)
    )


def detach(relationships: DataFrame, removed: DataFrame) -> DataFrame:
    """Edges that touch none of the removed nodes."""
    return (
        relationships.join(removed.toDF("from_kind", "from_qn"), ["from_kind", "from_qn"], "left_anti")
        .join(removed.toDF("to_kind", "to_qn"), ["to_kind", "to_qn"], "left_anti")
        .select(*relationships.columns)
    )


def duplicate_keys(entities: DataFrame) -> DataFrame:
    """Violations of the key contract: (kind, qualified_name) seen more than once."""
    return entities.groupBy(*NODE_KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def dimension_violations(entities: DataFrame, dimension: int) -> DataFrame:
    """Vectors whose length is not the contracted dimension, per (kind, length)."""
    return (
        entities.where(F.col("embedding").isNotNull() & (F.size("embedding") != dimension))
        .groupBy("kind", F.size("embedding").alias("length"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def incremental_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Every qualified name of either side with its status: added, changed,
    unchanged or removed."""
    before = old.select("qualified_name", F.col("source_hash").alias("old_hash"), F.lit(True).alias("_old"))
    after = new.select("qualified_name", F.col("source_hash").alias("new_hash"), F.lit(True).alias("_new"))
    status = (
        F.when(F.col("_old").isNull(), "added")
        .when(F.col("_new").isNull(), "removed")
        .when(F.col("old_hash").eqNullSafe(F.col("new_hash")), "unchanged")
        .otherwise("changed")
    )
    return before.join(after, "qualified_name", "full_outer").select(
        "qualified_name", "old_hash", "new_hash", status.alias("status")
    )
