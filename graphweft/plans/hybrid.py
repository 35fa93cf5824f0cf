"""Hybrid retrieval: vector or name matches widened over the graph."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphweft.functions.vectors import is_nonzero
from graphweft.operators.lookup import get_entity, name_search
from graphweft.operators.traverse import incidences
from graphweft.operators.vector import topk_overall, vector_topk
from graphweft.schema import (
    DEFAULT_TOP_K,
    DEPENDENCY_EDGE_TYPES,
    EXPANSION_DECAY,
    GRAPH_WEIGHT,
    SEARCHABLE_KINDS,
    SIMILAR_TOP_K,
    VECTOR_WEIGHT,
    KnowledgeGraph,
)
from graphweft.session import Scratch, seek_edges

# A match table holds at most k rows per query and is counted when written. Up to
# this many rows it is broadcast to the edges, beyond that it is joined.
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class SearchResult:
    """``results``: one row per (query, entity). ``related``: one row per edge of
    a match, long form, because a hub match can have any number of them."""

    results: DataFrame
    related: DataFrame


def relevance(vector_score, distance):
    return VECTOR_WEIGHT * vector_score + GRAPH_WEIGHT / (1 + distance)


def first_matches(graph: KnowledgeGraph, queries: DataFrame, k: int, by_vector: int = 1, by_name: int = 1) -> DataFrame:
    """Direct matches, at most ``k`` per query: by vector where the query has a
    usable one, by name otherwise. ``queries`` holds (query_id, text, vector);
    how many go each way can be given, so that a way that none goes is left out.
    Columns: query_id, name, qualified_name, kind, score, rank."""
    usable = is_nonzero(F.col("vector"))
    hits = []
    if by_vector:
        hits.append(vector_topk(graph.entities, queries.where(usable).select("query_id", "vector"), k, SEARCHABLE_KINDS))
    if by_name or not hits:
        hits.append(name_search(graph.entities, queries.where(~usable).select("query_id", "text"), k, graph.names))
    return topk_overall(reduce(DataFrame.unionByName, hits), k)


def _hinted(matches: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(matches) if rows <= BROADCAST_ROWS else matches


def incident_rows(graph: KnowledgeGraph, matches: DataFrame, rows: int) -> DataFrame:
    """Edges of the matches seen from the match, both directions in one scan."""
    near = matches.select("query_id", F.col("qualified_name").alias("near_qn"), "score")
    edges = seek_edges(graph.relationships, graph.incoming, ["from_qn", "to_qn"], near.select("near_qn"))
    return incidences(edges, "both").join(_hinted(near, rows), "near_qn").select(
        "query_id", F.col("near_qn").alias("match_qn"), "score", "far_kind", "far_qn", "rel_type"
    )


def expansions(graph: KnowledgeGraph, matches: DataFrame, rows: int) -> DataFrame:
    """Neighbours of the matches that are not matches themselves: half the score
    of their best match, at distance 1."""
    best = (
        incident_rows(graph, matches, rows)
        .groupBy("query_id", "far_qn")
        .agg(F.max("score").alias("score"), F.min("far_kind").alias("kind"))
        .withColumnRenamed("far_qn", "qualified_name")
    )
    fresh = best.join(_hinted(matches.select("query_id", "qualified_name"), rows), ["query_id", "qualified_name"], "left_anti")
    return fresh.select("query_id", "qualified_name", "kind", (F.col("score") * EXPANSION_DECAY).alias("vector_score"))


def search(graph: KnowledgeGraph, queries: DataFrame, k: int = DEFAULT_TOP_K) -> SearchResult:
    """Hybrid search for every query of (query_id, text, vector).

    The queries are evaluated once. The matches of the first step are written to
    the scratch folder: they are few, and all later steps read them.
    """
    scratch = Scratch(graph.entities.sparkSession)
    asked = queries.select(F.col("query_id").cast("bigint").alias("query_id"), "text", "vector")
    # Vectors of a few queries travel in the plan; texts are joined to the names.
    usable = F.when(is_nonzero(F.col("vector")), 1)
    asked, count, by_vector = scratch.write_counted(asked.withColumn("_usable", usable), "queries", "_usable")
    matches, rows, _ = scratch.write_counted(first_matches(graph, asked.drop("_usable"), k, by_vector, count - by_vector), "matches")

    # An entity matched under two kinds counts once, with its lower match.
    direct = matches.groupBy("query_id", "qualified_name").agg(F.max_by(F.struct("name", "kind", "score"), "rank").alias("m"))
    direct = direct.select(
        "query_id",
        "m.name",
        "qualified_name",
        "m.kind",
        F.col("m.score").alias("vector_score"),
        F.lit(0).alias("graph_distance"),
        F.lit("Vector").alias("source"),
    )
    widened = expansions(graph, matches, rows).select(
        "query_id",
        F.lit(None).cast("string").alias("name"),
        "qualified_name",
        "kind",
        "vector_score",
        F.lit(1).alias("graph_distance"),
        F.lit("GraphExpansion").alias("source"),
    )
    scored = direct.unionByName(widened).withColumn("relevance", relevance(F.col("vector_score"), F.col("graph_distance")))
    order = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "qualified_name")
    cut = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    # Names are joined after the cut: at most k rows per query need one, and they
    # go to the entities rather than the entities to them.
    names = graph.entities.select("kind", "qualified_name", F.col("name").alias("_name"))
    results = names.join(_hinted(cut, k * count), ["kind", "qualified_name"]).select(
        "query_id",
        "rank",
        F.coalesce("name", "_name").alias("name"),
        "qualified_name",
        "kind",
        "vector_score",
        "graph_distance",
        "relevance",
        "source",
    )
    return SearchResult(results, related(graph, matches, rows))


def related(graph: KnowledgeGraph, matches: DataFrame, rows: int) -> DataFrame:
    """One row per edge of a match: (query_id, match_qn, name, qualified_name,
    kind, relationship, direction)."""
    names = graph.entities.select(F.col("kind").alias("far_kind"), F.col("qualified_name").alias("far_qn"), "name")
    return (
        incident_rows(graph, matches, rows)
        .join(names, ["far_kind", "far_qn"])
        .select(
            "query_id",
            "match_qn",
            "name",
            F.col("far_qn").alias("qualified_name"),
            F.col("far_kind").alias("kind"),
            F.col("rel_type").alias("relationship"),
            F.lit("both").alias("direction"),
        )
    )


def explain_edges(graph: KnowledgeGraph, targets: DataFrame) -> DataFrame:
    """Callers, callees, dependencies and dependents of every target in one scan
    of the edges: (target, section, name, qualified_name, kind, relationship,
    direction)."""
    wanted = targets.select(F.col("qualified_name").alias("target"))
    dependency = F.col("rel_type").isin(*DEPENDENCY_EDGE_TYPES)
    edges = seek_edges(graph.relationships, graph.incoming, ["from_qn", "to_qn"], wanted).where((F.col("rel_type") == "CALLS") | dependency)

    def side(target: str, far: str, direction: str, calls: str, depends: str):
        return F.struct(
            F.col(f"{target}_qn").alias("target"),
            F.when(F.col("rel_type") == "CALLS", calls).otherwise(depends).alias("section"),
            F.col(f"{far}_kind").alias("kind"),
            F.col(f"{far}_qn").alias("qualified_name"),
            F.col("rel_type").alias("relationship"),
            F.lit(direction).alias("direction"),
        )

    sides = F.array(
        side("to", "from", "in", "callers", "dependents"), side("from", "to", "out", "callees", "dependencies")
    )
    seen = edges.select(F.inline(sides)).join(wanted, "target", "left_semi")
    names = graph.entities.select("kind", "qualified_name", "name")
    return seen.join(names, ["kind", "qualified_name"]).select(
        "target", "section", "name", "qualified_name", "kind", "relationship", "direction"
    )


def explain_heads(graph: KnowledgeGraph, targets: DataFrame) -> DataFrame:
    """Name and kind per target. An unknown target takes the least kind among
    its neighbours, or ``Unknown``."""
    wanted = targets.select("qualified_name").distinct()
    found = get_entity(graph.entities, wanted).select("qualified_name", F.col("kind").alias("own"))
    missing = wanted.join(found, "qualified_name", "left_anti")
    # A few unknown targets are looked up where the edges are sorted by either end.
    edges = seek_edges(graph.relationships, graph.incoming, ["from_qn", "to_qn"], missing)
    around = (
        incidences(edges, "both")
        .join(missing.withColumnRenamed("qualified_name", "near_qn"), "near_qn", "left_semi")
        .groupBy(F.col("near_qn").alias("qualified_name"))
        .agg(F.min("far_kind").alias("around"))
    )
    return (
        wanted.join(found, "qualified_name", "left")
        .join(around, "qualified_name", "left")
        .select(
            F.substring_index("qualified_name", "::", -1).alias("name"),
            "qualified_name",
            F.coalesce("own", "around", F.lit("Unknown")).alias("kind"),
        )
    )


@dataclass(frozen=True)
class Explanation:
    heads: DataFrame
    edges: DataFrame
    similar: DataFrame


def explain(graph: KnowledgeGraph, targets: DataFrame, embedder=None) -> Explanation:
    """Full context of every target. ``embedder`` turns (query_id, text) into
    (query_id, text, vector); without one the similar list comes from names.
    ``similar`` carries the target as ``target``."""
    named = targets.select(F.col("qualified_name").alias("text")).distinct()
    # Numbers are unique once written; a hash of the name would not be.
    keyed = Scratch(targets.sparkSession).write(named.select(F.monotonically_increasing_id().alias("query_id"), "text"), "targets")
    asked = embedder(keyed) if embedder else keyed.withColumn("vector", F.lit(None).cast("array<double>"))
    hits = search(graph, asked, SIMILAR_TOP_K).results
    similar = hits.join(keyed.withColumnRenamed("text", "target"), "query_id").drop("query_id")
    return Explanation(explain_heads(graph, targets), explain_edges(graph, targets), similar)
