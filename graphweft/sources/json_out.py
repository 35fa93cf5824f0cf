"""Results as JSON documents, one per row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.plans.hybrid import SearchResult

# Related entries per document. A match with more of them continues in further
# documents, so that no row grows with the degree of a hub.
RELATED_PER_DOCUMENT = 1000


def search_json(result: SearchResult, per_document: int = RELATED_PER_DOCUMENT) -> DataFrame:
    """(query_id, rank, part, json). Absent values and empty lists are left out
    of the text."""
    keys = ["query_id", "match_qn"]
    sizes = result.related.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / per_document).cast("int").alias("parts"))
    entry = F.struct("name", "qualified_name", "kind", "relationship", "direction")
    # Entries spread over the documents of their match by hash, so the split
    # needs no ordering of the whole list.
    part = F.pmod(F.xxhash64("qualified_name", "kind", "relationship", "name"), F.col("parts")).cast("int")
    lists = (
        result.related.join(sizes, keys)
        .select(*keys, part.alias("part"), entry.alias("entry"))
        .groupBy(*keys, "part")
        .agg(F.array_sort(F.collect_list("entry")).alias("related"))
    )
    rows = result.results.join(
        lists.withColumnRenamed("match_qn", "qualified_name"), ["query_id", "qualified_name"], "left"
    )
    document = F.struct(
        "name",
        "qualified_name",
        "kind",
        "vector_score",
        "graph_distance",
        "relevance",
        "source",
        F.when(F.size("related") > 0, F.col("related")).alias("related"),
    )
    return rows.select("query_id", "rank", F.coalesce("part", F.lit(0)).alias("part"), F.to_json(document).alias("json"))


def rows_json(df: DataFrame) -> DataFrame:
    """Any result table with one JSON document per row; nulls are left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").text(path)
