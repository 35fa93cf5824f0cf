"""Registered queries over a stored graph: batches, and indexing what changed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphweft.operators import upsert
from graphweft.plans.graph_queries import KG_SQL
from graphweft.plans.index import index_changes
from graphweft.plans.registry import query
from graphweft.schema import ENTITY_SCHEMA, RELATIONSHIP_SCHEMA, KnowledgeGraph, conform
from graphweft.session import scratch_root
from graphweft.sources import tables
from graphweft.sources.store import GraphStore
from graphweft.sources.tables import template_sql


def _store(spark: SparkSession, **settings) -> GraphStore:
    return GraphStore(spark, f"{scratch_root(spark)}/graphweft/{uuid.uuid4().hex}/store", **settings)


def _rows(graph: KnowledgeGraph, third: str) -> DataFrame:
    """Both tables as rows (part, label, key, value)."""
    nodes = graph.entities.select(F.lit("node").alias("part"), F.col("kind").alias("label"), F.col("qualified_name").alias("key"), F.col(third).alias("value"))
    return nodes.unionByName(
        graph.relationships.select(F.lit("edge").alias("part"), F.col("rel_type").alias("label"), F.concat_ws(" ", "from_qn", "to_qn").alias("key"), F.lit(None).cast("string").alias("value"))
    )


@query(
    "store_batches",
    f"""WITH {KG_SQL}, gone AS (SELECT 'supplier::' || s_suppkey AS qn FROM supplier WHERE s_acctbal < 0 AND s_suppkey % 2 = 1),
used AS (SELECT 'supplier::' || s_suppkey AS from_qn, 'bench::' || item_id AS to_qn FROM supplier JOIN benchmark ON item_id = s_suppkey WHERE item_id % 2 = 0)
SELECT 'node' AS part, kind AS label, n.qualified_name AS key, CASE WHEN s_acctbal < 0 THEN 'low ' || name ELSE name END AS value
FROM kg_nodes n LEFT JOIN supplier ON n.qualified_name = 'supplier::' || s_suppkey WHERE n.qualified_name NOT IN (SELECT qn FROM gone)
UNION ALL SELECT 'node', 'Constant', 'bench::' || item_id, 'again' FROM benchmark WHERE item_id % 2 = 0
UNION ALL SELECT 'edge', rel_type, from_qn || ' ' || to_qn, NULL FROM kg_edges WHERE from_qn NOT IN (SELECT qn FROM gone) AND to_qn NOT IN (SELECT qn FROM gone)
UNION ALL SELECT 'edge', 'USES_TYPE', from_qn || ' ' || to_qn, NULL FROM used""",
)
def _store_batches(spark, sf_dir):
    """A saved graph after two batches: an upsert, and one that makes much stale."""
    graph = tables.kg(spark, sf_dir)
    supplier, bench = (tables.table(spark, sf_dir, t) for t in ("supplier", "benchmark"))
    edge_schema = T.StructType.fromDDL(GraphStore._SCHEMAS["relationships"])
    store = _store(spark)
    store.save(KnowledgeGraph(conform(graph.entities, ENTITY_SCHEMA), conform(graph.relationships, edge_schema).select(*upsert.EDGE_COLUMNS)))

    def nodes(df: DataFrame, kind: str, key, name, digest) -> DataFrame:
        return conform(df, ENTITY_SCHEMA, kind=F.lit(kind), qualified_name=key, name=name, source_hash=F.sha2(digest, 256))

    low = nodes(supplier.where("s_acctbal < 0"), "Struct", tables.key_of("supplier", "s_suppkey"), F.concat(F.lit("low "), "s_name"), F.col("s_name"))
    items = nodes(bench, "Constant", tables.key_of("bench", "item_id"), F.col("item_id").cast("string"), F.col("text"))
    uses = supplier.join(bench, F.col("s_suppkey") == F.col("item_id"))
    bag = conform(uses, RELATIONSHIP_SCHEMA, from_qn=tables.key_of("supplier", "s_suppkey"), to_qn=tables.key_of("bench", "item_id"), rel_type=F.lit("USES_TYPE"))
    store.apply(low.unionByName(items), bag)
    again = nodes(bench.where("item_id % 2 = 0"), "Constant", tables.key_of("bench", "item_id"), F.lit("again"), F.concat("text", F.lit("2")))
    current = again.select("source_hash").unionByName(supplier.where("s_suppkey % 2 = 0").select(F.sha2("s_name", 256).alias("source_hash")))
    return _rows(store.apply(again, bag.limit(0), current), "name")


_MAKE, _BUILD = "def make_{p_partkey}(x):\n    return x", "def build_{p_partkey}(x):\n    return x"
_HELP = "def help_{s_suppkey}(x):\n    return x"


def _module_sql(rows: str, path: str, name: str, text: str) -> str:
    path, name, text = (template_sql(t) for t in (path, name, text))
    return f"""SELECT 'node' AS part, 'File' AS label, {path} AS key, sha256({text} || chr(10)) AS value FROM {rows}
UNION ALL SELECT 'node', 'Function', {path} || '::' || {name}, sha256({text}) FROM {rows}
UNION ALL SELECT 'edge', 'CONTAINS', {path} || ' ' || {path} || '::' || {name}, NULL FROM {rows}"""


@query(
    "incremental_index",
    "\nUNION ALL ".join([
        _module_sql("(SELECT * FROM part WHERE p_size % 5 <> 0 AND p_size % 7 <> 0)", "p/{p_partkey}.py", "make_{p_partkey}", _MAKE),
        _module_sql("(SELECT * FROM part WHERE p_size % 5 = 0 AND p_size % 7 <> 0)", "p/{p_partkey}.py", "build_{p_partkey}", _BUILD),
        _module_sql("supplier", "s/{s_suppkey}.py", "help_{s_suppkey}", _HELP),
    ]),
)
def _incremental_index(spark, sf_dir):
    """Source files of all parts, indexed; then some changed, some gone and some
    new. What is not to be read again has another text by then."""
    part, supplier = (tables.table(spark, sf_dir, t) for t in ("part", "supplier"))
    path = F.expr(template_sql("p/{p_partkey}.py"))
    text = lambda template: F.concat(F.expr(template_sql(template)), F.lit("\n"))
    first = part.select(path.alias("path"), text(_MAKE).alias("source"))
    changed = F.col("p_size") % 5 == 0
    left = part.where("p_size % 7 <> 0").select(path.alias("path"), F.when(changed, text(_BUILD)).otherwise("x = 1\n").alias("source"), F.when(changed, 2).otherwise(1).alias("at"))
    new = supplier.select(F.expr(template_sql("s/{s_suppkey}.py")).alias("path"), text(_HELP).alias("source"), F.lit(2).alias("at"))
    second = left.unionByName(new)

    def listed(files: DataFrame, at) -> DataFrame:
        return files.select("path", F.lit(1).cast("long").alias("size"), at.cast("long").alias("modified"))

    store = _store(spark, by_file=True)
    index_changes(store, listed(first, F.lit(1)), lambda paths: paths.join(first, "path"))
    graph = index_changes(store, listed(second, F.col("at")), lambda paths: paths.join(second.select("path", "source"), "path"))
    return _rows(graph, "source_hash")
