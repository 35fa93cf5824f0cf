"""Registered queries over the graph view of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.functions import text
from graphweft.functions.vectors import is_nonzero, l2_normalize, norm, zeros
from graphweft.operators import assembly, embed, lookup, traverse, upsert, vector
from graphweft.plans import hybrid
from graphweft.plans.registry import query
from graphweft.schema import KnowledgeGraph, literal_table
from graphweft.session import Scratch
from graphweft.sources import json_out, tables
from graphweft.sources.files import file_entities, is_listed, route

KINDS_SQL = "['Function','Method','Struct','Enum','Trait','Module','Class','Interface','Constructor','File']"

KG_SQL = f"""
kg_nodes AS (
  SELECT 'region::' || r_regionkey AS qualified_name, r_name AS name, 'File' AS kind, NULL::FLOAT[] AS embedding FROM region
  UNION ALL SELECT 'nation::' || n_nationkey, n_name, 'Module', NULL FROM nation
  UNION ALL SELECT 'customer::' || c_custkey, c_name, 'Class', NULL FROM customer
  UNION ALL SELECT 'supplier::' || s_suppkey, s_name, 'Struct', NULL FROM supplier
  UNION ALL SELECT 'part::' || p_partkey, p_name, coalesce({KINDS_SQL}[label + 1], 'Property'), embedding
    FROM part LEFT JOIN embeddings ON vec_id = p_partkey
), kg_edges AS (
  SELECT 'File' AS from_kind, 'region::' || n_regionkey AS from_qn, 'Module' AS to_kind, 'nation::' || n_nationkey AS to_qn,
         'CONTAINS' AS rel_type, NULL::INTEGER AS line FROM nation
  UNION ALL SELECT 'Module', 'nation::' || c_nationkey, 'Class', 'customer::' || c_custkey, 'CONTAINS', NULL FROM customer
  UNION ALL SELECT 'Module', 'nation::' || s_nationkey, 'Struct', 'supplier::' || s_suppkey, 'CONTAINS', NULL FROM supplier
  UNION ALL SELECT 'Struct', 'supplier::' || l_suppkey, coalesce({KINDS_SQL}[label + 1], 'Property'), 'part::' || l_partkey,
         'CALLS', line
    FROM (SELECT l_suppkey, l_partkey, max(l_linenumber) AS line FROM lineitem GROUP BY ALL)
    LEFT JOIN embeddings ON vec_id = l_partkey
)"""

CENTROID_SQL = """
centroids AS (
  SELECT label AS query_id, list(m ORDER BY pos) AS vector
  FROM (SELECT label, pos, avg(x) AS m
        FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY ALL)
  GROUP BY label
)"""

SEARCHABLE_SQL = "('Function','Method','Struct','Enum','Trait','Module')"


def _hits_sql(searchable: bool) -> str:
    only = f"AND kind IN {SEARCHABLE_SQL}" if searchable else ""
    return f"""
hits AS (
  SELECT query_id, name, qualified_name, kind,
         round((1 + list_cosine_similarity(embedding::DOUBLE[], vector)) / 2, 6) AS score
  FROM kg_nodes, centroids WHERE embedding IS NOT NULL {only}
)"""


def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per label: the mean of its vectors, (query_id, text, vector)."""
    rows = tables.table(spark, sf_dir, "embeddings").select(F.col("label").alias("id"), F.lit(1).alias("mask"), F.col("embedding").alias("vector"))
    return embed.mean_pool(rows, 64).select(
        F.col("id").cast("bigint").alias("query_id"), F.concat(F.lit("label "), "id").alias("text"), "vector"
    )


# ---- sources and assembly ----------------------------------------------------

DOCUMENT_EXTENSIONS = {"en": "english", "fr": "french"}


@query(
    "file_entities",
    """
SELECT source || '/' || doc_id || '.' || lang AS qualified_name, doc_id || '.' || lang AS name, 'File' AS kind, 1 AS line_start,
       CASE WHEN text = '' THEN 0 WHEN text LIKE '%' || chr(10) THEN len(text) - len(replace(text, chr(10), ''))
            ELSE len(text) - len(replace(text, chr(10), '')) + 1 END::INTEGER AS line_end,
       sha256(text) AS source_hash,
       CASE lang WHEN 'en' THEN 'english' ELSE 'french' END AS language
FROM documents WHERE lang IN ('en', 'fr') AND source <> 'src3'""",
)
def _file_entities(spark, sf_dir):
    files = tables.document_files(spark, sf_dir).where(is_listed(F.col("path"), ["src3/**"]))
    known = literal_table(spark, "ext, language", list(DOCUMENT_EXTENSIONS.items()))
    entities = file_entities(route(files, known)).select(
        F.col("qualified_name").alias("path"), "qualified_name", "name", "kind", "line_start", "line_end", "source_hash"
    )
    return route(entities, known).drop("path")


@query(
    "entity_merge_last_wins",
    """
SELECT 'conv::' || conv_id AS qualified_name, role AS name, sha256(text) AS source_hash, turn::INTEGER AS line_start
FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1""",
)
def _entity_merge(spark, sf_dir):
    turns = tables.table(spark, sf_dir, "conversations").select(
        tables.key_of("conv", "conv_id").alias("qualified_name"),
        F.col("role").alias("name"),
        F.sha2("text", 256).alias("source_hash"),
        F.col("turn").cast("int").alias("line_start"),
    )
    return assembly.merge_entities([turns], [F.col("line_start")])


@query(
    "graph_counts",
    f"""WITH {KG_SQL}
SELECT 'entities' AS measure, count(*) AS n FROM (SELECT * FROM kg_nodes)
UNION ALL SELECT 'relationships', count(*) FROM (SELECT l_suppkey FROM lineitem UNION ALL SELECT from_qn FROM kg_edges)
UNION ALL SELECT 'source_hashes', count(DISTINCT sha256(name)) FROM kg_nodes""",
)
def _graph_counts(spark, sf_dir):
    nodes = tables.kg_entities(spark, sf_dir).withColumn("source_hash", text.content_hash(F.col("name")))
    bag = assembly.merge_relationships(
        [
            tables.raw_calls(spark, sf_dir).select("from_qn", "to_qn", "rel_type"),
            tables.kg_relationships(spark, sf_dir).select("from_qn", "to_qn", "rel_type"),
        ]
    )
    return assembly.graph_counts(nodes, bag)


@query(
    "source_hashes",
    "SELECT DISTINCT sha256(text) AS source_hash FROM documents",
)
def _source_hashes(spark, sf_dir):
    return assembly.source_hashes(tables.document_entities(spark, sf_dir))


@query(
    "group_sizes",
    f"""WITH {KG_SQL}
SELECT 'kind' AS grouped_by, kind AS value, count(*) AS n FROM kg_nodes GROUP BY ALL
UNION ALL SELECT 'rel_type', rel_type, count(*) FROM kg_edges GROUP BY ALL""",
)
def _group_sizes(spark, sf_dir):
    graph = tables.kg(spark, sf_dir)
    return assembly.group_sizes(graph.entities, graph.relationships)


@query(
    "embedding_text",
    """
SELECT 'part::' || p_partkey AS qualified_name,
       concat_ws(chr(10), 'Property: ' || p_name, CASE WHEN p_size > 25 THEN p_type END, NULL, p_brand) AS embedding_text
FROM part""",
)
def _embedding_text(spark, sf_dir):
    signature = F.when(F.col("p_size") > 25, F.col("p_type"))
    value = text.embedding_text(F.lit("Property"), F.col("p_name"), signature, F.lit(None).cast("string"), F.col("p_brand"))
    return tables.table(spark, sf_dir, "part").select(
        tables.key_of("part", "p_partkey").alias("qualified_name"), value.alias("embedding_text")
    )


# ---- write side --------------------------------------------------------------


def _upsert_batch(spark, sf_dir):
    """Labels rewrite documents, benchmark items are new; a label with a vector
    of the same id brings it."""
    vectors = tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    rewritten = (
        tables.table(spark, sf_dir, "labels")
        .join(vectors, "doc_id", "left")
        .select(
            F.lit("File").alias("kind"),
            tables.key_of("doc", "doc_id").alias("qualified_name"),
            F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("name"),
            F.lit(None).cast("string").alias("doc_comment"),
            F.sha2(F.concat_ws("/", "quality", "toxic"), 256).alias("source_hash"),
            "embedding",
        )
    )
    added = tables.table(spark, sf_dir, "benchmark").select(
        F.lit("Constant").alias("kind"),
        tables.key_of("bench", "item_id").alias("qualified_name"),
        F.col("item_id").cast("string").alias("name"),
        F.col("text").alias("doc_comment"),
        F.sha2("text", 256).alias("source_hash"),
        F.lit(None).cast("array<float>").alias("embedding"),
    )
    return rewritten.unionByName(added)


@query(
    "entity_upsert",
    """
WITH batch AS (
  SELECT 'File' AS kind, 'doc::' || doc_id AS qualified_name, 'quality ' || quality AS name, NULL AS doc_comment,
         sha256(quality || '/' || toxic) AS source_hash, embedding
  FROM labels LEFT JOIN embeddings ON vec_id = doc_id
  UNION ALL SELECT 'Constant', 'bench::' || item_id, item_id::VARCHAR, text, sha256(text), NULL FROM benchmark
), stored AS (
  SELECT 'File' AS kind, 'doc::' || doc_id AS qualified_name, doc_id::VARCHAR AS name,
         CASE WHEN n_chars % 2 = 0 THEN lang END AS doc_comment, sha256(text) AS source_hash
  FROM documents
)
SELECT coalesce(b.kind, s.kind) AS kind, coalesce(b.qualified_name, s.qualified_name) AS qualified_name,
       CASE WHEN b.kind IS NULL THEN s.name ELSE b.name END AS name,
       CASE WHEN b.kind IS NULL THEN s.doc_comment ELSE b.doc_comment END AS doc_comment,
       CASE WHEN b.kind IS NULL THEN s.source_hash ELSE b.source_hash END AS source_hash,
       coalesce(len(b.embedding), 1)::INTEGER AS dimensions,
       round(coalesce(b.embedding[1]::DOUBLE, 0), 6) AS first_component
FROM stored s FULL JOIN batch b ON s.kind = b.kind AND s.qualified_name = b.qualified_name""",
)
def _entity_upsert(spark, sf_dir):
    stored = tables.document_entities(spark, sf_dir).withColumn("embedding", zeros(1))
    merged = upsert.upsert_entities(stored, _upsert_batch(spark, sf_dir))
    vector_ = F.coalesce("embedding", zeros(1))
    return merged.select(
        "kind",
        "qualified_name",
        "name",
        "doc_comment",
        "source_hash",
        F.size(vector_).alias("dimensions"),
        F.round(vector_[0].cast("double"), 6).alias("first_component"),
    )


RESOLVED_SQL = """
resolved AS (
  SELECT 'Struct' AS from_kind, 'supplier::' || l_suppkey AS from_qn, 'Property' AS to_kind, 'part::' || l_partkey AS to_qn,
         'CALLS' AS rel_type, l_linenumber AS line, l_returnflag AS field_name, l_linestatus AS field_type
  FROM lineitem JOIN part ON p_partkey = l_partkey AND p_size < 25
  QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey
                             ORDER BY l_linenumber DESC, l_returnflag DESC, l_linestatus DESC) = 1
)"""


def _sized_nodes(spark, sf_dir):
    parts = tables.table(spark, sf_dir, "part").where("p_size < 25")
    suppliers = tables.table(spark, sf_dir, "supplier")
    return parts.select(F.lit("Property").alias("kind"), tables.key_of("part", "p_partkey").alias("qualified_name")).unionByName(
        suppliers.select(F.lit("Struct").alias("kind"), tables.key_of("supplier", "s_suppkey").alias("qualified_name"))
    )


@query("resolve_relationships", f"WITH {RESOLVED_SQL} SELECT * FROM resolved")
def _resolve(spark, sf_dir):
    resolved = upsert.resolve(tables.raw_calls(spark, sf_dir), _sized_nodes(spark, sf_dir))
    return resolved.drop("variant_name", "dep_kind")


@query(
    "relationship_upsert",
    f"""WITH {RESOLVED_SQL}, stored AS (
  SELECT 'Struct' AS from_kind, 'supplier::' || s_suppkey AS from_qn, 'Property' AS to_kind, 'part::' || p_partkey AS to_qn,
         'CALLS' AS rel_type, 0 AS line, 'old' AS field_name
  FROM supplier JOIN part ON p_partkey = s_suppkey
)
SELECT coalesce(r.from_qn, s.from_qn) AS from_qn, coalesce(r.to_qn, s.to_qn) AS to_qn, 'CALLS' AS rel_type,
       CASE WHEN r.from_qn IS NULL THEN s.line ELSE r.line END AS line,
       CASE WHEN r.from_qn IS NULL THEN s.field_name ELSE r.field_name END AS field_name, r.field_type
FROM stored s FULL JOIN resolved r USING (from_qn, to_qn, rel_type)""",
)
def _relationship_upsert(spark, sf_dir):
    supplier, part = (tables.table(spark, sf_dir, t) for t in ("supplier", "part"))
    stored = supplier.join(part, F.col("s_suppkey") == F.col("p_partkey")).select(
        F.lit("Struct").alias("from_kind"),
        tables.key_of("supplier", "s_suppkey").alias("from_qn"),
        F.lit("Property").alias("to_kind"),
        tables.key_of("part", "p_partkey").alias("to_qn"),
        F.lit("CALLS").alias("rel_type"),
        F.lit(0).alias("line"),
        F.lit("old").alias("field_name"),
        *[F.lit(None).cast("string").alias(c) for c in ("field_type", "variant_name", "dep_kind")],
    )
    merged = upsert.upsert_relationships(stored, tables.raw_calls(spark, sf_dir), _sized_nodes(spark, sf_dir))
    return merged.select("from_qn", "to_qn", "rel_type", "line", "field_name", "field_type")


def _document_graph(spark, sf_dir):
    """Documents under their sources; sources carry no hash."""
    documents = tables.table(spark, sf_dir, "documents")
    files = documents.select(
        F.lit("File").alias("kind"), tables.key_of("doc", "doc_id").alias("qualified_name"), F.sha2("text", 256).alias("source_hash")
    )
    sources = documents.select(
        F.lit("Module").alias("kind"), F.concat(F.lit("source::"), "source").alias("qualified_name"), F.lit(None).cast("string").alias("source_hash")
    ).distinct()
    edges = documents.select(
        F.lit("Module").alias("from_kind"),
        F.concat(F.lit("source::"), "source").alias("from_qn"),
        F.lit("File").alias("to_kind"),
        tables.key_of("doc", "doc_id").alias("to_qn"),
        F.lit("CONTAINS").alias("rel_type"),
    )
    return KnowledgeGraph(files.unionByName(sources), edges)


def _stale_graph(spark, sf_dir):
    labelled = tables.table(spark, sf_dir, "documents").join(tables.table(spark, sf_dir, "labels"), "doc_id", "left_semi")
    return upsert.delete_stale(_document_graph(spark, sf_dir), labelled.select(F.sha2("text", 256).alias("source_hash")))


LIVE_SQL = """
live AS (SELECT doc_id, source, sha256(text) AS h FROM documents
         WHERE sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)))"""


@query(
    "delete_stale",
    f"""WITH {LIVE_SQL}
SELECT 'File' AS kind, 'doc::' || doc_id AS qualified_name, h AS source_hash FROM live
UNION ALL SELECT DISTINCT 'Module', 'source::' || source, NULL FROM documents""",
)
def _delete_stale(spark, sf_dir):
    return _stale_graph(spark, sf_dir).entities


@query(
    "delete_stale_detach",
    f"WITH {LIVE_SQL} SELECT 'source::' || source AS from_qn, 'doc::' || doc_id AS to_qn, 'CONTAINS' AS rel_type FROM live",
)
def _detach(spark, sf_dir):
    return _stale_graph(spark, sf_dir).relationships.select("from_qn", "to_qn", "rel_type")


@query(
    "unique_check",
    """
SELECT 'Function' AS kind, p_name AS qualified_name, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1""",
)
def _unique_check(spark, sf_dir):
    named = tables.table(spark, sf_dir, "part").select(F.lit("Function").alias("kind"), F.col("p_name").alias("qualified_name"))
    return upsert.duplicate_keys(named)


@query(
    "dim_check",
    f"""WITH {KG_SQL}, long AS (SELECT kind, embedding FROM kg_nodes WHERE embedding IS NOT NULL
  UNION ALL SELECT 'File', [0::FLOAT] FROM documents)
SELECT kind, len(embedding)::INTEGER AS length, count(*) AS n FROM long WHERE len(embedding) <> 64 GROUP BY ALL""",
)
def _dim_check(spark, sf_dir):
    short = tables.document_entities(spark, sf_dir).select("kind", zeros(1).alias("embedding"))
    return upsert.dimension_violations(tables.kg_entities(spark, sf_dir).select("kind", "embedding").unionByName(short), 64)


@query(
    "incremental_diff",
    """
WITH old AS (SELECT 'doc::' || doc_id AS qualified_name, sha256(text) AS old_hash FROM documents),
new AS (SELECT 'doc::' || item_id AS qualified_name, sha256(text) AS new_hash FROM benchmark
        UNION ALL SELECT 'bench::' || item_id, sha256(text) FROM benchmark
        UNION ALL SELECT 'doc::' || doc_id, sha256(text) FROM documents JOIN labels USING (doc_id)
          WHERE doc_id NOT IN (SELECT item_id FROM benchmark))
SELECT coalesce(old.qualified_name, new.qualified_name) AS qualified_name, old_hash, new_hash,
       CASE WHEN old_hash IS NULL THEN 'added' WHEN new_hash IS NULL THEN 'removed'
            WHEN old_hash = new_hash THEN 'unchanged' ELSE 'changed' END AS status
FROM old FULL JOIN new ON old.qualified_name = new.qualified_name""",
)
def _incremental_diff(spark, sf_dir):
    documents = tables.table(spark, sf_dir, "documents")
    bench = tables.table(spark, sf_dir, "benchmark")
    digest = F.sha2("text", 256).alias("source_hash")
    old = documents.select(tables.key_of("doc", "doc_id").alias("qualified_name"), digest)
    kept = documents.join(tables.table(spark, sf_dir, "labels"), "doc_id", "left_semi").join(
        bench.select(F.col("item_id").alias("doc_id")), "doc_id", "left_anti"
    )
    new = (
        bench.select(tables.key_of("doc", "item_id").alias("qualified_name"), digest)
        .unionByName(bench.select(tables.key_of("bench", "item_id").alias("qualified_name"), digest))
        .unionByName(kept.select(tables.key_of("doc", "doc_id").alias("qualified_name"), digest))
    )
    return upsert.incremental_diff(old, new)


# ---- graph queries -----------------------------------------------------------


def _trails_sql(steps: str, targets: str, depth: int, direction: str) -> str:
    return f"""WITH RECURSIVE {KG_SQL}, keyed AS (SELECT *, from_qn || '>' || to_qn || '>' || rel_type AS eid FROM kg_edges),
steps AS ({steps}), targets AS ({targets}),
trail AS (
  SELECT nq AS target, fk AS kind, fq AS qn, [eid] AS eids, [rel_type] AS types, 1 AS d
  FROM steps WHERE nq IN (SELECT qualified_name FROM targets)
  UNION ALL
  SELECT t.target, s.fk, s.fq, list_append(t.eids, s.eid), list_append(t.types, s.rel_type), d + 1
  FROM trail t JOIN steps s ON s.nk = t.kind AND s.nq = t.qn WHERE d < {depth} AND NOT list_contains(t.eids, s.eid)
)
SELECT target, n.name, n.qualified_name, n.kind, rel_type, '{direction}' AS direction
FROM (SELECT target, kind, qn, unnest(types) AS rel_type FROM trail) t
JOIN kg_nodes n ON n.kind = t.kind AND n.qualified_name = t.qn"""


_IN_SQL = "SELECT to_kind AS nk, to_qn AS nq, from_kind AS fk, from_qn AS fq, rel_type, eid FROM keyed"
_OUT_SQL = "SELECT from_kind AS nk, from_qn AS nq, to_kind AS fk, to_qn AS fq, rel_type, eid FROM keyed"
_BOTH_SQL = f"{_OUT_SQL} UNION ALL {_IN_SQL} WHERE (from_kind, from_qn) <> (to_kind, to_qn)"


@query("neighbors_in", _trails_sql(_IN_SQL, "SELECT qualified_name FROM kg_nodes", 3, "in"))
def _neighbors_in(spark, sf_dir):
    graph = tables.kg(spark, sf_dir)
    return traverse.neighbors(graph, graph.entities, 3, "in")


@query("neighbors_out", _trails_sql(_OUT_SQL, "SELECT qualified_name FROM kg_nodes", 3, "out"))
def _neighbors_out(spark, sf_dir):
    graph = tables.kg(spark, sf_dir)
    return traverse.neighbors(graph, graph.entities, 3, "out")


@query("neighbors_both", _trails_sql(_BOTH_SQL, "SELECT qualified_name FROM kg_nodes", 1, "both"))
def _neighbors_both(spark, sf_dir):
    graph = tables.kg(spark, sf_dir)
    return traverse.neighbors(graph, graph.entities, 1, "both")


@query("neighbors_both_d2", _trails_sql(_BOTH_SQL, "SELECT 'nation::' || n_nationkey AS qualified_name FROM nation", 2, "both"))
def _neighbors_both_d2(spark, sf_dir):
    nations = tables.table(spark, sf_dir, "nation").select(tables.key_of("nation", "n_nationkey").alias("qualified_name"))
    return traverse.neighbors(tables.kg(spark, sf_dir), nations, 2, "both")


@query(
    "get_entity",
    f"""WITH {KG_SQL}, asked AS (SELECT DISTINCT 'part::' || l_partkey AS qualified_name FROM lineitem
  UNION SELECT 'order::' || o_orderkey FROM orders)
SELECT name, qualified_name, kind, 1.0::DOUBLE AS score FROM kg_nodes JOIN asked USING (qualified_name)""",
)
def _get_entity(spark, sf_dir):
    asked = tables.table(spark, sf_dir, "lineitem").select(tables.key_of("part", "l_partkey").alias("qualified_name")).unionByName(
        tables.table(spark, sf_dir, "orders").select(tables.key_of("order", "o_orderkey").alias("qualified_name"))
    )
    return lookup.get_entity(tables.kg_entities(spark, sf_dir), asked)


def _name_sql(asked: str, k: int) -> str:
    return f"""WITH {KG_SQL}, asked AS ({asked})
SELECT query_id, name, qualified_name, kind, score FROM (
  SELECT query_id, name, qualified_name, kind,
         CASE WHEN lower(name) = lower(text) THEN 1.0 WHEN starts_with(lower(name), lower(text)) THEN 0.8 ELSE 0.5 END::DOUBLE AS score
  FROM kg_nodes JOIN asked ON contains(lower(name), lower(text)) OR contains(lower(qualified_name), lower(text)))
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, qualified_name, kind) <= {k}"""


@query("name_search", _name_sql("SELECT 1 AS query_id, 'supplier#00000001' AS text", 10))
def _name_search(spark, sf_dir):
    return lookup.name_search(tables.kg_entities(spark, sf_dir), [(1, "supplier#00000001")], 10)


@query("name_search_batch", _name_sql("SELECT n_nationkey::BIGINT AS query_id, n_name AS text FROM nation", 10))
def _name_search_batch(spark, sf_dir):
    asked = tables.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("query_id"), F.col("n_name").alias("text"))
    return lookup.name_search(tables.kg_entities(spark, sf_dir), asked, 10)


_ALL_NAMES_SQL = """SELECT p_partkey::BIGINT AS query_id, p_name AS text FROM part
  UNION ALL SELECT -1 - n_nationkey, left(n_name, n_nationkey % 4) FROM nation"""


@query("name_search_all", _name_sql(_ALL_NAMES_SQL, 5))
def _name_search_all(spark, sf_dir):
    """Every part name at once, and the empty text and short beginnings of the nation names."""
    parts = tables.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("query_id"), F.col("p_name").alias("text"))
    key = F.col("n_nationkey").cast("bigint")
    short = tables.table(spark, sf_dir, "nation").select((-1 - key).alias("query_id"), F.expr("left(n_name, n_nationkey % 4)").alias("text"))
    return lookup.name_search(tables.kg_entities(spark, sf_dir), parts.unionByName(short), 5)


@query("scan_kind", f"WITH {KG_SQL} SELECT qualified_name, name FROM kg_nodes WHERE kind = 'Struct'")
def _scan_kind(spark, sf_dir):
    return lookup.scan_kind(tables.kg_entities(spark, sf_dir), "Struct").select("qualified_name", "name")


@query(
    "graph_stats",
    f"""WITH {KG_SQL}, known AS (SELECT unnest(['File','Module','Function','Method','Constant','Static','Variable','TypeAlias',
  'Struct','Enum','Trait','Impl','Macro','Class','Interface','Constructor','Property','Decorator','Header','Namespace','Union',
  'Typedef','Preprocessor','HtmlElement','CssRule','CssSelector']) AS kind)
SELECT known.kind, count(kg_nodes.kind) AS n FROM known LEFT JOIN kg_nodes ON kg_nodes.kind = known.kind GROUP BY ALL
UNION ALL SELECT 'Total', count(*) FROM kg_nodes""",
)
def _graph_stats(spark, sf_dir):
    return lookup.graph_stats(tables.kg_entities(spark, sf_dir))


PAIRS_SQL = """
pairs AS (SELECT a.r_regionkey::BIGINT AS pair_id, 'region::' || a.r_regionkey AS from_qn, 'region::' || b.r_regionkey AS to_qn
          FROM region a JOIN region b ON b.r_regionkey = a.r_regionkey + 1)"""


def successive_pairs(spark, sf_dir, name, key):
    """Every row of a table paired with the one that has the next key."""
    left = tables.table(spark, sf_dir, name).select(F.col(key).cast("bigint").alias("pair_id"))
    right = left.select((F.col("pair_id") - 1).alias("pair_id"))
    return left.join(right, "pair_id").select(
        "pair_id",
        tables.key_of(name, "pair_id").alias("from_qn"),
        F.concat(F.lit(f"{name}::"), (F.col("pair_id") + 1).cast("string")).alias("to_qn"),
    )


@query(
    "shortest_path",
    f"""WITH RECURSIVE {KG_SQL}, {PAIRS_SQL},
adj AS MATERIALIZED (SELECT DISTINCT from_qn AS near, to_qn AS far FROM kg_edges UNION SELECT to_qn, from_qn FROM kg_edges),
reach AS (
  SELECT qualified_name AS goal, qualified_name AS node, 0 AS hops FROM kg_nodes WHERE qualified_name IN (SELECT to_qn FROM pairs)
  UNION SELECT goal, far, hops + 1 FROM reach JOIN adj ON near = node WHERE hops < 7
), dist AS MATERIALIZED (SELECT goal, node, min(hops) AS hops FROM reach GROUP BY ALL),
walk AS (
  SELECT pair_id, to_qn AS goal, from_qn AS node, 0 AS ordinal, d.hops AS left_over FROM pairs JOIN dist d ON d.goal = to_qn AND d.node = from_qn
  UNION ALL
  SELECT pair_id, w.goal, min(far) AS node, ordinal + 1, left_over - 1
  FROM walk w JOIN adj ON near = w.node JOIN dist d ON d.goal = w.goal AND d.node = far AND d.hops = left_over - 1
  GROUP BY pair_id, w.goal, ordinal, left_over
)
SELECT pair_id, ordinal, name, qualified_name, kind, '' AS relationship, '' AS direction
FROM walk JOIN kg_nodes ON qualified_name = node""",
)
def _shortest_path(spark, sf_dir):
    graph = tables.kg(spark, sf_dir)
    return traverse.path_nodes(graph, traverse.shortest_paths(graph, successive_pairs(spark, sf_dir, "region", "r_regionkey")))


@query(
    "path_hops",
    f"""WITH RECURSIVE {KG_SQL},
adj AS MATERIALIZED (SELECT DISTINCT from_qn AS near, to_qn AS far FROM kg_edges UNION SELECT to_qn, from_qn FROM kg_edges),
reach AS (
  SELECT s_suppkey AS pair_id, 'supplier::' || s_suppkey AS node, 0 AS hops FROM supplier
  UNION SELECT pair_id, far, hops + 1 FROM reach JOIN adj ON near = node WHERE hops < 4
)
SELECT s_suppkey - 1 AS pair_id, min(hops)::INTEGER AS hops
FROM supplier JOIN reach ON pair_id = s_suppkey - 1 AND node = 'supplier::' || s_suppkey GROUP BY ALL""",
)
def _path_hops(spark, sf_dir):
    return traverse.path_lengths(tables.kg(spark, sf_dir), successive_pairs(spark, sf_dir, "supplier", "s_suppkey"))


# ---- vectors -----------------------------------------------------------------


@query(
    "vector_topk_per_kind",
    f"""WITH {KG_SQL}, centroids AS (
  SELECT 0 AS query_id, list(m ORDER BY pos) AS vector
  FROM (SELECT pos, avg(x) AS m
        FROM (SELECT unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY ALL)
), {_hits_sql(True)}
SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, kind ORDER BY score DESC, qualified_name) <= 10""",
)
def _vector_topk(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "embeddings").select(F.lit(0).alias("id"), F.lit(1).alias("mask"), F.col("embedding").alias("vector"))
    asked = embed.mean_pool(rows, 64).select(F.col("id").alias("query_id"), "vector")
    return vector.vector_topk(tables.kg_entities(spark, sf_dir), asked, 10, hybrid.SEARCHABLE_KINDS)


@query(
    "vector_topk_batch",
    f"""WITH {KG_SQL}, {CENTROID_SQL}, {_hits_sql(False)}
SELECT query_id, name, qualified_name, kind, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, qualified_name, kind)::INTEGER AS rank
FROM hits QUALIFY rank <= 10""",
)
def _vector_topk_batch(spark, sf_dir):
    hits = vector.vector_topk(tables.kg_entities(spark, sf_dir), label_centroids(spark, sf_dir).select("query_id", "vector"), 10)
    return vector.topk_overall(hits, 10)


@query("vector_topk_lsh")
def _vector_topk_lsh(spark, sf_dir):
    index = vector.LshIndex(tables.kg_entities(spark, sf_dir))
    return index.search(label_centroids(spark, sf_dir).select("query_id", "vector"), 10)


@query(
    "mean_pool",
    """
SELECT label::BIGINT AS id, pos, round(avg(x), 6) AS value
FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding)))::INTEGER AS pos FROM embeddings) GROUP BY ALL""",
)
def _mean_pool(spark, sf_dir):
    pooled = label_centroids(spark, sf_dir).select(F.col("query_id").alias("id"), F.posexplode("vector").alias("pos", "value"))
    return pooled.select("id", "pos", F.round("value", 6).alias("value"))


@query(
    "l2_normalize",
    """
WITH scaled AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * label) AS v FROM embeddings),
normed AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM scaled)
SELECT vec_id, pos, round(CASE WHEN n > 0 THEN x / n ELSE x END, 6) AS value
FROM (SELECT vec_id, n, unnest(v) AS x, unnest(range(len(v)))::INTEGER AS pos FROM normed)""",
)
def _l2_normalize(spark, sf_dir):
    scaled = F.transform("embedding", lambda x: x.cast("double") * F.col("label"))
    unit = tables.table(spark, sf_dir, "embeddings").select("vec_id", l2_normalize(scaled).alias("v"))
    # Adding zero turns -0.0 into 0.0.
    return unit.select("vec_id", F.posexplode("v").alias("pos", "x")).select("vec_id", "pos", (F.round("x", 6) + 0.0).alias("value"))


@query(
    "zero_vectors",
    "SELECT doc_id, 16 AS dimensions, 0.0::DOUBLE AS total FROM documents",
)
def _zero_vectors(spark, sf_dir):
    embedded = embed.embed(tables.table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "none", 16)
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + F.abs(x).cast("double"))
    return embedded.select("doc_id", F.size("embedding").alias("dimensions"), total.alias("total"))


@query("text_vectorize_shape", "SELECT doc_id, 256 AS dimensions, 1.0::DOUBLE AS length FROM documents")
def _text_vectorize_shape(spark, sf_dir):
    """Dimension and Euclidean length of every document's vector."""
    return _text_vectorize(spark, sf_dir).select(
        "doc_id", F.size("embedding").alias("dimensions"), F.round(norm(F.col("embedding")), 4).alias("length")
    )


@query(
    "vector_usable",
    "SELECT vec_id, label <> 0 AS usable FROM embeddings",
)
def _vector_usable(spark, sf_dir):
    scaled = F.transform("embedding", lambda x: x * F.col("label"))
    return tables.table(spark, sf_dir, "embeddings").select("vec_id", is_nonzero(scaled).alias("usable"))


@query("text_vectorize")
def _text_vectorize(spark, sf_dir):
    return embed.embed(tables.table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "hashing", 256).select("doc_id", "embedding")


@query("dimensions", "SELECT max(len(embedding))::INTEGER AS dimensions FROM embeddings")
def _dimensions(spark, sf_dir):
    return embed.dimensions(tables.table(spark, sf_dir, "embeddings"))


# ---- hybrid retrieval --------------------------------------------------------


def _search_sql(hits: str, k: int) -> str:
    return f"""{hits}, matches AS (
  SELECT query_id, name, qualified_name, kind, score FROM hits
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, qualified_name, kind) <= {k}
), adj AS (
  SELECT from_qn AS near, to_kind AS fk, to_qn AS fq, rel_type FROM kg_edges
  UNION ALL SELECT to_qn, from_kind, from_qn, rel_type FROM kg_edges
), widened AS (
  SELECT query_id, fk AS kind, fq AS qualified_name, 0.5::DOUBLE * max(score) AS vector_score
  FROM matches m JOIN adj ON near = m.qualified_name
  WHERE NOT EXISTS (SELECT 1 FROM matches o WHERE o.query_id = m.query_id AND o.qualified_name = fq)
  GROUP BY ALL
), scored AS (
  SELECT query_id, name, qualified_name, kind, score AS vector_score, 0 AS graph_distance, 'Vector' AS source,
         0.7::DOUBLE * score + 0.3::DOUBLE AS relevance FROM matches
  UNION ALL
  SELECT query_id, n.name, w.qualified_name, w.kind, vector_score, 1, 'GraphExpansion', 0.7::DOUBLE * vector_score + 0.15::DOUBLE
  FROM widened w JOIN kg_nodes n ON n.qualified_name = w.qualified_name AND n.kind = w.kind
)"""


_RESULT_SQL = """
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, qualified_name)::INTEGER AS rank, name,
       qualified_name, kind, vector_score, graph_distance, relevance, source
FROM scored QUALIFY rank <= {k}"""

_VECTOR_HITS = f"WITH {KG_SQL}, {CENTROID_SQL}, {_hits_sql(True)}"


@query("hybrid_search", _search_sql(_VECTOR_HITS, 10) + _RESULT_SQL.format(k=10))
def _hybrid_search(spark, sf_dir):
    return hybrid.search(tables.kg(spark, sf_dir), label_centroids(spark, sf_dir), 10).results


@query("hybrid_search_deep", _search_sql(_VECTOR_HITS, 2000) + _RESULT_SQL.format(k=2000))
def _hybrid_search_deep(spark, sf_dir):
    return hybrid.search(tables.kg(spark, sf_dir), label_centroids(spark, sf_dir), 2000).results


@query(
    "hybrid_expansion",
    _search_sql(_VECTOR_HITS, 10) + " SELECT query_id, qualified_name, kind, vector_score FROM widened",
)
def _hybrid_expansion(spark, sf_dir):
    graph = tables.kg(spark, sf_dir)
    matches = hybrid.first_matches(graph, label_centroids(spark, sf_dir), 10, by_name=0)
    matches, rows, _ = Scratch(spark).write_counted(matches, "matches")
    return hybrid.expansions(graph, matches, rows)


@query(
    "hybrid_related",
    _search_sql(_VECTOR_HITS, 10)
    + """ SELECT query_id, near AS match_qn, n.name, n.qualified_name, n.kind, rel_type AS relationship, 'both' AS direction
FROM matches m JOIN adj ON near = m.qualified_name JOIN kg_nodes n ON n.kind = fk AND n.qualified_name = fq""",
)
def _hybrid_related(spark, sf_dir):
    return hybrid.search(tables.kg(spark, sf_dir), label_centroids(spark, sf_dir), 10).related


_FALLBACK_HITS = f"""WITH {KG_SQL}, asked AS (SELECT n_nationkey::BIGINT AS query_id, n_name AS text FROM nation),
hits AS (
  SELECT query_id, name, qualified_name, kind,
         CASE WHEN lower(name) = lower(text) THEN 1.0 WHEN starts_with(lower(name), lower(text)) THEN 0.8 ELSE 0.5 END::DOUBLE AS score
  FROM kg_nodes JOIN asked ON contains(lower(name), lower(text)) OR contains(lower(qualified_name), lower(text))
)"""


@query("hybrid_search_fallback", _search_sql(_FALLBACK_HITS, 50) + _RESULT_SQL.format(k=50))
def _hybrid_fallback(spark, sf_dir):
    asked = tables.table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("query_id"), F.col("n_name").alias("text"), zeros(64).alias("vector")
    )
    return hybrid.search(tables.kg(spark, sf_dir), asked, 50).results


@query(
    "explain_context",
    f"""WITH {KG_SQL}, sides AS (
  SELECT to_qn AS target, from_kind AS k, from_qn AS q, rel_type, 'in' AS direction,
         CASE WHEN rel_type = 'CALLS' THEN 'callers' ELSE 'dependents' END AS section FROM kg_edges
  UNION ALL SELECT from_qn, to_kind, to_qn, rel_type, 'out',
         CASE WHEN rel_type = 'CALLS' THEN 'callees' ELSE 'dependencies' END FROM kg_edges
)
SELECT target, section, name, qualified_name, kind, rel_type AS relationship, direction
FROM sides JOIN kg_nodes ON kind = k AND qualified_name = q WHERE rel_type IN ('CALLS', 'DEPENDS_ON', 'IMPORTS', 'USES_TYPE')""",
)
def _explain_context(spark, sf_dir):
    graph = tables.kg(spark, sf_dir)
    return hybrid.explain_edges(graph, graph.entities)


@query(
    "explain_heads",
    f"""WITH {KG_SQL}
SELECT split_part(qualified_name, '::', -1) AS name, qualified_name, kind FROM kg_nodes
UNION ALL SELECT DISTINCT o_orderpriority, 'priority::' || o_orderpriority, 'Unknown' FROM orders""",
)
def _explain_heads(spark, sf_dir):
    graph = tables.kg(spark, sf_dir)
    unknown = tables.table(spark, sf_dir, "orders").select(F.concat(F.lit("priority::"), "o_orderpriority").alias("qualified_name"))
    return hybrid.explain_heads(graph, graph.entities.select("qualified_name").unionByName(unknown))


_SIMILAR_HITS = f"""WITH {KG_SQL}, asked AS (SELECT 'nation::' || n_nationkey AS query_id, 'nation::' || n_nationkey AS text FROM nation),
hits AS (
  SELECT query_id, name, qualified_name, kind,
         CASE WHEN lower(name) = lower(text) THEN 1.0 WHEN starts_with(lower(name), lower(text)) THEN 0.8 ELSE 0.5 END::DOUBLE AS score
  FROM kg_nodes JOIN asked ON contains(lower(name), lower(text)) OR contains(lower(qualified_name), lower(text))
)"""


@query(
    "explain_similar",
    f"SELECT * EXCLUDE (query_id), query_id AS target FROM ({_search_sql(_SIMILAR_HITS, 5) + _RESULT_SQL.format(k=5)})",
)
def _explain_similar(spark, sf_dir):
    nations = tables.table(spark, sf_dir, "nation").select(tables.key_of("nation", "n_nationkey").alias("qualified_name"))
    return hybrid.explain(tables.kg(spark, sf_dir), nations).similar


# ---- presentation groupings and output ---------------------------------------


@query(
    "relevance_band",
    f"""{_search_sql(_VECTOR_HITS, 10)} SELECT query_id, qualified_name,
  CASE WHEN relevance >= 0.85 THEN 'strong' WHEN relevance >= 0.70 THEN 'good' WHEN relevance >= 0.50 THEN 'fair' ELSE 'weak' END AS band
FROM ({_RESULT_SQL.format(k=10)})""",
)
def _relevance_band(spark, sf_dir):
    found = hybrid.search(tables.kg(spark, sf_dir), label_centroids(spark, sf_dir), 10).results
    return found.select("query_id", "qualified_name", text.relevance_band(F.col("relevance")).alias("band"))


@query(
    "kind_family",
    f"""WITH {KG_SQL} SELECT CASE WHEN kind IN ('Function','Method','Constructor') THEN 'callable'
  WHEN kind IN ('Struct','Class','Interface','Enum') THEN 'type' WHEN kind = 'Trait' THEN 'trait'
  WHEN kind IN ('Module','File') THEN 'container' WHEN kind = 'Property' THEN 'value' ELSE 'other' END AS family, count(*) AS n
FROM kg_nodes GROUP BY ALL""",
)
def _kind_family(spark, sf_dir):
    nodes = tables.kg_entities(spark, sf_dir)
    return nodes.groupBy(text.kind_family(F.col("kind")).alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "edge_family",
    f"""WITH {KG_SQL} SELECT CASE rel_type WHEN 'CALLS' THEN 'calls' WHEN 'CONTAINS' THEN 'containment' ELSE 'other' END AS family,
  count(*) AS n FROM kg_edges GROUP BY ALL""",
)
def _edge_family(spark, sf_dir):
    edges = tables.kg_relationships(spark, sf_dir)
    return edges.groupBy(text.edge_family(F.col("rel_type")).alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "qname_split",
    f"""WITH {KG_SQL} SELECT qualified_name, split_part(qualified_name, '::', 1) || '::' AS path,
  split_part(qualified_name, '::', 2) AS identifier FROM kg_nodes""",
)
def _qname_split(spark, sf_dir):
    path, identifier = text.qname_parts(F.col("qualified_name"))
    return tables.kg_entities(spark, sf_dir).select("qualified_name", path.alias("path"), identifier.alias("identifier"))


@query("results_json")
def _results_json(spark, sf_dir):
    return json_out.search_json(hybrid.search(tables.kg(spark, sf_dir), label_centroids(spark, sf_dir), 10))


@query(
    "results_json_fields",
    f"""{_search_sql(_VECTOR_HITS, 10)}, listed AS (
  SELECT query_id, near AS qualified_name, count(*) AS n FROM (SELECT DISTINCT query_id, qualified_name AS near FROM matches)
  JOIN adj USING (near) GROUP BY ALL
)
SELECT r.query_id, rank, r.qualified_name, r.kind, r.source, coalesce(n, 0) AS related
FROM ({_RESULT_SQL.format(k=10)}) r LEFT JOIN listed l ON l.query_id = r.query_id AND l.qualified_name = r.qualified_name""",
)
def _results_json_fields(spark, sf_dir):
    """The JSON documents read back: one row per result, its lists counted."""
    schema = "qualified_name string, kind string, source string, related array<struct<qualified_name:string>>"
    parsed = _results_json(spark, sf_dir).select("query_id", "rank", F.from_json("json", schema).alias("d"))
    size = F.coalesce(F.size("d.related"), F.lit(0))
    return parsed.groupBy("query_id", "rank", "d.qualified_name", "d.kind", "d.source").agg(
        F.sum(F.greatest(size, F.lit(0))).alias("related")
    )
