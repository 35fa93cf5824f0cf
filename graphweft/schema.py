"""Data model: the two tables of a knowledge graph and its fixed dimensions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTITY_SCHEMA = T.StructType(
    [
        T.StructField("qualified_name", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("file_path", T.StringType(), False),
        T.StructField("module_path", T.StringType()),
        T.StructField("visibility", T.StringType(), False),
        T.StructField("line_start", T.IntegerType(), False),
        T.StructField("line_end", T.IntegerType(), False),
        T.StructField("doc_comment", T.StringType()),
        T.StructField("source_text", T.StringType(), False),
        T.StructField("source_hash", T.StringType(), False),
        T.StructField("signature", T.StringType()),
        T.StructField("is_async", T.BooleanType(), False),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)

RELATIONSHIP_SCHEMA = T.StructType(
    [
        T.StructField("from_qn", T.StringType(), False),
        T.StructField("to_qn", T.StringType(), False),
        T.StructField("rel_type", T.StringType(), False),
        T.StructField("line", T.IntegerType()),
        T.StructField("param_name", T.StringType()),
        T.StructField("position", T.IntegerType()),
        T.StructField("field_name", T.StringType()),
        T.StructField("field_type", T.StringType()),
        T.StructField("variant_name", T.StringType()),
        T.StructField("alias", T.StringType()),
        T.StructField("dep_kind", T.StringType()),
    ]
)

# ---- fixed values -----------------------------------------------------------
# Entity kinds with the family they are grouped under.
KIND_FAMILY = {
    "File": "container",
    "Module": "container",
    "Function": "callable",
    "Method": "callable",
    "Constant": "value",
    "Static": "value",
    "Variable": "value",
    "TypeAlias": "type",
    "Struct": "type",
    "Enum": "type",
    "Trait": "trait",
    "Impl": "trait",
    "Macro": "meta",
    "Class": "type",
    "Interface": "type",
    "Constructor": "callable",
    "Property": "value",
    "Decorator": "meta",
    "Header": "container",
    "Namespace": "container",
    "Union": "type",
    "Typedef": "type",
    "Preprocessor": "meta",
    "HtmlElement": "markup",
    "CssRule": "markup",
    "CssSelector": "markup",
}
# Kinds that carry a vector index, and the subset that a search visits.
VECTOR_INDEXED_KINDS = ("Function", "Method", "Struct", "Enum", "Trait", "Module", "File")
SEARCHABLE_KINDS = ("Function", "Method", "Struct", "Enum", "Trait", "Module")
# Relationship types with the family they are grouped under.
EDGE_FAMILY = {
    "CALLS": "calls",
    "CONTAINS": "containment",
    "IMPORTS": "dependency",
    "DEPENDS_ON": "dependency",
    "USES_TYPE": "typing",
    "RETURNS": "typing",
    "ACCEPTS_PARAM": "typing",
    "IMPLEMENTS": "inheritance",
    "EXTENDS": "inheritance",
    "IMPL_FOR": "inheritance",
}
# Types declared by the model that fall in no family of their own.
OTHER_EDGE_TYPES = ("DEFINES", "HAS_METHOD", "HAS_FIELD", "HAS_VARIANT")
DEPENDENCY_EDGE_TYPES = ("DEPENDS_ON", "IMPORTS", "USES_TYPE")
# File extension to language; matching is case-sensitive.
EXTENSION_LANGUAGE = {
    "rs": "rust",
    "c": "c",
    "h": "c",
    "cpp": "cpp",
    "cxx": "cpp",
    "cc": "cpp",
    "hpp": "cpp",
    "hxx": "cpp",
    "hh": "cpp",
    "py": "python",
    "pyi": "python",
    "js": "javascript",
    "mjs": "javascript",
    "cjs": "javascript",
    "jsx": "javascript",
    "ts": "typescript",
    "mts": "typescript",
    "cts": "typescript",
    "tsx": "tsx",
    "html": "html",
    "htm": "html",
    "css": "css",
}
DEFAULT_EXCLUDES = ("target/**", "node_modules/**", ".git/**", "vendor/**")
# Edge properties that are kept at rest.
STORED_EDGE_PROPERTIES = ("line", "field_name", "field_type", "variant_name", "dep_kind")
# Limits and weights of the query operators.
DEFAULT_TOP_K = 10
SIMILAR_TOP_K = 5
MAX_PATH_HOPS = 15
EXPANSION_DECAY = 0.5
VECTOR_WEIGHT = 0.7
GRAPH_WEIGHT = 0.3
DEFAULT_DIMENSION = 768
# -----------------------------------------------------------------------------


@dataclass(frozen=True)
class KnowledgeGraph:
    """A graph at rest: ``entities`` keyed by (kind, qualified_name) and
    ``relationships`` whose endpoints carry their kinds (see ``upsert.resolve``).
    ``incoming`` holds the same relationships sorted by their target, if stored,
    and ``names`` the trigram lists of the entities (``names.NameIndex``)."""

    entities: DataFrame
    relationships: DataFrame
    incoming: DataFrame | None = None
    names: object | None = None


def literal_table(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """A small fixed table as literals of the plan, which no job has to read."""

    def text(value) -> str:
        return f"'{value}'" if isinstance(value, str) else str(value).upper()

    listed = ", ".join("(" + ", ".join(text(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {listed} AS t({columns})")


def kinds_dimension(spark: SparkSession) -> DataFrame:
    """The 26 kinds as a table: (kind, family, vector_indexed, searchable)."""
    rows = [
        (kind, family, kind in VECTOR_INDEXED_KINDS, kind in SEARCHABLE_KINDS)
        for kind, family in KIND_FAMILY.items()
    ]
    return literal_table(spark, "kind, family, vector_indexed, searchable", rows)


def extensions_dimension(spark: SparkSession) -> DataFrame:
    return literal_table(spark, "ext, language", list(EXTENSION_LANGUAGE.items()))


def conform(df: DataFrame, schema: T.StructType, **values: Column) -> DataFrame:
    """Project ``df`` onto ``schema``: given expressions first, then columns of
    the same name, then typed nulls."""
    have = set(df.columns)
    columns = []
    for field in schema.fields:
        if field.name in values:
            column = values[field.name]
        elif field.name in have:
            column = F.col(field.name)
        else:
            column = F.lit(None)
        columns.append(column.cast(field.dataType).alias(field.name))
    return df.select(*columns)
