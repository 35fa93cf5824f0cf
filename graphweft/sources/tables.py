"""Views that read relational tables as a knowledge graph and as source files."""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.operators.upsert import EDGE_COLUMNS
from graphweft.schema import KnowledgeGraph

# ---- fixed values: how tables and labels map to kinds ------------------------
TABLE_KIND = {"region": "File", "nation": "Module", "customer": "Class", "supplier": "Struct", "part": "Property"}
LABEL_KIND = ("Function", "Method", "Struct", "Enum", "Trait", "Module", "Class", "Interface", "Constructor", "File")
# Schemas of the tables, so that reading one starts no job to infer it.
TABLE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, "
    "p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
    "o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, "
    "event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
# -----------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def label_kind(label: Column) -> Column:
    first, *rest = enumerate(LABEL_KIND)
    chain = F.when(label == first[0], first[1])
    for number, kind in rest:
        chain = chain.when(label == number, kind)
    return chain


def key_of(prefix: str, column: str) -> Column:
    return F.concat(F.lit(f"{prefix}::"), F.col(column).cast("string"))


def kg_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qualified_name, name, kind, embedding) over five tables. A part with a
    vector takes its kind from the vector's label."""
    plain = []
    for name, key, label in (
        ("region", "r_regionkey", "r_name"),
        ("nation", "n_nationkey", "n_name"),
        ("customer", "c_custkey", "c_name"),
        ("supplier", "s_suppkey", "s_name"),
    ):
        plain.append(
            table(spark, sf_dir, name).select(
                key_of(name, key).alias("qualified_name"),
                F.col(label).alias("name"),
                F.lit(TABLE_KIND[name]).alias("kind"),
                F.lit(None).cast("array<float>").alias("embedding"),
            )
        )
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("p_partkey"), "embedding", "label")
    parts = (
        table(spark, sf_dir, "part")
        .join(vectors, "p_partkey", "left")
        .select(
            key_of("part", "p_partkey").alias("qualified_name"),
            F.col("p_name").alias("name"),
            F.coalesce(label_kind(F.col("label")), F.lit(TABLE_KIND["part"])).alias("kind"),
            "embedding",
        )
    )
    return reduce(DataFrame.unionByName, [*plain, parts])


def _edge(from_: str, from_key: str, to: str, to_key: str, rel_type: str) -> list[Column]:
    values = {
        "from_kind": F.lit(TABLE_KIND[from_]),
        "from_qn": key_of(from_, from_key),
        "to_kind": F.lit(TABLE_KIND[to]),
        "to_qn": key_of(to, to_key),
        "rel_type": F.lit(rel_type),
        "line": F.lit(None).cast("int"),
    }
    return [values.get(c, F.lit(None).cast("string")).alias(c) for c in EDGE_COLUMNS]


def kg_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored edges: CONTAINS down the geography, CALLS from supplier to part."""
    nation, customer, supplier = (table(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    contains = [
        nation.select(*_edge("region", "n_regionkey", "nation", "n_nationkey", "CONTAINS")),
        customer.select(*_edge("nation", "c_nationkey", "customer", "c_custkey", "CONTAINS")),
        supplier.select(*_edge("nation", "s_nationkey", "supplier", "s_suppkey", "CONTAINS")),
    ]
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("l_partkey"), "label")
    supplies = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey", "l_partkey")
        .agg(F.max("l_linenumber").alias("line"))
        .join(labels, "l_partkey", "left")
        .withColumn("to_kind", F.coalesce(label_kind(F.col("label")), F.lit(TABLE_KIND["part"])))
    )
    edge = dict(zip(EDGE_COLUMNS, _edge("supplier", "l_suppkey", "part", "l_partkey", "CALLS")))
    edge.update(to_kind=F.col("to_kind"), line=F.col("line").cast("int").alias("line"))
    return reduce(DataFrame.unionByName, [*contains, supplies.select(*edge.values())])


def kg(spark: SparkSession, sf_dir: str) -> KnowledgeGraph:
    return KnowledgeGraph(kg_entities(spark, sf_dir), kg_relationships(spark, sf_dir))


def raw_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edge bag before storage: one CALLS row per line item."""
    return table(spark, sf_dir, "lineitem").select(
        key_of("supplier", "l_suppkey").alias("from_qn"),
        key_of("part", "l_partkey").alias("to_qn"),
        F.lit("CALLS").alias("rel_type"),
        F.col("l_linenumber").cast("int").alias("line"),
        F.col("l_returnflag").alias("field_name"),
        F.col("l_linestatus").alias("field_type"),
        F.lit(None).cast("string").alias("variant_name"),
        F.lit(None).cast("string").alias("dep_kind"),
    )


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: (path, source) with path ``<source>/<doc_id>.<lang>``."""
    return table(spark, sf_dir, "documents").select(
        F.concat_ws("/", "source", F.concat_ws(".", F.col("doc_id").cast("string"), "lang")).alias("path"),
        F.col("text").alias("source"),
    )


def document_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as minimal entities: (kind, qualified_name, name, doc_comment,
    source_hash)."""
    return table(spark, sf_dir, "documents").select(
        F.lit("File").alias("kind"),
        key_of("doc", "doc_id").alias("qualified_name"),
        F.col("doc_id").cast("string").alias("name"),
        F.when(F.col("n_chars") % 2 == 0, F.col("lang")).alias("doc_comment"),
        F.sha2("text", 256).alias("source_hash"),
    )


def spread(rows: DataFrame) -> DataFrame:
    """Rows that each stand for much work, over all cores, in several tasks a
    core so that a slow one does not hold up the rest. Only a table with
    fewer splits is moved; a large one has splits enough."""
    tasks = 3 * rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(tasks) if rows.rdd.getNumPartitions() < tasks else rows


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages")).select(
        F.concat(F.lit("page/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
        F.col("html").alias("source"),
    )


# Source files that tables are rendered into, one file per row. ``{column}``
# stands for a value of the row. The templates hold no single quotes and no
# backslashes, so that one SQL expression serves every engine.
RUST_FILE = """use crate::brand::{{Brand, Size}};

/// {p_name}
/// size {p_size}
pub struct Part{p_partkey} {{
    size: Size{p_size},
    pub price: f64,
}}

impl Priced for Part{p_partkey} {{
    fn price(&self) -> f64 {{
        scale({p_size});
        self.base.round()
    }}
}}

pub(crate) async fn load_{p_partkey}(id: u64) -> u64 {{
    store::read("}} not a block {{", id) // no_call(1)
}}

enum Kind {{ {p_type}, Other }}
mod inner {{
    trait Sized{p_size}: Base {{ fn size(&self) -> u32 {{ {p_size} }} }}
    const LIMIT: u32 = {p_size};
}}
"""
NESTED_FILE = """/* outer /* inner */ fn hidden_{s_nationkey}() {{ }} */
fn after_{s_suppkey}() {{ }}
fn text() {{ show("/* no /* comment", /* a /* b */ c */ after_{s_suppkey}()) }}
"""
CPP_FILE = """#include <vector>
#include "nation_{s_nationkey}.hpp"
#define SUPPLIER {s_suppkey}
/* int hidden() {{ }} */
namespace n{s_nationkey} {{
class Supplier{s_suppkey} : public Base, private ns::Other {{
 public:
  double balance() const {{ return round({s_acctbal}); }}
 private:
  int nation;
}};
enum class State {{ Active, Closed = {s_nationkey} }};
}}
static const int KEY = {s_suppkey};
int lookup_{s_suppkey}(int key) {{
    return table.find(key);
}}
namespace extra {{
#include "extra_{s_nationkey}.hpp"
#define EXTRA {s_suppkey}
struct Index {{
  int& operator[](int i) {{ return at(i); }}
  bool operator==(const Index& o) const;
}};
}}
"""
C_FILE = """#include <stdio.h>
#define NATION {s_nationkey}
// int hidden(void);
struct supplier_{s_suppkey} {{ int key; double balance; }};
union cell {{ int whole; float part; }};
enum zone {{ NORTH = {s_nationkey}, SOUTH }};
typedef unsigned long key_{s_suppkey};
int count_{s_suppkey};
int total(int a);
int total_{s_suppkey}(int a) {{
    printf("{{ %d", a);
    return add(a, table->size(a));
}}
"""
PYTHON_FILE = '''"""Customer {c_custkey}.

def hidden(): pass
"""
import os
from nation_{c_nationkey} import Nation, Region as R

SEGMENT = "{c_mktsegment}"


class Customer{c_custkey}(Base, pkg.Mixin):
    key = {c_custkey}

    def __init__(self, name: str):
        self.name = clean(name)

    @cached
    async def _balance(self, at=(1, 2)) -> float:
        """Balance of {c_name}."""
        return self.load({c_custkey})


def main():
    # no_call(1)
    run(Customer{c_custkey}("a (b"))
'''
SCRIPT_FILE = """import {{ Base }} from "./nation_{c_nationkey}.js";
export default class Customer{c_custkey} extends Base {{
  segment = "{c_mktsegment}";
  constructor(id) {{
    super(id);
    this.init({c_custkey});
  }}
  static async load(id) {{
    return await fetch(id);
  }}
}}
const double_{c_custkey} = (a, b) => a + plus(b);
async function main(x) {{
  run(x); // skip(x)
}}
let counter = {c_nationkey};
const clean_{c_custkey} = (s) => s.replace(/[{{"/]+/g, strip(s));
function last(y) {{ return y / 2 / half(y); }}
"""
TYPESCRIPT_FILE = """export interface Customer{c_custkey} extends Nation{c_nationkey} {{
  name: string;
  size(): number;
}}
type Key = number | string;
enum Zone {{ A{c_nationkey}, B }}
function area(x: number): number {{
  return calc(x);
}}
"""
CSS_FILE = """@import "base_{s_nationkey}.css";
@import url("theme.css");
/* .hidden {{ }} */
.supplier-{s_suppkey}, #nation-{s_nationkey} {{ color: red; }}
@media (max-width: {s_suppkey}px) {{
  .narrow {{ margin: 0; }}
}}
@keyframes spin{s_nationkey} {{ from {{ top: 0; }} to {{ top: 1px; }} }}
"""
# Table, path and text of each kind of file.
CODE_FILES = {
    "rust": ("part", "src/part_{p_partkey}.rs", RUST_FILE),
    "rust_nested": ("supplier", "nest/supplier_{s_suppkey}.rs", NESTED_FILE),
    "c": ("supplier", "lib/supplier_{s_suppkey}.c", C_FILE),
    "cpp": ("supplier", "lib/supplier_{s_suppkey}.cpp", CPP_FILE),
    "python": ("customer", "app/customer_{c_custkey}.py", PYTHON_FILE),
    "javascript": ("customer", "web/customer_{c_custkey}.js", SCRIPT_FILE),
    "typescript": ("customer", "web/customer_{c_custkey}.ts", TYPESCRIPT_FILE),
    "css": ("supplier", "web/supplier_{s_suppkey}.css", CSS_FILE),
}


def template_sql(template: str) -> str:
    """A template as a SQL ``concat`` over the columns it names."""
    parts = []
    for literal, column, _, _ in string.Formatter().parse(template):
        for i, line in enumerate(literal.split("\n")):
            parts += (["chr(10)"] if i else []) + ([f"'{line}'"] if line else [])
        if column:
            parts.append(column)
    return f"concat({', '.join(parts)})"


def code_files(spark: SparkSession, sf_dir: str, language: str) -> DataFrame:
    """(path, source): one generated source file per row of the language's table."""
    name, path, text = CODE_FILES[language]
    rows = spread(table(spark, sf_dir, name))
    return rows.select(F.expr(template_sql(path)).alias("path"), F.expr(template_sql(text)).alias("source"))
