"""Registered queries over source files and pages.

The SQL of the code queries states the expected entities and edges straight from
the rows the files were rendered from; it never looks at the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.extract import corpus, html
from graphweft.operators.assembly import merge_entities
from graphweft.plans.registry import query
from graphweft.sources import tables
from graphweft.sources.files import file_entities, route
from graphweft.sources.tables import CODE_FILES, template_sql

ENTITY_FIELDS = (
    "qualified_name kind module_path visibility line_start line_end doc_comment signature is_async source_hash"
).split()
EDGE_FIELDS = "from_qn to_qn rel_type line field_name field_type variant_name".split()


def _value(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    return str(value) if isinstance(value, int) else template_sql(value)


def _entities_sql(language: str, expected: list[tuple]) -> str:
    """``expected``: (kind, name under the path, module under the path,
    visibility, first line, last line, doc, signature, is_async, text)."""
    table, path, text = CODE_FILES[language]
    rows = [("File", path, None, "pub", 1, text.count("\n"), None, None, False, text)]
    for kind, name, module, visibility, first, last, doc, signature, is_async, source in expected:
        rows.append((kind, f"{path}::{name}", path + (f"::{module}" if module else ""), visibility, first, last, doc, signature, is_async, source))
    selects = []
    for kind, qn, module, visibility, first, last, doc, signature, is_async, source in rows:
        values = [_value(v) for v in (qn, kind, module, visibility, first, last, doc, signature, is_async)]
        values.append(f"sha256({_value(source)})")
        selects.append("SELECT " + ", ".join(f"{v} AS {c}" for v, c in zip(values, ENTITY_FIELDS)) + f" FROM {table}")
    return "\nUNION ALL ".join(selects)


def _edges_sql(language: str, expected: list[tuple]) -> str:
    """``expected``: (from under the path, to, type, line, field, field type, variant);
    a target that starts with ``::`` lies under the path as well."""
    table, path, _ = CODE_FILES[language]
    selects = []
    for from_, to, rel_type, *rest in expected:
        rest = (rest + [None] * 4)[:4]
        from_ = f"{path}::{from_}" if from_ else path
        to = path + to if to.startswith("::") else to
        values = [_value(v) for v in (from_, to, rel_type, *rest)]
        selects.append("SELECT " + ", ".join(f"{v} AS {c}" for v, c in zip(values, EDGE_FIELDS)) + f" FROM {table}")
    return "\nUNION ALL ".join(selects)


def _register(files: str, entities: list[tuple], edges: list[tuple]) -> None:
    language = files.split("_")[0]
    contained = [(e[2] or "", f"::{e[1]}", "CONTAINS") for e in entities]

    @query(f"declaration_scan_{files}", _entities_sql(files, entities))
    def _entities(spark, sf_dir) -> DataFrame:
        found, _ = corpus.extract(tables.code_files(spark, sf_dir, files), (language,), with_text=False)
        return found.select(*ENTITY_FIELDS)

    @query(f"relationships_{files}", _edges_sql(files, contained + edges))
    def _edges(spark, sf_dir) -> DataFrame:
        _, bag = corpus.extract(tables.code_files(spark, sf_dir, files), (language,))
        return bag.select(*EDGE_FIELDS)


def _lines(language: str, first: int, last: int, start: int = 0, drop: int = 0) -> str:
    """Lines of a template, without ``start`` leading and ``drop`` final characters."""
    text = "\n".join(CODE_FILES[language][2].split("\n")[first - 1 : last])
    return text[start : len(text) - drop]


_register(
    "rust",
    [
        ("Struct", "Part{p_partkey}", "", "pub", 5, 8, "{p_name}\nsize {p_size}", None, False, _lines("rust", 5, 8)),
        ("Impl", "impl Priced for Part{p_partkey}", "", "private", 10, 15, None, None, False, _lines("rust", 10, 15)),
        ("Method", "Part{p_partkey}::price", "Part{p_partkey}", "private", 11, 14, None, "fn price(&self) -> f64", False, _lines("rust", 11, 14, 4)),
        ("Function", "load_{p_partkey}", "", "pub(crate)", 17, 19, None, "pub(crate) async fn load_{p_partkey}(id: u64) -> u64", True, _lines("rust", 17, 19)),
        ("Enum", "Kind", "", "private", 21, 21, None, None, False, _lines("rust", 21, 21)),
        ("Module", "inner", "", "private", 22, 25, None, None, False, _lines("rust", 22, 25)),
        ("Trait", "inner::Sized{p_size}", "inner", "private", 23, 23, None, None, False, _lines("rust", 23, 23, 4)),
        ("Method", "inner::Sized{p_size}::size", "inner::Sized{p_size}", "private", 23, 23, None, "fn size(&self) -> u32", False, "fn size(&self) -> u32 {{ {p_size} }}"),
        ("Constant", "inner::LIMIT", "inner", "private", 24, 24, None, None, False, _lines("rust", 24, 24, 4)),
    ],
    [
        ("", "crate::brand::{{Brand, Size}}", "IMPORTS", 1),
        ("Part{p_partkey}", "Size{p_size}", "HAS_FIELD", None, "size", "Size{p_size}"),
        ("impl Priced for Part{p_partkey}", "Part{p_partkey}", "IMPL_FOR"),
        ("impl Priced for Part{p_partkey}", "Priced", "IMPLEMENTS"),
        ("Part{p_partkey}::price", "scale", "CALLS", 12),
        ("Part{p_partkey}::price", "round", "CALLS", 13),
        ("load_{p_partkey}", "store::read", "CALLS", 18),
        ("Kind", "::Kind::{p_type}", "HAS_VARIANT", None, None, None, "{p_type}"),
        ("Kind", "::Kind::Other", "HAS_VARIANT", None, None, None, "Other"),
        ("inner::Sized{p_size}", "Base", "EXTENDS"),
    ],
)

_register(
    "rust_nested",
    [
        ("Function", "after_{s_suppkey}", "", "private", 2, 2, None, "fn after_{s_suppkey}()", False, _lines("rust_nested", 2, 2)),
        ("Function", "text", "", "private", 3, 3, None, "fn text()", False, _lines("rust_nested", 3, 3)),
    ],
    [
        ("text", "show", "CALLS", 3),
        ("text", "after_{s_suppkey}", "CALLS", 3),
    ],
)

_register(
    "cpp",
    [
        ("Preprocessor", "SUPPLIER", "", "pub", 3, 3, None, None, False, _lines("cpp", 3, 3)),
        ("Namespace", "n{s_nationkey}", "", "pub", 5, 13, None, None, False, _lines("cpp", 5, 13)),
        ("Class", "n{s_nationkey}::Supplier{s_suppkey}", "n{s_nationkey}", "pub", 6, 11, None, None, False, _lines("cpp", 6, 11, 0, 1)),
        ("Method", "n{s_nationkey}::Supplier{s_suppkey}::balance", "n{s_nationkey}::Supplier{s_suppkey}", "pub", 8, 8, None, "double balance() const", False, _lines("cpp", 8, 8, 2)),
        ("Enum", "n{s_nationkey}::State", "n{s_nationkey}", "pub", 12, 12, None, None, False, _lines("cpp", 12, 12, 0, 1)),
        ("Constant", "KEY", "", "pub", 14, 14, None, None, False, _lines("cpp", 14, 14)),
        ("Function", "lookup_{s_suppkey}", "", "pub", 15, 17, None, "int lookup_{s_suppkey}(int key)", False, _lines("cpp", 15, 17)),
        ("Namespace", "extra", "", "pub", 18, 25, None, None, False, _lines("cpp", 18, 25)),
        ("Preprocessor", "extra::EXTRA", "extra", "pub", 20, 20, None, None, False, _lines("cpp", 20, 20)),
        ("Struct", "extra::Index", "extra", "pub", 21, 24, None, None, False, _lines("cpp", 21, 24, 0, 1)),
        ("Method", "extra::Index::operator[]", "extra::Index", "pub", 22, 22, None, "int& operator[](int i)", False, _lines("cpp", 22, 22, 2)),
        ("Method", "extra::Index::operator==", "extra::Index", "pub", 23, 23, None, None, False, _lines("cpp", 23, 23, 2)),
    ],
    [
        ("", "<vector>", "IMPORTS", 1),
        ("", '"nation_{s_nationkey}.hpp"', "IMPORTS", 2),
        ("n{s_nationkey}::Supplier{s_suppkey}", "Base", "EXTENDS"),
        ("n{s_nationkey}::Supplier{s_suppkey}", "ns::Other", "EXTENDS"),
        ("n{s_nationkey}::Supplier{s_suppkey}", "int", "HAS_FIELD", None, "nation", "int"),
        ("n{s_nationkey}::Supplier{s_suppkey}::balance", "round", "CALLS", 8),
        ("n{s_nationkey}::State", "::n{s_nationkey}::State::Active", "HAS_VARIANT", None, None, None, "Active"),
        ("n{s_nationkey}::State", "::n{s_nationkey}::State::Closed", "HAS_VARIANT", None, None, None, "Closed"),
        ("lookup_{s_suppkey}", "table.find", "CALLS", 16),
        ("extra", '"extra_{s_nationkey}.hpp"', "IMPORTS", 19),
        ("extra::Index::operator[]", "at", "CALLS", 22),
    ],
)

_C = "Customer{c_custkey}"
_register(
    "python",
    [
        ("Constant", "SEGMENT", "", "pub", 8, 8, None, None, False, _lines("python", 8, 8)),
        ("Class", _C, "", "pub", 11, 20, None, None, False, _lines("python", 11, 20)),
        ("Variable", f"{_C}::key", _C, "pub", 12, 12, None, None, False, _lines("python", 12, 12, 4)),
        ("Constructor", f"{_C}::__init__", _C, "pub(crate)", 14, 15, None, "def __init__(self, name: str)", False, _lines("python", 14, 15, 4)),
        ("Method", f"{_C}::_balance", _C, "pub(crate)", 18, 20, '"""Balance of {c_name}."""', "def _balance(self, at=(1, 2)) -> float", True, _lines("python", 18, 20, 4)),
        ("Function", "main", "", "pub", 23, 25, None, "def main()", False, _lines("python", 23, 25)),
    ],
    [
        ("", "os", "IMPORTS", 5),
        ("", "nation_{c_nationkey}", "IMPORTS", 6),
        ("", "Nation", "IMPORTS", 6),
        ("", "Region", "IMPORTS", 6),
        (_C, "Base", "EXTENDS"),
        (_C, "pkg.Mixin", "EXTENDS"),
        (f"{_C}::__init__", "clean", "CALLS", 15),
        (f"{_C}::_balance", "cached", "USES_TYPE"),
        (f"{_C}::_balance", "self.load", "CALLS", 20),
        ("main", "run", "CALLS", 25),
        ("main", _C, "CALLS", 25),
    ],
)

_register(
    "javascript",
    [
        ("Class", _C, "", "pub", 2, 11, None, None, False, _lines("javascript", 2, 11, len("export default "))),
        ("Property", f"{_C}::segment", _C, "pub", 3, 3, None, None, False, _lines("javascript", 3, 3, 2, 1)),
        ("Constructor", f"{_C}::constructor", _C, "pub", 4, 7, None, "constructor(id)", False, _lines("javascript", 4, 7, 2)),
        ("Method", f"{_C}::load", _C, "pub", 8, 10, None, "load(id)", True, _lines("javascript", 8, 10, 2)),
        ("Function", "double_{c_custkey}", "", "pub", 12, 12, None, "const double_{c_custkey} = (a, b)", False, "double_{c_custkey} = (a, b) => a + plus(b)"),
        ("Function", "main", "", "pub", 13, 15, None, "function main(x)", True, _lines("javascript", 13, 15)),
        ("Variable", "counter", "", "pub", 16, 16, None, None, False, "counter = {c_nationkey}"),
        ("Function", "clean_{c_custkey}", "", "pub", 17, 17, None, "const clean_{c_custkey} = (s)", False, 'clean_{c_custkey} = (s) => s.replace(/[{{"/]+/g, strip(s))'),
        ("Function", "last", "", "pub", 18, 18, None, "function last(y)", False, _lines("javascript", 18, 18)),
    ],
    [
        ("", "./nation_{c_nationkey}.js", "IMPORTS", 1),
        (_C, "Base", "EXTENDS"),
        (f"{_C}::constructor", "this.init", "CALLS", 6),
        (f"{_C}::load", "fetch", "CALLS", 9),
        ("double_{c_custkey}", "plus", "CALLS", 12),
        ("main", "run", "CALLS", 14),
        ("clean_{c_custkey}", "s.replace", "CALLS", 17),
        ("clean_{c_custkey}", "strip", "CALLS", 17),
        ("last", "half", "CALLS", 18),
    ],
)

_register(
    "typescript",
    [
        ("Interface", _C, "", "pub", 1, 4, None, None, False, _lines("typescript", 1, 4, len("export "))),
        ("Property", f"{_C}::name", _C, "pub", 2, 2, None, None, False, "name: string"),
        ("Method", f"{_C}::size", _C, "pub", 3, 3, None, None, False, "size(): number"),
        ("TypeAlias", "Key", "", "pub", 5, 5, None, None, False, _lines("typescript", 5, 5, 0, 1)),
        ("Enum", "Zone", "", "pub", 6, 6, None, None, False, _lines("typescript", 6, 6)),
        ("Function", "area", "", "pub", 7, 9, None, "function area(x: number): number", False, _lines("typescript", 7, 9)),
    ],
    [
        (_C, "Nation{c_nationkey}", "EXTENDS"),
        ("Zone", "::Zone::A{c_nationkey}", "HAS_VARIANT", None, None, None, "A{c_nationkey}"),
        ("Zone", "::Zone::B", "HAS_VARIANT", None, None, None, "B"),
        ("area", "calc", "CALLS", 8),
    ],
)

_register(
    "c",
    [
        ("Preprocessor", "NATION", "", "pub", 2, 2, None, None, False, _lines("c", 2, 2)),
        ("Struct", "supplier_{s_suppkey}", "", "pub", 4, 4, None, None, False, _lines("c", 4, 4, 0, 1)),
        ("Union", "cell", "", "pub", 5, 5, None, None, False, _lines("c", 5, 5, 0, 1)),
        ("Enum", "zone", "", "pub", 6, 6, None, None, False, _lines("c", 6, 6, 0, 1)),
        ("Typedef", "key_{s_suppkey}", "", "pub", 7, 7, None, None, False, _lines("c", 7, 7)),
        ("Variable", "count_{s_suppkey}", "", "pub", 8, 8, None, None, False, _lines("c", 8, 8)),
        ("Function", "total", "", "pub", 9, 9, None, None, False, _lines("c", 9, 9)),
        ("Function", "total_{s_suppkey}", "", "pub", 10, 13, None, "int total_{s_suppkey}(int a)", False, _lines("c", 10, 13)),
    ],
    [
        ("", "<stdio.h>", "IMPORTS", 1),
        ("supplier_{s_suppkey}", "int", "HAS_FIELD", None, "key", "int"),
        ("supplier_{s_suppkey}", "double", "HAS_FIELD", None, "balance", "double"),
        ("cell", "int", "HAS_FIELD", None, "whole", "int"),
        ("cell", "float", "HAS_FIELD", None, "part", "float"),
        ("zone", "::zone::NORTH", "HAS_VARIANT", None, None, None, "NORTH"),
        ("zone", "::zone::SOUTH", "HAS_VARIANT", None, None, None, "SOUTH"),
        ("total_{s_suppkey}", "printf", "CALLS", 11),
        ("total_{s_suppkey}", "add", "CALLS", 12),
        ("total_{s_suppkey}", "table->size", "CALLS", 12),
    ],
)

_S = ".supplier-{s_suppkey}, #nation-{s_nationkey}"
_register(
    "css",
    [
        ("CssRule", _S, "", "pub", 4, 4, None, None, False, _lines("css", 4, 4)),
        ("CssSelector", f"{_S}::.supplier-{{s_suppkey}}", _S, "pub", 4, 4, None, None, False, ".supplier-{s_suppkey}"),
        ("CssSelector", f"{_S}::#nation-{{s_nationkey}}", _S, "pub", 4, 4, None, None, False, "#nation-{s_nationkey}"),
        ("CssRule", "@media@L5", "", "pub", 5, 7, None, None, False, _lines("css", 5, 7)),
        ("CssRule", "@media@L5::.narrow", "@media@L5", "pub", 6, 6, None, None, False, _lines("css", 6, 6, 2)),
        ("CssRule", "@keyframes spin{s_nationkey}", "", "pub", 8, 8, None, None, False, _lines("css", 8, 8)),
    ],
    [
        ("", "base_{s_nationkey}.css", "IMPORTS", 1),
        ("", "theme.css", "IMPORTS", 2),
    ],
)


def _style_sheets(spark, sf_dir):
    return corpus.extract(tables.code_files(spark, sf_dir, "css"), ("css",), with_text=False)


@query(
    "css_imports",
    """
SELECT 'web/supplier_' || s_suppkey || '.css' AS from_qn, 'base_' || s_nationkey || '.css' AS to_qn, 1 AS line FROM supplier
UNION ALL SELECT 'web/supplier_' || s_suppkey || '.css', 'theme.css', 2 FROM supplier""",
)
def _css_imports(spark, sf_dir):
    return _style_sheets(spark, sf_dir)[1].where("rel_type = 'IMPORTS'").select("from_qn", "to_qn", "line")


@query(
    "css_media",
    """
SELECT 'web/supplier_' || s_suppkey || '.css' || q AS qualified_name, n AS name, a AS line_start, b AS line_end
FROM supplier, (VALUES ('::@media@L5', '@media@L5', 5, 7), ('::@media@L5::.narrow', '.narrow', 6, 6)) v(q, n, a, b)
UNION ALL SELECT 'web/supplier_' || s_suppkey || '.css::@keyframes spin' || s_nationkey, '@keyframes spin' || s_nationkey, 8, 8 FROM supplier""",
)
def _css_media(spark, sf_dir):
    entities = _style_sheets(spark, sf_dir)[0]
    nested = F.col("qualified_name").contains("::@media@L") | F.col("name").startswith("@keyframes")
    return entities.where(nested).select("qualified_name", "name", "line_start", "line_end")


# ---- pages -------------------------------------------------------------------


def _elements_sql(tags: tuple[str, ...]) -> str:
    """Elements of the pages with their qualified names, found by splitting the
    cleaned page into tokens; scripts and comments hold no line breaks here."""
    listed = ", ".join(f"'{t}'" for t in tags)
    return f"""
clean AS (
  SELECT page_id, regexp_replace(regexp_replace(html, '(<script[^>]*>).*?(</script>)', '\\1\\2', 'gs'), '<!--.*?-->', '', 'gs') AS h FROM pages
), pieces AS (
  SELECT page_id, unnest(string_split(h, '<')) AS tok, unnest(range(len(string_split(h, '<')))) AS i FROM clean
), tokens AS (
  SELECT page_id, i, tok, regexp_extract(tok, '^([A-Za-z][A-Za-z0-9]*)', 1) AS tag, regexp_extract(tok, '^/([A-Za-z][A-Za-z0-9]*)', 1) AS closed,
         1 + coalesce(sum(len(tok) - len(replace(tok, chr(10), ''))) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS line
  FROM pieces
), levels AS (
  SELECT *, sum(CASE WHEN tag IN ({listed}) AND tag NOT IN ('meta', 'link') THEN 1 WHEN closed IN ({listed}) THEN -1 ELSE 0 END)
              OVER (PARTITION BY page_id ORDER BY i) - CASE WHEN tag IN ('meta', 'link') THEN 0 ELSE 1 END AS level
  FROM tokens
), opened AS (
  SELECT page_id, i, level, line, tag, regexp_extract(tok, 'href="([^"]*)"', 1) AS href, '<' || tag || '>@L' || line AS name
  FROM levels WHERE tag IN ({listed})
), parented AS (
  SELECT o.*, (SELECT max(p.i) FROM opened p WHERE p.page_id = o.page_id AND p.level = o.level - 1 AND p.i < o.i) AS parent FROM opened o
), named AS (
  SELECT page_id, i, line, tag, href, name, 'page/' || page_id || '.html' AS module_path FROM parented WHERE parent IS NULL
  UNION ALL
  SELECT c.page_id, c.i, c.line, c.tag, c.href, c.name, n.module_path || '::' || n.name
  FROM parented c JOIN named n ON n.page_id = c.page_id AND n.i = c.parent
)"""


@query(
    "html_elements",
    f"""WITH RECURSIVE {_elements_sql(html.SIGNIFICANT)}
SELECT module_path || '::' || name AS qualified_name, name, 'HtmlElement' AS kind, line AS line_start FROM named""",
)
def _html_elements(spark, sf_dir):
    return html.elements(tables.page_files(spark, sf_dir)).select("qualified_name", "name", "kind", "line_start")


@query(
    "html_nesting",
    f"""WITH RECURSIVE {_elements_sql(html.SIGNIFICANT)}
SELECT module_path AS from_qn, module_path || '::' || name AS to_qn, 'CONTAINS' AS rel_type FROM named""",
)
def _html_nesting(spark, sf_dir):
    _, relationships = corpus.extract(tables.page_files(spark, sf_dir), ("html",))
    return relationships.where("rel_type = 'CONTAINS'").select("from_qn", "to_qn", "rel_type")


_LINKED = (*html.SIGNIFICANT, "a")


@query(
    "html_references",
    f"""WITH RECURSIVE {_elements_sql(_LINKED)}
SELECT module_path || '::' || name AS from_qn, href AS to_qn, 'IMPORTS' AS rel_type, line FROM named WHERE tag = 'a'""",
)
def _html_references(spark, sf_dir):
    rows = html.elements(tables.page_files(spark, sf_dir), _LINKED, ("script", "link", "a"))
    return html.references(rows).select("from_qn", "to_qn", "rel_type", "line")


def style_blocks(pages):
    """All style blocks of pages (path, source) as files of their own: the first
    is ``x.css`` for a page ``x.html``, a further one ``x_<number>.css``."""
    blocks = F.posexplode(F.regexp_extract_all("source", F.lit(r"(?s)<style[^>]*>(.*?)</style>"), F.lit(1))).alias("block", "source")
    number = F.when(F.col("block") > 0, F.concat(F.lit("_"), (F.col("block") + 1).cast("string"))).otherwise("")
    return pages.select("path", blocks).select(F.concat(F.regexp_replace("path", r"\.html$", ""), number, F.lit(".css")).alias("path"), "source")


def _page_styles(spark, sf_dir):
    return style_blocks(tables.page_files(spark, sf_dir))


@query(
    "css_rules",
    """
SELECT 'page/' || page_id || CASE WHEN block > 1 THEN '_' || block ELSE '' END || '.css::' || trim(split_part(style, '{', 1)) AS qualified_name,
       trim(split_part(style, '{', 1)) AS name, 'CssRule' AS kind, sha256(style) AS source_hash
FROM (SELECT page_id, unnest(s) AS style, unnest(range(1, len(s) + 1)) AS block
      FROM (SELECT page_id, regexp_extract_all(html, '<style[^>]*>(.*?)</style>', 1) AS s FROM pages))""",
)
def _css_rules(spark, sf_dir):
    found, _ = corpus.extract(_page_styles(spark, sf_dir), ("css",))
    return found.where("kind = 'CssRule'").select("qualified_name", "name", "kind", "source_hash")


@query(
    "corpus_merge",
    """
SELECT 'page/' || page_id || '.html' AS qualified_name, 'html' AS language, sha256(html) AS source_hash FROM pages
UNION ALL SELECT 'src/part_' || p_partkey || '.rs', 'rust', NULL FROM part
UNION ALL SELECT 'lib/supplier_' || s_suppkey || '.cpp', 'cpp', NULL FROM supplier""",
)
def _corpus_merge(spark, sf_dir):
    """File entities of a corpus of three languages, merged."""
    files = tables.page_files(spark, sf_dir)
    for language in ("rust", "cpp"):
        files = files.unionByName(tables.code_files(spark, sf_dir, language))
    entities = merge_entities([file_entities(route(files))])
    return route(entities.withColumnRenamed("file_path", "path")).select(
        "qualified_name", "language", F.when(F.col("language") == "html", F.col("source_hash")).alias("source_hash")
    )
