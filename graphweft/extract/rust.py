"""Rust: items, fields, variants, implementations, imports, calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft.extract import core
from graphweft.extract.braces import Rule, scan
from graphweft.functions.text import qualified

# Comments, strings and characters; a text whose block comments nest is lexed.
HIDDEN = (
    r'/\*.*?\*/|//[^\n]*|\br"[^"]*+"|\br#+".*?"#+|"[^"\\]*+(?:\\.[^"\\]*+)*+"|' r"'(?:\\[^'\n]*+|[^'\\\n])'"
)
KEPT = r"""[^/"'r]++|r(?![#"])"""
# Possessive throughout: a group of alternatives under a plain star is matched by
# recursion, and a long comment would overflow the stack.
LEAD = r"^(?:\s++|#!?\[[^\]]*+\])*+"
VIS = r"(?:pub(?:\s*\([^)]*\))?\s+)?"

_TYPE = r"([A-Za-z_]\w*)"
_FOR = rf"^(?:unsafe\s+)?impl(?:\s*<[^{{}}]*?>)?\s+!?[\w:<>,'&\s]+?\s+for\s+{_TYPE}\s*(?:where\b[^{{}}]*)?$"
_OWN = rf"^(?:unsafe\s+)?impl(?:\s*<[^{{}}]*?>)?\s+{_TYPE}\s*(?:where\b[^{{}}]*)?$"

_FN = rf"^{VIS}(?:(?:default|const|async|unsafe|extern)\s++)*+fn\s+(\w+)"

RULES = [
    Rule("Import", rf"^{VIS}(use)\s", bare=True),
    Rule("Function", _FN),
    Rule("Method", _FN, inside=("fns",)),
    Rule("Struct", rf"^{VIS}struct\s+(\w+)", bare=True),
    Rule("Enum", rf"^{VIS}enum\s+(\w+)"),
    Rule("Trait", rf"^{VIS}(?:unsafe\s+)?(?:auto\s+)?trait\s+(\w+)", scope="fns"),
    Rule("Impl", _FOR, scope="fns", base=_FOR),
    Rule("Impl", _OWN, scope="fns", base=_OWN),
    Rule("TypeAlias", rf"^{VIS}type\s+(\w+)", block=False, bare=True),
    Rule("Macro", r"^macro_rules!\s*(\w+)"),
    Rule("Module", rf"^{VIS}mod\s+(\w+)", scope="items", bare=True),
    Rule("Constant", rf"^{VIS}const\s+(\w+)\s*:", bare=True),
    Rule("Static", rf"^{VIS}static\s+(?:mut\s+)?(\w+)\s*:", bare=True),
]

# ---- fixed values: primitive types are no field targets, words that precede a
# parenthesis without being called --------------------------------------------
PRIMITIVES = tuple("u8 u16 u32 u64 u128 usize i8 i16 i32 i64 i128 isize f32 f64 bool char str".split())
KEYWORDS = tuple("if while for match return loop in let fn as else move mut ref where impl dyn use pub crate".split())
# -----------------------------------------------------------------------------
CALL = r"(?<!fn )(?<![\w!])((?:[A-Za-z_]\w*::)*[A-Za-z_]\w*)\s*\("


def _masked(text: Column) -> Column:
    hidden = F.when(text.rlike(core.NESTS), core.mask_nested(text)).otherwise(core.mask(text, HIDDEN, KEPT))
    # Semicolons in array types would end a statement.
    return F.regexp_replace(hidden, r"(\[[^\[\]{}();]*);(?=[^\[\]{}();]*\])", "$1,")


def _visibility(text: Column) -> Column:
    modifier = F.regexp_extract(text, r"^(pub(?:\([^)]*\))?)(?:\s|$)", 1)
    return (
        F.when(modifier.isin("pub", "pub(crate)", "pub(super)"), modifier).when(modifier != "", "pub").otherwise("private")
    )


def _doc(lead: Column) -> Column:
    """The run of doc comment lines that ends the lead, or the doc block that
    does. An attribute or a plain comment in between ends the run."""
    lines = F.filter(F.transform(F.split(lead, "\n"), lambda line: F.trim(line)), lambda line: line != "")
    run = F.aggregate(
        F.reverse(lines),
        F.struct(F.lit(True).alias("on"), core.empty("string").alias("docs")),
        lambda acc, line: core.let(
            acc["on"] & line.rlike("^//[/!]"),
            lambda on: F.struct(
                on.alias("on"),
                F.when(on, F.array_prepend(acc["docs"], F.trim(F.regexp_replace(line, "^(?:///|//!)", "")))).otherwise(acc["docs"]).alias("docs"),
            ),
        ),
        lambda acc: acc["docs"],
    )
    block = F.trim(F.regexp_extract(lead, r"(?s)/\*\*((?:(?!\*/).)*+)\*/\s*$", 1))
    return core.let(
        run, lambda docs: F.when(F.size(docs) > 0, F.array_join(docs, "\n")).when(block != "", block)
    )


def declarations(files: DataFrame) -> DataFrame:
    """All Rust declarations, one row each; imports come as kind ``Import``."""
    found = core.declarations(files, scan(F.col("masked"), F.col("path"), RULES, LEAD, transparent=r'^(?:unsafe\s+)?extern\b[^()]*$'), _masked(F.col("source")))
    head = F.substring(F.col("source_text"), F.lit(1), F.col("body_at"))
    implemented = F.regexp_extract(F.col("masked_text"), r"^(?:unsafe\s+)?impl(?:\s*<[^{}]*?>)?\s+!?([\w:<>,'&\s]+?)\s+for\s", 1)
    # A generic or scoped trait goes by the type name it holds.
    trait = F.when(implemented != "", F.regexp_extract(F.regexp_replace(implemented, r"<.*$", ""), r"(\w+)\s*$", 1))
    rows = found.withColumn("trait", F.when(F.col("kind") == "Impl", trait)).withColumn("type", F.col("name"))
    named = rows.withColumn(
        "name",
        F.when(F.col("kind") == "Impl", F.concat(F.lit("impl "), F.coalesce(F.concat("trait", F.lit(" for ")), F.lit("")), "name")).otherwise(F.col("name")),
    )
    return named.select(
        *[c for c in named.columns if c != "qualified_name"],
        F.concat_ws("::", "module_path", "name").alias("qualified_name"),
        F.when(F.col("kind").isin("Function", "Method"), F.trim(head)).alias("signature"),
    )


def facts(files: DataFrame) -> DataFrame:
    rows = core.with_body(declarations(files))
    kind, qn = F.col("kind"), F.col("qualified_name")
    imported = kind == "Import"
    signature_words = F.regexp_extract(F.col("signature"), r"^(.*?)\bfn\b", 1)
    found = core.entity(
        visibility=_visibility(F.col("source_text")),
        doc_comment=_doc(F.col("lead_text")),
        signature=F.col("signature"),
        is_async=F.coalesce(signature_words.rlike(r"\basync\b"), F.lit(False)),
    )
    path = F.trim(F.regexp_replace(F.regexp_replace("source_text", r"^(?:use )+", ""), r";+$", ""))
    import_edge = core.edge("IMPORTS", F.col("module_path"), path, line=F.col("line_start"))

    members = F.regexp_replace("body", r"#\[[^\]]*\]", "")
    pattern = r"^\s*(?:pub(?:\([^)]*\))?\s+)?(\w+)\s*:\s*([A-Za-z_]\w*)\s*$"
    fields = F.filter(
        F.transform(
            F.split(members, ","),
            lambda f: F.struct(F.regexp_extract(f, pattern, 1).alias("name"), F.regexp_extract(f, pattern, 2).alias("type")),
        ),
        lambda f: (f["name"] != "") & ~f["type"].isin(*PRIMITIVES),
    )
    variants = core.named(F.split(core.flat(members), ","), r"^\s*(\w+)")
    bounds = F.split(F.regexp_extract("head", r"(?s)^[^:]*:\s*(.*?)\s*(?:where\b.*)?$", 1), r"\s*\+\s*")
    bodied = F.col("body_at").isNotNull()
    implements = (kind == "Impl") & F.col("trait").isNotNull()
    return core.facts(
        rows,
        core.only(~imported, F.array(found), core.ENTITIES),
        [
            F.when(imported, F.array(import_edge)).otherwise(F.array(core.contains())),
            core.edges(
                bodied & (kind == "Struct"), fields, lambda f: core.edge("HAS_FIELD", qn, f["type"], field_name=f["name"], field_type=f["type"])
            ),
            core.edges(bodied & (kind == "Enum"), variants, lambda v: core.edge("HAS_VARIANT", qn, qualified(qn, v), variant_name=v)),
            core.edges(bodied & (kind == "Trait"), core.named(bounds, r"^([A-Za-z_]\w*)$"), lambda b: core.edge("EXTENDS", qn, b)),
            core.only(kind == "Impl", F.array(core.edge("IMPL_FOR", qn, F.col("type"))), core.EDGES),
            core.only(implements, F.array(core.edge("IMPLEMENTS", qn, F.col("trait"))), core.EDGES),
            core.calls(bodied & kind.isin("Function", "Method"), CALL, KEYWORDS),
        ],
    )
