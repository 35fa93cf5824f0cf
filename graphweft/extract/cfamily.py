"""C and C++: functions, types, members, globals, directives, calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft.extract import core
from graphweft.extract.braces import Rule, scan
from graphweft.functions.text import qualified

# Directives are hidden from the scan and read line by line.
HIDDEN = (
    r'/\*.*?\*/|//[^\n]*|(?<![^\n])[ \t]*#(?:[^\n\\]++|\\.)*+|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"' r"|'(?:\\[^'\n]*+|[^'\\\n])'"
)
KEPT = r"""[^/"'\n#]++|\n(?![ \t]*#)"""
LEAD = r"^(?:\s++|(?:public|private|protected)\s*+:(?!:)|template\s*+<[^{};]*?>(?=\s))*+"
_NOT = r"(?!(?:if|for|while|switch|else|do|return|catch|goto|case|typedef|using|namespace|new|delete|throw)\b)"
_TAIL = r"(?:const|noexcept|override|final|->[^{}]*+|:[^{}]*+|\s++)*+$"
_RETURN = r"[\w:<>,&*~\s\[\]]*?"
# An overloaded operator goes by the word and its sign.
_OPERATOR = r"operator\s*(?:\(\s*\)|\[\s*\]|(?:new|delete)\b(?:\s*\[\s*\])?|[-+*/%^&|~!=<>,]{1,3})"
_NAME = rf"(?:\w+::)*(?:{_OPERATOR}|~?\w+)"

# A function that returns a plain type goes by its name; one that returns a
# pointer goes by its whole declarator.
_FUNCTION = rf"^{_NOT}(?:{_RETURN}[\w>&\s])?(?<![*\w~])({_NAME})\s*\([^{{}};]*\)\s*{_TAIL}"
_POINTER = rf"^{_NOT}[\w:<>,\s]*?(\*+\s*(?:{_OPERATOR}|\w+)\s*\([^{{}};]*\))\s*$"
_PROTOTYPE = rf"^{_NOT}(?!\w+\s*\()[\w:<>,&\s]*?[\w>&]\s+&?({_NAME})\s*\([^{{}};]*\)\s*(?:const|noexcept|override|final|\s)*(?:=\s*\w+\s*)?$"
_TYPE_WORD = r"(?:struct|union|class|enum)"
_GLOBAL = rf"^{_NOT}(?!{_TYPE_WORD}\s+\w+\s*$)(?!extern\s*$)[\w:<>,\s]*?[\w>]\s+(\w+)\s*(?:=(?!=).*|,.*)?$"


def _types(scopes: tuple[str, ...], cpp: bool) -> list[Rule]:
    members = "class"
    rules = [
        Rule("Struct", r"^struct\s+(\w+)\s*(?:final\s*)?(?::[^{}]*)?$", inside=scopes, scope=members, bare=True),
        Rule("Union", r"^union\s+(\w+)\s*$", inside=scopes, scope=members, bare=True),
        Rule("Enum", r"^enum\s+(?:class\s+|struct\s+)?(\w+)\s*(?::[^{}]*)?$", inside=scopes),
    ]
    if cpp:
        rules.append(Rule("Class", r"^class\s+(\w+)\s*(?:final\s*)?(?::[^{}]*)?$", inside=scopes, scope=members, bare=True))
    return rules


def rules(cpp: bool) -> list[Rule]:
    namespace = [Rule("Namespace", r"^(?:inline\s+)?namespace\s+([\w:]+)\s*$", scope="items"), Rule("Namespace", r"^(?:inline\s+)?(namespace)\s*$", scope="items", name="anonymous")]
    return [
        Rule("Typedef", r"(?s)^(typedef)\b", bare=True),
        *(namespace if cpp else []),
        *_types(("items",), cpp),
        Rule("Method", r"(?s)" + _FUNCTION, inside=("class",)),
        Rule("Method", r"(?s)" + _POINTER, inside=("class",)),
        Rule("Method", r"(?s)" + _PROTOTYPE, inside=("class",), block=False, bare=True),
        Rule("Function", r"(?s)" + _POINTER),
        Rule("Function", r"(?s)" + _FUNCTION),
        Rule("Function", r"(?s)" + _PROTOTYPE, block=False, bare=True),
        Rule("Variable", r"(?s)" + _GLOBAL, bare=True),
    ]


# ---- fixed values: words that precede a parenthesis without being called ------
KEYWORDS = tuple("if for while switch return sizeof catch alignof decltype defined else do new delete throw".split())
# -----------------------------------------------------------------------------
CALL = r"(?<![\w.>:~])([A-Za-z_]\w*(?:(?:\.|->|::)~?[A-Za-z_]\w*)*)\s*\("


def declarations(files: DataFrame, cpp: bool) -> DataFrame:
    rows = core.declarations(files, _scanned("masked", cpp), _masked(F.col("source")), {"Typedef": "^[^;{}]*;"})
    # A typedef goes by its last word, unless that word is a parameter list.
    alias = F.regexp_extract(core.flat(F.col("masked_text")), r"(?s)([A-Za-z_]\w*)\s*(?:\[\s*\]\s*)*;\s*$", 1)
    constant = (F.col("kind") == "Variable") & F.contains(F.col("source_text"), F.lit("const "))
    rows = rows.withColumn("name", F.when(F.col("kind") == "Typedef", alias).otherwise(F.col("name")))
    rows = rows.withColumn("kind", F.when(constant, "Constant").otherwise(F.col("kind"))).where("name <> ''")
    return rows.withColumn("qualified_name", F.concat_ws("::", "module_path", "name"))


def _scanned(masked: str, cpp: bool) -> Column:
    return scan(F.col(masked), F.col("path"), rules(cpp), LEAD, transparent=r'^extern\s+"?\s*"?$')


def _masked(source: Column) -> Column:
    masked = core.mask(source, HIDDEN, KEPT)
    for word in ("public", "private", "protected"):  # any number of labels may stand before a member
        masked = F.regexp_replace(masked, rf"\b{word}:(?!:)", " " * (len(word) + 1))
    return masked


def directives(files: DataFrame, cpp: bool = False) -> DataFrame:
    """``#include`` and ``#define`` lines outside comments. Their parent is the
    innermost namespace around them, else the file."""
    visible = core.mask(F.col("source"), r"/\*.*?\*/|//[^\n]*", r"[^/]++")
    lines = F.transform(F.split(visible, "\n"), lambda text, i: F.struct((i + 1).alias("line_start"), text.alias("text")))
    lines = F.filter(lines, lambda d: d["text"].rlike(r"^\s*#\s*(?:include|define)\b"))
    spaces = core.empty(core.DECLARATION)
    if cpp:  # only a file with a directive behind a namespace is scanned for it
        inside = F.col("source").rlike(r"(?s)\bnamespace\b.*\n[ \t]*#[ \t]*(?:include|define)\b")
        spaces = F.when(inside, F.filter(_scanned("masked", cpp), lambda d: d["kind"] == "Namespace")).otherwise(spaces)

    def parent(line: Column, held: Column) -> Column:
        around = F.filter(held, lambda d: (d["line_start"] < line) & (d["line_end"] > line))
        deepest = F.array_max(F.transform(around, lambda d: F.struct(d["line_start"].alias("at"), F.concat_ws("::", d["parent"], d["name"]).alias("qn"))))
        return F.coalesce(deepest["qn"], F.col("path"))

    found = files.select("path", lines.alias("lines"), *(["source"] if cpp else []))
    if cpp:
        found = found.withColumn("masked", F.when(inside, _masked(F.col("source")))).withColumn("spaces", spaces)
    else:
        found = found.withColumn("spaces", spaces)
    placed = F.transform("lines", lambda d: F.struct(d["line_start"].alias("line_start"), d["text"].alias("text"), parent(d["line_start"], F.col("spaces")).alias("module_path")))
    return found.select("path", F.inline(placed)).select(
        "module_path",
        F.col("path").alias("file_path"),
        "line_start",
        F.trim("text").alias("source_text"),
        F.regexp_extract("text", r"^\s*#\s*define\s+(\w+)", 1).alias("name"),
        F.col("line_start").alias("line_end"),
        F.concat_ws("::", "module_path", F.regexp_extract("text", r"^\s*#\s*define\s+(\w+)", 1)).alias("qualified_name"),
        F.regexp_extract("text", r'^\s*#\s*include\s*("[^"]*"|<[^>]*>)', 1).alias("target"),
    )


def _declaration_facts(files: DataFrame, cpp: bool) -> DataFrame:
    rows = core.with_body(declarations(files, cpp))
    kind, qn, body = F.col("kind"), F.col("qualified_name"), F.col("body")
    head = F.regexp_replace(F.substring(F.col("source_text"), F.lit(1), F.col("body_at")), r"^\s+|\s+$", "")
    function = kind.isin("Function", "Method")
    bodied = F.col("body_at").isNotNull()
    holder = bodied & kind.isin("Struct", "Union", "Class")

    bases = F.split(F.regexp_extract("head", r"(?s)^[^:]*:(?!:)\s*(.*)$", 1), ",")
    base = r"^\s*(?:(?:public|private|protected|virtual)\s+)*((?:\w+::)*\w+)\s*$"
    member = r"^\s*(?:(?:public|private|protected)\s*:\s*)*((?:const\s+|static\s+|mutable\s+|volatile\s+)*)([\w:<>,\s]*?[\w>])\s+(\w+)\s*$"
    fields = F.filter(
        F.transform(
            F.split(core.squeezed(core.flat(body)), "[;}]"),
            lambda m: F.struct(F.regexp_extract(m, member, 2).alias("type"), F.regexp_extract(m, member, 3).alias("name")),
        ),
        lambda f: f["name"] != "",
    )
    variants = core.named(F.split(core.flat(body), ","), r"^\s*(\w+)")
    return core.facts(
        rows,
        F.array(core.entity(signature=F.when(function, head))),
        [
            F.array(core.contains()),
            core.edges(holder, core.named(bases, base), lambda b: core.edge("EXTENDS", qn, b)),
            core.edges(holder, fields, lambda f: core.edge("HAS_FIELD", qn, f["type"], field_name=f["name"], field_type=f["type"])),
            core.edges(bodied & (kind == "Enum"), variants, lambda v: core.edge("HAS_VARIANT", qn, qualified(qn, v), variant_name=v)),
            core.calls(bodied & function, CALL, KEYWORDS),
        ],
    )


def _directive_facts(files: DataFrame, cpp: bool) -> DataFrame:
    macro, include = F.col("name") != "", F.col("target") != ""
    import_edge = core.edge("IMPORTS", F.col("module_path"), F.col("target"), line=F.col("line_start"))
    return core.facts(
        directives(files, cpp),
        core.only(macro, F.array(core.entity(kind=F.lit("Preprocessor"))), core.ENTITIES),
        [core.only(macro, F.array(core.contains()), core.EDGES), core.only(include, F.array(import_edge), core.EDGES)],
    )


def facts(files: DataFrame, cpp: bool) -> DataFrame:
    return _declaration_facts(files, cpp).unionByName(_directive_facts(files, cpp))
