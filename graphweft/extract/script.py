"""JavaScript and TypeScript: functions, classes, members, variables, types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft.extract import core
from graphweft.extract.braces import Rule, scan
from graphweft.functions.text import qualified

# What stands before a slash tells a regular expression from a division. ``<``,
# ``>`` and ``}`` are left to markup and blocks, of ``=>`` the arrow counts.
_BEFORE = r"(?<=^|(?:[(,=:\[!&|?{;%~^]|=>|(?<!\+)\+|(?<!-)-|\*|\b(?:return|typeof|case|in|of|do|else|void|delete|throw|await|yield))\s{0,16})"
_REGEX = rf"{_BEFORE}/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\])++/[a-z]*+"
HIDDEN = (
    r'/\*.*?\*/|//[^\n]*|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"' r"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'" rf"|`[^`\\]*+(?:\\.[^`\\]*+)*+`|{_REGEX}"
)
KEPT = r"""[^/"'`]++"""
LEAD = r"^\s*+(?:@[\w.]++(?:\([^)]*+\))?+\s*+)*+(?:export\s++(?:default\s++)?)?(?:declare\s++)?"
# A newline ends a statement when the line could end one and the next line
# starts with a word. A blank at its end may be a hidden string or comment.
BOUNDARY = r"(?<=[{};])|(?<=\n)(?<=[\w)\]}'\"` \t]\n)(?=[ \t]*[A-Za-z_$#@])"
_NOT = r"(?!(?:if|for|while|switch|catch|return|function|else|do|new|await|typeof|super)\b)"
_ID = r"[A-Za-z_$][\w$]*"
_TYPE = r"(?::[^=;{}]*)?"
_ARROW = rf"=\s*(?:async\s+)?(?:(?:\([^{{}}]*?\)|{_ID})\s*(?::[^=;{{}}]*)?=>|function\b)"
# A comma that begins a further declarator of the same statement.
_NEXT = r",(?=\s*[A-Za-z_$][\w$]*\s*(?:[:=,;!]|$))"
_MODS = r"(?:(?:public|private|protected|static|readonly|override|abstract|async|get|set|declare)\s+)*"

RULES = [
    Rule("Import", r"(?s)^(import)\b(?!\s*\()", bare=True),
    Rule("Function", rf"(?s)^(?:async\s+)?function\s+({_ID})"),
    Rule("Class", rf"(?s)^class\s+({_ID})", scope="class"),
    Rule("Interface", rf"(?s)^interface\s+({_ID})"),
    Rule("Enum", rf"(?s)^(?:const\s+)?enum\s+({_ID})"),
    Rule("TypeAlias", rf"(?s)^type\s+({_ID})[^=]*=", bare=True),
    Rule("Function", rf"(?s)^(?:const|let|var)\s+({_ID})\s*{_TYPE}{_ARROW}", bare=True),
    Rule("Constant", rf"(?s)^const\s+({_ID})\b", bare=True),
    Rule("Variable", rf"(?s)^(?:let|var)\s+({_ID})\b", bare=True),
    Rule("Constructor", rf"(?s)^{_MODS}(constructor)\s*\(", inside=("class",)),
    Rule("Method", rf"(?s)^{_NOT}{_MODS}\*?\s*(#?{_ID})\s*(?:<[^>]*>)?\s*\([^;]*$", inside=("class",)),
    Rule("Property", rf"(?s)^{_NOT}{_MODS}(#?{_ID})\s*[?!]?\s*(?:[:=].*)?$", inside=("class",), bare=True),
]

# ---- fixed values: words that precede a parenthesis without being called ------
KEYWORDS = tuple("if for while switch catch function return super typeof import await async new else do".split())
# -----------------------------------------------------------------------------
CALL = r"(?<!new )(?<![\w$.#])(?!new\s)([A-Za-z_$][\w$]*(?:\??\.#?[A-Za-z_$][\w$]*)*)\s*\("


def declarations(files: DataFrame) -> DataFrame:
    masked = core.mask(F.col("source"), HIDDEN, KEPT)
    found = scan(F.col("masked"), F.col("path"), RULES, LEAD, boundary=BOUNDARY, transparent="(?s)^.*$")
    # A declarator with a block may be followed by others of its statement.
    more = {kind: r"^(?:,\s*[^;{}\n]*)?;?" for kind in ("Function", "Constant", "Variable")}
    return core.declarations(files, found, masked, {"Import": r"^[^\n;]*;?", **more})


def _rows(files: DataFrame) -> DataFrame:
    """Declarations with the language of their file. Types, interfaces and enums
    only exist in TypeScript; variables go by their declarator."""
    scripts = F.regexp_extract("file_path", r"\.([^.]*)$", 1).isin("js", "mjs", "cjs", "jsx")
    rows = declarations(files).withColumn("plain", scripts)
    rows = rows.where("NOT (plain AND kind IN ('Interface', 'TypeAlias', 'Enum'))")
    keyword = F.regexp_extract("source_text", r"^(?:const|let|var)\s+", 0)
    declared = (keyword != "") & F.col("kind").isin("Function", "Constant", "Variable")
    rows = rows.withColumn("declared", declared).withColumn("_k", F.when(declared, F.length(keyword)).otherwise(0))
    # Node text of a variable is its declarator, and a statement may hold several.
    rest = F.expr("substring(masked_text, _k + 1)")
    parts = F.when(F.col("declared"), F.split(core.flat(rest), _NEXT)).otherwise(F.array(rest))
    rows = rows.withColumn("_parts", parts)
    start = lambda i: F.length(F.array_join(F.slice("_parts", F.lit(1), i), ",")) + F.when(i > 0, 1).otherwise(0)
    spans = F.transform("_parts", lambda part, i: F.struct(i.alias("_i"), (start(i) + F.col("_k")).alias("_from"), F.length(part).alias("_size")))
    rows = rows.select("*", F.inline(spans)).withColumn("_part", F.expr("substring(masked_text, _from + 1, _size)"))
    blank = F.regexp_extract("_part", r"^\s*", 0)
    first = F.col("_i") == 0
    arrow = F.col("_part").rlike(rf"(?s)^\s*{_ID}\s*{_TYPE}{_ARROW}")
    plain_kind = F.when(keyword.startswith("const"), "Constant").otherwise("Variable")
    block = F.when(first, F.col("body_at") - F.col("_from")).when(F.instr("_part", "{") > 0, F.instr("_part", "{") - 1)
    begins = F.col("_from") + F.length(blank)
    text = F.regexp_replace(F.expr("substring(source_text, _begins + 1, _size - _blank)"), r"[;\s]+$", "")
    return (
        rows.withColumn("_begins", begins)
        .withColumn("_blank", F.length(blank))
        .select(
            "file_path",
            "module_path",
            "notes",
            "lead_text",
            "plain",
            "declared",
            F.when(F.col("declared"), F.regexp_extract("_part", rf"^\s*({_ID})", 1)).otherwise(F.col("name")).alias("name"),
            F.when(first, F.col("kind")).when(arrow, "Function").otherwise(plain_kind).alias("kind"),
            (F.col("line_start") + core.newlines(F.expr("substring(masked_text, 1, _begins)"))).alias("line_start"),
            F.when(
                F.col("declared"), F.col("line_start") + core.newlines(F.expr("substring(masked_text, 1, _from + _size)"))
            ).otherwise(F.col("line_end")).alias("line_end"),
            text.alias("source_text"),
            F.expr("substring(_part, _blank + 1)").alias("masked_text"),
            F.when((block >= 0) & (block < F.col("_size")), block - F.col("_blank")).alias("body_at"),
        )
        .withColumn("qualified_name", qualified(F.col("module_path"), F.col("name")))
    )


def _members() -> Column:
    """Method and property signatures of an interface as entities."""
    parts = F.split(core.flat(F.col("body")), r"(?<=[;,\n])")
    pattern = r"^\s*(?:readonly\s+)?([A-Za-z_$][\w$]*)\s*\??\s*"
    qn = F.col("qualified_name")

    def member(part: Column, i: Column) -> Column:
        name = F.regexp_extract(part, pattern + r"(?=[(<:])", 1)
        before = core.newlines(F.array_join(F.slice(parts, F.lit(1), i), "")) + core.newlines(F.regexp_extract(part, r"^\s*", 0))
        return core.entity(
            kind=F.when(part.rlike(pattern + r"[(<]"), "Method").otherwise("Property"),
            name=name,
            module_path=qn,
            qualified_name=qualified(qn, name),
            source_text=F.regexp_replace(part, r"^\s+|[\s;,]+$", ""),
            line_start=F.col("body_line") + before,
            line_end=F.col("body_line") + before,
        )

    found = F.filter(F.transform(parts, member), lambda e: e["name"] != "")
    return core.only(F.col("body_at").isNotNull() & (F.col("kind") == "Interface"), found, core.ENTITIES)


def facts(files: DataFrame) -> DataFrame:
    rows = core.with_body(_rows(files)).withColumn("members", _members())
    kind, name, qn, text = F.col("kind"), F.col("name"), F.col("qualified_name"), F.col("source_text")
    imported = kind == "Import"
    function = kind == "Function"
    method = kind.isin("Method", "Constructor")
    arrow = F.col("declared") & function
    rows = rows.withColumns({"_from": core.list_start("masked_text"), "_to": core.list_end("masked_text")})
    params = core.cut(text, F.col("_from"), F.col("_to"))
    returned = F.regexp_extract(F.expr("substring(source_text, _to + 1)"), r"(?s)^\s*:\s*([^={]+?)\s*\{", 1)
    returned = F.when(F.col("_to") > 0, returned).otherwise("")
    bare_arrow = F.regexp_extract(text, r"=\s*(?:async\s+)?([A-Za-z_$][\w$]*)\s*=>", 1)
    typed = F.when(returned != "", F.concat(F.lit(": "), returned)).otherwise("")
    signature = (
        F.when(arrow & (bare_arrow == ""), F.concat(F.lit("const "), name, F.lit(" = "), params))
        .when(function & ~F.col("declared"), F.concat(F.lit("function "), name, params, typed))
        .when(method, F.concat(name, params))
    )
    is_async = (
        (arrow & text.rlike(r"^[^=]*=\s*async\s"))
        | (function & ~F.col("declared") & text.startswith("async "))
        | (method & F.contains(text, F.lit("async ")))
    )
    visibility = F.when((kind == "Method") & name.startswith("#"), "private").otherwise("pub")
    found = F.array(core.entity(signature=signature, is_async=is_async, visibility=visibility))

    module = F.regexp_extract(text, r"""(?s)^import\b.*?["']([^"']*)["']\s*(?:with\b.*)?;?\s*$""", 1)
    import_edge = core.edge("IMPORTS", F.col("module_path"), module, line=F.col("line_start"))
    bodied = F.col("body_at").isNotNull()
    # Only plain scripts name the base class directly under the class heading.
    base = F.regexp_extract("head", r"^class\s+[\w$]+\s+extends\s+([A-Za-z_$][\w$]*)\s*$", 1)
    bases = F.split(F.regexp_extract("head", r"(?s)\sextends\s+(.*)$", 1), ",")
    variants = core.named(F.split(core.flat(F.col("body")), ","), r"^\s*([A-Za-z_$][\w$]*)")
    # An arrow without a block calls from its expression.
    expression = F.regexp_extract("masked_text", r"(?s)^[^=]*=\s*(?:async\s+)?(?:\([^)]*\)|[\w$]+)\s*(?::[^=]*)?=>(?!\s*\{)(.*)$", 1)
    rows = rows.withColumn("_body", F.coalesce("body", expression)).withColumn(
        "_line", F.coalesce("body_line", F.col("line_start") + core.newlines(F.col("masked_text")) - core.newlines(expression))
    )
    return core.facts(
        rows,
        core.only(~imported, F.concat(found, F.col("members")), core.ENTITIES),
        [
            core.only(~imported, F.array(core.contains()), core.EDGES),
            core.edges(F.lit(True), F.col("members"), lambda e: core.edge("CONTAINS", e["module_path"], e["qualified_name"])),
            core.only(imported & (module != ""), F.array(import_edge), core.EDGES),
            core.only(bodied & (kind == "Class") & F.col("plain") & (base != ""), F.array(core.edge("EXTENDS", qn, base)), core.EDGES),
            core.edges(bodied & (kind == "Interface"), core.named(bases, r"^\s*([A-Za-z_$][\w$]*)\s*$"), lambda b: core.edge("EXTENDS", qn, b)),
            core.edges(bodied & (kind == "Enum"), variants, lambda v: core.edge("HAS_VARIANT", qn, qualified(qn, v), variant_name=v)),
            core.calls(function | method, CALL, KEYWORDS, "_body", "_line"),
        ],
    )
