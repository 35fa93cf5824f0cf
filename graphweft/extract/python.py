"""Python: functions, classes, imports, decorators, assignments, calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft.extract import core
from graphweft.functions.text import qualified

HIDDEN = (
    r'#[^\n]*|"""[^"\\]*+(?:(?:\\.|"(?!""))[^"\\]*+)*+"""' r"|'''[^'\\]*+(?:(?:\\.|'(?!''))[^'\\]*+)*+'''"
    r'|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"' r"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
)
KEPT = r"""[^#"']++"""

# ---- fixed values: words that are no assignment target or callee --------------
KEYWORDS = tuple(
    "if elif else for while with as try except finally return yield lambda and or not in is assert del raise "
    "import from global nonlocal pass break continue await async def class match case".split()
)
# -----------------------------------------------------------------------------
_WORD = r"[^\W\d]\w*"
_DEF = rf"^\s*(?:async\s+)?def\s+({_WORD})"
_CLASS = rf"^\s*class\s+({_WORD})"
_IMPORT = r"^\s*(import|from)\s"
# A plain name before ``=`` or before an annotation.
_ASSIGN = rf"^\s*({_WORD})\s*(?:=(?!=)|:\s*[^\s=:])"
CALL = rf"(?<!def )(?<!class )(?<![\w.])({_WORD}(?:\.{_WORD})*)\s*\("

_BLOCK = (
    "struct<indent:int,scope:string,kind:string,name:string,parent:string,base:string,pos:int,line:int,notes:array<string>>"
)


def _scan(source: Column, masked: Column, path: Column) -> Column:
    """Declarations of a module as an array, by indentation.

    A line that starts a statement closes every block indented as far or
    further; a block ends with its last line that is not blank.
    """
    raw_lines, lines = F.split(source, "\n"), F.split(masked, "\n")

    def event(line: Column, raw: Column) -> Column:
        return core.let(F.regexp_replace(line, r"\s+$", ""), lambda code: described(line, raw, code))

    def described(line: Column, raw: Column, code: Column) -> Column:
        depth = F.length(F.regexp_replace(code, r"[^(\[{]", "")) - F.length(F.regexp_replace(code, r"[^)\]}]", ""))
        decorator = F.regexp_extract(raw, r"^\s*@\s*(.*?)\s*(?:#.*)?$", 1)
        return F.struct(
            F.length(line).alias("size"),
            code.alias("code"),
            # A docstring line is blank once masked, yet belongs to its block.
            (F.trim(F.regexp_replace(raw, r"^\s*#.*$", "")) == "").alias("blank"),
            F.length(F.regexp_extract(raw, r"^[ \t]*", 0)).alias("indent"),
            F.length(F.regexp_replace(raw, r"\s+$", "")).alias("used"),
            depth.alias("depth"),
            code.endswith("\\").alias("carries"),
            F.when(code.rlike(r"^\s*@"), decorator).alias("decorator"),
            # Inside a string that spans lines the masked line shows nothing.
            (code == "").alias("hidden"),
        )

    events = F.transform(F.arrays_zip(lines.alias("l"), raw_lines.alias("r")), lambda z: event(z["l"], z["r"]))

    def statement(code: Column) -> Column:
        """What a line declares: struct<name, kind>, null for nothing."""
        assigned = F.regexp_extract(code, _ASSIGN, 1)
        option = [
            (F.regexp_extract(code, _DEF, 1), "Function"),
            (F.regexp_extract(code, _CLASS, 1), "Class"),
            (F.regexp_extract(code, _IMPORT, 1), "Import"),
            (F.when(assigned.isin(*KEYWORDS), "").otherwise(assigned), "Variable"),
        ]
        return F.coalesce(*[F.when(n != "", F.struct(n.alias("name"), F.lit(k).alias("kind"))) for n, k in option])

    def ended(block: Column, stop: Column, line: Column) -> Column:
        return F.struct(
            block["kind"].alias("kind"),
            block["name"].alias("name"),
            block["parent"].alias("parent"),
            block["pos"].alias("pos"),
            F.lit(-1).alias("body"),
            stop.alias("stop"),
            block["line"].alias("line_start"),
            line.alias("line_end"),
            block["pos"].alias("lead"),
            block["notes"].alias("notes"),
        ).cast(core.DECLARATION)

    def step(s: Column, e: Column) -> Column:
        # A line that only shows string text or a continuation starts nothing.
        starts = (s["depth"] == 0) & ~s["carries"] & ~e["blank"] & ~(e["hidden"] & s["in_text"])
        closing = F.filter(s["stack"], lambda b: starts & (b["indent"] >= e["indent"]))
        stack = F.filter(s["stack"], lambda b: ~(starts & (b["indent"] >= e["indent"])))

        def apply(open_: Column) -> Column:
            top = F.try_element_at(open_, F.lit(-1))
            scope = F.coalesce(top["scope"], F.lit("items"))
            # Nothing is declared inside a function.
            declared = F.when(starts & (scope == "items"), statement(e["code"]))
            return core.let(declared, lambda d: advance(open_, top, d))

        def advance(open_: Column, top: Column, d: Column) -> Column:
            base = F.coalesce(top["base"], s["path"])
            kind, named = d["kind"], d.isNotNull()
            pos = s["pos"] + e["indent"]
            method = kind == "Function"
            written = (
                F.when(method & (d["name"] == "__init__"), "Constructor")
                .when(method & (base != s["path"]), "Method")
                .otherwise(kind)
            )
            block = F.struct(
                e["indent"].alias("indent"),
                F.when(kind == "Class", "items").otherwise("opaque").alias("scope"),
                written.alias("kind"),
                d["name"].alias("name"),
                base.alias("parent"),
                qualified(base, d["name"]).alias("base"),
                pos.alias("pos"),
                s["line"].alias("line"),
                F.when(method, s["notes"]).otherwise(core.empty("string")).alias("notes"),
            ).cast(_BLOCK)
            depth = F.when(e["blank"] & (s["depth"] == 0), 0).otherwise(F.greatest(s["depth"] + e["depth"], F.lit(0)))
            used = ~e["blank"]
            state = F.struct(
                (s["pos"] + e["size"] + 1).cast("int").alias("pos"),
                (s["line"] + 1).cast("int").alias("line"),
                depth.cast("int").alias("depth"),
                e["carries"].alias("carries"),
                F.when(used, s["pos"] + e["used"]).otherwise(s["last"]).cast("int").alias("last"),
                F.when(used, s["line"]).otherwise(s["last_line"]).cast("int").alias("last_line"),
                (e["hidden"] | (s["in_text"] & e["hidden"])).alias("in_text"),
                F.when(e["decorator"].isNotNull() & starts, F.array_append(s["notes"], e["decorator"]))
                .when(starts, core.empty("string"))
                .otherwise(s["notes"])
                .alias("notes"),
                F.when(named, F.array_append(open_, block)).otherwise(open_).alias("stack"),
                s["path"].alias("path"),
            )
            out = F.transform(F.reverse(closing), lambda b: ended(b, s["last"], s["last_line"]))
            return F.struct(state.alias("s"), out.alias("out"))

        return core.let(stack, apply)

    state = F.struct(
        F.lit(0).alias("pos"),
        F.lit(1).alias("line"),
        F.lit(0).alias("depth"),
        F.lit(False).alias("carries"),
        F.lit(0).alias("last"),
        F.lit(1).alias("last_line"),
        F.lit(False).alias("in_text"),
        core.empty("string").alias("notes"),
        core.empty(_BLOCK).alias("stack"),
        path.alias("path"),
    )
    done = core.fold(events, state, step, core.DECLARATION)
    return core.let(
        done, lambda r: F.concat(r["out"], F.transform(F.reverse(r["s"]["stack"]), lambda b: ended(b, r["s"]["last"], r["s"]["last_line"])))
    )


def declarations(files: DataFrame) -> DataFrame:
    masked = core.mask(F.col("source"), HIDDEN, KEPT)
    return core.declarations(files, _scan(F.col("source"), F.col("masked"), F.col("path")), masked)


def facts(files: DataFrame) -> DataFrame:
    rows = declarations(files)
    kind, name, qn = F.col("kind"), F.col("name"), F.col("qualified_name")
    imported = kind == "Import"
    function = kind.isin("Function", "Method", "Constructor")
    # A heading ends with the first colon that ends its line; a block on the
    # heading's own line has none, then it ends behind the parameter list.
    heading = F.length(F.regexp_extract("masked_text", r"(?s)^.*?:[ \t]*(?=\n|$)", 0))
    rows = rows.withColumn("_to", F.when(F.col("masked_text").rlike(r"^[^(:]*\("), core.list_end("masked_text")).otherwise(0))
    behind = F.length(F.regexp_extract(F.expr("substring(masked_text, _to + 1)"), r"(?s)^[^:]*:", 0))
    one_line = F.when(behind > 0, F.col("_to") + behind).otherwise(0)
    rows = rows.withColumn("_h", F.when(function | (kind == "Class"), F.when(heading > 0, heading).otherwise(one_line)))
    rows = rows.select(
        "*",
        F.expr("left(source_text, _h)").alias("head"),
        F.expr("left(masked_text, _h)").alias("masked_head"),
        F.expr("substring(masked_text, _h + 1)").alias("body"),
        (F.col("line_start") + core.newlines(F.expr("left(masked_text, _h)"))).alias("body_line"),
    )

    params = F.regexp_extract("head", r"(?s)^(?:async\s+)?def\s+\w+\s*(\(.*\))\s*(?:->.*)?:\s*$", 1)
    returned = F.regexp_extract("head", r"(?s)\)\s*->\s*(.*?)\s*:\s*$", 1)
    typed = F.when(returned != "", F.concat(F.lit(" -> "), returned)).otherwise("")
    text = r"""[rRuUbBfF]{0,2}(?:\"{3}(?:(?!\"{3}).)*+\"{3}|'{3}(?:(?!'{3}).)*+'{3}|"[^"\n]*"|'[^'\n]*')"""
    doc = F.regexp_extract(F.expr("substring(source_text, _h + 1)"), rf"(?s)^(?:\s*+#[^\n]*+\n)*+\s*+({text})\s*(?:\n|$)", 1)
    visibility = (
        F.when(~function, "pub")
        .when(name.startswith("__") & ~name.endswith("__"), "private")
        .when(name.startswith("_"), "pub(crate)")
        .otherwise("pub")
    )
    constant = (kind == "Variable") & name.rlike(r"^[\p{Lu}_]+$")
    found = core.entity(
        kind=F.when(constant, "Constant").otherwise(kind),
        signature=F.when(function, F.concat(F.lit("def "), name, params, typed)),
        doc_comment=F.when(function & (doc != ""), doc),
        visibility=visibility,
        is_async=function & F.col("source_text").startswith("async "),
    )

    statement = F.regexp_replace(F.regexp_replace("masked_text", r"[()\\]", " "), r"\s+", " ")
    plain = F.regexp_extract(statement, r"^import (.*?)\s*$", 1)
    origin = F.regexp_extract(statement, r"^from ([^.\s]\S*) import ", 1)
    names = F.regexp_extract(statement, r"^from \S+ import (.*?)\s*$", 1)
    targets = core.named(
        F.concat(F.array(origin), F.split(plain, ","), F.split(names, ",")), r"^\s*([\w.]+)(?:\s+as\s+\w+)?\s*$"
    )
    inside = F.regexp_extract("masked_head", r"(?s)^class\s+\w+\s*\((.*)\)\s*:", 1)
    bases = core.named(F.split(core.flat(inside), ","), rf"^\s*({_WORD}(?:\.{_WORD})*)\s*$")
    return core.facts(
        rows,
        core.only(~imported, F.array(found), core.ENTITIES),
        [
            core.only(~imported, F.array(core.contains()), core.EDGES),
            core.edges(imported, targets, lambda t: core.edge("IMPORTS", F.col("module_path"), t, line=F.col("line_start"))),
            core.edges(kind == "Class", bases, lambda b: core.edge("EXTENDS", qn, b)),
            core.edges(function, F.col("notes"), lambda d: core.edge("USES_TYPE", qn, d)),
            core.calls(function, CALL, KEYWORDS),
        ],
    )
