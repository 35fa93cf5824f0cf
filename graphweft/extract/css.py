"""CSS: rules and their selectors, media and keyframes blocks, imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft.extract import core
from graphweft.extract.braces import Rule, scan
from graphweft.functions.text import qualified

HIDDEN = r"/\*.*?\*/"
KEPT = r"[^/]++"
LEAD = r"^\s*"
RULES = [
    Rule("Import", r"(?s)^(@import)\s", block=False, bare=True),
    Rule("Media", r"(?s)^(@media)\b", scope="items", name="{name}@L{line}"),
    Rule("Keyframes", r"(?s)^@(?:-\w+-)?keyframes\s+([\w-]+)", name="@keyframes {name}"),
    Rule("CssRule", r"(?s)^([^@\s].*?)\s*$"),
]


def declarations(files: DataFrame) -> DataFrame:
    """Rule sets, media and keyframes blocks and imports, one row each. Media
    blocks are named by their line, which names what stands in them."""
    masked = core.mask(F.col("source"), HIDDEN, KEPT)
    # Blocks of other at-rules are seen through.
    found = scan(F.col("masked"), F.col("path"), RULES, LEAD, transparent=r"^@(?!import|media|(?:-\w+-)?keyframes)")
    return core.declarations(files, found, masked)


def facts(files: DataFrame) -> DataFrame:
    rows = declarations(files)
    kind, name, qn = F.col("kind"), F.col("name"), F.col("qualified_name")
    imported = kind == "Import"
    parts = F.split(name, r",(?![^(\[]*[)\]])")

    def selector(part: Column, i: Column) -> Column:
        text = F.regexp_replace(part, r"^\s+|\s+$", "")
        # Lines before the selector inside the rule.
        before = core.newlines(F.array_join(F.slice(parts, F.lit(1), i), ",")) + core.newlines(F.regexp_extract(part, r"^\s*", 0))
        first = F.col("line_start") + before
        return core.entity(
            kind=F.lit("CssSelector"),
            name=text,
            module_path=qn,
            qualified_name=qualified(qn, text),
            source_text=text,
            line_start=first,
            line_end=first + core.newlines(text),
        )

    listed = F.filter(F.transform(parts, selector), lambda e: (e["name"] != "") & (e["name"] != name))
    selectors = core.only(kind == "CssRule", listed, core.ENTITIES)
    target = F.regexp_extract("source_text", r"""(?s)^@import\s+(url\([^)]*\)|"[^"]*"|'[^']*')""", 1)
    bare = F.regexp_replace(F.regexp_replace(target, r"^url\((.*)\)$", "$1"), r"""^["' ]+|["' ]+$""", "")
    import_edge = core.edge("IMPORTS", F.col("module_path"), bare, line=F.col("line_start"))
    rows = rows.withColumn("selectors", selectors)
    return core.facts(
        rows,
        core.only(~imported, F.concat(F.array(core.entity(kind=F.lit("CssRule"))), F.col("selectors")), core.ENTITIES),
        [
            core.only(~imported, F.array(core.contains()), core.EDGES),
            core.edges(F.lit(True), F.col("selectors"), lambda e: core.edge("CONTAINS", e["module_path"], e["qualified_name"])),
            core.only(imported & (bare != ""), F.array(import_edge), core.EDGES),
        ],
    )
