"""HTML: significant elements, their nesting, and what they reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft.extract import core
from graphweft.functions.text import qualified

# ---- fixed values: elements that become entities; elements without content ----
SIGNIFICANT = tuple(
    "html head body main nav header footer section article aside form table script style link meta template".split()
)
VOID = tuple("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style")
# -----------------------------------------------------------------------------

_OPEN = "struct<tag:string,name:string,parent:string,qn:string,idx:int,line:int,ref:string>"
_ELEMENT = "struct<tag:string,name:string,parent:string,first:int,last:int,line_start:int,line_end:int,ref:string>"


def attribute(tag: Column, name: str) -> Column:
    """Value of the first attribute ``name`` of a start tag, quotes stripped;
    null when it has none."""
    pattern = rf"""(?s)^[^\s>/]+(?:\s+(?!{name}[\s=>])[^\s=>]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"']+))?)*\s+{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""
    value = F.regexp_extract(tag, pattern, 1)
    return F.when(value != "", F.regexp_replace(value, r"""^["']+|["']+$""", ""))


def _elements(source: Column, path: Column, significant: tuple[str, ...], reference_tags: tuple[str, ...]) -> Column:
    """Elements of a page as an array of ``_ELEMENT``.

    The page falls into pieces at every ``<``. A stack of open significant
    elements gives each its parent; other elements are seen through.
    """

    def event(piece: Column, index: Column) -> Column:
        opened = F.regexp_extract(piece, r"^([A-Za-z][\w:-]*)", 1)
        tag_text = F.regexp_extract(piece, r"""(?s)^(?:[^>"']++|"[^"]*+"|'[^']*+')*+""", 0)
        kept = opened.isin(*significant)
        target = F.coalesce(attribute(tag_text, "src"), F.when(opened != "script", attribute(tag_text, "href")))
        return F.struct(
            index.cast("int").alias("idx"),
            core.newlines(piece).alias("lines"),
            F.when(index > 0, opened).otherwise("").alias("open"),
            F.when(index > 0, F.regexp_extract(piece, r"^/([A-Za-z][\w:-]*)", 1)).otherwise("").alias("close"),
            ((index > 0) & piece.startswith("!--")).alias("comment"),
            F.contains(piece, F.lit("-->")).alias("uncomment"),
            (tag_text.endswith("/") | opened.isin(*VOID)).alias("void"),
            F.when(kept & ~opened.isin(*RAW), attribute(tag_text, "id")).alias("id"),
            F.when(opened.isin(*reference_tags), target).alias("ref"),
        )

    events = F.transform(F.split(source, "<"), event)

    def finished(block: Column, last: Column, line: Column) -> Column:
        return F.struct(
            block["tag"].alias("tag"),
            block["name"].alias("name"),
            block["parent"].alias("parent"),
            block["idx"].alias("first"),
            last.alias("last"),
            block["line"].alias("line_start"),
            line.alias("line_end"),
            block["ref"].alias("ref"),
        ).cast(_ELEMENT)

    def step(s: Column, e: Column) -> Column:
        quiet = s["mode"] != ""
        leaves = (s["mode"] == e["close"]) | ((s["mode"] == "!") & e["uncomment"])
        opens = ~quiet & e["open"].isin(*significant)
        closes = (~quiet | (s["mode"] == e["close"])) & e["close"].isin(*significant)
        parent = F.coalesce(F.try_element_at(s["stack"], F.lit(-1))["qn"], s["path"])
        name = F.concat(
            F.lit("<"),
            e["open"],
            F.when(e["id"].isNotNull(), F.concat(F.lit("#"), e["id"], F.lit(">"))).otherwise(
                F.concat(F.lit(">@L"), s["line"].cast("string"))
            ),
        )

        def apply(block: Column) -> Column:
            depth = F.array_position(F.reverse(F.transform(s["stack"], lambda b: b["tag"])), e["close"]).cast("int")
            kept = F.when(closes & (depth > 0), F.size(s["stack"]) - depth).otherwise(F.size(s["stack"]))
            ended = F.transform(
                F.reverse(F.slice(s["stack"], kept + 1, F.size(s["stack"]))), lambda b: finished(b, e["idx"], s["line"])
            )
            # Nothing is popped by an opening tag, and nothing opens on a close.
            stack = F.when(opens & ~e["void"], F.array_append(s["stack"], block)).otherwise(F.slice(s["stack"], F.lit(1), kept))
            mode = (
                F.when(quiet & ~leaves, s["mode"])
                .when(~quiet & e["comment"] & ~e["uncomment"], "!")
                .when(~quiet & e["open"].isin(*RAW) & ~e["void"], e["open"])
                .otherwise("")
            )
            state = F.struct(
                (s["line"] + e["lines"]).cast("int").alias("line"), mode.alias("mode"), stack.alias("stack"), s["path"].alias("path")
            )
            alone = F.when(opens & e["void"], F.array(finished(block, e["idx"], s["line"]))).otherwise(core.empty(_ELEMENT))
            return F.struct(state.alias("s"), F.concat(alone, ended).alias("out"))

        block = F.struct(
            e["open"].alias("tag"),
            name.alias("name"),
            parent.alias("parent"),
            qualified(parent, name).alias("qn"),
            e["idx"].alias("idx"),
            s["line"].alias("line"),
            e["ref"].alias("ref"),
        ).cast(_OPEN)
        return core.let(block, apply)

    state = F.struct(F.lit(1).alias("line"), F.lit("").alias("mode"), core.empty(_OPEN).alias("stack"), path.alias("path"))
    done = core.fold(events, state, step, _ELEMENT)
    return core.let(
        done,
        lambda r: F.concat(r["out"], F.transform(F.reverse(r["s"]["stack"]), lambda b: finished(b, F.size(events) - 1, r["s"]["line"]))),
    )


def elements(
    files: DataFrame, significant: tuple[str, ...] = SIGNIFICANT, reference_tags: tuple[str, ...] = ("script", "link")
) -> DataFrame:
    """One row per significant element, with the target it references."""
    scanned = files.select("path", F.split("source", "<").alias("pieces"), _elements(F.col("source"), F.col("path"), significant, reference_tags).alias("found"))

    def with_text(d: Column) -> Column:
        whole = F.concat(F.lit("<"), F.array_join(F.slice("pieces", d["first"] + 1, d["last"] - d["first"] + 1), "<"))
        # The last piece is a tag followed by text outside the element; a page
        # that ends inside the element has no such tag.
        tail = F.element_at(F.col("pieces"), d["last"] + 1)
        outside = F.when(F.contains(tail, F.lit(">")), F.length(tail) - F.instr(tail, ">")).otherwise(0)
        ends = (d["last"] == d["first"]) | tail.startswith("/")
        return F.struct(
            F.col("path").alias("file_path"),
            d["parent"].alias("module_path"),
            d["name"].alias("name"),
            d["tag"].alias("tag"),
            d["ref"].alias("ref"),
            d["line_start"].alias("line_start"),
            d["line_end"].alias("line_end"),
            F.when(ends, F.left(whole, F.length(whole) - outside)).otherwise(whole).alias("source_text"),
        )

    rows = scanned.select(F.inline(F.transform("found", with_text)))
    return rows.withColumn("kind", F.lit("HtmlElement")).withColumn("qualified_name", qualified(F.col("module_path"), F.col("name")))


def _reference() -> Column:
    return core.edge("IMPORTS", F.col("qualified_name"), F.col("ref"), line=F.col("line_start"))


def references(rows: DataFrame) -> DataFrame:
    """IMPORTS edges of the elements that reference something."""
    return rows.where("ref IS NOT NULL").select(_reference().alias("e")).select("e.*")


def facts(files: DataFrame) -> DataFrame:
    referenced = core.only(F.col("ref").isNotNull(), F.array(_reference()), core.EDGES)
    return core.facts(elements(files), F.array(core.entity()), [F.array(core.contains()), referenced])
