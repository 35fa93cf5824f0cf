"""Scope scan for languages whose blocks are braces."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphweft.extract.core import DECLARATION, empty, fold, let, newlines, squeezed
from graphweft.functions.text import qualified


@dataclass(frozen=True)
class Rule:
    """A kind of declaration. Group 1 of ``pattern`` is the name. ``inside`` are
    the scopes it counts in, ``scope`` is what its block is for what stands in
    it, ``block`` and ``bare`` say whether it may end in a block or without one."""

    kind: str
    pattern: str
    inside: tuple[str, ...] = ("items",)
    scope: str = "opaque"
    block: bool = True
    bare: bool = False
    # Pattern whose group 1 names the parent of what stands inside, if that is
    # not the declaration itself.
    base: str | None = None
    # How the name is written; ``{line}`` is the line the declaration starts on.
    name: str = "{name}"


def _written(option: Column, line: Column) -> Column:
    """The name as its rule writes it."""
    with_name = F.replace(option["written"], F.lit("{name}"), option["name"])
    return F.when(option["written"] == "", option["name"]).otherwise(F.replace(with_name, F.lit("{line}"), line.cast("string")))


def _classify(head: Column, rules: list[Rule]) -> Column:
    """The first rule that gives a name, as a struct; null if none does. Rules
    behind it are not tried."""

    def option(rule: Rule) -> Column:
        name = F.regexp_extract(head, rule.pattern, 1)
        found = F.struct(
            F.lit(rule.kind).alias("kind"),
            name.alias("name"),
            F.lit(rule.scope).alias("scope"),
            F.lit(rule.name if rule.name != "{name}" else "").alias("written"),
            (F.regexp_extract(head, rule.base, 1) if rule.base else F.lit(None).cast("string")).alias("base"),
        )
        return F.when(name != "", found)

    none = F.lit(None).cast("struct<kind:string,name:string,scope:string,written:string,base:string>")
    return F.when(head != "", F.coalesce(*[option(r) for r in rules], none))


def scan(
    masked: Column, path: Column, rules: list[Rule], lead: str, boundary: str = "(?<=[{};])", transparent: str = "$^"
) -> Column:
    """Declarations of a masked text, as an array.

    The text falls into pieces that end after a brace or a statement end. A
    stack of open blocks gives every piece its scope. ``lead`` matches what may
    stand before a declaration, ``transparent`` the heads of blocks that leave
    the scope as it is.
    """

    def event(piece: Column) -> Column:
        last = F.right(piece, F.lit(1))
        ends = F.when(last.isin("{", "}", ";", "\n"), last).otherwise("")
        return let(F.struct(F.regexp_extract(piece, lead, 0).alias("before"), ends.alias("delim")), lambda p: parted(piece, p["before"], p["delim"]))

    def parted(piece: Column, before: Column, delim: Column) -> Column:
        inner = F.substring(piece, F.length(before) + 1, F.length(piece) - F.length(before) - F.length(delim))
        # A lead that swallows the delimiter leaves no head.
        head = F.when(F.length(before) + F.length(delim) <= F.length(piece), inner).otherwise("")
        return let(
            head,
            lambda h: F.struct(
                F.length(piece).alias("size"),
                newlines(piece).alias("lines"),
                delim.alias("delim"),
                F.length(before).alias("lead"),
                newlines(before).alias("lead_lines"),
                squeezed(h).alias("head"),
            ),
        )

    events = F.transform(F.split(masked, boundary), event)
    block = "struct<scope:string,kind:string,name:string,parent:string,base:string,pos:int,body:int,line:int,lead:int>"
    root = F.struct(
        F.lit("items").alias("scope"),
        F.lit("").alias("kind"),
        F.lit("").alias("name"),
        path.alias("parent"),
        path.alias("base"),
        F.lit(0).alias("pos"),
        F.lit(0).alias("body"),
        F.lit(1).alias("line"),
        F.lit(0).alias("lead"),
    ).cast(block)

    def step(s: Column, e: Column) -> Column:
        def decide(top: Column) -> Column:
            # Only the rules of the scope that may end so are tried, and none inside a body.
            fits = F.lit(None)
            for scope in sorted({name for rule in rules for name in rule.inside}):
                here = [rule for rule in rules if scope in rule.inside]
                block, bare = (_classify(e["head"], [r for r in here if wanted(r)]) for wanted in (lambda r: r.block, lambda r: r.bare))
                fits = F.when(top["scope"] == scope, F.when(e["delim"] == "{", block).otherwise(bare)).otherwise(fits)
            line = s["line"] + e["lead_lines"]
            return let(fits, lambda d: let(d.withField("name", _written(d, line)), lambda named: apply(top, named)))

        def apply(top: Column, d: Column) -> Column:
            start, first_line = s["pos"] + e["lead"], s["line"] + e["lead_lines"]
            after, after_line = s["pos"] + e["size"], s["line"] + e["lines"]
            opens, closes = e["delim"] == "{", e["delim"] == "}"
            named = d.isNotNull()
            starts = named
            pushed = F.struct(
                F.when(starts, d["scope"]).when((top["scope"] != "opaque") & e["head"].rlike(transparent), top["scope"]).otherwise("opaque").alias("scope"),
                F.when(starts, d["kind"]).otherwise("").alias("kind"),
                F.when(starts, d["name"]).otherwise("").alias("name"),
                top["base"].alias("parent"),
                F.when(starts, qualified(top["base"], F.coalesce(d["base"], d["name"]))).otherwise(top["base"]).alias("base"),
                start.alias("pos"),
                (after - 1).alias("body"),
                first_line.alias("line"),
                s["pos"].alias("lead"),
            ).cast(block)
            bare = F.struct(
                d["kind"].alias("kind"),
                d["name"].alias("name"),
                top["base"].alias("parent"),
                start.alias("pos"),
                F.lit(-1).alias("body"),
                (after - F.when(closes, 1).otherwise(0)).alias("stop"),
                first_line.alias("line_start"),
                (after_line - F.when(e["delim"] == "\n", 1).otherwise(0)).alias("line_end"),
                s["pos"].alias("lead"),
                empty("string").alias("notes"),
            ).cast(DECLARATION)
            closed = F.struct(
                top["kind"].alias("kind"),
                top["name"].alias("name"),
                top["parent"].alias("parent"),
                top["pos"].alias("pos"),
                top["body"].alias("body"),
                after.alias("stop"),
                top["line"].alias("line_start"),
                after_line.alias("line_end"),
                top["lead"].alias("lead"),
                empty("string").alias("notes"),
            ).cast(DECLARATION)
            none = empty(DECLARATION)
            stack = (
                F.when(opens, F.array_append(s["stack"], pushed))
                .when(closes & (F.size(s["stack"]) > 1), F.slice(s["stack"], F.lit(1), F.size(s["stack"]) - 1))
                .otherwise(s["stack"])
            )
            ended = closes & (top["kind"] != "")
            out = (
                F.when(named & ~opens & ended, F.array(bare, closed))
                .when(named & ~opens, F.array(bare))
                .when(ended, F.array(closed))
                .otherwise(none)
            )
            state = F.struct(after.cast("int").alias("pos"), after_line.cast("int").alias("line"), stack.alias("stack"))
            return F.struct(state.alias("s"), out.alias("out"))

        return let(F.element_at(s["stack"], -1), decide)

    state = F.struct(F.lit(0).alias("pos"), F.lit(1).alias("line"), F.array(root).alias("stack"))
    return fold(events, state, step, DECLARATION)["out"]
