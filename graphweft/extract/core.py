"""Shared steps: masking, folding over pieces of a text, entity and edge rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphweft.functions.text import content_hash, qualified
from graphweft.schema import ENTITY_SCHEMA, RELATIONSHIP_SCHEMA

# What a scan finds: a declaration with character offsets into its file.
# ``body`` is the offset of the opening brace or -1, ``stop`` is one past the
# end, ``lead`` is where the text before the declaration starts.
DECLARATION = (
    "struct<kind:string,name:string,parent:string,pos:int,body:int,stop:int,"
    "line_start:int,line_end:int,lead:int,notes:array<string>>"
)


# How a statement goes on behind its block, per kind: the semicolon is its own.
TAILS = {kind: "^;" for kind in ("Constant", "Static", "Variable", "TypeAlias", "Import")}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once inside an expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def empty(element_type: str) -> Column:
    return F.expr(f"CAST(array() AS array<{element_type}>)")


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def fold(
    events: Column, state: Column, step: Callable[[Column, Column], Column], out_type: str, chunk: int = 256
) -> Column:
    """Run ``step(state, event) -> struct<s, out>`` over an array, in order.

    Returns ``struct<s, out>`` with the last state and all emitted elements.
    Elements gather per chunk and the chunks are joined once, so the cost stays
    close to linear in the length of the array.
    """

    def advance(acc: Column, event: Column) -> Column:
        grown = lambda out: F.when(F.size(out) > 0, F.concat(acc["out"], out)).otherwise(acc["out"])
        return let(step(acc["s"], event), lambda r: F.struct(r["s"].alias("s"), grown(r["out"]).alias("out")))

    def run_chunk(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(acc["s"].alias("s"), empty(out_type).alias("out")), advance)
        return let(inner, lambda r: F.struct(r["s"].alias("s"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    def parts(all_events: Column) -> Column:
        count = F.greatest(F.lit(1), F.ceil(F.size(all_events) / F.lit(chunk)).cast("int"))
        return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(all_events, i * chunk + 1, F.lit(chunk)))

    return F.aggregate(
        let(events, parts),
        F.struct(state.alias("s"), empty(f"array<{out_type}>").alias("out")),
        run_chunk,
        lambda acc: F.struct(acc["s"].alias("s"), F.flatten(acc["out"]).alias("out")),
    )


def mask(text: Column, hidden: str, kept: str) -> Column:
    """Blank every stretch that matches ``hidden`` (comments, strings), leaving
    newlines and all offsets in place. ``kept`` matches a run of plain text that
    starts none of them; any other single character is kept as it is."""
    tokens = F.regexp_extract_all(text, F.lit(f"(?s){hidden}|{kept}|."), F.lit(0))
    blank = F.transform(
        tokens, lambda t: F.when(t.rlike(f"(?s)^(?:{hidden})$"), F.regexp_replace(t, r"[^\n]", " ")).otherwise(t)
    )
    return F.array_join(blank, "")


#: A block comment that opens another before it ends.
NESTS = r"(?s)/\*(?:[^*/]|\*(?!/)|/(?!\*))*+/\*"
_LEXED = r"""(?s)\br#*+"|"#*+|'(?:\\[^'\n*/]*+|[^'\\\n])'|[^\\/*"'r\n]++|."""


def mask_nested(text: Column) -> Column:
    """The same for a language whose block comments nest: a finite-state lexer
    with a counter, as a fold over delimiters. Modes: 0 code, 1 line comment,
    2 string, 3 raw string, which ends at a quote with as many ``#`` as ``n``,
    4 block comment ``n`` deep. ``last`` is the token before where it may be half
    of a delimiter; in code such a slash is only written with the next token."""
    tokens = F.concat(F.regexp_extract_all(text, F.lit(_LEXED), F.lit(0)), F.array(F.lit("\n")))
    state = lambda mode, n, last: F.struct(*(F.lit(v).alias(c) if isinstance(v, (int, str)) else v.alias(c) for c, v in (("mode", mode), ("n", n), ("last", last))))

    def step(s: Column, t: Column) -> Column:
        mode, n, last = s["mode"], s["n"], s["last"]
        marks = F.length(t) - F.length(F.replace(t, F.lit("#"), F.lit("")))
        quote, pending = F.startswith(t, F.lit('"')), (mode == 0) & (last == "/")
        depth = n + F.when((last == "/") & (t == "*"), 1).when((last == "*") & (t == "/"), -1).otherwise(0)
        half = F.when(depth == n, F.when(t.isin("/", "*"), t).otherwise("")).otherwise("")
        after = (
            F.when(pending & (t == "*"), state(4, 1, ""))
            .when(pending & (t == "/"), state(1, 0, ""))
            .when((mode == 0) & t.rlike('^r#*"$'), state(3, marks, ""))
            .when((mode == 0) & quote, state(2, 0, ""))
            .when(mode == 0, state(0, 0, F.when(t == "/", t).otherwise("")))
            .when((mode == 1) & (t == "\n"), state(0, 0, ""))
            .when((mode == 2) & quote & (last != "\\"), state(0, 0, ""))
            .when(mode == 2, state(2, 0, F.when((t == "\\") & (last != "\\"), t).otherwise("")))
            .when((mode == 3) & quote & (marks >= n), state(0, 0, ""))
            .when((mode == 4) & (depth == 0), state(0, 0, ""))
            .when(mode == 4, state(4, depth, half))
            .otherwise(state(mode, n, ""))
        )
        blank = F.regexp_replace(t, r"[^\n]", " ")
        hidden = (mode != 0) | quote | t.rlike("(?s)^(?:r#*\"|'.+')$")
        out = F.when(pending & t.isin("*", "/"), "  ").otherwise(
            F.concat(F.when(pending, "/").otherwise(""), F.when(hidden, blank).when(t == "/", "").otherwise(t))
        )
        return F.struct(after.alias("s"), F.array(out).alias("out"))

    whole = F.array_join(fold(tokens, state(0, 0, ""), step, "string")["out"], "")
    return F.substring(whole, F.lit(1), F.length(whole) - 1)


def squeezed(text: Column) -> Column:
    """The text with long runs of blanks, as hidden comments leave them, as one
    blank: patterns that try every length of a run would be quadratic in it."""
    return F.when(F.length(text) >= 64, F.regexp_replace(text, r"\s{64,}+", " ")).otherwise(text)


def cut(text: Column, start: Column, stop: Column) -> Column:
    return F.substring(text, start + 1, stop - start)


def flat(text: Column) -> Column:
    """The text with what stands inside brackets blanked; the brackets, all line
    breaks and all offsets stay."""
    tokens = F.regexp_extract_all(text, F.lit(r"(?s)[(){}\[\]]|[^(){}\[\]]+"), F.lit(0))

    def step(before: Column, token: Column) -> Column:
        opens = token.isin("(", "{", "[")
        closes = token.isin(")", "}", "]")
        depth = before + F.when(opens, 1).when(closes, -1).otherwise(0)
        shown = ((before == 0) & ~closes) | (closes & (depth <= 0))
        out = F.when(shown, token).otherwise(F.regexp_replace(token, r"[^\n]", " "))
        return F.struct(F.greatest(depth, F.lit(0)).alias("s"), F.array(out).alias("out"))

    return F.array_join(fold(tokens, F.lit(0), step, "string")["out"], "")


def list_start(text: str) -> Column:
    """How many characters stand before the first parenthesis of a column."""
    return F.length(F.regexp_extract(text, r"^[^(]*+", 0))


def list_end(text: str) -> Column:
    """How many characters a column has up to the end of its first list in
    parentheses, however deep; 0 if there is none or it does not end."""
    tokens = F.regexp_extract_all(text, F.lit(r"[()]|[^()]++"), F.lit(0))

    def step(acc: Column, token: Column) -> Column:
        at = acc["at"] + F.length(token)
        ends = (token == ")") & (acc["d"] == 1) & (acc["end"] == 0)
        depth = acc["d"] + F.when(token == "(", 1).when(token == ")", -1).otherwise(0)
        return F.struct(
            F.greatest(depth, F.lit(0)).alias("d"), at.alias("at"), F.when(ends, at).otherwise(acc["end"]).alias("end")
        )

    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("at"), F.lit(0).alias("end"))
    return F.aggregate(tokens, start, step, lambda acc: acc["end"])


def declarations(
    files: DataFrame, found: Column, masked: Column | None = None, tails: dict[str, str] | None = None
) -> DataFrame:
    """One row per declaration of a file with its own slices of the text:
    ``source_text``, ``masked_text`` and ``lead_text``. The slices are taken
    inside the array, so that the file's text is not copied to every row."""
    scanned = files.select("path", "source", *([masked.alias("masked")] if masked is not None else [F.col("source").alias("masked")]))
    scanned = scanned.withColumn("found", found)

    def with_text(found: Column) -> Column:
        ends_in_block = found["body"] >= 0
        rest = F.substring(F.col("masked"), found["stop"] + 1, F.length("masked"))
        tail = F.lit(0)
        for kind, pattern in {**TAILS, **(tails or {})}.items():
            tail = F.when(ends_in_block & (found["kind"] == kind), F.length(F.regexp_extract(rest, pattern, 0))).otherwise(tail)
        return let(found.withField("stop", found["stop"] + tail), slices)

    def slices(d: Column) -> Column:
        return F.struct(
            d["kind"].alias("kind"),
            d["name"].alias("name"),
            d["parent"].alias("module_path"),
            d["line_start"].alias("line_start"),
            d["line_end"].alias("line_end"),
            d["notes"].alias("notes"),
            F.regexp_replace(cut(F.col("source"), d["pos"], d["stop"]), r"\s+$", "").alias("source_text"),
            cut(F.col("masked"), d["pos"], d["stop"]).alias("masked_text"),
            cut(F.col("source"), d["lead"], d["pos"]).alias("lead_text"),
            F.when(d["body"] >= 0, d["body"] - d["pos"]).alias("body_at"),
        )

    rows = scanned.select("path", F.inline(F.transform("found", with_text)))
    return rows.select(
        F.col("path").alias("file_path"), "*", qualified(F.col("module_path"), F.col("name")).alias("qualified_name")
    ).drop("path")


def with_body(rows: DataFrame) -> DataFrame:
    """Add ``head`` (masked text before the block), ``body`` (the block without
    its braces) and the line the body starts on; null without a block."""
    at = F.col("body_at")
    head = F.substring(F.col("masked_text"), F.lit(1), at)
    return rows.select(
        "*",
        head.alias("head"),
        F.substring(F.col("masked_text"), at + 2, F.length("masked_text") - at - 2).alias("body"),
        (F.col("line_start") + newlines(head)).alias("body_line"),
    )


def _struct(schema: T.StructType, values: dict[str, Column | None]) -> Column:
    fields = [values.get(f.name, None) for f in schema.fields]
    return F.struct(
        *[(F.lit(None) if v is None else v).cast(f.dataType).alias(f.name) for f, v in zip(schema.fields, fields)]
    )


def entity(**values: Column) -> Column:
    """An entity as a struct. Fields that are not given come from the
    declaration row the expression stands on."""
    row = {c: F.col(c) for c in ("qualified_name", "name", "kind", "file_path", "module_path", "line_start", "line_end", "source_text")}
    text = values.get("source_text", row["source_text"])
    fixed = {"visibility": F.lit("pub"), "is_async": F.lit(False), "source_hash": content_hash(text)}
    return _struct(ENTITY_SCHEMA, {**row, **fixed, **values})


def edge(rel_type: str, from_qn: Column, to_qn: Column, **values: Column) -> Column:
    return _struct(RELATIONSHIP_SCHEMA, {"from_qn": from_qn, "to_qn": to_qn, "rel_type": F.lit(rel_type), **values})


ENTITIES = ENTITY_SCHEMA.simpleString()
EDGES = RELATIONSHIP_SCHEMA.simpleString()


def contains() -> Column:
    return edge("CONTAINS", F.col("module_path"), F.col("qualified_name"))


def only(condition: Column, array: Column, element_type: str) -> Column:
    """The array where the condition holds, else an empty one."""
    return F.when(condition, array).otherwise(empty(element_type))


def edges(condition: Column, values: Column, make: Callable[[Column], Column]) -> Column:
    """One edge per element of an array, on rows that meet the condition."""
    return only(condition, F.transform(values, make), EDGES)


def named(parts: Column, pattern: str, group: int = 1) -> Column:
    """What ``pattern`` finds in each text of an array, where it finds something."""
    return F.filter(F.transform(parts, lambda p: F.regexp_extract(p, pattern, group)), lambda n: n != "")


def calls(condition: Column, pattern: str, keywords: tuple[str, ...], body: str = "body", line: str = "body_line") -> Column:
    """CALLS edges of the call sites in a body, one per site. Group 1 of
    ``pattern`` is the callee."""

    def sites(text: Column, offset: Column) -> Column:
        names = F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda n: (n != "") & ~n.isin(*keywords))
        return F.transform(names, lambda n: edge("CALLS", F.col("qualified_name"), n, line=F.col(line) + offset))

    return only(condition, F.flatten(F.transform(F.split(body, "\n"), sites)), EDGES)


def facts(rows: DataFrame, entities: Column, relationships: list[Column]) -> DataFrame:
    """What a declaration row contributes: (path, entities, edges), the last two arrays."""
    return rows.select(F.col("file_path").alias("path"), entities.alias("entities"), F.concat(*relationships).alias("edges"))
