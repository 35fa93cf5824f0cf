"""Text expressions: hashes, names, bands and families."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphweft.schema import EDGE_FAMILY, KIND_FAMILY


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def line_count(text: Column) -> Column:
    """Number of lines; an empty text has none and one final newline adds none."""
    newlines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (
        F.when(F.length(text) == 0, 0)
        .when(text.endswith("\n"), newlines)
        .otherwise(newlines + 1)
        .cast("int")
    )


def embedding_text(kind: Column, name: Column, signature: Column, doc: Column, source: Column) -> Column:
    return F.concat_ws("\n", F.concat(kind, F.lit(": "), name), signature, doc, source)


def qualified(parent: Column, name: Column) -> Column:
    return F.concat(parent, F.lit("::"), name)


def qname_parts(qn: Column) -> tuple[Column, Column]:
    """(path up to and including the last ``::``, identifier after it)."""
    identifier = F.substring_index(qn, "::", -1)
    return F.left(qn, F.length(qn) - F.length(identifier)), identifier


def relevance_band(relevance: Column) -> Column:
    return (
        F.when(relevance >= 0.85, "strong")
        .when(relevance >= 0.70, "good")
        .when(relevance >= 0.50, "fair")
        .otherwise("weak")
    )


def _family(value: Column, families: dict[str, str]) -> Column:
    groups: dict[str, list[str]] = {}
    for member, family in families.items():
        groups.setdefault(family, []).append(member)
    (first, members), *rest = groups.items()
    chain = F.when(value.isin(members), first)
    for family, members in rest:
        chain = chain.when(value.isin(members), family)
    return chain.otherwise("other")


def kind_family(kind: Column) -> Column:
    return _family(kind, KIND_FAMILY)


def edge_family(rel_type: Column) -> Column:
    return _family(rel_type, EDGE_FAMILY)
