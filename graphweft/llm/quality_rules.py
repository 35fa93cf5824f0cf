"""Rule-based quality filter as a short-circuit cascade, in built-in functions only.

A text is kept when it fails no rule, so the order of the rules changes only the
cost. Each rule's cost and the share it rejects are measured on a sample of at
most ``SAMPLE`` texts; rules are then tried by rejections per cost, the cheap
and selective ones first, inside one CASE expression that stops at the first
that fails. The verdict is the same in any order. A text is one row throughout;
nothing is shuffled.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft.llm.words import SPACE_CLASS, WORD_CLASS
from graphweft.session import Scratch

#: Texts that costs and selectivities are measured on, at most.
SAMPLE = 500
#: Times each is tried, so that the cost stands out of the overhead of a job.
TRIES = 20
#: Words of a window whose repetition counts.
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Column  # over text, words, lines and the base columns


def _rules() -> list[Rule]:
    lines = F.size(F.filter("lines", lambda x: x.rlike(WORD_CLASS)))
    starting = F.size(F.filter("lines", lambda x: x.rlike(r"^\s*[•‣\-*]\s")))
    ending = F.size(F.filter("lines", lambda x: x.rlike(r"(\.\.\.|…)\s*$")))
    return [
        Rule("symbols", F.col("n_symbols") * 10 > F.col("n_words")),
        Rule("word_length", (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words"))),
        Rule("repeated_lines", F.col("n_dup_lines") * 10 > lines * 3),
        Rule("bullets", starting * 10 > lines * 9),
        Rule("ellipses", ending * 10 > lines * 3),
        Rule("placeholder", F.lower("text").contains("lorem ipsum")),
    ]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, wherever the optimizer puts the whole."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(words: Column) -> Column:
    """Words inside windows that occur twice or more. Hashes of the windows are
    compared first; only a text with two equal hashes compares its windows as
    strings, sorted, so the count is exact and costs n log n."""
    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)
    at = lambda i: [F.get(words, i + j) for j in range(WINDOW)]
    hashes = F.transform(starts, lambda i: F.xxhash64(*at(i)))
    windows = F.array_sort(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", *at(i)).alias("g"), i.alias("p"))))

    def twice(s: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(s, i)["g"] == x["g"], F.lit(False))
        return F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["p"])

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    exact = _let(_let(windows, lambda s: F.sort_array(twice(s))), covered)
    doubled = _let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when((F.size(words) > WINDOW) & doubled, exact).otherwise(F.lit(0))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, text, words, lines and the base columns of each row of ``docs``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    words = F.array_remove(F.split("text", SPACE_CLASS), "")
    out = out.withColumns({"words": words, "lines": F.split("text", "\n")})
    solid = F.filter("lines", lambda x: x.rlike(WORD_CLASS))
    columns = {
        "n_words": F.size("words"),
        "word_chars": F.length(F.regexp_replace("text", SPACE_CLASS, "")),
        "n_symbols": F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")),
        "n_dup_lines": _let(solid, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": _let(F.col("words"), _repeated),
    }
    out = out.withColumns({name: c.cast("long") for name, c in columns.items()})
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return out.withColumn("base_failed", failed)


def ordered(sample: DataFrame, rules: list[Rule]) -> list[Rule]:
    """The rules by rejections per cost on a written sample, best first."""
    sample = sample.withColumn("try", F.explode(F.sequence(F.lit(1), F.lit(TRIES))))

    def measured(fails: Column) -> tuple[float, int]:
        start = time.perf_counter()
        n = sample.agg(F.count_if(fails & (F.col("try") > 0))).first()[0]
        return time.perf_counter() - start, n

    measured(F.lit(False))  # opens the files and compiles
    base, _ = measured(F.lit(False))
    cost = {r.name: measured(r.fails) for r in rules}
    return sorted(rules, key=lambda r: (-(cost[r.name][1] + 1) / max(cost[r.name][0] - base, 1e-3), r.name))


def judged(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id long, text string; others are
    ignored): doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept.

    kept is false for a text that fails the base or any rule of the cascade.
    Null and empty texts have no words and fail the base. Repeated rows and null
    ids stay as they are; no rows give no rows.
    """
    scratch = Scratch(docs.sparkSession)
    made = features(docs)
    sample = scratch.write(features(docs.limit(SAMPLE)), "sample").where("not base_failed")
    verdict = F.when(F.col("base_failed"), False)
    for rule in ordered(sample, _rules()):
        verdict = verdict.when(rule.fails, False)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return made.select(*columns, verdict.otherwise(True).alias("kept"))
