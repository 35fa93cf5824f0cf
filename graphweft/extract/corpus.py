"""Extraction over a corpus of mixed languages."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.extract import cfamily, core, css, html, python, rust, script
from graphweft.operators.assembly import merge_entities
from graphweft.session import Scratch, rows_within
from graphweft.sources.files import file_entities, route

#: Files that one job may leave out.
MOST_FAILED = 100

# Which languages an extractor reads. An extractor turns (path, source) rows
# into rows of (entities, edges).
EXTRACTORS = {
    ("rust",): rust.facts,
    ("c",): partial(cfamily.facts, cpp=False),
    ("cpp",): partial(cfamily.facts, cpp=True),
    ("python",): python.facts,
    ("javascript", "typescript", "tsx"): script.facts,
    ("html",): html.facts,
    ("css",): css.facts,
}


def facts(
    files: DataFrame,
    languages: tuple[str, ...] | None = None,
    read: Callable[[DataFrame], DataFrame] = lambda files: files,
) -> DataFrame:
    """(path, entities, edges) rows of all routed files, File entities included.

    ``read`` adds the column source to paths. Paths are routed first, so a file is
    only opened for its own language and for its File entity.
    """
    routed = route(files)
    whole = file_entities(read(routed))
    parts = [
        whole.select(F.col("file_path").alias("path"), F.array(F.struct(*whole.columns).cast(core.ENTITIES)).alias("entities"), core.empty(core.EDGES).alias("edges"))
    ]
    for names, extractor in EXTRACTORS.items():
        if languages is None or set(names) & set(languages):
            parts.append(extractor(read(routed.where(F.col("language").isin(*names)))))
    return reduce(DataFrame.unionByName, parts)


def languages_of(files: DataFrame) -> tuple[str, ...]:
    """The languages that the paths of files have: extractors of others can be left out of the plan."""
    return tuple(sorted(r[0] for r in route(files.select("path")).select("language").distinct().collect()))


def extract(
    files: DataFrame,
    languages: tuple[str, ...] | None = None,
    with_text: bool = True,
    read: Callable[[DataFrame], DataFrame] = lambda files: files,
) -> tuple[DataFrame, DataFrame]:
    """(entities, relationships) of all routed files of (path, source); the
    relationships carry the path of their file.

    Each file is scanned once: what it holds is written to the scratch folder,
    and both tables are read from there. Entities with one qualified name
    collapse to the last in the file; the relationships are a bag. ``languages``
    limits the extractors that run. ``files`` may hold paths only if ``read`` adds
    their source. Without ``with_text`` the entities' texts end
    with the scan, so that only narrow rows are merged.
    """
    return _tables(Scratch(files.sparkSession).write(facts(files, languages, read), "facts"), with_text)


def extract_or_list(
    files: DataFrame, with_text: bool = True, read: Callable[[DataFrame], DataFrame] = lambda files: files
) -> tuple[DataFrame, DataFrame, list[tuple[str, str]]]:
    """The same, but files that make extraction fail are left out and listed as
    (path, error). Where an attempt fails, its files are dealt into halves by a
    hash and tried again, until a bad one is alone: one bad file among n costs
    at most as much as extracting all of them once more, in about log n attempts.
    More than ``MOST_FAILED`` bad files are taken for another fault, which is raised."""
    scratch = Scratch(files.sparkSession)
    languages = languages_of(files)
    parts, failed, todo = [], [], [(files, 0)]
    while todo:
        some, depth = todo.pop()
        try:
            parts.append(scratch.write(facts(some, languages, read), "facts"))
        except (PySparkException, Py4JJavaError) as e:
            alone = rows_within(some.select("path"), 1)
            if alone is not None and not alone:
                raise
            if alone is not None:
                failed.append((alone[0]["path"], str(e)[:1000]))
            elif depth > 64:
                raise  # rows of one path
            else:
                half = F.pmod(F.xxhash64("path", F.lit(depth)), F.lit(2))
                todo += [(some.where(half == side), depth + 1) for side in (0, 1)]
            if len(failed) > MOST_FAILED:
                raise
    if not parts:
        parts = [scratch.write(facts(files.limit(0), languages, read), "facts")]
    return *_tables(reduce(DataFrame.unionByName, parts), with_text), failed


def _tables(found: DataFrame, with_text: bool) -> tuple[DataFrame, DataFrame]:
    entities = found.select(F.inline("entities"))
    return merge_entities([entities if with_text else entities.drop("source_text")]), found.select("path", F.inline("edges"))
