"""Scanning a tree of source files: listing, routing by extension, File entities."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.functions.text import content_hash, line_count
from graphweft.schema import DEFAULT_EXCLUDES, ENTITY_SCHEMA, conform, extensions_dimension
from graphweft.session import Scratch


def glob_regex(pattern: str) -> str:
    """A path glob as a regular expression over relative paths. A pattern with an
    inner slash starts at the root, any other may match at every depth; what it
    matches is excluded together with everything below."""
    body = pattern.strip("/")
    anchored = "/" in pattern.rstrip("/")
    out = []
    for part in re.findall(r"\*\*/|/\*\*$|\*|\?|\[[^\]]*\]|.", body):
        if part == "**/":
            out.append("(?:.*/)?")
        elif part == "/**":
            out.append("/.*")
        elif part == "*":
            out.append("[^/]*")
        elif part == "?":
            out.append("[^/]")
        elif part.startswith("[") and len(part) > 1:
            out.append(part.replace("[!", "[^"))
        else:
            out.append(re.escape(part))
    return ("^" if anchored else "^(?:.*/)?") + "".join(out) + "(?:/.*)?$"


def is_listed(path: Column, excludes: tuple[str, ...] | list[str]) -> Column:
    """Not hidden at any level and matched by no exclude glob."""
    listed = ~path.rlike(r"(^|/)\.")
    if excludes:
        listed = listed & ~path.rlike("|".join(f"(?:{glob_regex(p)})" for p in excludes))
    return listed


_LISTED = "path string, is_dir boolean, size long, modified long"


def _lister(root: str):
    """Lists directories given by their path below ``root``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, base = _opened(root)
        for batch in batches:
            for directory in batch["path"]:
                below = f"{base}/{directory}" if directory else base
                found = source.get_file_info(fs.FileSelector(below))
                if isinstance(source, fs.LocalFileSystem):  # links are not followed
                    found = [f for f in found if not os.path.islink(f.path)]
                found = [(f.path[len(base) :].lstrip("/"), f.type == fs.FileType.Directory, f.size or 0, f.mtime_ns or 0) for f in found]
                yield pd.DataFrame(found, columns=["path", "is_dir", "size", "modified"]).astype({"path": object, "is_dir": bool, "size": "int64", "modified": "int64"})

    return run


def list_tree(spark: SparkSession, root: str, excludes: tuple[str, ...] | list[str] = DEFAULT_EXCLUDES) -> DataFrame:
    """(path, size, modified) of every listed file below ``root``, one job per
    directory level; modified is in nanoseconds, 0 where the store has no times.

    Spark's own file sources pass over empty files and names that begin with an
    underscore, both of which count here, so directories are listed by tasks. An
    excluded directory is never entered.
    """
    scratch = Scratch(spark)
    level = spark.createDataFrame([("",)], "path string")
    files = []
    while True:
        found = level.mapInPandas(_lister(root), _LISTED).where(is_listed(F.col("path"), excludes))
        found, _, directories = scratch.write_counted(
            found.withColumn("dir", F.when(F.col("is_dir"), 1)), "listing", "dir"
        )
        files.append(found.where(~F.col("is_dir")).select("path", "size", "modified"))
        if not directories:
            return reduce(DataFrame.unionByName, files)
        # Few and small rows, each of them a directory to list.
        level = found.where("is_dir").select("path").repartition(spark.sparkContext.defaultParallelism)


def _reader(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, base = _opened(root)
        for batch in batches:
            for path in batch.column("path"):
                try:
                    with source.open_input_stream(f"{base}/{path}") as stream:
                        text = stream.read().decode("utf-8")
                except (OSError, UnicodeDecodeError):
                    continue
                yield pa.RecordBatch.from_pydict({"path": [path.as_py()], "source": [text]})

    return run


def read_tree(spark: SparkSession, root: str, excludes: tuple[str, ...] | list[str] = DEFAULT_EXCLUDES) -> DataFrame:
    """(path, source) of every listed file below ``root`` that can be read as
    UTF-8; other files are skipped. Paths are relative to the root. One file is
    held in a task at a time."""
    return read_files(list_tree(spark, root, excludes), root)


def read_files(paths: DataFrame, root: str) -> DataFrame:
    """(path, source) of the files at these paths below ``root``."""
    # The paths are few bytes each; spreading them spreads the reading.
    return paths.select("path").repartition("path").mapInArrow(_reader(root), "path string, source string")


def _opened(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a root and its path there. A root without a scheme is a
    local path; the Hadoop names of an object store go by its own."""
    if "://" not in root:
        root = os.path.abspath(root)
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", root))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_extension(path: Column) -> Column:
    """What follows the last dot of the file name; none for a leading dot."""
    return F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1)


def route(files: DataFrame, extensions: DataFrame | None = None) -> DataFrame:
    """Add ``language``; files of an unknown extension are dropped. The dimension
    has one row per known extension and is always broadcast."""
    known = extensions if extensions is not None else extensions_dimension(files.sparkSession)
    return (
        files.withColumn("ext", file_extension(F.col("path"))).join(F.broadcast(known), "ext").drop("ext")
    )


def file_entities(files: DataFrame) -> DataFrame:
    """One File entity per routed file. The text itself is not kept, only its hash."""
    return conform(
        files,
        ENTITY_SCHEMA,
        qualified_name=F.col("path"),
        name=file_name(F.col("path")),
        kind=F.lit("File"),
        file_path=F.col("path"),
        visibility=F.lit("pub"),
        line_start=F.lit(1),
        line_end=line_count(F.col("source")),
        source_text=F.lit(""),
        source_hash=content_hash(F.col("source")),
        is_async=F.lit(False),
    )
