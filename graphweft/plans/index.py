"""Indexing: from a tree of source files to the next version of a stored graph."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.extract import extract
from graphweft.extract.corpus import extract_or_list, languages_of
from graphweft.operators.assembly import source_hashes
from graphweft.operators.embed import embed_entities
from graphweft.operators.upsert import duplicate_keys
from graphweft.schema import DEFAULT_DIMENSION, DEFAULT_EXCLUDES, KnowledgeGraph
from graphweft.session import Scratch
from graphweft.sources.files import list_tree, read_files, route
from graphweft.sources.store import GraphStore

Read = Callable[[DataFrame], DataFrame]


def index_files(
    store: GraphStore, files: DataFrame, provider: str | None = None, dimension: int = DEFAULT_DIMENSION, read: Read = lambda files: files
) -> KnowledgeGraph:
    """Extract (path, source) files, embed their entities when a provider is
    named, upsert both tables and drop what no file holds any more. ``files`` are
    all there are; they may hold paths only if ``read`` adds their source."""
    # Texts are only read for embeddings; the stored graph has none.
    entities, relationships = extract(files, languages_of(files), with_text=provider is not None, read=read)
    if provider is not None:
        entities = embed_entities(entities, provider, dimension)
    return store.apply(entities, relationships.drop("path"), source_hashes(entities))


def index_changes(
    store: GraphStore, listing: DataFrame, read: Read, provider: str | None = None, dimension: int = DEFAULT_DIMENSION
) -> KnowledgeGraph:
    """The same for a tree of which much is indexed already: ``listing`` (path,
    size, modified) is compared with the files of the stored version, and only
    new and changed ones are read, extracted and embedded. The tables become
    those that ``index_files`` over all files would give: an entity goes if no
    file holds its text any more, and edges of files that are not read again
    are taken from their stored facts where a changed file brings their target.
    A file with the size and time it had is taken to be unchanged. A file that makes
    extraction fail is left out, as one that cannot be read, and listed in
    ``store.failed()`` until it changes."""
    scratch = Scratch(store.spark)
    listing = scratch.write(route(listing).select("path", "size", "modified"), "listing")
    known = store.files()
    changed = scratch.write(listing.join(known, ["path", "size", "modified"], "left_anti"), "changed")
    gone = known.join(listing, "path", "left_anti").select("path")
    scope, files_touched, _ = scratch.write_counted(changed.select("path").unionByName(gone), "scope")
    if not files_touched:
        return store.load()
    entities, relationships, bad = extract_or_list(changed.select("path"), with_text=provider is not None, read=read)
    failed = store.spark.createDataFrame(bad, "path string, error string")
    entities = entities if provider is None else embed_entities(entities, provider, dimension)
    entities = scratch.write(entities.drop("source_text"), "entities")

    # hashes that any file holds: of those read now, and of what the others stored
    rest = store.load().entities.join(scope.select(F.col("path").alias("file_path")), "file_path", "left_anti")
    hashes = source_hashes(entities).unionByName(source_hashes(rest)).distinct()
    own = entities.where("kind = 'File'").select(F.col("qualified_name").alias("path"), "source_hash")
    files = changed.join(own, "path", "left").select("path", "size", "modified", "source_hash")
    return store.apply(entities, relationships.drop("path"), hashes, scope, files=files, facts=relationships, failed=failed)


def index_tree(
    spark: SparkSession,
    root: str,
    store_root: str,
    provider: str | None = None,
    dimension: int = DEFAULT_DIMENSION,
    excludes: tuple[str, ...] | list[str] = DEFAULT_EXCLUDES,
    **store: int,
) -> KnowledgeGraph:
    """Index what has changed below ``root`` since the stored version; all of it
    the first time. ``store`` are settings of a new store, such as ``buckets``."""
    made = GraphStore(spark, store_root, by_file=True, dimension=dimension if provider else None, **store)
    return index_changes(made, list_tree(spark, root, excludes), partial(read_files, root=root), provider, dimension)


def assert_contracts(graph: KnowledgeGraph) -> None:
    """Raise when a (kind, qualified name) is stored twice."""
    worst = duplicate_keys(graph.entities).limit(1).collect()
    if worst:
        raise ValueError(f"stored twice: {worst[0].kind} {worst[0].qualified_name}")
