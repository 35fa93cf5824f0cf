"""The graph at rest: buckets of Parquet files, and versions that name them.

A row belongs to the bucket of its key: entities by qualified name,
relationships by their source, and once more (``incoming``) by their target. A
batch reads and rewrites the buckets it touches; all others stay the files they
are. A version is one small file that names the folder of every bucket. It is
created only if no other writer has created it, so of two writers that began
from one version the second is refused and readers never see a part of a batch.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphweft.operators import upsert
from graphweft.operators.names import NameIndex
from graphweft.schema import ENTITY_SCHEMA, RELATIONSHIP_SCHEMA, KnowledgeGraph
from graphweft.session import Scratch

STORED_ENTITY_COLUMNS = [f.name for f in ENTITY_SCHEMA.fields if f.name != "source_text"]
_EDGE_DDL = (
    "from_kind string, from_qn string, to_kind string, to_qn string, rel_type string, "
    "line int, field_name string, field_type string, variant_name string, dep_kind string"
)
#: Buckets of a new store; a cluster takes so many that one is a few hundred MB.
BUCKETS = 16
#: Versions that stay readable.
KEPT_VERSIONS = 3


class ConcurrentWrite(RuntimeError):
    """Another writer has made the version that this batch was to become."""


class ContractViolation(ValueError):
    """A batch would store a key twice or a vector of another dimension."""


class GraphStore:
    """Tables below ``root``: ``entities``, ``relationships``, ``incoming``, and
    for incremental indexing ``files`` (path, size, modified, source_hash),
    ``facts`` (path and the edges found in it, also those that lead nowhere) and
    ``failed`` (path, error).

    ``data/<table>/txn=<batch>/b=<bucket>/`` holds a bucket as a batch wrote it,
    below that the first two tables are in folders by kind or type, so a scan of
    one label reads only its files. ``by_file`` puts all keys of a source file
    (what stands before the first ``::``) into one bucket, which suits changes by
    file; otherwise keys are dealt by their whole name. ``dimension`` is the
    length that stored vectors must have. ``buckets``, ``by_file`` and
    ``dimension`` are fixed by the first version.
    """

    def __init__(
        self, spark: SparkSession, root: str, buckets: int = BUCKETS, by_file: bool = False,
        dimension: int | None = None, keep: int = KEPT_VERSIONS,
    ):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep
        self._new = {"version": 0, "buckets": buckets, "by_file": by_file, "dimension": dimension, "tables": {}}

    # ---- versions ------------------------------------------------------------

    def _fs(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _manifest(self, version: int) -> dict | None:
        """A version, or None while it is still being written."""
        fs, path = self._fs(f"{self.root}/versions/{version:09d}.json")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        except json.JSONDecodeError:
            return None
        finally:
            stream.close()

    def versions(self) -> list[int]:
        return [int(n[:9]) for n in self._names("versions") if n.endswith(".json")]

    def _current(self) -> dict:
        for version in reversed(self.versions()):
            if (found := self._manifest(version)) is not None:
                return found
        return self._new

    def current_version(self) -> int | None:
        return self._current()["version"] or None

    def _commit(self, base: dict, written: dict[str, dict[int, str]], replaced: bool = False) -> dict:
        """Make the version after ``base`` from the buckets that were written
        (a folder, or '' for a bucket that is empty now)."""
        tables = {}
        for name in {*base["tables"], *written}:
            old = {} if replaced else base["tables"].get(name, {})
            new = {str(b): folder for b, folder in written.get(name, {}).items()}
            tables[name] = {b: folder for b, folder in {**old, **new}.items() if folder}
        made = {**base, "version": base["version"] + 1, "tables": tables}
        fs, path = self._fs(f"{self.root}/versions/{made['version']:09d}.json")
        try:
            stream = fs.create(path, False)  # fails if it exists
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception) or fs.exists(path):
                raise ConcurrentWrite(f"version {made['version']} was made by another writer") from e
            raise
        stream.write(json.dumps(made).encode())
        stream.close()
        self._retire(made)
        return made

    def _retire(self, newest: dict) -> None:
        """Drop versions beyond those kept, and the files only they name. Files of
        batches that never became a version are left to ``sweep``."""
        old = [v for v in self.versions() if v <= newest["version"] - self.keep]
        named = lambda m: {(t, f) for t, buckets in (m or {"tables": {}})["tables"].items() for f in buckets.values()}
        alive = set().union(*(named(self._manifest(v)) for v in self.versions() if v not in old))
        for version in old:
            for table, folder in sorted(named(self._manifest(version)) - alive):
                self._delete(f"data/{table}/txn={folder}")
            self._delete(f"versions/{version:09d}.json")
            self._delete(f"names/v={version}")

    def _delete(self, folder: str) -> None:
        fs, path = self._fs(f"{self.root}/{folder}")
        fs.delete(path, True)

    def sweep(self) -> int:
        """Delete what no version names, left by batches that failed or were
        refused. Only for times without a writer. Returns the folders deleted."""
        alive = {(t, f) for v in self.versions() for t, buckets in (self._manifest(v) or {"tables": {}})["tables"].items() for f in buckets.values()}
        gone = [(t, f) for t in self._names("data") for f in self._names(f"data/{t}") if (t, f.removeprefix("txn=")) not in alive]
        for table, folder in gone:
            self._delete(f"data/{table}/{folder}")
        return len(gone)

    # ---- buckets -------------------------------------------------------------

    def _bucket(self, manifest: dict, key: Column) -> Column:
        key = F.substring_index(key, "::", 1) if manifest["by_file"] else key
        return F.pmod(F.xxhash64(key), F.lit(manifest["buckets"])).cast("int")

    def _of(self, manifest: dict, *keys: DataFrame) -> list[int]:
        """The buckets of the first columns of some tables; no more than there are buckets."""
        found = set()
        for df in keys:
            found |= {r[0] for r in df.select(self._bucket(manifest, F.col(df.columns[0])).alias("b")).distinct().collect()}
        return sorted(found)

    _KEYS = {"entities": "qualified_name", "relationships": "from_qn", "incoming": "to_qn", "files": "path", "facts": "path", "failed": "path"}
    _FOLDERS = {"entities": ["kind"], "relationships": ["rel_type"], "incoming": ["rel_type"], "files": [], "facts": [], "failed": []}
    _SCHEMAS = {
        "entities": T.StructType([f for f in ENTITY_SCHEMA.fields if f.name != "source_text"]),
        "relationships": _EDGE_DDL,
        "incoming": _EDGE_DDL,
        "files": "path string, size long, modified long, source_hash string",
        "failed": "path string, error string",
        "facts": T.StructType([T.StructField("path", T.StringType()), *RELATIONSHIP_SCHEMA.fields]),
    }

    def _read(self, manifest: dict, name: str, buckets: list[int] | None = None) -> DataFrame:
        held = manifest["tables"].get(name, {})
        wanted = held if buckets is None else [str(b) for b in buckets if str(b) in held]
        schema = self._SCHEMAS[name]
        schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        if not wanted:
            return self.spark.createDataFrame([], schema)
        base = f"{self.root}/data/{name}"
        paths = [f"{base}/txn={held[b]}/b={b}" for b in wanted]
        found = self.spark.read.option("basePath", base).parquet(*paths)
        # a kind or type stands in the folder names only, where Spark may take it for another type
        return found.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields))

    def _write(self, manifest: dict, df: DataFrame, name: str, touched: list[int]) -> dict[int, str]:
        """Write the new rows of the touched buckets: range-partitioned and sorted
        by bucket, folder and key, so that every file covers a narrow range of
        names and a hub is dealt over several. Returns the folder of each bucket."""
        if not touched:
            return {}
        folder, key = uuid.uuid4().hex, self._KEYS[name]
        parts = ["b", *self._FOLDERS[name]]
        order = [*parts, key, *(["to_qn"] if name == "relationships" else ["from_qn"] if name == "incoming" else [])]
        ranged = df.withColumn("b", self._bucket(manifest, F.col(key))).repartitionByRange(*order).sortWithinPartitions(*order)
        seen = Observation()
        if name == "entities":
            size = F.size("embedding")
            ranged = ranged.observe(seen, F.min(F.when(size >= 0, size)).alias("least"), F.max(size).alias("most"))
        ranged.write.partitionBy(*parts).parquet(f"{self.root}/data/{name}/txn={folder}")
        filled = {int(n[2:]) for n in self._names(f"data/{name}/txn={folder}") if n.startswith("b=")}
        written = {b: folder if b in filled else "" for b in touched}
        if name == "entities":
            sizes = seen.get if filled else {"least": None, "most": None}
            self._assert_contracts(manifest, written, sizes["least"], sizes["most"])
        return written

    def _assert_contracts(self, manifest: dict, written: dict[int, str], least: int | None, most: int | None) -> None:
        """What was written must hold before it becomes a version."""
        dimension = manifest["dimension"]
        if dimension is not None and least is not None and {least, most} != {dimension}:
            raise ContractViolation(f"vectors of {least} to {most} numbers where {dimension} are stored")
        fresh = {**manifest, "tables": {"entities": {str(b): f for b, f in written.items() if f}}}
        twice = upsert.duplicate_keys(self._read(fresh, "entities")).limit(1).collect()
        if twice:
            raise ContractViolation(f"stored twice: {twice[0].kind} {twice[0].qualified_name}")

    def _with(self, manifest: dict, name: str, written: dict[int, str]) -> dict:
        """The manifest as it will be once ``written`` is part of it."""
        held = {**manifest["tables"].get(name, {}), **{str(b): f for b, f in written.items()}}
        return {**manifest, "tables": {**manifest["tables"], name: {b: f for b, f in held.items() if f}}}

    # ---- whole tables --------------------------------------------------------

    def load(self, version: int | None = None) -> KnowledgeGraph:
        """The newest version, or one of those kept."""
        manifest = self._current() if version is None else self._manifest(version)
        index = f"{self.root}/names/v={manifest['version']}"
        names = NameIndex.load(self.spark, index) if self._names(f"names/v={manifest['version']}/postings") else None
        incoming = self._read(manifest, "incoming") if manifest["version"] else None
        return KnowledgeGraph(self._read(manifest, "entities"), self._read(manifest, "relationships").select(*upsert.EDGE_COLUMNS), incoming, names)

    def files(self) -> DataFrame:
        return self._read(self._current(), "files")

    def facts(self) -> DataFrame:
        return self._read(self._current(), "facts")

    def failed(self) -> DataFrame:
        """(path, error) of the files that could not be extracted as they are."""
        return self._read(self._current(), "failed")

    def index_names(self) -> NameIndex:
        """Write the trigram lists of the current version, which ``load`` then finds."""
        return NameIndex.build(self.load().entities, f"{self.root}/names/v={self.current_version()}")

    def scan_kind(self, kind: str) -> DataFrame:
        return self.load().entities.where(F.col("kind") == kind)

    def save(self, graph: KnowledgeGraph) -> int:
        """Make a whole graph the next version."""
        base = self._current()
        every = list(range(base["buckets"]))
        edges = graph.relationships.select(*upsert.EDGE_COLUMNS)
        written = {"entities": self._write(base, graph.entities.select(*STORED_ENTITY_COLUMNS), "entities", every)}
        written["incoming"] = self._write(base, edges, "incoming", every)
        written["relationships"] = self._write(base, self._read(self._with(base, "incoming", written["incoming"]), "incoming"), "relationships", every)
        return self._commit(base, written, replaced=True)["version"]

    # ---- batches -------------------------------------------------------------

    def apply(
        self, entities: DataFrame, relationships: DataFrame, current_hashes: DataFrame | None = None,
        scope: DataFrame | None = None, **by_path: DataFrame,
    ) -> KnowledgeGraph:
        """Upsert entities, drop what is stale, then upsert edges, as the next version.

        Edges are resolved against the entities just written; an edge to a stale
        entity would not outlive the stale deletion, so none is made. Stale are
        entities with a hash that is not among ``current_hashes`` (an empty set
        drops nothing), where ``scope`` is given only those of its files (path).
        ``by_path`` (``files``, ``facts``, ``failed``) replace what is stored of
        the files in ``scope``, which holds all their paths; stored facts of other files take part where the
        batch brings an entity that they name.
        """
        base = self._current()
        scratch = Scratch(self.spark)
        batch = scratch.write(entities.select(*STORED_ENTITY_COLUMNS), "batch")
        stored = self._read(base, "entities")
        stale = stored.limit(0)
        if current_hashes is not None and not current_hashes.isEmpty():
            hashes = current_hashes.select("source_hash").distinct()
            held = stored if scope is None else self._in_scope(base, scope)
            stale = held.where("source_hash IS NOT NULL").join(hashes, "source_hash", "left_anti")
        stale = scratch.write(stale.select("qualified_name", "kind"), "stale")

        touched = self._of(base, batch.select("qualified_name"), stale)
        before = self._read(base, "entities", touched)
        nodes = upsert.upsert_entities(before, batch)
        if current_hashes is not None:
            nodes = upsert.drop_stale_entities(nodes, current_hashes) if scope is None else self._drop_in_scope(nodes, current_hashes, scope)
        written = {"entities": self._write(base, nodes, "entities", touched)}
        after = self._with(base, "entities", written["entities"])
        fresh = self._read(after, "entities", touched).select(*upsert.NODE_KEY)
        removed, n_removed, _ = scratch.write_counted(before.select(*upsert.NODE_KEY).join(fresh, upsert.NODE_KEY, "left_anti"), "removed")

        bag = relationships.select(*(f.name for f in RELATIONSHIP_SCHEMA.fields if f.name in relationships.columns))
        if "facts" in by_path:
            added = scratch.write(fresh.join(before.select(*upsert.NODE_KEY), upsert.NODE_KEY, "left_anti").select("qualified_name").distinct(), "added")
            others = self._read(base, "facts").join(scope.select("path"), "path", "left_anti")
            named = others.join(added.toDF("to_qn"), "to_qn", "left_semi").unionByName(
                others.join(added.toDF("to_qn"), "to_qn", "left_anti").join(added.toDF("from_qn"), "from_qn", "left_semi")
            )
            bag = bag.unionByName(named.select(*bag.columns), allowMissingColumns=True)
        bag = scratch.write(bag, "bag")
        ends = self._read(after, "entities", self._of(base, bag.select("from_qn"), bag.select("to_qn")))
        new = scratch.write(upsert.resolve(bag, ends), "edges")
        gone = self._of(base, removed.select("qualified_name")) if n_removed else []

        def rewrite_edges(name: str) -> dict[int, str]:
            end = self._KEYS[name]
            lost = []  # with either end; each end is looked up where the buckets go by it
            for held, side in (("relationships", "from"), ("incoming", "to")) if n_removed else ():
                key = [f"{side}_kind", f"{side}_qn"]
                lost.append(self._read(base, held, gone).join(removed.toDF(*key), key, "left_semi").select(end))
            at = self._of(base, new.select(end), *lost)
            held = self._read(base, name, at)
            held = upsert.detach(held, removed) if n_removed else held
            return self._write(base, upsert.merge_edges(held, new), name, at)

        def rewrite_rows(name: str) -> dict[int, str]:
            rows = by_path[name]
            others = self._read(base, name, in_scope).join(scope.select("path"), "path", "left_anti")
            return self._write(base, others.unionByName(rows.select(*others.columns)), name, in_scope)

        in_scope = self._of(base, scope.select("path")) if by_path else []
        jobs = {name: rewrite_edges for name in ("relationships", "incoming")} | {name: rewrite_rows for name in by_path}
        # the tables do not depend on each other: their jobs run side by side
        with ThreadPoolExecutor(len(jobs)) as pool:
            written |= dict(zip(jobs, pool.map(lambda name: jobs[name](name), jobs), strict=True))
        self._commit(base, written)
        return self.load()

    def _in_scope(self, manifest: dict, scope: DataFrame) -> DataFrame:
        """Stored entities of some files; where buckets go by file, only those are read."""
        at = self._of(manifest, scope.select("path")) if manifest["by_file"] else None
        return self._read(manifest, "entities", at).join(scope.select(F.col("path").alias("file_path")), "file_path", "left_semi")

    def _drop_in_scope(self, nodes: DataFrame, hashes: DataFrame, scope: DataFrame) -> DataFrame:
        marked = nodes.join(scope.select(F.col("path").alias("file_path"), F.lit(True).alias("_in")).distinct(), "file_path", "left")
        inside = upsert.drop_stale_entities(marked.where("_in").select(*nodes.columns), hashes)
        return marked.where("_in IS NULL").select(*nodes.columns).unionByName(inside)
