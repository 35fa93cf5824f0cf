"""From files on disk to a stored graph and back."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from graphweft.operators import upsert
from graphweft.operators.lookup import get_entity
from graphweft.plans import hybrid
from graphweft.plans.index import assert_contracts, index_changes, index_files, index_tree
from graphweft.schema import ENTITY_SCHEMA, RELATIONSHIP_SCHEMA, KnowledgeGraph, conform
from graphweft.sources.files import file_entities, glob_regex, read_tree, route
from graphweft.sources.store import STORED_ENTITY_COLUMNS, ConcurrentWrite, ContractViolation, GraphStore


@pytest.mark.parametrize(
    "pattern, hits, misses",
    [
        ("target/**", ["target/a.rs", "target/x/y.rs"], ["src/target/a.rs", "targets/a.rs", "target"]),
        ("*.min.js", ["a.min.js", "web/b.min.js"], ["min.js", "a.js"]),
        ("docs", ["docs/a.py", "x/docs/b.py"], ["docs2/a.py"]),
        ("/top.py", ["top.py"], ["sub/top.py"]),
        ("src/**/gen_?.rs", ["src/gen_1.rs", "src/a/b/gen_2.rs"], ["src/gen_10.rs", "lib/gen_1.rs"]),
        ("[ab].c", ["a.c", "x/b.c"], ["c.c"]),
    ],
)
def test_globs(pattern, hits, misses):
    regex = re.compile(glob_regex(pattern))
    assert all(regex.search(p) for p in hits)
    assert not any(regex.search(p) for p in misses)


def write(root, files):
    for path, text in files.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(text if isinstance(text, bytes) else text.encode())


def test_tree_scan(spark, tmp_path):
    write(
        tmp_path,
        {
            "src/a.rs": "fn a() {}\n",
            "src/b.RS": "fn b() {}\n",
            ".hidden/c.rs": "fn c() {}\n",
            "src/.d.rs": "fn d() {}\n",
            "target/e.rs": "fn e() {}\n",
            "bad.py": b"x = '\xff\xfe'\n",
            "empty.py": "",
            "pkg/_build/__init__.py": "x = 1\n",
            "noext": "text",
            "two.lines.css": "a{}\n\nb{}",
        },
    )
    files = read_tree(spark, str(tmp_path))
    assert {r.path for r in files.collect()} == {"src/a.rs", "src/b.RS", "empty.py", "pkg/_build/__init__.py", "noext", "two.lines.css"}
    assert {(r.path, r.language) for r in route(files).collect()} == {("src/a.rs", "rust"), ("empty.py", "python"), ("pkg/_build/__init__.py", "python"), ("two.lines.css", "css")}
    lines = {r.qualified_name: (r.name, r.line_end, r.source_text) for r in file_entities(route(files)).collect()}
    assert lines == {"src/a.rs": ("a.rs", 1, ""), "empty.py": ("empty.py", 0, ""), "pkg/_build/__init__.py": ("__init__.py", 1, ""), "two.lines.css": ("two.lines.css", 3, "")}


def test_index_reindex_and_query(spark, tmp_path):
    code, store_root = tmp_path / "code", str(tmp_path / "store")
    write(
        code,
        {
            "lib.py": "import os\n\nLIMIT = 3\n\n\ndef parse(text):\n    return clean(text)\n\n\nclass Reader:\n    def read(self):\n        return parse(self)\n",
            "page.html": '<html>\n<script src="lib.py"></script>\n</html>\n',
        },
    )
    first = index_tree(spark, str(code), store_root, provider="hashing", dimension=32)
    names = {r.qualified_name: r.kind for r in first.entities.collect()}
    assert names["lib.py::Reader::read"] == "Method" and names["page.html"] == "File"
    assert "source_text" not in first.entities.columns
    # Calls name their callee barely and dangle; a script's source is a path.
    edges = {(r.from_qn, r.to_qn, r.rel_type) for r in first.relationships.collect()}
    assert ("page.html::<html>@L1::<script>@L2", "lib.py", "IMPORTS") in edges
    assert ("lib.py", "lib.py::parse", "CONTAINS") in edges
    assert not [e for e in edges if e[2] == "CALLS"]
    assert_contracts(first)

    write(code, {"lib.py": "def parse(text):\n    return text\n\n\nclass Reader:\n    def read(self):\n        return parse(self)\n"})
    second = index_tree(spark, str(code), store_root, provider="hashing", dimension=32)
    store = GraphStore(spark, store_root)
    assert store.current_version() == 2
    names = {r.qualified_name for r in store.load().entities.collect()}
    assert "lib.py::LIMIT" not in names and {"lib.py::parse", "lib.py::Reader::read", "page.html"} <= names
    assert {r.to_qn for r in second.relationships.collect()} <= names
    assert {r.qualified_name for r in store.scan_kind("Class").collect()} == {"lib.py::Reader"}

    asked = spark.createDataFrame([("lib.py::parse",)], "qualified_name string")
    assert get_entity(second.entities, asked).first().kind == "Function"
    text = spark.createDataFrame([(1, "parse", None)], "query_id long, text string, vector array<double>")
    best = hybrid.search(second, text, 5).results.orderBy("rank").first()
    assert (best.qualified_name, best.source) == ("lib.py::parse", "Vector")


def plain(graph):
    """Both tables without order, vectors as lists."""
    nodes = sorted(str(r.asDict()) for r in graph.entities.collect())
    return nodes, sorted(str(tuple(r)) for r in graph.relationships.collect()), sorted(str(tuple(r)) for r in graph.incoming.collect())


STEPS = [
    # base.py is imported by name before it exists; two files hold one text
    {"a.py": "def one():\n    pass\n\n\ndef two():\n    return one()\n", "page.html": '<html>\n<script src="lib.js"></script>\n</html>\n', "x/b.py": "def same():\n    pass\n", "c.py": "LIMIT = 1\n"},
    # lib.js appears: the edge of the unread page leads somewhere now; c.py holds the text of x/b.py, which loses it
    {"lib.js": "function go() {}\n", "c.py": "def same():\n    pass\n", "x/b.py": "def other():\n    pass\n"},
    # one file goes, one is empty, one cannot be read, one changes what is left alone otherwise
    {"lib.js": None, "a.py": "", "x/b.py": b"\xff\xfe", "d.css": "a { b: c }\n"},
    {},
]


def test_changes_give_what_a_full_index_gives(spark, tmp_path):
    code, stores = tmp_path / "code", [str(tmp_path / n) for n in ("changes", "full")]
    for i, step in enumerate(STEPS):
        for path, text in step.items():
            if text is None:
                (code / path).unlink()
            else:
                write(code, {path: text})
                os.utime(code / path, (1000 + i, 1000 + i))
        some = index_tree(spark, str(code), stores[0], provider="hashing", dimension=8, buckets=4)
        full = GraphStore(spark, stores[1], buckets=3)
        every = index_files(full, read_tree(spark, str(code)), provider="hashing", dimension=8)
        assert plain(some) == plain(every)
    store = GraphStore(spark, stores[0])
    # without a change no version is made
    assert store.current_version() == len(STEPS) - 1
    assert {r.path for r in store.files().collect()} == {"a.py", "page.html", "x/b.py", "c.py", "d.css"}


def test_unchanged_files_are_not_opened(spark, tmp_path):
    code, store = tmp_path / "code", str(tmp_path / "store")
    write(code, {f"f{i}.py": f"def f{i}():\n    pass\n" for i in range(6)})
    index_tree(spark, str(code), store, buckets=8)
    before = {b: f for b, f in GraphStore(spark, store)._current()["tables"]["entities"].items()}
    for i in range(5):  # other texts of the same size and time: only opening a file would tell
        at = (code / f"f{i}.py").stat()
        write(code, {f"f{i}.py": f"def g{i}():\n    pass\n"})
        os.utime(code / f"f{i}.py", ns=(at.st_atime_ns, at.st_mtime_ns))
    write(code, {"f5.py": "def changed():\n    pass\n"})
    graph = index_tree(spark, str(code), store)
    assert {r.name for r in graph.entities.where("kind = 'Function'").collect()} == {*(f"f{i}" for i in range(5)), "changed"}
    after = GraphStore(spark, store)._current()["tables"]["entities"]
    # the bucket of the one file is new, the others are the files they were
    assert sum(after[b] != before.get(b) for b in after) == 1 and len(after) > 1


def poisoned(files):
    """A reader that fails on some files, whatever else a task reads with them."""

    def run(batches):
        for batch in batches:
            if any("bad" in p for p in batch["path"].to_pylist()):
                raise ValueError("poison")
            yield batch

    texts = files.withColumn("source", F.concat(F.lit("def f():\n    pass\n# "), "path"))
    return texts.select("path", "source").coalesce(1).mapInArrow(run, "path string, source string")


def test_a_bad_file_is_left_out_and_listed(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path), by_file=True, buckets=2)
    names = ["a.py", "b.py", "x/bad.py"]
    listing = spark.createDataFrame([(n, 1, 1) for n in names], "path string, size long, modified long")
    graph = index_changes(store, listing, poisoned)
    assert {r.qualified_name for r in graph.entities.where("kind = 'Function'").collect()} == {"a.py::f", "b.py::f"}
    failed = {r.path: r.error for r in store.failed().collect()}
    assert set(failed) == {"x/bad.py"} and all("poison" in e for e in failed.values())
    # it is not tried again until it changes
    assert index_changes(store, listing, poisoned).entities.count() == graph.entities.count() and store.current_version() == 1


def graph_of(spark, rows, edges, dimension=2):
    """rows: (kind, qualified name, hash, vector)."""
    nodes = spark.createDataFrame([(k, q, q[-1:], h, v) for k, q, h, v in rows], "kind string, qualified_name string, name string, source_hash string, embedding array<float>")
    return conform(nodes, ENTITY_SCHEMA), conform(spark.createDataFrame(edges or [("", "", "")], "from_qn string, to_qn string, rel_type string"), RELATIONSHIP_SCHEMA)


def test_batches_against_whole_tables(spark, tmp_path):
    """Upserts, stale deletion and edges, step by step, against the same operators over whole tables."""
    rng = random.Random(4)
    store = GraphStore(spark, str(tmp_path), buckets=5, keep=2)
    held = KnowledgeGraph(store.load().entities, store.load().relationships)
    for step in range(4):
        rows = [(rng.choice("KL"), f"q{i}", rng.choice([None, f"h{rng.randrange(9)}"]), rng.choice([None, [1.0, float(step)]])) for i in rng.sample(range(30), 8)]
        edges = [(f"q{rng.randrange(30)}", f"q{rng.randrange(30)}", rng.choice(["CALLS", "USES_TYPE"])) for _ in range(40)]
        hashes = spark.createDataFrame([(f"h{i}",) for i in range(9) if i % 4 != step], "source_hash string") if step else None
        nodes, bag = graph_of(spark, rows, edges)
        got = store.apply(nodes, bag, hashes)
        wanted = upsert.upsert_entities(held.entities, nodes.select(*STORED_ENTITY_COLUMNS))
        wanted = wanted if hashes is None else upsert.drop_stale_entities(wanted, hashes)
        kept = upsert.keep_attached(held.relationships, wanted)
        held = KnowledgeGraph(spark.createDataFrame(wanted.collect(), wanted.schema), None)
        linked = upsert.upsert_relationships(kept, bag, held.entities)
        held = KnowledgeGraph(held.entities, spark.createDataFrame(linked.collect(), linked.schema))
        edges_of = lambda df: sorted(map(str, df.select(*upsert.EDGE_COLUMNS).collect()))
        assert sorted(map(str, got.entities.collect())) == sorted(map(str, held.entities.select(*got.entities.columns).collect()))
        assert edges_of(got.relationships) == edges_of(got.incoming) == edges_of(held.relationships)
    assert store.versions() == [3, 4] and store.load(3).entities.count()
    store.sweep()
    assert sorted(map(str, store.load().entities.collect())) == sorted(map(str, got.entities.collect()))


def test_a_second_writer_is_refused(spark, tmp_path):
    one, two = (GraphStore(spark, str(tmp_path), buckets=2) for _ in range(2))
    nodes, bag = graph_of(spark, [("K", "a", None, None)], [])
    one.apply(nodes, bag)
    base = two._current()
    late = two._write(base, graph_of(spark, [("K", "b", None, None)], [])[0].select(*STORED_ENTITY_COLUMNS), "entities", [0, 1])
    one.apply(graph_of(spark, [("K", "c", None, None)], [])[0], bag)
    with pytest.raises(ConcurrentWrite):
        two._commit(base, {"entities": late})
    assert {r.qualified_name for r in two.load().entities.collect()} == {"a", "c"}
    assert two.sweep() >= 1 and two.sweep() == 0
    assert {r.qualified_name for r in two.load().entities.collect()} == {"a", "c"}


def test_a_bad_batch_leaves_the_version(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path), buckets=2, dimension=2)
    bag = graph_of(spark, [("K", "a", None, None)], [])[1]
    store.apply(graph_of(spark, [("K", "a", None, [1.0, 2.0])], [])[0], bag)
    for bad in ([("K", "b", None, [1.0])], [("K", "b", "1", None), ("K", "b", "2", None)]):
        with pytest.raises(ContractViolation):
            store.apply(graph_of(spark, bad, [])[0], bag)
    assert store.current_version() == 1 and [r.qualified_name for r in store.load().entities.collect()] == ["a"]


def test_stored_name_index(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path))
    nodes, bag = graph_of(spark, [("K", f"m::name{i}", None, None) for i in range(20)], [])
    store.apply(nodes, bag)
    assert store.load().names is None
    store.index_names()
    graph = store.load()
    asked = spark.createDataFrame([(1, "NAME7", None), (2, "e1", None)], "query_id long, text string, vector array<double>")
    found = hybrid.search(graph, asked, 20).results.collect()
    assert {r.qualified_name for r in found if r.query_id == 1} == {"m::name7"} and sum(r.query_id == 2 for r in found) == 11


def test_empty_store_loads(spark, tmp_path):
    graph = GraphStore(spark, str(tmp_path / "none")).load()
    assert graph.entities.count() == 0 and graph.relationships.count() == 0


def test_both_ends_are_looked_up_where_files_are_sorted_by_them(spark, tmp_path):
    from pyspark.sql import functions as F

    from graphweft.operators import traverse, upsert
    from graphweft.schema import KnowledgeGraph
    from graphweft.session import seek_edges
    from graphweft.sources.store import STORED_ENTITY_COLUMNS, GraphStore

    store = GraphStore(spark, str(tmp_path))
    empty = store.load()
    edges = spark.range(400).select(
        F.lit("Function").alias("from_kind"), F.format_string("f%03d", F.col("id")).alias("from_qn"),
        F.lit("Function").alias("to_kind"), F.format_string("f%03d", (F.col("id") * 7) % 400).alias("to_qn"), F.lit("CALLS").alias("rel_type"),
    )
    rest = [c for c in upsert.EDGE_COLUMNS if c not in edges.columns]
    edges = edges.select("*", *(F.lit(None).cast(empty.relationships.schema[c].dataType).alias(c) for c in rest)).select(*upsert.EDGE_COLUMNS)
    named = {"qualified_name": F.lit("f000"), "name": F.lit("f000"), "kind": F.lit("Function")}
    fields = empty.entities.select(*STORED_ENTITY_COLUMNS).schema
    entity = spark.range(1).select(*(named.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))
    store.save(KnowledgeGraph(entity, edges))
    graph = store.load()
    assert sorted(map(tuple, graph.incoming.select("from_qn", "to_qn").collect())) == sorted(map(tuple, edges.select("from_qn", "to_qn").collect()))
    keys = spark.createDataFrame([("f007",), ("f000",)], "qualified_name string")
    for ends in (["from_qn"], ["to_qn"], ["from_qn", "to_qn"]):
        got = sorted(map(tuple, seek_edges(graph.relationships, graph.incoming, ends, keys).select("from_qn", "to_qn").collect()))
        want = [(r["from_qn"], r["to_qn"]) for r in edges.collect() if any(r[e] in ("f007", "f000") for e in ends)]
        assert got == sorted(want)
    assert all("/incoming/" in f for f in seek_edges(graph.relationships, graph.incoming, ["to_qn"], keys).inputFiles())
    for direction in ("in", "out", "both"):
        plain = KnowledgeGraph(graph.entities, graph.relationships)
        one, other = (sorted(map(str, traverse.neighbors(g, keys, 1, direction).collect())) for g in (graph, plain))
        assert one == other
