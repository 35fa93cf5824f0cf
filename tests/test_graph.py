"""Set semantics, traversal and paths against plain-Python models."""

import random
from collections import Counter, deque

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphweft.operators import assembly, lookup, names, traverse, upsert
from graphweft.schema import KnowledgeGraph

NODE = "kind string, qualified_name string, name string"
EDGE = (
    "from_kind string, from_qn string, to_kind string, to_qn string, rel_type string, "
    "line int, field_name string, field_type string, variant_name string, dep_kind string"
)
SLOW = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def make_graph(spark, nodes, edges):
    """nodes: qualified names; edges: (from, to, type)."""
    entities = spark.createDataFrame([("Function", n, n.upper()) for n in nodes], NODE)
    rows = [("Function", f, "Function", t, r, None, None, None, None, None) for f, t, r in edges]
    return KnowledgeGraph(entities, spark.createDataFrame(rows, EDGE))


def trails(edges, start, depth, direction):
    """(far end, type) of every edge of every trail, as a multiset."""
    out = Counter()

    def walk(node, used):
        for i, (f, t, _) in enumerate(edges):
            if i in used:
                continue
            ends = []
            if direction in ("out", "both") and f == node:
                ends.append(t)
            if direction in ("in", "both") and t == node and not (direction == "both" and f == t):
                ends.append(f)
            for far in ends:
                path = used + [i]
                for j in path:
                    out[(far, edges[j][2])] += 1
                if len(path) < depth:
                    walk(far, path)

    walk(start, [])
    return out


FIXTURE = [("a", "a", "CALLS"), ("a", "b", "CALLS"), ("a", "b", "IMPORTS"), ("b", "a", "CALLS"), ("b", "c", "CALLS")]


def check_trails(spark, nodes, edges, depth):
    graph = make_graph(spark, nodes, edges)
    targets = graph.entities
    for direction in ("in", "out", "both"):
        got = Counter()
        for r in traverse.neighbors(graph, targets, depth, direction).collect():
            assert r.direction == direction and r.name == r.qualified_name.upper()
            got[(r.target, r.qualified_name, r.rel_type)] += 1
        want = Counter({(s, far, t): n for s in nodes for (far, t), n in trails(edges, s, depth, direction).items()})
        assert got == want, direction


def test_trails_with_loop_parallel_edges_and_cycle(spark):
    check_trails(spark, ["a", "b", "c"], FIXTURE, 3)


graphs = st.sets(st.tuples(st.sampled_from("abcd"), st.sampled_from("abcd"), st.sampled_from(["CALLS", "USES_TYPE"])), min_size=1, max_size=6)


@SLOW
@given(graphs)
def test_trails_of_random_graphs(spark, edges):
    check_trails(spark, list("abcd"), sorted(edges), 2)


def test_few_new_edges_do_not_shuffle_the_stored_ones(spark, tmp_path):
    stored = make_graph(spark, [], [("a", "b", "CALLS"), ("b", "c", "CALLS")]).relationships
    new = make_graph(spark, [], [("a", "b", "CALLS"), ("c", "a", "CALLS")]).relationships.withColumn("line", F.lit(7))
    for name, df in (("stored", stored), ("new", new)):
        df.select(*upsert.EDGE_COLUMNS).write.parquet(f"{tmp_path}/{name}")
    merged = upsert.merge_edges(*(spark.read.schema(EDGE).parquet(f"{tmp_path}/{n}") for n in ("stored", "new")))
    assert {(r.from_qn, r.to_qn, r.line) for r in merged.collect()} == {("a", "b", 7), ("b", "c", None), ("c", "a", 7)}
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan


def test_trails_from_many_targets(spark, monkeypatch):
    monkeypatch.setattr(traverse, "SEEK_KEYS", 1)
    check_trails(spark, ["a", "b", "c", "d"], [*FIXTURE, ("c", "d", "CALLS"), ("d", "a", "CALLS")], 3)


def test_only_nodes_that_trails_pass_are_joined_again(spark):
    edges = [("hub", f"leaf{i}", "CALLS") for i in range(20)] + [("root", "hub", "CALLS")]
    steps = {d: traverse.incidences(make_graph(spark, ["root", "hub"], edges).relationships, d) for d in traverse.DIRECTIONS}
    for direction, came, goes in (("out", 1, 20), ("in", 20, 1), ("both", 21, 21)):
        middles, *rows = traverse._middles(steps[direction], steps[direction], direction, traverse.Scratch(spark))
        assert [r.near_qn for r in middles.collect()] == ["hub"] and rows == [came, goes]


def test_unknown_direction_means_both(spark):
    graph = make_graph(spark, ["a", "b"], [("a", "b", "CALLS")])
    assert {r.direction for r in traverse.neighbors(graph, graph.entities, 1, "sideways").collect()} == {"both"}


def shortest(edges, start, goal, limit=15):
    """Smallest node sequence among the shortest undirected paths."""
    near = {}
    for f, t, _ in edges:
        near.setdefault(f, set()).add(t)
        near.setdefault(t, set()).add(f)
    level = {start: [start]}
    seen = {start}
    for _ in range(limit + 1):
        if goal in level:
            return level[goal]
        following = {}
        for node, path in level.items():
            for far in near.get(node, ()):
                if far not in seen:
                    following[far] = min(following.get(far, [chr(0x10FFFF)]), path + [far])
        seen |= set(following)
        level = following
    return None


def check_paths(spark, nodes, edges, pairs):
    graph = make_graph(spark, nodes, edges)
    asked = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair_id long, from_qn string, to_qn string")
    rows = traverse.shortest_paths(graph, asked).collect()
    got = {r.pair_id: [n.qualified_name for n in r.path] for r in rows}
    want = {i: p for i, (a, b) in enumerate(pairs) if (p := shortest(edges, a, b)) is not None}
    assert got == want
    assert all(r.hops == len(r.path) - 1 for r in rows)
    return graph


def test_path_of_fifteen_hops_is_found_and_sixteen_is_not(spark):
    nodes = [f"n{i:02d}" for i in range(20)]
    edges = [(a, b, "CALLS") for a, b in zip(nodes, nodes[1:])]
    check_paths(spark, nodes, edges, [("n00", "n15"), ("n00", "n16"), ("n16", "n01"), ("n03", "n03")])


def test_names_that_are_prefixes_of_each_other(spark):
    edges = [("s", "ab", "X"), ("s", "a", "X"), ("ab", "t", "X"), ("a", "t", "X"), ("s", "lone", "X")]
    check_paths(spark, ["s", "a", "ab", "t", "lone", "far"], edges, [("s", "t"), ("t", "s"), ("s", "far")])


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.sets(st.tuples(st.sampled_from("abcdef"), st.sampled_from("abcdef"), st.just("CALLS")), max_size=9))
def test_paths_of_random_graphs(spark, edges):
    pairs = [(a, b) for a in "abcdef" for b in "af"]
    check_paths(spark, list("abcdef"), sorted(edges), pairs)


def test_paths_of_more_pairs_than_bits(spark):
    """Several blocks of pairs, all 64 bits of a block, pairs that end after different hops or never, repeated pairs."""
    rng = random.Random(12)
    nodes = [f"n{i:02d}" for i in range(40)]
    edges = sorted({(rng.choice(nodes[:36]), rng.choice(nodes[:36]), "CALLS") for _ in range(48)})
    pairs = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(150)] + [("n00", "n01")] * 3
    graph = check_paths(spark, nodes, edges, pairs)
    asked = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair_id long, from_qn string, to_qn string").coalesce(1)
    got = {r.pair_id: r.hops for r in traverse.path_lengths(graph, asked).collect()}
    assert got == {i: len(p) - 1 for i, (a, b) in enumerate(pairs) if (p := shortest(edges, a, b)) is not None}
    assert len(set(got.values())) > 3


def test_hubs_are_not_spread_out_for_every_block_of_pairs(spark, monkeypatch):
    """Two components with two hubs each below a root; in the second the hubs are joined, which closes an odd cycle."""
    leaves = [(f"{c}h{i % 2}", f"{c}leaf{i:03d}") for c in "ab" for i in range(200)]
    edges = [(f"{c}root", f"{c}h{i}", "CALLS") for c in "ab" for i in range(2)] + [(h, leaf, "CALLS") for h, leaf in leaves]
    edges += [("bh0", "bh1", "CALLS")]
    pairs = [(f"{c}leaf{i:03d}", f"{c}leaf{(i * 7 + 1) % 200:03d}") for c in "ab" for i in range(90)]
    pairs += [("lone", "aroot"), ("ah1", "ah1"), ("broot", "bleaf000"), ("aleaf000", "bleaf000"), ("aleaf000", "aleaf002")]
    graph = make_graph(spark, ["lone", *sorted({n for e in edges for n in e[:2]})], edges)
    written = Counter()
    write_counted = traverse.Scratch.write_counted

    def counted(self, df, name, of=None):
        made = write_counted(self, df, name, of)
        written[name.rstrip("0123456789")] += made[1]
        return made

    monkeypatch.setattr(traverse.Scratch, "write_counted", counted)
    asked = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair_id long, from_qn string, to_qn string").coalesce(1)
    got = {r.pair_id: r.hops for r in traverse.path_lengths(graph, asked).collect()}
    assert got == {i: len(p) - 1 for i, (a, b) in enumerate(pairs) if (p := shortest(edges, a, b)) is not None}
    assert written["level"] < 3 * len(pairs)


def test_path_nodes_are_rows(spark):
    graph = make_graph(spark, ["a", "b"], [("b", "a", "CALLS")])
    asked = spark.createDataFrame([(7, "a", "b")], "pair_id long, from_qn string, to_qn string")
    rows = traverse.path_nodes(graph, traverse.shortest_paths(graph, asked)).orderBy("ordinal").collect()
    assert [(r.pair_id, r.ordinal, r.name, r.relationship, r.direction) for r in rows] == [(7, 0, "A", "", ""), (7, 1, "B", "", "")]


ENTITY = "kind string, qualified_name string, name string, doc_comment string, source_hash string, embedding array<float>"


def test_upsert_overwrites_with_nulls_but_keeps_embeddings(spark):
    stored = spark.createDataFrame(
        [("Function", "q", "old", "doc", "h1", [1.0]), ("Class", "q", "twin", "doc", "h2", [2.0]), ("File", "f", "f", None, "h3", None)], ENTITY
    )
    batch = spark.createDataFrame([("Function", "q", "new", None, "h9", None), ("Enum", "e", "e", None, "h4", [3.0])], ENTITY)
    got = {(r.kind, r.qualified_name): (r.name, r.doc_comment, r.source_hash, r.embedding) for r in upsert.upsert_entities(stored, batch).collect()}
    assert got == {
        ("Function", "q"): ("new", None, "h9", [1.0]),
        ("Class", "q"): ("twin", "doc", "h2", [2.0]),
        ("File", "f"): ("f", None, "h3", None),
        ("Enum", "e"): ("e", None, "h4", [3.0]),
    }


def test_embedding_reaches_every_kind_of_the_name(spark):
    stored = spark.createDataFrame([("Function", "q", "a", None, "h1", None), ("Class", "q", "b", None, "h2", None)], ENTITY)
    batch = spark.createDataFrame([("Function", "q", "a", None, "h1", [5.0])], ENTITY)
    assert {r.embedding[0] for r in upsert.upsert_entities(stored, batch).collect()} == {5.0}


BAG = "from_qn string, to_qn string, rel_type string, line int, field_name string, field_type string, variant_name string, dep_kind string"


def test_resolve_drops_dangling_edges_and_keeps_the_greatest_line(spark):
    entities = spark.createDataFrame([("Function", "a", "A"), ("Function", "b", "B"), ("Class", "b", "B")], NODE)
    bag = spark.createDataFrame(
        [("a", "b", "CALLS", n, f"f{n}", None, None, None) for n in (3, 9, 5)]
        + [("a", "b", "CALLS", None, "zz", None, None, None), ("a", "gone", "CALLS", 1, None, None, None, None)],
        BAG,
    )
    rows = upsert.resolve(bag, entities).collect()
    assert {(r.to_kind, r.to_qn, r.line, r.field_name) for r in rows} == {("Function", "b", 9, "f9"), ("Class", "b", 9, "f9")}
    assert len(rows) == 2


def test_relationship_upsert_overwrites(spark):
    graph = make_graph(spark, ["a", "b"], [("a", "b", "CALLS"), ("b", "a", "CALLS")])
    bag = spark.createDataFrame([("a", "b", "CALLS", 4, None, None, None, None), ("a", "a", "CALLS", 1, None, None, None, None)], BAG)
    got = {(r.from_qn, r.to_qn): r.line for r in upsert.upsert_relationships(graph.relationships, bag, graph.entities).collect()}
    assert got == {("a", "b"): 4, ("b", "a"): None, ("a", "a"): 1}


hashes = st.lists(st.sampled_from(["h1", "h2", "h3", None]), min_size=4, max_size=4)


@SLOW
@given(hashes, st.sets(st.sampled_from(["h1", "h2", "h9"])))
def test_stale_deletion_against_a_model(spark, of_nodes, current):
    names = ["a", "b", "c", "d"]
    edges = [("a", "b", "X"), ("b", "c", "X"), ("c", "d", "Y"), ("d", "d", "X")]
    graph = make_graph(spark, names, edges)
    schema = "kind string, qualified_name string, source_hash string"
    entities = spark.createDataFrame([("Function", n, h) for n, h in zip(names, of_nodes)], schema)
    left = upsert.delete_stale(KnowledgeGraph(entities, graph.relationships), spark.createDataFrame([(h,) for h in current], "source_hash string"))
    alive = {n for n, h in zip(names, of_nodes) if not current or h is None or h in current}
    assert {r.qualified_name for r in left.entities.collect()} == alive
    assert {(r.from_qn, r.to_qn) for r in left.relationships.collect()} == {(f, t) for f, t, _ in edges if {f, t} <= alive}


def test_merge_last_part_wins(spark):
    schema = "qualified_name string, name string, kind string, line_start int"
    one = spark.createDataFrame([("q", "first", "A", 1), ("q", "second", "A", 5), ("r", "r", "A", 1)], schema)
    two = spark.createDataFrame([("q", "third", "B", 2)], schema)
    assert {(r.qualified_name, r.name) for r in assembly.merge_entities([one, two]).collect()} == {("q", "third"), ("r", "r")}
    assert {(r.qualified_name, r.name) for r in assembly.merge_entities([one]).collect()} == {("q", "second"), ("r", "r")}


def test_name_search_scores(spark):
    named = ["Parse", "parse_file", "my_parse", "other", "%"]
    entities = spark.createDataFrame([("Function", f"m::{n}", n) for n in named], NODE)
    one = lookup.name_search(entities, [(1, "PARSE")], 2).collect()
    assert [(r.qualified_name, r.score) for r in one] == [("m::Parse", 1.0), ("m::parse_file", 0.8)]
    texts = [(i, t) for i, t in enumerate(["parse", "%", "M::O", "absent"])]
    want = {(0, "m::Parse", 1.0), (0, "m::parse_file", 0.8), (0, "m::my_parse", 0.5), (1, "m::%", 1.0), (2, "m::other", 0.5)}
    for asked in (texts, spark.createDataFrame(texts, "query_id long, text string")):
        assert {(r.query_id, r.qualified_name, r.score) for r in lookup.name_search(entities, asked, 10).collect()} == want


@pytest.mark.parametrize("stored", [False, True])
def test_name_search_by_trigrams(spark, tmp_path, monkeypatch, stored):
    """Against ``in`` on all pairs: short, empty, null, repeated and unknown texts, null names, one gram in every name."""
    rng = random.Random(9)
    letters = "aAbÉé_:1𝒳"
    rows = {("K" + str(rng.randrange(2)), "mod::" + "".join(rng.choices(letters, k=rng.randrange(0, 9)))) for _ in range(150)}
    rows = [(kind, qn, None if i % 17 == 0 else qn[5:] or "x") for i, (kind, qn) in enumerate(sorted(rows))]
    entities = spark.createDataFrame(rows, NODE)
    asked = [None, "", "a", "É", "𝒳", "aB", "mod", "MOD::", "zzz", "mod", "od::a"] + [rng.choice(rows)[1][rng.randrange(6) :] for _ in range(40)]
    monkeypatch.setattr(names, "PIECE", 20)
    index = names.NameIndex.build(entities, str(tmp_path)) if stored else None
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, text string")
    got = list(map(tuple, names.search_names(entities, queries, 4, index).collect()))
    want = []
    for i, text in enumerate(asked):
        if text is None:
            continue
        t = text.lower()
        hits = [
            (-(1.0 if n is not None and n.lower() == t else 0.8 if n is not None and n.lower().startswith(t) else 0.5), qn.encode(), kind, n, qn)
            for kind, qn, n in rows
            if t in qn.lower() or (n is not None and t in n.lower())
        ]
        want += [(i, n, qn, kind, -s) for s, _, kind, n, qn in sorted(hits, key=lambda h: h[:3])[:4]]
    assert sorted(map(str, got)) == sorted(map(str, want))
    if stored:
        assert index.counts.where("pieces > 1").count() and index.postings.where("piece > 0").count()
    assert names.search_names(entities.limit(0), queries, 4).count() == 0
    assert names.search_names(entities, queries.limit(0), 4).count() == 0


def test_get_entity_takes_the_first_kind(spark):
    entities = spark.createDataFrame([("Struct", "q", "x"), ("Class", "q", "y")], NODE)
    keys = spark.createDataFrame([("q",), ("gone",), ("q",)], "qualified_name string")
    assert [tuple(r) for r in lookup.get_entity(entities, keys).collect()] == [("y", "q", "Class", 1.0)]


def test_graph_stats_lists_absent_kinds_and_total(spark):
    got = {r.kind: r.n for r in lookup.graph_stats(spark.createDataFrame([("Enum", "q", "x"), ("Own", "o", "y")], NODE)).collect()}
    assert got["Enum"] == 1 and got["File"] == 0 and got["Own"] == 1 and got["Total"] == 2 and len(got) == 28


def test_incremental_diff(spark):
    schema = "qualified_name string, source_hash string"
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], schema)
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], schema)
    got = {r.qualified_name: r.status for r in upsert.incremental_diff(old, new).collect()}
    assert got == {"a": "unchanged", "b": "changed", "c": "removed", "d": "added"}


def test_contract_checks(spark):
    rows = spark.createDataFrame([("A", "q", [1.0]), ("A", "q", [1.0, 2.0]), ("B", "q", None)], "kind string, qualified_name string, embedding array<float>")
    assert [tuple(r) for r in upsert.duplicate_keys(rows).collect()] == [("A", "q", 2)]
    assert [tuple(r) for r in upsert.dimension_violations(rows, 1).collect()] == [("A", 2, 1)]
    assert rows.where(F.col("kind") == "B").count() == lookup.scan_kind(rows, "B").count()
