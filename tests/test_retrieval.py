"""Vector search, pooling and hybrid retrieval against plain-Python models."""

import json
import math

import numpy as np
import pytest

from graphweft.operators import embed, traverse, vector
from graphweft.plans import hybrid
from graphweft.schema import SEARCHABLE_KINDS, KnowledgeGraph
from graphweft.sources import json_out

NODE = "kind string, qualified_name string, name string, embedding array<float>"
EDGE = "from_kind string, from_qn string, to_kind string, to_qn string, rel_type string"


def random_nodes(count=60, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    kinds = ["Function", "Struct", "Class"]
    rows = []
    for i in range(count):
        v = rng.normal(size=dim)
        if i % 10 == 1:
            v = np.array(rows[-1][3])  # a copy: equal scores
        if i % 17 == 5:
            v = np.zeros(dim)
        rows.append((kinds[i % 3], f"n{i:03d}", f"N{i}", [float(np.float32(x)) for x in v]))
    return rows + [("Function", "nov", "nov", None)]


def cosine_score(a, b):
    a, b = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
    return round((1 + a @ b / np.linalg.norm(a) / np.linalg.norm(b)) / 2, 6)


def brute_topk(nodes, queries, k, kinds=None):
    out = set()
    for qid, q in queries:
        if not any(q):
            continue
        for kind in {n[0] for n in nodes}:
            if kinds is not None and kind not in kinds:
                continue
            scored = [(-cosine_score(v, q), qn) for kd, qn, _, v in nodes if kd == kind and v is not None and any(v)]
            out |= {(qid, kind, qn, -s) for s, qn in sorted(scored)[:k]}
    return out


def rows_of(df):
    return {(r.query_id, r.kind, r.qualified_name, r.score) for r in df.collect()}


@pytest.fixture(scope="module")
def nodes():
    return random_nodes()


def test_topk_per_kind(spark, nodes):
    rng = np.random.default_rng(5)
    queries = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(3)] + [(9, [0.0] * 8)]
    entities = spark.createDataFrame(nodes, NODE)
    assert rows_of(vector.vector_topk(entities, queries, 4)) == brute_topk(nodes, queries, 4)
    only = rows_of(vector.vector_topk(entities, queries, 4, SEARCHABLE_KINDS))
    assert only == brute_topk(nodes, queries, 4, SEARCHABLE_KINDS)
    # Fewer entities than k.
    assert rows_of(vector.vector_topk(entities, queries, 100)) == brute_topk(nodes, queries, 100)


def test_many_queries_take_the_blocked_join(spark, nodes, monkeypatch):
    rng = np.random.default_rng(6)
    queries = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(5)] + [(9, [0.0] * 8)]
    entities = spark.createDataFrame(nodes, NODE)
    asked = spark.createDataFrame(queries, "query_id long, vector array<double>")
    for name, value in (("QUERIES_IN_PLAN", 2), ("ENTITY_BLOCK", 20), ("QUERY_BLOCK", 2)):
        monkeypatch.setattr(vector, name, value)
    assert rows_of(vector.vector_topk(entities, asked, 3)) == brute_topk(nodes, queries, 3)
    # A list of queries is split into passes.
    assert rows_of(vector.vector_topk(entities, queries, 3)) == brute_topk(nodes, queries, 3)


def test_many_arrow_batches(spark, nodes):
    queries = [(1, [1.0] * 8)]
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        hits = vector.vector_topk(spark.createDataFrame(nodes, NODE).coalesce(1), queries, 4)
        assert rows_of(hits) == brute_topk(nodes, queries, 4)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_wrong_dimension_is_an_error(spark, nodes):
    with pytest.raises(Exception, match="dimension"):
        vector.vector_topk(spark.createDataFrame(nodes, NODE), [(1, [1.0, 2.0])], 3).collect()


def test_lsh_recall(spark):
    nodes = random_nodes(400, 8, 11)
    rng = np.random.default_rng(8)
    queries = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(5)]
    entities = spark.createDataFrame(nodes, NODE)
    exact = {(r.query_id, r.qualified_name) for r in vector.topk_overall(vector.vector_topk(entities, queries, 5), 5).collect()}
    index = vector.LshIndex(entities, bucket_length=1.0, tables=6)
    near = {(r.query_id, r.qualified_name) for r in index.search(spark.createDataFrame(queries, "query_id long, vector array<double>"), 5).collect()}
    assert len(exact & near) >= 0.8 * len(exact)


def test_mean_pool_ignores_masked_tokens(spark):
    tokens = spark.createDataFrame(
        [(1, 1, [1.0, 2.0]), (1, 1, [3.0, 4.0]), (1, 0, [9.0, 9.0]), (2, 0, [5.0, 5.0])], "id int, mask int, vector array<float>"
    )
    assert {r.id: list(r.vector) for r in embed.mean_pool(tokens, 2).collect()} == {1: [2.0, 3.0], 2: [0.0, 0.0]}


def test_providers(spark):
    texts = spark.createDataFrame([(1, "alpha beta"), (2, "alpha beta"), (3, "gamma")], "id int, text string")
    vectors = {r.id: np.array(r.embedding) for r in embed.embed(texts, "text", "hashing", 32).collect()}
    assert np.allclose(vectors[1], vectors[2]) and math.isclose(np.linalg.norm(vectors[1]), 1, abs_tol=1e-6)
    assert {tuple(r.embedding) for r in embed.embed(texts, "text", "none", 3).collect()} == {(0.0, 0.0, 0.0)}
    assert embed.dimensions(embed.embed(texts, "text", "none", 3)).first().dimensions == 3
    with pytest.raises(ValueError):
        embed.embed(texts, "text", "absent")
    embed.register_provider("own", embed.zero_provider)
    assert embed.embed(texts, "text", "own", 2).count() == 3


def edges_of(nodes):
    names = [(n[0], n[1]) for n in nodes]
    pairs = [(i, (i * 7 + 3) % len(names), "CALLS") for i in range(len(names))]
    pairs += [(i, 0, "IMPORTS") for i in range(1, len(names), 2)] + [(0, 0, "USES_TYPE")]
    return [(*names[a], *names[b], t) for a, b, t in pairs]


def brute_search(nodes, edges, hits, k):
    """hits: (qn, kind, score) of one query, best first."""
    kind_of = {n[1]: n[0] for n in nodes}
    found = {qn: (score, 0, "Vector") for qn, _, score in hits}
    for qn, _, score in hits:
        for fk, f, tk, t, _ in edges:
            for far in ([t] if f == qn else []) + ([f] if t == qn and f != t else []):
                found.setdefault(far, (score * 0.5, 1, "GraphExpansion"))
    rows = [(-(0.7 * s + 0.3 / (1 + d)), qn, kind_of[qn], s, d, src) for qn, (s, d, src) in found.items()]
    return [(qn, kind, s, d, -rel, src) for rel, qn, kind, s, d, src in sorted(rows)[:k]]


def test_hybrid_search_against_a_model(spark, nodes):
    edges = edges_of(nodes)
    graph = KnowledgeGraph(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE))
    rng = np.random.default_rng(12)
    queries = [(i, f"text {i}", [float(x) for x in rng.normal(size=8)]) for i in range(2)] + [(5, "N1", [0.0] * 8)]
    asked = spark.createDataFrame(queries, "query_id long, text string, vector array<double>")
    for k in (3, 60):
        result = hybrid.search(graph, asked, k)
        got = {}
        for r in result.results.orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r)
        for qid, text, v in queries:
            if any(v):
                hits = sorted((-s, qn, kind) for _, kind, qn, s in brute_topk(nodes, [(qid, v)], k, SEARCHABLE_KINDS))[:k]
            else:
                score = {True: 1.0, False: 0.8}
                hits = sorted((-score[n[2].lower() == text.lower()], n[1], n[0]) for n in nodes if n[2].lower().startswith(text.lower()))[:k]
            want = brute_search(nodes, edges, [(qn, kind, -s) for s, qn, kind in hits], k)
            have = [(r.qualified_name, r.kind, r.vector_score, r.graph_distance, r.relevance, r.source) for r in got[qid]]
            assert [h[:2] + h[5:] for h in have] == [w[:2] + w[5:] for w in want]
            assert np.allclose([h[2:5] for h in have], [w[2:5] for w in want])
    assert "GraphExpansion" in {r.source for rows in got.values() for r in rows}


def test_json_leaves_out_what_is_absent_and_splits_long_lists(spark, nodes):
    edges = edges_of(nodes)
    graph = KnowledgeGraph(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE))
    asked = spark.createDataFrame([(1, "n000", None)], "query_id long, text string, vector array<double>")
    result = hybrid.search(graph, asked, 20)
    whole = [json.loads(r.json) for r in json_out.search_json(result).collect()]
    hub = next(d for d in whole if d["qualified_name"] == "n000")
    total = sum(len(d.get("related", ())) for d in whole)
    assert total == result.related.count() and len(hub["related"]) > 20
    assert all(d["related"] for d in whole if "related" in d) and any("related" not in d for d in whole)
    pieces = [json.loads(r.json) for r in json_out.search_json(result, per_document=5).collect()]
    assert sum(len(d.get("related", ())) for d in pieces) == total
    assert sum(d["qualified_name"] == "n000" for d in pieces) > 3


def test_explain(spark):
    nodes = [("Function", "m::f", "f", None), ("Function", "m::g", "g", None), ("Module", "m", "m", None)]
    edges = [
        ("Function", "m::f", "Function", "m::g", "CALLS"),
        ("Module", "m", "Function", "m::f", "CONTAINS"),
        ("Function", "m::f", "Module", "m", "IMPORTS"),
        ("Function", "m::f", "Function", "m::f", "CALLS"),
        ("Module", "m", "Enum", "m::gone", "USES_TYPE"),
    ]
    graph = KnowledgeGraph(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE))
    targets = spark.createDataFrame([("m::f",), ("m::gone",), ("no::such",)], "qualified_name string")
    context = hybrid.explain(graph, targets)
    assert {(r.name, r.qualified_name, r.kind) for r in context.heads.collect()} == {
        ("f", "m::f", "Function"),
        ("gone", "m::gone", "Module"),
        ("such", "no::such", "Unknown"),
    }
    assert sorted((r.target, r.section, r.qualified_name, r.direction) for r in context.edges.collect()) == [
        ("m::f", "callees", "m::f", "out"),
        ("m::f", "callees", "m::g", "out"),
        ("m::f", "callers", "m::f", "in"),
        ("m::f", "dependencies", "m", "out"),
        ("m::gone", "dependents", "m", "in"),
    ]
    assert {(r.target, r.qualified_name) for r in context.similar.where("source = 'Vector'").collect()} == {("m::f", "m::f")}


def test_empty_inputs_end(spark, nodes):
    graph = KnowledgeGraph(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges_of(nodes), EDGE))
    schema = "query_id long, text string, vector array<double>"
    assert hybrid.search(graph, spark.createDataFrame([], schema), 5).results.count() == 0
    nothing = hybrid.search(graph, spark.createDataFrame([(1, "no such name", None)], schema), 5)
    assert nothing.results.count() == 0 and nothing.related.count() == 0
    empty = KnowledgeGraph(graph.entities.limit(0), graph.relationships.limit(0))
    assert hybrid.search(empty, spark.createDataFrame([(1, "n", [1.0] * 8)], schema), 5).results.count() == 0
    asked = "pair_id long, from_qn string, to_qn string"
    assert traverse.shortest_paths(graph, spark.createDataFrame([], asked)).count() == 0
    assert traverse.shortest_paths(graph, spark.createDataFrame([(1, "absent", "n001")], asked)).count() == 0
    assert traverse.shortest_paths(empty, spark.createDataFrame([(1, "n000", "n001")], asked)).count() == 0
    none = spark.createDataFrame([], "qualified_name string")
    assert traverse.neighbors(graph, none, 2, "both").count() == 0
    assert hybrid.explain(graph, none).heads.count() == 0
