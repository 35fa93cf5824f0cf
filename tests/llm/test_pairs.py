"""Operators on pairs against brute force: vectors, texts, paragraphs, components."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from graphweft.llm import linking, ngram_join, substring_dedup, vector_dedup
from graphweft.llm.components import components
from graphweft.llm.words import shingles
from graphweft.session import Scratch
from tests.llm import brute


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 101 + i) for i in range(50)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    edges += edges[:5] + [(7, 7)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    want = brute.components(301, [e for e in edges])
    groups = {}
    for i, c in got.items():
        groups.setdefault(c, set()).add(want[i])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({want[i] for i in got})
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


def _variants(rng, n, size):
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.choice(size))]
        rows.append(base)
        for share in (0, 0.003, 0.01, 0.02, 0.03, 0.05):
            rows.append([rng.choice(vocabulary) if rng.random() < share else w for w in base])
    return [" ".join(r) for r in rows]


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_ngram_join(docs_of, k, num):
    rng = random.Random(k)
    texts = _variants(rng, 12, (2, 3, 8, 15, 40, 200, 900)) + [None, "", "  \n ", "One", "one", "a b", "A  B", "x " * 500, "x " * 900]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(None, "null id " * 5), (3, texts[1]), (3, texts[1])]
    got = {}
    for r in ngram_join.similar_texts(docs_of(*rows), k, num, 100).collect():
        got.setdefault((r["doc_id"], r["n_shingles"]), []).append(r["component_id"])
    sets = [brute.shingles(brute.words(t), k) for _, t in rows]
    links = [
        (a, b) for a in range(len(rows)) for b in range(a) if (u := len(sets[a] | sets[b])) and 100 * len(sets[a] & sets[b]) >= num * u
    ]
    part, want, least = brute.components(len(rows), links), {}, {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[part[i]] = min(least.get(part[i], doc_id), doc_id)
    for i, (doc_id, _) in enumerate(rows):
        want.setdefault((doc_id, len(sets[i])), []).append(least.get(part[i]))
    assert {x: sorted(map(str, y)) for x, y in got.items()} == {x: sorted(map(str, y)) for x, y in want.items()}


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_one_word_more_shares_a_cell(k, num):
    rng = np.random.default_rng(k)
    for n in range(3, 121):
        words = rng.integers(0, 2**63, n + 2, dtype=np.uint64)
        whole = words[1:-1]
        own = np.unique(shingles(whole, k))
        for other in (words[1:], words[:-1], words):
            more = np.unique(shingles(other, k))
            both = len(np.intersect1d(own, more))
            if 100 * both >= num * (len(own) + len(more) - both):
                assert np.intersect1d(ngram_join.set_cells(own, num, 100), ngram_join.set_cells(more, num, 100)).size, (n, len(other))


@pytest.mark.parametrize("num", [80, 90])
def test_more_ranges_than_differences(num):
    for most in range(1, 2000):
        n = np.arange(max(1, -(-num * most // 100)), most + 1)
        for total in (n + most, 2 * n):
            need = linking.least_overlap(total, num, 100)
            assert ngram_join._differences(most, num, 100) >= (total - 2 * need).max()


@pytest.mark.parametrize(("num", "sizes"), [(80, (5, 12, 30, 90, 200, 400)), (90, (10, 20, 60, 150, 400, 700))])
def test_pairs_at_the_threshold_meet_with_near_sketches(num, sizes):
    rng = np.random.default_rng(num)
    for n in sizes:
        for _ in range(150):
            more = int(rng.integers(0, 100 * n // num - n + 1))  # the larger set has so many members more
            total = 2 * n + more
            both = linking.least_overlap(np.array(total), num, 100)
            items = rng.integers(0, 2**62, total - both).astype(np.uint64)
            x, y = np.sort(items[:n]), np.sort(items[n - both :])
            words = np.concatenate([ngram_join.set_words(v, num, 100) for v in (x, y)])
            uids = np.repeat([1, 2], [len(ngram_join.set_words(v, num, 100)) for v in (x, y)])
            assert set(linking.sharing(words, uids)[1].tolist()) == {1, 2}, (n, more)
            assert linking.least_apart(linking.parities(x), linking.parities(y)) <= total - 2 * both


def test_unlike_members_of_a_cell_do_not_stay():
    cell = np.uint64(77 << linking.SKETCH_BITS)
    words = cell | np.array([0b1, 0b11, 0xFFFF00, 0x0FF000, 0x3], np.uint64)
    cells, uids, least, more = linking.sharing(np.append(words, np.uint64(1 << 40)), np.array([5, 3, 8, 9, 4, 1]))
    assert sorted(zip(uids.tolist(), least.tolist(), more.tolist())) == [(3, 4, True), (4, 3, True), (5, 3, True)] and set(cells.tolist()) == {77}
    same = linking.sharing(np.full(4000, cell), np.arange(4000)[::-1])
    assert dict(zip(same[1].tolist(), same[2].tolist())) == {0: 1} | {i: 0 for i in range(1, 4000)} and same[3].all()
    assert len(linking.sharing(np.full(3, cell), np.full(3, 6))[1]) == 0 and len(linking.sharing(words[:0], np.arange(0))[1]) == 0


def test_few_of_unlike_texts_are_taken_for_candidates():
    # texts of the same few common passages and else unlike: nearly all used to stay in cells
    rng = np.random.default_rng(6)
    common = rng.integers(0, 2**62, 40).astype(np.uint64)
    sets = [np.unique(np.concatenate([common, rng.integers(0, 2**62, 300).astype(np.uint64)])) for _ in range(200)]
    words = [ngram_join.set_words(s, 80, 100) for s in sets]
    flat, uids = np.concatenate(words), np.repeat(np.arange(200), [len(w) for w in words])
    _, at, n = np.unique(flat >> np.uint64(linking.SKETCH_BITS), return_inverse=True, return_counts=True)
    shared = int((n[at] > 1).sum())
    assert shared > 500 and len(linking.sharing(flat, uids)[1]) < shared / 20


def test_ngram_join_of_nothing(docs_of):
    assert ngram_join.similar_texts(docs_of().limit(0)).count() == 0


def test_bounds_lose_nothing():
    rng = np.random.default_rng(4)
    sets = []
    for n in (12, 90, 700, 6000):
        base = np.unique(rng.integers(0, 2**62, n).astype(np.uint64))
        for share in (0, 0.02, 0.05, 0.08, 0.1) * 3:
            x = base.copy()
            x[rng.random(len(x)) < share] ^= np.uint64(12345)
            sets.append(np.unique(x))
    sizes, parts = np.array([len(s) for s in sets]), np.arange(len(sets))
    points = [linking.point(s).tobytes() for s in sets]
    table = linking.folded(points, min(map(len, points)))
    tree = {tuple(sorted(p)) for p in linking.bounded_pairs(table, sizes, parts, 90, 100).tolist()}
    small = {tuple(p) for p in linking._small_pairs(table, sizes, parts, np.array([0, len(sets)]), 90, 100).tolist()}
    true = {(a, b) for b in range(len(sets)) for a in range(b) if linking._overlaps(sets[a], sets[b], 90, 100)}
    assert true <= tree and tree == small


def test_vectors(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(160):
        v = rng.standard_normal(16)
        rows.append((i * 5, v.tolist(), i % 3))
        for near in (0.05, 0.2, 0.4):
            rows.append((i * 5 + 1 + int(near * 9), (v * rng.uniform(0.1, 9) + near * rng.standard_normal(16)).tolist(), i % 3))
    one = rng.standard_normal(16).tolist()
    odd = [None, [], [0.0] * 16, [float("nan"), *one[1:]], [float("inf"), *one[1:]], [None, *one[1:]], one[:7], one[:7]]
    rows += [(9000 + i, v, 1) for i, v in enumerate(odd)] + [(9100, one, None), (9101, one, None), (9102, one, 1), (9102, one, 1), (None, one, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumnRenamed("x", "y")
    got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in vector_dedup.duplicates(df).collect())

    def usable(v, label):
        return label is not None and bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    links = []
    for a, (_, v, x) in enumerate(rows):
        for b, (_, w, y) in enumerate(rows[:a]):
            if usable(v, x) and usable(w, y) and x == y and len(v) == len(w):
                if np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93:
                    links.append((a, b))
    part, n, least = brute.components(len(rows), links), [0] * len(rows), {}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[part[i]] = min(least.get(part[i], r[0]), r[0])
    want = sorted((str(r[0]), n[i], c := least.get(part[i]), True if c is None or r[0] is None and c is None else r[0] == c if r[0] is not None else True) for i, r in enumerate(rows))
    assert got == want
    assert vector_dedup.duplicates(df.limit(0)).count() == 0


def _text(rng, n):
    return " ".join(f"{rng.choice('abcdef')}{rng.randrange(5000)}" for _ in range(n))


def test_repeated_spans(docs_of):
    rng = random.Random(9)
    passage, line = _text(rng, 60), _text(rng, 40)
    near = line.split()
    near[1] = "changed"
    rows = [(i, "\n".join(_text(rng, 50) for _ in range(3))) for i in range(20)]
    rows += [(100 + i, _text(rng, 33) + " " + passage + " " + _text(rng, 41)) for i in range(3)]
    rows += [(200, line + "\n" + _text(rng, 30)), (201, _text(rng, 45) + "\n" + " ".join(near)), (202, None), (203, ""), (204, "short line")]
    rows += [(300, rows[0][1]), (300, rows[0][1])]
    df = docs_of(*rows)
    found = substring_dedup.repeated_spans(df).collect()
    flagged = {r["doc_id"] for r in found}
    assert flagged == {0, 100, 101, 102, 200, 201, 300}
    assert {r["doc_id"] for r in found if r["kind"] == "paragraph" and not r["removed"]} >= {0, 200}
    by_id = dict(rows)
    for r in found:
        span = by_id[r["doc_id"]].encode()[r["begin"] : r["end"]].decode()
        assert len(span.split()) == r["n_words"] >= substring_dedup.LEAST_WORDS
    assert sum({r["removed"] for r in found if r["doc_id"] == d} == {True} for d in (100, 101, 102)) == 2
    kept = {(r["doc_id"], r["text"]) for r in substring_dedup.without_repeats(df).collect()}
    clean = {(i, t) for i, t in rows if i < 20 or i in (202, 203, 204)}
    assert clean <= kept and substring_dedup.without_repeats(df).columns == df.columns
    assert sum(len(set(passage.split()) & set(t.split())) > 40 for _, t in kept if t) == 1
    assert substring_dedup.repeated_spans(df.limit(0)).count() == 0


def test_passages_are_found_from_their_first_word_to_their_last(docs_of):
    rng = random.Random(31)
    rows, planted = [], {}
    for j in range(60):
        passage = _text(rng, 30 + j)
        for copy in range(2):
            head, tail = _text(rng, rng.randrange(40)), _text(rng, rng.randrange(40))
            planted[doc_id := 2 * j + copy] = passage
            rows.append((doc_id, f"{head} {passage} {tail}".strip()))
    spans = {}
    for r in substring_dedup.repeated_spans(docs_of(*rows)).where("kind = 'passage'").collect():
        span = rows[r["doc_id"]][1].encode()[r["begin"] : r["end"]].decode()
        spans.setdefault(r["doc_id"], []).append((span, r["removed"]))
    assert spans == {d: [(p, d % 2 == 1)] for d, p in planted.items()}


def test_anchors_of_several_documents_come_out(monkeypatch):
    monkeypatch.setattr(substring_dedup, "SENT_ANCHORS", 300)
    rng = random.Random(5)
    hot = _text(rng, 40)
    texts = [_text(rng, 60) + " " + hot + " " + _text(rng, 60) for _ in range(60)] + [" ".join([_text(rng, 30)] * 4)]
    make = lambda a, z: pa.record_batch({"text": texts[a:z], "doc_id": pa.array([None if i == 7 else i for i in range(a, z)], pa.int64()), "doc": list(range(a, z))})
    parts = [[make(0, 20), make(20, 30)], [make(30, 61)]]
    rows = lambda batches: [tuple(r[c] for c in substring_dedup._ANCHOR) for b in batches for r in b.to_pylist()]
    every = rows(b for p in parts for b in substring_dedup._anchors(iter(p)))
    docs = {}
    for r in every:
        docs.setdefault(r[0], set()).add(r[2])
    sent = pa.concat_tables([pa.Table.from_batches(substring_dedup._sent_anchors(iter(p))) for p in parts])
    # a hot anchor sends few rows of its to its bucket
    assert max(len(x) for b, x in zip(sent["bucket"].to_pylist(), sent["anchor"].to_pylist()) if b >= 0) < 30 < max(map(len, docs.values()))
    got = rows(substring_dedup._met_anchors(iter(sent.sort_by("bucket").to_batches(max_chunksize=50))))
    assert sorted(got, key=str) == sorted((r for r in every if len(docs[r[0]]) > 1), key=str)


def test_short_lines_make_paragraphs(docs_of):
    rng = random.Random(8)
    wrap = lambda words, n: "\n".join(" ".join(words[a : a + n]) for a in range(0, len(words), n))
    block = _text(rng, 120).split()
    near = [w if i % 40 else "changed" for i, w in enumerate(block)]
    rows = [(1, _text(rng, 30) + "\n" + wrap(block, 9) + "\n\n" + _text(rng, 12)), (2, wrap(near, 11) + "\n \n" + wrap(_text(rng, 50).split(), 8))]
    rows += [(3, "five words make a paragraph\n\n" + _text(rng, 30)), (4, _text(rng, 30) + "\nFive words make\na paragraph"), (5, "not five words\n\n"), (6, "not five words")]
    got = {(r["doc_id"], r["begin"], r["end"], r["removed"]) for r in substring_dedup.repeated_spans(docs_of(*rows)).where("kind = 'paragraph'").collect()}
    want = {(1, wrap(block, 9), False), (2, wrap(near, 11), True), (3, "five words make a paragraph", False), (4, "Five words make\na paragraph", True)}
    by_id = dict(rows)
    assert {(d, by_id[d].encode()[a:b].decode(), gone) for d, a, b, gone in got} == want


def test_blocks_leave_no_word_out():
    text = "\n\n a b\nc\n" + "x " * 20 + "\nd e\n\t\nf\r\ng\n\n\nh"
    for _, data, words in substring_dedup.each_text(pa.array([text, "", "\n", "one"])):
        found = [substring_dedup._blocks(data, words, i, words.offsets) for i in range(4)]
    assert [(a.tolist(), n.tolist()) for a, n in found] == [([0, 3, 23, 25, 27], [3, 20, 2, 2, 1]), ([], []), ([], []), ([28], [1])]


def test_bands_reach_the_recall():
    bands, rows = substring_dedup.tuned_bands(0.8)
    assert 1 - (1 - 0.8**rows) ** bands >= substring_dedup.RECALL and bands * rows <= substring_dedup.MOST_HASHES


def test_a_set_that_heads_no_star_is_still_compared(spark):
    rng = np.random.default_rng(1)
    u = np.unique(rng.integers(0, 2**62, 100).astype(np.uint64))
    v, w = u.copy(), np.unique(rng.integers(0, 2**62, 100).astype(np.uint64))
    v[3] += np.uint64(1)
    sets = {5: u, 7: np.sort(v), 1: w}
    cells = spark.createDataFrame([(10, 5), (10, 7), (20, 1), (20, 7)], "cell long, uid long")
    held = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in sets.items()], "uid long, items binary")
    fetch = lambda uids, few: uids.join(held, "uid").select("uid", "head", "salt", "items")
    got = {r["id"]: r["component"] for r in linking.link(cells, fetch, 90, 100, Scratch(spark)).collect()}
    assert got[5] == got[7] and got.get(1, 1) != got[5]


def _workers_of_a_task(plan):
    """The most Python steps that follow one another in an optimized plan without a shuffle between."""
    most = now = 0
    for line in plan.splitlines():
        if re.search(r"Repartition|Aggregate|Join|Union|Relation|LogicalRDD|LocalRelation", line):
            now = 0
        now += "MapInArrow" in line
        most = max(most, now)
    return most


def test_a_task_of_a_join_needs_one_python_worker(docs_of, monkeypatch):
    # two Python steps in a task are four workers of an executor of two cores, which stay and keep their memory
    plans, write = [], Scratch.write_counted

    def seen(self, df, name, of=None):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return write(self, df, name, of)

    monkeypatch.setattr(Scratch, "write_counted", seen)
    monkeypatch.setattr(linking, "STARS", 1)
    rng = random.Random(3)
    base = _text(rng, 300).split()
    rows = []
    for i in range(12):  # some unlike enough to stay in other components of a cell
        words = list(base)
        for at in rng.sample(range(300), 2 * i):
            words[at] = "changed"
        rows.append((i, " ".join(words)))
    df = docs_of(*rows)
    substring_dedup.repeated_spans(df).collect()
    assert "points" in {name for name, _ in plans}
    ngram_join.similar_texts(df, k=5, num=80).collect()
    assert {name: _workers_of_a_task(plan) for name, plan in plans if _workers_of_a_task(plan) > 1} == {}


def test_only_wanted_paragraphs_are_split(monkeypatch):
    text = "one two three four five six\n\nein zwei drei vier fünf sechs sieben\n\nlast line of five words"
    raw, split = text.encode(), []
    a, z = raw.index(b"ein"), raw.index(b"sieben") + 6
    wanted = [{"uid": 7, "head": 3, "salt": 0, "begin": a, "end": z}]
    kind = pa.list_(pa.struct({"uid": pa.int64(), "head": pa.int64(), "salt": pa.int64(), "begin": pa.int64(), "end": pa.int64()}))
    batch = pa.record_batch({"text": pa.array(["x y z", text]), "wanted": pa.array([[], wanted], kind)})
    of_all = substring_dedup.each_text
    monkeypatch.setattr(substring_dedup, "each_text", lambda column: (split.append(column.to_pylist()), of_all(column))[1])
    (row,) = [r for b in substring_dedup._sets(iter([batch])) for r in b.to_pylist()]
    _, _, words = next(of_all(pa.array([raw[a:z].decode()])))
    assert (row["uid"], row["head"], row["salt"]) == (7, 3, 0)
    assert row["items"] == np.unique(shingles(words.hashes, substring_dedup.SHINGLE)).tobytes()
    assert split == [[raw[a:z]]]
