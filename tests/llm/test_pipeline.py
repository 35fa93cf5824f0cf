"""The pipeline's stages, each on what the one before it kept, against brute force."""

import random

import public_tokenizers as P

import corpus_pipeline
from graphweft.llm import byte_bpe, mixing
from tests.llm import brute


def _corpus(rng):
    parts = {"aa": ["thon", "ed", "ing", "the", "re"], "bb": ["ung", "heit", "der", "ß", "en"]}
    word = lambda lang: "".join(rng.choice(parts[lang]) for _ in range(4))
    text = lambda lang, n: " ".join(word(lang) for _ in range(n))
    rows = []
    for i in range(60):
        lang = rng.choice(list(parts))
        rows.append((i, "\n".join(text(lang, 40) for _ in range(3)), lang, f"s{i % 3}", 1))
    for i in range(6):  # near copies of the first ones
        words = rows[i][1].split(" ")
        words[10] = "changed"
        rows.append((100 + i, " ".join(words), rows[i][2], "s0", 1))
    rows += [(200, rows[9][1], rows[9][2], "s1", 1), (201, rows[9][1], rows[9][2], None, 1), (202, None, "aa", "s1", 1), (203, "", None, "s1", 1)]
    passage = text("aa", 70)
    rows += [(300 + i, text("aa", 35) + " " + passage + " " + text("aa", 35), "aa", "s2", 1) for i in range(3)]
    return rows, passage


def test_stages(spark, tmp_path):
    rows, passage = _corpus(random.Random(4))
    sf_dir = str(tmp_path)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{sf_dir}/documents.parquet")
    pages = [(1, "http://a.b.org/aa/3.html", '<html lang="aa">'), (2, "nonsense", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{sf_dir}/pages.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = {}
    for name, stage in stages.items():
        stage(spark, docs, sf_dir).write.parquet(f"{sf_dir}/{name}")
        docs = spark.read.parquet(f"{sf_dir}/{name}")
        kept[name] = docs.collect()
        if name != "byte_bpe":
            assert docs.columns == corpus_pipeline.COLUMNS
            assert all(r["n_chars"] == len(r["text"]) for r in kept[name])

    by_id = {r[0]: r for r in rows}
    first = kept["language_id"]
    assert sorted(r["doc_id"] for r in first) == sorted(i for i in by_id if i not in (202, 203))
    assert all(r["lang"] == by_id[r["doc_id"]][2] for r in first)

    sets = [brute.shingles(brute.words(r["text"]), 5) for r in first]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    part = brute.components(len(sets), links)
    least = {}
    for r, p in zip(first, part, strict=True):
        least[p] = min(least.get(p, r["doc_id"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in kept["near_copies"]) == sorted(least.values())

    third = {r["doc_id"]: r["text"] for r in kept["substring_dedup"]}
    assert set(third) == set(least.values())
    assert all(third[i] == by_id[i][1] for i in third if i < 60)
    assert sum(len(set(passage.split()) & set(t.split())) > 50 for i, t in third.items() if i >= 300) == 1

    wanted = {r["doc_id"]: r["taken"] for r in mixing.taken(spark.read.parquet(f"{sf_dir}/substring_dedup")).collect()}
    got = {}
    for r in kept["source_mix"]:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(brute.words(r["text"]))
        assert brute.words(third[r["doc_id"]])[: len(brute.words(r["text"]))] == brute.words(r["text"])
    assert got == {i: n for i, n in wanted.items() if n}

    import tiktoken

    from graphweft.llm import byte_bpe

    ranks, _ = byte_bpe.vocabulary(P.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in kept["byte_bpe"])
    assert sorted((r["doc_id"], r["ids"]) for r in kept["byte_bpe"]) == sorted((r["doc_id"], library.encode_ordinary(r["text"])) for r in kept["source_mix"])


def test_ids_are_made_and_decoded_in_one_pass(spark):
    docs = spark.createDataFrame([(1, "one Two"), (2, None), (3, "ß\n x")], "doc_id long, text string")
    path = P.path("byte_bpe_50k.tiktoken")
    both = byte_bpe.encode_decode(docs, path, P.PATTERN)
    assert both.collect() == byte_bpe.decode(byte_bpe.encode(docs, path, P.PATTERN), path).collect()
    coded = corpus_pipeline.encode_texts(spark, docs.selectExpr("*", "'' AS lang", "'' AS source", "1L AS n_chars"), "")
    assert coded._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_texts_are_matched_in_one_shuffle(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "c"), (None, "c"), (0, "c"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = docs.where("text = 'a' OR doc_id IS NULL OR text IS NULL").selectExpr("doc_id", "xxhash64(text) AS mark").distinct()
    out = corpus_pipeline._matching(docs, kept)
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == [(1, "a"), (2, None), (None, "c")]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = corpus_pipeline._matching(docs, kept)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    # one of the texts, and two of ``kept``: that of its distinct() and that of the join
    assert plan.count("Exchange hashpartitioning") == 3
