"""Operators on single texts against the libraries, brute force or held-out accuracy."""

import collections
import math
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphweft.llm import attention, byte_bpe, language_id, lm_scoring, mixing, quality_classifier, quality_rules, token_counts
from tests.llm import brute

ODD = [
    None, "", " ", "\n\n  x\t", "it's don't 'S", "a <|endoftext|> b<|endoftext|>", "\u0085a​b　c\xa0 ", "٣४5²½ⅷ ʰ ꟊ", "𝒳🫨é é",
    "a" * 4000, " " * 300 + "x", "ab" * 2000, "thheanond " * 50, "\x1c\x1d x\x00y",
]


@pytest.fixture(scope="module")
def odd(docs_of):
    rng = random.Random(5)
    noise = ["".join(chr(rng.choice((rng.randrange(1, 0xD800), rng.randrange(1, 700)))) for _ in range(600)) for _ in range(5)]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(ODD + noise)]
    return rows + [(None, "null id"), (3, rows[3][1]), (3, rows[3][1])]


def test_byte_bpe(docs_of, odd):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks, table = byte_bpe.vocabulary(path)
    assert sorted(table.values) == sorted(ranks.values()) and all(table.get(k) == v for k, v in ranks.items())
    assert table.get(b"no such token at all") is None
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = byte_bpe.decode(byte_bpe.encode(docs_of(*odd), path, P.PATTERN), path).collect()
    assert len(rows) == len(odd)
    for r in rows:
        assert r["ids"] == library.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    assert byte_bpe.encode(docs_of(*odd).limit(0), path, P.PATTERN).count() == 0


def test_token_counts(docs_of, odd):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = token_counts.count_tokens(docs_of(*odd), path, P.PATTERN, limit=100).collect()
    texts = [t or "" for _, t, *_ in odd]
    want = [(i, len(t.encode()), n := len(library.encode(t, add_special_tokens=False)), n > 100) for (i, *_), t in zip(odd, texts, strict=True)]
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))


def test_quality_rules(docs_of, odd):
    good = "\n".join(" ".join(f"word{i}x{j}" for j in range(12)) for i in range(6))
    rows = [*odd, (50, good), (51, good + "\n" + good), (52, good.replace(" ", " # ")), (53, "a b c d e f g h i j k l"), (54, "Lorem ipsum " + good)]
    rows += [(55, "one two three four five six " * 9), (56, good + " p q r s t u p q r s t v")]
    got = {str(tuple(r)) for r in quality_rules.judged(docs_of(*rows)).collect()}
    want, kept = set(), {}
    for doc_id, text, *_ in rows:
        text = text or ""
        w, lines = brute.words(text, lower=False), [x for x in text.split("\n") if brute.words(x)]
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        twice = {g for g, n in collections.Counter(grams).items() if n > 1}
        inside = {j for i, g in enumerate(grams) if g in twice for j in range(i, i + 5)}
        chars, symbols, dup = sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines))
        failed = len(w) < 10 or 100 * len(inside) > 20 * len(w)
        bad = 10 * symbols > len(w) or chars < 2 * len(w) or chars > 15 * len(w) or 10 * dup > 3 * len(lines) or "lorem ipsum" in text.lower()
        kept[doc_id] = not (failed or bad)
        want.add(str((doc_id, len(w), chars, symbols, dup, len(inside), failed, kept[doc_id])))
    assert got == want
    assert kept[50] and not kept[51] and not kept[52] and not kept[53] and not kept[54] and not kept[55]
    assert quality_rules.judged(docs_of(*rows).limit(0)).count() == 0


def test_mixing(docs_of):
    rng = random.Random(8)
    sizes = {"big": 300, "mid": 40, "low": 6, None: 25, "Zed": 12}
    rows = [(i, " ".join("w" * rng.randrange(1, 5) for _ in range(rng.randrange(0, 60))), s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    rows += [(None, "a b c", "mid"), (2, None, "big"), (2, "x y", "big"), (2, "x y", "big"), (9999, "", "empty")]
    df = docs_of(*rows)
    got = mixing.taken(df).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.taken(df).collect()), key=str)
    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, s))
    total = {n: sum(len(brute.words(t)) for _, t, s in rows if s == n) for n in names}
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    full: set = set()
    while True:
        rest = sum(total.values()) - sum(3 * total[n] for n in full)
        w = sum(weight[n] for n in names if n not in full)
        aim = {n: 3 * total[n] if n in full else rest * weight[n] / w for n in names}
        over = {n for n in names if aim[n] > 3 * total[n]}
        if not over:
            break
        full |= over
    source = collections.defaultdict(list)
    for r in rows:
        source[(r[0], len(brute.words(r[1])))].append(r[2])
    taken = collections.Counter()
    for r in got:
        name = source[(r["doc_id"], r["size"])][0]
        assert r["source_size"] == total[name] and r["target"] == pytest.approx(aim[name]) and r["taken"] <= 3 * r["size"]
        taken[name] += r["taken"]
    for n in names:
        assert abs(taken[n] - aim[n]) <= 0.01 * aim[n] + 8
    assert mixing.taken(df.limit(0)).count() == 0


def test_schedule_is_even_at_every_length(docs_of):
    rows = [(i, "w " * 20, f"s{i % 4}") for i in range(200)]
    _, aims, pieces = mixing.mix(docs_of(*rows))
    share = {r["source"]: r["target"] / 4000 for r in aims.collect()}
    order = [f"s{r['row_source']}" for r in pieces.select("slot", F.col("sid").alias("row_source")).orderBy("slot").collect()]
    seen = collections.Counter()
    names = sorted(share)
    for t, s in enumerate(order, 1):
        seen[names[int(s[1:]) - 1]] += 1
        assert all(abs(seen[n] - t * share[n]) <= 3 + 2 * math.log2(t + 1) for n in names)


@pytest.fixture(scope="module")
def tongues():
    parts = {"aa": ["thon", "ed", "ing", "the"], "bb": ["ung", "heit", "der", "ß"], "cc": ["ción", "os", "ar", "ñ"]}
    rng = random.Random(1)
    word = lambda lang: "".join(rng.choice(parts[lang]) for _ in range(3))
    return [(i, " ".join(word(lang) for _ in range(rng.randrange(4, 60))), lang) for i, lang in enumerate(rng.choices(list(parts), k=300))]


def test_language_id(spark, tongues):
    rows = [(i, t, lang if i % 3 else None, None, None, f"h{i % 7}.site.org", "a", 1.0) for i, t, lang in tongues]
    rows += [(900, None, None, "aa", None, None, "a", 1.0), (901, "", None, None, "bb", "x", "a", 1.0), (902, "123 456", None, None, None, None, "a", 1.0)]
    rows += [(i, t, lang, "aa", None, None, "a", 1.0) for i, t, lang in [(903, tongues[0][1], None)] * 2]
    df = spark.createDataFrame(rows, "id long, text string, known string, declared string, address string, host string, first string, posterior double")
    got = language_id.identify(df).collect()
    assert len(got) == len(rows)
    truth = {i: lang for i, _, lang in tongues}
    held = [r for r in got if r["id"] in truth and r["id"] % 3 == 0]
    assert sum(r["found"] == truth[r["id"]] for r in held) >= 0.95 * len(held)
    assert all(r["accepted"] for r in held)
    odd = {r["id"]: r for r in got if r["id"] >= 900}
    assert not any(odd[i]["accepted"] for i in (900, 901, 902)) and odd[900]["found"] == "aa" and odd[901]["found"] == "bb"
    none = language_id.identify(df.withColumn("known", F.lit(None).cast("string"))).collect()
    assert all(r["found"] is None and not r["accepted"] for r in none)
    assert language_id.identify(df.limit(0)).count() == 0


def test_host_priors_decide_what_the_text_does_not(spark, tongues):
    rows = [(i, t, lang, None, None, {"aa": "a.one.org", "bb": "b.two.org", "cc": "c.two.org"}[lang]) for i, t, lang in tongues]
    rows += [(900, "x", None, None, None, "a.one.org"), (901, "x", None, None, None, "b.two.org")]
    df = spark.createDataFrame(rows, "id long, text string, known string, declared string, address string, host string")
    got = {r["id"]: r["found"] for r in language_id.identify(df).where("id >= 900").collect()}
    assert got == {900: "aa", 901: "bb"}


def test_addresses(spark):
    df = spark.createDataFrame([("https://Blog.a.example.de/en/12.html?x", '<HTML class=x LANG="fr-FR">'), ("http://b.fr", "<html>"), ("nonsense", None)], "url string, html string")
    host, code = language_id.address_parts(F.col("url"))
    got = [tuple(r) for r in df.select(host, code, language_id.markup_language(F.col("html"))).collect()]
    assert got == [("blog.a.example.de", "en", "fr"), ("b.fr", "fr", None), (None, None, None)]


def test_classifier(spark, docs_of):
    rng = random.Random(6)
    plain = [f"n{i}" for i in range(300)]

    def text(grade):
        out = [rng.choice(plain) for _ in range(rng.randrange(20, 120))]
        for _ in range(4 if grade == 1 else 0):
            out.insert(rng.randrange(len(out)), rng.choice(("idiot,", "Scum", "moron!")))
        return " ".join(f"{w}###" if grade == 0 else w for w in out)

    grades = [rng.choice((0, 1, 2, 2, 2)) for _ in range(900)]
    rows = [(i, text(g)) for i, g in enumerate(grades)] + [(5000, None), (5001, ""), (None, "n1 n2")]
    rated = spark.createDataFrame([(i, g) for i, g in enumerate(grades) if i % 2] + [(7, None), (None, 1), (123456, 2)], "doc_id long, grade int")
    got = {r["doc_id"]: r for r in quality_classifier.graded(docs_of(*rows), rated).collect()}
    assert len(got) == len(rows)
    held = [i for i in range(0, 900, 2)]
    right = sum(got[i]["kept"] == (grades[i] == 2) for i in held)
    assert right >= 0.9 * len(held)
    mean = [np.mean([got[i]["expected_grade"] for i in held if grades[i] == g]) for g in range(3)]
    assert mean == sorted(mean)
    none = quality_classifier.graded(docs_of(*rows), rated.limit(0)).collect()
    assert all(r["kept"] and r["expected_grade"] is None for r in none)


def test_thresholds_are_ordered():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 50, 9)).astype(np.int32) for _ in range(200)]
    model = quality_classifier.CumulativeLink.fit(rows, rng.integers(0, 4, 200))
    assert (np.diff(model.thresholds) > 0).all() and (np.diff(model.tails(rows), axis=1) <= 0).all()


def _slow_score(model, before, ids):
    """One target at a time, by loops."""
    q, k, v, own = model.tables()
    out = []
    for t in range(len(ids)):
        start = t // attention.STRIDE * attention.STRIDE - (attention.WINDOW - attention.STRIDE)
        places = range(max(0, start), t + 1)
        s = np.array([float(q[before[t]] @ k[before[p]]) + model.near[t - p] for p in places])
        a = np.exp(s - s.max())
        mixed = sum(w * v[before[p]].astype(float) for w, p in zip(a / a.sum(), places, strict=True))
        logits = own[before[t]] + mixed @ model.out
        logits = logits - logits.max()
        out.append((logits[model.group[ids[t]]] - np.log(np.exp(logits).sum())) / np.log(10) + model.inside[ids[t]])
    return np.array(out)


def test_attention_scores_each_token_once():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 50, 300)
    sizes = np.array([1, 5, 12, 13, 24, 25, 100])
    ids = rng.integers(0, 300, sizes.sum()).astype(np.int32)
    before = lm_scoring._before(ids, sizes, 299)
    model = attention.train(counts, before, ids, sizes, epochs=1)
    got = attention.Scorer(model).score(before, ids, sizes, batch=3)
    first = np.cumsum(sizes) - sizes
    want = np.concatenate([_slow_score(model, before[a : a + n], ids[a : a + n]) for a, n in zip(first, sizes, strict=True)])
    assert np.allclose(got, want, atol=1e-4)
    sees, seen, targets = attention.windows(sizes)
    places = sees[:, attention.WINDOW - attention.STRIDE :][targets]
    assert sorted(places.tolist()) == list(range(sizes.sum()))
    # the chances of all ids sum to one after any context
    q = np.arange(300, dtype=np.int32)
    tail = np.concatenate([np.append(before[:9], b) for b in [before[9]] * 300])
    last = attention.Scorer(model).score(tail, np.concatenate([np.append(ids[:9], i) for i in q]).astype(np.int32), np.full(300, 10))[9::10]
    assert (10**last).sum() == pytest.approx(1, abs=1e-4)


def test_attention_gradients_learn_order():
    sizes = np.full(60, 50)
    ids = np.concatenate([(np.arange(50) + s) % 10 for s in range(60)]).astype(np.int32)
    counts = np.bincount(ids, minlength=11)
    before = lm_scoring._before(ids, sizes, 10)
    flat = np.log10((counts + 1) / (counts + 1).sum())[ids].mean()
    model = attention.train(counts, before, ids, sizes, epochs=6, batch=16)
    assert attention.Scorer(model).score(before, ids, sizes).mean() > flat / 4


def test_lm_scoring(docs_of, odd):
    rng = random.Random(3)
    rows = [*odd, *((100 + i, " ".join(rng.choice(("The", "of", "and", f"w{rng.randrange(60)}")) for _ in range(30))) for i in range(60))]
    got = lm_scoring.score(docs_of(*rows), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    counts = collections.Counter(w for i, t, *_ in rows if not held(i) for w in [*brute.words(t), None])
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t, *_ in rows:
        w = [*brute.words(t), None]
        want.append((str(i), held(i), len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)))
    have = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got)
    for a, b in zip(have, sorted(want), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5])
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert lm_scoring.score(docs_of(*rows).limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_lm_learns_from_all_texts_to_their_end(docs_of, monkeypatch):
    seen = collections.Counter()
    table = lm_scoring.Subwords(*(np.empty(0, np.int64),) * 2, [], open(P.path("byte_bpe_50k.tiktoken"), "rb").read(), P.PATTERN, 50_500)
    monkeypatch.setattr(attention.Fit, "_step", lambda self, x, wanted, real, goal: seen.update(wanted[goal].tolist()))
    texts = ["the " * 3000 + "zebra", *(["a short one"] * 2500)]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    model = attention.Model.start(np.ones(50_501, np.int64))
    assert list(lm_scoring._fitted(table, model)([batch])) == []
    zebra, the = (table.encoded([w])[0].tolist() for w in ("zebra", "the"))
    assert all(seen[i] == 1 for i in zebra) and all(seen[i] == 3000 for i in the) and seen[50_500] == len(texts)


def _slow_loss(model, x, wanted, seen, goal):
    """Mean natural-log loss of the targets of some windows, by loops in double precision."""
    m = {n: getattr(model, n).astype(float) for n in ("embed", *attention.DENSE)}
    total = 0.0
    for w, j in zip(*np.nonzero(goal), strict=True):
        t = attention.WINDOW - attention.STRIDE + j
        places = [p for p in range(t + 1) if seen[w, p]]
        e = m["embed"][x[w]]
        s = np.array([e[t] @ m["query"] @ (e[p] @ m["key"]) / math.sqrt(attention.WIDTH) + m["near"][t - p] for p in places])
        a = np.exp(s - s.max())
        mixed = (a / a.sum()) @ e[places] @ m["value"]
        logits = (e[t] + mixed) @ m["out"] + m["bias"]
        total += logits.max() + math.log(np.exp(logits - logits.max()).sum()) - logits[model.group[wanted[w, j]]]
    return total / goal.sum()


@pytest.mark.parametrize("scale", [1, 40])  # 40: scores too large for exp as they are
def test_attention_gradients_are_those_of_the_loss(scale, monkeypatch):
    rng = np.random.default_rng(8)
    model = attention.Model.start(rng.integers(0, 50, 60))
    model.query *= scale
    model.near[:] = rng.standard_normal(attention.WINDOW)
    sizes = np.array([5, 30, 1])
    ids = rng.integers(0, 60, sizes.sum()).astype(np.int32)
    before = lm_scoring._before(ids, sizes, 59)
    sees, seen, goal = attention.windows(sizes)
    x, wanted = before[sees], ids[sees[:, attention.WINDOW - attention.STRIDE :]]
    given = []
    monkeypatch.setattr(attention.Fit, "_move", lambda self, m, s, grad, steps: given.append(grad.copy()) or np.zeros_like(grad))
    attention.Fit(model)._step(x, wanted, seen, goal)
    dense, by_id = given
    own = np.unique(x)
    got = attention._parts(model, dense) | {"embed": np.zeros_like(model.embed)}
    got["embed"][own] = by_id
    for n, grad in got.items():
        weights = getattr(model, n).astype(float)
        for at in rng.choice(own if n == "embed" else len(weights), 4):
            at = (at, *(rng.integers(k) for k in weights.shape[1:]))
            sides = []
            for step in (1e-5, -1e-5):
                other = weights.copy()
                other[at] += step
                sides.append(_slow_loss(attention.replace(model, **{n: other}), x, wanted, seen, goal))
            assert grad[at] == pytest.approx((sides[0] - sides[1]) / 2e-5, rel=2e-2, abs=2e-5 * scale), (n, at)


def test_lm_words_encoded_together_are_as_alone():
    ranks = open(P.path("byte_bpe_50k.tiktoken"), "rb").read()
    words = ["a", "don't", "'s", "x\u00a0", "\u00a0y", "\u2003", "1st", "\u0085", "—…", "🙂", "zé", "x\x1cy", "'", "last\u3000", "end"]
    encode = lm_scoring._encoder(ranks, P.PATTERN).encode_ordinary
    for some in (words, words[::-1], words[3:4], [], ["plain", "words"]):
        ids, sizes = lm_scoring.Speller(ranks, P.PATTERN).ids(some)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])][: len(some)] == [encode(" " + w) for w in some]


def test_lm_learns_and_scores_from_ids_kept_once(docs_of, monkeypatch):
    table = lm_scoring.Subwords(np.empty(0, np.int64), np.empty(0, np.int64), [], open(P.path("byte_bpe_50k.tiktoken"), "rb").read(), P.PATTERN, 50_256)
    texts = ["One two", None, "", "é\u00a0 x", "w " * 1_200_000, *(f"text {i}" for i in range(40))]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})
    # one batch, as it is read again
    parts = list(lm_scoring._coded(table, 3)([batch]))
    kept = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    assert len(parts) > 1 and kept.num_rows == len(texts)
    for (a, b), (c, d) in zip(lm_scoring._kept_ids(table, kept), lm_scoring._kept_ids(table, batch), strict=True):
        assert a.tolist() == c.tolist() and b.tolist() == d.tolist()

    def fitted(table, model, real=lm_scoring._fitted):
        def run(batches):
            def checked():
                for batch in batches:
                    assert "ids" in batch.schema.names and "text" not in batch.schema.names
                    yield batch

            yield from real(table, model)(checked())

        return run

    monkeypatch.setattr(lm_scoring, "_fitted", fitted)
    got = lm_scoring.score(docs_of(*enumerate(texts[:4] + texts[5:])), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert len(got) == len(texts) - 1 and all(r["score"] < 0 for r in got)


def test_averaged_weights():
    model = attention.Model.start(np.ones(50, np.int64))
    rng, rows, want = np.random.default_rng(4), [], []
    for n in (3, 40):
        fit = attention.Fit(model, batch=8)
        ids = rng.integers(0, n + 9, 30 * n)
        fit.learn(np.append(49, ids[:-1]), ids, np.full(n, 30))
        rows += attention.packed(fit, lm_scoring.CHUNK_IDS)
        want.append(fit)
    means = [tuple(r.values()) for b in lm_scoring._averages([lm_scoring._chunks(rows)]) for r in b.to_pylist()]
    got = attention.averaged(model, means, lm_scoring.CHUNK_IDS)
    a, b = want
    met = np.stack([a.met, b.met]).astype(float)
    for i in range(50):
        each = (a.model.embed[i], b.model.embed[i])
        assert np.allclose(got.embed[i], np.average(each, 0, met[:, i]) if met[:, i].any() else model.embed[i], atol=1e-6)
    assert np.allclose(got.out, np.average([a.model.out, b.model.out], 0, [a.windows, b.windows]), atol=1e-6)
