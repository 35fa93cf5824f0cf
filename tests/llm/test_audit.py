"""Source divergence and tokenizer alignment against plain statements; toxicity by distances and held-out accuracy."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from graphweft.llm import alignment, divergence, toxicity
from tests.llm.test_texts import ODD

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = {c: c + 32 for c in range(65, 91)}


def plain(rows, least, ranks):
    """rows: (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    count, texts = collections.Counter(), collections.Counter()
    for lang, source, text in rows:
        found = TERM.findall(text.translate(LOW))
        count.update((lang, source, t) for t in found)
        texts.update((lang, t) for t in set(found))
    out = []
    for lang in {r[0] for r in rows}:
        kept = [t for (x, t), n in texts.items() if x == lang and n >= least]
        sources = sorted({r[1] for r in rows if r[0] == lang})
        own = {s: {t: count[lang, s, t] for t in kept} for s in sources}
        whole = {t: sum(own[s][t] for s in sources) for t in kept}
        share = lambda c: {t: 1 + 10**9 * (n + 5) // (sum(c.values()) + 5 * len(kept)) for t, n in c.items()}
        p, q = {s: share(own[s]) for s in sources}, share(whole)
        for s in sources:
            pair = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            term = [(q[t] - p[s][t], t.encode(), t) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:ranks])):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(found)]
    return sorted(out)


def rows_of(docs, **kw):
    return sorted(tuple(r) for r in divergence.diverging(docs, **kw).select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("least, ranks", [(1, 3), (3, 50), (10**6, 5)])
def test_divergence(docs_of, least, ranks):
    rng = random.Random(3)
    words = ["The", "the", "of", "é", "Éa", "ñ𝒳", "Ω", "ab1cd", "x-y", "q\x00r", "[", "", "12", "zz\n", "ßü", "\u0085", "﻿b"]
    rows = []
    for i in range(120):
        # one source holds most rows, one has no terms, some languages have one source
        source = rng.choice(["hot"] * 8 + ["b", "c", None, "", "empty"])
        text = rng.choice([None, "", "12 !"]) if source == "empty" else " ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randrange(40)))
        rows.append((i % 50, text, source, rng.choice(["en", "en", "de", None, "", "one"])))
    rows += [(None, "lone text", "solo", "xx"), (1, "tie tie tja", "s", "yy"), (1, "tie tie tja", "s", "yy"), (2, "tja tie", "t", "yy")]
    got = rows_of(docs_of(*rows), least_texts=least, ranks=ranks)
    assert got == plain([(r[3], r[2], r[1]) for r in rows], least, ranks)
    if least == 10**6:
        assert {r[2] for r in got} == {"pair"} and {r[4] for r in got} == {0}


def test_divergence_ties_and_pieces(docs_of, monkeypatch):
    """Many terms of one value are cut in the order of their bytes; a text longer than a piece counts once for a term."""
    monkeypatch.setattr(divergence, "PIECE_BYTES", 64)
    names = ["".join(x) for x in itertools.product("abcé", repeat=4)]
    rows = [(1, " ".join(names), "a", "en"), (2, " ".join(reversed(names)) + " aaaa" * 100, "b", "en"), (3, "other", "c", "en")]
    for least in (1, 2):
        assert rows_of(docs_of(*rows), least_texts=least, ranks=7) == plain([(r[3], r[2], r[1]) for r in rows], least, 7)
    one = list(divergence._pieces((" ".join(names)).encode()))
    assert len(one) > 5 and b"".join(one).split() == " ".join(names).encode().split()


def test_divergence_empty(docs_of):
    assert divergence.diverging(docs_of((1, "a")).limit(0)).collect() == []


def plain_alignment(rows):
    """The rows of the alignment from whole texts, with the libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    letters = alignment._byte_letters()

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("\u2581", " ").encode()

    links, found = collections.Counter(), []
    for doc_id, text in rows:
        want = (" " + (text or "")).encode()
        ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)] if text else [[], []]
        raw = [[bytes(letters[c] for c in a.id_to_token(i)) for i in ids[0]], [piece(i) for i in ids[1]]]
        if b"".join(raw[0]) != want or b"".join(raw[1]) != want:
            ids = raw = [[], []]
        ends = [list(itertools.accumulate(map(len, r))) for r in raw]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        last = [dict(zip(e, i, strict=True)) for e, i in zip(ends, ids, strict=True)]
        pairs = [(last[0][c], last[1][c]) for c in cuts]
        groups, low = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for i, e in zip(ids[k], ends[k], strict=True) if low < e <= c) for k in (0, 1)))
            low = c
        links.update(pairs)
        found.append((doc_id, len(ids[0]), len(ids[1]), len(cuts), pairs, ";".join(groups)))
    best = collections.Counter()
    for (_, y), n in links.items():
        best[y] = max(best[y], n)
    return [
        (i, n_a, n_b, n, len(p), sum(links[x] == best[x[1]] for x in p), sum(links[x] for x in p), hashlib.sha256(g.encode()).hexdigest() if g else "")
        for i, n_a, n_b, n, p, g in found
    ]


@pytest.mark.parametrize("blocks", [1, 9])
def test_alignment(docs_of, blocks):
    rng = random.Random(8)
    noise = ["".join(chr(rng.choice((rng.randrange(1, 0xD800), rng.randrange(1, 700)))) for _ in range(150)) for _ in range(4)]
    texts = ODD + noise + ["a\u2581b", " lead", "trail  ", "two  blanks   in\n\n  it", "<s>x</s> <unk> <0x41>", "the same words again", "the same words again", "x" * 30]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (3, "the same words"), (3, "the same words")]
    # a partition is a block here
    got = alignment.aligned(docs_of(*rows).repartition(blocks), P.path("byte_bpe_50k.json"), P.PATTERN, P.path("piece_bpe_32k.model")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain_alignment(rows)))
    assert got[0].__fields__ == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_empty(docs_of):
    for docs in (docs_of((1, "a")).limit(0), docs_of((1, None), (2, ""))):
        rows = alignment.aligned(docs, P.path("byte_bpe_50k.json"), P.PATTERN, P.path("piece_bpe_32k.model")).collect()
        assert [tuple(r)[1:] for r in rows] == [(0, 0, 0, 0, 0, 0, "")] * len(rows)


def test_common_ends():
    """Against set intersection, for many texts at once; some without any common end but the last, some without tokens."""
    rng = np.random.default_rng(4)
    a, b, a_ranges, b_ranges, base = [], [], [0], [0], 0
    for i in range(300):
        n = int(rng.integers(0, 400)) if i % 7 else 0
        share = rng.choice([0.01, 0.3, 0.9])
        x, y = (np.flatnonzero(rng.random(n) < share) + 1 for _ in range(2))
        if i % 5 == 0 and n:
            x, y = np.arange(1, n, 2), np.arange(2, n, 2)  # no cut inside
        x, y = (np.union1d(v, [n]) if n else v[:0] for v in (x, y))
        a.append(base + x), b.append(base + y)
        a_ranges.append(a_ranges[-1] + len(x)), b_ranges.append(b_ranges[-1] + len(y))
        base += n
    a, b = np.concatenate(a), np.concatenate(b)
    at, place = alignment.common_ends(a, b, np.array(a_ranges), np.array(b_ranges))
    want = np.intersect1d(a, b)
    assert (a[at] == want).all() and (b[place] == want).all()


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, last = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(row[j] + 1, last[j + 1] + 1, last[j] + (x != y)))
    return row[-1]


def test_misspellings_against_all_distances(monkeypatch):
    rng = random.Random(6)
    entries = [("scum", True, 2.0), ("moron", True, 3.0), ("morons", True, 3.5), ("idiotic", False, 2.0), ("worthless", True, 4.0), ("disgusting", True, 4.0), ("lowe", False, 1.0), ("éclatant", False, 1.5)]
    words = [w for w, *_ in entries] + ["", "x", "lowering", "low", "idiotical", "idiotcal", "mor", "worthles", "wrothless"]
    for w in list(words) * 30:
        w = list(w)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randrange(2)] = rng.choice(["", "a", "o", "é", "1"])
        words.append("".join(w))
    for kept in (50_000, 3):
        monkeypatch.setattr(toxicity, "KEPT_STATES", kept)
        lexicon = toxicity.Lexicon(entries)
        for w in words:
            found = []
            for i, (text, whole, weight) in enumerate(entries):
                # a stem is any beginning of a word
                edits = levenshtein(text, w) if whole else min(levenshtein(text, w[:k]) for k in range(len(w) + 1))
                if edits <= toxicity.edits_borne(len(text), whole):
                    found.append((edits, -weight, i))
            assert lexicon.match(w) == (lambda best: best and (best[2], best[0]))(min(found, default=None)), w


def test_lexicon_choice():
    rows = [("idio", False, 99, 50.0, 5.0), ("idiot", False, 99, 50.0, 5.0), ("idiot", True, 99, 50.0, 5.0), ("lowei", False, 90, 45.0, 5.0), ("loweis", False, 30, 20.0, 4.8), ("loweisp", True, 30, 20.0, 4.8), ("lowe", False, 91, 44.0, 3.0)]
    assert toxicity._chosen(rows) == [("idiot", True, 5.0), ("lowei", False, 5.0)]
    assert toxicity._chosen([]) == []


def test_terms_in_context():
    def of(text):
        found = toxicity.tokens(text)
        return dict(zip(toxicity.FEATURES, toxicity.features(found, [(i, 4.0, 0) for i, t in enumerate(found) if t == "idiot"]), strict=True))

    abuse, quoted, reported = of("You are an IDIOT### and so on"), of('the paper has "what an idiot" on page one'), of("she said idiot again")
    assert abuse["most"] == 4 and abuse["addressed"] > 0 and abuse["most_quoted"] == 0
    assert quoted["most"] == 0 and quoted["most_quoted"] == 4 and reported["most_quoted"] == 4
    assert of('a lone " idiot here')["most"] == 4  # a mark that is not closed quotes nothing
    assert of('"a" idiot "b"')["most"] == 4 and of('"a\nidiot" b')["most"] == 4
    w = np.array(list(toxicity.FEATURES.values()))
    z = [np.dot(list(x.values()), w) for x in (abuse, quoted, of(""))]
    assert z[0] > 0 > z[1] > z[2]


def toxic_corpus(seed, n=900):
    """Invented prose, one text in five toxic by words of its own, some of them misspelt."""
    rng = random.Random(seed)
    plain = ["".join(rng.choices("aeioulnrst", k=rng.randrange(2, 8))) for _ in range(400)]
    bad, stem = ["zwarkid", "plomgust"], "vexqu"
    rows, labels = [], []
    for i in range(n):
        words, toxic = rng.choices(plain, k=rng.randrange(20, 60)), int(rng.random() < 0.2)
        for _ in range(3 * toxic):
            w = rng.choice([*bad, stem + rng.choice(plain)])
            words.insert(rng.randrange(len(words)), w if i % 10 else w.replace("zwarkid", "zw4rkid").replace("plomgust", "plomgusst"))
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    return rows, labels


def test_toxicity(spark, docs_of):
    rows, labels = toxic_corpus(2)
    given = [(i, t) for i, t in labels] + [(None, 1), (5, None), (6, 7), (7, labels[7][1])]
    marks = spark.createDataFrame([(i, t, "x") for i, t in given], "doc_id long, toxic int, text string")
    odd = [(None, "no id zwarkid"), (5000, None), (5001, ""), (5002, "  \n "), (5003, "zwarkid " * 3000), (5004, "calm " * 200_000), (5003, "zwarkid " * 3000)]
    out = toxicity.toxicity(docs_of(*rows, *odd), marks)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    got = out.collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    want = dict(labels)
    held = [r for r in got if r["doc_id"] in want and r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in want if zlib.crc32(str(i).encode()) % 5 == 0}
    wrong = [r for r in held if r["predicted"] != want[r["doc_id"]]]
    assert len(held) > 150 and len(wrong) <= 2
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[5003]["predicted"] == 1 and by_id[5004]["predicted"] == 0 and not by_id[None]["held_out"]
    assert by_id[5000]["score"] == by_id[5001]["score"] == by_id[5002]["score"] < 0.5


def test_toxicity_copies_teach_nothing(spark, docs_of):
    """The own words of a toxic text do not become terms by its copies."""
    rows, labels = toxic_corpus(3)
    own = "quirbelnast umsprolt zwarkid herdanulo"
    rows += [(2000 + i, own) for i in range(300)]
    labels += [(2000 + i, 1) for i in range(300)]
    learnt = docs_of(*rows).join(spark.createDataFrame(labels, "doc_id long, toxic int"), "doc_id").select("text", "toxic")
    entries = {e[0] for e in toxicity.learn_lexicon(learnt)}
    assert entries >= {"zwarkid", "plomgust", "vexqu"} and not entries & set(own.replace("zwarkid", "").split())


def test_toxicity_without_labels(spark, docs_of):
    docs = docs_of((1, "a"), (2, None))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r["score"], r["predicted"]) for r in toxicity.toxicity(docs, none).collect()] == [(0.0, 0)] * 2
    one = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, toxic int")
    assert [(r["score"], r["predicted"]) for r in toxicity.toxicity(docs, one).collect()] == [(1.0, 1)] * 2
    both = spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id long, toxic int")
    assert toxicity.toxicity(docs.limit(0), both).collect() == []
    assert all(0 <= r["score"] <= 1 for r in toxicity.toxicity(docs_of((70, "x")), both).collect())
