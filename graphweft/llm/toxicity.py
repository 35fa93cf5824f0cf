"""Toxicity from a lexicon, its misspellings, and what stands around a term.

**Lexicon.** Words and stems (beginnings of words) that labelled toxic texts hold
and clean ones do not. Evidence is counted by context: the first place of a
word in a text counts with its two neighbours, and equal places count once, so
copies of a text bring nothing new. An entry must be ``LEAST_EVIDENCE`` nats
less likely under chance. Of stems with the same evidence the longest stays.

**Misspellings.** The Levenshtein automaton of the whole lexicon runs over each
different word: a state is a set of (node of the lexicon trie, edits so far), and
states are made as words need them. The longer an entry, the more edits it bears.

**Context.** Terms inside quotation marks or beside a word of reporting count
apart from the others, as do those beside a word of address. A logistic
regression weighs these sums; its coefficients are drawn to stated ones, so what
the labels do not show (a corpus without quotations) keeps a sound weight.

Lexicon and weights are learnt from at most ``TOXIC + CLEAN`` labelled texts,
chosen by hash of the id. Every text is scored whole, where it lies.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.llm.pretokens import Memory, numbered
from graphweft.llm.words import slices
from graphweft.session import Scratch

#: Labelled texts that are learnt from, at most, of either label.
TOXIC, CLEAN = 4_000, 8_000
#: Nats by which an entry's texts must be less likely under chance, and the least logarithm of its odds.
LEAST_EVIDENCE, LEAST_ODDS = 14.0, 1.5
#: Entries of the lexicon, at most: those of most evidence; and candidates among which stems and words are chosen.
ENTRIES, CANDIDATES = 5_000, 50_000
#: Lengths of stems.
STEMS = range(4, 13)
#: A longer stem with such a share of a shorter one's evidence takes its place.
SAME = 0.8
#: Tokens to either side of a term that are its context, and within which its quotation marks must stand.
CONTEXT, QUOTATION = 6, 40
#: States of the automaton that are kept; this changes no result.
KEPT_STATES = 50_000

# Marks and words that show how a term is used.
QUOTES = frozenset('"“”„«»')
REPORTING = frozenset("said says wrote writes called calls quote quoted quotes word words term reported sagte schrieb nannte wort zitat dit écrit appelé mot citation dijo escribió llamó palabra cita".split())
ADDRESS = frozenset("you your you're u ur du dich dir dein deine ihr euch tu te toi ton vous votre tú ti eres usted ustedes vosotros".split())

_TOKEN = re.compile(r"""["“”„«»\n]|[^\W_](?:[^\s,;"“”„«»()\[\]{}<>|/]*[^\W_])?""").findall


def tokens(text: str) -> list[str]:
    """Words in lower case, and quotation marks and line breaks, in order."""
    return _TOKEN(text.lower())


def edits_borne(length: int, whole: bool) -> int:
    """Edits up to which a misspelt entry is still taken for it."""
    return (length >= 5) + (length >= 9) if whole else int(length >= 7)


@dataclass
class Lexicon:
    """Entries (text, whole word or stem, weight) as a trie, with its Levenshtein automaton."""

    entries: list[tuple[str, bool, float]]
    children: list[dict[str, int]] = field(default_factory=lambda: [{}])

    def __post_init__(self):
        self.ends: list[list[int]] = [[]]
        self.borne = [-1]  # most edits that an entry at or below a node bears
        for i, (text, whole, _) in enumerate(self.entries):
            bears, node = edits_borne(len(text), whole), 0
            self.borne[0] = max(self.borne[0], bears)
            for c in text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.borne.append(-1)
                node = self.children[node][c]
                self.borne[node] = max(self.borne[node], bears)
            self.ends[node].append(i)
        self._fresh()

    def _fresh(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.states: list[dict[int, int]] = []
        self.steps: list[dict[str, int]] = []
        self.stems: list[tuple | None] = []  # best stem reached in a state
        self.first = self._state({0: 0})

    def _state(self, reached: dict[int, int]) -> int:
        """The number of the state of these nodes and fewest edits, closed under letters left out."""
        todo = list(reached)
        while todo:
            node = todo.pop()
            edits = reached[node] + 1
            for child in self.children[node].values():
                if edits <= self.borne[child] and edits < reached.get(child, 99):
                    reached[child] = edits
                    todo.append(child)
        key = frozenset(reached.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(reached)
            self.steps.append({})
            self.stems.append(self._best(reached, False))
        return self.numbers[key]

    def _best(self, reached: dict[int, int], whole: bool) -> tuple | None:
        """(edits, -weight, entry) of the best entry that ends in a node of a state."""
        found = [
            (edits, -self.entries[i][2], i)
            for node, edits in reached.items()
            for i in self.ends[node]
            if self.entries[i][1] == whole and edits <= edits_borne(len(self.entries[i][0]), whole)
        ]
        return min(found, default=None)

    def _step(self, state: int, c: str) -> int:
        reached: dict[int, int] = {}
        for node, edits in self.states[state].items():
            for letter, child in self.children[node].items():
                cost = edits + (letter != c)
                if cost <= self.borne[child] and cost < reached.get(child, 99):
                    reached[child] = cost
            if edits + 1 <= self.borne[node] and edits + 1 < reached.get(node, 99):
                reached[node] = edits + 1  # a letter too many
        return self._state(reached)

    def match(self, word: str) -> tuple[int, int] | None:
        """(entry, edits) of the entry that a word is or begins with, by fewest
        edits, then highest weight, then first; None if there is none."""
        if len(self.states) > KEPT_STATES:
            self._fresh()
        state, best = self.first, None
        for c in word:
            known = self.steps[state]
            if c not in known:
                known[c] = self._step(state, c)
            state = known[c]
            if not self.states[state]:
                break
            if (stem := self.stems[state]) is not None and (best is None or stem < best):
                best = stem
        else:
            if (own := self._best(self.states[state], True)) is not None and (best is None or own < best):
                best = own
        return None if best is None else (best[2], best[0])


#: Sums over the terms of a text that the regression weighs, and the coefficients they are drawn to.
FEATURES = {
    "constant": -3.0, "most": 1.0, "sum": 1.0, "most_misspelt": 0.5, "share": 0.5, "kinds": 0.3,
    "most_quoted": 0.1, "sum_quoted": 0.1, "addressed": 0.3, "crowded": 0.2,
}


def _used(found: list[str], at: int) -> tuple[bool, bool]:
    """Whether the term at a position is quoted or reported, and whether it stands beside a word of address."""
    low, high = max(0, at - QUOTATION), at + 1 + QUOTATION
    before, after = found[low:at], found[at + 1 : high]
    line = before[len(before) - before[::-1].index("\n") :] if "\n" in before else before
    rest = after[: after.index("\n")] if "\n" in after else after
    quoted = sum(t in QUOTES for t in line) % 2 == 1 and any(t in QUOTES for t in rest)
    near = found[max(0, at - CONTEXT) : at] + found[at + 1 : at + 1 + CONTEXT]
    return quoted or not REPORTING.isdisjoint(near), not ADDRESS.isdisjoint(near)


def features(found: list[str], hits: list[tuple[int, float, int]]) -> list[float]:
    """The features of a text from its tokens and terms (position, weight, edits)."""
    out = dict.fromkeys(FEATURES, 0.0) | {"constant": 1.0}
    last = -99
    for at, weight, edits in hits:
        weight *= 0.7**edits
        reported, addressed = _used(found, at)
        if reported:
            out["most_quoted"], out["sum_quoted"] = max(out["most_quoted"], weight), out["sum_quoted"] + weight
            continue
        place = "most_misspelt" if edits else "most"
        out[place], out["sum"] = max(out[place], weight), out["sum"] + weight
        out["addressed"] += addressed
        out["crowded"] += at - last <= CONTEXT
        last = at
    own = [h for h in hits if not _used(found, h[0])[0]]
    out["share"] = 10 * (len(own) / max(1, len(found))) ** 0.5
    out["kinds"] = float(len({found[at] for at, _, _ in own}))
    for name in ("sum", "sum_quoted", "addressed", "crowded", "kinds"):
        out[name] = float(np.log1p(out[name]))
    return list(out.values())


def fit(rows: np.ndarray, toxic: np.ndarray, weight: np.ndarray, pull: float = 2.0) -> np.ndarray:
    """Coefficients of the logistic regression by Newton steps, drawn to those of ``FEATURES``."""
    prior = np.array(list(FEATURES.values()))
    ridge = np.full(len(prior), pull)
    ridge[0] = 1e-3
    w, loss = prior.copy(), lambda w: float((weight * np.logaddexp(0, np.where(toxic, -1, 1) * (rows @ w))).sum() + (ridge * (w - prior) ** 2).sum() / 2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -40, 40)))
        slope = rows.T @ (weight * (p - toxic)) + ridge * (w - prior)
        curve = (rows * (weight * p * (1 - p))[:, None]).T @ rows + np.diag(ridge)
        step, size = np.linalg.solve(curve, slope), 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, list[list[str]]]]:
    for batch in batches:
        for at, data, offsets in slices(batch["text"]):
            raw = data.tobytes()
            yield batch, at, [tokens(raw[x:y].decode()) for x, y in zip(offsets[:-1], offsets[1:], strict=True)]


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, hash of it and its neighbours where it stands first, label) for each word of each text."""
    for batch, at, found in _texts(batches):
        label = batch["toxic"].slice(at, len(found)).to_pylist()
        words, places, labels = [], [], []
        for toxic, own in zip(label, found, strict=True):
            own = [t for t in own if t not in QUOTES and t != "\n"]
            first = {}
            for i, t in enumerate(own):
                first.setdefault(t, i)
            words += first
            places += [xxhash.xxh3_64_intdigest("\n".join(own[max(0, i - 1) : i + 2])) - 2**63 for i in first.values()]
            labels += [toxic] * len(first)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(places, pa.int64()), pa.array(labels, pa.int32())], ["word", "place", "toxic"])


def _matched(lexicon: Lexicon, memory: Memory, found: list[list[str]]) -> Iterator[list[float]]:
    """The features of each text."""
    words, code, lengths = numbered(found)
    known = memory.of(words)
    hit = np.array([k is not None for k in known], bool)[code]
    stops = np.concatenate(([0], np.cumsum(lengths)))
    at = np.flatnonzero(hit)
    ranges = np.searchsorted(at, stops)
    for i, own in enumerate(found):
        places = at[ranges[i] : ranges[i + 1]]
        entries = [known[code[p]] for p in places]
        yield features(own, [(int(p - stops[i]), lexicon.entries[e][2], edits) for p, (e, edits) in zip(places, entries, strict=True)])


def _describing(entries: list[tuple[str, bool, float]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(entries)
        memory = Memory(lambda words: [lexicon.match(w) for w in words])
        for batch, at, found in _texts(batches):
            rows = pa.array(list(_matched(lexicon, memory, found)), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(at, len(found)), batch["toxic"].slice(at, len(found)), rows], ["doc_id", "toxic", "features"])

    return run


def _scoring(entries: list[tuple[str, bool, float]], weights: list[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, w = Lexicon(entries), np.array(weights)
        memory = Memory(lambda words: [lexicon.match(w) for w in words])
        for batch, at, found in _texts(batches):
            z = np.array(list(_matched(lexicon, memory, found))) @ w
            score = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(at, len(found)), pa.array(score)], ["doc_id", "score"])

    return run


def learn_lexicon(learnt: DataFrame) -> list[tuple[str, bool, float]]:
    """Entries (text, whole word, weight) from texts with a label: text, toxic (0, 1)."""
    places = learnt.mapInArrow(_evidence, "word string, place long, toxic int").groupBy("word", "place")
    places = places.agg(F.max("toxic").alias("t"), F.max(1 - F.col("toxic")).alias("c"))
    words = Scratch(learnt.sparkSession).write(places.groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c")), "words")
    total = words.agg(F.sum("t").alias("t"), F.sum("c").alias("c")).first()
    if not total["t"] or not total["c"]:
        return []
    share, n = total["t"] / (total["t"] + total["c"]), F.col("t") + F.col("c")
    stems = F.explode(F.expr(f"transform(sequence({STEMS[0]}, {STEMS[-1]}), k -> IF(length(word) > k, substring(word, 1, k), NULL))")).alias("entry")
    entries = words.select(F.col("word").alias("entry"), F.lit(True).alias("whole"), "t", "c").unionByName(
        words.where(F.length("word") > STEMS[0]).select(stems, F.lit(False).alias("whole"), "t", "c").where("entry is not null")
    )
    entries = entries.groupBy("entry", "whole").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where("t > 0 and length(entry) >= 3")
    # Chernoff's bound of the chance of so many toxic texts among n
    evidence = F.col("t") * F.log(F.col("t") / n / share) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / n / (1 - share))).otherwise(0.0)
    odds = F.log((F.col("t") + 0.5) / (total["t"] + 1)) - F.log((F.col("c") + 0.5) / (total["c"] + 1))
    entries = entries.select("entry", "whole", "t", evidence.alias("evidence"), odds.alias("odds")).where(f"odds >= {LEAST_ODDS} and evidence >= {LEAST_EVIDENCE}")
    best = entries.orderBy(F.desc("evidence"), "entry", "whole").limit(CANDIDATES).collect()
    return _chosen([(r["entry"], r["whole"], r["t"], r["evidence"], r["odds"]) for r in best])


def _chosen(candidates: list[tuple[str, bool, int, float, float]]) -> list[tuple[str, bool, float]]:
    """Of entries that begin with one another those that say most: the longest
    with (nearly) all of a stem's evidence, and longer ones only where their odds are higher."""
    # for each stem the most texts of an entry it begins; a word counts as longer than the stem of its letters
    most: dict[str, int] = {}
    for text, whole, t, _, _ in candidates:
        for k in range(STEMS[0], len(text) + whole):
            most[text[:k]] = max(most.get(text[:k], 0), t)
    kept: dict[str, float] = {}
    chosen = []
    for text, whole, t, evidence, odds in sorted(candidates, key=lambda x: (len(x[0]), x[1], x[0])):
        if not whole and most.get(text, 0) >= SAME * t:
            continue
        if any(kept.get(text[:k], -9.0) >= odds - 0.5 for k in range(STEMS[0], len(text) + whole)):
            continue
        if not whole:
            kept[text] = odds
        chosen.append((evidence, text, whole, odds))
    chosen.sort(key=lambda x: (-x[0], x[1], x[2]))
    return sorted((text, whole, odds) for _, text, whole, odds in chosen[:ENTRIES])


def held_out(doc_id: str = "doc_id"):
    """Whether a text is kept from learning."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs`` (doc_id long, text; other columns are ignored):
    doc_id, held_out (crc32 of the id as text is a multiple of 5), score (0 to 1),
    predicted (1 if score >= threshold, else 0).

    labels: doc_id, toxic (0 or 1). Rows with a null or another value, and those of
    texts held out, are not learnt from. An id that is labelled or stored
    several times is learnt once, with its greatest label and text. Null and empty
    texts are scored by the constant, as any without a term; repeated rows and null
    ids stay (null: not held out). Without labels of both kinds nothing is
    learnt, and every score is the share of toxic labels (0 without any). Very
    long texts are read whole, in a slice of their own; no rows give none.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    labels = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    n_clean, n_toxic = (sum(r["n"] for r in labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect() if r["toxic"] == k) for k in (0, 1))
    base = docs.select("doc_id", held_out().alias("held_out"), F.lit(n_toxic / max(1, n_toxic + n_clean)).alias("score"))
    if not n_clean or not n_toxic:
        return base.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

    # at most TOXIC + CLEAN rows, so they are sent to the texts
    picked = labels.where("toxic = 1").orderBy(*order).limit(TOXIC).unionByName(labels.where("toxic = 0").orderBy(*order).limit(CLEAN))
    learnt = docs.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))
    learnt = Scratch(docs.sparkSession).write(learnt, "learnt")
    entries = learn_lexicon(learnt)
    rows = sorted(learnt.mapInArrow(_describing(entries), "doc_id long, toxic int, features array<double>").collect())
    toxic = np.array([r["toxic"] for r in rows], float)
    weights = np.array(list(FEATURES.values()))
    if 0 < toxic.sum() < len(toxic):
        each = np.where(toxic == 1, n_toxic / toxic.sum(), n_clean / (len(toxic) - toxic.sum()))
        weights = fit(np.array([r["features"] for r in rows]), toxic, each * len(rows) / each.sum())
    made = docs.mapInArrow(_scoring(entries, weights.tolist()), "doc_id long, score double")
    return made.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
