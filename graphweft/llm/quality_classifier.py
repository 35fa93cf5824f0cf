"""Ordinal quality classifier: a cumulative-link regression on graded ratings.

For grades 0 .. K the chance of grade k or more is sigmoid(w . x - t_k) with one
weight vector for all grades and thresholds t_1 <= .. <= t_K. x holds the hashed
words of a text (runs of letters and digits), each once, and bins of a few
shares over the whole text. Weights and thresholds are fitted on at most
``SAMPLE`` rated texts, chosen by hash of the id; words in fewer than
``LEAST_TEXTS`` of them weigh nothing, so that no text is learnt by heart. Every
text is then scored where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.llm.words import Words, slices

#: Rated texts that the model is fitted on, at most.
SAMPLE = 10_000
#: Hash buckets of words; the bins of shares follow them.
BUCKETS = 1 << 18
BINS = 16
SHARES = 4
LEAST_TEXTS = 5
SIZE = BUCKETS + SHARES * BINS
EPOCHS, BATCH, RATE = 10, 32, 1.0
#: Pull of a weight to zero: a word must explain more than this to weigh anything (FTRL-proximal).
LASSO, RIDGE = 15.0, 1.0

_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _features(data: np.ndarray, words: Words, i: int) -> np.ndarray:
    """The features of one text: buckets of its words, and one bin each of its
    length, its share of different words, of symbols and of digits."""
    own = words.of(i)
    kinds = np.unique(own)
    raw = data[words.offsets[i] : words.offsets[i + 1]]
    seen = np.bincount(raw, minlength=128)
    letters = max(1, len(raw))
    shares = (
        np.log2(1 + len(own)), BINS * len(kinds) / max(1, len(own)),
        np.log2(1 + 4096 * sum(seen[ord(c)] for c in "#*$%&|<>") / letters), np.log2(1 + 4096 * seen[0x30:0x3A].sum() / letters),
    )
    bins = [BUCKETS + k * BINS + min(BINS - 1, int(s)) for k, s in enumerate(shares)]
    return np.concatenate([np.unique((kinds >> np.uint64(20)) % np.uint64(BUCKETS)).astype(np.int64), bins]).astype(np.int32)


@dataclass
class CumulativeLink:
    weights: np.ndarray
    first: float  # lowest threshold
    steps: np.ndarray  # logarithms of the distances to the next ones

    @property
    def thresholds(self) -> np.ndarray:
        return self.first + np.concatenate(([0.0], np.cumsum(np.exp(self.steps))))

    def tails(self, features: list[np.ndarray]) -> np.ndarray:
        """Chance of grade k or more, k = 1 .. K, for each text."""
        z = np.array([self.weights[f].sum() for f in features])
        return 1 / (1 + np.exp(np.clip(self.thresholds - z[:, None], -60, 60)))

    @classmethod
    def fit(cls, features: list[np.ndarray], grades: np.ndarray, seed: int = 3) -> CumulativeLink:
        top = int(grades.max())
        texts = np.bincount(np.concatenate(features), minlength=SIZE)
        features = [f[(texts[f] >= LEAST_TEXTS) | (f >= BUCKETS)] for f in features]
        share = np.array([(grades >= k).mean() for k in range(1, top + 1)]).clip(1e-3, 1 - 1e-3)
        start = -np.log(share / (1 - share))
        model = cls(np.zeros(SIZE), float(start[0]), np.log(np.maximum(np.diff(start), 0.1)))
        rng, bound = np.random.default_rng(seed), np.full(top, 1e-6)
        pull, squares = np.zeros(SIZE), np.zeros(SIZE)
        for _ in range(EPOCHS):
            order = rng.permutation(len(features))
            for at in range(0, len(order), BATCH):
                pick = order[at : at + BATCH]
                rows, y = [features[i] for i in pick], grades[pick]
                tail = np.pad(model.tails(rows), ((0, 0), (1, 1)), constant_values=((0, 0), (1, 0)))
                chance = np.maximum(tail[np.arange(len(y)), y] - tail[np.arange(len(y)), y + 1], 1e-9)
                slope = tail * (1 - tail)
                # d loss / d score of each text, and / d threshold k
                upper, lower = slope[np.arange(len(y)), y + 1], slope[np.arange(len(y)), y]
                d_z = (upper - lower) / chance
                d_t = np.zeros(top)
                np.add.at(d_t, np.maximum(y - 1, 0), np.where(y > 0, lower / chance, 0))
                np.add.at(d_t, np.minimum(y, top - 1), np.where(y < top, -upper / chance, 0))
                flat = np.concatenate(rows)
                touched, place = np.unique(flat, return_inverse=True)
                each = np.repeat(d_z, [len(r) for r in rows])
                grad, old = np.bincount(place, each), squares[touched]
                squares[touched] = new = old + grad**2
                pull[touched] += grad - (np.sqrt(new) - np.sqrt(old)) / RATE * model.weights[touched]
                z = pull[touched]
                model.weights[touched] = np.where(np.abs(z) > LASSO, (np.sign(z) * LASSO - z) / ((1 + np.sqrt(new)) / RATE + RIDGE), 0.0)
                # a threshold is the first one and all distances below it
                grad = np.concatenate(([d_t.sum()], [d_t[k:].sum() * np.exp(model.steps[k - 1]) for k in range(1, top)])) / len(y)
                bound += grad**2
                move = RATE * grad / np.sqrt(bound)
                model.first, model.steps = model.first - move[0], np.clip(model.steps - move[1:], -8, 8)
        return model


def _rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, data, offsets in slices(batch["text"]):
            words, n = Words(data, offsets, space=_BETWEEN), len(offsets) - 1
            rows = pa.array([_features(data, words, i).tobytes() for i in range(n)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(at, n), batch["grade"].slice(at, n), rows], ["doc_id", "grade", "features"])


def _scored(model: CumulativeLink | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in slices(batch["text"]):
                words = Words(data, offsets, space=_BETWEEN)
                n = len(words.offsets) - 1
                grade = tail = pa.nulls(n, pa.float64())
                if model is not None:
                    tails = model.tails([_features(data, words, i) for i in range(n)])
                    grade, tail = pa.array(tails.sum(1)), pa.array(tails[:, -1])
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(at, n), grade, tail], ["doc_id", "expected_grade", "tail"])

    return run


def graded(docs: DataFrame, ratings: DataFrame, least: float = 0.5) -> DataFrame:
    """One row per row of ``docs`` (doc_id long, text; others are ignored):
    doc_id, expected_grade, tail (chance of the highest grade), kept (tail >= least).

    ratings: doc_id, grade (0, 1, ..); rows with a null are left out. A text rated
    twice is learnt from twice. Null and empty texts have their bins only and
    are scored like others; repeated rows and null ids stay. Without a rating above 0
    there is no model: both numbers are null and kept is true. No rows give none.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ratings = ratings.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("grade").cast("int").alias("grade")).where("doc_id is not null and grade >= 0")
    # at most SAMPLE rows, so they are sent to the texts
    chosen = F.broadcast(ratings.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(SAMPLE))
    rows = docs.join(chosen, "doc_id").mapInArrow(_rated, "doc_id long, grade int, features binary")
    rows = sorted(rows.limit(2 * SAMPLE).collect(), key=lambda r: (r["doc_id"], r["grade"], bytes(r["features"])))
    model = None
    if rows and max(r["grade"] for r in rows):
        model = CumulativeLink.fit([np.frombuffer(r["features"], np.int32) for r in rows], np.array([r["grade"] for r in rows]))
    made = docs.mapInArrow(_scored(model), "doc_id long, expected_grade double, tail double")
    return made.withColumn("kept", F.coalesce(F.col("tail") >= least, F.lit(True)))
