"""A small causal self-attention language model in numpy.

One head of attention over subword ids with a learnt bias for each distance,
then a distribution over classes of ids; inside its class an id has its smoothed
share of the corpus counts. Classes hold about equal shares of the corpus, so
frequent ids are classes of their own.

A window is one gather of embeddings and a few batched products; learning goes the
same way back. The products are those of single queries, keys and values, put
together so that nothing as wide as the classes is kept or summed by id.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np

#: Ids a prediction sees at most, and targets of a window; a target sees WINDOW - STRIDE + 1 ids at least, where so many precede it.
WINDOW, STRIDE = 24, 12
WIDTH, CLASSES = 16, 48
#: How far each place seen lies before each target.
_BACK = np.arange(WINDOW - STRIDE, WINDOW)[:, None] - np.arange(WINDOW)[None]
_DISTANCE, _LATER = np.maximum(_BACK, 0), _BACK < 0
#: Scores between this and its negative go through exp as they are.
LARGE = 30
#: Weights that belong to no id.
DENSE = ("query", "key", "value", "out", "bias", "near")


def classes_of(counts: np.ndarray, n: int = CLASSES) -> tuple[np.ndarray, np.ndarray]:
    """(class of each id, log10 of its share of its class) from corpus counts, add-one smoothed."""
    share = counts + 1.0
    order = np.lexsort((np.arange(len(share)), -share))
    mass = np.cumsum(share[order])
    group = np.empty(len(share), np.int64)
    group[order] = np.minimum((mass - share[order] / 2) / mass[-1] * n, n - 1).astype(np.int64)
    _, group = np.unique(group, return_inverse=True)
    return group, np.log10(share / np.bincount(group, share)[group])


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over texts that lie one after the other, ``sizes`` ids each.

    Returns (sees, seen, targets): for each window the places of the ids it sees
    (the id before a target stands at the target's place), which of them exist, and
    which of its last STRIDE places are targets. Each place is a target once.
    """
    first = np.cumsum(sizes) - sizes
    n = -(-sizes // STRIDE)
    text = np.repeat(np.arange(len(sizes)), n)
    start = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * STRIDE - (WINDOW - STRIDE)
    sees = (start + first[text])[:, None] + np.arange(WINDOW)
    seen = np.ones(sees.shape, bool)
    # windows that reach over an end of their text
    over = np.flatnonzero((start < 0) | (start + WINDOW > sizes[text]))
    place, text = start[over, None] + np.arange(WINDOW), text[over, None]
    seen[over] = there = (place >= 0) & (place < sizes[text])
    sees[over] = np.where(there, place, 0) + first[text]
    return sees, seen, seen[:, WINDOW - STRIDE :]


@dataclass
class Model:
    embed: np.ndarray  # ids x width
    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    out: np.ndarray  # width x classes
    bias: np.ndarray  # of classes
    near: np.ndarray  # of distances, 0 is the id before the target
    group: np.ndarray
    inside: np.ndarray

    @classmethod
    def start(cls, counts: np.ndarray, seed: int = 5) -> Model:
        rng = np.random.default_rng(seed)
        group, inside = classes_of(counts)
        k = int(group.max()) + 1
        small = lambda *shape: (rng.standard_normal(shape) * 0.2).astype(np.float32)
        bias = np.log(np.bincount(group, counts + 1.0) / (counts.sum() + len(counts))).astype(np.float32)
        square = (WIDTH, WIDTH)
        return cls(small(len(counts), WIDTH), small(*square), small(*square), small(*square), small(WIDTH, k), bias, np.zeros(WINDOW, np.float32), group, inside)

    def tables(self) -> tuple[np.ndarray, ...]:
        """By id: query, key, value and what the id itself adds to the classes."""
        e = self.embed
        return e @ self.query / np.float32(np.sqrt(WIDTH)), e @ self.key, e @ self.value, e @ self.out + self.bias

    def mask(self) -> np.ndarray:
        """Bias of each (target, place seen): that of their distance, minus infinity for what comes later."""
        return np.where(_LATER, np.float32(-np.inf), self.near[_DISTANCE])


def _level(scores: np.ndarray) -> None:
    """Takes the largest of each row away where some could be too large or small for exp."""
    if not -LARGE < scores.min() <= scores.max() < LARGE:
        scores -= scores.max(-1, keepdims=True)


class _Windows:
    """From what up to ``most`` windows see to the classes of their targets, and back,
    in arrays that are used again and again.

    Rows of ``seen_as`` are embeddings with a one behind, so that one product gives
    the mixed rows and the sums of their weights. Queries and keys meet in one
    matrix. What the id before a target adds to the classes itself and what is mixed
    go through ``out`` together.
    """

    def __init__(self, model: Model, most: int):
        made = lambda *shape: np.zeros(shape, np.float32)
        targets, classes = most * STRIDE, model.out.shape[1]
        self.seen_as_, self.d_seen_ = made(most, WINDOW, WIDTH + 1), made(most, WINDOW, WIDTH)
        # weights over gradients of scores; gradients of mixed rows over queries
        self.both_, self.rows_ = made(most, 2 * STRIDE, WINDOW), made(most, 2 * STRIDE, WIDTH + 1)
        self.asked_, self.wide_, self.top_ = made(targets, WIDTH), made(targets, WIDTH + 1), made(targets, WIDTH + 1)
        self.mixed_, self.d_top_, self.some_ = made(targets, WIDTH), made(targets, WIDTH), made(targets, WIDTH)
        self.logits_, self.part_ = made(targets, classes), made(targets, 1)
        self.top_[:, WIDTH] = 1
        self.ones = np.ones(max(most, classes), np.float32)
        self.use(model)

    def use(self, model: Model) -> None:
        self.meet = model.query @ model.key.T / np.float32(np.sqrt(WIDTH))
        self.mask, self.value, self.near = model.mask(), model.value, np.abs(model.near).max()
        self.out = np.concatenate([model.out, model.bias[None]])

    def forward(self, embed: np.ndarray, ids: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """Logits, a row for each target. ``embed``: embeddings by id, with a one behind."""
        n = len(ids)
        t = n * STRIDE
        seen_as, both, rows, top, wide, mixed = self.seen_as_[:n], self.both_[:n], self.rows_[:n], self.top_[:t], self.wide_[:t], self.mixed_[:t]
        embed.take(ids, 0, out=seen_as, mode="clip")
        asked = self.asked_[:t]
        asked.reshape(n, STRIDE, WIDTH)[:] = seen_as[:, WINDOW - STRIDE :, :WIDTH]
        rows[:, STRIDE:, :WIDTH] = np.matmul(asked, self.meet, out=self.some_[:t]).reshape(n, STRIDE, WIDTH)
        rows[:, STRIDE:, WIDTH] = 0
        weight = both[:, :STRIDE]
        np.matmul(rows[:, STRIDE:], seen_as.transpose(0, 2, 1), out=weight)
        short = np.flatnonzero(~seen.all(1))
        if -LARGE < weight.min() - self.near <= weight.max() + self.near < LARGE:
            np.exp(weight, out=weight)
            weight *= np.exp(self.mask)
            weight[short] *= seen[short, None]
        else:
            weight += self.mask
            weight[short] += np.where(seen[short, None], np.float32(0), np.float32(-np.inf))
            weight -= weight.max(2, keepdims=True)
            np.exp(weight, out=weight)
        np.matmul(weight, seen_as, out=wide.reshape(n, STRIDE, WIDTH + 1))
        part = np.divide(1, wide[:, WIDTH:], out=self.part_[:t])
        np.multiply(wide[:, :WIDTH], part, out=mixed)
        np.add(np.matmul(mixed, self.value, out=self.some_[:t]), asked, out=top[:, :WIDTH])
        return np.matmul(top, self.out, out=self.logits_[:t])

    def backward(self, flat: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """(gradients of the embeddings by place, those of other weights); the
        gradients of the logits are ``flat``, each row times its ``scale``."""
        t, scale = len(flat), scale[:, None]
        n = t // STRIDE
        seen_as, both, rows, top, wide, mixed = self.seen_as_[:n], self.both_[:n], self.rows_[:n], self.top_[:t], self.wide_[:t], self.mixed_[:t]
        asked, some, part, d_top, d_seen = self.asked_[:t], self.some_[:t], self.part_[:t], self.d_top_[:t], self.d_seen_[:n]
        np.matmul(flat, self.out[:WIDTH].T, out=d_top)
        d_top *= scale
        d_out = np.multiply(top, scale, out=wide).T @ flat
        d_value, d_mixed = mixed.T @ d_top, np.matmul(d_top, self.value.T, out=some)
        np.multiply(d_mixed, part, out=wide[:, :WIDTH])
        mixed *= wide[:, :WIDTH]
        np.negative(mixed @ self.ones[:WIDTH], out=wide[:, WIDTH])
        rows[:, :STRIDE] = wide.reshape(n, STRIDE, WIDTH + 1)
        d_score = both[:, STRIDE:]
        np.matmul(rows[:, :STRIDE], seen_as.transpose(0, 2, 1), out=d_score)
        d_score *= both[:, :STRIDE]
        d_asked = np.matmul(d_score, seen_as[..., :WIDTH], out=some.reshape(n, STRIDE, WIDTH)).reshape(-1, WIDTH)
        np.matmul(both.transpose(0, 2, 1), rows[..., :WIDTH], out=d_seen)
        d_top += np.matmul(d_asked, self.meet.T, out=mixed)
        d_seen[:, WINDOW - STRIDE :] += d_top.reshape(n, STRIDE, WIDTH)
        by_place = self.ones[:n] @ both.reshape(n, -1)[:, STRIDE * WINDOW :]
        return d_seen, {
            "meet": asked.T @ d_asked, "value": d_value, "out": d_out[:WIDTH], "bias": d_out[WIDTH],
            "near": np.bincount(_DISTANCE.ravel(), by_place, WINDOW),
        }


class Scorer:
    """log10 probabilities of ids, for use in tasks."""

    def __init__(self, model: Model):
        self.model = model

    def score(self, before: np.ndarray, ids: np.ndarray, sizes: np.ndarray, batch: int = 256) -> np.ndarray:
        """log10 probability of each id; ``before`` holds the id that precedes it in its text."""
        sees, seen, targets = windows(sizes)
        embed, way = _with_ones(self.model.embed), _Windows(self.model, min(batch, len(sees)))
        out, group = np.empty(len(ids)), self.model.group[ids]
        for a in range(0, len(sees), batch):
            at, goal = sees[a : a + batch], targets[a : a + batch].ravel()
            logits = way.forward(embed, before.take(at), seen[a : a + batch])
            _level(logits)
            places = at[:, WINDOW - STRIDE :].ravel()
            hit = logits.ravel().take(np.arange(0, logits.size, logits.shape[1]) + group.take(places))
            logs = hit - np.log(np.exp(logits, out=logits) @ way.ones[: logits.shape[1]])
            out[places[goal]] = logs[goal]
        return out / np.log(10) + self.model.inside[ids]


def _with_ones(embed: np.ndarray) -> np.ndarray:
    return np.concatenate([embed, np.ones((len(embed), 1), np.float32)], 1)


class Fit:
    """A model under training by Adam. A batch changes the embeddings of the ids it
    sees, and all other weights. ``windows`` counts the windows learnt, ``met`` the
    batches that saw an id; they weigh this model where several are averaged."""

    def __init__(self, model: Model, batch: int = 256, rate: float = 0.01, seed: int = 5):
        # by id: embedding and one, first and second moments
        self.by_id = np.concatenate([_with_ones(model.embed), np.zeros((len(model.embed), 2 * WIDTH), np.float32)], 1)
        self.dense = np.concatenate([getattr(model, n).ravel() for n in DENSE])
        self.moments = np.zeros_like(self.dense), np.zeros_like(self.dense)
        self.model = replace(model, embed=self.by_id[:, :WIDTH], **_parts(model, self.dense))
        self.batch, self.rate, self.rng = batch, np.float32(rate), np.random.default_rng(seed)
        self.met, self.steps, self.windows = np.zeros(len(model.embed), np.int64), 0, 0
        self.marked, self.place = np.zeros(len(model.embed), bool), np.zeros(len(model.embed), np.int64)
        self.cells = np.arange(batch * WINDOW * WIDTH).reshape(-1, WIDTH)
        self.way = _Windows(self.model, batch)

    def learn(self, before: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Once over texts that lie one after the other, in an order by chance."""
        sees, seen, targets = windows(sizes)
        order = self.rng.permutation(len(sees))
        for a in range(0, len(order), self.batch):
            pick = order[a : a + self.batch]
            at = sees.take(pick, 0)
            self._step(before.take(at), ids.take(at[:, WINDOW - STRIDE :]), seen.take(pick, 0), targets.take(pick, 0))

    def _step(self, x: np.ndarray, wanted: np.ndarray, seen: np.ndarray, goal: np.ndarray) -> None:
        model, way = self.model, self.way
        way.use(model)
        self.marked[x] = True
        own = np.flatnonzero(self.marked)
        self.marked[own], self.place[own] = False, np.arange(len(own))
        x, by_id = self.place.take(x), self.by_id.take(own, 0)
        share = way.forward(by_id[:, : WIDTH + 1].copy(), x, seen)
        _level(share)
        np.exp(share, out=share)
        total = share @ way.ones[: share.shape[1]]
        share.ravel()[np.arange(0, share.size, share.shape[1]) + model.group.take(wanted).ravel()] -= total
        d_seen, grad = way.backward(share, goal.ravel() / (total * np.float32(max(1, goal.sum()))))
        meet = grad.pop("meet") / np.float32(np.sqrt(WIDTH))
        grad |= {"query": meet @ model.key, "key": meet.T @ model.query}
        # by id, in double precision
        cells = self.cells.take(x.ravel(), 0).ravel()
        d_embed = np.bincount(cells, d_seen.ravel(), len(own) * WIDTH).astype(np.float32).reshape(-1, WIDTH)
        self.steps += 1
        self.windows += len(x)
        self.met[own] += 1
        self.dense -= self._move(*self.moments, np.concatenate([grad[n].ravel() for n in DENSE], dtype=np.float32), self.steps)
        embed, m, s = np.split(by_id, [WIDTH + 1, 2 * WIDTH + 1], 1)
        embed[:, :WIDTH] -= self._move(m, s, d_embed, self.met[own, None])
        self.by_id[own] = by_id

    def _move(self, m: np.ndarray, s: np.ndarray, grad: np.ndarray, steps: int | np.ndarray) -> np.ndarray:
        m += (grad - m) * np.float32(0.1)
        grad *= grad
        s += (grad - s) * np.float32(0.01)
        first, second = _WARM[:, np.minimum(steps, _WARM.shape[1] - 1)]
        return m * (self.rate * first) / (np.sqrt(s * second) + np.float32(1e-8))


#: What moments are multiplied by after so many steps; behind the last it stays one.
with np.errstate(divide="ignore"):
    _WARM = (1 / (1 - np.array([[0.9], [0.99]]) ** np.arange(4096))).astype(np.float32)


def _parts(model: Model, dense: np.ndarray) -> dict[str, np.ndarray]:
    """The weights that belong to no id, as views of one array."""
    shapes = [getattr(model, n).shape for n in DENSE]
    parts = np.split(dense, np.cumsum([int(np.prod(x)) for x in shapes])[:-1])
    return {n: x.reshape(shape) for n, x, shape in zip(DENSE, parts, shapes, strict=True)}


def train(counts: np.ndarray, before: np.ndarray, ids: np.ndarray, sizes: np.ndarray, epochs: int = 2, batch: int = 256, rate: float = 0.01, seed: int = 5) -> Model:
    """A model fitted to texts that lie one after the other, in one place."""
    fit = Fit(Model.start(counts, seed), batch, rate, seed)
    for _ in range(epochs if len(ids) else 0):
        fit.learn(before, ids, sizes)
    return fit.model


def packed(fit: Fit, rows: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(chunk, places, weights, values) of a model: embeddings met, by ``rows`` ids, and
    then all other weights as one chunk."""
    for a in range(0, len(fit.met), rows):
        at = np.flatnonzero(fit.met[a : a + rows])
        if len(at):
            yield a // rows, at.tobytes(), fit.met[a + at].astype(np.float64).tobytes(), fit.model.embed[a + at].tobytes()
    if fit.windows:
        rest = np.concatenate([getattr(fit.model, n).ravel() for n in DENSE])
        yield -1, np.arange(1).tobytes(), np.array([fit.windows], np.float64).tobytes(), rest.tobytes()


def averaged(model: Model, chunks: Iterable[tuple[int, bytes, bytes, bytes]], rows: int) -> Model:
    """``model`` with the weights of the chunks; what is in none stays."""
    new = {n: getattr(model, n).copy() for n in ("embed", *DENSE)}
    for chunk, at, _, values in chunks:
        if chunk >= 0:
            new["embed"][np.frombuffer(at, np.int64) + chunk * rows] = np.frombuffer(values, np.float32).reshape(-1, WIDTH)
            continue
        parts = np.split(np.frombuffer(values, np.float32), np.cumsum([new[n].size for n in DENSE])[:-1])
        new |= {n: x.reshape(new[n].shape).copy() for n, x in zip(DENSE, parts, strict=True)}
    return replace(model, **new)
