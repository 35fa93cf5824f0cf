"""Near-duplicate vectors by product quantisation with inverted lists.

Vectors are scaled to length 1 and fall into the lists of a coarse quantiser;
what is left of a vector after its list's centre is coded by a code word in each
subspace. A query goes to every list that may hold a partner, its distances to
the codes of a list come from one table of query parts by code words, and the
candidates are ranked again by the exact cosine.

Both cuts are lossless, so every link is found:

- a list is probed unless the query is farther from its centre than the list's
  largest residual and the radius sqrt(2 - 2 * cosine) together, or farther than the
  radius from the plane beyond which a vector would be nearer to that centre
  than to the query's own;
- a code is a candidate unless its table distance exceeds the radius by more than
  the vector's stored coding error.

Quantisers are fitted on a sample of at most ``SAMPLE`` vectors, chosen by hash;
every vector is indexed. Equal vectors of one label are one entry with a count.
Small lists of one label share a block of about ``BLOCK`` members and a large list
has several; a query goes to each block it probes once, in blocks of its own. So
a list with a third of all vectors is dealt over many tasks; a task returns
counts and the edges of a spanning forest, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphweft.llm.components import components
from graphweft.session import Scratch

#: Vectors that the quantisers are fitted on, at most.
SAMPLE = 20_000
#: Code words in each subspace, and dimensions of a subspace.
WORDS, PART = 16, 8
#: Rows of a block of list members, and of queries.
BLOCK = 2048
#: Lists grow with the root of the number of vectors, up to this many.
MOST_LISTS = 4096


def _centres(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's algorithm from evenly spaced rows; an empty centre stays where it is."""
    k = max(1, min(k, len(x)))
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=k)[:, None]
        c = np.where(n > 0, total / np.maximum(n, 1), c)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for at in range(0, len(x), 4096):
        out[at : at + 4096] = ((c**2).sum(1) - 2 * x[at : at + 4096] @ c.T).argmin(1)
    return out


@dataclass
class Quantiser:
    lists: np.ndarray  # centres of the lists
    words: list[np.ndarray]  # code words of each subspace
    cuts: list[slice]

    @classmethod
    def fit(cls, x: np.ndarray, n_lists: int) -> Quantiser:
        lists = _centres(x, n_lists)
        rest = x - lists[_nearest(x, lists)]
        cuts = [slice(a, min(a + PART, x.shape[1])) for a in range(0, x.shape[1], PART)]
        return cls(lists, [_centres(rest[:, c], WORDS) for c in cuts], cuts)

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, codes, coding error and distance to the centre of each vector."""
        at = _nearest(x, self.lists)
        rest = x - self.lists[at]
        codes = np.stack([_nearest(rest[:, c], w) for c, w in zip(self.cuts, self.words, strict=True)], 1)
        near = np.concatenate([w[codes[:, i]] for i, w in enumerate(self.words)], 1)
        return at, codes.astype(np.uint8), np.linalg.norm(rest - near, axis=1), np.linalg.norm(rest, axis=1)

    def beside(self, d2: np.ndarray, radius: float) -> np.ndarray:
        """Lists whose side of the plane halfway to the query's own centre is within ``radius``, by squared distances to the centres."""
        own = d2.argmin(1)
        apart = np.sqrt(np.maximum((self.lists[own] ** 2).sum(1)[:, None] + (self.lists**2).sum(1) - 2 * self.lists[own] @ self.lists.T, 0))
        return d2 - d2.min(1, keepdims=True) <= 2 * radius * apart + 1e-6

    def distances(self, q: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries to the coded members of one list, by table lookup."""
        rest = q - self.lists[at]
        out = np.zeros((len(q), len(codes)))
        for i, (c, w) in enumerate(zip(self.cuts, self.words, strict=True)):
            table = ((rest[:, None, c] - w[None]) ** 2).sum(2)
            out += table[:, codes[:, i]]
        return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.float64) for x in column]) if len(column) else np.empty((0, 1))


def _coded(quantiser: Quantiser):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([np.frombuffer(v.as_buffer(), np.float64) for v in batch["unit"]])
            at, codes, error, reach = quantiser.code(x)
            columns = [pa.array(at), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array(reach)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "list", "codes", "error", "reach"])

    return run


def _probed(quantiser: Quantiser, x: np.ndarray, reach: np.ndarray, radius: float) -> np.ndarray:
    """Which lists may hold a partner of each query."""
    d2 = (x**2).sum(1)[:, None] + (quantiser.lists**2).sum(1) - 2 * x @ quantiser.lists.T
    return (np.sqrt(np.maximum(d2, 0)) <= radius + reach + 1e-6) & quantiser.beside(d2, radius)


def _probes(quantiser: Quantiser, reach: np.ndarray, radius: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = np.stack([np.frombuffer(v.as_buffer(), np.float64) for v in part["unit"]])
                i, to = np.nonzero(_probed(quantiser, x, reach, radius))
                i = pa.array(i)
                yield pa.RecordBatch.from_arrays([part["uid"].take(i), part["label"].take(i), pa.array(to)], ["uid", "label", "list"])

    return run


def _compared(quantiser: Quantiser, reach: np.ndarray, least: float, radius: float):
    def run(_key: tuple, queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or members.empty:
            return pd.DataFrame({"uid": [], "links": [], "near": []})
        q, m = _matrix(queries["unit"]), _matrix(members["unit"])
        codes = np.stack([np.frombuffer(c, np.uint8) for c in members["codes"]])
        ids, others = queries["uid"].to_numpy(), members["uid"].to_numpy()
        times, error = members["times"].to_numpy(), members["error"].to_numpy()
        uid, links, forest = [], [], []
        # the tree of each id seen here: queries and members by their place among all ids
        known, place = np.unique(np.concatenate([ids, others]), return_inverse=True)
        mine, theirs, tree = place[: len(ids)], place[len(ids) :], np.arange(len(known))
        lists = members["list"].to_numpy()
        present = np.unique(lists)
        for at in range(0, len(q), 256):
            own = q[at : at + 256]
            asked = _probed(quantiser, own, reach, radius)
            i, j = [], []
            for number in present:
                ask, held = np.flatnonzero(asked[:, number]), np.flatnonzero(lists == number)
                near = np.sqrt(quantiser.distances(own[ask], number, codes[held])) <= radius + error[held] + 1e-6
                x, y = np.nonzero(near & (ids[ask + at, None] != others[held]))
                i.append(ask[x])
                j.append(held[y])
            i, j = np.concatenate(i), np.concatenate(j)
            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
            exact = np.zeros(len(i), bool)
            for x in range(0, len(i), 65536):  # the exact cosine of the candidates
                exact[x : x + 65536] = np.einsum("ij,ij->i", q[i[x : x + 65536] + at], m[j[x : x + 65536]]) >= least
            i, j = i[exact] + at, j[exact]
            n = np.bincount(i - at, times[j], minlength=len(q[at : at + 256])).astype(np.int64)
            uid.append(ids[at : at + 256])
            links.append(n)
            stops = np.searchsorted(i, np.arange(at, at + 257))
            for x in np.flatnonzero(np.diff(stops)):
                own, met = mine[at + x], theirs[j[stops[x] : stops[x + 1]]]
                for t, first in zip(*np.unique(tree[met], return_index=True), strict=True):
                    if t != tree[own]:
                        forest.append((known[own], known[met[first]]))
                        tree[tree == t] = tree[own]
        uid, links = np.concatenate(uid), np.concatenate(links)
        some = links > 0
        edges = np.array(forest, np.int64).reshape(-1, 2)
        return pd.DataFrame(
            {
                "uid": np.concatenate([uid[some], edges[:, 0]]),
                "links": np.concatenate([links[some], np.zeros(len(edges), np.int64)]),
                "near": pd.array(np.concatenate([np.full(some.sum(), -1), edges[:, 1]]), "Int64"),
            }
        )

    return run


def duplicates(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """One row per row of ``vectors`` (vec_id long, embedding array of numbers,
    label; others are ignored): vec_id, n_links, component_id, kept.

    Vectors of one label are linked when their cosine in double precision is at
    least ``least``. n_links counts the other rows linked directly, component_id
    is the smallest vec_id reachable, kept says whether that is the row's own.

    Null labels, and vectors that are null, empty, zero, or hold null or
    non-finite components, are linked with nothing. Vectors of different length
    are never compared. Equal rows are linked with one another; rows of one
    vec_id are rows of their own. Null ids are kept; no rows give no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<double>").alias("v"),
    )
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce(F.col("label").isNotNull() & (F.size("v") > 0) & fine & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = scratch.write(rows.withColumn("v", F.when(usable, F.col("v"))).withColumn("row", F.monotonically_increasing_id()), "rows")

    # Equal vectors of a label are one entry; -0.0 equals 0.0.
    same = F.transform("v", lambda x: x + F.lit(0.0))
    entries = rows.where("v is not null").groupBy("label", same.alias("v"))
    entries = entries.agg(F.min("row").alias("uid"), F.count(F.lit(1)).alias("times"), F.min("vec_id").alias("least_id"))
    entries = scratch.write(entries.withColumn("dim", F.size("v")), "entries")
    dims = [r[0] for r in entries.groupBy("dim").agg(F.count(F.lit(1))).orderBy("dim").collect()]
    found = [_linked(entries.where(F.col("dim") == d), d, least, scratch) for d in dims]
    if not found:
        plain = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        return plain.withColumn("kept", F.lit(True))
    links = found[0]
    for other in found[1:]:
        links = links.unionByName(other)
    links = scratch.write(links, "links")

    parts = components(links.where("near >= 0").select(F.col("uid").alias("a"), F.col("near").alias("b")), scratch)
    counts = links.where("near < 0").groupBy("uid").agg(F.sum("links").alias("links"))
    whole = entries.join(parts.toDF("uid", "part"), "uid", "left").withColumn("part", F.coalesce("part", "uid"))
    smallest = whole.groupBy("part").agg(F.min("least_id").alias("component_id"))
    whole = whole.join(smallest, "part").join(counts, "uid", "left")
    whole = scratch.write(whole.select("label", "v", "component_id", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links")), "whole")
    keyed = rows.withColumn("v", same)
    out = keyed.join(whole, ["label", "v"], "left")
    out = out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _linked(entries: DataFrame, dim: int, least: float, scratch: Scratch) -> DataFrame:
    """(uid, links, near): counts of links where near is -1, else an edge of a spanning forest."""
    units = entries.mapInArrow(_unit, "uid long, label string, times long, unit binary")
    units, total, _ = scratch.write_counted(units, "units")
    taken = units.orderBy(F.xxhash64("uid"), "uid").limit(SAMPLE).select("unit").toArrow()
    sample = np.stack([np.frombuffer(x.as_buffer(), np.float64) for x in taken["unit"]])
    quantiser = Quantiser.fit(sample, min(MOST_LISTS, math.isqrt(total) + 1))
    radius = math.sqrt(max(0.0, 2 - 2 * least))
    coded = "uid long, label string, times long, unit binary, list long, codes binary, error double, reach double"
    members = scratch.write(units.mapInArrow(_coded(quantiser), coded), "members")
    far = np.full(len(quantiser.lists), -np.inf)
    for r in members.groupBy("list").agg(F.max("reach")).collect():  # one number a list
        far[r[0]] = r[1]
    # Small lists of a label share a block of members, a large one has several; a query goes to a block once.
    held = members.groupBy("label", "list").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("label").orderBy("list")) - F.col("n")
    held = held.withColumn("first", F.floor(before / BLOCK)).withColumn("salts", F.ceil(F.col("n") / BLOCK)).drop("n")
    held = scratch.write(held, "held")
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    asked = units.mapInArrow(_probes(quantiser, far, radius), "uid long, label string, list long").join(held, ["label", "list"])
    asked = asked.withColumn("salt", upto("salts")).select("uid", (F.col("first") + F.col("salt")).alias("mb")).distinct()
    queries = scratch.write(asked.join(units.select("uid", "label", "unit"), "uid"), "queries")
    counts = queries.groupBy("label", "mb").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("q"))
    counts = scratch.write(counts, "counts")
    members = members.join(held, ["label", "list"]).withColumn("mb", F.col("first") + F.pmod(F.xxhash64("uid"), "salts"))
    members = members.join(counts, ["label", "mb"]).withColumn("qb", upto("q"))
    queries = queries.join(counts, ["label", "mb"]).withColumn("qb", F.pmod(F.xxhash64("uid"), "q"))
    both_keys = ["label", "qb", "mb", "uid", "unit"]
    members = members.select(*both_keys, "list", "times", "codes", "error").toDF(*both_keys, "list", "times", "codes", "error")
    queries = queries.select(*both_keys).toDF(*both_keys)
    both = queries.groupBy("label", "qb", "mb").cogroup(members.groupBy("label", "qb", "mb"))
    return both.applyInPandas(_compared(quantiser, far, least, radius), "uid long, links long, near long")


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for v in batch["v"]:
            x = v.values.to_numpy(zero_copy_only=False)
            x = x / np.abs(x).max()  # so that no square overflows or vanishes
            out.append((x / np.linalg.norm(x)).tobytes())
        yield pa.RecordBatch.from_arrays([batch["uid"], batch["label"], batch["times"], pa.array(out, pa.binary())], ["uid", "label", "times", "unit"])
