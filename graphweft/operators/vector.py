"""Exact and approximate nearest neighbours by cosine similarity."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweft.functions.vectors import is_nonzero, l2_normalize
from graphweft.schema import DEFAULT_TOP_K
from graphweft.session import rows_within

# Query vectors that travel inside the plan. More than that are joined to the
# entities block by block.
QUERIES_IN_PLAN = 1024
# Entities and queries per group of the blocked join.
ENTITY_BLOCK = 32_768
QUERY_BLOCK = 1024

_OUT = "query_id bigint, name string, qualified_name string, kind string, score double"


def _matrix(vectors: list | pd.Series) -> np.ndarray:
    rows = np.asarray([np.asarray(v, dtype=np.float64) for v in vectors], dtype=np.float64)
    lengths = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(lengths > 0, lengths, 1.0)


def _candidates(unit: np.ndarray, kinds: np.ndarray, queries: np.ndarray, k: int) -> tuple:
    """(row, query, score) of every entity at or above the k-th best score of its
    kind. Scores are (1 + cosine) / 2 at six decimals."""
    scores = np.round((1.0 + unit @ queries.T) / 2.0, 6)
    rows, cols = [], []
    for kind in np.unique(kinds):
        members = np.flatnonzero(kinds == kind)
        block = scores[members]
        if len(members) > k:
            floor = np.partition(block, len(members) - k, axis=0)[len(members) - k]
            r, c = np.nonzero(block >= floor)
        else:
            r, c = (a.ravel() for a in np.indices(block.shape))
        rows.append(members[r])
        cols.append(c)
    row = np.concatenate(rows) if rows else np.empty(0, dtype=int)
    col = np.concatenate(cols) if cols else np.empty(0, dtype=int)
    return row, col, scores[row, col]


def _plain(rows: pd.DataFrame) -> pd.DataFrame:
    # Concatenated Arrow strings come in chunks, which a record batch cannot hold.
    return rows.astype({"name": object, "qualified_name": object, "kind": object})


def _best(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    ordered = rows.sort_values(["score", "qualified_name"], ascending=[False, True], kind="stable")
    return ordered.groupby(["query_id", "kind"], sort=False).head(k)


def _topk_in_tasks(query_ids: list[int], queries: np.ndarray, k: int):
    """Scores Arrow batches against the query matrix and leaves each task with
    at most ``k`` rows per query and kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.asarray(query_ids, dtype=np.int64)
        kept: list[pd.DataFrame] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if len(flat) != batch.num_rows * queries.shape[1]:
                raise ValueError("an embedding does not have the dimension of the query")
            vectors = flat.reshape(batch.num_rows, -1)
            lengths = np.linalg.norm(vectors, axis=1)
            usable = np.flatnonzero(lengths > 0)
            kinds = batch.column("kind").to_numpy(zero_copy_only=False)[usable]
            row, col, score = _candidates(vectors[usable] / lengths[usable, None], kinds, queries, k)
            picked = batch.select(["name", "qualified_name", "kind"]).take(pa.array(usable[row])).to_pandas()
            kept.append(_best(picked.assign(query_id=ids[col], score=score), k))
            if sum(map(len, kept)) > 200_000:
                kept = [_best(pd.concat(kept), k)]
        if kept:
            table = _best(pd.concat(kept), k)[["query_id", "name", "qualified_name", "kind", "score"]]
            yield pa.RecordBatch.from_pandas(_plain(table), preserve_index=False)

    return run


def _usable(entities: DataFrame, kinds: tuple[str, ...] | None) -> DataFrame:
    rows = entities.where(F.col("embedding").isNotNull())
    if kinds is not None:
        rows = rows.where(F.col("kind").isin(*kinds))
    return rows.select("name", "qualified_name", "kind", "embedding")


def vector_topk(
    entities: DataFrame, queries, k: int = DEFAULT_TOP_K, kinds: tuple[str, ...] | None = None
) -> DataFrame:
    """The ``k`` nearest entities of every kind for every query vector.

    ``queries`` is a list or DataFrame of (query_id, vector). Up to
    ``QUERIES_IN_PLAN`` queries are shipped with the tasks: the entities are read
    once, never shuffled, and a task returns at most ``k`` rows per query and
    kind. More queries are joined block-wise. Zero vectors match nothing.
    """
    if isinstance(queries, DataFrame):
        nonzero = queries.select(F.col("query_id").cast("bigint").alias("query_id"), "vector").where(is_nonzero(F.col("vector")))
        rows = rows_within(nonzero, QUERIES_IN_PLAN)
        if rows is None:
            return _rank_per_kind(_blocked_topk(_usable(entities, kinds), nonzero, k), k)
    else:
        rows = [(q, v) for q, v in queries if any(v)]
        if len(rows) > QUERIES_IN_PLAN:
            parts = [rows[i : i + QUERIES_IN_PLAN] for i in range(0, len(rows), QUERIES_IN_PLAN)]
            return reduce(DataFrame.unionByName, [vector_topk(entities, part, k, kinds) for part in parts])
    if not rows:
        return entities.sparkSession.createDataFrame([], _OUT)
    scorer = _topk_in_tasks([int(r[0]) for r in rows], _matrix([r[1] for r in rows]), k)
    return _rank_per_kind(_usable(entities, kinds).mapInArrow(scorer, _OUT), k)


def _rank_per_kind(hits: DataFrame, k: int) -> DataFrame:
    rank = Window.partitionBy("query_id", "kind").orderBy(F.desc("score"), "qualified_name")
    return hits.withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= k).drop("_rank")


def _numbers(count: int) -> Column:
    return F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint"))


def _blocked_topk(entities: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Every query block meets every entity block in one group of bounded size.
    Blocks are cut by hashes of unique keys, so none of them is hot."""
    entity_blocks = max(1, -(-entities.count() // ENTITY_BLOCK))
    query_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    left = entities.select(
        "*",
        F.pmod(F.xxhash64("qualified_name", "kind"), F.lit(entity_blocks)).alias("eb"),
        F.explode(_numbers(query_blocks)).alias("qb"),
    )
    right = queries.select(
        "*",
        F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).alias("qb"),
        F.explode(_numbers(entity_blocks)).alias("eb"),
    )

    def score(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "name", "qualified_name", "kind", "score"]
        if rows.empty or asked.empty:
            return _plain(pd.DataFrame({c: [] for c in columns}).astype({"query_id": "int64", "score": "float64"}))
        usable = rows[rows["embedding"].map(lambda v: bool(np.any(v)))].reset_index(drop=True)
        row, col, scores = _candidates(
            _matrix(usable["embedding"]), usable["kind"].to_numpy(), _matrix(asked["vector"]), k
        )
        picked = usable.iloc[row][["name", "qualified_name", "kind"]].reset_index(drop=True)
        return _plain(_best(picked.assign(query_id=asked["query_id"].to_numpy()[col], score=scores), k)[columns])

    return left.groupBy("qb", "eb").cogroup(right.groupBy("qb", "eb")).applyInPandas(score, _OUT)


def topk_overall(hits: DataFrame, k: int) -> DataFrame:
    """Cut the per-kind hits of each query to its ``k`` best, ranked from 1."""
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "qualified_name", "kind")
    return hits.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def _query_blocks(queries, columns: tuple[str, ...], per_pass: int) -> list[list[tuple]]:
    """Query rows in blocks of about ``per_pass``. A list is sliced; a DataFrame
    is read block by block, so the driver holds one block at a time."""
    if isinstance(queries, DataFrame):
        rows = queries.select(*columns)
        blocks = max(1, -(-rows.count() // per_pass))
        if blocks == 1:
            return [[tuple(r) for r in rows.collect()]]
        block = F.pmod(F.xxhash64(columns[0]), F.lit(blocks))
        return [[tuple(r) for r in rows.where(block == i).collect()] for i in range(blocks)]
    rows = [tuple(q) for q in queries]
    return [rows[i : i + per_pass] for i in range(0, len(rows), per_pass)] or [[]]


class LshIndex:
    """Random-projection buckets over unit vectors, for approximate search.

    ``table`` is the entities with one bucket code per hash table. A search reads
    the rows that share a code with any of its queries and scores those exactly,
    in the tasks: no candidate pair is ever emitted, however full a bucket is.
    """

    def __init__(self, entities: DataFrame, bucket_length: float = 0.5, tables: int = 4, seed: int = 17):
        unit = self._with_unit(_usable(entities, None), "embedding")
        model = BucketedRandomProjectionLSH(
            inputCol="unit", outputCol="buckets", bucketLength=bucket_length, numHashTables=tables, seed=seed
        )
        # The projections depend on the dimension and the seed alone, so the
        # model is fitted on a single row.
        self.model = model.fit(unit.limit(1))
        self.table = self._coded(unit)

    @staticmethod
    def _with_unit(df: DataFrame, column: str) -> DataFrame:
        return df.where(is_nonzero(F.col(column))).withColumn("unit", array_to_vector(l2_normalize(F.col(column))))

    def _coded(self, unit: DataFrame) -> DataFrame:
        codes = F.transform(
            F.transform("buckets", lambda v: vector_to_array(v)[0]), lambda b, i: F.concat_ws(":", i.cast("string"), b.cast("bigint").cast("string"))
        )
        return self.model.transform(unit).withColumn("codes", codes).drop("unit", "buckets")

    def search(self, queries: DataFrame, k: int = DEFAULT_TOP_K) -> DataFrame:
        """Approximate top ``k`` per query over all kinds."""
        parts = []
        for block in _query_blocks(queries, ("query_id", "vector"), QUERIES_IN_PLAN):
            asked = queries.sparkSession.createDataFrame(block, "query_id bigint, vector array<double>")
            codes = self._coded(self._with_unit(asked, "vector")).select(F.explode("codes").alias("code")).distinct()
            wanted = [r.code for r in codes.collect()]
            near = self.table.where(F.arrays_overlap("codes", F.array(*[F.lit(c) for c in wanted]))) if wanted else self.table.limit(0)
            parts.append(topk_overall(vector_topk(near, block, k), k))
        return reduce(DataFrame.unionByName, parts)
