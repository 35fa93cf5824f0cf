"""Embedding providers, pooling and normalisation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.feature import HashingTF, Normalizer, Tokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.functions.text import embedding_text
from graphweft.functions.vectors import zeros
from graphweft.schema import DEFAULT_DIMENSION

Provider = Callable[[DataFrame, str, int], DataFrame]


def zero_provider(df: DataFrame, text_column: str, dimension: int) -> DataFrame:
    """All zeros: searches fall back to names."""
    return df.withColumn("embedding", zeros(dimension))


def hashing_provider(df: DataFrame, text_column: str, dimension: int) -> DataFrame:
    """Hashed term frequencies at unit length; needs no model and no fitting."""
    stages = [
        Tokenizer(inputCol=text_column, outputCol="_tokens"),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dimension),
        Normalizer(inputCol="_tf", outputCol="_unit", p=2.0),
    ]
    hashed = Pipeline(stages=stages).fit(df).transform(df)
    return hashed.withColumn("embedding", vector_to_array("_unit", "float32")).drop("_tokens", "_tf", "_unit")


PROVIDERS: dict[str, Provider] = {
    "none": zero_provider,
    "disabled": zero_provider,
    "hashing": hashing_provider,
}


def register_provider(name: str, provider: Provider) -> None:
    """Add a provider: a function (DataFrame, text column, dimension) that
    returns the DataFrame with an ``embedding`` column."""
    PROVIDERS[name] = provider


def embed(df: DataFrame, text_column: str, provider: str = "hashing", dimension: int = DEFAULT_DIMENSION) -> DataFrame:
    if provider not in PROVIDERS:
        raise ValueError(f"unknown embedding provider: {provider}")
    return PROVIDERS[provider](df.drop("embedding"), text_column, dimension)


def embed_entities(entities: DataFrame, provider: str = "hashing", dimension: int = DEFAULT_DIMENSION) -> DataFrame:
    """Embed every entity's text; the vector stays on its row."""
    text = embedding_text(F.col("kind"), F.col("name"), F.col("signature"), F.col("doc_comment"), F.col("source_text"))
    return embed(entities.withColumn("_text", text), "_text", provider, dimension).drop("_text")


def dimensions(df: DataFrame) -> DataFrame:
    return df.agg(F.max(F.size("embedding")).alias("dimensions"))


def mean_pool(tokens: DataFrame, dimension: int) -> DataFrame:
    """Average of the token vectors whose mask is 1, per id.

    ``tokens`` holds (id, mask, vector). The averaging buffers are merged in the
    map tasks, so an id with very many tokens sends one buffer per task. An id
    without any masked token keeps a zero vector.
    """
    # Rows outside the mask only matter by their id, so the buffer sees one
    # vector per masked token.
    pooled = (
        tokens.where("mask = 1")
        .select("id", array_to_vector("vector").alias("v"))
        .groupBy("id")
        .agg(Summarizer.mean(F.col("v")).alias("mean"))
        .select("id", vector_to_array("mean").alias("vector"))
    )
    empty = F.array_repeat(F.lit(0.0), dimension)
    return tokens.select("id").distinct().join(pooled, "id", "left").select("id", F.coalesce("vector", empty).alias("vector"))
