"""From raw documents to encoded training text, in five stages.

Each stage is a function of (spark, docs, sf_dir) and works on all that the stage
before it kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.llm import byte_bpe, language_id, mixing, ngram_join, substring_dedup
from graphweft.llm.words import SPACE_CLASS
from graphweft.session import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _columns(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars by the text as it now is."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def _matching(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """One row of ``docs`` for each (doc_id, mark), the hash of its text, in ``kept``."""
    # keys without nulls: rows are told apart and joined in one shuffle of the texts
    keys = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("id"), F.col("doc_id").isNull().alias("none"), "mark"]
    held = docs.withColumn("mark", F.xxhash64(F.col("text").cast("string"))).select("*", *keys[:2]).dropDuplicates(["id", "none", "mark"])
    return held.join(kept.select(*keys), ["id", "none", "mark"], "left_semi")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain enough; lang becomes the language
    found. Null, empty and letterless texts go. Each row is judged by itself."""
    scratch = Scratch(spark)
    rows = language_id.with_pages(docs, spark.read.parquet(f"{sf_dir}/pages.parquet"))
    found = language_id.identify(rows.withColumn("mark", F.xxhash64("text")))
    # rows of one id, text and lang are told by the same evidence and share the verdict
    found = found.where("accepted").groupBy("doc_id", "mark", "known").agg(F.min("found").alias("found"))
    found = scratch.write(found, "found")
    held = docs.withColumn("mark", F.xxhash64(F.col("text").cast("string")))
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.mark") == F.col("f.mark")) & F.col("d.lang").eqNullSafe(F.col("f.known"))
    return _columns(held.alias("d").join(found.alias("f"), same).select("d.doc_id", "d.text", F.col("f.found").alias("lang"), "d.source"))


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the smallest id; five
    words and a similarity of 0.8 or more. Texts without words are no copies."""
    scratch = Scratch(spark)
    parts = scratch.write(ngram_join.similar_texts(docs, k=5, num=80, den=100), "parts")
    alone = parts.where("group is null").select("doc_id", "mark")
    first = parts.where("group is not null").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("kept"))
    kept = scratch.write(alone.union(first.select("kept.doc_id", "kept.mark")).distinct(), "kept")
    return _columns(_matching(docs, kept))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the paragraphs and passages that another one keeps; a
    document of which nothing is left goes."""
    return _columns(substring_dedup.without_repeats(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes: a row for each time one is taken. A document
    that the mix takes in part keeps its first words, with single blanks."""
    scratch = Scratch(spark)
    docs = docs.withColumn("mark", F.xxhash64(F.col("text").cast("string"))).dropDuplicates(["doc_id", "mark"])
    docs = scratch.write(docs, "docs")
    rows, _, pieces = mixing.mix(docs, carry=("mark",))
    turns = pieces.groupBy("row", "turn").agg(F.max("end").alias("words"))
    taken = scratch.write(turns.join(rows.select("row", F.col("doc_id").alias("of"), "size", F.col("mark").alias("of_mark")), "row"), "taken")
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("of_mark"))
    first = F.array_join(F.slice(F.array_remove(F.split("text", SPACE_CLASS), ""), 1, F.col("words").cast("int")), " ")
    text = F.when(F.col("words") < F.col("size"), first).otherwise(F.col("text"))
    return _columns(docs.join(taken, same).withColumn("text", text))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, ids, and whether the ids decode to the text's bytes."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = byte_bpe.encode_decode(docs.select(*COLUMNS), path, public_tokenizers.PATTERN)
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return coded.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("language_id", identify_language),
    ("near_copies", join_near_copies),
    ("substring_dedup", cut_repeats),
    ("source_mix", mix_sources),
    ("byte_bpe", encode_texts),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``, each written before the next reads it."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
