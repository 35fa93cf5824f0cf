"""The registered queries of this package and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.llm import (
    alignment,
    byte_bpe,
    divergence,
    language_id,
    lm_scoring,
    mixing,
    ngram_join,
    quality_classifier,
    quality_rules,
    substring_dedup,
    token_counts,
    toxicity,
    vector_dedup,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op2_ngram_join", sql=r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM items x JOIN items y ON x.g = y.g AND x.doc_id <> y.doc_id
    AND 100 * x.n >= 90 * y.n AND 100 * y.n >= 90 * x.n
  GROUP BY ALL HAVING 100 * count(*) >= 90 * (any_value(x.n) + any_value(y.n) - count(*))
), reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles,
  least(doc_id, coalesce((SELECT min(b) FROM reach r WHERE r.a = sets.doc_id), doc_id)) AS component_id
FROM sets
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.similar_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_shingles", "component_id")


@query("op7_byte_bpe")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = byte_bpe.decode(byte_bpe.encode(docs, path, public_tokenizers.PATTERN).drop("text"), path)
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op9_token_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


@query("op1_embedding_dedup", sql="""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
best AS (SELECT a, min(b) AS least FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(best.least, vec_id)) AS component_id,
  least(vec_id, coalesce(best.least, vec_id)) = vec_id AS kept
FROM embeddings e LEFT JOIN best ON best.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op3_quality_rules", sql=r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
b AS (SELECT doc_id, text, l, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) AS g FROM f),
win AS (SELECT doc_id, unnest(g) AS g, unnest(range(0, len(g))) AS p FROM b),
rep AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cover AS (SELECT doc_id, CAST(sum(least(5, coalesce(nxt - p, 5))) AS BIGINT) AS n FROM
  (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS nxt FROM rep) GROUP BY doc_id),
base AS (SELECT b.*, coalesce(c.n, 0) AS n_repeat_words, n_words < 10 OR 100 * coalesce(c.n, 0) > 20 * n_words AS base_failed
  FROM b LEFT JOIN cover c USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_dup_lines > 3 * len(l)
    OR 10 * len(list_filter(l, lambda x: regexp_matches(x, '^\s*[•‣\-*]\s'))) > 9 * len(l)
    OR 10 * len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) > 3 * len(l)
    OR contains(lower(text), 'lorem ipsum')) AS kept
FROM base
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query("op10_source_mix", sql=rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS DOUBLE) AS weight
  FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER k AS nth, (SELECT sum(size) FROM d) AS total,
  CAST((SELECT sum(size) FROM d) - coalesce(sum(3 * source_size) OVER (k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / sum(weight) OVER (k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s WINDOW k AS (ORDER BY 3 * source_size / weight, source IS NULL, source)),
t AS (SELECT source, source_size, CAST(total AS DOUBLE) AS total, least(3.0 * source_size,
  weight * (SELECT arg_min(level, nth) FROM o WHERE 3 * source_size >= level * weight)) AS target FROM o),
r AS (SELECT source, coalesce(lag(hi) OVER k, 0.0) AS lo, CASE WHEN lead(hi) OVER k IS NULL THEN 2.0 ELSE hi END AS hi FROM (
  SELECT source, sum(target) OVER (ORDER BY source IS NULL, source) / total AS hi FROM t WHERE target > 0) WINDOW k AS (ORDER BY source IS NULL, source)),
b AS (SELECT CAST(greatest(1, least({mixing.BLOCK_WORDS}, sum(size) // {mixing.LEAST_SLOTS})) AS BIGINT) AS block, CAST(sum(size) AS BIGINT) AS total FROM d),
n AS (SELECT unnest(range((SELECT (total + block - 1) // block FROM b))) AS slot),
p AS (SELECT slot, floor(slot / 1048576) * {mixing._GOLDEN_STRIDE!r}::DOUBLE AS x, (slot % 1048576) * {mixing._GOLDEN!r}::DOUBLE AS y FROM n),
u AS (SELECT slot, x - floor(x) + (y - floor(y)) AS z FROM p),
c AS (SELECT r.source, count(*) * (SELECT block FROM b) AS words FROM u JOIN r ON z - floor(z) >= lo AND z - floor(z) < hi GROUP BY r.source),
f AS (SELECT doc_id, source, size, CASE WHEN size > 0 THEN sum(size) OVER (PARTITION BY source, size > 0 ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id, size
  ROWS UNBOUNDED PRECEDING) - size END AS start FROM d)
SELECT f.doc_id, f.size, t.source_size, t.target, CAST(coalesce((SELECT sum(greatest(0, least(f.size, c.words - k * t.source_size - f.start)))
  FROM range(3) AS g(k)), 0) AS BIGINT) AS taken
FROM f JOIN t ON f.source IS NOT DISTINCT FROM t.source LEFT JOIN c ON f.source IS NOT DISTINCT FROM c.source
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query("op4_substring_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, pages = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "pages"))
    found = language_id.identify(language_id.with_pages(docs, pages))
    return found.select("doc_id", F.col("found").alias("lang"), F.round("posterior", 6).alias("posterior"), "declared_ok", F.col("accepted").alias("kept"))


@query("op6_lm_scoring")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return lm_scoring.score(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def grades(labels: DataFrame) -> DataFrame:
    """Grades of the rated texts: 0 poor, 1 good but toxic, 2 good and clean."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return labels.where("quality is not null and toxic is not null").select("doc_id", grade.alias("grade"))


@query("op5_quality_classifier")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality_classifier.graded(docs, grades(labels))


@query("op13_source_divergence", sql=r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
s AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n
  FROM (SELECT DISTINCT lang, source FROM d) g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT s.*, CAST(1 + (1000000000::HUGEINT * (s.n + 5)) // (sum(s.n) OVER (PARTITION BY s.lang, s.source) + 5 * v.v) AS BIGINT) AS p,
  CAST(1 + (1000000000::HUGEINT * (s.lang_n + 5)) // (v.total + 5 * v.v) AS BIGINT) AS q FROM s JOIN v ON v.lang = s.lang),
a AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM (SELECT DISTINCT lang, source FROM d) a
  JOIN (SELECT DISTINCT lang, source FROM d) b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN a f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
found AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.diverging(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query("op12_token_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    byte_level, pieces = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.aligned(docs, byte_level, public_tokenizers.PATTERN, pieces)


@query("op11_toxicity")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.toxicity(docs, labels)
