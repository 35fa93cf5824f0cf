"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are taken as independent given the language of a text:

- its bytes: a naive Bayes model over hashed byte trigrams, counted by grouped
  aggregation over all texts with a known language, add-half smoothed. The log
  likelihood is divided by ``TEMPER``, as neighbouring trigrams share bytes;
- the language its markup declares, right with probability ``DECLARED``;
- the language in its address: a two-letter first path segment or the last label
  of the host, where that is one of the languages, right with ``ADDRESS``;
- its host, whose prior is smoothed towards that of the host's domain, and that
  towards the prior of all texts, with ``STRENGTH`` texts' weight each. The counts
  behind them are the languages found from the other evidence.

Trigram counts come to the driver as one table of languages by ``FEATURES``
numbers, whatever the size of the input; the host priors are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft.llm.words import slices
from graphweft.session import Scratch

FEATURES = 1 << 13
DECLARED, ADDRESS = 0.9, 0.8
STRENGTH = 20.0
TEMPER = 4.0
#: A text is kept when its best language has this posterior and it has letters at all.
LEAST = 0.5
#: Languages the model may hold, the most frequent first; a guard for the model's size.
MOST_LANGUAGES = 256

_SKIP = np.zeros(256, bool)
_SKIP[[*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[0x41:0x5B] += 0x20
_LOWER[_SKIP] = 0x20


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of the byte trigrams of some texts; anything but letters is a blank."""
    x = _LOWER[data]
    if len(x) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    feature = ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(51)).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = (text[:-2] == text[2:]) & (code != 0x202020)
    return text[:-2][inside], feature[inside]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of features by language, summed over the task."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        labels = batch["known"].to_pylist()
        for at, data, offsets in slices(batch["text"]):
            text, feature = _trigrams(data, offsets)
            names = labels[at : at + len(offsets) - 1]
            for name in set(names):
                own = np.array([n == name for n in names])[text] if len(text) else np.empty(0, bool)
                total.setdefault(name, np.zeros(FEATURES, np.int64))
                total[name] += np.bincount(feature[own], minlength=FEATURES)
    for name, counts in total.items():
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some), pa.array(counts[some])], ["known", "feature", "n"])


def _scored(model: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [n for n in batch.schema.names if n != "text"]
            for at, data, offsets in slices(batch["text"]):
                n = len(offsets) - 1
                text, feature = _trigrams(data, offsets)
                scores = np.stack([np.bincount(text, row[feature], n) for row in model], 1) if len(model) else np.zeros((n, 0))
                column = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(model), pa.int32()), pa.array(scores.ravel()))
                found = pa.array(np.bincount(text, minlength=n), pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch[c].slice(at, n) for c in names), column, found], [*names, "scores", "n_trigrams"])

    return run


def _domain(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def address_parts(url: Column) -> tuple[Column, Column]:
    """(host, language code in the address) of a URL; null where there is none."""
    host = F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/:?#]+)", 1), F.lit("")))
    segment = F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+/([A-Za-z]{2})(?:[/?#\-]|$)", 1), F.lit(""))
    return host, F.lower(F.coalesce(segment, F.substring_index(host, ".", -1)))


def markup_language(html: Column) -> Column:
    """The primary language that a page declares on its root element; null where there is none."""
    return F.lower(F.nullif(F.regexp_extract(html, r"(?i)<html[^>]*\slang\s*=\s*[\"']?([A-Za-z]{2,3})", 1), F.lit("")))


#: Columns made on the way; those of these names in the input are replaced.
_OWN = "scores n_trigrams evidence first domain prior total top found posterior declared_ok accepted".split()


def identify(rows: DataFrame) -> DataFrame:
    """``rows`` with columns found, posterior, declared_ok and accepted added.

    rows: text, known (a language to learn from, or null), declared, address and
    host, all strings that may be null, and any other columns, which stay unless
    they have a name of ``_OWN``. found
    is the language of highest posterior, ties to the smaller name; accepted says
    that the text has letters and the posterior is ``LEAST`` or more; declared_ok
    whether declared is null or found.

    Null evidence counts for nothing. A null or empty text, and one without a
    letter, is not accepted; it still gets the language of its other evidence.
    Without any known language, found is null and nothing is accepted. Repeated
    rows stay; no rows give none.
    """
    scratch = Scratch(rows.sparkSession)
    rows = rows.drop(*_OWN)
    rows = rows.withColumns({c: F.col(c).cast("string") for c in ("text", "known", "declared", "address", "host")})
    learnt = rows.where("known is not null and text is not null").select("text", "known")
    counts = learnt.mapInArrow(_counted, "known string, feature long, n long").groupBy("known", "feature").agg(F.sum("n").alias("n"))
    counts = scratch.write(counts, "counts")
    names = counts.groupBy("known").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "known").limit(MOST_LANGUAGES)
    languages = sorted(r["known"] for r in names.collect())
    table = np.full((len(languages), FEATURES), 0.5)
    held = counts.where(F.col("known").isin(languages)).toArrow() if languages else None
    if held is not None:
        at = {name: i for i, name in enumerate(languages)}
        table[[at[k] for k in held["known"].to_pylist()], held["feature"].to_numpy()] += held["n"].to_numpy()
    model = np.log(table / table.sum(1, keepdims=True)) / TEMPER

    kept = [c for c in rows.columns if c != "text"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    scored = rows.select(*kept, "text").mapInArrow(_scored(model), f"{fields}, scores array<double>, n_trigrams long")
    scored = scratch.write(scored, "scored")
    names = F.array(*map(F.lit, languages)).cast("array<string>")
    k = max(2, len(languages))

    def told(column: str, right: float) -> Column:
        """Log likelihood of a declaration under each language; none if it is no known language."""
        some = F.array_contains(names, F.col(column))
        hit = lambda name: F.when(F.col(column) == name, float(np.log(right))).otherwise(float(np.log((1 - right) / (k - 1))))
        return F.transform(names, lambda name: F.when(some, hit(name)).otherwise(0.0))

    plus = lambda x, y: F.zip_with(x, y, lambda a, b: a + b)
    evidence = plus(plus(F.col("scores"), told("declared", DECLARED)), told("address", ADDRESS))
    fused = scored.withColumn("evidence", evidence).withColumn("first", F.array_position("evidence", F.array_max("evidence")) - 1)
    fused = fused.withColumn("domain", _domain(F.col("host")))

    # Counts of the languages found so far, by host, by domain and over all, as arrays.
    hits = [F.sum((F.col("first") == i).cast("double")) for i in range(len(languages))]
    by_host = fused.where("host is not null").groupBy("host", "domain").agg(F.array(*hits).alias("at_host"))
    by_host = scratch.write(by_host, "hosts")
    by_domain = by_host.groupBy("domain").agg(F.array(*(F.sum(F.col("at_host")[i]) for i in range(len(languages)))).alias("at_domain"))
    over_all = fused.agg(*(F.coalesce(h, F.lit(0.0)).alias(f"l{i}") for i, h in enumerate(hits))).first() if languages else []
    base = [(x + 1.0) / (sum(over_all) + len(languages)) for x in over_all]
    base_prior = F.array(*map(F.lit, base)).cast("array<double>")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    smooth = lambda n, prior: F.zip_with(n, prior, lambda a, p: (a + p * STRENGTH) / (total(n) + STRENGTH))
    priors = by_host.join(by_domain, "domain")
    priors = priors.select("host", smooth(F.col("at_host"), smooth(F.col("at_domain"), base_prior)).alias("prior"))
    priors = scratch.write(priors, "priors")
    out = fused.join(priors, "host", "left").withColumn("prior", F.coalesce("prior", base_prior))
    out = out.withColumn("total", F.zip_with("evidence", "prior", lambda e, p: e + F.log(p)))
    out = out.withColumn("top", F.array_max("total"))
    best = (F.array_position("total", F.col("top")) - 1).cast("int")
    posterior = F.try_divide(F.lit(1.0), total(F.transform("total", lambda x: F.exp(x - F.col("top")))))
    out = out.withColumns({"found": F.get(names, best), "posterior": posterior})
    accepted = F.coalesce((F.col("n_trigrams") > 0) & (F.col("posterior") >= LEAST), F.lit(False))
    out = out.withColumns({"accepted": accepted, "declared_ok": F.coalesce(F.col("declared") == F.col("found"), F.lit(True))})
    return out.select(*kept, "found", "posterior", "declared_ok", "accepted", "n_trigrams")


def with_pages(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows for ``identify`` from documents and the web pages they come from. A
    page belongs to the document whose number its address ends in; of several
    pages the one of the smallest page_id speaks. A document without a page has
    its column lang as declaration and its source as host."""
    number = F.regexp_extract("url", r"/([0-9]{1,18})(?:[./?#].*)?$", 1)
    host, code = address_parts(F.col("url"))
    found = pages.where(number != "").select(number.cast("long").alias("of"), "page_id", markup_language(F.col("html")).alias("markup"), host.alias("page_host"), code.alias("address"))
    found = found.groupBy("of").agg(F.min_by(F.struct("markup", "page_host", "address"), "page_id").alias("page")).select("of", "page.*")
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source").join(found, F.col("doc_id") == F.col("of"), "left")
    return out.select(
        "doc_id", "text", F.col("lang").alias("known"), F.coalesce("markup", "lang").alias("declared"), "address",
        F.coalesce("page_host", "source").alias("host"),
    )
