"""Token counts from pre-tokens, without token ids.

A byte-level BPE never merges across pre-tokens, so a text has as many tokens as
its pre-tokens have together. For each block of texts the pieces of a distinct
pre-token are counted once, the counts are joined to the pre-token frequencies
of each text, and summed. The dictionary side of that join is bounded by the
block (``pretokens.BLOCK_BYTES`` of text), so nothing is shuffled, and a block
lost with its executor is made anew.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.llm.pretokens import Memory, blocks, numbered


def _checked(spec_text: str) -> list[str]:
    """The special strings of a tokenizer file of the kind that is counted here."""
    spec = json.loads(spec_text)
    kind, added = spec["pre_tokenizer"] or {}, spec["added_tokens"]
    if kind.get("type") != "ByteLevel" or kind["add_prefix_space"] or spec["normalizer"] or not kind.get("use_regex", True):
        raise ValueError("byte-level tokenizers without normalizer and prefix space are counted")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError("added tokens must be plain strings")
    return sorted((t["content"] for t in added), key=lambda t: (-len(t), t))


@lru_cache(maxsize=2)
def _loaded(spec_text: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(spec_text)
    made.no_padding()
    made.no_truncation()
    made.encode_special_tokens = True  # a pre-token is ordinary text
    return made


def _counting(spec_text: str, special: list[str], pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _loaded(spec_text)
        cut = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        pieces = Memory(lambda words: [len(e) for e in made.encode_batch_fast(words, add_special_tokens=False)])
        for batch in batches:
            for at, n_bytes, texts, split in blocks(batch["text"], pattern):
                whole = np.array([len(cut.findall(t)) if any(s in t for s in special) else 0 for t in texts], np.int64)
                found = [
                    [p for part in cut.split(t) for p in f(part)] if n else f(t)
                    for t, f, n in zip(texts, split, whole, strict=True)
                ]
                words, code, lengths = numbered(found)
                count = np.array(pieces.of(words), np.int64)
                # frequencies of the distinct pre-tokens of each text, joined to their counts
                pair, times = np.unique(np.repeat(np.arange(len(texts)), lengths) * max(1, len(words)) + code, return_counts=True)
                text, word = np.divmod(pair, max(1, len(words)))
                tokens = whole + np.bincount(text, times * count[word] if len(pair) else None, len(texts)).astype(np.int64)
                columns = [batch["doc_id"].slice(at, len(texts)), pa.array(n_bytes, pa.int64()), pa.array(tokens)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str, pattern: str, limit: int = 1024) -> DataFrame:
    """One row per row of ``docs`` (doc_id long, text string; others are
    ignored): doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    path: a byte-level tokenizer file of the tokenizers library, read on the
    driver; pattern: its pre-token pattern. Special strings inside a text are one
    token, as by the library's default. Null texts count as empty, with 0 bytes
    and tokens; repeated rows and null ids stay as they are; no rows give none.
    """
    spec_text = Path(path).read_text(encoding="utf-8")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = docs.mapInArrow(_counting(spec_text, _checked(spec_text), pattern), "doc_id long, n_bytes long, n_tokens long")
    return made.withColumn("over_limit", F.col("n_tokens") > limit)
