"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import spread

#: The vocabulary's place on every machine, where neither a call nor the session's setting SETTING names another; it is no part of this library.
SETTING = "spark.lumenframe.vocabulary"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's texts are cut before merging (a fixed value of that public vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Any:
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, path: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``keep`` and tokens of each text; a null or empty text has none."""
    path = path or documents.sparkSession.conf.get(SETTING, VOCABULARY)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path)
        for b in batches:
            n = [len(coder.encode_ordinary(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", *keep)), pa.array(n, pa.int64())], names=["doc_id", *keep, "tokens"])

    df = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, F.col("text").cast("string").alias("text"))
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)
    return spread(df).mapInArrow(count, f"doc_id long, {kinds + ', ' if keep else ''}tokens long")
