"""Counting tokens of a public tokenizer, in Arrow batches."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where vocabulary files lie; every operator takes the path as a parameter.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The pre-splitting pattern published with byte-level BPE vocabularies of this kind (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column | str, path: str = VOCABULARY) -> Column:
    """Tokens of a whole text; 0 for an empty or null one."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(path)
        for s in batches:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in s], dtype="int32")

    return count(text)


def with_tokens(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens) of every document with an id, once per id."""
    docs = documents.where("doc_id is not null").select("doc_id", "source", "text")
    return docs.select("doc_id", "source", token_count("text", path).alias("n_tokens"))
