"""Token ids in Python workers, for operators that need counts or positions rather than the encoding itself.

tokens.py encodes inside Spark; test_tokens.py holds both against each other."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.llm.tokens import VOCABULARY

# --- fixed value: the vocabulary's word pattern ------------------------------------------------------
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# -----------------------------------------------------------------------------------------------------


@lru_cache(maxsize=4)
def encoding(path: str = VOCABULARY):
    """The tokenizer, once per worker process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("from-file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def n_tokens(text: Column, path: str = VOCABULARY) -> Column:
    """Number of tokens of a text, 0 for null and empty ones."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in batch], dtype="int32")

    return count(text)
