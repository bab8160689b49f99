"""Token counts by a public tokenizer, as an Arrow-batched column function."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern of the public byte-level BPE.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of a text; 0 for null and empty ones."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        enc = encoding(vocabulary)
        return pd.Series([len(enc.encode_ordinary(t)) if isinstance(t, str) and t else 0 for t in texts], dtype="int64")

    return count(text)
