"""Token counts of a public tokenizer. Its file is a parameter and stays where it is."""

from __future__ import annotations

import base64
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how byte-level BPE of this family cuts a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def encoding(path: str = TOKENIZER):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("voxloom", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def byte_lengths(path: str = TOKENIZER) -> np.ndarray:
    enc = encoding(path)
    return np.array([len(enc.decode_single_token_bytes(i)) for i in range(enc.n_vocab)], np.int32)


def count(text: str | None, path: str = TOKENIZER) -> int:
    """Tokens of a text; 0 for null. Lone surrogates count as the replacement character."""
    if not text:
        return 0
    return len(encoding(path).encode_ordinary(text))


def token_count(text: Column | str, path: str = TOKENIZER) -> Column:
    @F.pandas_udf(T.LongType())
    def counted(texts: pd.Series) -> pd.Series:
        return pd.Series([count(t if isinstance(t, str) else None, path) for t in texts], dtype="int64")

    return counted(text)
