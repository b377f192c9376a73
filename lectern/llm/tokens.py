"""Sizes in tokens of a public tokenizer: the multilingual byte-level BPE of 50,256 entries."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary lies; the file is read on the executors and never copied into this package.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the split pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(2)
def encoding(path: str = VOCABULARY):
    """The tokenizer, built once per process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, keys: list[str], text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``keys, n_tokens`` for every row with a text (an empty text has 0 tokens)."""
    rows = df.select(*keys, F.col(text).alias("_text")).where("_text IS NOT NULL")
    types = dict(rows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(path).encode_ordinary
        for b in batches:
            yield b[keys].assign(n_tokens=[len(encode(t)) for t in b["_text"]])

    return rows.mapInPandas(run, ", ".join([*(f"`{k}` {types[k]}" for k in keys), "n_tokens long"]))
