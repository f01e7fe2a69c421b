"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folder of the tokenizer files, and the file taken from it.
FOLDER, FILE = "/opt/tokenizers", "byte_bpe_multi_50k.tiktoken"

# Fixed value: how byte-level vocabularies of this family split a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load(folder: str = FOLDER, file: str = FILE):
    import tiktoken

    with open(os.path.join(folder, file), "rb") as f:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
    return tiktoken.Encoding(file, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def n_tokens(text: Column, folder: str = FOLDER, file: str = FILE) -> Column:
    """Tokens of the whole text; 0 for an empty one, null for null."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = load(folder, file)
        for texts in batches:
            yield texts.map(lambda t: None if t is None else len(coder.encode_ordinary(t))).astype("Int64")

    return count(text)


def with_tokens(df: DataFrame, text: str = "text", out: str = "tokens", **where: str) -> DataFrame:
    return df.withColumn(out, n_tokens(F.col(text), **where))
