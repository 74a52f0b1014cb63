"""Token counts by a public tokenizer's vocabulary file."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary's tokenizer cuts text before merging.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@lru_cache(maxsize=4)
def encoding(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def count(text: str, path: str = VOCABULARY) -> int:
    return len(encoding(path).encode_ordinary(text))


def with_counts(docs: DataFrame, keep: list, text: str, path: str = VOCABULARY) -> DataFrame:
    """``keep`` columns and n_tokens of every row with a text; an empty text has no tokens, a null one no row."""
    small_batches(docs.sparkSession)
    src = docs.filter(F.col(text).isNotNull()).select(*keep, F.col(text).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "_text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoding(path)
        for p in batches:
            yield p.drop(columns="_text").assign(n_tokens=[len(e.encode_ordinary(t)) for t in p["_text"]])

    return src.mapInPandas(run, kinds + ", n_tokens bigint")
