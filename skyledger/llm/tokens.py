"""Token counts with a public tokenizer, in Arrow batches; the tokenizer file's path is a parameter."""

from __future__ import annotations

import os
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKENIZER = os.environ.get("SKYLEDGER_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")


def _tokenizer(path: str):
    """The tokenizer, read once per worker; this function travels by value, so the cache is kept outside its module."""
    loaded = sys.__dict__.setdefault("_skyledger_tokenizers", {})
    if path not in loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        loaded[path] = Tokenizer.from_file(path)
        loaded[path].encode_special_tokens = True
    return loaded[path]


def n_tokens(text: Column, path: str = TOKENIZER) -> Column:
    """Tokens of the whole text; null and empty texts have none."""

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = _tokenizer(path)
        for texts in batches:
            counts = []
            for at in range(0, len(texts), 256):
                some = [t or "" for t in texts.iloc[at : at + 256]]
                counts += [len(e.ids) for e in tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            yield pd.Series(counts, index=texts.index, dtype="int64")

    count.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(count, "bigint")(text)
