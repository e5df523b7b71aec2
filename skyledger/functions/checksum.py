"""Checksums of header units: ones'-complement sums of big-endian words, and their text form."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FULL = 0xFFFFFFFF


def sum32(data: bytes, start: int = 0) -> int:
    """The sum of a block's 32-bit words with the carry added at the other end; a rest of a word is filled with zeros."""
    words = np.frombuffer(data + b"\0" * (-len(data) % 4), dtype=">u4")
    total = int(words.sum(dtype=np.uint64)) + start
    # folding the carry is the remainder by 2^32 - 1, of which a multiple stays all ones
    return total % FULL or (FULL if total else 0)


def encoded(value: int) -> str:
    """The 16 characters of a value: each of its bytes is shared out over four, none of them a sign between digits and letters."""
    columns = []
    for byte in value.to_bytes(4, "big"):
        parts = [byte // 4 + byte % 4 + 48] + [byte // 4 + 48] * 3
        # the first and second, and the third and fourth, are moved apart until all are digits or letters
        while not all(chr(p).isalnum() for p in parts):
            for i in (0, 2):
                if not (chr(parts[i]).isalnum() and chr(parts[i + 1]).isalnum()):
                    parts[i], parts[i + 1] = parts[i] + 1, parts[i + 1] - 1
        columns.append(parts)
    text = "".join(chr(columns[i % 4][i // 4]) for i in range(16))
    return text[-1] + text[:-1]


def sealed(header: bytes, data_sum: int = 0) -> str | None:
    """The CHECKSUM text that makes header and data sum to all ones; header: whole blocks with a CHECKSUM card; null without one."""
    card = next((k for k in range(0, len(header), 80) if header[k : k + 11] == b"CHECKSUM= '"), None)
    if card is None:
        return None
    blank = header[: card + 11] + b"0" * 16 + header[card + 27 :]
    total = sum32(blank, data_sum)
    return encoded(FULL - total)


def header_sum(header: Column) -> Column:
    """sum32 of a header's text; null gives null."""

    def work(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else sum32(t.encode("latin-1", "replace"))).astype("Int64")

    return F.pandas_udf(work, "bigint")(header)


def header_seal(header: Column, data_sum: Column) -> Column:
    """The CHECKSUM text of each header; see `sealed`."""

    def work(texts: pd.Series, sums: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else sealed(t.encode("latin-1", "replace"), 0 if pd.isna(s) else int(s)) for t, s in zip(texts, sums)], dtype=object)

    return F.pandas_udf(work, "string")(header, data_sum)
