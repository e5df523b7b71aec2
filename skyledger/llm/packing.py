"""Texts packed into containers of a fixed number of tokens, balanced by attention cost.

A container's cost is linear in its tokens plus quadratic in each text's, as
attention stays inside a text. Texts are taken in descending size; each goes
to the container of lowest cost among those with room that it would fill
nearly as well as any. Without the last condition all containers end about
equally full, with gaps that no text fits into. A text larger than a
container fills whole ones; its rest is packed like any other.

Scale: texts are dealt at random into shards of bounded size, each packed on
its own, so that no task sees more than a shard; a shard loses less than its
last containers' room. Sizes are all that is shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.tokens import TOKENIZER, n_tokens
from skyledger.session import cut, spread

_PLACED = "shard bigint, item bigint, doc_id bigint, piece int, first_token bigint, tokens bigint, slot bigint"


def pack_sizes(sizes: np.ndarray, capacity: int, linear: float, quadratic: float, slack: float = 0.25) -> np.ndarray:
    """The container of each item, in descending order; no item may exceed `capacity`.

    Of the containers with room, those come into question that the item would
    leave with at most `slack` of a capacity more room than the tightest; it
    goes to the one of lowest cost. As many containers as the sizes need at
    least are open from the start; a further one is opened where none has room.
    """
    slots = np.full(len(sizes), -1, dtype=np.int64)
    n = used = max(1, math.ceil(sizes.sum() / capacity))
    room, cost = np.full(n + len(sizes), capacity, dtype=np.int64), np.zeros(n + len(sizes))
    for i in np.argsort(-sizes, kind="stable"):
        left = room[:n] - sizes[i]
        fits = left >= 0
        if fits.any():
            k = int(np.where(fits & (left <= left[fits].min() + slack * capacity), cost[:n], np.inf).argmin())
        else:
            # one opened beyond the least number is the last choice, or it would draw the small texts that fill the others
            beyond = room[n:used] - sizes[i]
            fits = np.flatnonzero(beyond >= 0)
            k = n + int(fits[beyond[fits].argmin()]) if len(fits) else used
            used = max(used, k + 1)
        room[k] -= sizes[i]
        cost[k] += linear * sizes[i] + quadratic * float(sizes[i]) ** 2
        slots[i] = k
    return slots


def _pack(capacity: int, linear: float, quadratic: float, slack: float):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["tokens", "doc_id", "item"], ascending=[False, True, True], kind="stable")
        return rows.assign(slot=pack_sizes(rows["tokens"].to_numpy(), capacity, linear, quadratic, slack))[["shard", "item", "doc_id", "piece", "first_token", "tokens", "slot"]]

    return pack


def pack_texts(documents: DataFrame, capacity: int = 2048, linear: float = 1.0, quadratic: float = 1 / 2048, slack: float = 0.25, shard_items: int = 8_000, tokenizer: str = TOKENIZER, size: str | None = None) -> DataFrame:
    """container, item, doc_id, piece, first_token, tokens of every piece; item numbers the row, as a doc_id may be repeated or null.

    documents: doc_id, text. Null and empty texts need no room and are left
    out; a repeated row is an item of its own. A text of more than `capacity`
    tokens is cut into full containers and a rest, others are never cut. An
    empty table gives no container. `size` names a column that has the tokens
    already.
    """
    tokens = n_tokens(F.col("text"), tokenizer) if size is None else F.coalesce(F.col(size).cast("bigint"), F.lit(0))
    # each row gets its number once, after which nothing is worked out again: copies of a text and texts without a doc_id stay apart
    sized = spread(documents.select("doc_id", "text" if size is None else size)).select("doc_id", tokens.alias("size")).withColumn("item", F.monotonically_increasing_id())
    sized = cut(sized).filter(F.col("size") > 0)
    pieces = F.ceil(F.col("size") / capacity).cast("int")
    cutup = sized.select("item", "doc_id", "size", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
    first = F.col("piece").cast("bigint") * capacity
    items = cutup.select("item", "doc_id", "piece", first.alias("first_token"), F.least(F.lit(capacity), F.col("size") - first).alias("tokens"))
    whole = items.filter(F.col("tokens") == capacity).withColumn("container", F.concat_ws("-", F.lit("full"), "item", "piece"))
    rest = items.filter(F.col("tokens") < capacity)
    shards = max(1, math.ceil(sized.count() / shard_items))
    dealt = rest.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards)))
    placed = dealt.groupBy("shard").applyInPandas(_pack(capacity, linear, quadratic, slack), _PLACED)
    placed = placed.withColumn("container", F.concat_ws("-", F.lit("mixed"), "shard", "slot"))
    names = ["container", "item", "doc_id", "piece", "first_token", "tokens"]
    return placed.select(*names).unionByName(whole.select(*names))


def fill(packed: DataFrame, capacity: int = 2048, linear: float = 1.0, quadratic: float = 1 / 2048) -> DataFrame:
    """container, items, tokens, fill, cost of every container."""
    t = F.col("tokens")
    return packed.groupBy("container").agg(F.count("*").alias("items"), F.sum(t).alias("tokens"), (F.sum(t) / capacity).alias("fill"), F.sum(linear * t + quadratic * t * t).alias("cost"))
