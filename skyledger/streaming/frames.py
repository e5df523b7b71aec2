"""Streaming forms of the folder questions: windows, trends, listings deduplicated, a locked scale.

Each function takes a streaming DataFrame and gives one. `drain` runs one over
what its source holds now and gives the rows it put out.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skyledger.session import shared_folder


def source(spark: SparkSession, path: str, ts: str) -> DataFrame:
    """A table's folder or file as a stream, `ts` as a timestamp."""
    schema = spark.read.parquet(path).schema
    # as a pattern: a file stream takes a plain path for a folder
    return spark.readStream.schema(schema).parquet(f"{path}*").withColumn(ts, F.col(ts).cast("timestamp"))


def drain(df: DataFrame) -> DataFrame:
    """Everything the stream puts out (append mode) over the data there is now, as a table in the shared folder."""
    at = f"{shared_folder(df.sparkSession)}/stream-{uuid.uuid4().hex}"
    run = df.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{at}/out")


def night_windows(events: DataFrame, ts: str, keys: list[str], value: str, late: str = "1 hour") -> DataFrame:
    """Per night (noon to noon) and keys the number and sum of `value`; a night is put out when `late` has passed since its end."""
    w = F.window(ts, "1 day", startTime="12 hours")
    g = events.withWatermark(ts, late).groupBy(w, *keys).agg(F.count("*").alias("n"), F.sum(F.round(F.col(value) * 1000).cast("bigint")).alias("value_milli"))
    return g.select(F.col("window.start").cast("string").alias("night_start"), *keys, "n", "value_milli")


def trend(events: DataFrame, ts: str, keys: list[str], value: str, length: str = "1 hour", step: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sliding windows: number and greatest value of each window and keys."""
    g = events.withWatermark(ts, late).groupBy(F.window(ts, length, step), *keys).agg(F.count("*").alias("n"), F.max(value).alias("greatest"))
    return g.select(F.col("window.start").cast("string").alias("start"), *keys, "n", "greatest")


def listed_once(listings: DataFrame, ts: str, keys: list[str], late: str = "800 days") -> DataFrame:
    """Each file once, however often it is listed again within `late`."""
    return listings.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def night_of(events: DataFrame, ts: str, lon: str | None = None) -> DataFrame:
    """events with `night`: the date of the local solar day, noon to noon, at longitude `lon` (degrees east, a column); without it at Greenwich."""
    shift = F.lit(0.0) if lon is None else F.coalesce(lon, F.lit(0.0)) / 360.0
    return events.withColumn("night", F.date_from_unix_date(F.floor(F.unix_micros(ts) / 86_400_000_000 + shift - 0.5).cast("int")))


def local_nights(events: DataFrame, ts: str, lon: str, keys: list[str], value: str, late: str = "1 hour") -> DataFrame:
    """As night_windows, of nights at each event's own longitude: the window runs over solar time, which may be half a day ahead or behind."""
    solar = (F.unix_micros(ts) + (F.coalesce(lon, F.lit(0.0)) / 360.0 * 86_400_000_000).cast("bigint"))
    moved = events.withColumn("_solar", F.timestamp_micros(solar)).withWatermark("_solar", f"{late}")
    w = F.window("_solar", "1 day", startTime="12 hours")
    g = moved.groupBy(w, *keys).agg(F.count("*").alias("n"), F.sum(F.round(F.col(value) * 1000).cast("bigint")).alias("value_milli"))
    return g.select(F.to_date("window.start").alias("night"), *keys, "n", "value_milli")


def locked_scale(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Each record's value relative to the first of its key: the first sets the scale, later ones reuse it.

    Records of a key that arrive together are taken in `order`; those that
    arrive later never move the scale. The state of a key is one number; a
    batch goes through in chunks, of which only the least record so far and
    the items are held.
    """
    kinds = dict(events.dtypes)

    def scale(k: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = state.get[0] if state.exists else None
        least, items = None, []
        for rows in chunks:
            items.append(rows[order[-1]])
            if known is None:
                top = rows.sort_values(order, kind="stable").iloc[0]
                at = tuple(top[o] for o in order)
                if least is None or at < least[0]:
                    least = (at, float(top[value]))
        first = known if known is not None else least[1]
        state.update((first,))
        for some in items:
            yield pd.DataFrame({key: k[0], "item": some, "scale": first})

    out = f"{key} {kinds[key]}, item {kinds[order[-1]]}, scale double"
    return events.select(key, *order, value).groupBy(key).applyInPandasWithState(scale, out, "first double", "append", GroupStateTimeout.NoTimeout)
