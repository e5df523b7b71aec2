"""Sessions of activity: runs of a key's events without a gap longer than allowed.

The events are range-partitioned and sorted by key and time (a hot key is
spread over many partitions), each partition is read once in order, and
sessions are put out as they end; the reader holds one open session and one
Arrow batch. A session cut by a partition border comes out as pieces, at most
two per partition; these few are put together at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyledger.session import cut

_FIELDS = "key string, start bigint, end bigint, first_id bigint, last_id bigint, n bigint, edge boolean"
_SCHEMA = pa.schema([("key", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n", pa.int64()), ("edge", pa.bool_())])


def _scan(gap_micros: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the open session: key, start, end, first id, last id, events, is it the partition's first
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").to_pandas().to_numpy()
            at = batch.column("at").to_numpy()
            ids = batch.column("id").to_numpy()
            opens = np.ones(len(at), dtype=bool)
            opens[1:] = (keys[1:] != keys[:-1]) | (np.diff(at) > gap_micros)
            if held is not None:
                opens[0] = keys[0] != held[0] or at[0] - held[2] > gap_micros
            starts = np.flatnonzero(opens)
            ends = np.append(starts[1:], len(at)) - 1
            if held is not None and (not len(starts) or starts[0] > 0):
                k = (starts[0] if len(starts) else len(at)) - 1
                held = (held[0], held[1], int(at[k]), held[3], int(ids[k]), held[5] + k + 1, held[6])
            done = []
            for a, b in zip(starts, ends):
                if held is not None:
                    done.append(held)
                held = (keys[a], int(at[a]), int(at[b]), int(ids[a]), int(ids[b]), int(b - a + 1), held is None)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), type=f.type) for x, f in zip(zip(*done), _SCHEMA)], schema=_SCHEMA)
        if held is not None:
            last = (*held[:6], True)
            yield pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip(last, _SCHEMA)], schema=_SCHEMA)

    return scan


def sessionise(df: DataFrame, key: str, at: str, item: str, gap_seconds: int = 3600) -> DataFrame:
    """key, start, end (micros), first_id, last_id, n of every session.

    A session is a longest run of a key's events, in order of time and then of
    `item` (bigint), in which none starts more than `gap_seconds` after the one
    before. Events that agree in all three count once; those with a null key or
    time are left out. An empty table gives no session.
    """
    slim = df.select(F.col(key).cast("string").alias("key"), F.col(at).cast("bigint").alias("at"), F.col(item).cast("bigint").alias("id")).filter(F.col("key").isNotNull() & F.col("at").isNotNull())
    ordered = slim.distinct().repartitionByRange("key", "at", "id").sortWithinPartitions("key", "at", "id")
    # read twice below, which must see the same pieces
    pieces = cut(ordered.mapInArrow(_scan(gap_seconds * 1_000_000), _FIELDS))
    w = Window.partitionBy("key").orderBy("start", "end", "first_id")
    apart = F.coalesce(F.col("start") - F.lag("end").over(w) > gap_seconds * 1_000_000, F.lit(True))
    edges = pieces.filter("edge").withColumn("part", F.sum(apart.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = edges.groupBy("key", "part").agg(
        F.min("start").alias("start"), F.max("end").alias("end"),
        F.min_by("first_id", F.struct("start", "first_id")).alias("first_id"), F.max_by("last_id", F.struct("end", "last_id")).alias("last_id"), F.sum("n").alias("n"),
    )
    names = ["key", "start", "end", "first_id", "last_id", "n"]
    return pieces.filter(~F.col("edge")).select(*names).unionByName(whole.select(*names)).withColumnRenamed("key", key)
