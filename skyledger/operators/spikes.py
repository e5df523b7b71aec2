"""Faulty measurements: impossible values, stuck stretches and spikes, per source.

Each source's readings, in record order, run through a control chart: an
exponentially weighted mean is carried through a session from both sides, and
a reading far from it is clipped before it updates mean and scale. A reading's
distance from its neighbours' course (the mean of both charts, itself left
out) is held against the source's usual scatter, a robust scale over all its
readings. A counter of equal readings in a row and the physical limits catch
the rest.

Scale: a source's readings are charted in chunks of bounded size, cut by
number of readings, with an overlap in which an exponential weight dies away, so a hot source is many
tasks; its scatter is a mergeable quantile sketch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.operators import order
from skyledger.session import cut, if_small


@dataclass(frozen=True)
class Limits:
    """What a reading can be, and when it is a case.

    low, high: physical limits; low_open: `low` itself is impossible. stuck:
    that many equal readings in a row are a fault. times: that many usual
    scatters from the course are a spike. weight: of a new reading in the
    chart. clip: scales at which the chart clips a reading.
    """

    low: float
    high: float
    low_open: bool = False
    stuck: int = 10
    times: float = 8.0
    weight: float = 0.3
    clip: float = 3.0
    gap_seconds: int = 3600


def _chart(v: np.ndarray, good: np.ndarray, scale: float, weight: float, clip: float) -> np.ndarray:
    """Before each reading, the clipped exponentially weighted mean of the good ones before it; NaN without any."""
    out = np.full(len(v), np.nan)
    first = v[good][:5]
    if not len(first):
        return out
    mean, seen, spread = float(np.median(first)), False, scale
    for i, (x, ok) in enumerate(zip(v.tolist(), good.tolist())):
        if seen:
            out[i] = mean
        if ok:
            step = x - mean
            step = max(-clip * spread, min(clip * spread, step))
            mean += weight * step
            # the chart's scale follows the clipped steps, within twice and half its start
            spread = min(2 * scale, max(scale / 2, spread + 0.05 * (1.25 * abs(step) - spread)))
            seen = True
    return out


def _residuals(by_measure: dict[str, Limits]):
    def chart(rows: pd.DataFrame) -> pd.DataFrame:
        # rows listed again are one reading; a copy with a time beats one without
        rows = rows.sort_values(["item", "v", "at"], kind="stable").drop_duplicates(["item", "v"])
        limits = by_measure[rows["measure"].iloc[0]]
        v = rows["v"].to_numpy(dtype=float)
        possible = rows["possible"].to_numpy(dtype=bool)
        runs = np.concatenate([[0], np.cumsum(v[1:] != v[:-1])])
        stuck = np.bincount(runs)[runs] >= limits.stuck
        at = rows["at"].ffill().to_numpy(dtype=float)
        breaks = np.concatenate([[False], np.nan_to_num(np.diff(at)) > limits.gap_seconds * 1e6])
        good = possible & ~stuck
        step = np.abs(np.diff(v[good]))
        step = step[step > 0]
        scale = float(np.median(step)) if len(step) else 1.0
        off = np.full(len(v), np.nan)
        for part in np.split(np.arange(len(v)), np.flatnonzero(breaks)):
            if not len(part):
                continue
            x, ok = v[part], good[part]
            there = _chart(x, ok, scale, limits.weight, limits.clip)
            back = _chart(x[::-1], ok[::-1], scale, limits.weight, limits.clip)[::-1]
            both = np.stack([there, back])
            known = ~np.isnan(both)
            n = known.sum(axis=0)
            course = np.where(n > 0, np.where(known, both, 0).sum(axis=0) / np.maximum(n, 1), np.nan)
            off[part] = x - course
        own = rows["own"].to_numpy(dtype=bool)
        out = pd.DataFrame({"source": rows["source"], "measure": rows["measure"], "item": rows["item"], "v": v, "possible": possible, "stuck": stuck, "off": off})
        return out[own]

    return chart


def chunked(readings: DataFrame, chunk_rows: int) -> DataFrame:
    """Each reading in its chunk (`own` true) and, near a border, a copy in the chunk beside it.

    A source is cut into chunks of about `chunk_rows` readings, with a
    sixteenth of a chunk or more in common on either side.
    """
    # edges are told by bucket, which is a sixteenth of a chunk at most
    placed = cut(order.blocks(readings, "source", "item", chunk_rows))
    last = placed.groupBy("source").agg(F.max("block").alias("last"))
    edge = chunk_rows // 16
    before = F.when((F.col("start") < edge) & (F.col("block") > 0), F.col("block") - 1)
    after = F.when((F.col("start") + F.col("n") >= chunk_rows - edge) & (F.col("block") < F.col("last")), F.col("block") + 1)
    chunks = placed.join(last, "source").select("source", "bucket", F.col("block").alias("_here"), F.array_compact(F.array("block", before, after)).alias("chunks"))
    cutup = readings.withColumn("bucket", order.bucket("item", chunk_rows)).join(if_small(cut(chunks)), ["source", "bucket"])
    return cutup.withColumn("chunk", F.explode("chunks")).withColumn("own", F.col("chunk") == F.col("_here")).drop("bucket", "chunks", "_here")


def faults(readings: DataFrame, limits: dict[str, Limits], usual: tuple[str, ...] = (), chunk_rows: int = 20_000) -> DataFrame:
    """measure, source, item, v, reason of every faulty reading.

    readings: measure (a key of `limits`; others are left out), source, item
    (bigint, rising in record order), at (micros, may be null: the reading
    belongs to the session of the one before), v (double). Rows that agree
    count once; null and NaN readings and rows without source or item are left
    out; of several values for one item each is judged. A spike is judged
    against the course of its neighbours in the session, for the measures
    named in `usual` against the source's median. reason is impossible, stuck
    or spike, the first that holds. A session with one reading has no
    neighbours, so no spike; a source whose scatter is 0 has a spike wherever
    a reading leaves the course.
    """
    v = F.col("v").cast("double")
    possible = F.lit(None).cast("boolean")
    for name, x in limits.items():
        possible = F.when(F.col("measure") == name, ((v > x.low) if x.low_open else (v >= x.low)) & (v <= x.high)).otherwise(possible)
    slim = readings.filter(F.col("measure").isin(list(limits)) & F.col("source").isNotNull() & F.col("item").isNotNull() & F.col("v").isNotNull() & ~F.isnan(v))
    slim = slim.select(F.concat_ws("|", "measure", "source").alias("source"), "measure", F.col("item").cast("bigint"), F.col("at").cast("bigint"), v.alias("v"), possible.alias("possible"))
    charted = cut(chunked(cut(slim), chunk_rows).groupBy("source", "chunk").applyInPandas(_residuals(limits), "source string, measure string, item bigint, v double, possible boolean, stuck boolean, off double"))
    good = F.col("possible") & ~F.col("stuck")
    if usual:
        level = charted.filter(good & F.col("measure").isin(list(usual))).groupBy("source").agg(F.percentile_approx("v", 0.5, 10_000).alias("usual"))
        charted = charted.join(level, "source", "left").withColumn("off", F.when(F.col("usual").isNotNull(), F.col("v") - F.col("usual")).otherwise(F.col("off"))).drop("usual")
    scatter = charted.filter(good & ~F.isnan("off")).groupBy("source").agg((1.4826 * F.percentile_approx(F.abs("off"), 0.5, 10_000)).alias("scatter"))
    times = F.lit(None).cast("double")
    for name, x in limits.items():
        times = F.when(F.col("measure") == name, F.lit(x.times)).otherwise(times)
    judged = charted.join(scatter, "source", "left")
    spike = F.coalesce(~F.isnan("off") & (F.abs("off") > times * F.col("scatter")), F.lit(False))
    reason = F.when(~F.col("possible"), "impossible").when(F.col("stuck"), "stuck").when(spike, "spike")
    judged = judged.withColumn("reason", reason).filter(F.col("reason").isNotNull())
    return judged.select("measure", F.expr("substring(source, length(measure) + 2)").alias("source"), "item", "v", "reason")
