"""Timestamps: each written form against a plain Python reading, and the Viterbi pass against trying every path."""

import datetime as dt
import itertools
import random
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyledger.functions import timeparse
from skyledger.operators import timestamps

SCHEMA = "rig string, frame_id bigint, part string, date_obs string"
RIGS = "rig string, zone_name string, clock string, date_order string"

CASES = [
    ("2022-01-24T04:12:53.525", "UTC", "utc", "dmy", "2022-01-24T04:12:53Z"),
    ("2022-01-24T04:12:53,525", "UTC", "utc", "dmy", "2022-01-24T04:12:53Z"),
    (" '2022-01-24 04:12:53 UTC' ", "Asia/Kolkata", "local", "dmy", "2022-01-24T04:12:53Z"),
    ("2022-07-24 04:12:53", "Europe/Berlin", "local", "dmy", "2022-07-24T02:12:53Z"),
    ("2022-07-24 04:12:53 CEST", "Europe/Berlin", "utc", "dmy", "2022-07-24T02:12:53Z"),
    ("2022-07-24 04:12:53 IST", "Asia/Kolkata", "utc", "dmy", "2022-07-23T22:42:53Z"),
    ("2022-07-24 04:12:53 IST", "Europe/Dublin", "utc", "dmy", "2022-07-24T03:12:53Z"),
    ("02/01/2022 09:08:07 PM", "UTC", "utc", "mdy", "2022-02-01T21:08:07Z"),
    ("02/01/2022 12:08:07 AM", "UTC", "utc", "dmy", "2022-01-02T00:08:07Z"),
    ("31.12.2022 21:53:22", "UTC", "utc", "dmy", "2022-12-31T21:53:22Z"),
    ("Fri, 01 Dec 2023 21:09:29 +0100", "UTC", "utc", "dmy", "2023-12-01T20:09:29Z"),
    ("Apr 2, 2023 23:47:24", "UTC", "utc", "dmy", "2023-04-02T23:47:24Z"),
    ("20220108T060756Z", "UTC", "utc", "dmy", "2022-01-08T06:07:56Z"),
    ("2022-01-10 19:49:34 +1030", "UTC", "utc", "dmy", "2022-01-10T09:19:34Z"),
    ("1641618049", "UTC", "utc", "dmy", "2022-01-08T05:00:49Z"),
    ("1641615839431", "UTC", "utc", "dmy", "2022-01-08T04:23:59Z"),
    ("59587.21121167", "UTC", "utc", "dmy", "2022-01-08T05:04:08Z"),
    ("2459586.902541", "UTC", "utc", "dmy", "2022-01-07T09:39:39Z"),
    ("2024-02-30T21:15:10", "UTC", "utc", "dmy", None),
    ("0000-00-00T00:00:00", "UTC", "utc", "dmy", None),
    ("2023-06-11T", "UTC", "utc", "dmy", None),
    ("T22:14:03", "UTC", "utc", "dmy", None),
    ("2022-01-01T24:00:00", "UTC", "utc", "dmy", None),
    ("", "UTC", "utc", "dmy", None),
    (None, "UTC", "utc", "dmy", None),
    ("x" * 100_000, "UTC", "utc", "dmy", None),
]


def test_every_form(spark):
    rows = [(f"r{i}", i, "frames.date_obs", c[0]) for i, c in enumerate(CASES)]
    rigs = [(f"r{i}", c[1], c[2], c[3]) for i, c in enumerate(CASES)]
    got = timestamps.read_times(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(rigs, RIGS)).select("frame_id", timeparse.utc_text(F.col("micros")).alias("t"))
    found = {r["frame_id"]: r["t"] for r in got.collect()}
    for i, c in enumerate(CASES):
        assert found.get(i) == c[4], c


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/Denver", "Australia/Adelaide"])
def test_wall_times_that_occur_twice(spark, zone):
    """A night across the change of clocks, written in wall time: order settles every time."""
    z, step = ZoneInfo(zone), dt.timedelta(minutes=7)
    start = {"Europe/Berlin": dt.datetime(2022, 10, 29, 22), "America/Denver": dt.datetime(2022, 11, 6, 5), "Australia/Adelaide": dt.datetime(2022, 4, 2, 13)}[zone]
    true = [start.replace(tzinfo=dt.timezone.utc) + k * step for k in range(60)]
    rows = [("r", k, "frames.date_obs", t.astimezone(z).strftime("%Y-%m-%d %H:%M:%S")) for k, t in enumerate(true)]
    got = timestamps.read_times(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("r", zone, "local", "dmy")], RIGS), block_rows=9)
    found = {r["frame_id"]: r["micros"] for r in got.collect()}
    assert found == {k: int(t.timestamp()) * 1_000_000 for k, t in enumerate(true)}


def _brute(chain):
    best = None
    for path in itertools.product(*[range(len(c[1])) for c in chain]):
        cost = sum(timestamps._step(*a, *b)[i, j] for a, b, i, j in zip(chain, chain[1:], path, path[1:]))
        if best is None or cost < best[0] - 1e-9:
            best = (cost, path)
    return best


def test_blocks_give_the_cheapest_path(spark):
    """Undeclared order of day and month: choices all along, cut into tiny blocks, against every path."""
    rng = random.Random(5)
    for trial in range(4):
        rows = []
        for k in range(9):
            day, month = rng.randint(1, 12), rng.randint(1, 12)
            rows.append(("r", 10 * k, "p", f"{day:02d}/{month:02d}/2022 {rng.randint(0, 23):02d}:00:00"))
        named = spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({"rig": "seq", "frame_id": "item"})
        read = timeparse.with_time_readings(named, "date_obs").drop("date_obs")
        readings = {r["item"]: r["readings"] for r in read.collect()}
        chain = [(i, np.array([x["micros"] for x in readings[i]], dtype=np.int64), [x["kind"] for x in readings[i]]) for i in sorted(readings)]
        got = {r["item"]: r["micros"] for r in timestamps.choose_readings(read, block_rows=2).collect()}
        path = [int(np.flatnonzero(c[1] == got[c[0]])[0]) for c in chain]
        cost = sum(timestamps._step(*a, *b)[i, j] for a, b, i, j in zip(chain, chain[1:], path, path[1:]))
        assert cost == pytest.approx(_brute(chain)[0])


def test_repeats_nulls_and_empty(spark):
    rigs = spark.createDataFrame([("r", "UTC", "utc", "dmy")], RIGS)
    rows = spark.createDataFrame([("r", 1, "a", "2022-01-01 00:00:00"), ("r", 1, "a", "2022-01-01 00:00:00"), ("r", 2, "a", None), (None, 3, "a", "2022-01-01 00:00:00"), ("unknown", 4, "a", "2022-01-01 00:00:00")], SCHEMA)
    assert timestamps.read_times(rows, rigs).distinct().count() == 2
    assert timestamps.read_times(rows, rigs, unread=True).filter("micros IS NULL").count() == 1
    assert timestamps.read_times(rows.limit(0), rigs).count() == 0


def test_dates(spark):
    cases = {"2022/01/07": "2022-01-07", "20220107": "2022-01-07", "10 Dec 22": "2022-12-10", "2022-1-7": "2022-01-07", "Apr 2 2023": "2023-04-02", "07.01.2022": "2022-01-07", "2022-01-07T00:00:00": "2022-01-07", "tonight": None, "-": None, "2022-02-30 ": None}
    df = spark.createDataFrame([(k, "dmy") for k in cases], "t string, o string")
    got = timeparse.with_date_readings(df, "t", "o").select("t", timeparse.date_text(F.try_element_at("readings", F.lit(1))["micros"]).alias("d"))
    assert {r["t"]: r["d"] for r in got.collect()} == cases
