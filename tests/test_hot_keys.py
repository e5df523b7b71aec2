"""One source with nearly all rows, ids with far outliers, and what certain records tell uncertain ones."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.functions import timeparse
from skyledger.operators import order, spikes, timestamps

SCHEMA = "rig string, frame_id bigint, part string, date_obs string"
RIGS = "rig string, zone_name string, clock string, date_order string"


def _read(spark, texts, **kw):
    rows = [("r", 10 * k, "p", t) for k, t in enumerate(texts)]
    got = timestamps.read_times(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("other", "UTC", "utc", "dmy")], RIGS), **kw)
    return [r["t"] for r in got.select("frame_id", timeparse.utc_text(F.col("micros")).alias("t")).orderBy("frame_id").collect()]


@pytest.mark.parametrize("block_rows", [1, 2, 500])
def test_certain_records_tell_the_order(spark, block_rows):
    texts = ["25/12/2023 20:00", "26/12/2023 20:00", "01/02/2024 20:00", "13/02/2024 20:00", "14/02/2024 20:00"]
    assert [t[:10] for t in _read(spark, texts, block_rows=block_rows)] == ["2023-12-25", "2023-12-26", "2024-02-01", "2024-02-13", "2024-02-14"]


def test_what_was_told_last_outlasts_records_that_tell_nothing(spark):
    texts = ["25/12/2023 20:00", "2023-12-26T20:00:00", "2024-01-02T20:00:00", "05/05/2024 20:00", "07/06/2024 20:00"]
    assert _read(spark, texts, block_rows=2)[-1][:10] == "2024-06-07"
    assert _read(spark, [t.replace("25/12", "12/25") for t in texts], block_rows=2)[-1][:10] == "2024-07-06"


def _cost(chain, path):
    told, total, before = ["", ""], 0.0, None
    for (item, readings), k in zip(chain, path):
        micros, kinds = readings[k]
        for p, kind in enumerate(timestamps._parts(kinds)):
            if kind:
                total += timestamps.SWITCH * (told[p] not in ("", kind))
                told[p] = kind
        if before is not None:
            total += timestamps._apart(before[0], np.array([before[1]]), item, np.array([micros]))[0, 0]
        before = (item, micros)
    return total


@pytest.mark.parametrize("seed", range(3))
def test_blocks_and_groups_of_blocks_give_the_cheapest_path(spark, seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(11):
        day, month = rng.randint(1, 28), rng.randint(1, 12)
        texts.append(rng.choice([f"{day:02d}/{month:02d}/2022 {rng.randint(0, 23):02d}:00:00", f"{month:02d}/{day:02d}/2022 05:00:00", f"2022-{month:02d}-{day:02d}T01:00:00Z"]))
    named = spark.createDataFrame([("r", 10 * k, "p", t) for k, t in enumerate(texts)], "seq string, item bigint, part string, date_obs string")
    read = timeparse.with_time_readings(named, "date_obs").drop("date_obs")
    chain = [(r["item"], [(x["micros"], x["kind"]) for x in r["readings"]]) for r in read.orderBy("item").collect()]
    best = min(_cost(chain, p) for p in itertools.product(*[range(len(c[1])) for c in chain]))
    for fan in (2, 256):
        got = {r["item"]: r["micros"] for r in timestamps.choose_readings(read, block_rows=2, fan=fan).collect()}
        path = [[m for m, _ in c[1]].index(got[c[0]]) for c in chain]
        assert _cost(chain, path) == pytest.approx(best)


def test_blocks_of_skewed_ids(spark):
    """Half of all ids close together, others far apart, one of 10^12."""
    ids = list(range(0, 3000)) + [10**6 + 1000 * k for k in range(3000)] + [10**12]
    df = spark.createDataFrame([("hot", i) for i in ids] + [("cold", 7)], "k string, item bigint").repartition(5)
    placed = df.withColumn("bucket", order.bucket("item", 160)).join(order.blocks(df, "k", "item", 160), ["k", "bucket"])
    sizes = {(r["k"], r["block"]): (r["n_rows"], r["lo"], r["hi"]) for r in placed.groupBy("k", "block").agg(F.count("*").alias("n_rows"), F.min("item").alias("lo"), F.max("item").alias("hi")).collect()}
    hot = [sizes["hot", b] for b in range(len(sizes) - 1)]
    assert sum(n for n, _, _ in hot) == len(ids) and max(n for n, _, _ in hot) < 2 * 160 and all(a[2] < b[1] for a, b in zip(hot, hot[1:]))
    odd = spark.createDataFrame([(None, 3), (None, 1), ("a", 2)], "k string, item bigint")
    assert {tuple(r) for r in order.numbered(odd, ["k"], ["item"], "at").collect()} == {(None, 1, 1), (None, 3, 2), ("a", 2, 1)}
    numbers = {r["item"]: r["at"] for r in order.numbered(df, ["k"], ["item"], "at").filter("k = 'hot'").collect()}
    assert numbers == {i: k + 1 for k, i in enumerate(sorted(ids))}


def test_spikes_with_one_far_id(spark):
    rng = np.random.default_rng(2)
    rows = [("m", "hot", i, i * 60_000_000, float(rng.normal(0, 0.3)) + (9 if i % 500 == 250 else 0)) for i in range(6000)] + [("m", "hot", 10**12, 10**15, 0.1)]
    df = spark.createDataFrame(rows, "measure string, source string, item bigint, at bigint, v double")
    for chunk in (800, 10**6):
        got = {r["item"] for r in spikes.faults(df, {"m": spikes.Limits(-100.0, 100.0)}, chunk_rows=chunk).collect()}
        assert got == {i for i in range(6000) if i % 500 == 250}
    sizes = spikes.chunked(df, 800).groupBy("chunk").count()
    assert sizes.agg(F.max("count")).first()[0] < 2 * 800 and sizes.filter("chunk < 0").count() == 0
