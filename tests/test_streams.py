"""Streams over small files: nights at each event's longitude, and a scale that later records don't move."""

import datetime as dt

from pyspark.sql import functions as F

from skyledger.streaming import frames as stream


def test_nights_at_their_longitude(spark, tmp_path):
    at = lambda d, h: dt.datetime(2024, 5, d, h)
    rows = [(at(1, 23), 0.0, "a", 1.0), (at(2, 3), 0.0, "a", 2.0), (at(2, 3), 150.0, "a", 4.0), (at(2, 3), None, "a", 8.0), (at(9, 0), 0.0, "a", 16.0)]
    spark.createDataFrame(rows, "ts timestamp, lon double, kind string, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    source = stream.source(spark, str(tmp_path / "events.parquet"), "ts")
    got = {(str(r["night"]), r["n"], r["value_milli"]) for r in stream.drain(stream.local_nights(source, "ts", "lon", ["kind"], "value")).collect()}
    # 3 in the morning UTC is past noon 150 degrees east
    assert got == {("2024-05-01", 3, 11_000), ("2024-05-02", 1, 4_000)}
    told = stream.night_of(spark.createDataFrame(rows, "ts timestamp, lon double, kind string, value double"), "ts", "lon")
    assert [str(r["night"]) for r in told.collect()][:4] == ["2024-05-01", "2024-05-01", "2024-05-02", "2024-05-01"]


def test_locked_scale_of_any_key_type(spark, tmp_path):
    rows = [("k", i, i % 7, float(100 - i)) for i in range(50)] + [("j", 3, 0, 5.0)]
    spark.createDataFrame(rows, "who string, item bigint, at int, value double").write.parquet(str(tmp_path / "x.parquet"))
    source = spark.readStream.schema(spark.read.parquet(str(tmp_path / "x.parquet")).schema).parquet(f"{tmp_path}/x.parquet*")
    got = stream.drain(stream.locked_scale(source, "who", ["at", "item"], "value"))
    assert {(r["who"], r["scale"]) for r in got.collect()} == {("k", 100.0), ("j", 5.0)} and got.count() == 51
    assert got.filter(F.col("item") == 3).count() == 2
