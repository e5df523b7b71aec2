"""Sessions and faults against plain Python over random sequences."""

import random

import numpy as np
import pandas as pd

from skyledger.operators import sessions, spikes


def _plain_sessions(rows, gap):
    out = []
    for key in sorted({r[0] for r in rows}):
        mine = sorted({(t, i) for k, t, i in rows if k == key})
        for t, i in mine:
            if out and out[-1][0] == key and t - out[-1][2] <= gap:
                out[-1] = (key, out[-1][1], t, out[-1][3], i, out[-1][5] + 1)
            else:
                out.append((key, t, t, i, i, 1))
    return sorted(out)


def test_sessions_match_a_plain_scan(spark):
    rng = random.Random(1)
    rows = []
    for key, n in (("hot", 4000), ("a", 50), ("b", 1)):
        t = 0
        for i in range(n):
            t += rng.choice([0, 60, 3600, 3601, 9000]) * 1_000_000
            rows += [(key, t, i)] * rng.choice([1, 1, 1, 2])
    df = spark.createDataFrame(rows, "rig string, micros bigint, frame_id bigint").repartition(7)
    got = sorted((r["rig"], r["start"], r["end"], r["first_id"], r["last_id"], r["n"]) for r in sessions.sessionise(df, "rig", "micros", "frame_id").collect())
    assert got == _plain_sessions(rows, 3600 * 1_000_000)


def test_sessions_of_nulls_and_nothing(spark):
    df = spark.createDataFrame([(None, 1, 1), ("a", None, 2), ("a", 5, 3)], "rig string, micros bigint, frame_id bigint")
    assert [r["n"] for r in sessions.sessionise(df, "rig", "micros", "frame_id").collect()] == [1]
    assert sessions.sessionise(df.limit(0), "rig", "micros", "frame_id").count() == 0


LIMITS = {"m": spikes.Limits(-100.0, 100.0)}
SCHEMA = "measure string, source string, item bigint, at bigint, v double"


def _planted(seed):
    rng = np.random.default_rng(seed)
    rows, truth = [], set()
    for source, n in (("hot", 5000), ("cold", 400)):
        level = 0.0
        for i in range(n):
            if i % 100 == 0:
                level = rng.uniform(-20, 20)  # another session, another level
            v = level + 0.01 * (i % 100) + rng.normal(0, 0.3)
            if i % 97 == 50:
                v, _ = v + rng.choice([-1, 1]) * 9, truth.add((source, i, "spike"))
            elif i % 211 == 60:
                v, _ = 3276.7, truth.add((source, i, "impossible"))
            rows.append(("m", source, i, (i + i // 100 * 200) * 60_000_000, float(v)))
        for i in range(220, 235):
            rows[-n + i] = ("m", source, i, rows[-n + i][3], 1.25)
            truth -= {(source, i, "spike"), (source, i, "impossible")}
            truth.add((source, i, "stuck"))
    return rows, truth


def test_planted_faults_in_chunks(spark):
    rows, truth = _planted(3)
    df = spark.createDataFrame(rows + rows[:50], SCHEMA)
    for chunk in (100_000, 500):
        got = {(r["source"], r["item"], r["reason"]) for r in spikes.faults(df, LIMITS, chunk_rows=chunk).collect()}
        assert got == truth, (chunk, got ^ truth)


def test_usual_level_and_odd_rows(spark):
    rows = [("m", "s", i, None, 5.0 + 0.1 * (i % 7)) for i in range(60)] + [("m", "s", 60, None, 9.0), ("m", "s", 61, None, None), ("m", "s", 62, None, float("nan")), ("m", None, 63, None, 1.0), ("other", "s", 1, None, 1e9)]
    got = {(r["item"], r["reason"]) for r in spikes.faults(spark.createDataFrame(rows, SCHEMA), LIMITS, usual=("m",)).collect()}
    assert got == {(60, "spike")}
    assert spikes.faults(spark.createDataFrame(rows, SCHEMA).limit(0), LIMITS).count() == 0


def test_extra_columns_that_clash(spark):
    """Columns named like those the operators make inside."""
    rows = [("m", "s", i, i * 60_000_000, 5.0 + i % 3, 1, True, "x", 2) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA + ", chunk int, own boolean, reason string, scatter int")
    assert spikes.faults(df, LIMITS).count() == 0
    events = df.selectExpr("source AS rig", "at AS micros", "item AS frame_id", "chunk AS key", "scatter AS start", "own AS edge")
    assert sessions.sessionise(events, "rig", "micros", "frame_id").count() == 1
