"""Schema drift and attribute–value rows on small fixtures with known results."""

import random

import pytest

from skyledger.functions import values
from skyledger.operators import drift, eav

HDUS = "frame_id bigint, rig string, batch_no int, hdu int, cards array<struct<keyword string, value_type string, value_text string, note string>>"


def _hdus(spark):
    rows, f = [], 0
    for batch in (1, 2, 4):
        for k in range(8):
            f += 1
            c = [("EXPTIME" if batch < 4 else "EXPOSURE", "float", f"{10 * (k % 2 + 1)}.0", "[s] exposure time" if batch < 4 else "(s) Exposure Time"), ("GAIN", "float" if batch == 1 else "integer", "100", None)]
            if batch == 1:
                c.append(("PIERSIDE", "string", "East", "side of pier"))
            if batch == 4:
                c.append(("AIRMASS", "float", f"1.{k}", "airmass at start"))
            if k == 0:
                c += [("ODD", "string", "once", None), ("HISTORY", "commentary", "x", None)]
            if batch == 2 and k < 4:
                c[1] = ("GAIN", "undefined", None, None)
            rows += [(f, "r", batch, 0, c)] * (2 if k == 3 else 1)
    return spark.createDataFrame(rows, HDUS)


def test_changes(spark):
    got = {(r["batch"], r["path"], r["change"], r["new_path"]) for r in drift.changes(drift.header_files(_hdus(spark))).collect()}
    assert got == {(2, "PIERSIDE", "removed", ""), (2, "GAIN", "retyped", ""), (4, "EXPTIME", "renamed", "EXPOSURE"), (4, "AIRMASS", "added", "")}


def test_contradicting_comments_are_no_rename(spark):
    rows = [(1, "r", 1, 0, [("A", "integer", "1", "one thing")]), (2, "r", 2, 0, [("B", "integer", "1", "another")])]
    got = {(r["path"], r["change"]) for r in drift.changes(drift.header_files(spark.createDataFrame(rows, HDUS))).collect()}
    assert got == {("A", "removed"), ("B", "added")}


def test_same_values_without_comments_are_a_rename(spark):
    rows = [(1, "r", 1, 0, [("A", "float", "50.0", None)]), (2, "r", 2, 0, [("B", "integer", "50", None)])]
    assert [(r["path"], r["change"], r["new_path"]) for r in drift.changes(drift.header_files(spark.createDataFrame(rows, HDUS))).collect()] == [("A", "renamed", "B")]


def test_json_paths(spark):
    df = spark.createDataFrame([(1, "x", '{"a": {"b": [1], "c": 2}, "d": true, "e": null}'), (1, "y", None), (1, "z", "no json")], "rev int, app string, rule string")
    got = {(r["path"], r["type"]) for r in drift.json_files(df, "apps", "rev", "app", "rule").selectExpr("inline(fields)").collect()}
    assert got == {("a.b", "array"), ("a.c", "number"), ("d", "boolean"), ("e", "undefined")}


def test_unified_table(spark):
    hdus = _hdus(spark)
    wide = drift.unify(hdus, drift.changes(drift.header_files(hdus)).filter("change = 'renamed'"))
    assert wide.count() == 24
    assert wide.filter("exposure IS NULL").count() == 0 and dict(wide.dtypes)["exposure"] == "double"
    assert "exptime" not in wide.columns and wide.filter("gain IS NULL").count() == 4


def test_empty_headers(spark):
    assert drift.changes(drift.header_files(_hdus(spark).limit(0))).count() == 0


NUMBERS = {
    "60.0": 60.0, "60,5": 60.5, "1.2D+02": 120.0, "+1.": 1.0, "'30.0 '": 30.0, "-10.0 C": -10.0, "84.4 %": 84.4, "714.0 mm": 714.0, ".5": 0.5,
    "inf": None, "NaN": None, "1E": None, "0x1G": None, "12..5": None, "1.2.3": None, "20/30": None, "80 or 100": None, "---": None, "": None, None: None, "1E999": None, "see log": None,
}


def test_numbers(spark):
    df = spark.createDataFrame([(k,) for k in NUMBERS], "t string")
    from pyspark.sql import functions as F

    assert {r["t"]: r["v"] for r in df.select("t", values.number(F.col("t")).alias("v")).collect()} == NUMBERS


CARDS = "frame_id bigint, hdu int, record int, keyword string, value_type string, value_text string, note string"
DICT = [("EXPTIME", "exposure_s", "double", 1.0), ("EXP_MS", "exposure_s", "double", 0.001), ("BIN", "binning", "bigint", 1.0), ("FLIP", "flipped", "boolean", None), ("OBJ", "object", "string", 1.0)]


def test_wide_rows_and_problems(spark):
    rows = [
        (1, 0, 1, "EXPTIME", "float", "60.0", None), (1, 0, 2, "EXP_MS", "float", "60000.0", None), (1, 0, 3, "BIN", "string", "'2 '", None), (1, 0, 4, "FLIP", "string", "yes", None), (1, 0, 5, "OBJ", "string", "'Qb 3'", None), (1, 1, 5, "OBJ", "string", "QB 3 ", None),
        (2, 0, 1, "EXPTIME", "float", "60.0", None), (2, 0, 2, "EXP_MS", "float", "61000.0", None), (2, 0, 3, "BIN", "float", "2.5", None), (2, 0, 4, "FLIP", "logical", "T", None), (2, 0, 5, "FLIP", "logical", "F", None),
        (3, 0, 1, "EXPTIME", "unparsed", "auto", None), (3, 0, 2, "EXP_MS", "float", "5000", None), (3, 0, 3, "BIN", "undefined", None, None), (3, 0, 4, "UNKNOWN", "string", "x", None), (3, 0, 5, "OBJ", "string", "x" * 100_000, None),
        (None, 0, 1, "EXPTIME", "float", "1.0", None),
    ]
    cards = spark.createDataFrame(rows + rows[:6], CARDS)
    dictionary = spark.createDataFrame(DICT, "keyword string, field string, field_type string, unit_factor double")
    cells = eav.typed(cards, dictionary)
    assert {tuple(r) for r in eav.problems(cells).collect()} == {(2, "exposure_s", "conflict"), (2, "binning", "unreadable"), (2, "flipped", "conflict")}
    wide = {r["frame_id"]: r for r in eav.widen(cells, eav.fields_of(dictionary)).collect()}
    assert set(wide) == {1, 2, 3} and wide[1]["exposure_s"] == 60.0 and wide[1]["binning"] == 2 and wide[1]["flipped"] is True
    assert wide[2]["exposure_s"] == 60.0 and wide[2]["binning"] is None and wide[3]["exposure_s"] == 5.0 and wide[3]["object"] == "x" * 100_000
    assert eav.problems(eav.typed(cards.limit(0), dictionary)).count() == 0


def test_discovered_types(spark):
    rows = [(i, 0, i, k, "string", v, None) for i, (k, v) in enumerate([("a", "1"), ("a", "2"), ("b", "1.5"), ("b", "2"), ("c", "yes"), ("c", "no"), ("d", "x"), ("e", None)])]
    got = {r["keyword"]: r["field_type"] for r in eav.discover(spark.createDataFrame(rows, CARDS)).collect()}
    assert got == {"a": "bigint", "b": "double", "c": "boolean", "d": "string", "e": "string"}


def test_extra_columns_that_clash(spark):
    from pyspark.sql import functions as F

    hdus = _hdus(spark).withColumns({"source": F.lit(1), "path": F.lit("x"), "fields": F.lit(2)})
    assert drift.changes(drift.header_files(hdus)).count() == 4
    cards = spark.createDataFrame([(1, 0, 1, "EXPTIME", "float", "60.0", None)], CARDS).withColumns({"field": F.lit(1), "num": F.lit("x"), "entity": F.lit(0)})
    dictionary = spark.createDataFrame(DICT, "keyword string, field string, field_type string, unit_factor double").withColumn("value_text", F.lit(1))
    assert eav.widen(eav.typed(cards, dictionary), eav.fields_of(dictionary)).first()["exposure_s"] == 60.0
