"""Typed branches, alternatives that come and go, whole numbers to the last digit, attributes no dictionary knows."""

from skyledger.functions import values
from skyledger.operators import drift, eav

HDUS = "frame_id bigint, rig string, batch_no int, hdu int, cards array<struct<keyword string, value_type string, value_text string, note string>>"


def _card(k, v, t="float"):
    return (k, t, v, None)


def test_conflicting_types_become_typed_branches(spark):
    rows = [
        (1, "a", 1, 0, [_card("GAIN", "1.5"), _card("A-1", "1", "integer"), _card("A_1", "2", "integer")]), (2, "a", 1, 0, [_card("GAIN", "2.5")]), (3, "a", 2, 0, [_card("GAIN", "high", "string")]),
        (4, "a", 2, 0, [_card("GAIN", "9007199254740993", "integer"), _card("N", "9007199254740993", "integer")]), (5, "a", 2, 0, []), (5, "a", 2, 0, []),
    ]
    hdus = spark.createDataFrame(rows, HDUS)
    none = spark.createDataFrame([], "source string, batch int, path string, new_path string")
    got = {r["frame_id"]: r for r in drift.unify(hdus, none).collect()}
    assert len(got) == 5 and got[1]["gain"] == 1.5 and got[3]["gain"] is None and got[3]["gain__string"] == "high" and got[3]["gain__other"] == "string:high"
    assert got[4]["gain__bigint"] == 9007199254740993 and got[4]["n"] == 9007199254740993 and got[1]["gain__bigint"] is None
    # keywords whose names clash are two columns
    assert {got[1]["a_1"], got[1]["a_1_"]} == {1, 2}
    files = drift.header_files(hdus)
    assert {tuple(r)[1:] for r in drift.appearing(files).collect()} == {
        (2, "GAIN", "string", "appeared", 1), (2, "GAIN", "integer", "appeared", 1), (2, "GAIN", "float", "gone", 2), (2, "N", "integer", "appeared", 1), (2, "A-1", "integer", "gone", 1), (2, "A_1", "integer", "gone", 1),
    }
    assert drift.appearing(files.limit(0)).count() == 0


def test_files_listed_twice_count_once(spark):
    files = drift.header_files(spark.createDataFrame([(1, "a", 1, 0, [_card("X", "1")])] * 3 + [(2, "a", 1, 0, [_card("X", None, "undefined")])], HDUS))
    assert {tuple(r) for r in drift.alternatives(files).collect()} == {("a", 1, None, "*", 2), ("a", 1, "X", "*", 2), ("a", 1, "X", "float", 1)}


def test_whole_numbers(spark):
    from pyspark.sql import functions as F

    cases = {"9007199254740993": 9007199254740993, "-123456789012345678": -123456789012345678, "2.0": 2, "1E3": 1000, "2.5": None, "99999999999999999999": None, "2,0": 2, "9007199254740993.5": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["v"] for r in df.select("t", values.whole(F.col("t")).alias("v")).collect()} == cases


CARDS = "frame_id bigint, hdu int, record int, keyword string, value_type string, value_text string, note string"


def test_attributes_that_no_dictionary_knows(spark):
    rows = [(i, 0, 1, "EXPTIME", "float", "60.0", None) for i in range(4)] + [(i, 0, 2, "N-SUB", "integer", str(9007199254740993 + i), None) for i in range(3)] + [(0, 0, 3, "RARE", "string", "x", None), (1, 0, 4, "HISTORY", "commentary", "y", None)]
    cards = spark.createDataFrame(rows, CARDS)
    dictionary = spark.createDataFrame([("EXPTIME", "exposure_s", "double", 1.0), ("ABSENT", "absent", "boolean", None)], "keyword string, field string, field_type string, unit_factor double")
    found = eav.attributes(cards, dictionary, most_new=1)
    assert {(r["keyword"], r["field"], r["field_type"], r["known"]) for r in found.collect()} == {("EXPTIME", "exposure_s", "double", True), ("ABSENT", "absent", "boolean", True), ("N-SUB", "n_sub", "bigint", False), ("RARE", "others", "string", False)}
    wide = {r["frame_id"]: r for r in eav.widen(eav.typed(cards, found), eav.fields_of(found)).collect()}
    assert wide[1]["n_sub"] == 9007199254740994 and wide[0]["others"] == {"RARE": "x"} and wide[3]["n_sub"] is None and wide[3]["absent"] is None
    assert {(r["keyword"], r["field_type"]) for r in eav.attributes(cards).collect()} == {("EXPTIME", "bigint"), ("N-SUB", "bigint"), ("RARE", "string")}
    assert eav.problems(eav.typed(cards, found)).count() == 0
