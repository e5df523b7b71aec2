"""Queries that must see every row: small cases that a cut version gets wrong."""

import os

import pytest

from skyledger.operators import catalogue, classify, drift, headers

DATA = "/root/testdata/sf0.001"
there = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")

FILES = "frame_id bigint, name string, exposure_s double, stack_count bigint, object string"
CARDS = "frame_id bigint, hdu int, record int, keyword string, value_type string, value_text string"
UNITS = "frame_id bigint, hdu int, kind string, bitpix bigint, shape array<bigint>"


def _verdicts(spark):
    files = [(1, "Light_1.fit", 300.0, None, None), (2, "masterbias_1.fit", 0.001, None, None), (3, "r.fit", None, 212, "M 1"), (4, "d.fit", 300.0, None, None), (5, "md.fit", 300.0, None, None), (6, "x.fit", 10.0, None, None), (7, "Dark_1.fit", 60.0, None, None), (8, "y.fit", 10.0, 30, None)]
    cards = [
        (1, 0, 1, "IMAGETYP", "string", "'Light   '"), (1, 0, 2, "BAYERPAT", "string", "RGGB"), (2, 0, 1, "IMAGETYP", "string", "Bias"), (2, 0, 2, "STACKCNT", "integer", "100"),
        (3, 0, 1, "HISTORY", "commentary", "mean stacking of frames"), (3, 0, 2, "HISTORY", "commentary", "asinh stretch, then crop"), (3, 0, 3, "LIVETIME", "float", "4240.0"), (3, 0, 4, "EXPTIME", "float", "20.0"),
        (4, 0, 1, "FRAMETYP", "string", "Dark"), (4, 0, 1, "FRAMETYP", "string", "Dark"), (5, 0, 1, "IMAGETYP", "string", "Master Dark"), (5, 0, 2, "NCOMBINE", "integer", "40"),
    ]
    units = [(1, 0, "primary", 16, [64, 48]), (2, 0, "primary", 16, [64, 48]), (3, 0, "primary", -32, [64, 48, 3]), (4, 0, "primary", 16, [64, 48]), (5, 0, "primary", -32, [64, 48]), (5, 1, "bin_table", 8, [2, 2])]
    found = classify.verdicts(spark.createDataFrame(files, FILES), spark.createDataFrame(cards, CARDS), spark.createDataFrame(units, UNITS))
    return {r["frame_id"]: r for r in found.collect()}


def test_verdicts_of_published_files(spark):
    """Labels and confidences of FIXTURES.md section 1, and files that have no header at all."""
    got = _verdicts(spark)
    assert {k: (r["label"], r["confidence"]) for k, r in got.items()} == {
        1: ("Light sub", 95), 2: ("Master bias", 97), 3: ("Stacked light, processed", 73), 4: ("Dark frame", 90), 5: ("Master dark", 95), 6: ("Unknown", 0), 7: ("Dark frame", 78), 8: ("Stacked light", 73),
    }
    assert [s["name"] for s in got[3]["processing"]] == ["stacking", "crop", "stretch"] and got[3]["processed"] and got[3]["linear"] is False
    assert [(e["weight"], e["supports"]) for e in got[1]["evidence"]] == [(60, "light"), (25, "light"), (25, "single"), (20, "single"), (15, "single")]
    assert [e["weight"] for e in got[3]["evidence"]] == [50, 30, 25, 20, 10]


@there
def test_every_listed_file_has_a_verdict(spark):
    from skyledger.plans import reference

    listed = spark.read.parquet(f"{DATA}/frames.parquet").select("frame_id").distinct()
    got = reference.QUERIES["ref_verdicts"](spark, DATA)
    assert got.count() == listed.count() == got.join(listed, "frame_id").count()


HDUS = "frame_id bigint, rig string, batch_no int, hdu int, cards array<struct<keyword string, value_type string, value_text string, note string>>"


def test_unified_table_keeps_units_rules_and_second_values(spark):
    card = lambda k, v, t="float": (k, t, v, None)
    rows = [
        (1, "a", 1, 0, [card("X", "5.0")]), (1, "a", 1, 1, [card("NSTARS", "7", "integer")]),
        (2, "a", 2, 0, [card("Y", "5.0"), card("X", "9.0")]), (3, "a", 2, 0, [card("X", "4.0")]),
        (4, "b", 1, 0, [card("X", "1.0"), card("Y", "2.0")]), (5, "b", 2, 0, [card("Y", "3.0"), card("Y", "3.5")]),
    ]
    renames = spark.createDataFrame([("a", 2, "X", "Y"), ("apps", 2, "old.k", "new.k")], "source string, batch int, path string, new_path string")
    rules = drift.json_files(spark.createDataFrame([(1, "p", '{"old": {"k": 1}}'), (2, "p", '{"new": {"k": 2}, "l": [1]}')], "rev int, app string, rule string"), "apps", "rev", "app", "rule")
    wide = drift.unify(spark.createDataFrame(rows + rows[:2], HDUS), renames, rules)
    got = {(r["rig"], r["batch_no"], r["file"], r["hdu"]): r for r in wide.collect()}
    assert len(got) == wide.count() == 8
    assert got["a", 1, "1", 1]["nstars"] == 7 and got["apps", 2, "p", None]["l"] == "[1]"
    assert [got["apps", b, "p", None]["new_k"] for b in (1, 2)] == [1.0, 2.0]
    assert [got["a", b, f, 0]["x"] for b, f in ((1, "1"), (2, "2"), (2, "3"))] == [5.0, 5.0, 4.0] and got["a", 2, "2", 0]["x__more"] == ["X=float:9.0"]
    assert (got["b", 1, "4", 0]["x"], got["b", 1, "4", 0]["y"]) == (1.0, 2.0) and got["b", 2, "5", 0]["y__more"] == ["Y=float:3.5"]


def test_canonical_names_follow_batches():
    back = {(b, p): n for b, p, n in drift.canonical_names([(2, "A", "B"), (5, "B", "A")], [1, 3, 6])}
    assert set(back.values()) == {"A"}
    apart = {(b, p): n for b, p, n in drift.canonical_names([(2, "M", "N"), (4, "K", "M")], [1, 5])}
    assert apart[1, "M"] == apart[5, "N"] and apart[5, "M"] == apart[1, "K"] and apart[5, "M"] != apart[5, "N"]


TARGETS = "target_id int, designation string, common_name string, aliases array<string>, ra_deg double, dec_deg double, size_arcmin double"


def test_lookup_by_alias_and_by_position(spark):
    targets = spark.createDataFrame([(1, "QB 3", None, ["Wn 0035", "x"], 359.9, 10.0, None), (2, "QB 4", "Wheel", None, 0.2, 10.3, 60.0), (3, "QB 5", None, [None], 200.0, -89.9, 5.0)], TARGETS)
    names = spark.createDataFrame([("wn_35",), ("wheel",), ("qb3",), ("other",)], "object string")
    found = catalogue.lookup(names, "object", targets, "target_id", ["designation", "common_name", "aliases"]).collect()
    assert {r["object"]: r["target_id"] for r in found} == {"wn_35": 1, "wheel": 2, "qb3": 1, "other": None}
    cards = [
        (1, 0, 1, "RA", "359.95"), (1, 0, 2, "DEC", "10.0"), (2, 0, 1, "OBJCTRA", "'00 00 00'"), (2, 0, 2, "OBJCTDEC", "'+10 15 00'"), (3, 0, 1, "RA", "20.0"), (3, 0, 2, "DEC", "-89:54:00"),
        (4, 0, 1, "RA", "100.0"), (4, 0, 2, "DEC", "10.0"), (5, 0, 1, "RA", "0.0"), (6, 0, 1, "RA", "bad"), (6, 0, 2, "OBJCTRA", "12:00:00"), (6, 0, 3, "DEC", "-0 30 00"),
    ]
    at = catalogue.header_positions(spark.createDataFrame(cards, "frame_id bigint, hdu int, record int, keyword string, value_text string"))
    assert {r["frame_id"]: (r["ra_deg"], r["dec_deg"]) for r in at.collect()} == {1: (359.95, 10.0), 2: (0.0, 10.25), 3: (20.0, -89.9), 4: (100.0, 10.0), 6: (180.0, -0.5)}
    near = {r["frame_id"]: r["target_id"] for r in catalogue.nearest(at, "frame_id", targets, "target_id").collect()}
    assert near == {1: 2, 2: 2, 3: 3}


def test_every_unit_is_compared_with_the_one_before(spark):
    card = lambda k, v: (k, "string", v, None)
    rows = [(f, "r", 1, 0, [card("K", v)] + ([card("OPT", "x")] if f != 3 else [])) for f, v in ((1, "a"), (2, "b"), (3, "b"), (5, "b"))] + [(f, "r", 1, 1, [card("N", str(f % 2))]) for f in (2, 5)] + [(4, "s", 1, 0, [card("K", "z")])]
    hdus = spark.createDataFrame(rows + rows[:3], HDUS)
    got = {(r["b"]["hdu"], r["a"]["frame_id"], r["b"]["frame_id"], r["keyword"], r["status"]) for r in headers.differences(headers.unit_cards(hdus), headers.successive_units(hdus)).collect()}
    assert got == {(0, 1, 2, "K", "changed"), (0, 2, 3, "OPT", "only_a"), (0, 3, 5, "OPT", "only_b"), (1, 2, 5, "N", "changed")}


def test_all_kinds_of_cards_come_back(spark):
    long = "it's / a long & winding " * 9 + "end"
    rows = [
        (1, "OBJECT", "string", long, "note", False), (2, "GUIDE RMS TOTAL", "float", "0.5", "[arcsec] error", True), (3, "GUIDE RMS TOTAL", "string", long, None, True), (4, "HISTORY", "commentary", "stacked = twice", None, False),
        (5, "AMBHUM", "unparsed", "89,6", "[%] humidity", False), (6, "NIL", "undefined", None, None, False), (7, "A", "string", "'" * 80, None, False), (8, "B", "integer", "1", "n" * 70, False), (9, "OBJECT", "string", "x&", None, False),
    ]
    back = headers.round_trip(spark.createDataFrame(rows, "i int, keyword string, value_type string, value_text string, note string, hierarch boolean")).collect()
    assert {r["i"] for r in back if not r["agree"]} == {8}
    assert all(len(x) == 80 for r in back for x in r["records"]) and {r["i"] for r in back if len(r["records"]) > 1} == {1, 3, 7}
