"""Canonical facts, calibration, edits, comparisons, moves and text forms on small cases with known results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.functions import astro, filename, text
from skyledger.operators import calibration, canonical, compare, edits, folder, organise
from skyledger.operators.canonical import Rule
from skyledger.sources import fits

CARDS = "frame_id bigint, hdu int, record int, keyword string, value_type string, value_text string, note string, hierarch boolean"


def _cards(spark, files):
    rows = [(f, h, i, k, t, v, None, False) for (f, h), cards in files.items() for i, (k, t, v) in enumerate(cards)]
    return spark.createDataFrame(rows, CARDS)


def _facts(spark, name, cards, rules=(), planes=1, history=()):
    told = cards + [("HISTORY", "commentary", line) for line in history]
    heads = canonical.headers_of(_cards(spark, {(1, 0): told}))
    files = spark.createDataFrame([(1, name, planes)], "frame_id bigint, name string, planes int")
    return canonical.facts(files, heads, list(rules)).first()


def test_totals_that_stand_in_the_exposure(spark):
    dwarf = Rule(exptime_total="stacked_file")
    r = _facts(spark, "stacked_M31_60s60_Duo.fits", [("EXPTIME", "float", "2580.0"), ("DET-TEMP", "float", "20.5")], [dwarf, Rule(keys={"sensor_temp_c": ["DET-TEMP"]})])
    assert (r["exposure_s"]["value"], r["stack_count"]["value"], r["total_integration_s"]["value"]) == (60.0, 43, 2580.0)
    assert r["exposure_s"]["source"] == "filename" and r["stack_count"]["source"].startswith("derived") and r["sensor_temp_c"]["source"] == "DET-TEMP" and r["gain"]["value"] == 60.0 and r["filter"]["value"] == "Duo"
    r = _facts(spark, "x.fits", [("EXPTIME", "float", "12000.0"), ("NCOMBINE", "integer", "40")], [Rule(exptime_total="always")])
    assert (r["exposure_s"]["value"], r["stack_count"]["value"], r["total_integration_s"]["value"]) == (300.0, 40, 12000.0)
    r = _facts(spark, "x.fits", [("EXPTIME", "float", "3600.0"), ("LUM_EXP", "integer", "120"), ("LUM_CNT", "integer", "30")], [Rule(exptime_total="always", keys={"exposure_s": ["LUM_EXP"], "stack_count": ["LUM_CNT"]})])
    assert (r["exposure_s"]["value"], r["exposure_s"]["source"], r["stack_count"]["value"]) == (120.0, "LUM_EXP", 30)


def test_totals_implied_and_contradicted(spark):
    r = _facts(spark, "M31_302x10s_LP.fit", [("EXPTIME", "float", "3020"), ("STACKCNT", "integer", "302")])
    assert (r["exposure_s"]["value"], r["total_integration_s"]["value"]) == (10.0, 3020.0) and r["notes"]
    r = _facts(spark, "x.fit", [("EXPTIME", "float", "20"), ("STACKCNT", "integer", "212"), ("LIVETIME", "float", "20")])
    assert r["total_integration_s"]["value"] == 4240.0 and "contradicts" in r["notes"][0]
    r = _facts(spark, "x.fit", [("EXPTIME", "float", "20"), ("STACKCNT", "integer", "212"), ("LIVETIME", "float", "4240")])
    assert r["total_integration_s"] == ("4240.0", "LIVETIME") or r["total_integration_s"]["source"] == "LIVETIME"


def test_rules_aliases_scales_serials_and_history(spark):
    rule = Rule(ignore={"FOCALLEN": "always 0"}, serial={"TELESCOP": "serial"}, scale={"EXP_MS": 0.001}, keys={"exposure_s": ["EXP_MS"]}, aliases={"IMAGETYP": {"ext": "Light"}}, mount_in={"ORIGIN": ["EQ*"]}, row_order="TOP-DOWN", history_count=("Images:",), notes=("read by rule",))
    r = _facts(spark, "x.fit", [("FOCALLEN", "integer", "250"), ("TELESCOP", "string", "S50_1234"), ("EXP_MS", "integer", "2500"), ("IMAGETYP", "string", "'EXT '"), ("ORIGIN", "string", "EQ6-R"), ("BAYERPAT", "string", "GRBG")], [rule], planes=3, history=("Images: 96 used",))
    assert r["focal_mm"] is None and r["telescope"] is None and r["exposure_s"]["value"] == 2.5 and r["frame_type"]["value"] == "Light" and r["mount"]["value"] == "EQ6-R" and r["row_order"]["value"] == "TOP-DOWN"
    assert r["stack_count"]["value"] == 96 and r["bayer"] is None and "read by rule" in r["notes"] and r["serials"][0]["value"] == "S50_1234" and r["ignored"] == ["FOCALLEN"]


def test_positions_dates_and_ranks(spark):
    r = _facts(spark, "x.fit", [("RA", "float", "400"), ("OBJCTRA", "string", "20 57 10.8"), ("OBJCTDEC", "string", "-00 30 00"), ("DATE-OBS", "string", "1997/01/10"), ("TIME-OBS", "string", "21:05:07.5"), ("SITELAT", "string", "+47 30 00"), ("SITELONG", "string", "-105 16 00"), ("GAIN", "string", "high"), ("OBJECT", "string", " "), ("OBJNAME", "string", "M 1")])
    assert r["ra"]["value"] == pytest.approx(314.295) and r["ra"]["source"] == "OBJCTRA" and r["dec"]["value"] == -0.5 and r["date_obs"]["value"] == "1997-01-10T21:05:07.500" and r["date_obs"]["source"] == "derived:DATE-OBS,TIME-OBS"
    assert r["site_lat"]["value"] == 47.5 and r["site_lon"]["value"] == pytest.approx(-105.266667, abs=1e-6) and r["gain"] is None and r["object"]["source"] == "OBJNAME"
    r = _facts(spark, "x.fit", [("CTYPE1", "string", "RA---TAN"), ("CRVAL1", "float", "10.5"), ("DATE-OBS", "string", "2026-09-24T21:34:12")])
    assert r["ra"] is not None and r["ra"]["value"] == 10.5 and r["dec"] is None and r["date_obs"]["source"] == "DATE-OBS"


def test_image_unit_goes_first_and_programs_are_told(spark):
    cards = _cards(spark, {(1, 0): [("GAIN", "integer", "1"), ("CREATOR", "string", "ZWO Seestar S50"), ("COMMENT", "commentary", "Written by OwlCap 2")], (1, 1): [("GAIN", "integer", "2")], (1, 2): [("OFFSET", "integer", "3")]})
    units = spark.createDataFrame([(1, 0, []), (1, 1, [4, 4]), (1, 2, [2])], "frame_id bigint, hdu int, shape array<bigint>")
    heads = canonical.headers_of(cards, units)
    assert heads.first()["vals"]["GAIN"]["num"] == 2.0 and "OFFSET" not in heads.first()["vals"]
    rules = spark.createDataFrame([(1, "old", '{"match": {"CREATOR": "x"}}'), (2, "old", '{"name": "Old", "role": "capture", "match": {"CREATOR": "zwo *|other"}}'), (1, "owl", '{"role": "processing", "comment": ["Written by OwlCap*"]}')], "revision int, app_id string, rule string")
    apps = canonical.matched(heads, canonical.app_rules(rules))
    assert {r["id"]: r["weight"] for r in apps.collect()} == {"old": 3, "owl": 2}
    assert [a["id"] for a in canonical.software(apps).first()["software"]] == ["old", "owl"]
    both = spark.createDataFrame([("s50", "S50", "scope", 1, "match", "CREATOR", "*S50"), ("s30", "S30", "scope", 0, "match", "CREATOR", "ZWO*"), ("s30", "S30", "scope", 0, "match", "GAIN", "2")], "id string, name string, role string, place int, how string, key string, pattern string")
    told = canonical.scope(canonical.matched(heads, both)).first()
    assert (told["scope"], told["conflict"]) == ("s30", "s50")


FRAMES = "frame_id bigint, frame string, integrated boolean, stack_count bigint, camera string, gain double, offset_adu double, exposure_s double, sensor_temp_c double, set_temp_c double, binning bigint, filter_name string, size array<bigint>, night string"


def test_calibration_with_masters_and_unknowns(spark):
    light = lambda i, cam="Cam A", exp=300.0, filt="Ha": (i, "light", False, None, cam, 100.0, 50.0, exp, -10.0, -10.0, 1, filt, [10, 10], "2024-01-01")
    rows = [
        light(1), light(2), light(3, "cam b", 60.0, None),
        (10, "dark", True, 40, "cam a ", 100.3, None, 300.004, -9.0, None, 1, None, [10, 10], None), (11, "dark", False, None, "Cam A", 100.0, 50.0, 300.0, -10.0, None, 1, None, [10, 10], None),
        (12, "flat", False, None, None, 100.0, 50.0, 2.0, None, None, None, "HA", [10, 10], "2024-01-02"), (13, "dark_flat", False, None, "Cam A", 100.0, 50.0, 2.0, None, None, 1, None, None, None), (14, "bias", False, None, "Cam A", 200.0, 50.0, 0.0, None, None, 1, None, None, None),
    ]
    frames = spark.createDataFrame(rows, FRAMES)
    found = {r["first_frame"]: r for r in calibration.sets(frames).collect()}
    assert found[10]["master"] and found[10]["frames"] == 40 and not found[11]["master"] and len(found) == 5
    m = {r["first_frame"]: r for r in calibration.match(frames).collect()}
    # a master one degree off scores 1, a set of singles a half
    assert m[1]["darks"]["set"] == 11 and m[1]["darks"]["score"] == 0.5 and m[1]["darks"]["status"] == "ok"
    # a flat of no known camera, of the same filter in other letters, of another night
    assert m[1]["flats"]["set"] == 12 and m[1]["flats"]["notes"] == ["night"] and m[1]["bias"]["set"] == 13 and m[1]["status"] == "ready" and m[1]["why"] is None
    assert m[3]["darks"] is None and m[3]["flats"]["set"] == 12 and m[3]["status"] == "partial" and "no darks" in m[3]["why"] and m[3]["share"] == pytest.approx(60 / 660)
    got = calibration.readiness(calibration.match(frames)).first()
    assert (got["ready"], got["partial"], got["missing"]) == (1, 1, 0)
    assert calibration.match(frames.limit(0)).count() == 0


def test_edits_in_order_with_refusals(spark):
    cards = _cards(spark, {
        (1, 0): [("SIMPLE", "logical", "T"), ("GAIN", "integer", "100"), ("OBSERVER", "string", "me"), ("OBSERVER", "string", "you"), ("HISTORY", "commentary", "old")],
        (2, 0): [("CAMGAIN", "integer", "5"), ("GAIN", "integer", "6")],
    })
    ops = [edits.Op("set", "observer", "nobody"), edits.Op("set", "NEW", "1.5"), edits.Op("rename", "GAIN", "EGAIN"), edits.Op("set", "EGAIN", "7"), edits.Op("history", value="y" * 100)]
    r = {x["frame_id"]: x for x in edits.plan(cards, ops).collect()}
    told = [(c["kind"], c["keyword"], c["before"], c["after"]) for c in r[1]["changes"]]
    assert told == [("modified", "observer".upper(), "'me'", "'nobody'"), ("added", "NEW", None, "1.5"), ("renamed", "GAIN->EGAIN", "GAIN = 100", "EGAIN = 100"), ("modified", "EGAIN", "100", "7"), ("history", "HISTORY", None, "y" * 100)]
    assert "2 times" in r[1]["warnings"][0] and r[1]["consequences"] == ["other calibration frames match"] and r[1]["refused"] is None
    # one added, two of history, the audit line over two records
    assert r[1]["records"] == 5 and r[1]["records_after"] > 8 and r[1]["in_place"]
    refused = {x["frame_id"]: x["refused"] for x in edits.plan(cards, [edits.Op("rename", "CAMGAIN", "GAIN")]).collect()}
    assert refused[2] == "cannot rename CAMGAIN to GAIN: GAIN already exists" and refused[1] is not None
    for op, word in ((edits.Op("set", "BITPIX", "8"), "locked"), (edits.Op("unset", "TFORM3"), "locked"), (edits.Op("set", "TOOLONGKEY", "1"), "valid"), (edits.Op("set", "OBJECT", "café"), "printable")):
        x = edits.plan(cards, [op]).collect()
        assert all(word in y["refused"] and not y["changes"] and y["records"] == y["records_after"] for y in x)
    units = spark.createDataFrame([(1, 0, "primary", ["missing_end"]), (2, 0, "compressed_image", [])], "frame_id bigint, hdu int, kind string, errors array<string>")
    x = {y["frame_id"]: y["refused"] for y in edits.plan(cards, [edits.Op("set", "ZVAL", "1")], units).collect()}
    assert "missing_end" in x[1] and "tile-compression" in x[2]
    total = edits.totals(edits.plan(cards, [edits.Op("set", "GAIN", "9")])).first()
    assert (total["changed"], total["in_place"], total["refused"]) == (2, 2, 0)


def test_assignments_and_queue(spark):
    df = spark.createDataFrame([(1, "gain = 5"), (2, "OBJECT='M 1'"), (3, "GAIN=1e2"), (4, "FILTER"), (5, "bad key=1"), (6, "FLAG=T")], "place int, assignment string")
    assert edits.parsed(df) == [edits.Op("set", "OBJECT", "M 1", "string"), edits.Op("set", "GAIN", "1e2", "float"), edits.Op("unset", "FILTER"), edits.Op("set", "FLAG", "T", "logical")]
    assert edits.from_template(spark.createDataFrame([(None, "5")], "object string, gain string")) == [edits.Op("unset", "OBJECT"), edits.Op("set", "GAIN", "5")]
    scrub = edits.scrub(_cards(spark, {(1, 0): [("OBSLAT", "float", "1"), ("TELESCOP", "string", "S50_1"), ("GAIN", "integer", "1")]}), ["TELESCOP"], spark.createDataFrame([(1, "S50")], "frame_id bigint, model string"))
    assert {tuple(r)[2:] for r in scrub.collect()} == {("OBSLAT", "unset", None), ("TELESCOP", "set", "S50")}


def test_what_differences_mean(spark):
    cards = _cards(spark, {
        (1, 0): [("GAIN", "integer", "100"), ("CCD-TEMP", "float", "-10.0"), ("EXPTIME", "float", "300.0"), ("DATE-OBS", "string", "2024-01-01T00:00:00"), ("FILTER", "string", "Ha"), ("CRVAL1", "float", "1")],
        (2, 0): [("GAIN", "float", "1.0E2"), ("CCD-TEMP", "float", "-7.5"), ("EXPTIME", "float", "60.0"), ("DATE-OBS", "string", "2024-01-01T12:30:00"), ("FILTER", "string", "Ha "), ("OFFSET", "integer", "5")],
    })
    kinds = spark.createDataFrame([(1, "light", False), (2, "dark", False)], "frame_id bigint, kind string, integrated boolean")
    pairs = spark.createDataFrame([(1, 2)], "a bigint, b bigint")
    rows = compare.compared(cards, pairs, kinds)
    got = {r["keyword"]: (r["status"], r["level"], r["impact"]) for r in rows.collect()}
    assert got == {
        "GAIN": ("same", "ok", "match"), "CCD-TEMP": ("changed", "warning", "Δ 2.5 °C"), "EXPTIME": ("changed", "warning", "dark exposure differs (needs scaling)"), "DATE-OBS": ("changed", "info", "12.5 h apart"),
        "FILTER": ("same", None, None), "CRVAL1": ("only_a", None, None), "OFFSET": ("only_b", "warning", "offset missing on one side"),
    }
    assert [r["keyword"] for r in rows.orderBy("place").collect()][-1] == "OFFSET" and {r["keyword"] for r in compare.notable(rows).collect()} == set(got) - {"FILTER"}
    assert tuple(compare.counted(rows).first())[2:] == (7, 5, 0)


LISTING = "path string, name string, date_obs string, object string, filter_name string, exposure_s double, stack_count bigint, night string, gain double, camera string, frame string"


def test_moves_never_share_a_place(spark):
    row = lambda path, date, obj="M 1": (path, path.rsplit("/", 1)[1], date, obj, None, 300.0, None, "2024-01-01", None, None, "light")
    files = spark.createDataFrame([row("/in/a/x.fit", "2024-01-02T00:00:00"), row("/in/b/x.fit", "2024-01-01T00:00:00"), row("/in/c/x.fit", None), row("/in/d/x_2.fit", "2024-01-03T00:00:00"), row("/out/M 1/unknown/y.fit", "2024-01-04T00:00:00"), row("/in/e/y.fit", "2023-01-01T00:00:00")], LISTING)
    sides = spark.createDataFrame([("/in/a/X.txt",), ("/in/z/x.txt",)], "path string")
    moves = organise.plan(files, "/out", companions=sides)
    got = {r["source"]: r["target"] for r in moves.collect()}
    assert got == {"/in/c/x.fit": "/out/M 1/unknown/x.fit", "/in/b/x.fit": "/out/M 1/unknown/x_3.fit", "/in/a/x.fit": "/out/M 1/unknown/x_4.fit", "/in/d/x_2.fit": "/out/M 1/unknown/x_2.fit", "/in/e/y.fit": "/out/M 1/unknown/y_2.fit", "/in/a/X.txt": "/out/M 1/unknown/x_4.txt"}
    assert len(set(got.values())) == len(got) and {r["source"]: r["target"] for r in organise.undo(moves).collect()} == {v: k for k, v in got.items()}
    named = {r["source"]: (r["target"], r["lacking"]) for r in organise.plan(files, "/out", "{object}", "{object}_{exptime}s_{time}_{seq}{scope}").collect()}
    assert named["/in/c/x.fit"] == ("/out/M 1/M 1_300s_unknown_0001unknown.fit", ["time", "scope"]) and named["/in/b/x.fit"][0] == "/out/M 1/M 1_300s_000000_0003unknown.fit"


def test_grading_rules():
    assert folder.parse_rules("hfr>3.5, stars<50,bg > 900, ecc>0.6, trails") == {"hfr_max": 3.5, "stars_min": 50.0, "background_max": 900.0, "eccentricity_max": 0.6, "trails": True}
    for bad in ("hfr<3", "stars>5", "fwhm>2", "hfr>x", "hfr"):
        with pytest.raises(ValueError):
            folder.parse_rules(bad)


def test_text_forms(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    lit = F.lit
    assert one(text.fuzzy(lit("neb"), lit("Copperleaf Nebula"))) == 1000 - 11 + 200 and one(text.fuzzy(lit("cnb"), lit("Crab Neb"))) == 500 - 7 and one(text.fuzzy(lit("xz"), lit("abc"))) is None and one(text.fuzzy(lit(" "), lit("abc"))) == 0
    for pattern, value, fits_ in (("ZWO *AIR", "zwo asiair", True), ("Seestar*", " seestar s50 ", True), ("a.c", "abc", False), ("*", "", True), ("a*b", "ab\ncb", True), ("M(1)*", "m(1)x", True)):
        assert one(text.matches(lit(pattern), lit(value))) is fits_, pattern
    assert one(text.ra_text(lit(359.99999))) == "00h00m00.0s" and one(text.ra_text(lit(314.295))) == "20h57m10.8s" and one(text.dec_text(lit(-31.23527))) == "−31°14′07″"
    assert one(text.parse_dec(lit("-00 30 00"))) == -0.5 and one(text.parse_ra(lit("24:00:00"))) is None and one(text.parse_lon(lit("1 2 3 4"))) is None and one(text.parse_ra(lit("20h57m10.8s"))) == pytest.approx(314.295)
    assert [one(f(lit(15120.0))) for f in (text.compact_duration, text.report_duration, text.spaced_duration)] == ["4h12m", "4h 12m", "4 h 12 m"] and one(text.trimmed(lit(250.0), 2)) == "250" and one(text.trimmed(lit(2.9), 3)) == "2.9"
    f = one(filename.facts(lit("/a/Light_M 45_300.0s_Bin1_2600MC_gain100_20251024-212700_-14.9C_0001.fit")))
    assert tuple(f) == ("light", 300.0, 100, 1, -14.9, None, None)
    f = one(filename.facts(lit("Stacked_771_NGC 6995_20.0s_LP_20260924.fit.fz")))
    assert (f["prefix"], f["frames"], f["filter_name"], f["exposure_s"]) == ("stacked", 771, "LP", 20.0)
    assert one(filename.facts(lit("M31_460x10s_608.3ms.fit")))["frames"] == 460


def test_moon_and_plate(spark):
    one = lambda *c: spark.range(1).select(*[x.alias(f"x{i}") for i, x in enumerate(c)]).first()
    ra, dec = astro.moon(F.lit(2448724.5))
    lit_, waxing = astro.moon_phase(F.lit(2448724.5))
    got = one(ra, dec, lit_, waxing, astro.azimuth(F.lit(347.3193375), F.lit(-6.719892), F.lit(38.921389), F.lit(-77.065556), F.lit(2446896.30625)))
    assert got["x0"] == pytest.approx(134.68847, abs=0.3) and got["x1"] == pytest.approx(13.768368, abs=0.3) and got["x2"] == pytest.approx(0.6786, abs=0.01) and got["x3"] and got["x4"] == pytest.approx(248.0337, abs=0.01)
    cd = astro.cd_matrix(*[F.lit(x) for x in (-0.001, 0.0, 0.0, 0.001)], *[F.lit(None).cast("double")] * 3, F.lit(False))
    at = lambda x, y, p1=100.0, p2=50.0, m=cd: astro.pixel_to_sky(F.lit(x), F.lit(y), F.lit(10.0), F.lit(41.0), F.lit(p1) if isinstance(p1, float) else p1, F.lit(p2) if isinstance(p2, float) else p2, m)
    got = one(*at(99.0, 49.0), at(99.0, 50.0)[1], at(100.0, 49.0)[0], astro.rotation(cd), astro.wcs_scale(cd))
    assert got["x0"] == pytest.approx(10.0) and got["x1"] == pytest.approx(41.0) and got["x2"] == pytest.approx(41.001, abs=1e-6) and got["x3"] < 10 and got["x4"] == 0.0 and got["x5"] == pytest.approx(3.6)
    # the same sky under the same pixel after each change of the image
    want = one(*at(30.0, 20.0))
    for how, x, y, px, py in (("crop", 10.0, 5.0, 20.0, 15.0), ("flip_columns", 200.0, 0.0, 169.0, 20.0), ("flip_rows", 0.0, 100.0, 30.0, 79.0), ("rotate", 0.0, 100.0, 79.0, 30.0), ("scale", 2.0, 0.0, 60.5, 40.5)):
        p1, p2, m = astro.moved_solution(F.lit(100.0), F.lit(50.0), cd, how, x, y)
        moved = one(*at(px, py, p1, p2, m))
        assert moved["x0"] == pytest.approx(want["x0"]) and moved["x1"] == pytest.approx(want["x1"]), how


def _unit(cards, data=b""):
    pad = lambda b, fill: b + fill * (-len(b) % 2880)
    return pad(b"".join(c.ljust(80)[:80].encode() for c in [*cards, "END"]), b" ") + pad(data, b"\0")


def test_a_folder_as_a_listing(spark, tmp_path):
    head = ["SIMPLE  =                    T", "BITPIX  =                   16", "NAXIS   =                    2", "NAXIS1  =                    4", "NAXIS2  =                    3"]
    pixels = np.arange(12, dtype=">i2").tobytes()
    light = [*head, "OBJECT  = 'NGC 6995'", "EXPTIME =                 20.0", "GAIN    =                   80", "IMAGETYP= 'Light   '", "DATE-OBS= '2026-09-24T21:34:12'", "BAYERPAT= 'GRBG    '", "FOCALLEN=                250.0", "XPIXSZ  =                  2.9", "GAIN    =                   90"]
    (tmp_path / "Light_NGC 6995_20.0s_LP_20260924-213412.fit").write_bytes(_unit(light, pixels))
    (tmp_path / "dark 1.fits").write_bytes(_unit([*head[:1], *head[2:], "IMAGETYP= 'Dark    '"], pixels))
    got = {r["name"]: r for r in fits.listing(spark, str(tmp_path)).collect()}
    r = got["Light_NGC 6995_20.0s_LP_20260924-213412.fit"]
    assert (r["object"], r["exposure_s"], r["gain"], r["filter_name"], r["label"], r["frame"], r["pixel_scale"], r["night"], r["size"]) == ("NGC 6995", 20.0, 80.0, "LP", "Light sub", "light", 2.393, "2026-09-24", [4, 3])
    assert got["dark 1.fits"]["frame"] == "dark"
    units = fits.hdus(fits.resolve(spark, [str(tmp_path), str(tmp_path / "dark 1.fits")], roots=[str(tmp_path)]))
    issues = {(r["code"], r["what"]) for r in fits.layout_issues(units, fits.cards(units)).collect()}
    assert ("duplicate_keyword", "GAIN") in issues and ("missing_required", "BITPIX") in issues
    with pytest.raises(ValueError):
        fits.resolve(spark, ["/etc"], roots=[str(tmp_path)])
