"""Header reading on files written here, and published astronomical examples."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.functions import astro, filename
from skyledger.operators import catalogue, classify, folder, headers
from skyledger.sources import fits


def _card(text):
    return text.ljust(80)[:80].encode("latin-1")


def _unit(cards, data=b""):
    head = b"".join(map(_card, [*cards, "END"]))
    pad = lambda b, fill: b + fill * (-len(b) % 2880)
    return pad(head, b" ") + pad(data, b"\0")


@pytest.fixture()
def archive(tmp_path):
    pixels = np.arange(12, dtype=">i2").reshape(3, 4)
    cards = ["SIMPLE  =                    T", "BITPIX  =                   16", "NAXIS   =                    2", "NAXIS1  =                    4", "NAXIS2  =                    3", "BZERO   =                32768", "OBJECT  = 'O''Neill '          / name of target", "EXPTIME =                 20.0 / [s] exposure", "LONGSTR = 'first &'", "CONTINUE  'second'", "HISTORY stacked twice"]
    (tmp_path / "a.fits").write_bytes(_unit(cards, pixels.tobytes()) + _unit(["XTENSION= 'BINTABLE'", "BITPIX  =                    8", "NAXIS   =                    2", "NAXIS1  =                    2", "NAXIS2  =                    1", "PCOUNT  =                    0", "GCOUNT  =                    1"], b"ab"))
    (tmp_path / "short.FIT").write_bytes(_unit(cards, pixels.tobytes())[:-2880 + 5])
    (tmp_path / "other.fits").write_bytes(b"not a header" * 10)
    (tmp_path / "empty.fits").write_bytes(b"")
    (tmp_path / ".hidden.fits").write_bytes(_unit(cards))
    (tmp_path / "notes.txt").write_text("x")
    return str(tmp_path)


def test_headers_and_pixels(spark, archive):
    files = fits.list_files(spark, archive)
    assert sorted(r["path"].rsplit("/", 1)[1] for r in files.collect()) == ["a.fits", "other.fits", "short.FIT"]
    units = fits.hdus(files)
    got = {(r["path"].rsplit("/", 1)[1], r["hdu"]): r for r in units.collect()}
    assert got["a.fits", 0]["data_bytes"] == 24 and got["a.fits", 1]["issue"] is None and got["short.FIT", 0]["issue"] == "truncated_data" and got["other.fits", 0]["issue"] == "not_fits"
    cards = {r["keyword"]: r for r in fits.cards(units).filter("path LIKE '%a.fits' AND hdu = 0").collect()}
    assert cards["OBJECT"]["value_text"] == "O'Neill" and cards["OBJECT"]["note"] == "name of target"
    assert cards["EXPTIME"]["value_type"] == "float" and cards["SIMPLE"]["value_type"] == "logical" and cards["HISTORY"]["value_type"] == "commentary"
    assert cards["LONGSTR"]["value_text"] == "first second"
    planes = fits.planes(units).collect()
    assert len(planes) == 1 and planes[0]["data"] == [32768.0 + k for k in range(12)] and (planes[0]["width"], planes[0]["height"]) == (4, 3)


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def _micros(*when):
    return int(dt.datetime(*when, tzinfo=dt.timezone.utc).timestamp() * 1e6)


def test_published_examples(spark):
    lit = lambda x: F.lit(float(x))
    assert _one(spark, astro.julian_day(F.lit(_micros(1957, 10, 4, 19, 26, 24)))) == pytest.approx(2436116.31, abs=1e-6)
    assert _one(spark, astro.sidereal(lit(2446895.5))) == pytest.approx(197.693195, abs=1e-4)
    venus = astro.altitude(lit(347.3193375), lit(-6.719892), lit(38.921389), lit(-77.065556), astro.julian_day(F.lit(_micros(1987, 4, 10, 19, 21))))
    assert _one(spark, venus) == pytest.approx(15.1249, abs=0.01)
    assert _one(spark, astro.airmass(lit(90))) == pytest.approx(1.0, abs=1e-3) and _one(spark, astro.airmass(lit(30))) == pytest.approx(1.995, abs=0.01) and _one(spark, astro.airmass(lit(-1))) is None
    ra, dec = astro.sun(lit(2448908.5))
    assert _one(spark, ra) == pytest.approx(198.38083, abs=0.02) and _one(spark, dec) == pytest.approx(-7.78507, abs=0.02)
    assert _one(spark, astro.pixel_scale(lit(2.9), lit(250))) == pytest.approx(2.393, abs=0.001)


def test_file_names(spark):
    cases = {"Light_T3_20.0s_LP_Bin2.fit": ("light", 20.0, 2), "DSO_Stacked_795_608.3ms.fits.fz": ("dso_stacked", 0.6083, None), "masterlight_460x10s.fit": ("masterlight", 10.0, None), "x_60s60_bin1.fit": (None, 60.0, 1), "lightness.fit": (None, None, None), "": (None, None, None)}
    df = spark.createDataFrame([(k,) for k in cases], "name string")
    n = F.col("name")
    got = {r["name"]: (r["p"], r["e"], r["b"]) for r in df.select("name", filename.prefix(n).alias("p"), filename.exposure(n).alias("e"), filename.binning(n).alias("b")).collect()}
    assert got == cases


def test_upper_median(spark):
    rows = [("a", v) for v in (4.0, 1.0, 3.0, 2.0)] + [("b", 5.0), ("b", 5.0), ("b", 1.0), ("c", None)]
    got = {r["k"]: r["m"] for r in folder.upper_median(spark.createDataFrame(rows, "k string, v double"), ["k"], F.col("v"), "m").collect()}
    assert got == {"a": 3.0, "b": 5.0}


def test_records_round_trip(spark):
    rows = [("OBJECT", "string", "it's / here", "a note"), ("GAIN", "integer", "100", None), ("T", "float", "-1.5E+02", "[C]"), ("FLAG", "logical", "T", None), ("NIL", "undefined", "", None)]
    df = spark.createDataFrame(rows, "keyword string, value_type string, value_text string, note string")
    df = df.withColumn("r", headers.format_record(*[F.col(c) for c in df.columns])).withColumn("p", headers.parse_record(F.col("r")))
    for r in df.collect():
        assert len(r["r"]) == 80 and tuple(r["p"]) == tuple(r[c] for c in ("keyword", "value_type", "value_text", "note"))


def test_evidence(spark):
    rows = [(1, "Light_1.fit", "Dark Frame", 60.0, None), (2, "x.fit", None, 0.001, "M"), (3, "x.fit", None, 10.0, "M"), (4, "x.fit", None, None, None), (5, "flat_1.fit", "DARK-FLAT", 1.0, None)]
    got = {r["frame_id"]: (r["kind"], r["score"]) for r in classify.classify(spark.createDataFrame(rows, "frame_id bigint, name string, frame_type string, exposure_s double, object string")).collect()}
    assert got == {1: ("dark", 48), 2: ("bias", 30), 3: ("light", 20), 4: ("unknown", 0), 5: ("dark_flat", 48)}


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), float(a), float(d)) for i, a, d in zip(range(200), rng.uniform(0, 40, 200), rng.uniform(-20, 20, 200))]
    got = {r["i"]: (r["near"], r["degrees"]) for r in catalogue.neighbours(spark.createDataFrame(rows, "i int, ra_deg double, dec_deg double"), "i", 1.5).collect()}
    rad = np.pi / 180
    want = {}
    for i, a, d in rows:
        all_ = sorted((round(2 * np.arcsin(min(1, np.sqrt(np.sin((e - d) * rad / 2) ** 2 + np.cos(d * rad) * np.cos(e * rad) * np.sin((b - a) * rad / 2) ** 2))) / rad, 6), j) for j, b, e in rows if j != i)
        if all_[0][0] <= 1.5:
            want[i] = (all_[0][1], pytest.approx(all_[0][0], abs=1e-6))
    assert got == want
