"""Headers compared side by side: what differs, what it means for calibration, and how much blocks it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions import text, values
from skyledger.operators.canonical import text_datetime

# Keywords that must agree for one file to calibrate the other.
CALIBRATION = {"GAIN": "gain", "OFFSET": "offset", "INSTRUME": "camera", "READOUTM": "readout mode", "BAYERPAT": "Bayer pattern", "ROWORDER": "row order"}
CAL_KINDS = ["dark", "flat", "bias", "dark_flat"]


def _days(s: Column) -> Column:
    p = text_datetime(s)
    day = F.unix_date(F.try_to_date(F.concat_ws("-", p["year"].cast("string"), p["month"].cast("string"), p["day"].cast("string")), "y-M-d"))
    return day + (p["hour"] * 3600 + p["minute"] * 60 + p["second"]) / 86400.0


def compared(cards: DataFrame, pairs: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """a, b, keyword, place, status, value_a, value_b, level, impact, wcs of every value keyword of each pair of files.

    pairs: a, b (frame ids of `cards`). kinds: frame_id, kind, integrated, for
    what a difference means; unknown without. place is the order of a's header,
    then of what only b has. Of a keyword given twice the last card counts in
    the place of the first. Numbers are equal as numbers, texts without outer
    blanks. level: ok, info, warning or blocker; null where a row means nothing.
    """
    c, no = F.col, F.lit(False)
    last = cards.filter(F.coalesce("value_type", F.lit("")) != "commentary").groupBy("frame_id", "keyword").agg(F.max_by(F.struct("value_type", "value_text"), "record").alias("x"), F.min("record").alias("at"))
    last = last.select("frame_id", "keyword", "at", c("x.value_type").alias("t"), F.trim(F.coalesce("x.value_text", F.lit(""))).alias("v"))
    side = lambda s, other: pairs.join(last.withColumnRenamed("frame_id", s), s).select("a", "b", "keyword", c("t").alias(f"t_{s}"), c("v").alias(f"v_{s}"), c("at").alias(f"at_{s}"))
    both = side("a", "b").join(side("b", "a"), ["a", "b", "keyword"], "full_outer")
    number = lambda s: F.when(c(f"t_{s}").isin("integer", "float"), F.translate(f"v_{s}", "Dd", "EE").try_cast("double"))
    both = both.withColumns({"n_a": number("a"), "n_b": number("b")})
    same = F.when(c("n_a").isNotNull() & c("n_b").isNotNull(), c("n_a") == c("n_b")).otherwise(c("v_a") == c("v_b"))
    both = both.withColumn("status", F.when(c("t_b").isNull(), "only_a").when(c("t_a").isNull(), "only_b").when(same, "same").otherwise("changed"))
    if kinds is not None:
        own = lambda s: kinds.select(c("frame_id").alias(s), c("kind").alias(f"kind_{s}"), c("integrated").alias(f"integrated_{s}")).dropDuplicates([s])
        both = both.join(own("a"), "a", "left").join(own("b"), "b", "left")
    else:
        both = both.withColumns({x: F.lit(None) for x in ("kind_a", "kind_b")}).withColumns({x: F.lit(None).cast("boolean") for x in ("integrated_a", "integrated_b")})
    cal = lambda s: F.coalesce(c(f"kind_{s}").isin(CAL_KINDS), no)
    is_ = lambda s, k: F.coalesce(c(f"kind_{s}") == k, no)
    calibrating, k, st = cal("a") | cal("b"), c("keyword"), c("status")
    what = F.lit(None).cast("string")
    for key, name in CALIBRATION.items():
        what = F.when(k == key, name).otherwise(what)
    imp = lambda level, words: F.struct(F.lit(level).alias("level"), (F.lit(words) if isinstance(words, str) else words).alias("impact"))
    apart = F.abs(c("n_a") - c("n_b"))
    warm = F.when((apart > 0) | calibrating, F.struct(F.when(apart > 2, "warning").otherwise("ok").alias("level"), F.when(apart < 0.05, "match").otherwise(F.concat(F.lit("Δ "), F.format_string("%.1f", F.round(apart, 1)), F.lit(" °C"))).alias("impact")))
    dark, flat = is_("a", "dark") | is_("b", "dark"), is_("a", "flat") | is_("b", "flat")
    stacks = F.coalesce("integrated_a", no) & F.coalesce("integrated_b", no)
    days = F.abs(_days(c("v_a")) - _days(c("v_b")))
    number_of = F.coalesce("n_a", "n_b")
    found = (
        F.when(what.isNotNull() & (st == "same"), F.when(calibrating, imp("ok", "match"))).when(what.isNotNull() & (st == "changed"), imp("blocker", F.concat(F.lit("blocks calibration ("), what, F.lit(" differs)"))))
        .when(what.isNotNull(), imp("warning", F.concat(what, F.lit(" missing on one side")))).when(k.isin("CCD-TEMP", "SET-TEMP"), warm)
        .when(k.isin("EXPTIME", "EXPOSURE") & dark, F.when(st == "same", imp("ok", "match")).when((st == "changed") & ~stacks, imp("warning", "dark exposure differs (needs scaling)")))
        .when((k == "FILTER") & flat, F.when(st == "changed", imp("blocker", "blocks flat calibration (filter differs)")).when(st == "same", imp("ok", "match")))
        .when(k.isin("IMAGETYP", "FRAME") & (st == "changed") & ~c("kind_a").eqNullSafe(c("kind_b")), imp("info", "expected"))
        .when((k == "BITPIX") & (st == "changed") & (F.coalesce("integrated_a", no) | F.coalesce("integrated_b", no)), imp("info", "expected for a stack or master"))
        .when(k.isin("STACKCNT", "NCOMBINE") & (st != "same") & number_of.isNotNull(), imp("info", F.concat(F.when(calibrating, "master").otherwise("stack"), F.lit(" of "), text.trimmed(number_of, 3))))
        .when((k == "DATE-OBS") & (st == "changed") & days.isNotNull(), imp("info", text.interval(days)))
    )
    out = both.withColumn("found", found)
    shown = lambda s: text.shown(c(f"t_{s}"), c(f"v_{s}"))
    return out.select("a", "b", "keyword", F.coalesce("at_a", c("at_b") + 1_000_000_000).alias("place"), "status", shown("a").alias("value_a"), shown("b").alias("value_b"), "found.level", "found.impact", text.is_wcs(k).alias("wcs"))


def notable(rows: DataFrame) -> DataFrame:
    """Differences, and agreements that matter."""
    return rows.filter((F.col("status") != "same") | F.col("impact").isNotNull())


def counted(rows: DataFrame) -> DataFrame:
    """a, b, keywords, differences, blockers of each pair."""
    return rows.groupBy("a", "b").agg(F.count("*").alias("keywords"), F.count_if(F.col("status") != "same").alias("differences"), F.count_if(F.coalesce(F.col("level") == "blocker", F.lit(False))).alias("blockers"))
