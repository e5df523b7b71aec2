"""Calibration frames matched to light frames: sets and masters, the best of each kind, and what a group still lacks.

Frames are grouped into sets by their settings, and light frames into groups by
what their calibration must fit; both are as few as there are settings. A
group's candidates share its camera or tell none (an equi-join); of them the
set with the lowest score is taken. A set of another known camera is never
taken, which changes no group's status.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.operators.folder import is_light, milliseconds, upper_median

KINDS = ("dark", "flat", "bias", "dark_flat")
MISSING = -(2**62)
KEYS = ["k_camera", "k_gain", "k_offset", "k_ms", "k_binning", "k_filter", "k_size"]
_OWN = ["camera", "gain", "offset_adu", "exposure_s", "binning", "filter_name", "size", "night"]


def _keyed(frames: DataFrame) -> DataFrame:
    """frames with size as text and the rounded settings that group them; what is unknown is a setting too."""
    r = lambda c, k=1: F.coalesce(F.round(F.col(c) * k).cast("bigint"), F.lit(MISSING))
    df = frames.withColumn("size", F.when(F.size("size") > 0, F.array_join("size", "x")))
    return df.withColumns({
        "k_camera": F.coalesce("camera", F.lit("")), "k_gain": r("gain"), "k_offset": r("offset_adu"), "k_ms": F.coalesce(milliseconds("exposure_s"), F.lit(MISSING)), "k_binning": F.coalesce("binning", F.lit(1)),
        "k_filter": F.coalesce("filter_name", F.lit("")), "k_size": F.coalesce("size", F.lit("")),
    })


def sets(frames: DataFrame) -> DataFrame:
    """first_frame, kind, master, frames, camera, gain, offset_adu, exposure_s, temp_c, binning, filter_name, size, night of every set.

    A master is a set of its own, of as many frames as it was stacked from.
    Others are grouped by their settings; darks also by whole degrees, flats by
    night. A set's values are those of its first frame, its temperature is the
    upper median.
    """
    cal = _keyed(frames.filter(F.col("frame").isin(*KINDS)))
    masters = cal.filter("integrated").select(F.col("frame_id").alias("first_frame"), F.col("frame").alias("kind"), F.lit(True).alias("master"), F.greatest(F.coalesce("stack_count", F.lit(1)), F.lit(1)).alias("frames"), *_OWN, F.col("sensor_temp_c").alias("temp_c"))
    bucket = F.when(F.col("frame") == "dark", F.coalesce(F.round("sensor_temp_c").cast("bigint"), F.lit(MISSING))).otherwise(0)
    single = cal.filter(~F.coalesce("integrated", F.lit(False))).withColumns({"k_temp": bucket, "k_night": F.when(F.col("frame") == "flat", F.coalesce("night", F.lit(""))).otherwise("")})
    keys = ["frame", *KEYS, "k_temp", "k_night"]
    found = single.groupBy(*keys).agg(F.count("*").alias("frames"), F.min("frame_id").alias("first_frame"), F.min_by(F.struct(*_OWN), "frame_id").alias("x"))
    found = found.join(upper_median(single, keys, F.col("sensor_temp_c"), "temp_c"), keys, "left")
    return masters.unionByName(found.select("first_frame", F.col("frame").alias("kind"), F.lit(False).alias("master"), "frames", *[F.col(f"x.{c}").alias(c) for c in _OWN], "temp_c"))


def light_groups(frames: DataFrame) -> DataFrame:
    """Light subs by the settings that their calibration must fit: first_frame, the first sub's settings, temp_c, cooled, subs, integration_s, nights."""
    subs = _keyed(frames.filter(is_light()))
    out = subs.groupBy(*KEYS).agg(
        F.min("frame_id").alias("first_frame"), F.min_by(F.struct(*[c for c in _OWN if c != "night"]), "frame_id").alias("x"), F.count("*").alias("subs"), F.max(F.col("set_temp_c").isNotNull()).alias("cooled"),
        F.coalesce(F.sum("exposure_s"), F.lit(0.0)).alias("integration_s"), F.sort_array(F.collect_set("night")).alias("nights"),
    )
    out = out.join(upper_median(subs, KEYS, F.col("sensor_temp_c"), "temp_c"), KEYS, "left")
    return out.select("first_frame", *[F.col(f"x.{c}").alias(c) for c in _OWN if c != "night"], "temp_c", "cooled", "subs", "integration_s", "nights")


def _close(a: Column, b: Column, within: float) -> Column:
    """Unknown on either side is no mismatch."""
    return F.coalesce(F.abs(a - b) <= F.greatest(F.lit(within), 1e-6 * F.abs(a)), F.lit(True))


def _same(a: Column, b: Column) -> Column:
    return F.coalesce(F.lower(F.trim(a)) == F.lower(F.trim(b)), F.lit(True))


def best(groups: DataFrame, library: DataFrame, kinds: tuple[str, ...], into: str, exposure: Column, gain: Column, offset: Column) -> DataFrame:
    """groups with `into`: set (first_frame), kind, status, notes, score of the set of `kinds` that fits best; null without a candidate.

    exposure, gain, offset: what is wanted, of the group's columns; null wants
    nothing; the exposure is that of darks and dark-flats. Score: the distance
    in temperature of darks, 1000 for each bad difference, 10 for each one to
    be warned of, and a half for not being a master. The lower set wins ties.
    """
    c = F.col
    s = library.filter(c("kind").isin(*kinds)).select(F.struct(*library.columns).alias("s"))
    # a set is met by groups of its camera and by those of none; one that tells no camera by all
    camera = F.lower(F.trim("s.camera"))
    s = s.withColumn("_key", F.explode(F.array(F.coalesce(camera, F.lit("*")), F.lit("?"))))
    own = F.lower(F.trim("camera"))
    g = groups.withColumns({"_exposure": exposure, "_gain": gain, "_offset": offset}).withColumn("_key", F.explode(F.when(own.isNull(), F.array(F.lit("?"))).otherwise(F.array(own, F.lit("*")))))
    met = g.join(s, "_key")
    flat, dark = c("s.kind") == "flat", c("s.kind") == "dark"
    wanted = F.when(dark | (c("s.kind") == "dark_flat"), c("_exposure"))
    apart = F.when(dark, F.abs(c("s.temp_c") - c("temp_c")))
    ok, most = F.when(c("cooled"), 2.0).otherwise(3.0), F.when(c("cooled"), 5.0).otherwise(6.0)
    note = lambda bad, words: F.when(bad, words)
    setting = [note(~_close(c("s.gain"), c("_gain"), 0.5), "gain"), note(~_close(c("s.offset_adu"), c("_offset"), 0.5), "offset")]
    hard = F.array_compact(F.array(
        note(~_same(c("s.size"), c("size")), "size"), note(F.coalesce("s.binning", F.lit(1)) != F.coalesce("binning", F.lit(1)), "binning"), *[F.when(~flat, x) for x in setting],
        note(~_close(c("s.exposure_s"), wanted, 0.01), "exposure"), note(apart > most, "temperature"), note(flat & ~_same(c("s.filter_name"), c("filter_name")), "filter"),
    ))
    other_night = flat & c("s.night").isNotNull() & (F.size("nights") > 0) & ~F.array_contains("nights", c("s.night"))
    soft = F.array_compact(F.array(*[F.when(flat, x) for x in setting], note((apart > ok) & (apart <= most), "temperature"), note(other_night, "night")))
    met = met.withColumns({"_hard": hard, "_soft": soft})
    score = F.coalesce(apart, F.lit(0.0)) + 1000.0 * F.size("_hard") + 10.0 * F.size("_soft") + F.when(c("s.master"), 0.0).otherwise(0.5)
    told = F.struct(c("s.first_frame").alias("set"), c("s.kind").alias("kind"), F.when(F.size("_hard") > 0, "bad").when(F.size("_soft") > 0, "warn").otherwise("ok").alias("status"), F.concat("_hard", "_soft").alias("notes"), F.round(score, 4).alias("score"), c("s.gain").alias("gain"), c("s.offset_adu").alias("offset_adu"), c("s.exposure_s").alias("exposure_s"))
    chosen = met.groupBy("first_frame").agg(F.min_by(told, F.struct(F.round(score, 4), c("s.first_frame"), c("s.kind"))).alias(into))
    return groups.join(chosen, "first_frame", "left")


def match(frames: DataFrame, library: DataFrame | None = None) -> DataFrame:
    """Every light group with darks, flats and bias (see `best`), status, share of all integration, and why.

    library: frames to take calibration from; those of `frames` if not given.
    Bias or dark-flats must fit the chosen flats, or the lights where there are
    none. status: ready if nothing is badly off, missing if darks and flats
    are, else partial; bias counts only where flats were found. why names what
    is off, and for less than a quarter of the integration that it may be left
    out; null for ready groups.
    """
    c = F.col
    found = sets(frames if library is None else library)
    g = best(light_groups(frames), found, ("dark",), "darks", c("exposure_s"), c("gain"), c("offset_adu"))
    g = best(g, found, ("flat",), "flats", F.lit(None).cast("double"), c("gain"), c("offset_adu"))
    of_flat = lambda name: F.when(c("flats").isNotNull(), c(f"flats.{name}")).otherwise(c(name))
    g = best(g, found, ("bias", "dark_flat"), "bias", c("flats.exposure_s"), of_flat("gain"), of_flat("offset_adu"))
    off = lambda kind: c(kind).isNull() | (c(f"{kind}.status") == "bad")
    status = F.when(~off("darks") & ~off("flats") & ~(off("bias") & c("flats").isNotNull()), "ready").when(off("darks") & off("flats"), "missing").otherwise("partial")
    total = frames.filter(is_light()).agg(F.sum("exposure_s")).first()[0]
    g = g.withColumn("status", status).withColumn("share", c("integration_s") / F.lit(total) if total else F.lit(None).cast("double"))
    told = lambda kind: F.when(c(kind).isNull(), F.lit(f"no {kind}")).when(c(f"{kind}.status") == "bad", F.concat(F.lit(f"{kind}: "), F.array_join(f"{kind}.notes", ", ")))
    hint = F.when(c("share") < 0.25, F.concat(F.lit("or leave these subs out ("), F.format_string("%.1f", 100 * c("share")), F.lit("% of the integration)")))
    return g.withColumn("why", F.when(status != "ready", F.concat_ws("; ", told("darks"), told("flats"), F.when(c("flats").isNotNull(), told("bias")), hint)))


def readiness(matched: DataFrame) -> DataFrame:
    """One row: groups that are ready, partial and missing, and the share of the integration that is ready."""
    is_ = lambda s: F.count_if(F.col("status") == s).alias(s)
    return matched.agg(is_("ready"), is_("partial"), is_("missing"), F.round(F.coalesce(F.sum(F.when(F.col("status") == "ready", F.col("share"))), F.lit(0.0)), 6).alias("ready_share"))
