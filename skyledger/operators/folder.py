"""Folder-scale questions over frame listings: totals, groups, nights, checks, grading, order.

A listing is a row per file (TESTDATA.md, `frames`); files listed again count
once. All aggregates combine on the map side. Medians are the upper middle
value, found over counted values, so that no group is collected into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.operators import order

#: Names of missing keys.
NO_OBJECT, NO_FILTER, NO_NIGHT = "(no OBJECT)", "(no filter)", "(unknown)"


def listed(frames: DataFrame) -> DataFrame:
    """Each file once."""
    return frames.drop("scanned_at").dropDuplicates(["frame_id"])


def milliseconds(exposure: Column | str) -> Column:
    return F.round((F.col(exposure) if isinstance(exposure, str) else exposure) * 1000).cast("bigint")


def is_light(frames: DataFrame | None = None) -> Column:
    """A single light sub."""
    return (F.col("frame") == "light") & ~F.col("integrated")


def keyed(frames: DataFrame) -> DataFrame:
    return frames.withColumns({"object": F.coalesce("object", F.lit(NO_OBJECT)), "filter_name": F.coalesce("filter_name", F.lit(NO_FILTER)), "ms": milliseconds("exposure_s")})


def counts(frames: DataFrame) -> DataFrame:
    """Files of each kind; stacks of any kind apart."""
    kind = F.when(F.col("integrated"), "stack").otherwise(F.coalesce("frame", F.lit("unknown")))
    return frames.groupBy(kind.alias("kind")).agg(F.count("*").alias("files"))


def totals(frames: DataFrame) -> DataFrame:
    """One row: files, bytes, unreadable files, nights, milliseconds of light."""
    return frames.agg(
        F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.count_if(F.col("frame").isNull() | F.col("error").isNotNull()).alias("unreadable"),
        F.countDistinct(F.when(~F.col("integrated"), F.col("night"))).alias("nights"), F.sum(F.when(is_light(), milliseconds("exposure_s"))).alias("light_ms"),
    )


def targets(frames: DataFrame) -> DataFrame:
    """Per target and filter: subs, the sub lengths, exposure, nights."""
    subs = keyed(frames.filter(is_light()))
    lengths = F.array_join(F.sort_array(F.collect_set("ms")), ",")
    return subs.groupBy("object", "filter_name").agg(F.count("*").alias("subs"), F.sum("ms").alias("total_ms"), lengths.alias("lengths_ms"), F.countDistinct("night").alias("nights"), (F.countDistinct("ms") > 1).alias("mixed"))


def minorities(frames: DataFrame, value: Column) -> DataFrame:
    """Per target and filter the values that most of its subs don't share, with their subs; ties go to the largest text."""
    tally = keyed(frames.filter(is_light())).withColumn("value", value.cast("string")).filter(F.col("value").isNotNull()).groupBy("object", "filter_name", "value").agg(F.count("*").alias("subs"))
    w = Window.partitionBy("object", "filter_name").orderBy(F.desc("subs"), F.desc("value"))
    return tally.withColumn("r", F.row_number().over(w)).filter("r > 1").drop("r")


def duplicates(frames: DataFrame) -> DataFrame:
    """Time and size that several light subs share."""
    return frames.filter(is_light() & F.col("date_obs").isNotNull()).groupBy("date_obs", "bytes").agg(F.count("*").alias("files")).filter("files > 1")


def checks(frames: DataFrame, by: str = "rig") -> DataFrame:
    """Per source the figures the folder checks are made of."""
    light = is_light()
    of = lambda c: F.when(light, F.col(c))
    twice = duplicates_by(frames, by)
    return frames.groupBy(by).agg(
        F.count_if(light).alias("subs"), F.countDistinct(F.when(light, milliseconds("exposure_s"))).alias("lengths"), F.countDistinct(of("filter_name")).alias("filters"),
        F.count_if(light & F.col("filter_name").isNull()).alias("no_filter"), F.countDistinct(F.when(light, F.round(F.col("gain") * 100).cast("bigint"))).alias("gains"),
        (F.max(of("sensor_temp_c")) - F.min(of("sensor_temp_c")) > 4).alias("wide_temp"), F.count_if(F.col("error").isNotNull() | F.col("frame").isNull()).alias("damaged"),
        F.count_if(light & (F.col("focal_mm").isNull() | (F.col("focal_mm") <= 0))).alias("no_focal"),
    ).join(twice, by, "left").withColumn("duplicates", F.coalesce("duplicates", F.lit(0)))


def duplicates_by(frames: DataFrame, by: str) -> DataFrame:
    once = frames.filter(is_light() & F.col("date_obs").isNotNull()).groupBy(by, "date_obs", "bytes").agg(F.count("*").alias("files")).filter("files > 1")
    return once.groupBy(by).agg(F.count("*").alias("duplicates"))


def with_grades(frames: DataFrame, subgrades: DataFrame) -> DataFrame:
    """Each light sub with its `reject` (null where it wasn't graded)."""
    grades = subgrades.groupBy("frame_id").agg(F.max("reject").alias("reject"), F.max("fwhm").alias("fwhm"))
    return frames.filter(is_light()).join(grades, "frame_id", "left")


def nights(frames: DataFrame, subgrades: DataFrame) -> DataFrame:
    """Per night as written: subs, captured and usable milliseconds, rejects, and how bad the night was."""
    ms = milliseconds("exposure_s")
    rejected = F.coalesce("reject", F.lit(False))
    per = with_grades(frames, subgrades).groupBy(F.coalesce("night", F.lit(NO_NIGHT)).alias("night")).agg(
        F.count("*").alias("subs"), F.sum(ms).alias("captured_ms"), F.coalesce(F.sum(F.when(~rejected, ms)), F.lit(0)).alias("usable_ms"), F.count_if(rejected).alias("rejects"),
    )
    share = F.col("rejects") / F.col("subs")
    return per.withColumn("status", F.when(share < 0.05, "ok").when(share < 0.2, "warn").otherwise("bad"))


def acquisition(frames: DataFrame, subgrades: DataFrame) -> DataFrame:
    """Per night, filter and sub length the kept subs: number, first binning and gain in capture order, mean FWHM in arc seconds."""
    kept = with_grades(frames, subgrades).filter(~F.coalesce("reject", F.lit(False)))
    first = F.struct(F.col("date_obs").isNotNull(), "date_obs", "frame_id")
    arcsec = F.col("fwhm").cast("double") * F.col("pixel_scale")
    return kept.groupBy(F.coalesce("night", F.lit(NO_NIGHT)).alias("night"), F.coalesce("filter_name", F.lit("")).alias("filter_name"), milliseconds("exposure_s").alias("ms")).agg(
        F.count("*").alias("number"), F.coalesce(F.min_by("binning", F.when(F.col("binning").isNotNull(), first)), F.lit(1)).alias("binning"),
        F.min_by("gain", F.when(F.col("gain").isNotNull(), first)).alias("gain"), F.round(F.avg(arcsec), 4).alias("mean_fwhm"),
    )


def upper_median(df: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """keys and `name`: the value at place n/2 (from 0) of each group's sorted values, nulls aside.

    Values are counted first; a group's window runs over its distinct values.
    """
    tally = df.select(*keys, value.alias("_v")).filter(F.col("_v").isNotNull()).groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys)
    up_to = F.sum("_n").over(w.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    placed = tally.withColumns({"_upto": up_to, "_all": F.sum("_n").over(w)})
    return placed.filter(F.col("_upto") > F.floor(F.col("_all") / 2)).groupBy(*keys).agg(F.min("_v").alias(name))


MEASURES = ("hfr", "stars", "background", "eccentricity")


def parse_rules(text: str) -> dict[str, float | bool]:
    """hfr_max, stars_min, background_max, eccentricity_max and trails of `hfr>3.5, stars<50, bg>900, ecc>0.6, trails`; anything else is an error."""
    names = {("hfr", ">"): "hfr_max", ("stars", "<"): "stars_min", ("bg", ">"): "background_max", ("background", ">"): "background_max", ("ecc", ">"): "eccentricity_max", ("eccentricity", ">"): "eccentricity_max"}
    out: dict[str, float | bool] = {}
    for part in filter(None, (p.strip() for p in text.split(","))):
        if part in ("trails", "satellite"):
            out["trails"] = True
            continue
        sign = next((s for s in "<>" if s in part), None)
        if sign is None:
            raise ValueError(f"{part!r}: expected a rule such as hfr>3.5 or stars<50")
        key, value = (x.strip() for x in part.split(sign, 1))
        if (key, sign) not in names:
            raise ValueError(f"{part!r}: use hfr>, stars<, bg> or ecc>")
        out[names[key, sign]] = float(value)
    return out


def grading_limits(subs: DataFrame, keys: list[str], k: float = 3.0, rules: dict[str, float | bool] | None = None) -> DataFrame:
    """Per group the medians and the limits a sub is judged by: median and k robust scatters, within bounds of the median; `rules` go before them.

    The four measures go through both medians together, as rows.
    """
    pairs = F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).cast("double").alias("v")) for n in MEASURES])
    long = subs.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.measure", "p.v").filter(F.col("v").isNotNull())
    middle = upper_median(long, [*keys, "measure"], F.col("v"), "median")
    spread = upper_median(long.join(middle, [*keys, "measure"]), [*keys, "measure"], F.abs(F.col("v") - F.col("median")), "mad")
    of = lambda n, c: F.max(F.when(F.col("measure") == n, F.col(c)))
    wide = middle.join(spread, [*keys, "measure"]).groupBy(*keys).agg(*[of(n, c).alias(f"{c}_{n}") for n in MEASURES for c in ("median", "mad")])
    out = subs.groupBy(*keys).agg(F.count("*").alias("subs")).join(wide, keys, "left")
    m = lambda n: F.col(f"median_{n}")
    s = lambda n: 1.4826 * F.col(f"mad_{n}")
    told = {n: F.lit(float(v)) for n, v in (rules or {}).items() if n != "trails"}
    return out.select(
        *keys, "subs", m("hfr"), m("stars"), m("background"), m("eccentricity"),
        F.greatest(m("hfr") + k * s("hfr"), m("hfr") * 1.25).alias("hfr_max"), F.greatest(m("stars") - k * s("stars"), m("stars") * 0.5).alias("stars_min"),
        F.greatest(m("background") + k * s("background"), m("background") * 1.5).alias("background_max"),
        F.least(F.greatest(m("eccentricity") + k * s("eccentricity"), m("eccentricity") + 0.2), F.lit(0.95)).alias("eccentricity_max"),
    ).withColumns(told)


def judge(subs: DataFrame, limits: DataFrame, keys: list[str], reject_trails: bool = False) -> DataFrame:
    """Each sub with its reasons and badness under its group's limits; limits are few and joined on the group.

    A sub without stars and background couldn't be read: that is its reason,
    and its badness is 10. A trail (column `trail`, where there is one) is a
    reason that rejects only with `reject_trails`.
    """
    d = lambda n: F.col(n).cast("double")
    no = lambda c: F.coalesce(c, F.lit(False))
    j = subs.join(limits.select(*keys, "hfr_max", "stars_min", "background_max", "eccentricity_max"), keys)
    few, bright = no(d("stars") < F.col("stars_min")), no(d("background") > F.col("background_max"))
    soft, long = no(d("hfr") > F.col("hfr_max")), no(d("eccentricity") > F.col("eccentricity_max"))
    twilight, low = no(F.col("sun_altitude") > -18), no(F.col("altitude") < 35)
    reasons = F.concat_ws(
        ",", F.when(bright & (twilight | ~few), "dawn"), F.when(few & ~(bright & twilight), F.when(low, "low_altitude").otherwise("clouds")), F.when(long, "trailing"), F.when(soft & ~few & ~long, "soft"),
    )
    ratio = lambda a, b: F.coalesce(F.when(b > 0, a / b), F.lit(0.0))
    worst = F.greatest(ratio(d("hfr"), F.col("hfr_max")), ratio(F.col("stars_min"), d("stars") + 0.5), ratio(d("background"), F.col("background_max")), ratio(d("eccentricity"), F.col("eccentricity_max")), F.lit(0.0))
    unread = F.col("stars").isNull() & F.col("background").isNull()
    trail = no(F.col("trail")) if "trail" in subs.columns else F.lit(False)
    told = F.when(unread, "unreadable").otherwise(F.concat_ws(",", F.nullif(reasons, F.lit("")), F.when(trail, "satellite")))
    reject = unread | (reasons != "") | (trail & F.lit(reject_trails))
    return j.select("frame_id", *keys, told.alias("reasons"), F.when(unread, 10.0).otherwise(F.round(worst, 6)).alias("badness"), reject.alias("reject"))


def grading_totals(graded: DataFrame, subs: DataFrame) -> DataFrame:
    """One row: kept and rejected subs, those with a trail, captured and usable milliseconds, and the median HFR."""
    own = subs.select("frame_id", milliseconds("exposure_s").alias("_ms"), F.col("hfr").cast("double").alias("_hfr"))
    g = graded.select("frame_id", "reject", "reasons").join(own, "frame_id")
    middle = upper_median(g.withColumn("_all", F.lit(0)), ["_all"], F.col("_hfr"), "median_hfr").first()
    return g.agg(
        F.count_if(~F.col("reject")).alias("kept"), F.count_if("reject").alias("rejected"), F.count_if(F.col("reasons").contains("satellite")).alias("trails"), F.coalesce(F.sum("_ms"), F.lit(0)).alias("captured_ms"),
        F.coalesce(F.sum(F.when(~F.col("reject"), F.col("_ms"))), F.lit(0)).alias("usable_ms"), F.lit(middle["median_hfr"] if middle else None).cast("double").alias("median_hfr"),
    )

def worst(graded: DataFrame, k: int = 20) -> DataFrame:
    """The k worst subs; ties by file."""
    return graded.orderBy(F.desc("badness"), "frame_id").limit(k)


def in_capture_order(frames: DataFrame, folder: Column) -> DataFrame:
    """Each file with its place in its folder, by written time (nulls first), path and number.

    Places come from a sort over all partitions, so a folder may hold any
    number of files.
    """
    at = F.struct(F.col("date_obs").isNotNull().alias("dated"), F.coalesce("date_obs", F.lit("")).alias("at"), "path", "frame_id")
    return order.numbered(frames.select(folder.alias("folder"), "frame_id", at.alias("_at")), ["folder"], ["_at"], "place").select("folder", "frame_id", "place")


def calibration_sets(frames: DataFrame) -> DataFrame:
    """Single calibration frames in sets by ten properties; a set's temperature is its upper median."""
    cal = frames.filter(F.col("frame").isin("dark", "flat", "bias", "dark_flat") & ~F.col("integrated"))
    missing = -(2**62)
    r = lambda c, k: F.coalesce(F.round(F.col(c) * k).cast("bigint"), F.lit(missing))
    keyed_cal = cal.select(
        "frame_id", "frame", F.coalesce("camera", F.lit("")).alias("camera"), r("gain", 1).alias("gain"), r("offset_adu", 1).alias("offset_adu"), r("exposure_s", 1000).alias("ms"),
        F.when(F.col("frame") == "dark", r("sensor_temp_c", 1)).otherwise(0).alias("bucket_c"), F.coalesce("binning", F.lit(1)).alias("binning"), F.coalesce("filter_name", F.lit("")).alias("filter_name"),
        F.coalesce(F.array_join("size", "x"), F.lit("")).alias("size"), F.when(F.col("frame") == "flat", F.coalesce("night", F.lit(""))).otherwise("").alias("night"), "sensor_temp_c",
    )
    keys = ["frame", "camera", "gain", "offset_adu", "ms", "bucket_c", "binning", "filter_name", "size", "night"]
    sets = keyed_cal.groupBy(*keys).agg(F.count("*").alias("frames"), F.min("frame_id").alias("first_frame"))
    return sets.join(upper_median(keyed_cal, keys, F.col("sensor_temp_c"), "temp_c"), keys, "left")


def light_groups(frames: DataFrame) -> DataFrame:
    """Light subs grouped by what their calibration must fit."""
    missing = -(2**62)
    subs = frames.filter(is_light()).select(
        F.coalesce("camera", F.lit("")).alias("camera"), F.coalesce(F.round("gain").cast("bigint"), F.lit(missing)).alias("gain"), F.coalesce(F.round("offset_adu").cast("bigint"), F.lit(missing)).alias("offset_adu"),
        F.coalesce(milliseconds("exposure_s"), F.lit(missing)).alias("ms"), F.coalesce("binning", F.lit(1)).alias("binning"), F.coalesce(F.array_join("size", "x"), F.lit("")).alias("size"), "sensor_temp_c", "set_temp_c",
    )
    keys = ["camera", "gain", "offset_adu", "ms", "binning", "size"]
    out = subs.groupBy(*keys).agg(F.count("*").alias("subs"), F.max(F.col("set_temp_c").isNotNull()).alias("cooled"))
    return out.join(upper_median(subs, keys, F.col("sensor_temp_c"), "temp_c"), keys, "left")


def match_darks(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """The best dark set of each light group that has one of its camera, size and binning.

    Score: distance in temperature, 1000 for each hard difference, 10 for each
    soft one, a half for not being a master; the first set wins ties. An
    equi-join on camera, size and binning keeps candidates few; sets that
    differ there are no candidates.
    """
    darks = sets.filter(F.col("frame") == "dark").select("camera", "size", "binning", F.col("gain").alias("d_gain"), F.col("offset_adu").alias("d_offset"), F.col("ms").alias("d_ms"), F.col("temp_c").alias("d_temp"), "first_frame")
    missing = F.lit(-(2**62))
    differs = lambda a, b: (F.col(a) != missing) & (F.col(b) != missing) & (F.col(a) != F.col(b))
    apart = F.abs(F.col("temp_c") - F.col("d_temp"))
    ok, most = F.when(F.col("cooled"), 2.0).otherwise(3.0), F.when(F.col("cooled"), 5.0).otherwise(6.0)
    hard = differs("gain", "d_gain").cast("int") + differs("offset_adu", "d_offset").cast("int") + differs("ms", "d_ms").cast("int") + F.coalesce((apart > most).cast("int"), F.lit(0))
    soft = F.coalesce(((apart > ok) & (apart <= most)).cast("int"), F.lit(0))
    scored = groups.join(darks, ["camera", "size", "binning"]).withColumns({"score": F.round(F.coalesce(apart, F.lit(0.0)) + 1000 * hard + 10 * soft + 0.5, 4), "status": F.when(hard > 0, "bad").when(soft > 0, "warn").otherwise("ok")})
    keys = ["camera", "gain", "offset_adu", "ms", "binning", "size"]
    return scored.groupBy(*keys, "subs").agg(F.min_by(F.struct("first_frame", "score", "status"), F.struct("score", "first_frame")).alias("x")).select(*keys, "subs", F.col("x.first_frame").alias("dark_frame"), "x.score", "x.status")


def match_flats(sets: DataFrame, nights: DataFrame) -> DataFrame:
    """The best flat set of each light group and filter: those of its camera, size, binning and filter.

    nights: keys of the groups with filter_name and the nights of their lights
    (one row each). Score: 10 for each soft difference (gain, offset, a night
    that is no light night), a half for not being a master; the first set wins
    ties. A group without nights isn't held against any.
    """
    keys = ["camera", "gain", "offset_adu", "ms", "binning", "size", "filter_name"]
    flats = sets.filter(F.col("frame") == "flat").select("camera", "size", "binning", F.lower("filter_name").alias("f"), F.col("gain").alias("d_gain"), F.col("offset_adu").alias("d_offset"), F.col("night").alias("d_night"), "first_frame")
    missing = F.lit(-(2**62))
    differs = lambda a, b: ((F.col(a) != missing) & (F.col(b) != missing) & (F.col(a) != F.col(b))).cast("int")
    wanted = nights.groupBy(*keys).agg(F.count("night").alias("n_nights"), F.count_if(F.lit(True)).alias("subs")).withColumn("f", F.lower("filter_name"))
    pairs = wanted.join(flats, ["camera", "size", "binning", "f"])
    shared = nights.filter(F.col("night").isNotNull()).select(*keys, F.col("night").alias("d_night")).distinct().withColumn("on_night", F.lit(True))
    met = pairs.join(shared, [*keys, "d_night"], "left")
    other = ((F.col("d_night") != "") & (F.col("n_nights") > 0) & F.col("on_night").isNull()).cast("int")
    score = 10 * (differs("gain", "d_gain") + differs("offset_adu", "d_offset") + other) + 0.5
    scored = met.withColumn("score", score)
    return scored.groupBy(*keys, "subs").agg(F.min_by(F.struct("first_frame", "score"), F.struct("score", "first_frame")).alias("x")).select(*keys, "subs", F.col("x.first_frame").alias("flat_frame"), "x.score")


def light_nights(frames: DataFrame) -> DataFrame:
    """Each light sub's calibration keys with filter and night."""
    missing = -(2**62)
    r = lambda c: F.coalesce(c, F.lit(missing))
    return frames.filter(is_light()).select(
        F.coalesce("camera", F.lit("")).alias("camera"), r(F.round("gain").cast("bigint")).alias("gain"), r(F.round("offset_adu").cast("bigint")).alias("offset_adu"), r(milliseconds("exposure_s")).alias("ms"),
        F.coalesce("binning", F.lit(1)).alias("binning"), F.coalesce(F.array_join("size", "x"), F.lit("")).alias("size"), F.coalesce("filter_name", F.lit("")).alias("filter_name"), "night",
    )
