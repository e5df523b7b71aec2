"""Folder, header, calibration, catalogue, sky and pixel queries, each with its SQL twin.

QUERIES maps a name to (spark, folder) -> DataFrame, SQL the same name to the
statement that gives the same rows on the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.functions import astro, filename
from skyledger.operators import catalogue, classify, folder, headers, pixels
from skyledger.session import read
from skyledger.streaming import frames as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_LISTED = "e AS (SELECT DISTINCT ON (frame_id) * FROM frames)"
_SUBS = "e AS (SELECT DISTINCT ON (frame_id) * FROM frames), l AS (SELECT *, coalesce(object, '(no OBJECT)') AS obj, coalesce(filter_name, '(no filter)') AS flt, CAST(round(exposure_s * 1000) AS BIGINT) AS ms FROM e WHERE frame = 'light' AND NOT integrated)"
_GRADED = _SUBS + ", r AS (SELECT frame_id, bool_or(reject) AS reject, max(fwhm) AS fwhm FROM subgrades GROUP BY 1), g AS (SELECT l.*, coalesce(r.reject, false) AS rejected, r.fwhm FROM l LEFT JOIN r USING (frame_id))"


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _frames(spark: SparkSession, sf: str) -> DataFrame:
    return folder.listed(read(spark, sf, "frames"))


# ---- folder summary

@query(f"WITH {_LISTED} SELECT CASE WHEN integrated THEN 'stack' ELSE coalesce(frame, 'unknown') END AS kind, count(*) AS files FROM e GROUP BY 1")
def ref_frame_counts(spark, sf):
    return folder.counts(_frames(spark, sf))


@query(f"""WITH {_LISTED} SELECT count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) FILTER (frame IS NULL OR error IS NOT NULL) AS unreadable,
 count(DISTINCT night) FILTER (NOT integrated) AS nights, CAST(sum(CASE WHEN frame = 'light' AND NOT integrated THEN CAST(round(exposure_s * 1000) AS BIGINT) END) AS BIGINT) AS light_ms FROM e""")
def ref_folder_totals(spark, sf):
    return folder.totals(_frames(spark, sf))


@query(f"""WITH {_SUBS} SELECT obj AS object, flt AS filter_name, count(*) AS subs, CAST(sum(ms) AS BIGINT) AS total_ms, coalesce(array_to_string(list_sort(list(DISTINCT ms) FILTER (ms IS NOT NULL)), ','), '') AS lengths_ms,
 count(DISTINCT night) AS nights, count(DISTINCT ms) > 1 AS mixed FROM l GROUP BY 1, 2""")
def ref_target_filter(spark, sf):
    return folder.targets(_frames(spark, sf))


@query(f"""WITH {_SUBS}, t AS (SELECT obj, flt, CAST(CAST(round(gain * 100) AS BIGINT) AS VARCHAR) AS value, count(*) AS subs FROM l WHERE gain IS NOT NULL GROUP BY ALL)
SELECT obj AS object, flt AS filter_name, value, subs FROM (SELECT *, row_number() OVER (PARTITION BY obj, flt ORDER BY subs DESC, value DESC) AS r FROM t) WHERE r > 1""")
def ref_gain_minorities(spark, sf):
    return folder.minorities(_frames(spark, sf), F.round(F.col("gain") * 100).cast("bigint"))


@query(f"WITH {_SUBS} SELECT date_obs, bytes, count(*) AS files FROM l WHERE date_obs IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def ref_duplicates(spark, sf):
    return folder.duplicates(_frames(spark, sf))


@query(f"""WITH {_LISTED}, d AS (SELECT rig, count(*) AS duplicates FROM (SELECT rig, date_obs, bytes FROM e WHERE frame = 'light' AND NOT integrated AND date_obs IS NOT NULL GROUP BY ALL HAVING count(*) > 1) GROUP BY 1),
c AS (SELECT rig, count(*) FILTER (l) AS subs, count(DISTINCT CAST(round(exposure_s * 1000) AS BIGINT)) FILTER (l) AS lengths, count(DISTINCT filter_name) FILTER (l) AS filters, count(*) FILTER (l AND filter_name IS NULL) AS no_filter,
 count(DISTINCT CAST(round(gain * 100) AS BIGINT)) FILTER (l) AS gains, max(sensor_temp_c) FILTER (l) - min(sensor_temp_c) FILTER (l) > 4 AS wide_temp, count(*) FILTER (error IS NOT NULL OR frame IS NULL) AS damaged,
 count(*) FILTER (l AND (focal_mm IS NULL OR focal_mm <= 0)) AS no_focal FROM (SELECT *, frame = 'light' AND NOT integrated AS l FROM e) GROUP BY 1)
SELECT c.*, coalesce(d.duplicates, 0) AS duplicates FROM c LEFT JOIN d USING (rig)""")
def ref_checks(spark, sf):
    return folder.checks(_frames(spark, sf))


@query(f"""WITH {_GRADED}, n AS (SELECT coalesce(night, '(unknown)') AS night, count(*) AS subs, CAST(sum(ms) AS BIGINT) AS captured_ms, CAST(coalesce(sum(ms) FILTER (NOT rejected), 0) AS BIGINT) AS usable_ms, count(*) FILTER (rejected) AS rejects FROM g GROUP BY 1)
SELECT *, CASE WHEN rejects / subs < 0.05 THEN 'ok' WHEN rejects / subs < 0.2 THEN 'warn' ELSE 'bad' END AS status FROM n""")
def ref_nights(spark, sf):
    return folder.nights(_frames(spark, sf), read(spark, sf, "subgrades"))


@query(f"""WITH {_GRADED}, k AS (SELECT *, row(date_obs IS NOT NULL, coalesce(date_obs, ''), frame_id) AS o FROM g WHERE NOT rejected)
SELECT coalesce(night, '(unknown)') AS night, coalesce(filter_name, '') AS filter_name, ms, count(*) AS number, coalesce(arg_min(binning, o) FILTER (binning IS NOT NULL), 1) AS binning,
 arg_min(gain, o) FILTER (gain IS NOT NULL) AS gain, round(avg(CAST(fwhm AS DOUBLE) * pixel_scale), 4) AS mean_fwhm FROM k GROUP BY ALL""")
def ref_acquisition(spark, sf):
    return folder.acquisition(_frames(spark, sf), read(spark, sf, "subgrades"))


@query(f"WITH {_GRADED} SELECT frame_id, rig, path FROM g WHERE NOT rejected")
def ref_kept_subs(spark, sf):
    rejected = read(spark, sf, "subgrades").filter("reject").select("frame_id").distinct()
    return _frames(spark, sf).filter(folder.is_light()).join(rejected, "frame_id", "left_anti").select("frame_id", "rig", "path")


# ---- grading

_KEYS = ["object", "filter_name", "ms"]


def _subs(spark, sf):
    frames = folder.keyed(read(spark, sf, "frames")).groupBy("frame_id").agg(F.min("object").alias("object"), F.min("filter_name").alias("filter_name"))
    subs = read(spark, sf, "subgrades").dropDuplicates(["frame_id"]).withColumn("ms", folder.milliseconds("exposure_s"))
    return subs.join(frames, "frame_id")


def _median(x: str, order: str = "") -> str:
    return f"list_sort(list({x}) FILTER ({x} IS NOT NULL))[CAST(floor(count({x}) / 2) AS BIGINT) + 1]"


_NAMES = ("hfr", "stars", "background", "eccentricity")
_LIMITS = f"""f AS (SELECT frame_id, min(coalesce(object, '(no OBJECT)')) AS object, min(coalesce(filter_name, '(no filter)')) AS filter_name FROM frames GROUP BY 1),
s AS (SELECT DISTINCT ON (frame_id) frame_id, CAST(hfr AS DOUBLE) AS hfr, CAST(stars AS DOUBLE) AS stars, CAST(background AS DOUBLE) AS background, CAST(eccentricity AS DOUBLE) AS eccentricity, sun_altitude, altitude, CAST(round(exposure_s * 1000) AS BIGINT) AS ms FROM subgrades),
j AS (SELECT s.*, f.object, f.filter_name FROM s JOIN f USING (frame_id)),
m AS (SELECT object, filter_name, ms, count(*) AS subs, {', '.join(f'{_median(n)} AS median_{n}' for n in _NAMES)} FROM j GROUP BY 1, 2, 3),
a AS (SELECT object, filter_name, ms, {', '.join(f'abs({n} - median_{n}) AS {n}' for n in _NAMES)} FROM j JOIN m USING (object, filter_name, ms)),
d AS (SELECT object, filter_name, ms, {', '.join(f'{_median(n)} AS mad_{n}' for n in _NAMES)} FROM a GROUP BY 1, 2, 3),
t AS (SELECT object, filter_name, ms, subs, median_hfr, median_stars, median_background, median_eccentricity, greatest(median_hfr + 3.0::DOUBLE * (1.4826::DOUBLE * mad_hfr), median_hfr * 1.25::DOUBLE) AS hfr_max,
 greatest(median_stars - 3.0::DOUBLE * (1.4826::DOUBLE * mad_stars), median_stars * 0.5::DOUBLE) AS stars_min, greatest(median_background + 3.0::DOUBLE * (1.4826::DOUBLE * mad_background), median_background * 1.5::DOUBLE) AS background_max,
 CASE WHEN median_eccentricity IS NULL THEN 0.95::DOUBLE ELSE least(greatest(median_eccentricity + 3.0::DOUBLE * (1.4826::DOUBLE * mad_eccentricity), median_eccentricity + 0.2::DOUBLE), 0.95::DOUBLE) END AS eccentricity_max FROM m JOIN d USING (object, filter_name, ms))"""


@query(f"WITH {_LIMITS} SELECT * FROM t")
def ref_grading_limits(spark, sf):
    return folder.grading_limits(_subs(spark, sf), _KEYS)


_JUDGED = f"""{_LIMITS}, q AS (SELECT j.*, hfr_max, stars_min, background_max, eccentricity_max, coalesce(stars < stars_min, false) AS few, coalesce(background > background_max, false) AS bright, coalesce(hfr > hfr_max, false) AS soft,
 coalesce(eccentricity > eccentricity_max, false) AS long, coalesce(sun_altitude > -18, false) AS twilight, coalesce(altitude < 35, false) AS low FROM j JOIN t USING (object, filter_name, ms)),
w AS (SELECT frame_id, object, filter_name, ms, CASE WHEN stars IS NULL AND background IS NULL THEN 'unreadable' ELSE concat_ws(',', CASE WHEN bright AND (twilight OR NOT few) THEN 'dawn' END, CASE WHEN few AND NOT (bright AND twilight) THEN CASE WHEN low THEN 'low_altitude' ELSE 'clouds' END END,
 CASE WHEN long THEN 'trailing' END, CASE WHEN soft AND NOT few AND NOT long THEN 'soft' END) END AS reasons,
 CASE WHEN stars IS NULL AND background IS NULL THEN 10 ELSE round(greatest(coalesce(CASE WHEN hfr_max > 0 THEN hfr / hfr_max END, 0), coalesce(CASE WHEN stars + 0.5 > 0 THEN stars_min / (stars + 0.5) END, 0), coalesce(CASE WHEN background_max > 0 THEN background / background_max END, 0),
 coalesce(CASE WHEN eccentricity_max > 0 THEN eccentricity / eccentricity_max END, 0), 0), 6) END AS badness FROM q)"""


@query(f"WITH {_JUDGED} SELECT *, reasons <> '' AS reject FROM w")
def ref_graded_subs(spark, sf):
    subs = _subs(spark, sf)
    return folder.judge(subs, folder.grading_limits(subs, _KEYS), _KEYS)


@query(f"WITH {_JUDGED} SELECT *, reasons <> '' AS reject FROM w ORDER BY badness DESC, frame_id LIMIT 20")
def ref_worst_subs(spark, sf):
    return folder.worst(ref_graded_subs(spark, sf))


@query("SELECT rig, count(*) FILTER (NOT reject) AS kept, count(*) FILTER (reject) AS rejected, CAST(sum(ms) AS BIGINT) AS captured_ms, CAST(coalesce(sum(ms) FILTER (NOT reject), 0) AS BIGINT) AS usable_ms FROM (SELECT DISTINCT ON (frame_id) *, CAST(round(exposure_s * 1000) AS BIGINT) AS ms FROM subgrades) GROUP BY 1")
def ref_grading_totals(spark, sf):
    subs = read(spark, sf, "subgrades").dropDuplicates(["frame_id"]).withColumn("ms", folder.milliseconds("exposure_s"))
    return subs.groupBy("rig").agg(F.count_if(~F.col("reject")).alias("kept"), F.count_if("reject").alias("rejected"), F.sum("ms").alias("captured_ms"), F.coalesce(F.sum(F.when(~F.col("reject"), F.col("ms"))), F.lit(0)).alias("usable_ms"))


@query("""WITH s AS (SELECT DISTINCT * FROM subgrades), k AS (SELECT group_id, count(*) AS graded, count(*) FILTER (reject) AS rejects FROM s GROUP BY 1)
SELECT t.group_id, t.rig, t.subs, k.graded, k.rejects FROM (SELECT DISTINCT ON (group_id) * FROM thresholds) t JOIN k USING (group_id)""")
def ref_group_rejects(spark, sf):
    graded = read(spark, sf, "subgrades").distinct().groupBy("group_id").agg(F.count("*").alias("graded"), F.count_if("reject").alias("rejects"))
    return read(spark, sf, "thresholds").dropDuplicates(["group_id"]).select("group_id", "rig", "subs").join(graded, "group_id")


# ---- order and names

@query(f"""WITH {_LISTED}, p AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS folder FROM e) SELECT folder, frame_id, row_number() OVER (PARTITION BY folder ORDER BY date_obs ASC NULLS FIRST, path, frame_id) AS place FROM p""")
def ref_capture_order(spark, sf):
    return folder.in_capture_order(_frames(spark, sf), F.regexp_replace("path", "/[^/]*$", "")).withColumn("place", F.col("place").cast("bigint"))


_STEM = r"regexp_replace(regexp_replace(name, '^.*[/\\]', ''), '(\.[A-Za-z]{1,4})+$', '')"


@query(rf"""WITH {_LISTED}, s AS (SELECT frame_id, {_STEM} AS st FROM e), x AS (SELECT *, regexp_extract(st, '(?i)(?:^|[_ ])(?:\d+x)?([\d.]+(?:ms|s))\d*(?:$|[_ ])', 1) AS t FROM s)
SELECT frame_id, nullif(regexp_extract(lower(st), '^({'|'.join(filename.PREFIXES)})[_ -]', 1), '') AS prefix,
 CASE WHEN lower(t) LIKE '%ms' THEN TRY_CAST(regexp_extract(t, '([\d.]+)', 1) AS DOUBLE) / 1000 ELSE TRY_CAST(regexp_extract(t, '([\d.]+)', 1) AS DOUBLE) END AS exposure_s,
 TRY_CAST(nullif(regexp_extract(st, '(?i)(?:^|[_ ])bin(\d+)(?:$|[_ ])', 1), '') AS BIGINT) AS binning FROM x""")
def ref_filename_facts(spark, sf):
    n = F.col("name")
    return _frames(spark, sf).select("frame_id", filename.prefix(n).alias("prefix"), filename.exposure(n).alias("exposure_s"), filename.binning(n).alias("binning"))


@query(rf"""WITH {_SUBS}, n AS (SELECT frame_id, regexp_replace(obj, '[/\\:*?"<>|]', '_', 'g') || '/' || regexp_replace(coalesce(flt, 'unknown'), '[/\\:*?"<>|]', '_', 'g') AS folder, name FROM l),
k AS (SELECT *, row_number() OVER (PARTITION BY folder, name ORDER BY frame_id) AS r FROM n)
SELECT frame_id, folder, CASE WHEN r = 1 THEN name ELSE regexp_replace(name, '(\.[A-Za-z]+)$', '') || '_' || r || coalesce(regexp_extract(name, '(\.[A-Za-z]+)$', 1), '') END AS new_name FROM k""")
def ref_organise_plan(spark, sf):
    """Where each light sub would go, by object and filter; names that clash within a folder get a number."""
    from pyspark.sql import Window

    subs = folder.keyed(_frames(spark, sf).filter(folder.is_light()))
    placed = subs.select("frame_id", F.concat_ws("/", filename.safe(F.col("object")), filename.safe(F.col("filter_name"))).alias("folder"), "name")
    r = F.row_number().over(Window.partitionBy("folder", "name").orderBy("frame_id"))
    named = placed.withColumn("r", r)
    ext = F.regexp_extract("name", r"(\.[A-Za-z]+)$", 1)
    return named.select("frame_id", "folder", F.when(F.col("r") == 1, F.col("name")).otherwise(F.concat(F.regexp_replace("name", r"(\.[A-Za-z]+)$", ""), F.lit("_"), F.col("r"), ext)).alias("new_name"))


@query(rf"""WITH {_LISTED} SELECT kind, count(*) AS files FROM (SELECT unnest([CASE WHEN frame = 'light' AND NOT integrated THEN 'lights' END, CASE WHEN integrated THEN 'stacks' END,
 CASE WHEN frame IN ('dark', 'flat', 'bias', 'dark_flat') THEN 'calibration' END]) AS kind FROM e) WHERE kind IS NOT NULL GROUP BY 1""")
def ref_rail_filters(spark, sf):
    kinds = F.array_compact(F.array(F.when(folder.is_light(), "lights"), F.when(F.col("integrated"), "stacks"), F.when(F.col("frame").isin("dark", "flat", "bias", "dark_flat"), "calibration")))
    return _frames(spark, sf).select(F.explode(kinds).alias("kind")).groupBy("kind").agg(F.count("*").alias("files"))


# ---- calibration

_MISSING = "-4611686018427387904"
_R = lambda c, k=1: f"coalesce(CAST(round({c} * {k}) AS BIGINT), {_MISSING})"
_SETS = f"""{_LISTED}, c AS (SELECT frame_id, frame, coalesce(camera, '') AS camera, {_R('gain')} AS gain, {_R('offset_adu')} AS offset_adu, {_R('exposure_s', 1000)} AS ms, CASE WHEN frame = 'dark' THEN {_R('sensor_temp_c')} ELSE 0 END AS bucket_c,
 coalesce(binning, 1) AS binning, coalesce(filter_name, '') AS filter_name, coalesce(array_to_string(size, 'x'), '') AS size, CASE WHEN frame = 'flat' THEN coalesce(night, '') ELSE '' END AS night, sensor_temp_c
 FROM e WHERE frame IN ('dark', 'flat', 'bias', 'dark_flat') AND NOT integrated),
sets AS (SELECT frame, camera, gain, offset_adu, ms, bucket_c, binning, filter_name, size, night, count(*) AS frames, min(frame_id) AS first_frame, {_median('sensor_temp_c')} AS temp_c FROM c GROUP BY ALL)"""
_GROUPS = f"""lg AS (SELECT coalesce(camera, '') AS camera, {_R('gain')} AS gain, {_R('offset_adu')} AS offset_adu, {_R('exposure_s', 1000)} AS ms, coalesce(binning, 1) AS binning, coalesce(array_to_string(size, 'x'), '') AS size, sensor_temp_c, set_temp_c
 FROM e WHERE frame = 'light' AND NOT integrated),
grp AS (SELECT camera, gain, offset_adu, ms, binning, size, count(*) AS subs, bool_or(set_temp_c IS NOT NULL) AS cooled, {_median('sensor_temp_c')} AS temp_c FROM lg GROUP BY ALL)"""


@query(f"WITH {_SETS} SELECT * FROM sets")
def ref_calibration_sets(spark, sf):
    return folder.calibration_sets(_frames(spark, sf))


@query(f"WITH {_LISTED}, {_GROUPS} SELECT * FROM grp")
def ref_light_groups(spark, sf):
    return folder.light_groups(_frames(spark, sf))


@query(f"""WITH {_SETS}, {_GROUPS}, p AS (SELECT g.*, s.first_frame, s.gain AS dg, s.offset_adu AS d_o, s.ms AS dm, abs(g.temp_c - s.temp_c) AS apart FROM grp g JOIN sets s ON s.frame = 'dark' AND g.camera = s.camera AND g.size = s.size AND g.binning = s.binning),
h AS (SELECT *, CAST(gain <> {_MISSING} AND dg <> {_MISSING} AND gain <> dg AS INT) + CAST(offset_adu <> {_MISSING} AND d_o <> {_MISSING} AND offset_adu <> d_o AS INT) + CAST(ms <> {_MISSING} AND dm <> {_MISSING} AND ms <> dm AS INT)
 + coalesce(CAST(apart > CASE WHEN cooled THEN 5 ELSE 6 END AS INT), 0) AS hard, coalesce(CAST(apart > CASE WHEN cooled THEN 2 ELSE 3 END AND apart <= CASE WHEN cooled THEN 5 ELSE 6 END AS INT), 0) AS soft FROM p),
z AS (SELECT *, round(coalesce(apart, 0) + 1000 * hard + 10 * soft + 0.5::DOUBLE, 4) AS score, CASE WHEN hard > 0 THEN 'bad' WHEN soft > 0 THEN 'warn' ELSE 'ok' END AS status FROM h)
SELECT camera, gain, offset_adu, ms, binning, size, subs, first_frame AS dark_frame, score, status FROM (SELECT *, row_number() OVER (PARTITION BY camera, gain, offset_adu, ms, binning, size ORDER BY score, first_frame) AS r FROM z) WHERE r = 1""")
def ref_match_darks(spark, sf):
    frames = _frames(spark, sf)
    return folder.match_darks(folder.light_groups(frames), folder.calibration_sets(frames))


# ---- headers

_CARDS = "h AS (SELECT DISTINCT ON (frame_id, hdu) * FROM hdus WHERE hdu = 0), x AS (SELECT frame_id, rig, batch_no, generate_subscripts(cards, 1) - 1 AS record, unnest(cards) AS c FROM h), k AS (SELECT frame_id, rig, batch_no, record, c.keyword AS keyword, c.value_type AS value_type, c.value_text AS value_text FROM x)"
_SQL_LAYOUT = "regexp_full_match(keyword, 'SIMPLE|XTENSION|BITPIX|Z?NAXIS[0-9]*|EXTEND|[PG]COUNT|BZERO|BSCALE|CHECKSUM|DATASUM|END|COMMENT|HISTORY||ZIMAGE|ZBITPIX|ZCMPTYPE|TFIELDS|(ZTILE|ZNAME|ZVAL|TTYPE|TFORM)[0-9]+') AND keyword <> 'ZNAXIS'"


@query(f"""WITH {_CARDS}, f AS (SELECT rig, keyword, frame_id, arg_min(row(value_type, value_text), record) AS v FROM k WHERE value_type <> 'commentary' AND NOT ({_SQL_LAYOUT}) GROUP BY ALL),
g AS (SELECT rig, keyword, CASE WHEN v[1] = 'undefined' THEN '' ELSE coalesce(v[2], '') END AS text, v[1] IN ('integer', 'float') AS numeric FROM f), t AS (SELECT rig, keyword, text, count(*) AS n, bool_or(numeric) AS numeric FROM g GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY rig, keyword ORDER BY n DESC, text) - 1 AS rk FROM t),
s AS (SELECT rig, keyword, CAST(sum(n) AS BIGINT) AS present, count(*) AS distinct_n, bool_and(numeric) AS numeric, string_agg(text || ' x ' || n, '; ' ORDER BY rk) FILTER (rk < 8) AS "values", min(TRY_CAST(replace(replace(text, 'D', 'E'), 'd', 'E') AS DOUBLE)) FILTER (numeric) AS lo, max(TRY_CAST(replace(replace(text, 'D', 'E'), 'd', 'E') AS DOUBLE)) FILTER (numeric) AS hi FROM r GROUP BY 1, 2)
SELECT rig, keyword, present, distinct_n, CASE WHEN distinct_n = 1 THEN 'same' WHEN distinct_n * 10 >= present * 9 AND present > 3 THEN 'unique' WHEN numeric AND distinct_n > 6 THEN 'range' ELSE 'mixed' END AS spread, "values", CASE WHEN numeric THEN lo END AS least, CASE WHEN numeric THEN hi END AS greatest FROM s""")
def ref_keyword_spread(spark, sf):
    return headers.spread(headers.exploded(read(spark, sf, "hdus")), ["rig"])


@query("SELECT rig, batch_no, keyword, max(present) AS present, max(files) AS files, CAST(sum(n_files) AS BIGINT) AS shown, count(*) AS n_values FROM (SELECT DISTINCT * FROM keyspread) WHERE spread <> 'same' OR present < files GROUP BY ALL")
def ref_spread_differing(spark, sf):
    k = read(spark, sf, "keyspread").distinct().filter((F.col("spread") != "same") | (F.col("present") < F.col("files")))
    return k.groupBy("rig", "batch_no", "keyword").agg(F.max("present").alias("present"), F.max("files").alias("files"), F.sum("n_files").alias("shown"), F.count("*").alias("n_values"))


@query(f"""WITH {_CARDS}, fst AS (SELECT rig, batch_no, min(frame_id) AS b FROM h GROUP BY 1, 2), p AS (SELECT b, lag(b) OVER (PARTITION BY rig ORDER BY batch_no) AS a FROM fst),
l AS (SELECT frame_id, keyword, arg_max(row(value_type, value_text), record) AS v FROM k WHERE value_type <> 'commentary' GROUP BY 1, 2),
pa AS (SELECT a, b, keyword, v[1] AS ta, trim(v[2]) AS va FROM p JOIN l ON l.frame_id = p.a), pb AS (SELECT a, b, keyword, v[1] AS tb, trim(v[2]) AS vb FROM p JOIN l ON l.frame_id = p.b WHERE a IS NOT NULL),
z AS (SELECT coalesce(pa.a, pb.a) AS a, coalesce(pa.b, pb.b) AS b, coalesce(pa.keyword, pb.keyword) AS keyword, va AS value_a, vb AS value_b,
 CASE WHEN pb.b IS NULL THEN 'only_a' WHEN pa.b IS NULL THEN 'only_b' WHEN ta IN ('integer', 'float') AND tb IN ('integer', 'float') THEN
  CASE WHEN TRY_CAST(replace(replace(va, 'D', 'E'), 'd', 'E') AS DOUBLE) = TRY_CAST(replace(replace(vb, 'D', 'E'), 'd', 'E') AS DOUBLE) THEN 'same' ELSE 'changed' END
  WHEN va IS NOT DISTINCT FROM vb THEN 'same' ELSE 'changed' END AS status FROM pa FULL JOIN pb ON pa.a = pb.a AND pa.b = pb.b AND pa.keyword = pb.keyword)
SELECT a, b, keyword, status, value_a, value_b FROM z WHERE status <> 'same'""")
def ref_header_diff(spark, sf):
    """The first file of each of a rig's batches against the first of the batch before."""
    from pyspark.sql import Window

    hdus = read(spark, sf, "hdus")
    first = hdus.filter("hdu = 0").groupBy("rig", "batch_no").agg(F.min("frame_id").alias("b"))
    pairs = first.withColumn("a", F.lag("b").over(Window.partitionBy("rig").orderBy("batch_no"))).filter("a IS NOT NULL").select("a", "b")
    return headers.differences(headers.exploded(hdus), pairs)


@query("""WITH h AS (SELECT DISTINCT ON (frame_id, hdu) * FROM hdus), x AS (SELECT frame_id, hdu, generate_subscripts(cards, 1) - 1 AS record, unnest(cards) AS c FROM h), k AS (SELECT frame_id, hdu, record, c.keyword AS keyword, c.value_type AS value_type, c.value_text AS value_text FROM x),
p AS (SELECT hdu, frame_id AS b, lag(frame_id) OVER (PARTITION BY rig, hdu ORDER BY frame_id) AS a FROM h), l AS (SELECT frame_id, hdu, keyword, arg_max(row(value_type, value_text), record) AS v FROM k WHERE value_type <> 'commentary' GROUP BY 1, 2, 3),
pa AS (SELECT p.hdu, a, b, keyword, v[1] AS ta, trim(v[2]) AS va FROM p JOIN l ON l.frame_id = p.a AND l.hdu = p.hdu), pb AS (SELECT p.hdu, a, b, keyword, v[1] AS tb, trim(v[2]) AS vb FROM p JOIN l ON l.frame_id = p.b AND l.hdu = p.hdu WHERE a IS NOT NULL),
z AS (SELECT coalesce(pa.hdu, pb.hdu) AS hdu, coalesce(pa.a, pb.a) AS a, coalesce(pa.b, pb.b) AS b, coalesce(pa.keyword, pb.keyword) AS keyword, va AS value_a, vb AS value_b,
 CASE WHEN pb.b IS NULL THEN 'only_a' WHEN pa.b IS NULL THEN 'only_b' WHEN ta IN ('integer', 'float') AND tb IN ('integer', 'float') THEN
  CASE WHEN TRY_CAST(replace(replace(va, 'D', 'E'), 'd', 'E') AS DOUBLE) = TRY_CAST(replace(replace(vb, 'D', 'E'), 'd', 'E') AS DOUBLE) THEN 'same' ELSE 'changed' END
  WHEN va IS NOT DISTINCT FROM vb THEN 'same' ELSE 'changed' END AS status FROM pa FULL JOIN pb ON pa.hdu = pb.hdu AND pa.a = pb.a AND pa.b = pb.b AND pa.keyword = pb.keyword)
SELECT hdu, a, b, keyword, status, value_a, value_b FROM z WHERE status <> 'same'""")
def ref_header_changes(spark, sf):
    """Every header unit against the one before it of the same rig and hdu; ref_header_diff compares the first files of batches only."""
    hdus = read(spark, sf, "hdus")
    found = headers.differences(headers.unit_cards(hdus), headers.successive_units(hdus))
    return found.select("b.hdu", F.col("a.frame_id").alias("a"), F.col("b.frame_id").alias("b"), "keyword", "status", "value_a", "value_b")


@query("WITH c AS (SELECT DISTINCT frame_id, hdu, record, keyword, value_type, value_text FROM cards WHERE value_type <> 'commentary') SELECT frame_id, keyword, v[1] AS value_type, v[2] AS value_text FROM (SELECT frame_id, keyword, arg_min(row(value_type, value_text), row(hdu, record)) AS v FROM c GROUP BY 1, 2)")
def ref_first_values(spark, sf):
    cards = read(spark, sf, "cards").withColumn("record", F.struct("hdu", "record"))
    return headers.first_values(cards, ["frame_id"])


@query("""WITH c AS (SELECT DISTINCT frame_id, hdu, record, keyword FROM cards), d AS (SELECT *, row_number() OVER (PARTITION BY frame_id, hdu, keyword ORDER BY record) AS r, min(record) OVER (PARTITION BY frame_id, hdu, keyword) AS first_record FROM c WHERE keyword NOT IN ('HISTORY', 'COMMENT'))
SELECT frame_id, hdu, keyword, record, first_record FROM d WHERE r > 1""")
def ref_duplicate_keywords(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("frame_id", "hdu", "keyword")
    c = read(spark, sf, "cards").select("frame_id", "hdu", "record", "keyword").distinct().filter(~F.col("keyword").isin("HISTORY", "COMMENT"))
    return c.withColumns({"r": F.row_number().over(w.orderBy("record")), "first_record": F.min("record").over(w)}).filter("r > 1").drop("r")


@query("""WITH c AS (SELECT DISTINCT * FROM cards), k AS (SELECT *, value_type = 'string' AS str, CASE WHEN hierarch OR length(keyword) > 8 THEN 'HIERARCH ' || keyword || ' = ' ELSE rpad(keyword, 8, ' ') || '= ' END AS head, coalesce(value_text, '') AS t FROM c),
l AS (SELECT *, CASE WHEN value_type = 'commentary' THEN greatest(ceil(length(t) / 72), 1) WHEN str AND length(replace(t, '''', '''''')) + length(head) > 78 THEN NULL ELSE 1 END AS n FROM k)
SELECT value_type, count(*) AS cards, CAST(sum(n) AS BIGINT) AS records, count(*) FILTER (n IS NULL) AS split FROM l GROUP BY 1""")
def ref_record_round_trip(spark, sf):
    """All cards written as records: how many cards and records of each type, and how many long strings are split over CONTINUE records."""
    c = headers.round_trip(read(spark, sf, "cards").distinct())
    split = F.get("records", F.lit(1)).startswith("CONTINUE")
    split = F.coalesce(split, F.lit(False))
    return c.groupBy("value_type").agg(F.count("*").alias("cards"), F.sum(F.when(~split, F.size("records"))).alias("records"), F.count_if(split).alias("split"))


@query()
def ref_cards_round_trip(spark, sf):
    """All cards, written as records and read again; lost is what doesn't come back as it was."""
    back = headers.round_trip(read(spark, sf, "cards").distinct())
    return back.groupBy("value_type", "hierarch").agg(F.count("*").alias("cards"), F.count_if("agree").alias("agree"), F.count_if(~F.col("agree")).alias("lost"))


@query()
def ref_cards_lost(spark, sf):
    """Each card that doesn't come back from its records as it was."""
    lost = headers.round_trip(read(spark, sf, "cards").distinct()).filter(~F.col("agree"))
    return lost.select("frame_id", "hdu", "record", "keyword", "value_type", "value_text", "note", "hierarch", "records", "parsed")


_SQL_PRIVATE = """regexp_full_match(keyword, 'SITE(LAT|LONG|ELEV|NAME)|OBS(LAT|LONG|ALT|ERVER|ERVAT)|(LAT|LONG|ALT)-OBS|OBSGEO-[BLHXYZ]|LATITUDE|LONGITUD|ALTITUDE|AUTHOR|CAMERAID|SERIALN[BO]|CAMSERNO')"""


@query(f"""WITH c AS (SELECT DISTINCT frame_id, hdu, record, keyword FROM cards), p AS (SELECT frame_id, hdu, count(*) AS records, count(*) FILTER ({_SQL_PRIVATE}) AS removed,
 array_to_string(list_sort(list(DISTINCT keyword) FILTER ({_SQL_PRIVATE})), ',') AS keywords FROM c GROUP BY 1, 2)
SELECT frame_id, hdu, records, removed, keywords, records - removed + 1 AS records_after, ceil((records + 1) * 80 / 2880) = ceil((records - removed + 2) * 80 / 2880) AS in_place FROM p WHERE removed > 0""")
def ref_scrub_plan(spark, sf):
    return headers.scrub_plan(read(spark, sf, "cards").select("frame_id", "hdu", "record", "keyword").distinct())


@query("""SELECT frame_id, hdu, CAST(abs(bitpix) / 8 AS BIGINT) AS pixel_bytes, CAST(coalesce(list_product(shape), 0) AS BIGINT) AS pixels, data_bytes, CAST(ceil(data_bytes / 2880) * 2880 AS BIGINT) AS padded_bytes, header_offset + header_blocks * 2880 = data_offset AS contiguous FROM (SELECT DISTINCT ON (frame_id, hdu) * FROM hdus)""")
def ref_hdu_layout(spark, sf):
    h = read(spark, sf, "hdus").dropDuplicates(["frame_id", "hdu"])
    product = F.when(F.size("shape") > 0, F.aggregate("shape", F.lit(1).cast("bigint"), lambda a, x: a * x)).otherwise(0)
    return h.select("frame_id", "hdu", F.floor(F.abs("bitpix") / 8).alias("pixel_bytes"), product.alias("pixels"), "data_bytes", (F.ceil(F.col("data_bytes") / 2880) * 2880).alias("padded_bytes"), (F.col("header_offset") + F.col("header_blocks") * 2880 == F.col("data_offset")).alias("contiguous"))


# ---- catalogue and sky

_PLAIN = lambda c: f"regexp_replace(upper(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}+]', '', 'g')), '^(\\p{{L}}+?)0+([1-9]\\d*)$', '\\1\\2')"


@query(f"""WITH {_SUBS}, n AS (SELECT DISTINCT object FROM l WHERE object IS NOT NULL), k AS (SELECT {_PLAIN('designation')} AS plain, target_id FROM targets UNION ALL SELECT {_PLAIN('common_name')}, target_id FROM targets WHERE common_name IS NOT NULL),
m AS (SELECT plain, min(target_id) AS target_id FROM k WHERE plain <> '' GROUP BY 1) SELECT object, target_id FROM (SELECT object, {_PLAIN('object')} AS plain FROM n) LEFT JOIN m USING (plain)""")
def ref_catalogue_lookup(spark, sf):
    names = _frames(spark, sf).filter(folder.is_light() & F.col("object").isNotNull()).select("object").distinct()
    return catalogue.lookup(names, "object", read(spark, sf, "targets"), "target_id", ["designation", "common_name"]).select("object", "target_id")


@query(f"""WITH {_SUBS}, n AS (SELECT DISTINCT object FROM l WHERE object IS NOT NULL), a AS (SELECT target_id, unnest(aliases) AS alias FROM targets),
k AS (SELECT {_PLAIN('designation')} AS plain, target_id FROM targets UNION ALL SELECT {_PLAIN('common_name')}, target_id FROM targets WHERE common_name IS NOT NULL UNION ALL SELECT {_PLAIN('alias')}, target_id FROM a WHERE alias IS NOT NULL),
m AS (SELECT plain, min(target_id) AS target_id FROM k WHERE plain <> '' GROUP BY 1) SELECT object, target_id FROM (SELECT object, {_PLAIN('object')} AS plain FROM n) LEFT JOIN m USING (plain)""")
def ref_catalogue_names(spark, sf):
    """As ref_catalogue_lookup, by all names of an entry, aliases too."""
    names = _frames(spark, sf).filter(folder.is_light() & F.col("object").isNotNull()).select("object").distinct()
    return catalogue.lookup(names, "object", read(spark, sf, "targets"), "target_id", ["designation", "common_name", "aliases"]).select("object", "target_id")


@query()
def ref_catalogue_nearest(spark, sf):
    """The entry that the header's position is of, for light files whose name means none."""
    columns = ["frame_id", "hdu", "record", "keyword", "value_text"]
    units = read(spark, sf, "hdus").select("frame_id", "hdu", F.posexplode("cards").alias("record", "c")).select("frame_id", "hdu", "record", "c.keyword", "c.value_text")
    at = catalogue.header_positions(read(spark, sf, "cards").select(*columns).unionByName(units))
    lights = _frames(spark, sf).filter(folder.is_light()).select("frame_id", "object")
    named = catalogue.lookup(lights, "object", read(spark, sf, "targets"), "target_id", ["designation", "common_name", "aliases"])
    return catalogue.nearest(named.filter("target_id IS NULL").select("frame_id").join(at, "frame_id"), "frame_id", read(spark, sf, "targets"), "target_id")


_SEP = "2 * asin(least(1.0, sqrt(pow(sin(radians(b.dec_deg - a.dec_deg) / 2), 2) + cos(radians(a.dec_deg)) * cos(radians(b.dec_deg)) * pow(sin(radians(b.ra_deg - a.ra_deg) / 2), 2)))) / pi() * 180"


@query(f"""WITH d AS (SELECT a.target_id, b.target_id AS near, round({_SEP}, 6) AS degrees FROM targets a JOIN targets b ON a.target_id <> b.target_id WHERE abs(a.dec_deg - b.dec_deg) <= 5)
SELECT target_id, near, degrees FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY degrees, near) AS r FROM d WHERE degrees <= 5) WHERE r = 1""")
def ref_neighbours(spark, sf):
    return catalogue.neighbours(read(spark, sf, "targets"), "target_id", 5.0)


_JD = "(epoch_us(ts) / 86400000000.0::DOUBLE + 2440587.5::DOUBLE)"


@query(f"""WITH s AS (SELECT event_id, {_JD} AS jd, (user_id % 120 - 60)::DOUBLE AS lat, (user_id % 360 - 180)::DOUBLE AS lon FROM events), n AS (SELECT *, jd - 2451545.0::DOUBLE AS d FROM s),
g AS (SELECT *, radians(357.528::DOUBLE + 0.9856003::DOUBLE * d) AS g, radians(23.439::DOUBLE - 0.0000004::DOUBLE * d) AS tilt FROM n), e AS (SELECT *, radians(280.460::DOUBLE + 0.9856474::DOUBLE * d + 1.915::DOUBLE * sin(g) + 0.020::DOUBLE * sin(2 * g)) AS l FROM g),
p AS (SELECT *, atan2(cos(tilt) * sin(l), cos(l)) / pi() * 180 AS ra, asin(sin(tilt) * sin(l)) AS dec, 280.46061837::DOUBLE + 360.98564736629::DOUBLE * d + 0.000387933::DOUBLE * (d / 36525) * (d / 36525) - (d / 36525) * (d / 36525) * (d / 36525) / 38710000 AS st FROM e),
q AS (SELECT *, asin(sin(dec) * sin(radians(lat)) + cos(dec) * cos(radians(lat)) * cos(radians(st + lon - ra))) / pi() * 180 AS alt FROM p)
SELECT event_id, round(alt, 3) AS sun_altitude, CASE WHEN round(alt, 3) <= -18 THEN 'night' WHEN round(alt, 3) <= -12 THEN 'astronomical twilight' WHEN round(alt, 3) <= -6 THEN 'nautical twilight' WHEN round(alt, 3) <= 0 THEN 'civil twilight' ELSE 'day' END AS sky FROM q""")
def ref_sun_altitude(spark, sf):
    e = read(spark, sf, "events")
    jd = astro.julian_day(F.unix_micros(F.col("ts").cast("timestamp")))
    e = e.select("event_id", jd.alias("jd"), (F.col("user_id") % 120 - 60).cast("double").alias("lat"), (F.col("user_id") % 360 - 180).cast("double").alias("lon"))
    ra, dec = astro.sun(F.col("jd"))
    e = e.withColumns({"ra": ra, "dec": dec}).withColumn("sun_altitude", F.round(astro.altitude(F.col("ra"), F.col("dec"), F.col("lat"), F.col("lon"), F.col("jd")), 3))
    return e.select("event_id", "sun_altitude", astro.sky(F.col("sun_altitude")).alias("sky"))


@query("SELECT night, count(*) AS events, count(DISTINCT user_id) AS users FROM (SELECT user_id, CAST(DATE '1970-01-01' + CAST(floor(epoch_us(ts) / 86400000000.0::DOUBLE + (user_id % 360 - 180) / 360.0::DOUBLE - 0.5::DOUBLE) AS INT) AS VARCHAR) AS night FROM events) GROUP BY 1")
def ref_session_nights(spark, sf):
    lon = (F.col("user_id") % 360 - 180).cast("double")
    e = read(spark, sf, "events").select("user_id", astro.session_night(F.unix_micros(F.col("ts").cast("timestamp")), lon).alias("night"))
    return e.groupBy("night").agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"))


@query("""WITH s AS (SELECT DISTINCT frame_id, altitude FROM subgrades WHERE altitude IS NOT NULL) SELECT frame_id, altitude, round(CASE WHEN altitude > 0 THEN 1 / (sin(radians(altitude)) + 0.50572::DOUBLE * pow(altitude + 6.07995::DOUBLE, -1.6364::DOUBLE)) END, 4) AS airmass FROM s""")
def ref_airmass(spark, sf):
    s = read(spark, sf, "subgrades").select("frame_id", "altitude").filter("altitude IS NOT NULL").distinct()
    return s.select("frame_id", "altitude", F.round(astro.airmass(F.col("altitude")), 4).alias("airmass"))


@query("""SELECT rig, round(206.264806::DOUBLE * pixel_um / focal_mm, 3) AS scale, CASE WHEN 206.264806::DOUBLE * pixel_um / focal_mm < 0.8 THEN 'over' WHEN 206.264806::DOUBLE * pixel_um / focal_mm <= 2.0 THEN 'well' ELSE 'under' END AS sampling,
 count(*) AS files, count(*) FILTER (abs(f.pixel_scale / f.binning / (206.264806::DOUBLE * pixel_um / focal_mm) - 1) > 0.05) AS mismatched FROM (SELECT DISTINCT ON (frame_id) * EXCLUDE (focal_mm) FROM frames) f JOIN rigs USING (rig) GROUP BY rig, pixel_um, focal_mm""")
def ref_optics(spark, sf):
    rigs = read(spark, sf, "rigs").select("rig", "pixel_um", "focal_mm")
    scale = astro.pixel_scale(F.col("pixel_um"), F.col("focal_mm"))
    off = F.abs(F.col("pixel_scale") / F.col("binning") / scale - 1) > 0.05
    joined = _frames(spark, sf).drop("focal_mm").join(rigs, "rig")
    return joined.groupBy("rig", "pixel_um", "focal_mm").agg(F.count("*").alias("files"), F.count_if(off).alias("mismatched")).select("rig", F.round(scale, 3).alias("scale"), astro.sampling(scale).alias("sampling"), "files", "mismatched")


# ---- pixels

_PX = "x AS (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), s AS (SELECT label, count(*) AS n, min(v) AS lo, max(v) AS hi, avg(v) AS mean FROM x GROUP BY 1)"


@query(f"""WITH {_PX}, b AS (SELECT label, CASE WHEN hi > lo THEN least(CAST(floor((v - lo) / ((hi - lo) / 4096)) AS BIGINT), 4095) ELSE 0 END AS bin, count(*) AS c FROM x JOIN s USING (label) GROUP BY 1, 2),
u AS (SELECT *, sum(c) OVER (PARTITION BY label ORDER BY bin) AS upto FROM b) SELECT s.label, s.n, s.lo, s.hi, round(s.mean, 9) AS mean, min(bin) FILTER (upto >= ceil(0.5 * s.n)) AS median_bin, min(bin) FILTER (upto >= ceil(0.9999 * s.n)) AS top_bin FROM u JOIN s USING (label) GROUP BY ALL""")
def ref_channel_stats(spark, sf):
    px = pixels.pixels(read(spark, sf, "embeddings"), "label", "embedding")
    return pixels.channel_stats(px, "label").withColumn("mean", F.round("mean", 9))


@query(f"""WITH {_PX}, y AS (SELECT label, (v - lo) / (hi - lo) AS v FROM x JOIN s USING (label)), m AS (SELECT label, {_median('v')} AS med FROM y GROUP BY 1), d AS (SELECT label, abs(v - med) AS d FROM y JOIN m USING (label)), a AS (SELECT label, {_median('d')} AS mad FROM d GROUP BY 1),
p AS (SELECT label, med, mad, least(greatest(med - 2.8::DOUBLE * 1.4826::DOUBLE * mad, 0), 1) AS sh FROM m JOIN a USING (label))
SELECT label, round(med, 9) AS median, round(mad, 9) AS mad, round(sh, 9) AS shadows, round(CASE WHEN med - sh <= 0 THEN 0 WHEN med - sh >= 1 THEN 1 ELSE (0.25::DOUBLE - 1) * (med - sh) / ((2 * 0.25::DOUBLE - 1) * (med - sh) - 0.25::DOUBLE) END, 9) AS midtones FROM p""")
def ref_stretch(spark, sf):
    px = pixels.pixels(read(spark, sf, "embeddings"), "label", "embedding")
    span = px.groupBy("label").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    unit = px.join(span, "label").select("label", ((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("v"))
    med = folder.upper_median(unit, ["label"], F.col("v"), "median")
    mad = folder.upper_median(unit.join(med, "label"), ["label"], F.abs(F.col("v") - F.col("median")), "mad")
    shadows, midtones = pixels.stretch_parameters(F.col("median"), F.col("mad"))
    r = lambda c, n: F.round(c, 9).alias(n)
    return med.join(mad, "label").select("label", r(F.col("median"), "median"), r(F.col("mad"), "mad"), r(shadows, "shadows"), r(midtones, "midtones"))


# ---- streams

@query("""WITH e AS (SELECT ts, event_type, CAST(round(value * 1000) AS BIGINT) AS v, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01 12:00:00') AS w FROM events)
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS night_start, event_type, count(*) AS n, CAST(sum(v) AS BIGINT) AS value_milli FROM e WHERE w + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2""")
def ref_stream_nights(spark, sf):
    return stream.drain(stream.night_windows(stream.source(spark, f"{sf}/events.parquet", "ts"), "ts", ["event_type"], "value"))


@query("""WITH e AS (SELECT event_type, value, ts, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events)
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, max(value) AS greatest FROM e WHERE w + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY 1, 2""")
def ref_stream_trend(spark, sf):
    return stream.drain(stream.trend(stream.source(spark, f"{sf}/events.parquet", "ts"), "ts", ["event_type"], "value"))


@query("SELECT DISTINCT frame_id, rig, path FROM frames")
def ref_stream_listed_once(spark, sf):
    return stream.drain(stream.listed_once(stream.source(spark, f"{sf}/frames.parquet", "scanned_at"), "scanned_at", ["frame_id"]).select("frame_id", "rig", "path"))


@query("SELECT user_id, event_id AS item, first_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS scale FROM events")
def ref_stream_locked_scale(spark, sf):
    return stream.drain(stream.locked_scale(stream.source(spark, f"{sf}/events.parquet", "ts").select("user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"], "value"))


# ---- evidence and edits

_KIND = lambda t: f"CASE WHEN regexp_matches({t}, 'darkflat|flatdark') THEN 'dark_flat' WHEN regexp_matches({t}, 'bias|offset') OR {t} = 'zero' THEN 'bias' WHEN regexp_matches({t}, 'dark') THEN 'dark' WHEN regexp_matches({t}, 'flat') THEN 'flat' WHEN regexp_matches({t}, 'light|object|science') THEN 'light' END"


@query(rf"""WITH {_LISTED}, c AS (SELECT frame_id, min(value_text) AS ft FROM cards WHERE keyword IN ('IMAGETYP', 'FRAMETYP') GROUP BY 1),
s AS (SELECT e.frame_id, e.object, e.exposure_s < 0.005 AS short, regexp_replace(lower(c.ft), '[-_ ]', '', 'g') AS k, regexp_replace(nullif(regexp_extract(lower({_STEM}), '^({'|'.join(filename.PREFIXES)})[_ -]', 1), ''), '[-_ ]', '', 'g') AS n FROM e LEFT JOIN c USING (frame_id)),
v AS (SELECT *, {_KIND('k')} AS kk, {_KIND('n')} AS kn FROM s), t AS (SELECT *, kk IS NULL AND kn IS NULL AND NOT coalesce(short, false) AND object IS NOT NULL AS lone FROM v),
z AS (SELECT frame_id, unnest([60, 25, 30, 20]) AS w, unnest([1, 2, 3, 4]) AS o, unnest(['header', 'name', 'exposure', 'object']) AS why, unnest([kk, kn, CASE WHEN short THEN 'bias' END, CASE WHEN lone THEN 'light' END]) AS kind FROM t),
g AS (SELECT frame_id, kind, sum(w) AS w, min(o) AS o FROM z WHERE kind IS NOT NULL GROUP BY 1, 2), r AS (SELECT frame_id, list(kind ORDER BY w DESC, o) AS ks, list(w ORDER BY w DESC, o) AS ws FROM g GROUP BY 1),
x AS (SELECT frame_id, string_agg(why || '=' || kind, ',' ORDER BY o) AS evidence FROM z WHERE kind IS NOT NULL GROUP BY 1)
SELECT t.frame_id, coalesce(ks[1], 'unknown') AS kind, CAST(coalesce(ws[1], 0) - floor(coalesce(ws[2], 0) / 2) AS BIGINT) AS score, CASE WHEN ks IS NULL THEN 0 ELSE CAST(round(50 + 50 * tanh((ws[1] - floor(coalesce(ws[2], 0) / 2)) / 40.0::DOUBLE)) AS BIGINT) END AS confidence,
 coalesce(evidence, '') AS evidence FROM t LEFT JOIN r USING (frame_id) LEFT JOIN x USING (frame_id)""")
def ref_classify(spark, sf):
    types = read(spark, sf, "cards").filter(F.col("keyword").isin("IMAGETYP", "FRAMETYP")).groupBy("frame_id").agg(F.min("value_text").alias("frame_type"))
    return classify.classify(_frames(spark, sf).join(types, "frame_id", "left"))


@query()
def ref_verdicts(spark, sf):
    """The verdict on every listed file, by all evidence at hand."""
    columns = ["frame_id", "hdu", "record", "keyword", "value_type", "value_text"]
    units = read(spark, sf, "hdus")
    cards = units.select("frame_id", "hdu", F.posexplode("cards").alias("record", "c")).select("frame_id", "hdu", "record", "c.keyword", "c.value_type", "c.value_text")
    return classify.verdicts(_frames(spark, sf), read(spark, sf, "cards").select(*columns).unionByName(cards), units)


_OPS = [(1, "set", "OBSERVER", "archive"), (2, "set", "BINX", "1"), (3, "unset", "SITELAT", None), (4, "unset", "SITELONG", None), (5, "set", "OBSERVER", "the archive"), (6, "set", "XBINNING", "1")]
_OPS_SQL = "o(place, op, keyword, value) AS (VALUES " + ", ".join(f"({p}, '{o}', '{k}', {'NULL' if v is None else repr(v)})" for p, o, k, v in _OPS) + ")"


@query(f"""WITH {_OPS_SQL}, l AS (SELECT keyword, arg_max(row(op, value), place) AS x FROM o GROUP BY 1), c AS (SELECT DISTINCT frame_id, hdu, record, keyword, value_type, value_text FROM cards), f AS (SELECT DISTINCT frame_id FROM c),
h AS (SELECT frame_id, keyword, arg_min(value_text, row(hdu, record)) AS before, count(*) AS n FROM c WHERE value_type <> 'commentary' GROUP BY 1, 2),
m AS (SELECT f.frame_id, l.keyword, l.x[1] AS op, l.x[2] AS value, h.before, h.n FROM f CROSS JOIN l LEFT JOIN h ON h.frame_id = f.frame_id AND h.keyword = l.keyword),
k AS (SELECT *, CASE WHEN op = 'unset' AND n IS NOT NULL THEN 'remove' WHEN op = 'set' AND n IS NULL THEN 'add' WHEN op = 'set' AND before IS DISTINCT FROM value THEN 'modify' END AS kind FROM m)
SELECT frame_id, keyword, kind, before, CASE WHEN op = 'set' THEN value END AS after FROM k WHERE kind IS NOT NULL""")
def ref_edit_plan(spark, sf):
    cards = read(spark, sf, "cards").select("frame_id", "hdu", "record", "keyword", "value_type", "value_text").distinct().withColumn("record", F.struct("hdu", "record"))
    return headers.edit_plan(cards, spark.createDataFrame(_OPS, "place int, op string, keyword string, value string"))


@query(f"""WITH {_OPS_SQL}, l AS (SELECT keyword, arg_max(row(op, value), place) AS x FROM o GROUP BY 1), c AS (SELECT DISTINCT frame_id, hdu, record, keyword, value_type, value_text FROM cards), f AS (SELECT DISTINCT frame_id FROM c),
h AS (SELECT frame_id, keyword, arg_min(value_text, row(hdu, record)) AS before, count(*) AS n FROM c WHERE value_type <> 'commentary' GROUP BY 1, 2),
m AS (SELECT f.frame_id, l.keyword, l.x[1] AS op, l.x[2] AS value, h.before, h.n FROM f CROSS JOIN l LEFT JOIN h ON h.frame_id = f.frame_id AND h.keyword = l.keyword),
k AS (SELECT *, CASE WHEN op = 'unset' AND n IS NOT NULL THEN 'remove' WHEN op = 'set' AND n IS NULL THEN 'add' WHEN op = 'set' AND before IS DISTINCT FROM value THEN 'modify' END AS kind FROM m)
SELECT keyword, kind, count(*) AS files FROM k WHERE kind IS NOT NULL GROUP BY 1, 2""")
def ref_batch_totals(spark, sf):
    return ref_edit_plan(spark, sf).groupBy("keyword", "kind").agg(F.count("*").alias("files"))


@query("""WITH p AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
SELECT vec_id, CAST(floor(floor(i / 8) / 2) AS BIGINT) AS y, CAST(floor((i % 8) / 2) AS BIGINT) AS x, round(avg(v), 9) AS value FROM p GROUP BY 1, 2, 3""")
def ref_pixel_bin(spark, sf):
    """Embeddings as planes of 8 x 8, binned by two."""
    return pixels.binned(read(spark, sf, "embeddings"), "vec_id", "embedding", 8).withColumn("value", F.round("value", 9))


@query("""WITH p AS (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings) SELECT vec_id, i AS "at", CAST(embedding[CAST((7 - i % 8) * 8 + floor(i / 8) + 1 AS BIGINT)] AS DOUBLE) AS value FROM p""")
def ref_pixel_rotate(spark, sf):
    turned = pixels.rotated(read(spark, sf, "embeddings"), "vec_id", "embedding", 8, 8)
    return turned.select("vec_id", F.posexplode("embedding").alias("at", "v")).select("vec_id", F.col("at").cast("bigint").alias("at"), F.col("v").cast("double").alias("value"))


@query(f"""WITH {_SETS}, n AS (SELECT coalesce(camera, '') AS camera, {_R('gain')} AS gain, {_R('offset_adu')} AS offset_adu, {_R('exposure_s', 1000)} AS ms, coalesce(binning, 1) AS binning, coalesce(array_to_string(size, 'x'), '') AS size, coalesce(filter_name, '') AS filter_name, night
 FROM e WHERE frame = 'light' AND NOT integrated), w AS (SELECT camera, gain, offset_adu, ms, binning, size, filter_name, count(night) AS nn, count(*) AS subs, list(DISTINCT night) FILTER (night IS NOT NULL) AS ns FROM n GROUP BY ALL),
z AS (SELECT w.*, s.first_frame, CAST(10 * (CAST(w.gain <> {_MISSING} AND s.gain <> {_MISSING} AND w.gain <> s.gain AS INT) + CAST(w.offset_adu <> {_MISSING} AND s.offset_adu <> {_MISSING} AND w.offset_adu <> s.offset_adu AS INT)
 + CAST(s.night <> '' AND nn > 0 AND NOT list_contains(ns, s.night) AS INT)) + 0.5 AS DOUBLE) AS score FROM w JOIN sets s ON s.frame = 'flat' AND s.camera = w.camera AND s.size = w.size AND s.binning = w.binning AND lower(s.filter_name) = lower(w.filter_name))
SELECT camera, gain, offset_adu, ms, binning, size, filter_name, subs, first_frame AS flat_frame, score FROM (SELECT *, row_number() OVER (PARTITION BY camera, gain, offset_adu, ms, binning, size, filter_name ORDER BY score, first_frame) AS r FROM z) WHERE r = 1""")
def ref_match_flats(spark, sf):
    frames = _frames(spark, sf)
    return folder.match_flats(folder.calibration_sets(frames), folder.light_nights(frames)).withColumn("score", F.col("score").cast("double"))


@query(f"""WITH {_GRADED}, a AS (SELECT coalesce(night, '(unknown)') AS night, coalesce(filter_name, '') AS filter_name, ms, count(*) AS number FROM g WHERE NOT rejected GROUP BY ALL)
SELECT night, concat_ws(',', night, replace(filter_name, ',', ' '), CAST(number AS VARCHAR), coalesce(CAST(ms AS VARCHAR), '')) AS line FROM a""")
def ref_acquisition_csv(spark, sf):
    """The acquisition table as CSV lines; commas in names become blanks."""
    a = folder.acquisition(_frames(spark, sf), read(spark, sf, "subgrades"))
    return a.select("night", F.concat_ws(",", "night", F.replace(F.col("filter_name"), F.lit(","), F.lit(" ")), F.col("number").cast("string"), F.coalesce(F.col("ms").cast("string"), F.lit(""))).alias("line"))


@query("""WITH d AS (SELECT DISTINCT rig, round(sum(exposure_s) OVER (PARTITION BY rig)) AS s FROM (SELECT DISTINCT ON (frame_id) rig, coalesce(exposure_s, 0) AS exposure_s FROM subgrades))
SELECT rig, CASE WHEN s < 60 THEN CAST(CAST(s AS BIGINT) AS VARCHAR) || 's' WHEN s < 3600 THEN CAST(CAST(floor(s / 60) AS BIGINT) AS VARCHAR) || 'm' ELSE CAST(CAST(floor(s / 3600) AS BIGINT) AS VARCHAR) || 'h' || lpad(CAST(CAST(floor((s % 3600) / 60) AS BIGINT) AS VARCHAR), 2, '0') || 'm' END AS captured FROM d""")
def ref_captured_text(spark, sf):
    s = read(spark, sf, "subgrades").dropDuplicates(["frame_id"]).groupBy("rig").agg(F.sum(F.coalesce("exposure_s", F.lit(0.0))).alias("s"))
    return s.select("rig", filename.compact_duration(F.col("s")).alias("captured"))


@query(r"""SELECT regexp_replace(regexp_replace(keyword, '^([A-Z]+)[0-9]+_[0-9]+$', '\1i_j'), '^([A-Z]+)[0-9]+$', '\1n') AS pattern, count(*) AS cards, count(DISTINCT keyword) AS keywords FROM (SELECT DISTINCT frame_id, hdu, record, keyword FROM cards) GROUP BY 1""")
def ref_keyword_patterns(spark, sf):
    """Indexed keywords under one pattern: NAXIS2 is NAXISn, CD1_2 is CDi_j."""
    pattern = F.regexp_replace(F.regexp_replace("keyword", r"^([A-Z]+)[0-9]+_[0-9]+$", "$1i_j"), r"^([A-Z]+)[0-9]+$", "$1n")
    return read(spark, sf, "cards").select("frame_id", "hdu", "record", "keyword").distinct().groupBy(pattern.alias("pattern")).agg(F.count("*").alias("cards"), F.countDistinct("keyword").alias("keywords"))
