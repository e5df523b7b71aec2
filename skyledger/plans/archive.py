"""Queries over the archive tables: drift, wide headers, faults, sessions, times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.functions import timeparse
from skyledger.operators import drift, eav, sessions, spikes, timestamps
from skyledger.session import cut, read

#: What each measured column can be (TESTDATA.md, p3_found).
MEASURES = {
    "frames": spikes.Limits(-100.0, 100.0),
    "subgrades": spikes.Limits(0.0, 1000.0),
    "thresholds": spikes.Limits(0.0, 1000.0, low_open=True),
}


def _rules(spark: SparkSession, sf: str) -> DataFrame:
    return drift.json_files(read(spark, sf, "app_rules"), "apps", "revision", "app_id", "rule")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every change of the headers between a rig's batches and of the rules between revisions."""
    both = drift.header_files(read(spark, sf, "hdus")).unionByName(_rules(spark, sf))
    return drift.changes(both, read(spark, sf, "keydict")).select(F.col("source").alias("rig"), F.col("batch").alias("batch_no"), F.col("path").alias("keyword"), "change", F.col("new_path").alias("new_keyword"))


def _all_files(spark: SparkSession, sf: str) -> DataFrame:
    """The files of all header units and the rules; the source of unit k of a rig is `rig#k`."""
    hdus = read(spark, sf, "hdus")
    return drift.header_files(hdus).unionByName(drift.unit_files(hdus)).unionByName(_rules(spark, sf))


def p1_alternatives(spark: SparkSession, sf: str) -> DataFrame:
    """The tagged union of each batch: every keyword and JSON field of any unit with its types and the files that carry each."""
    found = drift.alternatives(_all_files(spark, sf)).filter("type <> '*'")
    return found.select(F.col("source").alias("rig"), F.col("batch").alias("batch_no"), F.col("path").alias("keyword"), "type", "files")


def p1_appearing(spark: SparkSession, sf: str) -> DataFrame:
    """Every alternative type of a keyword that appears in a batch or is gone from it, with the files that carry or carried it."""
    found = drift.appearing(_all_files(spark, sf))
    return found.select(F.col("source").alias("rig"), F.col("batch").alias("batch_no"), F.col("path").alias("keyword"), "type", "change", "files")


def p1_table(spark: SparkSession, sf: str) -> DataFrame:
    """One consistent table of all header units and of the rules of all revisions."""
    found = drift.changes(_all_files(spark, sf), read(spark, sf, "keydict"))
    return drift.unify(read(spark, sf, "hdus"), found.filter(F.col("change") == "renamed"), _rules(spark, sf))


def _cells(spark: SparkSession, sf: str, which: str = "true") -> tuple[DataFrame, list[tuple[str, str]]]:
    """The stated values of the attributes found in the cards, and the fields they are of."""
    rows = read(spark, sf, "cards")
    wanted = cut(eav.attributes(rows, read(spark, sf, "keydict"))).filter(which)
    return eav.typed(rows, wanted), eav.fields_of(wanted)


def p2_attributes(spark: SparkSession, sf: str) -> DataFrame:
    """Every attribute of the cards with its field and type, and the type its values look like."""
    return eav.attributes(read(spark, sf, "cards"), read(spark, sf, "keydict"))


def p2_wide(spark: SparkSession, sf: str) -> DataFrame:
    """One row per file with a typed column for each field of the dictionary."""
    cells, _ = _cells(spark, sf, "known")
    return eav.widen(cells, eav.fields_of(read(spark, sf, "keydict")))


def p2_wide_all(spark: SparkSession, sf: str) -> DataFrame:
    """As p2_wide, with a column of the inferred type for each attribute the dictionary doesn't know."""
    return eav.widen(*_cells(spark, sf))


def p2_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """Cells with more than one value: the keyword whose value counts, and whether one can't be read."""
    return eav.repeats(*_cells(spark, sf, "known")).withColumnRenamed("entity", "frame_id")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """The cells of the dictionary's fields that can't be filled cleanly."""
    return eav.problems(*_cells(spark, sf, "known")).withColumnRenamed("entity", "frame_id")


def p3_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Faulty readings of the three measured columns with value and reason."""
    columns = lambda table, value: read(spark, sf, table).select(F.lit(table).alias("part"), "rig", "frame_id", "date_obs", F.col(value).cast("double").alias("v"))
    timed = timestamps.read_times(columns("frames", "sensor_temp_c").unionByName(columns("subgrades", "badness")), read(spark, sf, "rigs"), unread=True)
    timed = timed.select(F.col("part").alias("measure"), F.col("rig").alias("source"), F.col("frame_id").alias("item"), F.col("micros").alias("at"), "v")
    hfr = read(spark, sf, "thresholds").select(F.lit("thresholds").alias("measure"), F.col("rig").alias("source"), F.col("group_id").alias("item"), F.lit(None).cast("bigint").alias("at"), F.col("hfr_max").cast("double").alias("v"))
    found = spikes.faults(timed.unionByName(hfr), MEASURES, usual=("thresholds",))
    return found.select(F.col("measure").alias("src"), F.col("source").alias("rig"), F.col("item").alias("row_id"), "v", "reason")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p3_faults(spark, sf).select("src", "row_id").distinct()


def p4_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Start, end (start of the last frame), duration and frames of every observing session."""
    frames, subgrades, rigs = (read(spark, sf, t) for t in ("frames", "subgrades", "rigs"))
    times = timestamps.frame_times(frames, subgrades, rigs).filter(F.col("src") == "frames.date_obs")
    found = sessions.sessionise(times, "rig", "micros", "frame_id")
    return found.select(
        "rig", F.col("first_id").alias("first_frame_id"), F.col("last_id").alias("last_frame_id"),
        timeparse.utc_text(F.col("start")).alias("start_utc"), timeparse.utc_text(F.col("end")).alias("end_utc"),
        ((F.col("end") - F.col("start")) / 1_000_000).alias("duration_s"), F.col("n").alias("n_frames"),
    )


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_sessions(spark, sf).select("rig", "first_frame_id", "last_frame_id", "n_frames")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return timestamps.normalised(*(read(spark, sf, t) for t in ("frames", "subgrades", "rigs")))


QUERIES = {"p1_found": p1_found, "p1_alternatives": p1_alternatives, "p1_appearing": p1_appearing, "p1_table": p1_table, "p2_found": p2_found, "p2_attributes": p2_attributes, "p2_repeats": p2_repeats, "p2_wide": p2_wide, "p2_wide_all": p2_wide_all, "p3_found": p3_found, "p3_faults": p3_faults, "p4_found": p4_found, "p4_sessions": p4_sessions, "p5_found": p5_found}

# SQL twins. NBSP is chr(160) there; the number's grammar is that of functions.values.
_BARE = "regexp_replace(value_text, '^[\\s\\x{00A0}''\"]+|[\\s\\x{00A0}''\"]+$', '', 'g')"
_NUM = r"([+-]?(?:[0-9]+[.,]?[0-9]*|[.,][0-9]+)(?:[EeDd][+-]?[0-9]+)?)"
_UNIT = r"(?:\s+[A-Za-zµ%°\"''][A-Za-z0-9µ%°\"''/^²]*|%|°[CF]?|s|ms|sec|mm|cm|m|C|K|ADU|e|deg|arcsec|mag)?"
_SQL_CELLS = f"""c AS (SELECT DISTINCT frame_id, hdu, record, keyword, value_type, value_text FROM cards WHERE value_type <> 'undefined' AND value_text IS NOT NULL),
b AS (SELECT c.*, {_BARE} AS b, field, field_type, coalesce(unit_factor, 1) AS factor FROM c JOIN keydict USING (keyword)),
n AS (SELECT *, CASE WHEN regexp_full_match(b, '{_NUM}{_UNIT}') THEN TRY_CAST(replace(replace(replace(regexp_extract(b, '^{_NUM}', 1), ',', '.'), 'D', 'E'), 'd', 'E') AS DOUBLE) END AS v FROM b WHERE b <> ''),
t AS (SELECT frame_id, hdu, record, keyword, field, field_type, CASE WHEN isfinite(v) AND (field_type = 'double' OR field_type = 'bigint' AND v = floor(v)) THEN v * factor END AS num,
 CASE WHEN field_type = 'boolean' THEN CASE WHEN lower(b) IN ('t', 'true', 'yes', 'y', '1', 'on') THEN true WHEN lower(b) IN ('f', 'false', 'no', 'n', '0', 'off') THEN false END END AS flag, CASE WHEN field_type = 'string' THEN b END AS str FROM n)"""

# the fields of keydict by type
_SQL_FIELDS = {
    "DOUBLE": "airmass dew_c exposure_s focal_mm gain guide_rms humidity rotator_deg sensor_temp_c set_temp_c site_lat site_lon sky_quality",
    "BIGINT": "binning focus_pos offset_adu",
    "VARCHAR": "camera creator date_obs filter_name frame_type object pier_side",
    "BOOLEAN": "flipped",
}
_SQL_UNION = """h AS (SELECT DISTINCT ON (frame_id, hdu) CASE WHEN hdu = 0 THEN rig ELSE rig || '#' || hdu END AS rig, batch_no, frame_id, cards FROM hdus), x AS (SELECT DISTINCT rig, batch_no, CAST(frame_id AS VARCHAR) AS f, c.keyword AS keyword, c.value_type AS type FROM (SELECT rig, batch_no, frame_id, unnest(cards) AS c FROM h)),
j AS (SELECT revision, app_id, key, json_extract(rule, '$."' || key || '"') AS v, '' AS pre FROM (SELECT revision, app_id, rule, unnest(json_keys(rule)) AS key FROM app_rules)),
k AS (SELECT revision, app_id, key AS path, v FROM j WHERE json_type(v) <> 'OBJECT' UNION ALL SELECT revision, app_id, key || '.' || sub, json_extract(v, '$."' || sub || '"') FROM (SELECT *, unnest(json_keys(v)) AS sub FROM j WHERE json_type(v) = 'OBJECT')),
a AS (SELECT rig, batch_no, f, keyword, type FROM x WHERE type NOT IN ('undefined', 'commentary') UNION ALL
 SELECT 'apps', revision, app_id, path, CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'ARRAY' THEN 'array' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'number' END FROM k WHERE json_type(v) <> 'NULL'),
every AS (SELECT DISTINCT rig, batch_no FROM h UNION SELECT 'apps', revision FROM app_rules), u AS (SELECT rig, batch_no, keyword, type, count(*) AS files FROM a GROUP BY ALL)"""

SQL = {
    "p2_found": f"""WITH {_SQL_CELLS}, g AS (SELECT frame_id, field, bool_or(num IS NOT NULL OR flag IS NOT NULL OR str IS NOT NULL) AS readable,
 coalesce(max(num) - min(num) > 0.001::DOUBLE * greatest(abs(max(num)), abs(min(num))), false) OR count(DISTINCT flag) > 1 OR count(DISTINCT upper(str)) > 1 AS apart FROM t GROUP BY 1, 2)
SELECT frame_id, field, CASE WHEN NOT readable THEN 'unreadable' ELSE 'conflict' END AS problem FROM g WHERE NOT readable OR apart""",
    "p1_alternatives": f"""WITH {_SQL_UNION} SELECT rig, batch_no, keyword, type, files FROM u""",
    "p1_appearing": f"""WITH {_SQL_UNION}, b AS (SELECT rig, batch_no, lag(batch_no) OVER (PARTITION BY rig ORDER BY batch_no) AS before FROM (SELECT DISTINCT rig, batch_no FROM every)),
z AS (SELECT coalesce(n.rig, o.rig) AS rig, coalesce(n.batch_no, o.batch_no) AS batch_no, coalesce(n.keyword, o.keyword) AS keyword, coalesce(n.type, o.type) AS type, CASE WHEN o.rig IS NULL THEN 'appeared' ELSE 'gone' END AS change, coalesce(n.files, o.files) AS files, n.rig IS NOT NULL AND o.rig IS NOT NULL AS kept
 FROM (SELECT u.*, before FROM u JOIN b USING (rig, batch_no) WHERE before IS NOT NULL) n FULL JOIN (SELECT u.rig, b.batch_no, u.batch_no AS before, u.keyword, u.type, u.files FROM u JOIN b ON u.rig = b.rig AND u.batch_no = b.before) o ON n.rig = o.rig AND n.batch_no = o.batch_no AND n.keyword = o.keyword AND n.type = o.type)
SELECT rig, batch_no, keyword, type, change, files FROM z WHERE NOT kept""",
    "p2_wide": f"""WITH {_SQL_CELLS}, r AS (SELECT *, row(hdu, record, keyword) AS o FROM t WHERE num IS NOT NULL OR flag IS NOT NULL OR str IS NOT NULL), f AS (SELECT frame_id, field, arg_min(num, o) AS num, arg_min(flag, o) AS flag, arg_min(str, o) AS str FROM r GROUP BY 1, 2), e AS (SELECT DISTINCT frame_id FROM t)
SELECT e.frame_id, {", ".join(f"CAST(max({'str' if k == 'VARCHAR' else 'flag' if k == 'BOOLEAN' else 'num'}) FILTER (field = '{n}') AS {k}) AS {n}" for k, names in _SQL_FIELDS.items() for n in names.split())} FROM e LEFT JOIN f USING (frame_id) GROUP BY 1""",
    "p2_attributes": f"""WITH s AS (SELECT keyword, {_BARE} AS b FROM cards WHERE value_type <> 'commentary' AND keyword IS NOT NULL), n AS (SELECT keyword, b, coalesce(b <> '', false) AS stated, CASE WHEN regexp_full_match(b, '{_NUM}{_UNIT}') THEN TRY_CAST(replace(replace(replace(regexp_extract(b, '^{_NUM}', 1), ',', '.'), 'D', 'E'), 'd', 'E') AS DOUBLE) END AS v FROM s),
c AS (SELECT keyword, count(*) FILTER (stated) AS n, count(*) FILTER (stated AND lower(b) IN ('t', 'true', 'yes', 'y', 'on', 'f', 'false', 'no', 'n', 'off')) AS b, count(*) FILTER (stated AND isfinite(v) AND v = floor(v)) AS i, count(*) FILTER (stated AND isfinite(v)) AS d FROM n GROUP BY 1),
i AS (SELECT keyword, n, CASE WHEN n > 0 AND b >= 0.9 * n THEN 'boolean' WHEN n > 0 AND i >= 0.9 * n THEN 'bigint' WHEN n > 0 AND d >= 0.9 * n THEN 'double' ELSE 'string' END AS inferred_type FROM c)
SELECT coalesce(i.keyword, k.keyword) AS keyword, coalesce(k.field, regexp_replace(lower(i.keyword), '[^a-z0-9]', '_', 'g')) AS field, coalesce(k.field_type, inferred_type) AS field_type, coalesce(k.unit_factor, 1) AS unit_factor, inferred_type, coalesce(n, 0) AS n, k.field IS NOT NULL AS known FROM i FULL JOIN keydict k ON i.keyword = k.keyword""",
    "p2_repeats": f"""WITH {_SQL_CELLS}, r AS (SELECT *, row(hdu, record, keyword) AS o, num IS NOT NULL OR flag IS NOT NULL OR str IS NOT NULL AS ok FROM t)
SELECT frame_id, field, arg_min(keyword, o) FILTER (ok) AS keyword, NOT bool_and(ok) AS unread FROM r GROUP BY 1, 2 HAVING count(DISTINCT o) > 1""",
}
