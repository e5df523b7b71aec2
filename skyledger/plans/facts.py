"""Queries on canonical facts and on what wrote the files, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.functions import filename
from skyledger.operators import canonical, classify
from skyledger.plans.reference import _LISTED, _frames, query
from skyledger.session import read


def all_cards(spark: SparkSession, sf: str) -> DataFrame:
    """The cards of both card tables: frame_id, hdu, record, keyword, value_type, value_text."""
    columns = ["frame_id", "hdu", "record", "keyword", "value_type", "value_text"]
    units = read(spark, sf, "hdus").select("frame_id", "hdu", F.posexplode("cards").alias("record", "c")).select("frame_id", "hdu", "record", "c.keyword", "c.value_type", "c.value_text")
    return read(spark, sf, "cards").select(*columns).unionByName(units)


def _heads(spark: SparkSession, sf: str) -> DataFrame:
    return canonical.headers_of(all_cards(spark, sf), read(spark, sf, "hdus"))


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    heads = _heads(spark, sf)
    apps = canonical.matched(heads, canonical.app_rules(read(spark, sf, "app_rules")))
    shapes = read(spark, sf, "hdus").filter(F.size("shape") > 0).groupBy("frame_id").agg(F.min_by("shape", "hdu").alias("shape"))
    files = _frames(spark, sf).select("frame_id", "name").join(shapes, "frame_id", "left").withColumn("planes", F.when(F.size("shape") > 2, F.get("shape", F.lit(2))).when(F.size("shape") > 0, 1))
    return canonical.facts(files, heads, [canonical.dictionary_rule(read(spark, sf, "keydict"))], apps)


_ALL = """h AS (SELECT DISTINCT ON (frame_id, hdu) frame_id, hdu, shape, cards FROM hdus), x AS (SELECT frame_id, hdu, generate_subscripts(cards, 1) - 1 AS record, unnest(cards) AS c FROM h),
a AS (SELECT frame_id, hdu, record, keyword, value_type, value_text FROM cards UNION ALL SELECT frame_id, hdu, record, c.keyword, c.value_type, c.value_text FROM x),
im AS (SELECT frame_id, min(hdu) AS image FROM h WHERE len(shape) > 0 GROUP BY 1), p AS (SELECT a.*, a.hdu <> coalesce(image, 0) AS later FROM a LEFT JOIN im USING (frame_id) WHERE keyword IS NOT NULL),
v AS (SELECT frame_id, keyword, arg_min(row(value_type, coalesce(value_text, '')), row(later, hdu, record)) AS v FROM p WHERE value_type <> 'commentary' AND (NOT later OR hdu = 0) GROUP BY 1, 2)"""
# facts that come from keywords alone, with their standard keywords
_SIMPLE = {
    "object": ("s", "OBJECT OBJNAME"), "camera": ("s", "INSTRUME"), "set_temp_c": ("n", "SET-TEMP SET_TEMP"), "offset": ("n", "OFFSET BLKLEVEL"), "focal_mm": ("p", "FOCALLEN FOCAL"), "pixel_um": ("p", "XPIXSZ PIXSIZE1 PIXSZ"),
    "pier_side": ("s", "PIERSIDE"), "focus_pos": ("w", "FOCPOS FOCUSPOS"), "total_integration_s": ("p", "LIVETIME TOTALEXP"), "site_elev_m": ("n", "SITEELEV OBSGEO-H ALT-OBS OBSALT"), "egain": ("p", "EGAIN"),
}
_STD = ", ".join(f"('{f}', '{kind}', '{k}', {i})" for f, (kind, keys) in _SIMPLE.items() for i, k in enumerate(keys.split()))
_BARE = "regexp_replace(v[2], '^[\\s\\x{00A0}''\"]+|[\\s\\x{00A0}''\"]+$', '', 'g')"
_NUM = r"([+-]?(?:[0-9]+[.,]?[0-9]*|[.,][0-9]+)(?:[EeDd][+-]?[0-9]+)?)"
_UNIT = r"(?:\s+[A-Za-zµ%°\"''][A-Za-z0-9µ%°\"''/^²]*|%|°[CF]?|s|ms|sec|mm|cm|m|C|K|ADU|e|deg|arcsec|mag)?"


@query(f"""WITH {_ALL}, std(fact, kind, keyword, rank) AS (VALUES {_STD}), d AS (SELECT CASE field WHEN 'offset_adu' THEN 'offset' WHEN 'filter_name' THEN 'filter' ELSE field END AS fact, keyword, unit_factor FROM keydict),
k AS (SELECT * FROM std UNION ALL SELECT d.fact, kinds.kind, d.keyword, 100 + row_number() OVER (PARTITION BY d.fact ORDER BY d.keyword) FROM d JOIN (SELECT DISTINCT fact, kind FROM std) kinds USING (fact) WHERE NOT EXISTS (SELECT 1 FROM std WHERE std.fact = d.fact AND std.keyword = d.keyword)),
t AS (SELECT frame_id, fact, kind, keyword, rank, {_BARE} AS b, v[1] AS vt, coalesce((SELECT max(unit_factor) FROM d WHERE d.keyword = v.keyword), 1) AS factor FROM v JOIN k USING (keyword)),
n AS (SELECT *, CASE WHEN regexp_full_match(b, '{_NUM}{_UNIT}') THEN TRY_CAST(replace(replace(replace(regexp_extract(b, '^{_NUM}', 1), ',', '.'), 'D', 'E'), 'd', 'E') AS DOUBLE) END * factor AS x FROM t WHERE vt <> 'undefined'),
o AS (SELECT * FROM n WHERE CASE WHEN kind = 's' THEN trim(b) <> '' WHEN kind = 'n' THEN isfinite(x) ELSE isfinite(x) AND x > 0 END)
SELECT frame_id, fact, CASE WHEN kind = 's' THEN NULL WHEN kind = 'w' THEN round(x) ELSE round(x, 6) END AS num, CASE WHEN kind = 's' THEN trim(b) END AS str, keyword AS source FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, fact ORDER BY rank) AS r FROM o) WHERE r = 1 AND frame_id IN (SELECT frame_id FROM frames) AND NOT (fact = 'total_integration_s')""")
def ref_canonical_facts(spark, sf):
    """Facts that come from keywords alone: value and the keyword it is from, by the standard keywords and the dictionary."""
    f = _facts(spark, sf)
    names = [n for n in _SIMPLE if n != "total_integration_s"]

    def row(n):
        kind = _SIMPLE[n][0]
        value = F.col(f"{n}.value")
        num = F.lit(None).cast("double") if kind == "s" else F.round(value.cast("double"), 6)
        return F.when(F.col(n).isNotNull(), F.struct(F.lit(n).alias("fact"), num.alias("num"), (value if kind == "s" else F.lit(None).cast("string")).alias("str"), F.col(f"{n}.source").alias("source")))

    return f.select("frame_id", F.explode(F.array_compact(F.array(*[row(n) for n in names]))).alias("x")).select("frame_id", "x.*")


@query()
def ref_canonical_exposures(spark, sf):
    """Exposure, stack count and total of each file with their sources, and what is to be noted about the header."""
    f = _facts(spark, sf)
    return f.select("frame_id", *[F.col(f"{n}.{p}").alias(f"{n}_{p}") for n in ("exposure_s", "stack_count", "total_integration_s", "date_obs", "site_lat", "site_lon", "ra", "dec") for p in ("value", "source")], "notes")


_SQL_RULES = """nw AS (SELECT app_id, arg_max(rule, revision) AS rule FROM app_rules GROUP BY 1), mk AS (SELECT app_id, json_extract(rule, '$.match') AS m FROM nw), kk AS (SELECT app_id, m, unnest(json_keys(m)) AS key FROM mk WHERE json_type(m) = 'OBJECT'),
pv AS (SELECT app_id, key, json_extract(m, '$."' || key || '"') AS v FROM kk), pl AS (SELECT app_id, key, unnest(CASE WHEN json_type(v) = 'ARRAY' THEN CAST(v AS VARCHAR[]) ELSE [json_extract_string(v, '$')] END) AS ps FROM pv),
pt AS (SELECT app_id, key, unnest(string_split(ps, '|')) AS pattern FROM pl), cm AS (SELECT app_id, json_extract(rule, '$.comment') AS v FROM nw), cl AS (SELECT app_id, unnest(CASE WHEN json_type(v) = 'ARRAY' THEN CAST(v AS VARCHAR[]) ELSE [json_extract_string(v, '$')] END) AS needle FROM cm WHERE v IS NOT NULL)"""


@query(f"""WITH {_ALL}, {_SQL_RULES}, m AS (SELECT frame_id, app_id, keyword || '=' || trim(v[2]) AS e, keyword FROM v JOIN pt ON pt.key = v.keyword AND lower(trim(v[2])) LIKE replace(lower(trim(pattern)), '*', '%')
 UNION SELECT frame_id, app_id, 'COMMENT ''' || substr(lower(trim(value_text)), 1, 48) || '''', 'COMMENT' FROM p JOIN cl ON keyword = 'COMMENT' AND value_type = 'commentary' AND contains(lower(value_text), trim(lower(replace(needle, '*', '')))))
SELECT frame_id, app_id AS id, array_to_string(list_sort(list(DISTINCT e)), '; ') AS evidence, CAST((SELECT sum(CASE k WHEN 'INSTRUME' THEN 4 WHEN 'CREATOR' THEN 3 WHEN 'TELESCOP' THEN 1 ELSE 2 END) FROM (SELECT unnest(list(DISTINCT keyword)) AS k)) AS INT) AS weight FROM m GROUP BY 1, 2""")
def ref_app_matches(spark, sf):
    """The programs whose newest rule a file's header fits, with what fitted."""
    found = canonical.matched(_heads(spark, sf), canonical.app_rules(read(spark, sf, "app_rules")))
    return found.select("frame_id", "id", F.array_join("evidence", "; ").alias("evidence"), "weight")


@query(f"""WITH {_ALL}, g AS (SELECT rig AS id, row_number() OVER (ORDER BY rig) AS place, camera, telescope FROM rigs), r AS (SELECT id, place, 'INSTRUME' AS key, camera AS said FROM g UNION ALL SELECT id, place, 'TELESCOP', telescope FROM g),
m AS (SELECT frame_id, id, place, sum(CASE key WHEN 'INSTRUME' THEN 4 ELSE 1 END) AS weight FROM v JOIN r ON r.key = v.keyword AND lower(trim(v[2])) = lower(trim(r.said)) GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY weight DESC, place, id) AS n FROM m)
SELECT frame_id, max(id) FILTER (n = 1) AS scope, max(id) FILTER (n = 2) AS conflict FROM k GROUP BY 1""")
def ref_scope_matches(spark, sf):
    """The rig whose camera and telescope a file's header names best, and the next best."""
    rigs = read(spark, sf, "rigs").select(F.col("rig").alias("id"), F.col("rig").alias("name"), F.lit("scope").alias("role"), F.row_number().over(_by_rig()).alias("place"), "camera", "telescope")
    one = lambda key, column: rigs.select("id", "name", "role", "place", F.lit("match").alias("how"), F.lit(key).alias("key"), F.col(column).alias("pattern"))
    return canonical.scope(canonical.matched(_heads(spark, sf), one("INSTRUME", "camera").unionByName(one("TELESCOP", "telescope")))).select("frame_id", "scope", "conflict")


def _by_rig():
    from pyspark.sql import Window

    return Window.orderBy("rig")


@query(rf"""WITH {_LISTED}, s AS (SELECT frame_id, list_filter(string_split_regex(regexp_replace(regexp_replace(name, '^.*[/\\]', ''), '(\.[A-Za-z]{{1,4}})+$', ''), '[_ ]'), lambda x: x <> '') AS ts FROM e), t AS (SELECT frame_id, ts, unnest(ts) AS raw, generate_subscripts(ts, 1) AS i FROM s),
n AS (SELECT frame_id, i, lower(raw) AS t, raw, ts[i + 1] AS nxt FROM t), k AS (SELECT frame_id, i, t, nxt, regexp_full_match(t, '[\d.-]+s\d+') AND TRY_CAST(regexp_extract(t, '^([\d.-]+)s', 1) AS DOUBLE) IS NOT NULL AS dwarf, regexp_full_match(t, '[\d.-]+s') AND TRY_CAST(regexp_extract(t, '^([\d.-]+)s', 1) AS DOUBLE) IS NOT NULL AS plain FROM n)
SELECT e.frame_id, coalesce(arg_max(TRY_CAST(substr(t, 5) AS BIGINT), i) FILTER (regexp_full_match(t, 'gain[+-]?\d+')), arg_min(TRY_CAST(regexp_extract(t, 's(\d+)$', 1) AS BIGINT), i) FILTER (dwarf)) AS gain,
 arg_max(TRY_CAST(regexp_extract(t, '^([\d.-]+)c$', 1) AS DOUBLE), i) FILTER (regexp_full_match(t, '[\d.-]+c') AND (contains(t, '.') OR starts_with(t, '-'))) AS temp_c, arg_min(nxt, i) FILTER (nxt IS NOT NULL AND (dwarf OR plain AND lower(nxt) IN ('lp', 'ircut', 'uvir', 'l', 'r', 'g', 'b', 'ha', 'oiii', 'sii', 'ho', 'sho', 'duo', 'dual'))) AS filter_name,
 arg_min(TRY_CAST(regexp_extract(t, '^(\d+)x', 1) AS BIGINT), i) FILTER (regexp_full_match(t, '\d+x[\d.-]+s')) AS frames FROM e LEFT JOIN k USING (frame_id) GROUP BY 1""")
def ref_filename_details(spark, sf):
    """Gain, temperature, filter and frames that each file's name states."""
    f = filename.facts(F.col("name"))
    return _frames(spark, sf).select("frame_id", f.alias("f")).select("frame_id", "f.gain", "f.temp_c", "f.filter_name", "f.frames")


@query()
def ref_entries(spark, sf):
    """The listing made anew from headers and names: facts, verdict, scale and night of every file."""
    files = _frames(spark, sf)
    units = read(spark, sf, "hdus")
    verdicts = classify.verdicts(files, all_cards(spark, sf), units)
    return canonical.entries(_facts(spark, sf), files.select("frame_id", "path", "name", "bytes", "size"), verdicts)
