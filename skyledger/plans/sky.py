"""Queries on positions, plate solutions, keywords and text forms, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.functions import astro, text
from skyledger.plans.reference import _LISTED, _frames, query
from skyledger.session import read

_SQL_RA = "lpad(CAST(CAST(floor(k / 36000) AS BIGINT) AS VARCHAR), 2, '0') || 'h' || lpad(CAST(CAST(floor(k / 600) AS BIGINT) % 60 AS VARCHAR), 2, '0') || 'm' || lpad(CAST(CAST(floor(k / 10) AS BIGINT) % 60 AS VARCHAR), 2, '0') || '.' || CAST(k % 10 AS VARCHAR) || 's'"
_SQL_DEC = "CASE WHEN dec_deg < 0 THEN '−' ELSE '+' END || lpad(CAST(CAST(floor(d / 3600) AS BIGINT) AS VARCHAR), 2, '0') || '°' || lpad(CAST(CAST(floor(d / 60) AS BIGINT) % 60 AS VARCHAR), 2, '0') || '′' || lpad(CAST(d % 60 AS VARCHAR), 2, '0') || '″'"


@query(f"""WITH e AS (SELECT DISTINCT ON (frame_id) frame_id, object FROM frames), p AS (SELECT frame_id, ra_deg, dec_deg FROM e JOIN targets ON designation = object),
k AS (SELECT *, CAST(round(ra_deg * 2400) AS BIGINT) % 864000 AS k, CAST(round(abs(dec_deg) * 3600) AS BIGINT) AS d FROM p), t AS (SELECT frame_id, k, d, dec_deg, {_SQL_RA} AS ra_text, {_SQL_DEC} AS dec_text FROM k)
SELECT frame_id, ra_text, dec_text, round(k / 2400.0::DOUBLE, 6) AS ra_back, round(CASE WHEN dec_deg < 0 THEN -d / 3600.0::DOUBLE ELSE d / 3600.0::DOUBLE END, 6) AS dec_back FROM t""")
def ref_positions_as_text(spark, sf):
    """The position of each file's target as text, and read again from it."""
    t = read(spark, sf, "targets").select(F.col("designation").alias("object"), "ra_deg", "dec_deg")
    p = _frames(spark, sf).select("frame_id", "object").join(t, "object").select("frame_id", text.ra_text(F.col("ra_deg")).alias("ra_text"), text.dec_text(F.col("dec_deg")).alias("dec_text"))
    # the minus sign of display is not the one of headers
    back = F.regexp_replace("dec_text", "^−", "-")
    return p.withColumns({"ra_back": F.round(text.parse_ra(F.col("ra_text")), 6), "dec_back": F.round(text.parse_dec(back), 6)})


_SQL_CD = "-s / 3600 * cos(radians(r)) AS a, -s / 3600 * sin(radians(r)) AS b, -s / 3600 * sin(radians(r)) AS c, s / 3600 * cos(radians(r)) AS d"


@query(f"""WITH e AS (SELECT DISTINCT ON (frame_id) frame_id, object, pixel_scale, size FROM frames), p AS (SELECT frame_id, ra_deg, dec_deg, pixel_scale AS s, CAST(frame_id % 360 AS DOUBLE) AS r, CAST(size[1] AS DOUBLE) AS w, CAST(size[2] AS DOUBLE) AS h FROM e JOIN targets ON designation = object WHERE pixel_scale > 0 AND len(size) >= 2),
m AS (SELECT *, {_SQL_CD} FROM p), x AS (SELECT *, radians(a * (0.5 - w / 2) + b * (0.5 - h / 2)) AS xi, radians(c * (0.5 - w / 2) + d * (0.5 - h / 2)) AS eta, cos(radians(dec_deg)) - radians(c * (0.5 - w / 2) + d * (0.5 - h / 2)) * sin(radians(dec_deg)) AS den FROM m),
y AS (SELECT *, degrees(radians(ra_deg) + atan2(xi, den)) AS ra, degrees(atan2(-b, d)) AS rot FROM x)
SELECT frame_id, round(s * w / 60, 3) AS width_arcmin, round(s * h / 60, 3) AS height_arcmin, round(sqrt(abs(a * d - b * c)) * 3600, 4) AS scale, round(rot - 360 * floor(rot / 360), 4) AS rotation, round(ra - 360 * floor(ra / 360), 5) AS corner_ra, round(degrees(atan2(sin(radians(dec_deg)) + eta * cos(radians(dec_deg)), sqrt(xi * xi + den * den))), 5) AS corner_dec FROM y""")
def ref_frame_corners(spark, sf):
    """Field of view, scale, rotation and first corner on the sky of each file whose target is known, turned by its number of degrees."""
    t = read(spark, sf, "targets").select(F.col("designation").alias("object"), "ra_deg", "dec_deg")
    e = _frames(spark, sf).select("frame_id", "object", "pixel_scale", "size").filter((F.col("pixel_scale") > 0) & (F.size("size") >= 2)).join(t, "object")
    none, c = F.lit(None).cast("double"), F.col
    step = c("pixel_scale") / 3600
    e = e.withColumns({"w": c("size")[0].cast("double"), "h": c("size")[1].cast("double"), "cd": astro.cd_matrix(none, none, none, none, -step, step, (c("frame_id") % 360).cast("double"), F.lit(True))})
    ra, dec = astro.pixel_to_sky(F.lit(0.0), F.lit(0.0), c("ra_deg"), c("dec_deg"), (c("w") + 1) / 2, (c("h") + 1) / 2, c("cd"))
    return e.select(
        "frame_id", F.round(astro.field_of_view(c("pixel_scale"), c("w")), 3).alias("width_arcmin"), F.round(astro.field_of_view(c("pixel_scale"), c("h")), 3).alias("height_arcmin"),
        F.round(astro.wcs_scale(c("cd")), 4).alias("scale"), F.round(astro.rotation(c("cd")), 4).alias("rotation"), F.round(ra, 5).alias("corner_ra"), F.round(dec, 5).alias("corner_dec"),
    )


_SIN = lambda a, b: f"sin(radians({a}::DOUBLE + {b}::DOUBLE * t))"


@query(f"""WITH e AS (SELECT DISTINCT ON (frame_id) frame_id, rig, object, scanned_at FROM frames ORDER BY frame_id, scanned_at), s AS (SELECT frame_id, site_lat AS lat, site_lon AS lon, ra_deg AS ra, dec_deg AS dec, epoch_us(scanned_at) / 86400000000.0::DOUBLE + 2440587.5::DOUBLE AS jd FROM e JOIN rigs USING (rig) JOIN targets ON designation = object WHERE scanned_at IS NOT NULL),
c AS (SELECT *, (jd - 2451545.0::DOUBLE) / 36525.0::DOUBLE AS t, jd - 2451545.0::DOUBLE AS n FROM s),
l AS (SELECT *, 218.32::DOUBLE + 481267.881::DOUBLE * t + 6.29::DOUBLE * {_SIN('135.0', '477198.87')} - 1.27::DOUBLE * {_SIN('259.3', '-413335.36')} + 0.66::DOUBLE * {_SIN('235.7', '890534.22')} + 0.21::DOUBLE * {_SIN('269.9', '954397.74')} - 0.19::DOUBLE * {_SIN('357.5', '35999.05')} - 0.11::DOUBLE * {_SIN('186.5', '966404.03')} AS ml,
 5.13::DOUBLE * {_SIN('93.3', '483202.02')} + 0.28::DOUBLE * {_SIN('228.2', '960400.89')} - 0.28::DOUBLE * {_SIN('318.3', '6003.15')} - 0.17::DOUBLE * {_SIN('217.6', '-407332.21')} AS mb, radians(357.52911::DOUBLE + 35999.05029::DOUBLE * t) AS m, radians(23.439291::DOUBLE - 0.0130042::DOUBLE * t) AS e,
 280.46061837::DOUBLE + 360.98564736629::DOUBLE * n + 0.000387933::DOUBLE * t * t - t * t * t / 38710000 AS st FROM c),
u AS (SELECT *, 280.46646::DOUBLE + 36000.76983::DOUBLE * t + (1.914602::DOUBLE - 0.004817::DOUBLE * t) * sin(m) + 0.019993::DOUBLE * sin(2 * m) + 0.000289::DOUBLE * sin(3 * m) AS sl, radians(st + lon - ra) AS h, degrees(atan2(sin(radians(ml)) * cos(e) - tan(radians(mb)) * sin(e), cos(radians(ml)))) AS mra, degrees(asin(sin(radians(mb)) * cos(e) + cos(radians(mb)) * sin(e) * sin(radians(ml)))) AS mdec FROM l),
z AS (SELECT *, degrees(atan2(-cos(radians(dec)) * sin(h), sin(radians(dec)) * cos(radians(lat)) - cos(radians(dec)) * cos(h) * sin(radians(lat)))) AS az, ml - sl - 360 * floor((ml - sl) / 360) AS apart FROM u)
SELECT frame_id, round(az - 360 * floor(az / 360), 1) AS azimuth, round((1 - cos(radians(mb)) * cos(radians(ml - sl))) / 2, 2) AS moon_lit, apart < 180 AS moon_waxing, round(degrees(2 * asin(least(1.0, sqrt(pow(sin(radians(mdec - dec) / 2), 2) + cos(radians(dec)) * cos(radians(mdec)) * pow(sin(radians(mra - ra) / 2), 2))))), 1) AS moon_degrees FROM z""")
def ref_moon(spark, sf):
    """Where each file's target stood at its site when it was first listed, and the moon's light and distance."""
    t = read(spark, sf, "targets").select(F.col("designation").alias("object"), F.col("ra_deg").alias("ra"), F.col("dec_deg").alias("dec"))
    first = read(spark, sf, "frames").groupBy("frame_id").agg(F.min("rig").alias("rig"), F.min("object").alias("object"), F.min("scanned_at").alias("at"))
    c = F.col
    e = first.filter("at IS NOT NULL").join(read(spark, sf, "rigs").select("rig", F.col("site_lat").alias("lat"), F.col("site_lon").alias("lon")), "rig").join(t, "object")
    e = e.withColumn("jd", astro.julian_day(F.unix_micros(c("at").cast("timestamp"))))
    lit, waxing = astro.moon_phase(c("jd"))
    mra, mdec = astro.moon(c("jd"))
    return e.select("frame_id", F.round(astro.azimuth(c("ra"), c("dec"), c("lat"), c("lon"), c("jd")), 1).alias("azimuth"), F.round(lit, 2).alias("moon_lit"), waxing.alias("moon_waxing"), F.round(astro.separation(c("ra"), c("dec"), mra, mdec), 1).alias("moon_degrees"))


_SQL_KEYS = "k AS (SELECT keyword FROM cards WHERE keyword IS NOT NULL UNION SELECT unnest(cards).keyword FROM hdus)"


@query(rf"""WITH {_SQL_KEYS} SELECT keyword, regexp_full_match(keyword, '[A-Z0-9_-]{{1,8}}') AS valid, CASE WHEN keyword IN ('BZERO', 'BSCALE') THEN 'changes what every stored pixel value means' WHEN keyword = 'BLANK' THEN 'changes which pixels count as undefined' WHEN keyword IN ('CHECKSUM', 'DATASUM') THEN 'is maintained on write'
 WHEN keyword = 'CONTINUE' THEN 'is part of a long-string value' WHEN keyword = 'END' THEN 'ends the header' WHEN regexp_full_match(keyword, 'SIMPLE|XTENSION|BITPIX|NAXIS[0-9]*|EXTEND|PCOUNT|GCOUNT|TFIELDS') THEN 'describes the data layout' WHEN regexp_full_match(keyword, 'T(FORM|TYPE|BCOL|DIM|HEAP|ZERO|SCAL|NULL)[0-9]*') THEN 'describes a table column' END AS locked,
 regexp_matches(keyword, '^(WCSAXES|LONPOLE|LATPOLE|RADESYS|MJDREF|A_ORDER|B_ORDER|AP_ORDER|BP_ORDER|IMAGEW|IMAGEH|PLTSOLVD)$|^(CTYPE|CRVAL|CRPIX|CDELT|CROTA|CUNIT|CD1_|CD2_|PC1_|PC2_|PV|LTM)|^(A|B|AP|BP)_[0-9]') AS wcs FROM k""")
def ref_keyword_rules(spark, sf):
    """Every keyword that occurs: whether it may be written, why it may not be edited, whether it is of a plate solution."""
    k = read(spark, sf, "cards").select("keyword").filter("keyword IS NOT NULL").union(read(spark, sf, "hdus").select(F.explode("cards.keyword"))).distinct()
    key = F.col("keyword")
    return k.select("keyword", text.valid_keyword(key).alias("valid"), text.locked(key).alias("locked"), text.is_wcs(key).alias("wcs"))


@query(rf"""WITH c AS (SELECT DISTINCT frame_id, hdu, record, keyword, value_type, value_text FROM cards WHERE value_type IN ('string', 'integer', 'float', 'logical') AND value_text IS NOT NULL AND regexp_full_match(keyword, '[A-Z0-9_-]{{1,8}}')),
t AS (SELECT *, trim(value_text) AS v FROM c) SELECT frame_id, hdu, record, CASE WHEN value_type = 'string' THEN '''' || v || '''' ELSE value_text END AS shown, CASE WHEN value_type = 'string' THEN 'string' WHEN v IN ('T', 'F') THEN 'logical' WHEN regexp_full_match(v, '[+-]?[0-9]+') AND TRY_CAST(v AS BIGINT) IS NOT NULL THEN 'integer'
 WHEN regexp_full_match(v, '[-+0-9.eE]+') AND TRY_CAST(v AS DOUBLE) IS NOT NULL THEN 'float' ELSE 'string' END AS read_type FROM t""")
def ref_assignments(spark, sf):
    """Each valued card as a list shows it, and the type it has when it is assigned again as KEY=VALUE."""
    c = read(spark, sf, "cards").filter(F.col("value_type").isin("string", "integer", "float", "logical") & F.col("value_text").isNotNull() & text.valid_keyword(F.col("keyword")))
    c = c.select("frame_id", "hdu", "record", "keyword", "value_type", "value_text").distinct()
    c = c.withColumn("shown", text.shown(F.col("value_type"), F.col("value_text")))
    again = text.assignment(F.concat(F.lower("keyword"), F.lit(" = "), "shown"))
    return c.select("frame_id", "hdu", "record", "shown", again["value_type"].alias("read_type"))


@query(rf"""WITH {_LISTED} SELECT frame_id, CASE WHEN regexp_matches(name, '\.(fits|fit|fts)\.fz$') THEN regexp_extract(name, '^(.*?)\.((?:fits|fit|fts)\.fz)$', 1) WHEN contains(name, '.') THEN regexp_replace(name, '\.[^.]*$', '') ELSE name END AS stem,
 CASE WHEN regexp_matches(name, '\.(fits|fit|fts)\.fz$') THEN regexp_extract(name, '^(.*?)\.((?:fits|fit|fts)\.fz)$', 2) WHEN contains(name, '.') THEN regexp_extract(name, '\.([^.]*)$', 1) ELSE '' END AS ext FROM (SELECT frame_id, regexp_replace(name, '^.*[/\\]', '') AS name FROM e)""")
def ref_stems(spark, sf):
    stem, ext = text.stem_ext(F.col("name"))
    return _frames(spark, sf).select("frame_id", stem.alias("stem"), ext.alias("ext"))


@query("""WITH s AS (SELECT rig, coalesce(sum(exposure_s), 0) AS s FROM (SELECT DISTINCT ON (frame_id) rig, exposure_s FROM subgrades) GROUP BY 1), d AS (SELECT rig, s, CAST(round(s) AS BIGINT) AS t, CAST(round(s / 60) AS BIGINT) AS m FROM s)
SELECT rig, CASE WHEN m >= 60 THEN CAST(m // 60 AS VARCHAR) || 'h ' || lpad(CAST(m % 60 AS VARCHAR), 2, '0') || 'm' WHEN m > 0 THEN CAST(m AS VARCHAR) || ' min' ELSE CAST(t AS VARCHAR) || ' s' END AS report,
 CASE WHEN t >= 3600 THEN CAST(t // 3600 AS VARCHAR) || ' h ' || lpad(CAST((t % 3600) // 60 AS VARCHAR), 2, '0') || ' m' WHEN t >= 60 THEN CAST(t // 60 AS VARCHAR) || ' m' ELSE CAST(t AS VARCHAR) || ' s' END AS spaced, regexp_replace(regexp_replace(printf('%.2f', round(s / 3600, 2)), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') AS hours,
 CASE WHEN s / 86400 >= 1 THEN CAST(CAST(round(s / 86400) AS BIGINT) AS VARCHAR) || ' days apart' WHEN s / 86400 * 24 >= 1 THEN printf('%.1f', round(s / 86400 * 24, 1)) || ' h apart' ELSE CAST(CAST(round(s / 86400 * 1440) AS BIGINT) AS VARCHAR) || ' min apart' END AS apart FROM d""")
def ref_duration_texts(spark, sf):
    """Graded exposure of each rig in the forms of reports and lists."""
    s = read(spark, sf, "subgrades").dropDuplicates(["frame_id"]).groupBy("rig").agg(F.coalesce(F.sum("exposure_s"), F.lit(0.0)).alias("s"))
    x = F.col("s")
    return s.select("rig", text.report_duration(x).alias("report"), text.spaced_duration(x).alias("spaced"), text.trimmed(x / 3600, 2).alias("hours"), text.interval(x / 86400).alias("apart"))


@query()
def ref_fuzzy_objects(spark, sf):
    """Typed objects that a short query is a subsequence of, with the score of the match."""
    names = _frames(spark, sf).filter("object IS NOT NULL").groupBy("object").agg(F.count("*").alias("files"))
    return names.withColumn("score", text.fuzzy(F.lit("neb"), F.col("object"))).filter("score IS NOT NULL")
