"""Smaller queries on listings, headers and planes, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.functions import checksum, names, text
from skyledger.operators import calibration, folder, headers, pixels
from skyledger.plans.calibration import _GROUPS, _SETS
from skyledger.plans.reference import _GRADED, _LISTED, _PX, _frames, query
from skyledger.session import read


@query("SELECT DISTINCT frame_id, hdu, record, keyword, value_text FROM cards WHERE hdu = 0 AND contains(upper(keyword), 'TEMP')")
def ref_header_projection(spark, sf):
    """The first unit's cards whose keyword holds a piece of text, in any case."""
    c = read(spark, sf, "cards").filter((F.col("hdu") == 0) & F.upper("keyword").contains("temp".upper()))
    return c.select("frame_id", "hdu", "record", "keyword", "value_text").distinct()


@query(f"WITH {_LISTED} SELECT frame_id, path FROM e WHERE error IS NULL")
def ref_selectable(spark, sf):
    """All files without an error."""
    return _frames(spark, sf).filter("error IS NULL").select("frame_id", "path")


@query(f"WITH {_SETS}, {_GROUPS} SELECT first_frame, camera, filter_name, size, subs, cooled, temp_c, round(integration_s, 3) AS integration_s, array_to_string(nights, ',') AS nights FROM lg")
def ref_calibration_groups(spark, sf):
    """Light groups with their filter, integration and nights."""
    g = calibration.light_groups(_frames(spark, sf))
    return g.select("first_frame", "camera", "filter_name", "size", "subs", "cooled", "temp_c", F.round("integration_s", 3).alias("integration_s"), F.array_join("nights", ",").alias("nights"))


_T2 = lambda x: rf"regexp_replace(regexp_replace(printf('%.2f', round({x}, 2)), '(\.[0-9]*?)0+$', '\1'), '\.$', '')"


@query(rf"""WITH {_GRADED}, o AS (SELECT *, row(date_obs IS NOT NULL, coalesce(date_obs, ''), frame_id) AS o FROM g WHERE NOT rejected), a AS (SELECT coalesce(night, '') AS night, coalesce(filter_name, '') AS filter_name, coalesce(ms, 0) AS ms, count(*) AS n, arg_min_null(binning, o) AS b, arg_min_null(gain, o) AS gain, arg_min_null(set_temp_c, o) AS cool, avg(CAST(fwhm AS DOUBLE) * pixel_scale) AS f FROM o GROUP BY ALL)
SELECT night, concat_ws(',', night, replace(filter_name, ',', ' '), CAST(n AS VARCHAR), {_T2('ms / 1000.0::DOUBLE')}, CAST(coalesce(b, 1) AS VARCHAR), coalesce({_T2('gain')}, ''), coalesce({_T2('round(cool)')}, ''), coalesce(printf('%.2f', round(f, 2)), '')) AS line FROM a""")
def ref_acquisition_lines(spark, sf):
    """Kept subs by night, filter and length as CSV lines: date, filter, number, duration, binning, gain, cooling, mean FWHM."""
    c = F.col
    kept = folder.with_grades(_frames(spark, sf), read(spark, sf, "subgrades")).filter(~F.coalesce("reject", F.lit(False)))
    first = F.struct(c("date_obs").isNotNull(), F.coalesce("date_obs", F.lit("")), "frame_id")
    a = kept.groupBy(F.coalesce("night", F.lit("")).alias("night"), F.coalesce("filter_name", F.lit("")).alias("filter_name"), F.coalesce(folder.milliseconds("exposure_s"), F.lit(0)).alias("ms")).agg(
        F.count("*").alias("n"), F.min_by(F.struct("binning", "gain", "set_temp_c"), first).alias("x"), F.avg(c("fwhm").cast("double") * c("pixel_scale")).alias("f"),
    )
    shown = lambda v: F.coalesce(text.trimmed(v, 2), F.lit(""))
    fwhm = F.coalesce(F.format_string("%.2f", F.round("f", 2)), F.lit(""))
    fwhm = F.when(c("f").isNull(), "").otherwise(fwhm)
    none = lambda v, s: F.when(v.isNull(), "").otherwise(s)
    gain, cool = c("x.gain"), F.round("x.set_temp_c")
    line = F.concat_ws(",", "night", F.replace(c("filter_name"), F.lit(","), F.lit(" ")), c("n").cast("string"), shown(c("ms") / 1000.0), F.coalesce("x.binning", F.lit(1)).cast("string"), none(gain, shown(gain)), none(cool, shown(cool)), fwhm)
    return a.select("night", line.alias("line"))


@query("""WITH t AS (SELECT *, CASE kind WHEN 'G' THEN 'Galaxy' WHEN 'OCl' THEN 'Open cluster' WHEN 'GCl' THEN 'Globular cluster' WHEN 'PN' THEN 'Planetary nebula' WHEN 'HII' THEN 'Emission nebula (HII region)' WHEN 'DrkN' THEN 'Dark nebula' WHEN 'Neb' THEN 'Nebula' WHEN 'SNR' THEN 'Supernova remnant' ELSE 'Other' END AS k,
 CASE constellation WHEN 'Per' THEN 'Perseus' WHEN 'Cep' THEN 'Cepheus' WHEN 'Sco' THEN 'Scorpius' WHEN 'Vir' THEN 'Virgo' WHEN 'Ori' THEN 'Orion' WHEN 'Sgr' THEN 'Sagittarius' WHEN 'Cas' THEN 'Cassiopeia' WHEN 'Lyr' THEN 'Lyra' WHEN 'Mon' THEN 'Monoceros' WHEN 'Aql' THEN 'Aquila' WHEN 'Cyg' THEN 'Cygnus' WHEN 'Leo' THEN 'Leo' END AS c FROM targets)
SELECT k AS kind_name, c AS constellation_name, count(*) AS files FROM (SELECT DISTINCT ON (frame_id) * FROM frames) JOIN t ON designation = object GROUP BY ALL""")
def ref_kinds_and_constellations(spark, sf):
    """Files by what their target is and where it stands, in words."""
    t = read(spark, sf, "targets").select(F.col("designation").alias("object"), names.kind_name(F.col("kind")).alias("kind_name"), names.constellation_name(F.col("constellation")).alias("constellation_name"))
    return _frames(spark, sf).select("object").join(t, "object").groupBy("kind_name", "constellation_name").agg(F.count("*").alias("files"))


@query(f"""WITH {_PX}, b AS (SELECT label, CASE WHEN hi > lo THEN least(CAST(floor((v - lo) / ((hi - lo) / 4096)) AS BIGINT), 4095) ELSE 0 END AS bin FROM x JOIN s USING (label)) SELECT label, CAST(floor(bin / 16) AS BIGINT) AS col, count(*) AS n, round(ln(1 + count(*)), 9) AS height FROM b WHERE bin BETWEEN 1 AND 4094 GROUP BY 1, 2""")
def ref_display_histogram(spark, sf):
    """The histogram of each plane in 256 columns with logarithmic heights, the first and last bin aside."""
    return pixels.display_histogram(pixels.pixels(read(spark, sf, "embeddings"), "label", "embedding"), "label").withColumn("height", F.round("height", 9))


@query("""WITH r AS (SELECT DISTINCT ON (rig) * FROM rigs), v AS (SELECT rig, unnest([{'keyword': 'FOCALLEN', 'value': CAST(focal_mm AS VARCHAR)}, {'keyword': 'XPIXSZ', 'value': CAST(pixel_um AS VARCHAR)}, {'keyword': 'YPIXSZ', 'value': CAST(pixel_um AS VARCHAR)}, {'keyword': 'TELESCOP', 'value': telescope}, {'keyword': 'INSTRUME', 'value': camera}]) AS x FROM r)
SELECT rig, x.keyword AS keyword, TRY_CAST(CASE WHEN x.keyword IN ('FOCALLEN', 'XPIXSZ', 'YPIXSZ') THEN x.value END AS DOUBLE) AS num, CASE WHEN x.keyword IN ('TELESCOP', 'INSTRUME') THEN x.value END AS str, 'rig: ' || rig AS note FROM v WHERE x.value IS NOT NULL""")
def ref_rig_ops(spark, sf):
    """The values that each rig would set in a header."""
    r = read(spark, sf, "rigs").dropDuplicates(["rig"])
    none = lambda kind: F.lit(None).cast(kind)
    number = lambda key, column: F.struct(F.lit(key).alias("keyword"), F.col(column).cast("double").alias("num"), none("string").alias("str"))
    word = lambda key, column: F.struct(F.lit(key).alias("keyword"), none("double").alias("num"), F.col(column).alias("str"))
    ops = F.array(number("FOCALLEN", "focal_mm"), number("XPIXSZ", "pixel_um"), number("YPIXSZ", "pixel_um"), word("TELESCOP", "telescope"), word("INSTRUME", "camera"))
    return r.select("rig", F.explode(ops).alias("x")).select("rig", "x.*", F.concat(F.lit("rig: "), "rig").alias("note")).filter("num IS NOT NULL OR str IS NOT NULL")


@query()
def ref_header_checksums(spark, sf):
    """Each header unit written as records with an empty CHECKSUM card: its sum and the text that seals it."""
    c = read(spark, sf, "cards").select("frame_id", "hdu", "record", "keyword", "value_type", "value_text", "note", "hierarch").distinct()
    lines = headers.format_records(*[F.col(x) for x in ("keyword", "value_type", "value_text", "note", "hierarch")])
    units = c.groupBy("frame_id", "hdu").agg(F.array_sort(F.collect_list(F.struct("record", lines.alias("lines")))).alias("x"))
    blank = F.rpad(F.lit("CHECKSUM= '0000000000000000'"), 80, " ")
    body = F.concat(F.array_join(F.flatten(F.transform("x", lambda r: r["lines"])), ""), blank, F.rpad(F.lit("END"), 80, " "))
    units = units.select("frame_id", "hdu", body.alias("body"))
    whole = units.withColumn("body", F.expr("rpad(body, cast(ceil(length(body) / 2880) * 2880 as int), ' ')"))
    return whole.select("frame_id", "hdu", checksum.header_sum(F.col("body")).alias("sum"), checksum.header_seal(F.col("body"), F.lit(0).cast("bigint")).alias("seal"))


@query()
def ref_documents(spark, sf):
    """Each light group with its calibration as one JSON document."""
    m = calibration.match(_frames(spark, sf))
    return m.select("first_frame", F.to_json(F.struct(F.lit("calibration/1").alias("schema"), *[F.col(x) for x in m.columns])).alias("document"))
