"""Queries on comparisons, moves and grading totals, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.operators import classify, compare, folder, headers, organise
from skyledger.plans.facts import all_cards
from skyledger.plans.reference import _JUDGED, _frames, _median, _subs, query, ref_graded_subs
from skyledger.session import read


def _compared(spark, sf):
    """Every file's first header unit against the one before it of its rig, with what the files are."""
    hdus = read(spark, sf, "hdus").filter("hdu = 0")
    pairs = headers.successive_units(hdus).select(F.col("a.frame_id").alias("a"), F.col("b.frame_id").alias("b"))
    kinds = _frames(spark, sf).select("frame_id", F.col("frame").alias("kind"), "integrated")
    return compare.compared(headers.exploded(hdus), pairs, kinds)


_COMPARED = """WITH h AS (SELECT DISTINCT ON (frame_id) * FROM hdus WHERE hdu = 0), x AS (SELECT frame_id, generate_subscripts(cards, 1) - 1 AS record, unnest(cards) AS c FROM h), p AS (SELECT frame_id AS b, lag(frame_id) OVER (PARTITION BY rig ORDER BY frame_id) AS a FROM h),
l AS (SELECT frame_id, c.keyword AS keyword, arg_max(row(c.value_type, trim(coalesce(c.value_text, ''))), record) AS v FROM x WHERE c.value_type <> 'commentary' GROUP BY 1, 2), f AS (SELECT DISTINCT ON (frame_id) frame_id, frame, integrated FROM frames),
pa AS (SELECT a, b, keyword, v[1] AS ta, v[2] AS va FROM p JOIN l ON l.frame_id = p.a), pb AS (SELECT a, b, keyword, v[1] AS tb, v[2] AS vb FROM p JOIN l ON l.frame_id = p.b WHERE a IS NOT NULL),
j AS (SELECT coalesce(pa.a, pb.a) AS a, coalesce(pa.b, pb.b) AS b, coalesce(pa.keyword, pb.keyword) AS keyword, ta, tb, va, vb, CASE WHEN ta IN ('integer', 'float') THEN TRY_CAST(replace(replace(va, 'D', 'E'), 'd', 'E') AS DOUBLE) END AS na, CASE WHEN tb IN ('integer', 'float') THEN TRY_CAST(replace(replace(vb, 'D', 'E'), 'd', 'E') AS DOUBLE) END AS nb
 FROM pa FULL JOIN pb ON pa.a = pb.a AND pa.b = pb.b AND pa.keyword = pb.keyword),
s AS (SELECT j.*, CASE WHEN tb IS NULL THEN 'only_a' WHEN ta IS NULL THEN 'only_b' WHEN na IS NOT NULL AND nb IS NOT NULL THEN CASE WHEN na = nb THEN 'same' ELSE 'changed' END WHEN va = vb THEN 'same' ELSE 'changed' END AS status, coalesce(fa.frame IN ('dark', 'flat', 'bias', 'dark_flat'), false) OR coalesce(fb.frame IN ('dark', 'flat', 'bias', 'dark_flat'), false) AS cal,
 coalesce(fa.frame = 'flat', false) OR coalesce(fb.frame = 'flat', false) AS flat FROM j LEFT JOIN f fa ON fa.frame_id = j.a LEFT JOIN f fb ON fb.frame_id = j.b)"""


@query(f"""{_COMPARED} SELECT a, b, count(*) AS keywords, count(*) FILTER (status <> 'same') AS differences, count(*) FILTER (status = 'changed' AND (keyword IN ('GAIN', 'OFFSET', 'INSTRUME', 'READOUTM', 'BAYERPAT', 'ROWORDER') OR keyword = 'FILTER' AND flat)) AS blockers FROM s GROUP BY 1, 2""")
def ref_comparison_counts(spark, sf):
    """Of each header and the one before it: keywords, differences, and those that block calibration."""
    return compare.counted(_compared(spark, sf))


@query()
def ref_comparison_notable(spark, sf):
    """Differences of each header to the one before it, and agreements that matter, with what they mean."""
    return compare.notable(_compared(spark, sf))


@query()
def ref_moves(spark, sf):
    """Where every light sub would go, by object, filter and night, numbered in capture order."""
    return organise.plan(_frames(spark, sf).filter(folder.is_light()), "/sorted", "{object}/{filter}", "{object}_{exptime}s_{night}_{seq}")


@query(f"""WITH {_JUDGED}, z AS (SELECT w.*, j.hfr FROM w JOIN j USING (frame_id)) SELECT count(*) FILTER (reasons = '') AS kept, count(*) FILTER (reasons <> '') AS rejected, CAST(0 AS BIGINT) AS trails, CAST(sum(ms) AS BIGINT) AS captured_ms, CAST(coalesce(sum(ms) FILTER (reasons = ''), 0) AS BIGINT) AS usable_ms, {_median('hfr')} AS median_hfr FROM z""")
def ref_grading_summary(spark, sf):
    return folder.grading_totals(ref_graded_subs(spark, sf), _subs(spark, sf))


@query()
def ref_graded_by_rules(spark, sf):
    """Subs judged by stated limits instead of those of their group."""
    rules = folder.parse_rules("hfr>3.5, stars<50")
    subs = _subs(spark, sf)
    keys = ["object", "filter_name", "ms"]
    return folder.judge(subs, folder.grading_limits(subs, keys, rules=rules), keys)


@query()
def ref_listing_labels(spark, sf):
    """Files of each label, by all evidence."""
    found = classify.verdicts(_frames(spark, sf), all_cards(spark, sf), read(spark, sf, "hdus"))
    return found.groupBy("label").agg(F.count("*").alias("files"), F.min("confidence").alias("least_confidence"), F.max("confidence").alias("greatest_confidence"))
