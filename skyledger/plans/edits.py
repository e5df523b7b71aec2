"""Queries on planned edits, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.operators import edits
from skyledger.plans.reference import _SQL_PRIVATE, query
from skyledger.session import read

#: Staged edits: a value, a keyword under another name, a site taken out, a line of history.
OPS = [edits.Op("set", "OBSERVER", "nobody"), edits.Op("set", "OBSERVER", "archive"), edits.Op("rename", "CAMGAIN", "GAIN"), edits.Op("unset", "SITELAT"), edits.Op("history", value="checked")]


def _planned(spark, sf):
    return edits.plan(read(spark, sf, "cards"), OPS)


_SQL_EDITS = """c AS (SELECT DISTINCT * FROM cards), v AS (SELECT * FROM c WHERE value_type <> 'commentary'), u AS (SELECT DISTINCT frame_id, hdu FROM c),
w AS (SELECT *, CASE WHEN value_type = 'string' THEN '''' || trim(coalesce(value_text, '')) || '''' ELSE coalesce(value_text, '') END AS shown FROM v),
f AS (SELECT frame_id, hdu, keyword, arg_min(shown, record) AS shown FROM w GROUP BY 1, 2, 3), bad AS (SELECT frame_id, hdu FROM f WHERE keyword = 'GAIN'), ok AS (SELECT * FROM u ANTI JOIN bad USING (frame_id, hdu)),
x AS (SELECT frame_id, hdu, CASE WHEN shown IS NULL THEN 'added' ELSE 'modified' END AS kind, 'OBSERVER' AS keyword, shown AS before, '''archive''' AS after FROM ok LEFT JOIN (SELECT * FROM f WHERE keyword = 'OBSERVER') USING (frame_id, hdu) WHERE shown IS DISTINCT FROM '''archive'''
 UNION ALL SELECT frame_id, hdu, 'renamed', 'CAMGAIN->GAIN', 'CAMGAIN = ' || shown, 'GAIN = ' || shown FROM ok JOIN f USING (frame_id, hdu) WHERE keyword = 'CAMGAIN'
 UNION ALL SELECT frame_id, hdu, 'removed', 'SITELAT', shown, NULL FROM ok JOIN w USING (frame_id, hdu) WHERE keyword = 'SITELAT' UNION ALL SELECT frame_id, hdu, 'history', 'HISTORY', NULL, 'checked' FROM ok)"""


@query(f"WITH {_SQL_EDITS} SELECT * FROM x")
def ref_edits(spark, sf):
    """Every change that the staged edits would make, unit by unit."""
    return edits.changes(_planned(spark, sf))


@query(f"WITH {_SQL_EDITS} SELECT frame_id, hdu, 'cannot rename CAMGAIN to GAIN: GAIN already exists' AS refused FROM u JOIN bad USING (frame_id, hdu)")
def ref_edits_refused(spark, sf):
    return _planned(spark, sf).filter("refused IS NOT NULL").select("frame_id", "hdu", "refused")


@query()
def ref_edit_totals(spark, sf):
    """What the staged edits would do to the whole batch."""
    return edits.totals(_planned(spark, sf))


@query(f"SELECT DISTINCT frame_id, hdu, keyword, 'unset' AS op, CAST(NULL AS VARCHAR) AS value FROM cards WHERE value_type <> 'commentary' AND {_SQL_PRIVATE}")
def ref_scrub_ops(spark, sf):
    """What takes places, persons and serial numbers out of each header unit."""
    return edits.scrub(read(spark, sf, "cards"))


@query("""WITH c AS (SELECT DISTINCT frame_id, hdu, record, keyword, trim(value_text) AS line FROM cards WHERE keyword IN ('HISTORY', 'COMMENT'))
SELECT frame_id, keyword, string_agg(coalesce(line, ''), chr(10) ORDER BY hdu, record) AS lines, count(*) AS n FROM c GROUP BY 1, 2""")
def ref_commentary(spark, sf):
    """Each file's history and comments, in order."""
    c = read(spark, sf, "cards").filter(F.col("keyword").isin("HISTORY", "COMMENT")).select("frame_id", "hdu", "record", "keyword", F.trim("value_text").alias("line")).distinct()
    lines = F.transform(F.array_sort(F.collect_list(F.struct("hdu", "record", F.coalesce("line", F.lit("")).alias("line")))), lambda x: x["line"])
    return c.groupBy("frame_id", "keyword").agg(F.array_join(lines, "\n").alias("lines"), F.count("*").alias("n"))
