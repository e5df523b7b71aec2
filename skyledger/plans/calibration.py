"""Queries on calibration, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.operators import calibration
from skyledger.plans.reference import _LISTED, _R, _frames, _median, query

_OWN = "camera, gain, offset_adu, exposure_s, binning, filter_name, nullif(array_to_string(size, 'x'), '') AS size"
_KEY = f"coalesce(camera, ''), {_R('gain')}, {_R('offset_adu')}, {_R('exposure_s', 1000)}, coalesce(binning, 1), coalesce(filter_name, ''), coalesce(array_to_string(size, 'x'), '')"
_FIRST = lambda keys: ", ".join(f"arg_min_null({k}, frame_id) AS {k}" for k in keys.split())
_SETS = f"""{_LISTED}, q AS (SELECT frame_id, frame, integrated, stack_count, {_OWN}, night, sensor_temp_c, row({_KEY}) AS k, CASE WHEN frame = 'dark' THEN {_R('sensor_temp_c')} ELSE 0 END AS kt, CASE WHEN frame = 'flat' THEN coalesce(night, '') ELSE '' END AS kn FROM e),
ls AS (SELECT frame_id AS first_frame, frame AS kind, true AS master, greatest(coalesce(stack_count, 1), 1) AS frames, camera, gain, offset_adu, exposure_s, binning, filter_name, size, night, sensor_temp_c AS temp_c FROM q WHERE frame IN ('dark', 'flat', 'bias', 'dark_flat') AND integrated
 UNION ALL SELECT min(frame_id), frame, false, count(*), {_FIRST('camera gain offset_adu exposure_s binning filter_name size night')}, {_median('sensor_temp_c')} FROM q WHERE frame IN ('dark', 'flat', 'bias', 'dark_flat') AND NOT integrated GROUP BY frame, k, kt, kn)"""
_GROUPS = f"""lg AS (SELECT min(frame_id) AS first_frame, {_FIRST('camera gain offset_adu exposure_s binning filter_name size')}, {_median('sensor_temp_c')} AS temp_c, bool_or(set_temp_c IS NOT NULL) AS cooled, count(*) AS subs, coalesce(sum(exposure_s), 0) AS integration_s, coalesce(list_sort(list(DISTINCT night) FILTER (night IS NOT NULL)), []) AS nights
 FROM (SELECT *, (SELECT set_temp_c FROM e WHERE e.frame_id = q.frame_id) AS set_temp_c FROM q) WHERE frame = 'light' AND NOT integrated GROUP BY k)"""


def _close(a: str, b: str, within: str) -> str:
    return f"coalesce(abs({a} - {b}) <= greatest({within}::DOUBLE, 1e-6 * abs({a})), true)"


def _best(name: str, of: str, kinds: str, exposure: str, gain: str, offset: str) -> str:
    """The best set of some kinds for each row of `of`."""
    same = lambda a, b: f"coalesce(lower(trim({a})) = lower(trim({b})), true)"
    pairs = f"""{name}_p AS (SELECT g.first_frame AS g, s.*, s.kind = 'flat' AS flat, CASE WHEN s.kind = 'dark' THEN abs(s.temp_c - g.temp_c) END AS apart, CASE WHEN cooled THEN 2 ELSE 3 END AS ok, CASE WHEN cooled THEN 5 ELSE 6 END AS most,
 {same('s.size', 'g.size')} AS size_ok, coalesce(s.binning, 1) = coalesce(g.binning, 1) AS bin_ok, {_close('s.gain', gain, '0.5')} AS gain_ok, {_close('s.offset_adu', offset, '0.5')} AS off_ok, CASE WHEN s.kind IN ('dark', 'dark_flat') THEN {_close('s.exposure_s', exposure, '0.01')} ELSE true END AS exp_ok, {same('s.filter_name', 'g.filter_name')} AS filter_ok,
 s.night IS NOT NULL AND len(g.nights) > 0 AND NOT list_contains(g.nights, s.night) AS other FROM {of} g JOIN ls s ON s.kind IN ({kinds}) AND {same('s.camera', 'g.camera')})"""
    return f"""{pairs}, {name}_s AS (SELECT *, CAST(NOT size_ok AS INT) + CAST(NOT bin_ok AS INT) + CASE WHEN flat THEN CAST(NOT filter_ok AS INT) ELSE CAST(NOT gain_ok AS INT) + CAST(NOT off_ok AS INT) END + CAST(NOT exp_ok AS INT) + coalesce(CAST(apart > most AS INT), 0) AS hard,
 CASE WHEN flat THEN CAST(NOT gain_ok AS INT) + CAST(NOT off_ok AS INT) + CAST(other AS INT) ELSE 0 END + coalesce(CAST(apart > ok AND apart <= most AS INT), 0) AS soft FROM {name}_p),
{name} AS (SELECT * FROM (SELECT g, first_frame AS {name}_set, CASE WHEN hard > 0 THEN 'bad' WHEN soft > 0 THEN 'warn' ELSE 'ok' END AS {name}_status, round(coalesce(apart, 0) + 1000 * hard + 10 * soft + CASE WHEN master THEN 0 ELSE 0.5::DOUBLE END, 4) AS {name}_score, gain AS {name}_gain, offset_adu AS {name}_offset, exposure_s AS {name}_exposure,
 row_number() OVER (PARTITION BY g ORDER BY round(coalesce(apart, 0) + 1000 * hard + 10 * soft + CASE WHEN master THEN 0 ELSE 0.5::DOUBLE END, 4), first_frame, kind) AS r FROM {name}_s) WHERE r = 1)"""


_MATCH = f"""WITH {_SETS}, {_GROUPS}, {_best('dark', 'lg', "'dark'", 'g.exposure_s', 'g.gain', 'g.offset_adu')}, {_best('flat', 'lg', "'flat'", 'NULL', 'g.gain', 'g.offset_adu')},
lf AS (SELECT lg.*, flat_set, CASE WHEN flat_set IS NULL THEN gain ELSE flat_gain END AS want_gain, CASE WHEN flat_set IS NULL THEN offset_adu ELSE flat_offset END AS want_offset, flat_exposure AS want_exposure FROM lg LEFT JOIN flat ON flat.g = lg.first_frame),
{_best('bias', 'lf', "'bias', 'dark_flat'", 'g.want_exposure', 'g.want_gain', 'g.want_offset')},
j AS (SELECT lg.*, dark_set, dark_status, flat.flat_set, flat_status, bias_set, bias_status, coalesce(dark_status, 'bad') = 'bad' AS no_dark, coalesce(flat_status, 'bad') = 'bad' AS no_flat, coalesce(bias_status, 'bad') = 'bad' AND flat.flat_set IS NOT NULL AS no_bias, dark_score, flat_score, bias_score
 FROM lg LEFT JOIN dark ON dark.g = lg.first_frame LEFT JOIN flat ON flat.g = lg.first_frame LEFT JOIN bias ON bias.g = lg.first_frame),
m AS (SELECT *, CASE WHEN NOT no_dark AND NOT no_flat AND NOT no_bias THEN 'ready' WHEN no_dark AND no_flat THEN 'missing' ELSE 'partial' END AS status, integration_s / sum(integration_s) OVER () AS share FROM j)"""


@query(f"WITH {_SETS} SELECT * FROM ls")
def ref_calibration_library(spark, sf):
    """Every set of calibration frames and every master."""
    return calibration.sets(_frames(spark, sf))


@query(f"{_MATCH} SELECT first_frame, camera, filter_name, subs, dark_set, dark_status, dark_score, flat_set, flat_status, flat_score, bias_set, bias_status, bias_score, status, round(share, 9) AS share FROM m")
def ref_calibration_match(spark, sf):
    """Each light group with the darks, flats and bias that fit it best, and whether it can be calibrated."""
    m = calibration.match(_frames(spark, sf))
    part = lambda kind, name: [F.col(f"{kind}.{x}").alias(f"{name}_{x}") for x in ("set", "status", "score")]
    return m.select("first_frame", "camera", "filter_name", "subs", *part("darks", "dark"), *part("flats", "flat"), *part("bias", "bias"), "status", F.round("share", 9).alias("share"))


@query(f"{_MATCH} SELECT count(*) FILTER (status = 'ready') AS ready, count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'missing') AS missing, round(coalesce(sum(share) FILTER (status = 'ready'), 0), 6) AS ready_share FROM m")
def ref_calibration_readiness(spark, sf):
    return calibration.readiness(calibration.match(_frames(spark, sf)))
