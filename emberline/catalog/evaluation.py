"""Streams of sessions, survival data, paired comparisons and noisy forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.catalog.episodes import segments
from emberline.catalog.registry import query
from emberline.catalog.sqltext import CTES, RECURSIVE
from emberline.operators import inference, kpi, noise, survival
from emberline.plans.staging import stage_path
from emberline.sources.adapters import MAX_GAP_MIN, forecast, history, telemetry_stream
from emberline.streaming.sessions import stream_mode_sessions as run_sessions

# -- mode sessions: what the watermark of the whole stream has passed ---------------------------------
CTES["passed"] = "SELECT *, w FROM {moded}, (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR AS w FROM {moded}) WHERE ts <= w"
CTES["sessions"] = """
SELECT home_id, run, mode, min(ts) AS start_ts, max(ts) AS last_ts, count(*) AS duration_steps, max(gap) AS max_gap, avg(gap) AS mean_gap, any_value(w) AS w,
  max(run) OVER (PARTITION BY home_id) AS latest
FROM (SELECT *, sum(CASE WHEN mode = pm AND epoch_us(ts) - epoch_us(pts) <= 86400000000 THEN 0 ELSE 1 END) OVER (PARTITION BY home_id ORDER BY ts, event_id) AS run
  FROM (SELECT *, lag(mode) OVER o AS pm, lag(ts) OVER o AS pts FROM {passed} WINDOW o AS (PARTITION BY home_id ORDER BY ts, event_id)))
GROUP BY home_id, run, mode"""


@query(
    """SELECT home_id, CAST(run AS BIGINT) AS run, mode, start_ts, duration_steps, max_gap, mean_gap FROM {sessions}
    WHERE mode IN ('heating', 'cooling') AND (run < latest OR last_ts + INTERVAL 1 DAY < w)""",
    "max_gap mean_gap",
)
def stream_mode_sessions(spark, sf):
    path = stage_path(spark, "mode-sessions")
    key = "spark.sql.shuffle.partitions"
    # The number of state stores is fixed for the life of a stream; this one is short.
    partitions = spark.conf.get(key)
    spark.conf.set(key, str(min(int(partitions), 8)))
    try:
        run_sessions(telemetry_stream(spark, sf), path, f"{path}-state", max_gap_min=MAX_GAP_MIN, delay="1 hour").awaitTermination()
    finally:
        spark.conf.set(key, partitions)
    return spark.read.parquet(path)


# -- survival -----------------------------------------------------------------------------------------
CTES["hazard"] = """
SELECT s.home_id, s.month, s.seg_rn, s.event_id, s.timestep_idx, s.timestep_idx * 5 AS elapsed_min, p.drift_direction, s.indoor, p.boundary_temp, timestep_idx < n_rows - 1 AS at_risk,
  coalesce(timestep_idx + 1 = crossing_timestep_idx, false) AS event, crossing_timestep_idx IS NULL AND timestep_idx = n_rows - 1 AS censored
FROM {segs} s JOIN {passages} p USING (home_id, month, seg_rn) WHERE eligible AND (crossing_timestep_idx IS NULL OR timestep_idx < crossing_timestep_idx)"""
CTES["risk"] = """
SELECT drift_direction, timestep_idx, count(*) FILTER (at_risk) AS n_risk, count(*) FILTER (event AND at_risk) AS n_events, count(*) FILTER (censored) AS n_censored FROM {hazard} GROUP BY ALL"""
CTES["limits"] = """
SELECT *, n_events::DOUBLE / n_risk AS hazard, CASE WHEN bool_or(n_events >= n_risk) OVER w THEN 0 ELSE exp(sum(CASE WHEN n_events < n_risk THEN ln(1 - n_events::DOUBLE / n_risk) ELSE 0 END) OVER w) END::DOUBLE AS survival,
  sum(CASE WHEN n_events < n_risk THEN n_events::DOUBLE / (n_risk::DOUBLE * (n_risk - n_events)) ELSE 0 END) OVER w AS terms
FROM {risk} WHERE n_risk > 0 WINDOW w AS (PARTITION BY drift_direction ORDER BY timestep_idx ROWS UNBOUNDED PRECEDING)"""


@query("SELECT * FROM {hazard}")
def hazard_steps(spark, sf):
    cols = ["home_id", "month", "seg_rn", "event_id", "timestep_idx", "elapsed_min", "drift_direction", "indoor", "boundary_temp", "at_risk", "event", "censored"]
    return survival.hazard_steps(segments(spark, sf)).select(*cols)


@query(
    """SELECT * EXCLUDE (terms), survival * survival * terms AS variance, least(greatest(survival - 1.959963984540054 * sqrt(survival * survival * terms), 0), 1) AS lower,
      least(greatest(survival + 1.959963984540054 * sqrt(survival * survival * terms), 0), 1) AS upper FROM {limits}""",
    "hazard survival variance lower upper",
)
def survival_curve(spark, sf):
    return survival.survival_curve(survival.hazard_steps(segments(spark, sf)), ["drift_direction"])


# -- paired comparisons -------------------------------------------------------------------------------
CTES["paired"] = """
SELECT k.policy, k.building, k.scenario, r.total_kwh - k.total_kwh AS diff FROM {kpis} k JOIN {kpis} r
ON k.building = r.building AND k.scenario = r.scenario AND r.policy = 'baseline' AND k.policy <> 'baseline'"""
_HEX = "('0x' || substr(md5({}), 1, 7))::BIGINT"
CTES["resampled"] = f"""
SELECT policy, scenario, b, sum(times * diff) / nullif(sum(times), 0) AS m FROM (
  SELECT *, len(list_filter({[float(x) for x in inference.POISSON]}, lambda x: x <= ((h * a + c) % {inference.PRIME})::DOUBLE / {inference.PRIME})) AS times
  FROM (SELECT *, {_HEX.format("concat_ws('|', policy, building, scenario)")} AS h FROM {{paired}}),
    (SELECT b, {_HEX.format("'42:' || b || ':a'")} + 1 AS a, {_HEX.format("'42:' || b || ':c'")} + 1 AS c FROM range(0, 200) r(b)))
GROUP BY policy, scenario, b"""
CTES["ranked"] = """
SELECT *, rank() OVER (PARTITION BY policy, scenario ORDER BY abs(diff)) + (count(*) OVER s - 1) / 2.0::DOUBLE AS rnk, count(*) OVER s AS t
FROM {paired} WHERE diff <> 0 WINDOW s AS (PARTITION BY policy, scenario, abs(diff))"""
CTES["tested"] = """
SELECT p.policy, p.scenario, n, coalesce(n_nonzero, 0) AS n_nonzero, coalesce(w_plus, 0) AS w_plus,
  CASE WHEN spread > 0 THEN sign(off) * greatest(abs(off) - 0.5, 0) / spread ELSE 0 END::DOUBLE AS z
FROM (SELECT policy, scenario, count(*) AS n FROM {paired} GROUP BY 1, 2) p LEFT JOIN (
  SELECT *, w_plus - n_nonzero * (n_nonzero + 1) / 4.0::DOUBLE AS off, sqrt(n_nonzero::DOUBLE * (n_nonzero + 1) * (2 * n_nonzero + 1) / 24 - ties / 48) AS spread FROM (
    SELECT policy, scenario, count(*) AS n_nonzero, sum(rnk) FILTER (diff > 0) AS w_plus, sum(t::DOUBLE * t - 1) AS ties FROM {ranked} GROUP BY 1, 2)) r USING (policy, scenario)"""
CTES["tailed"] = """
SELECT * EXCLUDE (t), least(2 * exp(-z * z / 2) / sqrt(2 * pi()) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))), 1)::DOUBLE AS p_value
FROM (SELECT *, 1 / (1 + 0.2316419::DOUBLE * abs(z)) AS t FROM {tested})"""


def policy_differences(spark, sf):
    k = kpi.policy_kpis(history(spark, sf), ["policy", "building", "scenario"])
    return inference.paired_differences(k, F.col("policy") == "baseline", ["building", "scenario"], "total_kwh")


@query(
    """SELECT policy, scenario, n, mean, q25, median, q75, ci_low, ci_high FROM (
      SELECT policy, scenario, count(*) AS n, avg(diff) AS mean, quantile_cont(diff, 0.25) AS q25, quantile_cont(diff, 0.5) AS median, quantile_cont(diff, 0.75) AS q75 FROM {paired} GROUP BY 1, 2)
    JOIN (SELECT policy, scenario, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM {resampled} GROUP BY 1, 2) USING (policy, scenario)""",
    "mean q25 median q75 ci_low ci_high",
)
def bootstrap_intervals(spark, sf):
    return inference.bootstrap_mean(policy_differences(spark, sf), ["policy", "scenario"], F.concat_ws("|", "policy", "building", "scenario"))


@query(
    """SELECT * EXCLUDE (k, scaled), max(scaled) OVER (ORDER BY k) AS p_holm FROM (
      SELECT *, least((count(*) OVER () - k + 1) * p_value, 1) AS scaled FROM (SELECT *, row_number() OVER (ORDER BY p_value, policy, scenario) AS k FROM {tailed}))""",
    "w_plus z p_value p_holm",
)
def signed_rank_tests(spark, sf):
    return inference.signed_rank(policy_differences(spark, sf), ["policy", "scenario"])


# -- noisy forecasts: one recursive step per row ------------------------------------------------------
_UNIFORM = "((('0x' || substr(md5(concat_ws(':', k, seed, '{}')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)"
CTES["shocks"] = f"""
SELECT *, least(0.5 + 0.25 * (epoch_us(ts) - epoch_us(first)) / 3600000000.0::DOUBLE, 4) * sqrt(-2 * ln({_UNIFORM.format("a")})) * cos(2 * pi() * {_UNIFORM.format("b")}) AS shock
FROM (SELECT *, row_number() OVER (ORDER BY ts, temp) AS k, min(ts) OVER () AS first FROM {{fc}}), (VALUES (1), (2), (3)) v(seed)"""
CTES["errors"] = """
SELECT seed, k, shock::DOUBLE AS error FROM {shocks} WHERE k = 1
UNION ALL SELECT s.seed, s.k, 0.7::DOUBLE * e.error + s.shock FROM errors e JOIN {shocks} s ON s.seed = e.seed AND s.k = e.k + 1"""
RECURSIVE.add("errors")


@query("SELECT ts, temp, seed, error, temp + error AS forecast FROM {shocks} JOIN {errors} USING (seed, k)", "temp error forecast")
def ar1_forecast(spark, sf):
    return noise.forecast_noise(forecast(spark, sf), [], [1, 2, 3])
