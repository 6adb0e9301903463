"""As-of, interval and reference joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.catalog.registry import query
from emberline.operators import joins, kpi
from emberline.plans.lookup import lookup_with_fallback
from emberline.sources.adapters import forecast, history, hourly_load, peak_windows, telemetry, thermostat_states


@query(
    """SELECT t.event_id, t.home_id, coalesce(a.v, b.v, c.v) AS value FROM {moded} t
    LEFT JOIN (SELECT home_id, mode, avg(gap) AS v FROM {moded} GROUP BY 1, 2 HAVING count(*) >= 20) a ON t.home_id = a.home_id AND t.mode = a.mode
    LEFT JOIN (SELECT home_id, avg(gap) AS v FROM {moded} GROUP BY 1 HAVING count(*) >= 65) b ON t.home_id = b.home_id
    CROSS JOIN (SELECT avg(gap) AS v FROM {moded}) c""",
    "value",
)
def lookup_fallback(spark, sf):
    from emberline.functions.scalar import comfort_mode, setpoint_gap

    t = telemetry(spark, sf).select("event_id", "home_id", comfort_mode().alias("mode"), setpoint_gap().alias("gap"))
    mean = lambda keys, n: t.groupBy(*keys).agg(F.avg("gap").alias("v"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= n)
    levels = [(mean(["home_id", "mode"], 20), ["home_id", "mode"]), (mean(["home_id"], 65), ["home_id"]), (mean([], 1), [])]
    return lookup_with_fallback(t, levels, "v", F.lit(0.0), "value").select("event_id", "home_id", "value")


@query("SELECT t.event_id, f.temp FROM {tel} t ASOF LEFT JOIN {fc} f ON t.ts >= f.ts", "temp")
def asof_backward(spark, sf):
    t = telemetry(spark, sf).select("event_id", "ts")
    return joins.asof_join(t, forecast(spark, sf), [], "ts", "temp", "temp").select("event_id", "temp")


@query(
    """SELECT t.event_id, t.home_id, p.v AS last_active FROM {tel} t ASOF LEFT JOIN
      (SELECT home_id, ts, indoor AS v FROM {tel} WHERE (heat_run > 0 OR cool_run > 0) AND indoor IS NOT NULL) p ON t.home_id = p.home_id AND t.ts >= p.ts"""
)
def asof_backward_by_home(spark, sf):
    t = telemetry(spark, sf)
    active = t.where(((F.col("heat_run") > 0) | (F.col("cool_run") > 0)) & F.col("indoor").isNotNull()).select("home_id", "ts", F.col("indoor").alias("v"))
    return joins.asof_join(t.select("event_id", "home_id", "ts"), active, ["home_id"], "ts", "v", "last_active").drop("ts")


@query(
    """SELECT t.event_id, CASE WHEN p.ts = t.ts THEN p.temp WHEN n.ts > p.ts THEN p.temp + (n.temp - p.temp) * ((epoch_us(t.ts) - epoch_us(p.ts))::DOUBLE / (epoch_us(n.ts) - epoch_us(p.ts))) END AS temp
    FROM {tel} t ASOF LEFT JOIN {fc} p ON t.ts >= p.ts ASOF LEFT JOIN {fc} n ON t.ts <= n.ts""",
    "temp",
)
def asof_interpolate(spark, sf):
    t = telemetry(spark, sf).select("event_id", "ts")
    return joins.asof_join(t, forecast(spark, sf), [], "ts", "temp", "temp", "interpolate").select("event_id", "temp")


@query("SELECT state_id, window_start, window_end FROM {picked}")
def active_or_next_window(spark, sf):
    w = joins.active_or_next_window(thermostat_states(spark, sf), peak_windows(spark, sf), 360)
    return w.select("state_id", "window_start", "window_end")


@query(
    """SELECT * FROM (SELECT start, "end", lag("end") OVER (ORDER BY start, "end") AS prev_end FROM (
      SELECT date_trunc('hour', timestamp) AS start, max(timestamp) + INTERVAL 30 MINUTE AS "end" FROM {states} GROUP BY 1)) WHERE start < prev_end"""
)
def window_overlap_check(spark, sf):
    w = thermostat_states(spark, sf).groupBy(F.date_trunc("hour", "timestamp").alias("start")).agg((F.max("timestamp") + F.expr("interval 30 minutes")).alias("end"))
    return joins.overlapping_windows(w)


@query(
    """SELECT k.policy, k.building, k.scenario, greatest(0, coalesce(r.peak_kwh, 0) - k.peak_kwh) AS shifted_kwh, greatest(0, coalesce(r.cost_usd, 0) - k.cost_usd) AS cost_savings_usd
    FROM {kpis} k LEFT JOIN (SELECT * FROM {kpis} WHERE policy = 'baseline') r ON k.building = r.building AND k.scenario = r.scenario""",
    "shifted_kwh cost_savings_usd",
)
def baseline_relative(spark, sf):
    k = kpi.policy_kpis(history(spark, sf), ["policy", "building", "scenario"])
    out = kpi.savings_vs_reference(k, "baseline", ["building", "scenario"])
    return out.select("policy", "building", "scenario", "shifted_kwh", "cost_savings_usd")


@query("SELECT state_id, outdoor_used, forecast_reason FROM {fmean} WHERE until IS NOT NULL", "outdoor_used")
def interval_mean_forecast(spark, sf):
    from emberline.operators.decide import decision_inputs

    d = decision_inputs(thermostat_states(spark, sf), peak_windows(spark, sf), forecast(spark, sf), {})
    return d.where(F.col("forecast_reason").isNotNull()).select("state_id", "outdoor_used", "forecast_reason")


@query("SELECT run, n_days, daily_par FROM {daypar}", "daily_par")
def daily_par(spark, sf):
    return kpi.daily_par(hourly_load(spark, sf), ["run"])


@query(
    """SELECT run, CAST(slot AS BIGINT) AS slot, avg(consumption_kw) AS mean_kw, stddev_pop(consumption_kw) AS std_kw, count(*) AS n_days FROM {blocks}
    WHERE (run, block) IN (SELECT (run, block) FROM {blocks} GROUP BY run, block HAVING count(*) = 24) GROUP BY 1, 2""",
    "mean_kw std_kw",
)
def hourly_load_profile(spark, sf):
    return kpi.hourly_profile(hourly_load(spark, sf), ["run"])


@query("SELECT * FROM {kpis}", "total_kwh peak_kw par peak_kwh comfort_violations_h discomfort_degree_hours max_temp_deviation_f cost_usd")
def policy_kpis(spark, sf):
    return kpi.policy_kpis(history(spark, sf), ["policy", "building", "scenario"])


@query(
    """SELECT l.run, sum(consumption_kw) AS total_kwh, max(consumption_kw) AS peak_kw, avg(consumption_kw) AS mean_kw, max(consumption_kw) / avg(consumption_kw) AS par, any_value(daily_par) AS daily_par,
      any_value(r) AS ramping, any_value(f) AS load_factor FROM {load} l JOIN {daypar} d ON l.run = d.run JOIN (SELECT event_type AS run, max(value) AS r, avg(value) AS f FROM events GROUP BY 1) k ON l.run = k.run GROUP BY 1""",
    "total_kwh peak_kw mean_kw par daily_par ramping load_factor",
)
def controller_summary(spark, sf):
    from emberline.sources.adapters import table

    e = table(spark, sf, "events").groupBy(F.col("event_type").alias("run")).agg(F.max("value").alias("ramping"), F.avg("value").alias("load_factor"))
    long = e.unpivot("run", ["ramping", "load_factor"], "cost_function", "value")
    return kpi.controller_summary(hourly_load(spark, sf), long, ["ramping", "load_factor"])



@query(
    """SELECT run, unnest(list_filter([{'check': 'Energy ratio', 'passed': e / b BETWEEN 0.5 AND 2, 'message': printf('%.3f', e / b)},
        {'check': 'Non-negative consumption', 'passed': mn >= 0, 'message': 'min=' || printf('%.2f', mn)},
        CASE WHEN NOT (t0 >= 5 AND t1 <= 35) THEN {'check': 'Temp bounds', 'passed': false, 'message': '[' || printf('%.1f', t0) || ', ' || printf('%.1f', t1) || ']'} END,
        {'check': 'No NaN in consumption', 'passed': NOT has_nan, 'message': ''},
        {'check': 'Consumption stats', 'passed': true, 'message': 'mean=' || printf('%.1f', av) || ', max=' || printf('%.1f', mx) || ' kW'}], lambda x : x IS NOT NULL), recursive := true)
    FROM (SELECT run, sum(consumption_kw) AS e, min(consumption_kw) AS mn, max(consumption_kw) AS mx, avg(consumption_kw) AS av, max(isnan(consumption_kw)) AS has_nan, min(temp_c) AS t0, max(temp_c) AS t1 FROM {load} GROUP BY 1),
      (SELECT sum(consumption_kw) AS b FROM {load} WHERE run = 'view')"""
)
def sanity_checks(spark, sf):
    return kpi.sanity_checks(hourly_load(spark, sf), "view")


@query("SELECT DISTINCT 'no such run' AS run, 'Baseline exists' AS check, false AS passed, 'No baseline results' AS message FROM {load}")
def sanity_checks_without_baseline(spark, sf):
    return kpi.sanity_checks(hourly_load(spark, sf), "no such run")
