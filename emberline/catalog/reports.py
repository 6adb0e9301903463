"""Error reports over the log-log model's predictions and the horizon baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.catalog.episodes import responses, sparse_horizon
from emberline.catalog.registry import query
from emberline.catalog.sqltext import CTES
from emberline.operators import metrics, rates, samples
from emberline.plans.staging import stage
from emberline.sources.adapters import home_dim


def active_split(spark, sf):
    """Written once: the fit and the scoring both read it."""
    a = stage(samples.active_episode_samples(responses(spark, sf)), "active-samples")
    return stage(samples.within_group_split(a, ["home_id"], "episode_id"), "active-split")


def predictions(spark, sf):
    s = active_split(spark, sf)
    p = rates.predict_log_log(s.where("is_train"), s.where("not is_train"), "change_type", "log_gap", (3.5, 1.0))
    out = p.join(home_dim(spark, sf), "home_id", "left").select(
        F.lit("log_log").alias("model"), "episode_id", "event_id", "home_id", F.col("duration_min").cast("double").alias("actual"), "pred", "change_type",
        "initial_gap", "abs_gap", "system_running", "state", "month", "hour", "outdoor_temp",
    )
    return stage(out, "predictions")  # reports read it several times


def horizon_split(spark, sf):
    split = samples.stratified_split(home_dim(spark, sf), "home_id", "state")
    return stage(samples.cross_group_split(sparse_horizon(spark, sf), split, "home_id"), "horizon-split")


def horizon_predictions(spark, sf):
    s = horizon_split(spark, sf)
    train, test = s.where("is_train"), s.where("not is_train")
    models = {
        "persistence": rates.predict_persistence(test, "indoor"),
        "drive_line": rates.drift_regression(train, test, []),
        "mode_aware": rates.mode_aware_drift(train, test, []),
    }
    out = None
    for name, p in models.items():
        one = p.select(F.lit(name).alias("model"), "home_id", "event_id", F.col("target").alias("actual"), "pred", "mode")
        out = one if out is None else out.unionByName(one)
    return stage(out, "horizon-predictions")


_ERR = """count(*) AS n, avg(abs(pred - actual)) AS mae, sqrt(avg((pred - actual) * (pred - actual))) AS rmse, max(abs(pred - actual)) AS max_error, avg(pred - actual) AS bias, stddev_samp(abs(pred - actual)) AS std_ae,
  CASE WHEN var_pop(actual) > 1e-12 THEN 1 - sum((pred - actual) * (pred - actual)) / (var_pop(actual) * count(*)) ELSE 0 END AS r2, coalesce(avg(abs(pred - actual) / actual) FILTER (actual > 1) * 100, 0) AS mape,
  quantile_cont(abs(pred - actual), 0.5) AS median_ae, quantile_cont(abs(pred - actual), 0.75) AS p75, quantile_cont(abs(pred - actual), 0.9) AS p90, quantile_cont(abs(pred - actual), 0.95) AS p95, quantile_cont(abs(pred - actual), 0.99) AS p99"""
_ERR_COLS = "mae rmse max_error bias std_ae r2 mape median_ae p75 p90 p95 p99"
_STRAT = """count(*) AS n, avg(abs(pred - actual)) AS mae, sqrt(avg((pred - actual) * (pred - actual))) AS rmse, avg(pred - actual) AS bias, coalesce(avg(abs(pred - actual) / actual) FILTER (actual > 1) * 100, 0) AS mape"""

CTES["hpreds"] = """
SELECT 'persistence' AS model, home_id, event_id, target AS actual, indoor AS pred, mode FROM {hsplit} WHERE NOT is_train
UNION ALL SELECT 'drive_line', home_id, event_id, target, indoor + a + b * outdoor_drive, mode FROM {hsplit},
  (SELECT regr_slope(target - indoor, outdoor_drive) AS b, regr_intercept(target - indoor, outdoor_drive) AS a FROM {hsplit} WHERE is_train) WHERE NOT is_train
UNION ALL SELECT 'mode_aware', t.home_id, t.event_id, t.target, indoor + coalesce(k, 0) * (CASE t.mode WHEN 'heating' THEN heat_sp WHEN 'cooling' THEN cool_sp ELSE outdoor_future END - indoor), t.mode
  FROM {hsplit} t LEFT JOIN (SELECT mode, sum(x * y) / (sum(x * x) + 1e-8) AS k FROM (SELECT mode, target - indoor AS y, CASE mode WHEN 'heating' THEN heat_sp WHEN 'cooling' THEN cool_sp ELSE outdoor_future END - indoor AS x FROM {hsplit} WHERE is_train) GROUP BY 1) f ON t.mode = f.mode
  WHERE NOT is_train"""


@query(f"SELECT model, mode, {_ERR} FROM {{hpreds}} GROUP BY 1, 2", _ERR_COLS)
def error_metrics(spark, sf):
    return metrics.error_metrics(horizon_predictions(spark, sf), ["model", "mode"])


@query(f"SELECT model, {_ERR} FROM {{preds}} GROUP BY 1", _ERR_COLS)
def error_metrics_active(spark, sf):
    return metrics.error_metrics(predictions(spark, sf), ["model"])


@query(
    f"""SELECT model, dim, stratum, {_STRAT} FROM (SELECT *, unnest([{{'dim': 'duration', 'stratum': CASE WHEN actual <= 15 THEN '<15min' WHEN actual <= 30 THEN '15-30' WHEN actual <= 60 THEN '30-60' WHEN actual <= 120 THEN '60-120' WHEN actual <= 240 THEN '120-240' WHEN actual <= 1000 THEN '>240' END}},
      {{'dim': 'gap', 'stratum': CASE WHEN abs_gap <= 0 THEN NULL WHEN abs_gap <= 1 THEN '0-1F' WHEN abs_gap <= 2 THEN '1-2F' WHEN abs_gap <= 3 THEN '2-3F' WHEN abs_gap <= 5 THEN '3-5F' WHEN abs_gap <= 10 THEN '5-10F' WHEN abs_gap <= 20 THEN '>10F' END}},
      {{'dim': 'change_type', 'stratum': change_type}}, {{'dim': 'system_running', 'stratum': CASE WHEN system_running = 1 THEN 'running' ELSE 'not running' END}}, {{'dim': 'state', 'stratum': state}}, {{'dim': 'month', 'stratum': month::VARCHAR}},
      {{'dim': 'hour', 'stratum': CASE WHEN hour <= 6 THEN 'night' WHEN hour <= 12 THEN 'morning' WHEN hour <= 18 THEN 'afternoon' ELSE 'evening' END}},
      {{'dim': 'outdoor', 'stratum': CASE WHEN outdoor_temp <= 32 THEN '<32F' WHEN outdoor_temp <= 50 THEN '32-50F' WHEN outdoor_temp <= 70 THEN '50-70F' WHEN outdoor_temp <= 85 THEN '70-85F' WHEN outdoor_temp <= 120 THEN '>85F' END}}], recursive := true) FROM {{preds}})
    WHERE stratum IS NOT NULL GROUP BY 1, 2, 3""",
    "mae rmse bias mape",
)
def stratified_metrics(spark, sf):
    return metrics.stratified_metrics(predictions(spark, sf), metrics.error_strata(), ["model"])


CTES["gpreds"] = """
SELECT 'gap' AS model, change_type, current_gap, timestep_idx, y_true AS actual, current_temp + k * current_gap AS pred FROM {esplit},
  (SELECT sum(current_gap * (y_true - current_temp)) / (sum(current_gap * current_gap) + 1e-8) AS k FROM {esplit} WHERE is_train) WHERE NOT is_train"""


@query(
    f"""SELECT model, dim, stratum, {_STRAT} FROM (SELECT *, unnest([{{'dim': 'change_type', 'stratum': change_type}}, {{'dim': 'gap', 'stratum': CASE WHEN abs(current_gap) < 1 THEN '0-1F' WHEN abs(current_gap) < 2 THEN '1-2F' WHEN abs(current_gap) < 3 THEN '2-3F' WHEN abs(current_gap) < 5 THEN '3-5F' WHEN abs(current_gap) < 100 THEN '>5F' END}},
      {{'dim': 'stage', 'stratum': CASE WHEN timestep_idx < 2 THEN 'early' WHEN timestep_idx < 6 THEN 'mid' WHEN timestep_idx < 1000 THEN 'late' END}}], recursive := true) FROM {{gpreds}}) WHERE stratum IS NOT NULL GROUP BY 1, 2, 3""",
    "mae rmse bias mape",
)
def stratified_window_metrics(spark, sf):
    from emberline.catalog.models import window_split

    s = window_split(spark, sf)
    p = rates.gap_fraction(s.where("is_train"), s.where("not is_train"), "global").select(
        F.lit("gap").alias("model"), "change_type", "current_gap", "timestep_idx", F.col("y_true").alias("actual"), "pred"
    )
    strata = {"change_type": F.col("change_type"), "gap": metrics.step_gap_bucket("current_gap"), "stage": metrics.stage_bucket("timestep_idx")}
    return metrics.stratified_metrics(p, strata, ["model"])


@query(
    "SELECT home_id, avg(abs(pred - actual)) AS mae, stddev_samp(abs(pred - actual)) AS std, count(*) AS n_episodes, avg(pred - actual) AS bias, avg(actual) AS avg_duration FROM {preds} GROUP BY 1",
    "mae std bias avg_duration",
)
def per_home_error_stats(spark, sf):
    return metrics.per_home_errors(predictions(spark, sf))


@query(
    """SELECT bucket, count(*) AS n, avg(abs(pred - actual)) AS mae, avg(pred - actual) AS bias, avg(actual) AS mean_actual, avg(pred) AS mean_pred FROM
      (SELECT *, CASE WHEN pred <= 0 THEN NULL WHEN pred <= 20 THEN '<20min' WHEN pred <= 40 THEN '20-40' WHEN pred <= 60 THEN '40-60' WHEN pred <= 100 THEN '60-100' WHEN pred <= 200 THEN '100-200' WHEN pred <= 1000 THEN '>200' END AS bucket FROM {preds})
    WHERE bucket IS NOT NULL GROUP BY 1""",
    "mae bias mean_actual mean_pred",
)
def calibration_table(spark, sf):
    return metrics.calibration(predictions(spark, sf))


@query(
    """SELECT count(*) FILTER (pred < actual) AS n_under, avg((pred < actual)::INT) * 100 AS under_pct, avg(pred - actual) FILTER (pred < actual) AS under_mean_error,
      count(*) FILTER (pred > actual) AS n_over, avg((pred > actual)::INT) * 100 AS over_pct, avg(pred - actual) FILTER (pred > actual) AS over_mean_error FROM {preds}""",
    "under_pct under_mean_error over_pct over_mean_error",
)
def under_over_split(spark, sf):
    return metrics.under_over(predictions(spark, sf))


@query(
    """SELECT dim, stratum, sum(tail)::BIGINT AS n_tail, count(*) AS n_all, 100.0::DOUBLE * sum(tail) / sum(sum(tail)) OVER (PARTITION BY dim) AS tail_pct, 100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY dim) AS overall_pct
    FROM (SELECT tail, unnest([{'dim': 'duration', 'stratum': CASE WHEN actual <= 15 THEN '<15min' WHEN actual <= 30 THEN '15-30' WHEN actual <= 60 THEN '30-60' WHEN actual <= 120 THEN '60-120' WHEN actual <= 240 THEN '120-240' WHEN actual <= 1000 THEN '>240' END},
        {'dim': 'change_type', 'stratum': change_type}, {'dim': 'system_running', 'stratum': CASE WHEN system_running = 1 THEN 'running' ELSE 'not running' END}], recursive := true)
      FROM (SELECT *, (abs(pred - actual) > (SELECT quantile_cont(abs(pred - actual), 0.95) FROM {preds}))::INT AS tail FROM {preds})) WHERE stratum IS NOT NULL GROUP BY 1, 2""",
    "tail_pct overall_pct",
)
def tail_breakdown(spark, sf):
    return metrics.tail_breakdown(predictions(spark, sf))


@query(
    """SELECT * FROM (SELECT kind, n, 100.0::DOUBLE * n / sum(n) OVER () AS pct, mae, bias, 100 * a / sum(a) OVER () AS error_share_pct FROM (
      SELECT CASE WHEN actual > 10 THEN 'long' WHEN actual < 10 THEN 'short' ELSE 'other' END AS kind, count(*) AS n, avg(abs(pred - actual)) AS mae, avg(pred - actual) AS bias, sum(abs(pred - actual)) AS a FROM {preds} GROUP BY 1)
) WHERE kind <> 'other'""",
    "pct mae bias error_share_pct",
)
def error_contribution(spark, sf):
    return metrics.error_contribution(predictions(spark, sf), long_over=10, short_under=10)


@query(
    """SELECT episode_id, actual, pred, pred - actual AS error, abs_gap, change_type, system_running, state, outdoor_temp FROM {preds} ORDER BY abs(pred - actual) DESC, episode_id LIMIT 20""",
    "pred error",
)
def worst_predictions(spark, sf):
    from emberline.operators.profile import top_k

    p = predictions(spark, sf)
    top = top_k(p, [F.round(metrics.abs_err(), 9).desc(), F.col("episode_id")], 20)
    return top.select("episode_id", "actual", "pred", metrics.err().alias("error"), "abs_gap", "change_type", "system_running", "state", "outdoor_temp")


CTES["hstats"] = """
SELECT home_id, round(avg(abs(pred - actual)), 9) AS mae, stddev_samp(abs(pred - actual)) AS std, count(*) AS n_episodes, avg(pred - actual) AS bias, avg(actual) AS avg_duration FROM {preds} GROUP BY 1 HAVING count(*) >= 2"""
CTES["hard"] = """
SELECT * FROM (SELECT *, 'hard' AS label FROM {hstats} ORDER BY mae DESC, home_id LIMIT 10) UNION ALL SELECT * FROM (SELECT *, 'easy' AS label FROM {hstats} ORDER BY mae, home_id LIMIT 10)"""


def home_labels(p):
    h = metrics.per_home_errors(p).withColumn("mae", F.round("mae", 9))
    return metrics.hardest_easiest(h, 10, 2)


@query("SELECT * FROM {hard}", "mae std bias avg_duration")
def hardest_easiest_homes(spark, sf):
    return home_labels(predictions(spark, sf))


@query(
    "SELECT label, count(*) AS n, avg(abs_gap) AS abs_gap, avg(actual) AS actual, avg(outdoor_temp) AS outdoor_temp, avg(system_running) AS system_running FROM {preds} JOIN {hard} USING (home_id) GROUP BY 1",
    "abs_gap actual outdoor_temp system_running",
)
def hard_vs_easy_profile(spark, sf):
    p = predictions(spark, sf)
    return metrics.group_profile(p, home_labels(p), ["abs_gap", "actual", "outdoor_temp", "system_running"])


@query(
    """SELECT model, mae, 100 * (b - mae) / b AS improvement_pct FROM (SELECT model, avg(abs(pred - actual)) AS mae FROM {hpreds} GROUP BY 1), (SELECT avg(abs(pred - actual)) AS b FROM {hpreds} WHERE model = 'persistence')""",
    "mae improvement_pct",
)
def improvement_vs_baseline(spark, sf):
    m = metrics.error_metrics(horizon_predictions(spark, sf), ["model"])
    return metrics.improvement(m, "persistence")


CTES["rpreds"] = """
SELECT 'minutes_per_degree' AS model, initial_gap, elapsed_min, remaining_min::DOUBLE AS actual, k * abs(current_gap) AS pred FROM {rsplit},
  (SELECT sum(abs(current_gap) * remaining_min) / (sum(current_gap * current_gap) + 1e-8) AS k FROM {rsplit} WHERE is_train) WHERE NOT is_train"""


@query(
    f"""SELECT model, dim, stratum, {_STRAT} FROM (SELECT *, unnest([{{'dim': 'initial_gap', 'stratum': CASE WHEN abs(initial_gap) < 1 THEN NULL WHEN abs(initial_gap) < 2 THEN '1-2F' WHEN abs(initial_gap) < 3 THEN '2-3F' WHEN abs(initial_gap) < 5 THEN '3-5F' WHEN abs(initial_gap) < 100 THEN '>5F' END}},
      {{'dim': 'elapsed', 'stratum': CASE WHEN elapsed_min < 5 THEN 'start' WHEN elapsed_min < 15 THEN 'early' WHEN elapsed_min < 30 THEN 'mid' WHEN elapsed_min < 10000 THEN 'late' END}}], recursive := true) FROM {{rpreds}}) WHERE stratum IS NOT NULL GROUP BY 1, 2, 3""",
    "mae rmse bias mape",
)
def stratified_setpoint_metrics(spark, sf):
    """Remaining minutes of setpoint responses, by initial gap and minutes since the change."""
    from emberline.catalog.models import remaining_split
    from emberline.catalog.models import parts as train_and_test

    train, test = train_and_test(remaining_split(spark, sf))
    p = rates.minutes_per_degree(train, test, "global").select(
        F.lit("minutes_per_degree").alias("model"), "initial_gap", "elapsed_min", F.col("remaining_min").cast("double").alias("actual"), "pred"
    )
    return metrics.stratified_metrics(p, metrics.setpoint_strata(), ["model"])
