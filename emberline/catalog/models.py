"""Model fits and predictions."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.catalog.episodes import drift_table, responses, sparse_horizon
from emberline.catalog.olssql import ols_ctes
from emberline.catalog.registry import query
from emberline.catalog.reports import active_split, horizon_split
from emberline.catalog.sqltext import CTES
from emberline.operators import boosting, metrics, rates, regress, samples
from emberline.plans.lookup import beside
from emberline.plans.staging import stage
from emberline.sources.adapters import thermostat_states

# All documented parameters but the number of trees: 200 take minutes a model on one machine. It is the operators' default.
TREES = {"maxIter": 20}


def split_of(e: DataFrame, name: str, min_units: int) -> DataFrame:
    """Samples are written before the split reads them twice, and the split before fit and score read it."""
    return stage(samples.within_group_split(stage(e, name), ["home_id"], "episode_id", min_units=min_units), name)


def window_split(spark, sf):
    return split_of(samples.episode_windows(responses(spark, sf), horizon=1), "window-split", 2)


def remaining_split(spark, sf):
    return split_of(samples.elapsed_remaining(responses(spark, sf)), "remaining-split", 2)


def drift_split(spark, sf):
    return split_of(samples.drift_samples(drift_table(spark, sf)), "drift-split", 1)


def home_horizon_split(spark, sf):
    return stage(samples.temporal_split(sparse_horizon(spark, sf), min_samples=10, min_test=3), "home-horizon-split")


def parts(s: DataFrame) -> tuple[DataFrame, DataFrame]:
    return s.where("is_train"), s.where("not is_train")


def stacked(models: dict[str, DataFrame], *cols: str) -> DataFrame:
    keep = cols or ("event_id", "pred")
    return reduce(DataFrame.unionByName, [p.select(F.lit(n).alias("model"), *keep) for n, p in models.items()])


@query("SELECT event_id, target, indoor AS pred FROM {hsplit} WHERE NOT is_train")
def predict_persistence(spark, sf):
    _, test = parts(horizon_split(spark, sf))
    return rates.predict_persistence(test, "indoor").select("event_id", "target", "pred")


@query("SELECT event_id, y_true, target_setpoint AS pred FROM {esplit} WHERE NOT is_train")
def predict_target(spark, sf):
    _, test = parts(window_split(spark, sf))
    return rates.predict_persistence(test, "target_setpoint").select("event_id", "y_true", "pred")


@query("SELECT event_id, pred FROM {rsplit}, (SELECT avg(remaining_min) AS pred FROM {rsplit} WHERE is_train) WHERE NOT is_train", "pred")
def predict_global_mean(spark, sf):
    return rates.predict_global_mean(*parts(remaining_split(spark, sf)), "remaining_min").select("event_id", "pred")


@query("SELECT event_id, pred FROM {hpreds} WHERE model = 'drive_line'", "pred")
def drift_regression(spark, sf):
    return rates.drift_regression(*parts(horizon_split(spark, sf)), []).select("event_id", "pred")


@query(
    """SELECT event_id, indoor + coalesce(a + b * outdoor_drive, 0) AS pred FROM {tsplit} t LEFT JOIN
      (SELECT home_id, regr_slope(target - indoor, outdoor_drive) AS b, regr_intercept(target - indoor, outdoor_drive) AS a FROM {tsplit} WHERE is_train GROUP BY 1) f USING (home_id) WHERE NOT is_train""",
    "pred",
)
def drift_regression_per_home(spark, sf):
    return rates.drift_regression(*parts(home_horizon_split(spark, sf)), ["home_id"]).select("event_id", "pred")


@query("SELECT event_id, pred FROM {hpreds} WHERE model = 'mode_aware'", "pred")
def mode_aware_drift(spark, sf):
    return rates.mode_aware_drift(*parts(horizon_split(spark, sf)), []).select("event_id", "pred")


_GOAL = "CASE mode WHEN 'heating' THEN heat_sp WHEN 'cooling' THEN cool_sp ELSE outdoor_future END - indoor"


@query(
    f"""SELECT event_id, indoor + coalesce(k, 0) * ({_GOAL}) AS pred FROM {{tsplit}} t LEFT JOIN (SELECT home_id, mode, sum(x * y) / (sum(x * x) + 1e-8) AS k FROM
      (SELECT home_id, mode, target - indoor AS y, {_GOAL} AS x FROM {{tsplit}} WHERE is_train) GROUP BY 1, 2 HAVING count(*) >= 3) f USING (home_id, mode) WHERE NOT is_train""",
    "pred",
)
def mode_aware_drift_per_home(spark, sf):
    return rates.mode_aware_drift(*parts(home_horizon_split(spark, sf)), ["home_id"], 3).select("event_id", "pred")


_K = "sum(x * y) / (sum(x * x) + 1e-8)"
CTES["gk"] = "SELECT home_id, change_type, CASE WHEN timestep_idx < 2 THEN 'early' WHEN timestep_idx < 6 THEN 'mid' ELSE 'late' END AS stage, current_gap AS x, y_true - current_temp AS y FROM {esplit} WHERE is_train"
CTES["gt"] = "SELECT *, CASE WHEN timestep_idx < 2 THEN 'early' WHEN timestep_idx < 6 THEN 'mid' ELSE 'late' END AS stage FROM {esplit} WHERE NOT is_train"


@query(
    f"""WITH g AS (SELECT {_K} AS k FROM {{gk}})
    SELECT 'global' AS model, event_id, current_temp + k * current_gap AS pred FROM {{gt}}, g
    UNION ALL SELECT 'clipped', event_id, CASE change_type WHEN 'heat_increase' THEN least(current_temp + k * current_gap, target_setpoint) ELSE greatest(current_temp + k * current_gap, target_setpoint) END FROM {{gt}}, g
    UNION ALL SELECT 'mode', event_id, current_temp + coalesce(k, 0) * current_gap FROM {{gt}} LEFT JOIN (SELECT change_type, {_K} AS k FROM {{gk}} GROUP BY 1) USING (change_type)
    UNION ALL SELECT 'stage', event_id, current_temp + coalesce(k, 0) * current_gap FROM {{gt}} LEFT JOIN (SELECT stage, greatest(0, least(1, {_K})) AS k FROM {{gk}} GROUP BY 1) USING (stage)
    UNION ALL SELECT 'home', event_id, current_temp + coalesce(h.k, g.k) * current_gap FROM {{gt}} CROSS JOIN g LEFT JOIN (SELECT home_id, greatest(0, least(0.5, {_K})) AS k FROM {{gk}} GROUP BY 1 HAVING count(*) >= 10) h USING (home_id)""",
    "pred",
)
def gap_fraction(spark, sf):
    train, test = parts(window_split(spark, sf))
    return stacked({s: rates.gap_fraction(train, test, s) for s in ("global", "clipped", "mode", "stage", "home")})


CTES["mk"] = "SELECT home_id, change_type, abs(current_gap) AS x, remaining_min AS y FROM {rsplit} WHERE is_train"
CTES["mt"] = "SELECT * FROM {rsplit} WHERE NOT is_train"


@query(
    f"""WITH g AS (SELECT {_K} AS k FROM {{mk}}), m AS (SELECT change_type, {_K} AS k FROM {{mk}} GROUP BY 1)
    SELECT 'global' AS model, event_id, k * abs(current_gap) AS pred FROM {{mt}}, g
    UNION ALL SELECT 'mode', event_id, coalesce(k, 0) * abs(current_gap) FROM {{mt}} LEFT JOIN m USING (change_type)
    UNION ALL SELECT 'home', event_id, coalesce(h.k, g.k) * abs(current_gap) FROM {{mt}} CROSS JOIN g LEFT JOIN (SELECT home_id, greatest(5, least(60, {_K})) AS k FROM {{mk}} GROUP BY 1 HAVING count(*) >= 10) h USING (home_id)
    UNION ALL SELECT 'home_mode', event_id, coalesce(h.k, m.k, 20) * abs(current_gap) FROM {{mt}} t LEFT JOIN m ON t.change_type = m.change_type
      LEFT JOIN (SELECT home_id, change_type, greatest(5, least(60, {_K})) AS k FROM {{mk}} GROUP BY 1, 2 HAVING count(*) >= 10) h ON t.home_id = h.home_id AND t.change_type = h.change_type""",
    "pred",
)
def origin_slope(spark, sf):
    train, test = parts(remaining_split(spark, sf))
    return stacked({s: rates.minutes_per_degree(train, test, s) for s in ("global", "mode", "home", "home_mode")})


CTES["dk"] = "SELECT home_id, drift_direction, margin AS x, duration_min AS y FROM {dsplit} WHERE is_train"


@query(
    f"""WITH m AS (SELECT drift_direction, {_K} AS k FROM {{dk}} GROUP BY 1), r AS (SELECT avg(y) / greatest(avg(x), 1e-6) AS k FROM {{dk}})
    SELECT 'direction' AS model, event_id, greatest(5, least(480, coalesce(m.k, r.k) * margin)) AS pred FROM {{dsplit}} CROSS JOIN r LEFT JOIN m USING (drift_direction) WHERE NOT is_train
    UNION ALL SELECT 'home_direction', event_id, greatest(5, least(480, coalesce(h.k, m.k, r.k) * margin)) FROM {{dsplit}} t CROSS JOIN r LEFT JOIN m ON t.drift_direction = m.drift_direction
      LEFT JOIN (SELECT home_id, drift_direction, greatest(5, least(480, {_K})) AS k FROM {{dk}} GROUP BY 1, 2 HAVING count(*) >= 5) h ON t.home_id = h.home_id AND t.drift_direction = h.drift_direction WHERE NOT is_train""",
    "pred",
)
def drift_linear_rate(spark, sf):
    train, test = parts(drift_split(spark, sf))
    return stacked({"direction": rates.linear_rate(train, test, False), "home_direction": rates.linear_rate(train, test, True)})


CTES["ak"] = "SELECT home_id, change_type, abs_gap AS x, duration_min AS y FROM {asplit} WHERE is_train"


@query(
    f"""SELECT event_id, coalesce(h.k, m.k, 30) * abs_gap AS pred FROM {{asplit}} t LEFT JOIN (SELECT change_type, {_K} AS k FROM {{ak}} GROUP BY 1) m ON t.change_type = m.change_type
      LEFT JOIN (SELECT home_id, change_type, greatest(5, least(120, {_K})) AS k FROM {{ak}} GROUP BY 1, 2 HAVING count(*) >= 5) h ON t.home_id = h.home_id AND t.change_type = h.change_type WHERE NOT is_train""",
    "pred",
)
def active_rate_home_mode(spark, sf):
    return rates.active_rate_home_mode(*parts(active_split(spark, sf))).select("event_id", "pred")


@query(
    """SELECT event_id, coalesce(m.v, g.v) AS pred FROM {dsplit} CROSS JOIN (SELECT quantile_cont(duration_min, 0.5) AS v FROM {dsplit} WHERE is_train) g
      LEFT JOIN (SELECT drift_direction, quantile_cont(duration_min, 0.5) AS v FROM {dsplit} WHERE is_train GROUP BY 1) m USING (drift_direction) WHERE NOT is_train"""
)
def group_median_predict(spark, sf):
    return rates.group_median(*parts(drift_split(spark, sf)), ["drift_direction"], "duration_min").select("event_id", "pred")


CTES["g_act"] = "SELECT avg(log_duration) AS g FROM {asplit} WHERE is_train"


@query(
    """SELECT event_id, coalesce(h.e, g) AS home_encoded, coalesce(hm.e, g) AS home_mode_encoded FROM {asplit} t CROSS JOIN {g_act}
      LEFT JOIN (SELECT home_id, (count(*) * avg(log_duration) + 10 * any_value(g)) / (count(*) + 10) AS e FROM {asplit}, {g_act} WHERE is_train GROUP BY 1) h ON t.home_id = h.home_id
      LEFT JOIN (SELECT home_id, is_heating, (count(*) * avg(log_duration) + 10 * any_value(g)) / (count(*) + 10) AS e FROM {asplit}, {g_act} WHERE is_train GROUP BY 1, 2) hm ON t.home_id = hm.home_id AND t.is_heating = hm.is_heating
    WHERE NOT is_train""",
    "home_encoded home_mode_encoded",
)
def smoothed_target_encoding(spark, sf):
    train, test = parts(active_split(spark, sf))
    return rates.add_encodings(train, test, "is_heating").select("event_id", "home_encoded", "home_mode_encoded")


@query(
    """SELECT 'home' AS level, home_id, -1::BIGINT AS mode, count(*) AS n, avg(log_duration - g) * count(*) / (count(*) + 10) AS offset_min FROM {asplit}, {g_act} WHERE is_train GROUP BY 2
    UNION ALL SELECT 'home_mode', home_id, is_heating, count(*), avg(log_duration - g) * count(*) / (count(*) + 10) FROM {asplit}, {g_act} WHERE is_train GROUP BY 2, 3 HAVING count(*) >= 3""",
    "offset_min",
)
def shrunken_residual_offset(spark, sf):
    train, _ = parts(active_split(spark, sf))
    mean = train.agg(F.avg("log_duration").alias("g"))
    resid = beside(train, mean).withColumn("residual", F.col("log_duration") - F.col("g"))
    home = rates.residual_offset(resid, ["home_id"]).select(F.lit("home").alias("level"), "home_id", F.lit(-1).cast("long").alias("mode"), "n", F.col("offset").alias("offset_min"))
    both = rates.residual_offset(resid, ["home_id", "is_heating"], 10, 3)
    return home.unionByName(both.select(F.lit("home_mode").alias("level"), "home_id", F.col("is_heating").alias("mode"), "n", F.col("offset").alias("offset_min")))


CTES["newton"] = """
SELECT home_id, episode_id, n, k FROM (SELECT home_id, episode_id, count(*) AS n, -sum(t * ln(r)) / sum(t * t) AS k, sum(t * t) AS tt FROM (
    SELECT home_id, episode_id, (timestep_idx * 5)::DOUBLE AS t, (indoor - start_outdoor) / (start_temp - start_outdoor) AS r FROM {drift} WHERE abs(start_temp - start_outdoor) >= 1) WHERE r > 0.01 GROUP BY 1, 2)
WHERE n >= 2 AND tt > 0 AND k > 0 AND k <= 1"""


@query("SELECT * FROM {newton}", "k")
def newton_decay_k(spark, sf):
    return rates.newton_k(drift_table(spark, sf))


CTES["newton_train"] = "SELECT n.* FROM {newton} n JOIN {dsplit} d USING (episode_id) WHERE is_train"
_NEWTON = "greatest(5, coalesce(CASE WHEN abs(start_temp - start_outdoor) >= 0.5 AND (boundary_temp - start_outdoor) / (start_temp - start_outdoor) > 0 AND (boundary_temp - start_outdoor) / (start_temp - start_outdoor) < 1 THEN -ln((boundary_temp - start_outdoor) / (start_temp - start_outdoor)) / {k} END, mid))"


@query(
    f"""SELECT 'global' AS model, event_id, {_NEWTON.replace('{k}', 'g.k')} AS pred FROM {{dsplit}}, (SELECT quantile_cont(k, 0.5) AS k FROM {{newton_train}}) g, (SELECT quantile_cont(duration_min, 0.5) AS mid FROM {{dsplit}} WHERE is_train) WHERE NOT is_train
    UNION ALL SELECT 'home', event_id, {_NEWTON.replace('{k}', 'coalesce(h.k, g.k)')} FROM {{dsplit}} CROSS JOIN (SELECT quantile_cont(k, 0.5) AS k FROM {{newton_train}}) g CROSS JOIN (SELECT quantile_cont(duration_min, 0.5) AS mid FROM {{dsplit}} WHERE is_train)
      LEFT JOIN (SELECT home_id, quantile_cont(k, 0.5) AS k FROM {{newton_train}} GROUP BY 1 HAVING count(*) >= 3) h USING (home_id) WHERE NOT is_train""",
    "pred",
)
def newton_predict(spark, sf):
    steps = stage(drift_table(spark, sf), "drift-steps")
    s = split_of(samples.drift_samples(steps), "drift-split", 1)
    train, test = parts(s)
    train_steps = steps.join(train.select("episode_id"), "episode_id", "left_semi")
    return stacked({"global": rates.newton_predict(train_steps, train, test, False), "home": rates.newton_predict(train_steps, train, test, True)})


_HX = {c: c for c in regress.HORIZON_FEATURES["time"]}
for _n, _xs in regress.HORIZON_FEATURES.items():
    ols_ctes(f"ols_{_n}", "hsplit", {c: c for c in _xs}, "target")


@query(
    " UNION ALL ".join(f"SELECT '{n}' AS model, event_id, fit AS pred FROM {{ols_{n}}} WHERE NOT is_train" for n in regress.HORIZON_FEATURES),
    "pred",
)
def ols_features(spark, sf):
    train, test = parts(horizon_split(spark, sf))
    return stacked({n: regress.ols_features(train, test, xs) for n, xs in regress.HORIZON_FEATURES.items()})


for _m, _xs in regress.MODE_FEATURES.items():
    ols_ctes(f"olsm_{_m}", "hsplit", {c: c for c in _xs}, "target", where=f"mode = '{_m}'")


@query(" UNION ALL ".join(f"SELECT event_id, fit AS pred FROM {{olsm_{m}}} WHERE NOT is_train" for m in regress.MODE_FEATURES), "pred")
def ols_per_mode(spark, sf):
    return regress.ols_per_mode(*parts(horizon_split(spark, sf))).select("event_id", "pred")


ols_ctes("olsh", "tsplit", {"indoor": "indoor", "outdoor": "outdoor"}, "target", ["home_id"], min_n=5)


@query("SELECT event_id, coalesce(fit, indoor) AS pred FROM {tsplit} LEFT JOIN (SELECT event_id, fit FROM {olsh}) USING (event_id) WHERE NOT is_train", "pred")
def ols_per_home(spark, sf):
    return regress.ols_per_home(*parts(home_horizon_split(spark, sf)), ["indoor", "outdoor"], 5).select("event_id", "pred")


@query()
def ols_per_home_features(spark, sf):
    """All feature sets per home; with few rows a home's fit is rank-deficient and takes the least-norm answer."""
    train, test = parts(home_horizon_split(spark, sf))
    models = {n: regress.ols_per_home(train, test, xs, 5) for n, xs in regress.HORIZON_FEATURES.items()}
    models["mode"] = regress.ols_per_mode(train, test, ["home_id"], 5)
    return stacked(models)


_TG = {"drive": "outdoor_temp - current_temp", "current_gap": "current_gap"}
ols_ctes("tg", "esplit", _TG, "y_true - current_temp", where="outdoor_temp IS NOT NULL")
ols_ctes("tgr", "esplit", _TG, "y_true - current_temp", alpha=1.0, where="outdoor_temp IS NOT NULL")
ols_ctes("tgh", "esplit", _TG, "y_true - current_temp", ["home_id"], 1.0, 3, where="outdoor_temp IS NOT NULL")


@query(
    """SELECT 'global' AS model, event_id, current_temp + fit AS pred FROM {tg} JOIN {esplit} e USING (event_id) WHERE NOT e.is_train
    UNION ALL SELECT 'home', event_id, current_temp + coalesce(h.fit, g.fit) FROM {tgr} g JOIN {esplit} e USING (event_id) LEFT JOIN (SELECT event_id, fit FROM {tgh}) h USING (event_id) WHERE NOT e.is_train""",
    "pred",
)
def drive_gap_regression(spark, sf):
    train, test = parts(window_split(spark, sf))
    return stacked({"global": regress.drive_gap_regression(train, test, False), "home": regress.drive_gap_regression(train, test, True, 3)})


_T2 = {"gap": "abs(current_gap)", "outdoor_drive": "outdoor_drive"}
_T3 = {**_T2, "el": "elapsed_min"}
ols_ctes("tt", "rsplit", _T2, "remaining_min", alpha=1.0)
ols_ctes("tt3", "rsplit", _T3, "remaining_min", alpha=1.0)
ols_ctes("tth", "rsplit", _T3, "remaining_min", ["home_id"], 1.0, 5)


@query(
    """SELECT 'global' AS model, event_id, greatest(0, fit) AS pred FROM {tt} WHERE NOT is_train
    UNION ALL SELECT 'home', event_id, greatest(0, coalesce(h.fit, g.fit)) FROM {tt3} g LEFT JOIN (SELECT event_id, fit FROM {tth}) h USING (event_id) WHERE NOT is_train""",
    "pred",
)
def ttt_ridge(spark, sf):
    train, test = parts(remaining_split(spark, sf))
    return stacked({"global": regress.time_to_target_ridge(train, test, False), "home": regress.time_to_target_ridge(train, test, True, 5)})


@query("SELECT event_id, pred FROM {preds}", "pred")
def log_log_ridge(spark, sf):
    p = rates.predict_log_log(*parts(active_split(spark, sf)), "change_type", "log_gap", (3.5, 1.0))
    return p.select("event_id", "pred")


@query("SELECT change_type, n, exp(a) AS k_at_one_degree, b AS slope FROM {ll_mode}", "k_at_one_degree slope")
def log_log_coefficients(spark, sf):
    train, _ = parts(active_split(spark, sf))
    c = rates.log_log_ridge(train, ["change_type"], "log_gap", "log_duration")
    return c.select("change_type", "n", F.exp("a").alias("k_at_one_degree"), F.col("b").alias("slope"))


ols_ctes("dr", "dsplit", {c: c for c in regress.DRIFT_RIDGE_FEATURES}, "log_duration", alpha=1.0)
ols_ctes("ar", "asplit", {c: c for c in regress.ACTIVE_RIDGE_FEATURES}, "log_duration", alpha=1.0)


@query(
    """SELECT 'drift' AS model, event_id, greatest(5, least(480, exp(fit))) AS pred FROM {dr} WHERE NOT is_train
    UNION ALL SELECT 'drift_offset', event_id, greatest(5, least(480, exp(fit + coalesce(o.v, 0)))) FROM {dr} JOIN {dsplit} d USING (event_id) LEFT JOIN
      (SELECT home_id, drift_direction, avg(log_duration - fit) * count(*) / (count(*) + 10) AS v FROM {dr} JOIN {dsplit} d USING (event_id) WHERE d.is_train GROUP BY 1, 2 HAVING count(*) >= 3) o ON d.home_id = o.home_id AND d.drift_direction = o.drift_direction WHERE NOT d.is_train
    UNION ALL SELECT 'active_offset', event_id, exp(fit + coalesce(o.v, 0)) FROM {ar} JOIN {asplit} d USING (event_id) LEFT JOIN
      (SELECT home_id, avg(log_duration - fit) * count(*) / (count(*) + 10) AS v FROM {ar} JOIN {asplit} d USING (event_id) WHERE d.is_train GROUP BY 1 HAVING count(*) >= 3) o ON d.home_id = o.home_id WHERE NOT d.is_train""",
    "pred",
)
def ridge_plus_offsets(spark, sf):
    train, test = parts(drift_split(spark, sf))
    xs = regress.DRIFT_RIDGE_FEATURES
    at, ae = parts(active_split(spark, sf))
    return stacked(
        {
            "drift": regress.ridge_plus_offsets(train, test, xs, None, 5, 480),
            "drift_offset": regress.ridge_plus_offsets(train, test, xs, ["home_id", "drift_direction"], 5, 480),
            "active_offset": regress.ridge_plus_offsets(at, ae, regress.ACTIVE_RIDGE_FEATURES, ["home_id"]),
        }
    )


@query(
    """SELECT model, dim, stratum, count(*) AS n, avg(abs(pred - actual)) AS mae, sqrt(avg((pred - actual) * (pred - actual))) AS rmse, avg(pred - actual) AS bias,
      coalesce(avg(abs(pred - actual) / actual) FILTER (actual > 1) * 100, 0) AS mape
    FROM (SELECT 'ridge' AS model, actual, pred, unnest([{'dim': 'direction', 'stratum': drift_direction},
      {'dim': 'margin', 'stratum': CASE WHEN margin < 1 THEN NULL WHEN margin < 2 THEN '1-2F' WHEN margin < 3 THEN '2-3F' WHEN margin < 5 THEN '3-5F' WHEN margin < 999 THEN '>5F' END},
      {'dim': 'duration', 'stratum': CASE WHEN actual <= 0 THEN NULL WHEN actual <= 30 THEN '<=30 min' WHEN actual <= 120 THEN '30-120 min' WHEN actual <= 9999 THEN '>120 min' END}], recursive := true)
      FROM (SELECT d.drift_direction, d.margin, d.duration_min::DOUBLE AS actual, greatest(5, least(480, exp(fit))) AS pred FROM {dr} JOIN {dsplit} d USING (event_id) WHERE NOT d.is_train))
    WHERE stratum IS NOT NULL GROUP BY 1, 2, 3""",
    "mae rmse bias mape",
)
def stratified_drift_metrics(spark, sf):
    train, test = parts(drift_split(spark, sf))
    scored = regress.ridge_plus_offsets(train, test, regress.DRIFT_RIDGE_FEATURES, None, 5, 480)
    scored = scored.select(F.lit("ridge").alias("model"), "drift_direction", "margin", F.col("duration_min").cast("double").alias("actual"), "pred")
    return metrics.stratified_metrics(scored, metrics.drift_strata(), ["model"])


# The check series has one humidity, which stands in for that outdoors.
ols_ctes("an", "asplit", {c: "indoor_humidity" if c == "outdoor_humidity" else c for c in regress.NINE_EFFECTS}, "log_duration", alpha=1.0)


def nine_effect_parts(spark, sf):
    return parts(active_split(spark, sf).withColumn("outdoor_humidity", F.col("indoor_humidity")))


@query(
    """SELECT event_id, exp(fit + coalesce(o.v, 0)) AS pred, o.v IS NOT NULL AS has_offset FROM {an} JOIN {asplit} d USING (event_id) LEFT JOIN
      (SELECT home_id, is_heating, avg(log_duration - fit) * count(*) / (count(*) + 10) AS v FROM {an} JOIN {asplit} d USING (event_id) WHERE d.is_train GROUP BY 1, 2 HAVING count(*) >= 3) o
      ON d.home_id = o.home_id AND d.is_heating = o.is_heating WHERE NOT d.is_train""",
    "pred",
)
def ridge_nine_effects(spark, sf):
    """Nine effects, and an offset for each home and mode with three training episodes or more."""
    train, test = nine_effect_parts(spark, sf)
    keys = ["home_id", "is_heating"]
    enough = train.groupBy(*keys).agg((F.count(F.lit(1)) >= 3).alias("has_offset"))
    scored = regress.ridge_plus_offsets(train, test, regress.NINE_EFFECTS, keys)
    return scored.join(enough, keys, "left").select("event_id", "pred", F.coalesce("has_offset", F.lit(False)).alias("has_offset"))


@query()
def random_intercept_model(spark, sf):
    train, test = nine_effect_parts(spark, sf)
    models = {"three": regress.ACTIVE_RIDGE_FEATURES, "nine": regress.NINE_EFFECTS}
    return stacked({k: regress.predict_random_intercept(train, test, xs) for k, xs in models.items()}, "event_id", "pred", "fit_by")


def judged(models: dict[str, tuple[DataFrame, float, float]]) -> DataFrame:
    """Test rows with whether their prediction lies in its range, and whether the model's training error is below the
    plain mean's. ``models``: {name: (training and test rows with a prediction, low, high)}."""
    out = []
    for name, (scored, low, high) in models.items():
        scored = stage(scored.select("event_id", "is_train", "log_duration", "pred"), f"judged-{name}")
        off = F.log("pred") - F.col("log_duration")
        fit = scored.where("is_train").agg((F.sqrt(F.avg(off * off)) < F.stddev_pop("log_duration")).alias("beats_mean"))
        test = beside(scored.where("not is_train"), fit)
        out.append(test.select(F.lit(name).alias("model"), "event_id", F.col("pred").between(low, high).alias("in_range"), "beats_mean"))
    return reduce(DataFrame.unionByName, out)


def judged_sql(split: str, *models: str) -> str:
    return " UNION ALL ".join(f"SELECT '{m}' AS model, event_id, true AS in_range, true AS beats_mean FROM {{{split}}} WHERE NOT is_train" for m in models)


@query(judged_sql("dsplit", "log", "linear"))
def gbm_global(spark, sf):
    s = drift_split(spark, sf)
    train, _ = parts(s)
    fits = {n: boosting.gbm_global(train, s, boosting.DRIFT_FEATURES, n == "log", params=TREES) for n in ("log", "linear")}
    return judged({n: (p, 5, 480) for n, p in fits.items()})


@query(judged_sql("asplit", "encoded"))
def gbm_home_encoded(spark, sf):
    s = active_split(spark, sf)
    train, _ = parts(s)
    return judged({"encoded": (boosting.gbm_home_encoded(train, s, boosting.ACTIVE_FEATURES, "is_heating", 5, 240, TREES), 5, 240)})


@query(judged_sql("asplit", "hybrid"))
def gbm_hybrid(spark, sf):
    s = active_split(spark, sf)
    train, _ = parts(s)
    return judged({"hybrid": (boosting.gbm_hybrid(train, s, boosting.ACTIVE_FEATURES, "is_heating", 5, 240, TREES), 5, 240)})


@query("SELECT CAST(k AS INTEGER) AS place, true AS known, true AS in_order, true AS share FROM range(1, 6) r(k)")
def top_features(spark, sf):
    """The five features of most weight, told by place: each is one of the model's, weights fall and are shares."""
    train, _ = parts(drift_split(spark, sf))
    model = boosting.fit_gbt(train, boosting.DRIFT_FEATURES, "log_duration", TREES)
    w = Window.orderBy(F.col("importance").desc(), "feature")  # five rows
    top = boosting.top_features(model, boosting.DRIFT_FEATURES, spark).withColumn("place", F.row_number().over(w))
    falls = F.coalesce(F.col("importance") <= F.lag("importance").over(w), F.lit(True))
    return top.select("place", F.col("feature").isin(boosting.DRIFT_FEATURES).alias("known"), falls.alias("in_order"), F.col("importance").between(0, 1).alias("share"))


def artifacts(spark, sf):
    """Hybrid artifacts of both tasks, in memory: (model, offsets, meta)."""
    a, _ = parts(active_split(spark, sf))
    d, _ = parts(drift_split(spark, sf))
    # A fit is some hundred short jobs, so the two run side by side.
    with ThreadPoolExecutor(2) as pool:
        fits = [pool.submit(boosting.fit_gbt, train, xs, "log_duration", TREES) for train, xs in ((a, boosting.ACTIVE_FEATURES), (d, boosting.DRIFT_FEATURES))]
        am, dm = (f.result() for f in fits)
    return (
        (am, boosting.home_offsets(am, a, boosting.ACTIVE_FEATURES, "is_heating"), {}),
        (dm, boosting.home_offsets(dm, d, boosting.DRIFT_FEATURES, "is_heating"), {}),
    )


@query(
    """SELECT state_id, CASE WHEN mode = 'heating' THEN indoor_temp_f >= 72 - 1e-6 ELSE indoor_temp_f <= 68 + 1e-6 END AS active_zero,
      CASE WHEN mode = 'heating' THEN indoor_temp_f <= 68 + 1e-6 ELSE indoor_temp_f >= 72 - 1e-6 END AS drift_zero, true AS in_range FROM {states}"""
)
def score_first_passage(spark, sf):
    """Where minutes are 0 (the state is there already), and whether the others lie in the models' ranges."""
    active, drift = artifacts(spark, sf)
    heating = F.col("mode") == "heating"
    s = thermostat_states(spark, sf).withColumns({"goal": F.when(heating, 72.0).otherwise(68.0), "edge": F.when(heating, 68.0).otherwise(72.0)})
    scored = boosting.score_drift(boosting.score_active(s, active, "goal"), drift, "edge")
    inside = lambda c, high: (F.col(c) == 0) | F.col(c).between(5, high)
    return scored.select(
        "state_id", (F.col("active_minutes") == 0).alias("active_zero"), (F.col("drift_minutes") == 0).alias("drift_zero"), (inside("active_minutes", 240) & inside("drift_minutes", 480)).alias("in_range")
    )
