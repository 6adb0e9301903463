"""Windows, sequences, segmentation, samples, splits, sampling and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.catalog.registry import query
from emberline.operators import drift, profile, samples
from emberline.operators.responses import setpoint_responses as respond
from emberline.plans.series import epoch
from emberline.sources.adapters import MAX_GAP_MIN, building_dim, home_dim, raw_telemetry, telemetry


def responses(spark, sf):
    return respond(raw_telemetry(spark, sf))


def segments(spark, sf):
    return drift.drift_segments(telemetry(spark, sf), max_gap=MAX_GAP_MIN)


def drift_table(spark, sf):
    return drift.drift_episodes(telemetry(spark, sf), min_minutes=5, max_gap=MAX_GAP_MIN)


def sparse_horizon(spark, sf):
    """The check series has about 67 rows per home, so the stride is short."""
    return samples.horizon_samples(telemetry(spark, sf), horizon=2, stride=3, offset=1)


@query("SELECT * FROM {changes}")
def setpoint_changes(spark, sf):
    return profile.setpoint_changes(telemetry(spark, sf))


@query("SELECT * FROM {mode_runs}", "max_gap mean_gap")
def mode_episodes(spark, sf):
    return profile.mode_episodes(telemetry(spark, sf))


@query("SELECT * FROM {hsamp}", "hour_sin hour_cos")
def horizon_samples(spark, sf):
    return sparse_horizon(spark, sf)


@query(
    "SELECT event_id, indoor_slope_3, indoor_slope_6, outdoor_slope_3, outdoor_slope_6 FROM {sloped}",
    "indoor_slope_3 indoor_slope_6 outdoor_slope_3 outdoor_slope_6",
)
def recent_slope(spark, sf):
    s = drift.recent_slope(telemetry(spark, sf), max_gap=MAX_GAP_MIN)
    return s.select("event_id", "indoor_slope_3", "indoor_slope_6", "outdoor_slope_3", "outdoor_slope_6")


@query("SELECT event_id, off_min * 60 AS off_sec FROM {offs} WHERE is_off", "off_sec")
def time_since_off(spark, sf):
    t = drift.time_since_off(telemetry(spark, sf), max_gap=MAX_GAP_MIN).where("off")
    return t.select("event_id", (F.col("off_min") * 60).alias("off_sec"))


@query(
    "SELECT * REPLACE (time_since_hvac_off_min * 60 AS time_since_hvac_off_min) FROM {drift}",
    "recent_indoor_slope_15m recent_indoor_slope_30m recent_outdoor_slope_15m recent_outdoor_slope_30m time_since_hvac_off_min",
)
def drift_episodes(spark, sf):
    # Off time is shown in seconds: whole microseconds, so rounding cannot tie.
    return drift_table(spark, sf).withColumn("time_since_hvac_off_min", F.col("time_since_hvac_off_min") * 60)


@query("SELECT home_id, month, timestamp, event_id, episode_id, change_type, target_setpoint, start_temp, initial_gap, timestep_idx, n_steps, indoor, outdoor, heat_sp, cool_sp, humidity, heat_run, cool_run FROM {resp}")
def setpoint_responses(spark, sf):
    nn = {c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in ("indoor", "outdoor", "heat_sp", "cool_sp", "humidity", "heat_run")}
    return responses(spark, sf).withColumns(nn)


@query("SELECT home_id, month, seg_rn, n_rows, drift_direction, boundary_temp, signed_boundary_gap, crossing_timestep_idx, eligible, time_to_boundary_min FROM {passages}")
def first_passage(spark, sf):
    cols = ["home_id", "month", "seg_rn", "n_rows", "drift_direction", "boundary_temp", "signed_boundary_gap", "crossing_timestep_idx", "eligible", "time_to_boundary_min"]
    return drift.first_passage(segments(spark, sf)).select(*cols)


@query("SELECT * FROM {rem}")
def elapsed_remaining(spark, sf):
    return samples.elapsed_remaining(responses(spark, sf))


@query("SELECT * FROM {ewin}")
def episode_windows(spark, sf):
    return samples.episode_windows(responses(spark, sf), horizon=1)


@query("SELECT * FROM {act}", "log_duration log_gap hour_sin hour_cos month_sin month_cos")
def episode_start_snapshot(spark, sf):
    return samples.active_episode_samples(responses(spark, sf))


@query(
    """SELECT episode_id, sum(coalesce(heat_run, 0)) AS early_heat_runtime, sum(coalesce(cool_run, 0)) AS early_cool_runtime FROM {resp} WHERE timestep_idx < 3 GROUP BY 1"""
)
def early_runtime_sum(spark, sf):
    return samples.early_runtime(responses(spark, sf))


@query("SELECT home_id, event_id, is_train FROM {tsplit}")
def temporal_split(spark, sf):
    return samples.temporal_split(sparse_horizon(spark, sf), min_samples=10, min_test=3).select("home_id", "event_id", "is_train")


@query("SELECT home_id, episode_id, is_train FROM {asplit}")
def within_home_split(spark, sf):
    a = samples.active_episode_samples(responses(spark, sf))
    return samples.within_group_split(a, ["home_id"], "episode_id").select("home_id", "episode_id", "is_train")


@query("SELECT home_id, event_id, is_train FROM {hsplit}")
def cross_home_split(spark, sf):
    s = samples.stratified_split(home_dim(spark, sf), "home_id", "state")
    return samples.cross_group_split(sparse_horizon(spark, sf), s, "home_id").select("home_id", "event_id", "is_train")


@query("SELECT * FROM {home_split}")
def stratified_home_split(spark, sf):
    return samples.stratified_split(home_dim(spark, sf), "home_id", "state")


@query("SELECT episode_id, event_id, current_temp + CASE WHEN timestep_idx > 0 THEN elapsed_change / (timestep_idx * 5) ELSE 0 END * 15 AS pred FROM {ewin}", "pred")
def rate_extrapolation(spark, sf):
    return samples.rate_extrapolation(samples.episode_windows(responses(spark, sf), horizon=1)).select("episode_id", "event_id", "pred")


@query(
    """SELECT episode_id, event_id, dense_id FROM {resp} JOIN (SELECT episode_id, row_number() OVER (ORDER BY f.ts, f.e, episode_id) - 1 AS dense_id FROM
      (SELECT episode_id, min({'ts': timestamp, 'e': event_id}) AS f FROM {resp} GROUP BY 1)) USING (episode_id)"""
)
def dense_episode_ids(spark, sf):
    d = samples.dense_ids(responses(spark, sf), "episode_id", ["timestamp", "event_id"], epoch("timestamp"))
    return d.select("episode_id", "event_id", "dense_id")


@query(
    """SELECT episode_id, event_id, timestep_idx, CASE WHEN timestep_idx = 0 THEN 5 * min(CASE WHEN CASE WHEN change_type = 'heat_increase' THEN indoor >= target_setpoint ELSE indoor <= target_setpoint END THEN timestep_idx END)
      OVER (PARTITION BY episode_id) END AS time_to_target_min FROM {resp}"""
)
def first_row_label(spark, sf):
    return samples.first_row_label(responses(spark, sf)).select("episode_id", "event_id", "timestep_idx", "time_to_target_min")


@query("SELECT * FROM {tel} WHERE home_id IN (SELECT DISTINCT home_id FROM {tel} ORDER BY home_id LIMIT 10)")
def first_n_homes(spark, sf):
    return samples.first_n_homes(telemetry(spark, sf), 10)


@query(
    """SELECT episode_id, event_id FROM {resp} WHERE episode_id IN (SELECT episode_id FROM (SELECT DISTINCT episode_id FROM {resp} WHERE home_id IN
        (SELECT home_id FROM (SELECT DISTINCT home_id FROM {resp}) ORDER BY md5(home_id || ':42'), home_id LIMIT 60)) ORDER BY md5(episode_id || ':42'), episode_id LIMIT 100)"""
)
def sample_homes_episodes(spark, sf):
    homes = samples.sample_keys(responses(spark, sf), "home_id", 60)
    return samples.sample_keys(homes, "episode_id", 100).select("episode_id", "event_id")


@query(
    """SELECT drift_direction, episode_id FROM (SELECT *, row_number() OVER (PARTITION BY drift_direction ORDER BY md5(episode_id || ':42'), episode_id) AS r FROM {dsamp}) WHERE r <= 150"""
)
def cap_per_group(spark, sf):
    return samples.cap_per_group(samples.drift_samples(drift_table(spark, sf)), ["drift_direction"], "episode_id", 150).select("drift_direction", "episode_id")


@query(
    """SELECT s_suppkey AS building_no, CAST(floor(1007 / m) + CASE WHEN i <= 1007 % m THEN 1 ELSE 0 END AS BIGINT) AS quota
    FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS i, count(*) OVER () AS m FROM supplier)"""
)
def allocate_quota(spark, sf):
    return samples.allocate_quota(building_dim(spark, sf), "building_no", 1007)


@query("SELECT home_id, ts, event_id, 'heat' AS kind, heat_sp AS setpoint FROM {tel} UNION ALL SELECT home_id, ts, event_id, 'cool', cool_sp FROM {tel}")
def union_directions(spark, sf):
    t = telemetry(spark, sf)
    one = lambda k: t.select("home_id", "ts", "event_id", F.lit(k).alias("kind"), F.col(f"{k}_sp").alias("setpoint"))
    return one("heat").unionByName(one("cool"))


@query("SELECT home_id FROM {asplit} WHERE is_train INTERSECT SELECT home_id FROM {asplit} WHERE NOT is_train")
def homes_in_both(spark, sf):
    a = samples.within_group_split(samples.active_episode_samples(responses(spark, sf)), ["home_id"], "episode_id")
    return a.where("is_train").select("home_id").intersect(a.where("not is_train").select("home_id"))


@query("SELECT DISTINCT home_id FROM {tel}")
def distinct_keys(spark, sf):
    return telemetry(spark, sf).select("home_id").distinct()


@query("SELECT * FROM {dsamp}", "log_duration log_margin hour_sin hour_cos month_sin month_cos")
def drift_training_samples(spark, sf):
    return samples.drift_samples(drift_table(spark, sf))
