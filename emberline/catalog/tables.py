"""Sources, sinks and dimensions."""

from __future__ import annotations

from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import functions as F

from emberline.catalog.registry import query
from emberline.operators import kpi, samples
from emberline.operators.boosting import DRIFT_FEATURES, DRIFT_TYPE, apply_offsets, fit_gbt, home_offsets, raw_predictions
from emberline.operators.drift import drift_episodes
from emberline.plans.staging import stage, stage_path
from emberline.schema import require_columns
from emberline.sources import sinks
from emberline.sources import telemetry as src
from emberline.sources.adapters import MAX_GAP_MIN, building_dim, home_dim, hourly_load, measurement_grid, raw_telemetry, table, telemetry

TREES = {"maxIter": 20}  # else the documented parameters


def drift_table(spark, sf):
    return drift_episodes(telemetry(spark, sf), min_minutes=5, max_gap=MAX_GAP_MIN)


@query(
    """SELECT vec_id AS home_id, CAST(vec_id % 12 + 1 AS INTEGER) AS month, TIMESTAMP '2024-01-01' + to_months(CAST(vec_id % 12 AS INTEGER)) + to_minutes(CAST(5 * (i - 1) AS INTEGER)) AS ts,
      70 + 10 * embedding[i]::DOUBLE AS indoor, 50 - 20 * embedding[i]::DOUBLE AS outdoor
    FROM (SELECT *, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)""",
    "indoor outdoor",
)
def grid_to_long(spark, sf):
    return src.grid_to_long(measurement_grid(spark, sf), ["indoor", "outdoor"])


@query(
    """SELECT home_id, state FROM (SELECT user_id AS home_id, arg_min(CASE WHEN event_type = 'click' THEN '' ELSE event_type END, (ts, event_id)) AS state FROM events GROUP BY 1) WHERE state <> ''"""
)
def home_state_dim(spark, sf):
    e = table(spark, sf, "events")
    t = e.select(F.col("user_id").alias("home_id"), "ts", "event_id", F.when(F.col("event_type") == "click", "").otherwise(F.col("event_type")).alias("state"))
    return src.home_state_dim(t)


@query("SELECT * FROM {raw}")
def scan_telemetry_csv(spark, sf):
    path = stage_path(spark, "telemetry-csv")
    raw_telemetry(spark, sf).write.csv(path, header=True, timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return src.read_telemetry_csv(spark, path)


@query("SELECT user_id AS home_id, min(CASE WHEN user_id % 10 < 7 THEN 'train' WHEN user_id % 10 = 7 THEN 'val' ELSE 'test' END) AS split FROM events GROUP BY 1")
def scan_home_splits(spark, sf):
    k = F.col("home_id") % 10
    t = telemetry(spark, sf).withColumn("split", F.when(k < 7, "train").when(k == 7, "val").otherwise("test"))
    return src.home_splits(t)


@query("SELECT home_id, episode_id, drift_direction, start_temp, boundary_temp, time_to_boundary_min FROM {drift} WHERE timestep_idx = 0 AND time_to_boundary_min BETWEEN 10 AND 480")
def scan_episode_starts(spark, sf):
    path = stage_path(spark, "drift")
    e = drift_table(spark, sf)
    sinks.write_episodes(e, path)
    cols = ["home_id", "episode_id", "drift_direction", "start_temp", "boundary_temp", "time_to_boundary_min"]
    return src.scan_episode_starts(spark, path, e.schema, 10, 480, cols)


@query("SELECT * FROM {drift}", "time_since_hvac_off_min start_temp recent_indoor_slope_15m recent_indoor_slope_30m recent_outdoor_slope_15m recent_outdoor_slope_30m")
def scan_episodes(spark, sf):
    path = stage_path(spark, "drift")
    e = drift_table(spark, sf)
    sinks.write_episodes(e, path)
    return src.scan_episodes(spark, path, e.schema, ["episode_id", "timestep_idx", "time_to_boundary_min"])


@query("SELECT * FROM {tel}")
def require_columns_ok(spark, sf):
    return require_columns(telemetry(spark, sf), ["home_id", "ts", "indoor", "outdoor", "heat_sp", "cool_sp"])


@query("SELECT month, home_id, count(*) AS n, sum(indoor) AS indoor_sum, min(ts) AS first_ts FROM {tel} GROUP BY 1, 2")
def sink_long_csv(spark, sf):
    path = stage_path(spark, "long-csv")
    t = telemetry(spark, sf)
    sinks.write_long(t, path)
    sinks.write_long(t, path)  # a replay leaves one copy
    back = src.read_telemetry_csv(spark, path, t.select(*[c for c in t.columns if c != "month"], "month").schema)
    return back.groupBy("month", "home_id").agg(F.count(F.lit(1)).alias("n"), F.sum("indoor").alias("indoor_sum"), F.min("ts").alias("first_ts"))


@query("SELECT episode_id, count(*) AS n_rows, min(start_temp) AS start_temp FROM {drift} GROUP BY 1")
def sink_episodes_parquet(spark, sf):
    path = stage_path(spark, "episodes")
    e = drift_table(spark, sf)
    sinks.write_episodes(e, path)
    back = spark.read.schema(e.schema).parquet(path)
    return back.groupBy("episode_id").agg(F.count(F.lit(1)).alias("n_rows"), F.min("start_temp").alias("start_temp"))


@query("SELECT episode_id, duration_min, true AS in_range FROM {dsplit}")
def sink_model_artifact(spark, sf):
    """Save a fitted hybrid drift model, load it with its type checked, and score with the loaded copy."""
    d = stage(samples.drift_samples(drift_table(spark, sf)), "drift-samples")
    model = fit_gbt(d, DRIFT_FEATURES, "log_duration", TREES)
    path = stage_path(spark, "artifact")
    sinks.save_artifact(spark, path, DRIFT_TYPE, model, home_offsets(model, d, DRIFT_FEATURES, "is_heating"), {"min_duration": 5, "max_duration": 480})
    loaded, offsets, meta = sinks.load_artifact(spark, path, DRIFT_TYPE, GBTRegressionModel)
    scored = apply_offsets(raw_predictions(loaded, d, DRIFT_FEATURES), offsets, "is_heating", "_raw", meta["min_duration"], meta["max_duration"])
    return scored.select("episode_id", "duration_min", F.col("pred").between(meta["min_duration"], meta["max_duration"]).alias("in_range"))


@query("SELECT run, sum(consumption_kw) AS total_kwh, max(consumption_kw) AS peak_kw FROM {load} GROUP BY 1", "total_kwh peak_kw")
def sink_summary(spark, sf):
    s = hourly_load(spark, sf).groupBy("run").agg(F.sum("consumption_kw").alias("total_kwh"), F.max("consumption_kw").alias("peak_kw"))
    path = sinks.write_summary(s, stage_path(spark, "summary"))
    return spark.read.schema(s.schema).csv(path, header=True)


@query(
    """SELECT s_suppkey AS building_no, s_name AS id, 'cold' AS climate_zone, 1000 * (s_suppkey % 3 + 1) AS floor_area_sqft, 'post2000' AS vintage,
      ['heatpump', 'ac_resistance', 'resistance_only'][CAST(floor(s_suppkey / 3) AS BIGINT) % 3 + 1] AS hvac_type, (5.0 + s_suppkey % 10)::DOUBLE AS hvac_capacity_kw
    FROM supplier WHERE s_nationkey % 3 = 0 AND s_suppkey % 3 = 2"""
)
def filter_buildings(spark, sf):
    return src.filter_dim(building_dim(spark, sf), climate_zone="cold", vintage="post2000")


@query("SELECT t.*, h.state, CASE WHEN t.home_id % 10 < 7 THEN 'train' ELSE 'test' END AS split FROM {tel} t LEFT JOIN {homes} h USING (home_id)")
def attach_home_attrs(spark, sf):
    dim = home_dim(spark, sf).withColumn("split", F.when(F.col("home_id") % 10 < 7, "train").otherwise("test"))
    return src.attach_dim(telemetry(spark, sf), dim, "home_id")


@query("SELECT t.* FROM {tel} t WHERE home_id IN (SELECT home_id FROM {homes} WHERE state IN ('NATION_1', 'NATION_2', 'NATION_3'))")
def semi_join_keys(spark, sf):
    keys = home_dim(spark, sf).where(F.col("state").isin("NATION_1", "NATION_2", "NATION_3"))
    return src.semi(telemetry(spark, sf), keys, ["home_id"])


@query("SELECT t.* FROM {tel} t WHERE home_id NOT IN (SELECT home_id FROM {homes} WHERE state IN ('NATION_1', 'NATION_2', 'NATION_3'))")
def anti_join_keys(spark, sf):
    keys = home_dim(spark, sf).where(F.col("state").isin("NATION_1", "NATION_2", "NATION_3"))
    return src.anti(telemetry(spark, sf), keys, ["home_id"])


@query("SELECT split, count(*) AS n_homes FROM {home_split} GROUP BY 1")
def split_counts(spark, sf):
    s = samples.stratified_split(home_dim(spark, sf), "home_id", "state")
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n_homes"))


@query("SELECT run, max(consumption_kw) / avg(consumption_kw) AS par FROM {load} GROUP BY 1", "par")
def par(spark, sf):
    return kpi.par(hourly_load(spark, sf), ["run"])
