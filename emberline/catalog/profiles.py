"""Fleet profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.catalog.episodes import drift_table, responses, segments
from emberline.catalog.registry import query
from emberline.functions.scalar import comfort_mode, setpoint_gap
from emberline.operators import drift, metrics, profile
from emberline.operators import responses as resp
from emberline.sources.adapters import telemetry

_DESCRIBE = "count({x}) AS n, avg({x}) AS mean, stddev_pop({x}) AS std, min({x})::DOUBLE AS min, max({x})::DOUBLE AS max, quantile_cont({x}, 0.5)::DOUBLE AS median, " + ", ".join(
    f"quantile_cont({{x}}, {p / 100})::DOUBLE AS p{p}" for p in (10, 25, 75, 90, 95, 99)
)
_STATS = "mean std min max median p10 p25 p75 p90 p95 p99"
PERCENTS = [10, 25, 75, 90, 95, 99]


def _desc(x: str) -> str:
    return _DESCRIBE.replace("{x}", x)


def change_counts(spark, sf):
    return profile.setpoint_change_counts(telemetry(spark, sf), min_rows=60)


@query(
    """SELECT home_id, count(*) AS n_valid, avg((mode = 'heating')::INT) * 100 AS heating_pct, avg((mode = 'cooling')::INT) * 100 AS cooling_pct, avg((mode = 'passive')::INT) * 100 AS passive_pct
    FROM {moded} WHERE mode <> 'invalid' GROUP BY 1""",
    "heating_pct cooling_pct passive_pct",
)
def mode_share_per_home(spark, sf):
    return profile.mode_share(telemetry(spark, sf))


@query(f"SELECT mode, {_desc('duration_steps * 5')} FROM {{mode_runs}} GROUP BY 1", _STATS)
def describe_distribution(spark, sf):
    m = profile.mode_episodes(telemetry(spark, sf)).withColumn("minutes", F.col("duration_steps") * 5)
    return profile.describe(m, "minutes", PERCENTS, ["mode"])


@query(f"SELECT mode, {_desc('gap')} FROM {{moded}} WHERE mode IN ('heating', 'cooling') GROUP BY 1", _STATS)
def describe_gaps(spark, sf):
    t = telemetry(spark, sf).select(comfort_mode().alias("mode"), setpoint_gap().alias("gap"))
    return profile.describe(t.where(F.col("mode").isin("heating", "cooling")), "gap", PERCENTS, ["mode"])


_DUR = """CASE WHEN x > 0 AND x <= 5 THEN '<=5min' WHEN x <= 10 THEN '5-10min' WHEN x <= 15 THEN '10-15min' WHEN x <= 30 THEN '15-30min' WHEN x <= 60 THEN '30-60min'
  WHEN x <= 120 THEN '1-2hr' WHEN x <= 240 THEN '2-4hr' ELSE '>4hr' END"""


@query(
    f"SELECT mode, bucket, count(*) AS n, 100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY mode) AS pct FROM (SELECT mode, {_DUR} AS bucket FROM (SELECT mode, duration_steps * 5 AS x FROM {{mode_runs}})) GROUP BY 1, 2",
    "pct",
)
def bucket_histogram(spark, sf):
    m = profile.mode_episodes(telemetry(spark, sf))
    return profile.histogram(m, profile.duration_bucket(F.col("duration_steps") * 5), ["mode"])


@query(
    """SELECT mode, CASE WHEN gap <= 0.5 THEN '<=0.5F' WHEN gap <= 1 THEN '0.5-1F' WHEN gap <= 2 THEN '1-2F' WHEN gap <= 3 THEN '2-3F' WHEN gap <= 5 THEN '3-5F' WHEN gap <= 10 THEN '5-10F' ELSE '>10F' END AS bucket,
      count(*) AS n, 100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY mode) AS pct FROM {moded} WHERE mode IN ('heating', 'cooling') GROUP BY 1, 2""",
    "pct",
)
def gap_histogram(spark, sf):
    t = telemetry(spark, sf).select(comfort_mode().alias("mode"), setpoint_gap().alias("gap"))
    return profile.histogram(t.where(F.col("mode").isin("heating", "cooling")), profile.gap_bucket("gap"), ["mode"])


@query("SELECT mode, count(*) AS n, avg((duration_steps * 5 <= 30)::INT) * 100 AS pct_within FROM {mode_runs} GROUP BY 1", "pct_within")
def short_run_share(spark, sf):
    m = profile.mode_episodes(telemetry(spark, sf)).withColumn("minutes", F.col("duration_steps") * 5)
    return profile.threshold_share(m, "minutes", 30, ["mode"])


@query("SELECT * FROM {change_counts}")
def setpoint_change_counts(spark, sf):
    return change_counts(spark, sf)


@query("SELECT count(*) AS n_homes, count(*) FILTER (n_heat_changes = 0) AS zero_heat, count(*) FILTER (n_cool_changes = 0) AS zero_cool, sum(n_changes)::BIGINT AS total_changes FROM {change_counts}")
def zero_change_homes(spark, sf):
    c = change_counts(spark, sf)
    zero = lambda k: F.count(F.when(F.col(k) == 0, 1))
    return c.agg(
        F.count(F.lit(1)).alias("n_homes"), zero("n_heat_changes").alias("zero_heat"), zero("n_cool_changes").alias("zero_cool"), F.sum("n_changes").alias("total_changes")
    )


@query(
    """SELECT CASE WHEN n_changes = 0 THEN '0' WHEN n_changes <= 10 THEN '1-10' WHEN n_changes <= 50 THEN '11-50' WHEN n_changes <= 100 THEN '51-100' WHEN n_changes <= 500 THEN '101-500' WHEN n_changes <= 1000 THEN '501-1000' ELSE '>1000' END AS bucket,
      count(*) AS n, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS pct FROM {change_counts} GROUP BY 1""",
    "pct",
)
def homes_by_change_count(spark, sf):
    return profile.histogram(change_counts(spark, sf), profile.change_count_bucket("n_changes"))


@query(
    """SELECT kind, CASE WHEN abs(delta) < 2 THEN '1-2F' WHEN abs(delta) < 3 THEN '2-3F' WHEN abs(delta) < 5 THEN '3-5F' WHEN abs(delta) < 10 THEN '5-10F' ELSE '>10F' END AS bucket,
      count(*) AS n, 100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY kind) AS pct FROM {changes} GROUP BY 1, 2""",
    "pct",
)
def change_magnitudes(spark, sf):
    return profile.histogram(profile.setpoint_changes(telemetry(spark, sf)), profile.magnitude_bucket(F.abs("delta")), ["kind"])


@query(
    """SELECT kind, count(*) AS n, count(*) FILTER (delta > 0) AS n_up, count(*) FILTER (delta < 0) AS n_down, avg((delta > 0)::INT) * 100 AS up_pct, avg((delta < 0)::INT) * 100 AS down_pct FROM {changes} GROUP BY 1""",
    "up_pct down_pct",
)
def change_direction_split(spark, sf):
    return profile.change_direction_split(profile.setpoint_changes(telemetry(spark, sf)))


@query(
    """SELECT gradient, mode, n, 100.0::DOUBLE * n / sum(n) OVER () AS pct_all, 100.0::DOUBLE * n / sum(n) OVER (PARTITION BY mode) AS pct_mode FROM (
      SELECT CASE WHEN mode = 'passive' THEN 'deadband' WHEN mode = 'heating' THEN CASE WHEN outdoor < indoor THEN 'active_heating' ELSE 'passive_heating' END
        ELSE CASE WHEN outdoor > indoor THEN 'active_cooling' ELSE 'passive_cooling' END END AS gradient, CASE WHEN mode = 'passive' THEN 'deadband' ELSE mode END AS mode, count(*) AS n
      FROM {moded} WHERE mode <> 'invalid' AND outdoor IS NOT NULL GROUP BY 1, 2)""",
    "pct_all pct_mode",
)
def gradient_totals(spark, sf):
    return profile.gradient_totals(telemetry(spark, sf))


@query(
    """SELECT threshold::BIGINT AS threshold, count(*) FILTER (n_changes >= threshold) AS n_homes, coalesce(sum(n_changes) FILTER (n_changes >= threshold), 0)::BIGINT AS total_changes
    FROM {change_counts}, (VALUES (10), (50), (100), (200), (500)) t(threshold) GROUP BY 1"""
)
def home_threshold_table(spark, sf):
    return profile.home_threshold_table(change_counts(spark, sf))


@query("SELECT home_id, n_heat_changes, n_cool_changes, n_changes FROM {change_counts} ORDER BY n_changes DESC, home_id LIMIT 20")
def top_homes_by_changes(spark, sf):
    c = change_counts(spark, sf).drop("n_samples")
    return profile.top_k(c, [F.col("n_changes").desc(), F.col("home_id")], 20)


@query("SELECT drift_direction, target_boundary, count(DISTINCT episode_id) AS n_episodes FROM {drift} GROUP BY 1, 2")
def episode_counts_by(spark, sf):
    return resp.episode_counts(drift_table(spark, sf), ["drift_direction", "target_boundary"])


@query("SELECT change_type, state, count(DISTINCT episode_id) AS n_episodes FROM {resp} JOIN {homes} USING (home_id) GROUP BY 1, 2")
def response_counts_by_state(spark, sf):
    from emberline.sources.adapters import home_dim

    return resp.episode_counts(responses(spark, sf).join(home_dim(spark, sf), "home_id"), ["change_type", "state"])


@query(
    "SELECT count(*) AS n, avg(v) AS mean, stddev_pop(v) AS std, min(v)::DOUBLE AS min, max(v)::DOUBLE AS max, quantile_cont(v, 0.5)::DOUBLE AS median, quantile_cont(v, 0.1)::DOUBLE AS p10, quantile_cont(v, 0.9)::DOUBLE AS p90 FROM (SELECT time_to_boundary_min AS v FROM {drift} WHERE timestep_idx = 0)",
    "mean std min max median p10 p90",
)
def episode_first_stats(spark, sf):
    e = drift_table(spark, sf)
    first = e.groupBy("episode_id").agg(F.min_by("time_to_boundary_min", "timestep_idx").alias("v"))
    return profile.describe(first, "v", [10, 90])


@query(
    """SELECT count(*) AS candidate_intervals, count(*) FILTER (eligible AND time_to_boundary_min >= 5) AS crossed_intervals, count(*) FILTER (eligible AND crossing_timestep_idx IS NULL) AS dropped_no_crossing,
      count(*) FILTER (eligible AND time_to_boundary_min >= 5)::DOUBLE / count(*) AS crossed_fraction FROM {passages}""",
    "crossed_fraction",
)
def extraction_funnel(spark, sf):
    return drift.extraction_funnel(drift.first_passage(segments(spark, sf)), 5)


@query("SELECT home_id, episode_id, change_type, count(*) * 5 AS duration_min, min(initial_gap) AS initial_gap FROM {resp} GROUP BY 1, 2, 3")
def episode_duration(spark, sf):
    return resp.episode_duration(responses(spark, sf))


@query("SELECT * FROM {equipped}")
def available_equipment(spark, sf):
    return drift.available_equipment(telemetry(spark, sf))


@query("SELECT change_type, count(*) AS n_rows, count(DISTINCT home_id) AS n_homes, count(DISTINCT episode_id) AS n_units FROM {resp} GROUP BY 1")
def dataset_counts(spark, sf):
    return metrics.dataset_counts(responses(spark, sf), ["change_type"])
