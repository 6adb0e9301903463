"""A cross-section of the catalog against SQL, with plain and with chunked execution."""

import duckdb
import pytest
from pyspark.sql import functions as F

import check
from emberline.catalog import load

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()
SAMPLE = [
    "grid_to_long", "mode_episodes", "setpoint_changes", "horizon_samples", "setpoint_responses", "gradient_totals", "policy_kpis",
    "sanity_checks", "baseline_relative", "stratified_home_split", "peak_decision", "validate_domain", "log_log_ridge", "asof_interpolate",
    "stream_mode_sessions", "hazard_steps", "survival_curve", "bootstrap_intervals", "apply_scales", "holdout_cells", "holdout_leaks", "ridge_nine_effects",
]
CHUNKED = [
    "mode_episodes", "daily_par", "setpoint_changes", "setpoint_change_counts", "horizon_samples", "drift_episodes", "window_overlap_check", "within_home_split", "dense_episode_ids",
    "fill_gaps", "change_by_horizon", "peak_day_kpis", "home_features", "signed_rank_tests", "ar1_forecast", "trend_and_decay", "capped_training_samples",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def compare(spark, con, name):
    got = check.naive(QUERIES[name](spark, SF).toArrow())
    want = check.naive(con.sql(ORACLES[name]).to_arrow_table())
    assert check.types(got) == check.types(want)
    assert check.canonical(got) == check.canonical(want)


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, con, name):
    compare(spark, con, name)


@pytest.mark.parametrize("name", CHUNKED)
def test_query_chunked(spark, con, chunked, name):
    compare(spark, con, name)


def test_every_oracle_parses(con):
    for name, sql in ORACLES.items():
        con.execute("EXPLAIN " + sql)
        assert name in QUERIES


def test_artifact_type_is_checked(spark, tmp_path):
    from emberline.sources.sinks import load_artifact

    spark.createDataFrame([("other", [], {})], "model_type string, offsets array<string>, meta map<string,double>").write.parquet(f"{tmp_path}/m/meta")
    with pytest.raises(ValueError, match="expected model_type"):
        load_artifact(spark, f"{tmp_path}/m", "wanted", None)


def test_episode_scan_pushes_filters_and_columns(spark, tmp_path):
    from emberline.sources.telemetry import scan_episode_starts

    rows = [("a", 0, True, 20), ("a", 1, True, 20), ("b", 0, True, 900), ("c", 0, False, 20)]
    e = spark.createDataFrame(rows, "episode_id string, timestep_idx long, crossed_boundary boolean, time_to_boundary_min long").withColumn("x", F.lit(1.0))
    e.write.parquet(f"{tmp_path}/e")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    got = scan_episode_starts(spark, f"{tmp_path}/e", e.schema, 15, 480, ["episode_id"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(timestep_idx,0)" in plan and "GreaterThanOrEqual(time_to_boundary_min" in plan
    assert "x:double" not in plan
    assert [r.episode_id for r in got.collect()] == ["a"]
