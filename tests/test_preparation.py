"""Gap filling, scaling, holdouts, horizons, days with peaks, and tables without event ids."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from emberline.operators import kpi, prepare, profile, regress, samples
from emberline.sources.telemetry import home_state_dim


def at(minute):
    return dt.datetime(2024, 5, 1) + dt.timedelta(minutes=minute)


def test_only_short_gaps_inside_a_series_are_filled(spark):
    rows = [("a", 0, None), ("a", 5, 10.0), ("a", 10, None), ("a", 20, 40.0), ("a", 60, None), ("a", 100, 80.0), ("a", 105, None), (None, 0, 1.0), (None, 2, None), (None, 4, 3.0)]
    t = spark.createDataFrame([(h, at(m), i, x, "k") for i, (h, m, x) in enumerate(rows)], "home_id string, ts timestamp, event_id int, indoor double, note string")
    got = {(r.home_id, (r.ts - at(0)).seconds // 60): (r.indoor, r.indoor_filled, r.note) for r in prepare.fill_gaps(t, ["indoor"], 30).collect()}
    assert got["a", 10] == (20.0, True, "k") and got[None, 2] == (2.0, True, "k")
    assert got["a", 60] == (None, False, "k") and got["a", 0][0] is None and got["a", 105][0] is None and got["a", 5] == (10.0, False, "k")
    shares = {r.home_id: (r.n, r.indoor_missing, r.flagged) for r in prepare.missing_share(t, ["indoor"], 0.4).collect()}
    assert shares == {"a": (7, pytest.approx(4 / 7), True), None: (3, pytest.approx(1 / 3), False)}
    assert prepare.fill_gaps(t.limit(0), ["indoor"]).collect() == []


def test_scales_come_from_the_rows_given(spark, tmp_path):
    train = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "x double, c double")
    prepare.fit_scales(train, ["x", "c"]).write.parquet(f"{tmp_path}/scales")
    test = spark.createDataFrame([(5.0, 5.0), (None, 9.0)], "x double, c double")
    got = prepare.apply_scales(test, spark.read.parquet(f"{tmp_path}/scales"), ["x", "c"]).collect()
    assert [(r.x_z, r.c_z) for r in got] == [(3.0, 0.0), (None, 0.0)]
    empty = prepare.apply_scales(test, prepare.fit_scales(train.limit(0), ["x", "c"]), ["x", "c"]).collect()
    assert [(r.x_z, r.c_z) for r in empty] == [(None, None)] * 2
    share = spark.createDataFrame([(150.0,), (None,), (900.0,)], "r double").select(prepare.runtime_share("r").alias("v"))
    assert [r.v for r in share.collect()] == [0.5, 0.0, 1.0]


def test_holdout_cells_and_leaks(spark):
    t = spark.createDataFrame([(h, m) for h in ("a", "b", None) for m in (1, 2)], "home_id string, month int")
    homes = spark.createDataFrame([("a", "train"), ("b", "test")], "home_id string, split string")
    cells = prepare.holdout_cells(t, homes, 2)
    assert {(r.home_id, r.month): r.cell for r in cells.collect()} == {("a", 1): "seen", ("a", 2): "new_time", ("b", 1): "new_home", ("b", 2): "new_both", (None, 1): "new_home", (None, 2): "new_both"}
    assert {r.n for r in prepare.leak_check(cells).collect()} == {0}
    leaky = cells.unionByName(spark.createDataFrame([("a", 1, "new_home"), ("b", 1, "new_time")], cells.schema))
    assert {r.rule: r.n for r in prepare.leak_check(leaky).collect()} == {"home-month in two cells": 2, "home seen and new": 2, "month seen and held": 1}


def test_changes_over_several_horizons(spark):
    rows = [("a", at(5 * k), x, 65.0, 75.0) for k, x in enumerate([60.0, 61.0, None, 70.0, 70.2])]
    t = spark.createDataFrame(rows, "home_id string, ts timestamp, indoor double, heat_sp double, cool_sp double")
    got = {(r.horizon, r.mode): (r.n, r.mean, r.small_pct, r.p5) for r in prepare.change_by_horizon(t, {"one": 1, "three": 3}).collect()}
    assert got == {
        ("one", "heating"): (1, 1.0, 0.0, 1.0),
        ("one", "passive"): (1, pytest.approx(0.2), 100.0, pytest.approx(0.2)),
        ("three", "heating"): (2, pytest.approx(9.6), 0.0, pytest.approx(9.24)),
    }


HISTORY = "run string, timestamp timestamp, indoor_temp double, hvac_power_kw double, heat_setpoint double, cool_setpoint double"


def test_intervals_are_cut_at_windows_and_midnight(spark):
    """At 23:30 with 2 kW for 60 minutes; at 16:30 the next day for 60 minutes, half of it in the window; the last reading holds for no time."""
    rows = [("r", at(23 * 60 + 30), 70.0, 2.0, 68.0, 74.0), ("r", at(24 * 60 + 30), 60.0, 0.0, 68.0, 74.0), ("r", at(40 * 60 + 30), 70.0, 3.0, 68.0, 74.0), ("r", at(41 * 60 + 30), 70.0, None, 68.0, 74.0), ("r", None, 70.0, 9.0, 68.0, 74.0)]
    df = spark.createDataFrame(rows, HISTORY)
    one, two = kpi.peak_day_kpis(df, ["run"], max_step_min=60).orderBy("day").collect()
    assert (one.day, one.total_energy_kwh, one.peak_runtime_min) == (dt.date(2024, 5, 1), 1.0, 0.0)
    assert (two.total_energy_kwh, two.peak_runtime_min, two.pre_peak_runtime_min, two.peak_energy_kwh) == (pytest.approx(4.0), 30.0, 30.0, 1.5)
    assert (two.violation_min, two.violation_degree_min, two.max_violation_f) == (60.0, 420.0, 7.0)
    both = df.withColumn("policy", F.lit("base")).unionByName(df.withColumns({"policy": F.lit("new"), "hvac_power_kw": F.col("hvac_power_kw") / 2}))
    k = kpi.with_reference_day(kpi.peak_day_kpis(both, ["policy", "run"]), "base", ["run", "day"])
    got = {(r.policy, r.day.day): (r.peak_runtime_reduction_pct, r.energy_overhead_pct) for r in k.collect()}
    assert got == {("base", 1): (None, 0.0), ("base", 2): (0.0, 0.0), ("new", 1): (None, -50.0), ("new", 2): (0.0, pytest.approx(-50.0))}
    assert kpi.peak_day_kpis(df.limit(0), ["run"]).collect() == []


def test_tables_without_event_ids(spark):
    rows = [("a", at(5 * k), 60.0 + k, 50.0, 65.0 + (k > 3), 75.0) for k in range(12)]
    t = spark.createDataFrame(rows, "home_id string, ts timestamp, indoor double, outdoor double, heat_sp double, cool_sp double")
    (run,) = profile.mode_episodes(t).collect()
    assert (run.home_id, run.mode, run.duration_steps) == ("a", "heating", 6)
    (move,) = profile.setpoint_changes(t).collect()
    assert (move.kind, move.delta, move.ts) == ("heat", 1.0, at(20))
    (count,) = profile.setpoint_change_counts(t, min_rows=5).collect()
    assert (count.n_samples, count.n_heat_changes, count.n_cool_changes, count.n_changes) == (12, 1, 0, 1)
    assert samples.horizon_samples(t, horizon=2, stride=3, offset=1).count() == 3
    assert [r.state for r in home_state_dim(t.withColumn("state", F.concat(F.lit("s"), F.minute("ts")))).collect()] == ["s0"]
    history = t.select(F.col("home_id").alias("run"), F.col("ts").alias("timestamp"), F.col("indoor").alias("indoor_temp"), F.lit(1.2).alias("hvac_power_kw"), F.col("heat_sp").alias("heat_setpoint"), F.col("cool_sp").alias("cool_setpoint"), F.hour("ts").alias("hour"))
    (k,) = kpi.policy_kpis(history, ["run"]).collect()
    assert k.total_kwh == pytest.approx(12 * 1.2 / 12)


def test_mixed_model_falls_back_to_the_ridge(spark):
    rows = [(f"h{i % 6}", i % 2, float(i % 7), float(i % 7) * 0.1 + i % 6 * 0.2 + (i * 37 % 11) * 0.01) for i in range(120)]
    df = spark.createDataFrame(rows, "home_id string, is_heating int, x double, log_duration double")
    mixed = regress.predict_random_intercept(df, df, ["x"])
    assert {r.fit_by for r in mixed.select("fit_by").distinct().collect()} == {"mixed"}
    ridge = regress.predict_random_intercept(df, df, ["x"], iterations=0)
    want = regress.ridge_plus_offsets(df, df, ["x"], ["home_id", "is_heating"])
    assert {r.fit_by for r in ridge.select("fit_by").distinct().collect()} == {"ridge"}
    assert sorted(r.pred for r in ridge.collect()) == pytest.approx(sorted(r.pred for r in want.collect()))
