"""Golden rows of the peak decision, and validation errors."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from emberline.operators import decide, joins, samples
from emberline.sources import telemetry as src

STATE = "state_id int, home_id long, timestamp timestamp, indoor_temp_f double, outdoor_temp_f double, system_running boolean, mode string"


def at(h, m=0):
    return dt.datetime(2026, 1, 1, h, m)


def windows(spark, *spans):
    return spark.createDataFrame([(at(a), at(b)) for a, b in spans], "start timestamp, end timestamp")


def decide_one(spark, when, spans, active=0.0, drift=0.0, indoor=70.0, mode="heating", outdoor=30.0, forecast=None, **config):
    s = spark.createDataFrame([(1, 1, when, indoor, outdoor, False, mode)], STATE)
    fc = None if forecast is None else spark.createDataFrame([(at(h), float(v)) for h, v in forecast], "ts timestamp, temp double")
    score = lambda d: d.withColumns({"active_minutes": F.lit(float(active)), "drift_minutes": F.lit(float(drift))})
    return decide.peak_decision(s, windows(spark, *spans), fc, config, score).first()


@pytest.mark.parametrize(
    "kw, phase, heat, cool, text",
    [
        (dict(when=at(12), spans=[(17, 20)], horizon_minutes=60), "normal", 70, None, "no peak window"),
        (dict(when=at(15), spans=[(17, 20)], active=30), "normal", 70, None, "not time"),
        (dict(when=at(16), spans=[(17, 20)], active=50), "precondition", 72, None, "should start"),
        (dict(when=at(16), spans=[(17, 20)], active=50, indoor=75.0, mode="cooling"), "precondition", None, 68, ""),
        (dict(when=at(18), spans=[(17, 20)], drift=240), "peak_coast", 68, None, "stays within comfort"),
        (dict(when=at(18), spans=[(17, 20)], drift=10, indoor=69.0), "peak_coast", 68, None, "defer HVAC"),
        (dict(when=at(18), spans=[(17, 20)], drift=10, indoor=68.0), "peak_maintain", 68, None, "boundary reached"),
        (dict(when=at(18), spans=[(17, 20)], drift=240, indoor=72.0, mode="cooling"), "peak_maintain", None, 72, ""),
        (dict(when=at(13, 30), spans=[(13, 14), (17, 20)], drift=240), "peak_coast", 68, None, ""),
        (dict(when=at(16), spans=[(13, 14), (17, 20)], active=50), "precondition", 72, None, ""),
        (dict(when=at(16), spans=[(17, 20)], active=50, indoor=71.75), "normal", 70, None, "already near storage target"),
    ],
)
def test_golden_rows(spark, kw, phase, heat, cool, text):
    r = decide_one(spark, **kw)
    assert (r.phase, r.heat_setpoint_f, r.cool_setpoint_f) == (phase, heat, cool)
    assert text in r.reason


def test_forecast_mean(spark):
    r = decide_one(spark, at(16), [(17, 20)], active=50, forecast=[(16, 40), (17, 44)])
    assert r.outdoor_used == 42.0
    r = decide_one(spark, at(18), [(17, 20)], drift=240, forecast=[(18, 40), (19, 42), (20, 46)])
    assert abs(r.outdoor_used - 128 / 3) < 1e-9
    r = decide_one(spark, at(16), [(17, 20)], active=50, outdoor=31.0, forecast=[(18, 40)])
    assert r.outdoor_used == 31.0 and "lookup failed" in r.reason


def test_validation(spark):
    with pytest.raises(ValueError, match="must not overlap"):
        decide.check_windows(windows(spark, (13, 15), (14, 16)))
    with pytest.raises(ValueError, match="comfort_lower_f"):
        decide.check_config({**decide.DEFAULT_CONFIG, "comfort_lower_f": 72, "comfort_upper_f": 68})
    bad = spark.createDataFrame([(1, 1, at(1), 200.0, 30.0, True, "off"), (2, 1, at(1), 70.0, 30.0, True, "heating")], STATE)
    assert {(r.state_id, r.rule) for r in decide.check_states(bad).collect()} == {(1, "indoor_temp_f must be plausible"), (1, "mode must be heating or cooling")}
    with pytest.raises(ValueError, match="mode must be"):
        decide.policy_setback(mode="off")
    homes = spark.createDataFrame([("a", "new", "pump"), ("b", "new", "coil"), ("c", "old", "coil")], "id string, vintage string, kind string")
    with pytest.raises(ValueError, match="unknown attributes"):
        src.filter_dim(homes, colour="red")
    with pytest.raises(ValueError, match="must be positive"):
        samples.sample_keys(homes, "id", 0)
    assert [r.id for r in src.filter_dim(homes, vintage="new", kind="coil").collect()] == ["b"]


def test_interpolation_leaves_outside_empty(spark):
    left = spark.createDataFrame([(i, at(h, m)) for i, (h, m) in enumerate([(0, 0), (1, 0), (1, 30), (2, 0), (3, 0)])], "i int, ts timestamp")
    right = spark.createDataFrame([(at(1), 10.0), (at(2), 20.0)], "ts timestamp, v double")
    got = {r.i: r.out for r in joins.asof_join(left, right, [], "ts", "v", "out", "interpolate").collect()}
    assert got == {0: None, 1: 10.0, 2: 15.0, 3: 20.0, 4: None}
