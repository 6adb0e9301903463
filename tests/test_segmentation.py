"""Segmentation against a sequential statement of the rules, plus the edge equalities."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import sequential
from emberline.operators import drift, responses
from emberline.schema import TELEMETRY

START = dt.datetime(2024, 3, 1)


def series(rows, home=1):
    """rows: (minute, indoor, outdoor, heat, cool, run)"""
    return [
        (home, START + dt.timedelta(minutes=float(m)), i, 202403, float(a), float(b), float(h), float(c), 40.0, float(r), 0.0)
        for i, (m, a, b, h, c, r) in enumerate(rows)
    ]


def random_rows(seed, n=150):
    rng = np.random.default_rng(seed)
    minute = np.cumsum(rng.choice([5, 5, 5, 10, 15], n))
    pick = lambda v, p=None: rng.choice(v, n, p=p)
    return list(
        zip(
            minute,
            pick([0, 66, 67, 68, 69, 70, 71, 74, np.nan], [0.03] + [0.13] * 7 + [0.06]),
            pick([64, 66, 67, 80], [0.3, 0.2, 0.2, 0.3]),
            np.where(rng.random(n) < 0.05, np.nan, np.repeat(rng.choice([66, 67, 68, 70], n // 5 + 1), 5)[:n]),
            np.where(rng.random(n) < 0.03, 0, np.repeat(rng.choice([70, 72, 73, 75], n // 3 + 1), 3)[:n]),
            pick([0, 300], [0.9, 0.1]),
        )
    )


def raw_frame(spark, seeds):
    rows = [r for s in seeds for r in series(random_rows(s), home=s)]
    return spark.createDataFrame(rows, TELEMETRY)


def cleaned(raw):
    from emberline.sources.adapters import clean

    return clean(raw)


def check_drift(spark, seeds):
    raw = raw_frame(spark, seeds)
    got = drift.drift_segments(cleaned(raw)).groupBy("home_id", "seg_rn").agg(F.max("rn").alias("last")).collect()
    got = sorted((r.home_id, r.seg_rn - 1, r.last) for r in got)
    want = []
    for s in seeds:
        p = pd.DataFrame(random_rows(s), columns=["minute", "indoor", "outdoor", "heat_sp", "cool_sp", "run"])
        p["running"] = p["run"] > 0
        p.loc[p.indoor == 0, "indoor"] = np.nan
        want += [(s, a, b) for a, b in sequential.brute_force_segments(p, 3.0, 1.0, 10.0)]
    assert got == sorted(want) and len(want) > 20


def check_responses(spark, seeds):
    raw = raw_frame(spark, seeds)
    got = responses.setpoint_responses(raw).groupBy("home_id", "episode_id", "change_type").agg(F.min("event_id").alias("a"), F.max("event_id").alias("z"))
    got = sorted((r.home_id, r.a, r.z, r.change_type) for r in got.collect())
    want = []
    for s in seeds:
        p = pd.DataFrame(random_rows(s), columns=["minute", "indoor", "outdoor", "heat_sp", "cool_sp", "run"])
        want += [(s, a, z, k) for a, z, k in sequential.brute_force_responses(p, 1.0, 0.5)]
    assert got == sorted(want) and len(want) > 10


SEEDS = list(range(1, 9))


def test_drift_segments_match_sequential_rule(spark):
    check_drift(spark, SEEDS)


def test_responses_match_sequential_rule(spark):
    check_responses(spark, SEEDS)


def test_responses_match_when_chunked(spark, chunked):
    check_responses(spark, SEEDS[:3])


def test_drift_segments_match_when_chunked(spark, chunked):
    check_drift(spark, SEEDS[:3])


@pytest.mark.parametrize(
    "temps, outdoor, minutes, kept",
    [
        ([72, 71, 70], 60, [0, 5, 10], None),  # crossing at index 2: 10 minutes, too early
        ([72, 71, 71, 70], 60, [0, 5, 10, 15], 15),  # index 3: kept
        ([72, 71, 71, 70], 69, [0, 5, 10, 15], 15),  # |delta| exactly 3 starts
        ([72, 71, 71, 70], 70, [0, 5, 10, 15], None),  # |delta| 2 does not
        ([72, 71, 71, 70], 60, [0, 5, 15, 20], 15),  # a gap of exactly 10 minutes is allowed
        ([72, 71, 71, 70], 60, [0, 5, 20, 25], None),  # 15 minutes breaks
    ],
)
def test_drift_edges(spark, temps, outdoor, minutes, kept):
    rows = [(m, t, outdoor, 70, 76, 0) for m, t in zip(minutes, temps)] + [(500, 72, outdoor, 70, 76, 300)]
    e = drift.drift_episodes(cleaned(spark.createDataFrame(series(rows), TELEMETRY)))
    got = [r.time_to_boundary_min for r in e.where("timestep_idx = 0").collect()]
    assert got == ([] if kept is None else [kept])


def test_home_without_equipment_is_skipped(spark):
    rows = [(5 * i, t, 60, 70, 76, 0) for i, t in enumerate([72, 71, 71, 70])]
    assert drift.drift_episodes(cleaned(spark.createDataFrame(series(rows), TELEMETRY))).count() == 0


def test_segments_stop_at_month_end(spark):
    rows = series([(5 * i, t, 60, 70, 76, 0) for i, t in enumerate([73, 72, 71, 71, 71, 70])] + [(500, 72, 60, 70, 76, 300)])
    rows = [r[:3] + ((202403 if i < 2 else 202404),) + r[4:] for i, r in enumerate(rows)]
    rows.append(rows[0][:1] + (START + dt.timedelta(minutes=600), 99, 202403) + rows[-1][4:])
    segs = drift.drift_segments(cleaned(spark.createDataFrame(rows, TELEMETRY)))
    assert {(r.month, r.n) for r in segs.groupBy("month", "seg_rn").agg(F.count("*").alias("n")).collect()} == {(202403, 2), (202404, 4)}


def test_row_that_breaks_a_response_cannot_start_one(spark):
    # Heat jumps at row 1, jumps again at row 2 (break); row 2 would be a trigger by itself but is consumed.
    rows = [(0, 66, 50, 66, 80, 0), (5, 66, 50, 68, 80, 0), (10, 66, 50, 70, 80, 0), (15, 70, 50, 70, 80, 0)]
    assert responses.setpoint_responses(spark.createDataFrame(series(rows), TELEMETRY)).count() == 0
    # A jump of exactly one degree is no trigger.
    rows = [(0, 66, 50, 66, 80, 0), (5, 66, 50, 67, 80, 0), (10, 67, 50, 67, 80, 0)]
    assert responses.setpoint_responses(spark.createDataFrame(series(rows), TELEMETRY)).count() == 0


def test_text_ids_no_event_ids_and_columns_that_pass_through(spark):
    raw = raw_frame(spark, SEEDS[:4])
    named = raw.withColumns({"home_id": F.sha2(F.col("home_id").cast("string"), 256), "state": F.lit("TX"), "split": F.lit("test"), "outdoor_humidity": F.col("outdoor") / 2}).drop("event_id")
    for build, labels in ((lambda t: drift.drift_episodes(cleaned(t)), "drift_direction"), (responses.setpoint_responses, "change_type")):
        old, new = build(raw), build(named)
        assert dict(new.dtypes)["home_id"] == "string" and {"state", "split", "outdoor_humidity"} <= set(new.columns) and "event_id" not in new.columns
        cols = ["timestamp", "timestep_idx", labels, "indoor"]
        want = sorted(tuple(map(str, r)) for r in old.select(F.sha2(F.col("home_id").cast("string"), 256), *cols).collect())
        assert sorted(tuple(map(str, r)) for r in new.select("home_id", *cols).collect()) == want and want
        assert new.where("outdoor_humidity <> outdoor / 2 or state <> 'TX'").count() == 0
