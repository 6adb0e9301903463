"""Streamed sessions, survival data, paired comparisons and recursive noise against plain versions."""

from __future__ import annotations

import datetime as dt
import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.operators import inference, noise, survival
from emberline.operators.profile import mode_episodes
from emberline.plans.series import null_safe_join
from emberline.streaming.sessions import stream_mode_sessions

TELEMETRY = "home_id string, ts timestamp, event_id long, indoor double, heat_sp double, cool_sp double"


def at(minute):
    return dt.datetime(2024, 5, 1) + dt.timedelta(minutes=minute)


def readings():
    """Two homes and one without id: modes come and go, one reading is invalid, and two share an instant."""
    temps = {"a": [60, 60, 70, 60, None, 60, 80, 80, 80], "b": [80, 80, 80, 60, 60, 70, 70, 70, 80], None: [60] * 9}
    rows = [(h, at(20 * k), k, None if x is None else float(x), 65.0, 75.0) for h, v in temps.items() for k, x in enumerate(v)]
    return [*rows, ("a", at(160), 99, 60.0, 65.0, 75.0)]


def write(spark, rows, path):
    spark.createDataFrame(rows, TELEMETRY).coalesce(1).write.parquet(path)


def runs(df):
    return sorted(map(tuple, df.select("home_id", "run", "mode", "start_ts", "duration_steps", "max_gap", "mean_gap").collect()), key=str)


@pytest.mark.parametrize("stops", [1, 3])
def test_streamed_sessions_equal_runs_of_the_table(spark, tmp_path, stops):
    """Readings out of order inside the watermark, a late one, restarts from the checkpoint, and runs that only a timer ends."""
    rows = readings()
    by_time = sorted(rows, key=lambda r: (r[1], str(r[0])))
    mixed = [by_time[k] for k in np.argsort(np.arange(len(by_time)) + np.random.default_rng(1).uniform(-2, 2, len(by_time)))]
    late = ("a", at(-500), 7, 60.0, 65.0, 75.0)
    flush = ("z", at(50_000), 1, None, 65.0, 75.0)
    # A batch drops what the watermark before it had passed: the first batch moves it, the third feels it.
    batches = [mixed[:14], mixed[14:], [flush, late]]
    source = f"{tmp_path}/in"

    def stream():
        t = spark.readStream.schema(TELEMETRY).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
        assert stream_mode_sessions(t, f"{tmp_path}/out", f"{tmp_path}/state", max_gap_min=1440, delay="2 hours").awaitTermination(300)

    for k, batch in enumerate(batches):
        write(spark, batch, f"{source}/p{k}")
        if stops == 3 or k == 2:
            stream()
    got, want = spark.read.parquet(f"{tmp_path}/out"), mode_episodes(spark.createDataFrame(rows, TELEMETRY))
    assert runs(got) == runs(want) and got.count() > 6
    if stops == 3:
        # Nothing new: the state is closed, and nothing is written twice.
        stream()
        assert runs(spark.read.parquet(f"{tmp_path}/out")) == runs(want)


def test_a_gap_ends_a_session(spark, tmp_path):
    rows = [("a", at(m), m, 60.0, 65.0, 75.0) for m in (0, 5, 14, 30, 39)] + [("z", at(9000), 1, None, 65.0, 75.0)]
    write(spark, rows, f"{tmp_path}/in/p0")
    t = spark.readStream.schema(TELEMETRY).parquet(f"{tmp_path}/in/*").drop("event_id")
    assert stream_mode_sessions(t, f"{tmp_path}/out", f"{tmp_path}/state", max_gap_min=10, delay="1 hour").awaitTermination(300)
    got = sorted((r.run, r.start_ts, r.duration_steps) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(1, at(0), 3), (2, at(30), 2)]


SEGMENT = "home_id string, month int, seg_rn long, timestep_idx long, indoor double, start_temp double, start_outdoor double, start_heat double, start_cool double"


def test_segments_that_never_cross_are_censored(spark):
    """Drifts down to 65 from 70: one crosses at its third step, one never does, one has a single row, one cannot drift anywhere."""
    segments = {("a", 1): [70, 68, 66, 65, 64], ("a", 9): [70, 69, None, 68], ("b", 1): [70], ("c", 1): [60, 60]}
    rows = [(h, 5, s, k, None if x is None else float(x), float(v[0]), 40.0, 65.0, 75.0) for (h, s), v in segments.items() for k, x in enumerate(v)]
    steps = survival.hazard_steps(spark.createDataFrame(rows, SEGMENT).withColumn("note", F.lit("kept")))
    got = sorted((r.home_id, r.seg_rn, r.timestep_idx, r.at_risk, r.event, r.censored) for r in steps.collect())
    assert got == [
        *[("a", 1, k, True, k == 2, False) for k in range(3)],
        *[("a", 9, k, k < 3, False, k == 3) for k in range(4)],
        ("b", 1, 0, False, False, True),
    ]
    assert "note" in steps.columns
    (one, two, three) = survival.survival_curve(steps, ["month"]).orderBy("timestep_idx").collect()
    assert [(r.n_risk, r.n_events) for r in (one, two, three)] == [(2, 0), (2, 0), (2, 1)]
    assert (one.survival, three.survival) == (1.0, pytest.approx(0.5)) and three.variance == pytest.approx(0.25 * 1 / (2 * 1))
    assert steps.limit(0).transform(lambda d: survival.survival_curve(d, ["month"])).collect() == []


def test_survival_equals_a_plain_product(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        length, crosses = int(rng.integers(1, 9)), bool(rng.random() < 0.5)
        rows += [(None if i % 2 else "s", k, k + 1 < length or crosses, crosses and k + 1 == length, not crosses and k + 1 == length) for k in range(length)]
    rows += [("all", 0, True, True, False)] * 3
    df = spark.createDataFrame(rows, "stratum string, timestep_idx int, at_risk boolean, event boolean, censored boolean")
    got = {(r.stratum, r.timestep_idx): r for r in survival.survival_curve(df, ["stratum"]).collect()}
    for s in (None, "s", "all"):
        alive, terms = 1.0, 0.0
        for k in range(9):
            n = sum(r[2] for r in rows if r[0] == s and r[1] == k)
            d = sum(r[2] and r[3] for r in rows if r[0] == s and r[1] == k)
            if not n:
                assert (s, k) not in got
                continue
            alive *= 1 - d / n
            terms = terms + d / (n * (n - d)) if d < n else 0.0
            r = got[s, k]
            assert (r.n_risk, r.n_events) == (n, d) and r.survival == pytest.approx(alive) and r.variance == pytest.approx(alive * alive * terms)
            assert 0 <= r.lower <= r.survival <= r.upper <= 1


def differences():
    rng = np.random.default_rng(8)
    rows = [(g, i, float(x)) for g, shift in (("up", 2), (None, 0), ("down", -3)) for i, x in enumerate(np.round(rng.normal(shift, 3, 60)))]
    return [*rows, ("zero", 1, 0.0), ("zero", 2, 0.0), ("up", 900, None), ("down", 901, float("nan"))]


def table(spark):
    return spark.createDataFrame(differences(), "g string, unit int, diff double").withColumn("s", F.lit("other"))


def usable(g):
    return [(i, d) for h, i, d in differences() if h == g and d is not None and not math.isnan(d)]


def test_signed_ranks_with_ties_and_zeros(spark, chunked):
    got = {r.g: r for r in inference.signed_rank(table(spark), ["g"]).collect()}
    p = {}
    for g in ("up", None, "down", "zero"):
        d = [x for _, x in usable(g) if x]
        size = sorted(map(abs, d))
        rank = {a: np.mean([k + 1 for k, b in enumerate(size) if a == b]) for a in size}
        w, n = sum(rank[abs(x)] for x in d if x > 0), len(d)
        ties = sum(t**3 - t for t in Counter(size).values())
        spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
        off = w - n * (n + 1) / 4
        z = math.copysign(max(abs(off) - 0.5, 0), off) / spread if spread else 0.0
        p[g] = math.erfc(abs(z) / math.sqrt(2))
        r = got[g]
        assert (r.n, r.n_nonzero, r.w_plus) == (len(usable(g)), n, pytest.approx(w)) and r.z == pytest.approx(z) and r.p_value == pytest.approx(p[g], abs=3e-7)
    order, most = sorted(p, key=lambda g: p[g]), 0.0
    for k, g in enumerate(order):
        most = max(most, min((len(p) - k) * p[g], 1))
        assert got[g].p_holm == pytest.approx(most, abs=2e-6)
    assert got["up"].p_holm < 0.01 and got["zero"].p_holm == 1
    assert inference.signed_rank(table(spark).limit(0), ["g"]).collect() == []


def test_bootstrap_equals_plain_resampling(spark):
    got = {r.g: r for r in inference.bootstrap_mean(table(spark).repartition(5), ["g"], F.col("unit"), resamples=60, seed=3).collect()}
    pairs = inference.multipliers(60, 3).tolist()
    for g in ("up", None, "down", "zero"):
        rows = usable(g)
        means = []
        for a, c in pairs:
            times = [int(np.searchsorted(inference.POISSON, (int(hashlib.md5(str(i).encode()).hexdigest()[:7], 16) * a + c) % inference.PRIME / inference.PRIME, side="right")) for i, _ in rows]
            if sum(times):
                means.append(sum(t * d for t, (_, d) in zip(times, rows)) / sum(times))
        r = got[g]
        assert (r.n, r.mean) == (len(rows), pytest.approx(np.mean([d for _, d in rows]))) and r.median == np.median([d for _, d in rows])
        assert (r.ci_low, r.ci_high) == (pytest.approx(np.quantile(means, 0.025)), pytest.approx(np.quantile(means, 0.975)))
    up = [d for _, d in usable("up")]
    assert got["up"].ci_low < np.mean(up) < got["up"].ci_high and got["up"].ci_high - got["up"].ci_low == pytest.approx(4 * np.std(up) / math.sqrt(60), rel=0.35)


def test_differences_need_a_reference(spark):
    df = spark.createDataFrame([("base", 1, 5.0), ("new", 1, 3.0), ("new", 2, 1.0), ("base", None, 2.0), ("new", None, 2.5), (None, 1, 9.0), ("new", 1, None)], "policy string, k int, kwh double")
    got = sorted((str(r.policy), r.k or 0, r["diff"]) for r in inference.paired_differences(df, F.col("policy") == "base", ["k"], "kwh").collect())
    assert got == [("None", 1, -4.0), ("new", 0, -0.5), ("new", 1, 2.0)]


@pytest.mark.parametrize("chunk", [3, 1000])
def test_affine_scan_equals_a_loop(spark, chunk):
    """A long series runs through several levels of chunks; null keys are keys."""
    rng = np.random.default_rng(2)
    rows = [(k, i + 1, float(rng.uniform(0.5, 1.1)), float(rng.normal())) for k, n in (("long", 100), (None, 7), ("one", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "key string, place long, f double, s double").repartition(4)
    got = {(r.key, r.place): r.x for r in noise.affine_scan(df, ["key"], "place", F.col("f"), F.col("s"), "x", chunk).collect()}
    x, last = 0.0, object()
    for key, place, f, s in rows:
        x = f * (x if key == last else 0.0) + s
        last = key
        assert got[key, place] == pytest.approx(x, rel=1e-9)
    assert len(got) == len(rows)


def test_noise_by_series_and_seed(spark):
    rows = [(h, at(60 * k), None if k == 3 else 50.0 + k) for h in ("a", None) for k in range(40)] + [("a", None, 1.0)]
    truth = spark.createDataFrame(rows, "home string, ts timestamp, temp double")
    out = noise.forecast_noise(truth, ["home"], [1, 2], chunk=8)
    assert out.count() == 160 and out.where("forecast IS NULL").count() == 4 and out.where("error IS NULL").count() == 0
    one = out.where("seed = 1 AND home = 'a'").orderBy("ts").collect()
    again = noise.forecast_noise(truth.repartition(6), ["home"], [1], chunk=5)
    same = null_safe_join(again, out.where("seed = 1").select("home", "ts", F.col("error").alias("e")), ["home", "ts"])
    assert same.where("abs(error - e) > 1e-9 OR e IS NULL").count() == 0
    shock = [b.error - 0.7 * a.error for a, b in zip(one, one[1:])]
    assert 0.3 < np.std(shock[:5]) < 3 and np.std(shock[20:]) > 1.5
    assert noise.forecast_noise(truth.limit(0), ["home"], [1]).collect() == []
