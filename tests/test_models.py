"""Solvers against numpy, and invariants of splits, encodings and fits."""

import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberline.operators import boosting, rates, regress, samples
from emberline.plans.linear import gram, solve
from emberline.schema import require_columns
from emberline.session import shared_dir


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    n = 600
    p = pd.DataFrame({"home_id": rng.integers(0, 12, n), "event_id": np.arange(n), "a": rng.normal(70, 3, n), "b": rng.normal(40, 10, n)})
    p["c"] = p.b - p.a
    effect = rng.normal(0, 0.5, 12)
    p["log_duration"] = 3 + 0.02 * p.a - 0.03 * p.b + effect[p.home_id] + rng.normal(0, 0.1, n)
    return p, spark.createDataFrame(p), effect


def test_ridge_matches_centred_formula(data):
    p, df, _ = data
    got = solve(gram(df, [], ["a", "b"], "log_duration"), alpha=1.0).first().coef
    x, y = p[["a", "b"]].to_numpy(), p.log_duration.to_numpy()
    xc = x - x.mean(0)
    w = np.linalg.solve(xc.T @ xc + np.eye(2), xc.T @ (y - y.mean()))
    assert np.allclose(got, [y.mean() - x.mean(0) @ w, *w])


def test_collinear_fit_predicts_like_least_squares(data):
    p, df, _ = data
    coef = solve(gram(df, [], ["a", "b", "c"], "log_duration"), standardize=True).first().coef
    x = np.column_stack([np.ones(len(p)), p.a, p.b, p.c])
    want = x @ np.linalg.lstsq(x, p.log_duration, rcond=None)[0]
    assert np.allclose(x @ np.array(coef), want)


def test_random_intercept_recovers_home_effects(data):
    _, df, effect = data
    beta, offsets = regress.random_intercept(df, "home_id", ["a", "b"], "log_duration")
    got = np.array([r.offset for r in offsets.orderBy("home_id").collect()])
    assert np.allclose(beta[1:], [0.02, -0.03], atol=0.01)
    assert np.corrcoef(got, effect)[0, 1] > 0.98


def test_encodings_lie_between_group_and_global_mean(data):
    p, df, _ = data
    g = p.log_duration.mean()
    for r in rates.target_encoding(df, ["home_id"], "log_duration", "e").collect():
        m = p.loc[p.home_id == r.home_id, "log_duration"].mean()
        assert min(g, m) - 1e-9 <= r.e <= max(g, m) + 1e-9


def test_within_group_split_fractions_and_repeatability(data):
    _, df, _ = data
    one = samples.within_group_split(df, ["home_id"], "event_id").select("home_id", "event_id", "is_train")
    again = samples.within_group_split(df.repartition(7), ["home_id"], "event_id").select("home_id", "event_id", "is_train")
    assert one.exceptAll(again).count() == 0
    for r in one.groupBy("home_id").agg(F.count("*").alias("n"), F.sum(F.col("is_train").cast("int")).alias("t")).collect():
        assert r.t == max(1, int(np.floor(r.n * 0.7)))


def test_boosting_learns(data):
    _, df, _ = data
    df = df.withColumn("y", 0.02 * F.col("a") - 0.03 * F.col("b"))
    model = boosting.fit_gbt(df.where("event_id < 400"), ["a", "b"], "y", {"maxIter": 20, "maxDepth": 3})
    rows = boosting.raw_predictions(model, df.where("event_id >= 400"), ["a", "b"]).select("_raw", "y").toPandas()
    assert np.mean((rows._raw - rows.y) ** 2) < 0.2 * np.var(rows.y)


def test_empty_training_data_keeps_every_test_row(spark):
    test = spark.createDataFrame([(1, 70.0, 5.0, 71.0, 2.0)], "home_id long, indoor double, outdoor_drive double, target double, current_gap double")
    got = rates.drift_regression(test.limit(0), test, []).collect()
    assert [r.pred for r in got] == [70.0]
    assert rates.predict_global_mean(test.limit(0), test, "target").first().pred is None
    steps = test.selectExpr("home_id", "indoor as current_temp", "target as y_true", "current_gap", "'heat' as change_type")
    assert rates.gap_fraction(steps.limit(0), steps, "global").first().pred == 70.0
    assert regress.ols_features(test.limit(0), test, ["indoor"]).count() == 1


def test_required_columns_are_listed_sorted(spark):
    with pytest.raises(ValueError, match=r"\['x', 'y'\]"):
        require_columns(spark.range(1), ["y", "x", "id"])


def test_quota_and_dense_ids(spark):
    d = spark.createDataFrame([(i,) for i in (5, 3, 9)], "k long")
    assert {r.k: r.quota for r in samples.allocate_quota(d, "k", 11).collect()} == {3: 4, 5: 4, 9: 3}


def test_workers_get_the_package(tmp_path):
    """From a foreign folder, without the package on the workers' path."""
    root = str(Path(__file__).resolve().parent.parent)
    code = f"""
import sys
sys.path.insert(0, {root!r})
from emberline.plans.linear import gram, solve
from emberline.session import build_session
spark = build_session("foreign", "local[2]", 2)
df = spark.createDataFrame([(1, float(i), 2.0 * i + 1) for i in range(9)], "k long, x double, y double")
print("coef", [round(c, 6) for c in solve(gram(df, ["k"], ["x"], "y")).first().coef])
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "coef [1.0, 2.0]" in done.stdout, done.stderr[-2000:]


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        conf, sparkContext = Conf(), Context()  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())
