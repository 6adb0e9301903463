"""Gradient-boosted time models on Spark ML, with home encodings, and home offsets."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.scalar import clamp, clip, directional_gap, drift_margin, fill_default, log_shifted, signed_active_drive, signed_drift_drive, time_features
from emberline.operators.rates import add_encodings, residual_offset
from emberline.plans.lookup import lookup_with_fallback

# Feature lists and training parameters.
ACTIVE_FEATURES = [
    "log_gap", "abs_gap", "is_heating", "system_running", "signed_outdoor_drive", "outdoor_temp", "start_temp",
    "hour_sin", "hour_cos", "month_sin", "month_cos", "hour", "month", "day_of_week", "indoor_humidity",
]
DRIFT_FEATURES = [
    "margin", "log_margin", "is_heating", "signed_outdoor_drive", "outdoor_temp", "start_temp", "boundary_temp",
    "hour_sin", "hour_cos", "month_sin", "month_cos", "hour", "month", "day_of_week",
]
DEFAULTS = {"maxDepth": 6, "maxIter": 200, "stepSize": 0.1, "minInstancesPerNode": 10, "subsamplingRate": 0.8, "seed": 42}
ACTIVE_TYPE = "hybrid_gbm_active_time_to_target"
DRIFT_TYPE = "gbm_drift_time_to_boundary"


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    filled = df.withColumns({f"_f_{f}": fill_default(F.col(f).cast("double"), 0) for f in features})
    out = VectorAssembler(inputCols=[f"_f_{f}" for f in features], outputCol="features").transform(filled)
    return out.drop(*[f"_f_{f}" for f in features])


def fit_gbt(train: DataFrame, features: list[str], y: str = "log_duration", params: dict | None = None) -> GBTRegressionModel:
    """Distributed boosting. Training is data-parallel over rows, so a very large home needs no special care.

    A written split of millions of samples is a file or two, and each level of each tree is a pass over the rows, so they are
    dealt over all cores first.
    """
    est = GBTRegressor(featuresCol="features", labelCol=y, predictionCol="_raw", cacheNodeIds=True, **{**DEFAULTS, **(params or {})})
    rows = assemble(train, features).select("features", y)
    return est.fit(rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, 1)))


def raw_predictions(model: GBTRegressionModel, df: DataFrame, features: list[str]) -> DataFrame:
    return model.setPredictionCol("_raw").transform(assemble(df, features)).drop("features")


def gbm_global(train: DataFrame, test: DataFrame, features: list[str], log_target: bool = True, lo: float = 5, hi: float = 480, params: dict | None = None) -> DataFrame:
    model = fit_gbt(train, features, "log_duration" if log_target else "duration_min", params)
    raw = F.exp("_raw") if log_target else F.col("_raw")
    return raw_predictions(model, test, features).withColumn("pred", clip(raw, lo, hi)).drop("_raw")


def gbm_home_encoded(train: DataFrame, test: DataFrame, features: list[str], mode: str, lo: float = 5, hi: float = 480, params: dict | None = None) -> DataFrame:
    """Encodings come from the training rows only, for both sides."""
    xs = [*features, "home_encoded", "home_mode_encoded"]
    model = fit_gbt(add_encodings(train, train, mode), xs, "log_duration", params)
    scored = raw_predictions(model, add_encodings(train, test, mode), xs)
    return scored.withColumn("pred", clip(F.exp("_raw"), lo, hi)).drop("_raw", "home_encoded", "home_mode_encoded")


def home_offsets(model: GBTRegressionModel, train: DataFrame, features: list[str], mode: str) -> dict[str, DataFrame]:
    resid = raw_predictions(model, train, features).withColumn("residual", F.col("log_duration") - F.col("_raw"))
    return {
        "home_mode_residuals": residual_offset(resid, ["home_id", mode], 10.0, 3),
        "home_residuals": residual_offset(resid, ["home_id"], 10.0, 1),
    }


def apply_offsets(df: DataFrame, offsets: dict[str, DataFrame], mode: str, log_col: str, lo: float, hi: float) -> DataFrame:
    levels = [(offsets["home_mode_residuals"], ["home_id", mode]), (offsets["home_residuals"], ["home_id"])]
    scored = lookup_with_fallback(df, levels, "offset", F.lit(0.0), "_off")
    return scored.withColumn("pred", clip(F.exp(F.col(log_col) + F.col("_off")), lo, hi)).drop("_off")


def gbm_hybrid(train: DataFrame, test: DataFrame, features: list[str], mode: str = "is_heating", lo: float = 5, hi: float = 480, params: dict | None = None) -> DataFrame:
    """Global model plus the home's (or home and mode's) shrunken mean residual."""
    model = fit_gbt(train, features, "log_duration", params)
    offsets = home_offsets(model, train, features, mode)
    return apply_offsets(raw_predictions(model, test, features), offsets, mode, "_raw", lo, hi).drop("_raw")


def top_features(model: GBTRegressionModel, features: list[str], spark, k: int = 5) -> DataFrame:
    rows = [(f, float(v)) for f, v in zip(features, model.featureImportances.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature").limit(k)


def _score(states: DataFrame, artifact: tuple, features: list[str], gap: Column, lo: float, hi: float, out: str) -> DataFrame:
    model, offsets, meta = artifact
    lo, hi = meta.get("min_duration", lo), meta.get("max_duration", hi)
    raw = raw_predictions(model, states, features)
    levels = [(offsets["home_mode_residuals"], ["home_id", "is_heating"]), (offsets["home_residuals"], ["home_id"])]
    raw = lookup_with_fallback(raw, levels, "offset", F.lit(0.0), "_off")
    minutes = clamp(F.exp(F.col("_raw") + F.col("_off")), lo, hi)
    return raw.withColumn(out, F.when(gap <= 1e-6, 0.0).otherwise(minutes)).drop("_raw", "_off", *[f for f in features if f not in states.columns])


def _state_features(states: DataFrame, gap: Column, outdoor: str) -> DataFrame:
    tf = time_features("timestamp")
    return states.withColumns(
        {
            "_gap": gap,
            "outdoor_temp": F.col(outdoor),
            "start_temp": F.col("indoor_temp_f"),
            "hour": tf["hour"],
            "month": tf["month_of_year"],
            "day_of_week": tf["day_of_week"],
            "hour_sin": tf["hour_sin"],
            "hour_cos": tf["hour_cos"],
            "month_sin": tf["month_sin"],
            "month_cos": tf["month_cos"],
        }
    )


def score_active(states: DataFrame, artifact: tuple, target: str, outdoor: str = "outdoor_temp_f", lo: float = 5, hi: float = 240, out: str = "active_minutes") -> DataFrame:
    """Minutes the equipment needs to bring each state to ``target``; 0 when it is already there."""
    heating = F.col("mode") == "heating"
    gap = directional_gap("indoor_temp_f", target, heating)
    df = _state_features(states, gap, outdoor).withColumns(
        {
            "abs_gap": F.col("_gap"),
            "log_gap": log_shifted("_gap"),
            "is_heating": heating.cast("long"),
            "_running": F.col("system_running").cast("double"),
            "signed_outdoor_drive": signed_active_drive(heating, "indoor_temp_f", outdoor),
            "indoor_humidity": F.coalesce(F.col("indoor_humidity"), F.lit(50.0)) if "indoor_humidity" in states.columns else F.lit(50.0),
        }
    )
    df = df.withColumn("_was", F.col("system_running")).withColumn("system_running", F.col("_running"))
    scored = _score(df, artifact, ACTIVE_FEATURES, F.col("_gap"), lo, hi, out)
    return scored.select(*[F.col("_was").alias(c) if c == "system_running" else F.col(c) for c in states.columns], out)


def score_drift(states: DataFrame, artifact: tuple, boundary: str, outdoor: str = "outdoor_temp_f", lo: float = 5, hi: float = 480, out: str = "drift_minutes") -> DataFrame:
    """Minutes until each state drifts to ``boundary`` with equipment off; 0 when it is already there."""
    heating = F.col("mode") == "heating"
    gap = drift_margin("indoor_temp_f", boundary, heating)
    df = _state_features(states, gap, outdoor).withColumns(
        {
            "margin": F.col("_gap"),
            "log_margin": log_shifted("_gap"),
            "is_heating": heating.cast("double"),
            "signed_outdoor_drive": signed_drift_drive(heating, "indoor_temp_f", outdoor),
            "boundary_temp": F.col(boundary),
        }
    )
    return _score(df, artifact, DRIFT_FEATURES, F.col("_gap"), lo, hi, out).select(*states.columns, out)
