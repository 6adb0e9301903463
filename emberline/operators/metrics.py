"""Prediction error reports over one long table of predictions."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.scalar import bucketize
from emberline.plans.lookup import beside
from emberline.plans.quantiles import agg_with_quantiles


def err() -> Column:
    return F.col("pred") - F.col("actual")


def abs_err() -> Column:
    return F.abs(err())


def error_metrics(preds: DataFrame, keys: list[str]) -> DataFrame:
    """MAE, RMSE, bias, maximum, sample deviation, P50 to P99, R2 and percentage error (targets above 1) per key."""
    y = F.col("actual")
    sse = F.sum(err() * err())
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.avg(abs_err()).alias("mae"),
        F.sqrt(F.avg(err() * err())).alias("rmse"),
        F.max(abs_err()).alias("max_error"),
        F.avg(err()).alias("bias"),
        F.stddev_samp(abs_err()).alias("std_ae"),
        F.when(F.var_pop(y) > 1e-12, 1 - sse / (F.var_pop(y) * F.count(F.lit(1)))).otherwise(0.0).alias("r2"),
        F.coalesce(F.avg(F.when(y > 1, abs_err() / y)) * 100, F.lit(0.0)).alias("mape"),
    ]
    return agg_with_quantiles(preds, keys, aggs, abs_err(), {"median_ae": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99})


def stratified_metrics(preds: DataFrame, strata: dict[str, Column], keys: list[str]) -> DataFrame:
    """Error summary by every stratum of every dimension in one shuffle: each row is listed once per dimension."""
    listed = F.inline(
        F.filter(
            F.array(*[F.struct(F.lit(d).alias("dim"), c.cast("string").alias("stratum")) for d, c in strata.items()]),
            lambda s: s["stratum"].isNotNull(),
        )
    )
    return (
        preds.select("*", listed)
        .groupBy(*keys, "dim", "stratum")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(abs_err()).alias("mae"),
            F.sqrt(F.avg(err() * err())).alias("rmse"),
            F.avg(err()).alias("bias"),
            F.coalesce(F.avg(F.when(F.col("actual") > 1, abs_err() / F.col("actual"))) * 100, F.lit(0.0)).alias("mape"),
        )
    )


# Edges and labels of the buckets that the reports use.
def step_gap_bucket(x) -> Column:
    return bucketize(F.abs(x), [0, 1, 2, 3, 5, 100], ["0-1F", "1-2F", "2-3F", "3-5F", ">5F"])


def initial_gap_bucket(x) -> Column:
    return bucketize(F.abs(x), [1, 2, 3, 5, 100], ["1-2F", "2-3F", "3-5F", ">5F"])


def stage_bucket(idx) -> Column:
    return bucketize(idx, [0, 2, 6, 1000], ["early", "mid", "late"])


def elapsed_bucket(minutes) -> Column:
    return bucketize(minutes, [0, 5, 15, 30, 10000], ["start", "early", "mid", "late"])


def margin_bucket(x) -> Column:
    return bucketize(x, [1, 2, 3, 5, 999], ["1-2F", "2-3F", "3-5F", ">5F"])


def drift_duration_bucket(x) -> Column:
    return bucketize(x, [0, 30, 120, 9999], ["<=30 min", "30-120 min", ">120 min"], "right")


def report_duration_bucket(x) -> Column:
    return bucketize(x, [0, 15, 30, 60, 120, 240, 1000], ["<15min", "15-30", "30-60", "60-120", "120-240", ">240"], "right")


def report_gap_bucket(x) -> Column:
    return bucketize(x, [0, 1, 2, 3, 5, 10, 20], ["0-1F", "1-2F", "2-3F", "3-5F", "5-10F", ">10F"], "right")


def hour_band(x) -> Column:
    return bucketize(x, [-1, 6, 12, 18, 24], ["night", "morning", "afternoon", "evening"], "right")


def outdoor_band(x) -> Column:
    return bucketize(x, [-20, 32, 50, 70, 85, 120], ["<32F", "32-50F", "50-70F", "70-85F", ">85F"], "right")


def predicted_bucket(x) -> Column:
    return bucketize(x, [0, 20, 40, 60, 100, 200, 1000], ["<20min", "20-40", "40-60", "60-100", "100-200", ">200"], "right")


def error_strata() -> dict[str, Column]:
    """Dimensions of the error report."""
    return {
        "duration": report_duration_bucket("actual"),
        "gap": report_gap_bucket("abs_gap"),
        "change_type": F.col("change_type"),
        "system_running": F.when(F.col("system_running") == 1, "running").otherwise("not running"),
        "state": F.col("state"),
        "month": F.col("month").cast("string"),
        "hour": hour_band("hour"),
        "outdoor": outdoor_band("outdoor_temp"),
    }


def drift_strata() -> dict[str, Column]:
    """Dimensions of the drift report: direction, margin to the boundary, and duration."""
    return {"direction": F.col("drift_direction"), "margin": margin_bucket("margin"), "duration": drift_duration_bucket("actual")}


def setpoint_strata() -> dict[str, Column]:
    """Dimensions of the setpoint-response report: initial gap and minutes since the change."""
    return {"initial_gap": initial_gap_bucket("initial_gap"), "elapsed": elapsed_bucket("elapsed_min")}


def per_home_errors(preds: DataFrame) -> DataFrame:
    return preds.groupBy("home_id").agg(
        F.avg(abs_err()).alias("mae"),
        F.stddev_samp(abs_err()).alias("std"),
        F.count(F.lit(1)).alias("n_episodes"),
        F.avg(err()).alias("bias"),
        F.avg("actual").alias("avg_duration"),
    )


def calibration(preds: DataFrame) -> DataFrame:
    b = preds.withColumn("bucket", predicted_bucket("pred")).where(F.col("bucket").isNotNull())
    return b.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(abs_err()).alias("mae"),
        F.avg(err()).alias("bias"),
        F.avg("actual").alias("mean_actual"),
        F.avg("pred").alias("mean_pred"),
    )


def under_over(preds: DataFrame) -> DataFrame:
    under, over = err() < 0, err() > 0
    return preds.agg(
        F.count(F.when(under, 1)).alias("n_under"),
        (F.avg(under.cast("double")) * 100).alias("under_pct"),
        F.avg(F.when(under, err())).alias("under_mean_error"),
        F.count(F.when(over, 1)).alias("n_over"),
        (F.avg(over.cast("double")) * 100).alias("over_pct"),
        F.avg(F.when(over, err())).alias("over_mean_error"),
    )


def tail_breakdown(preds: DataFrame, q: float = 0.95) -> DataFrame:
    """Share of each stratum among errors above the q-quantile, next to its share of all rows."""
    cut = agg_with_quantiles(preds, [], [], abs_err(), {"cut": q})
    strata = F.inline(
        F.array(
            F.struct(F.lit("duration").alias("dim"), report_duration_bucket("actual").alias("stratum")),
            F.struct(F.lit("change_type").alias("dim"), F.col("change_type").alias("stratum")),
            F.struct(F.lit("system_running").alias("dim"), F.when(F.col("system_running") == 1, "running").otherwise("not running").alias("stratum")),
        )
    )
    flagged = beside(preds, cut).withColumn("_tail", (abs_err() > F.col("cut")).cast("long"))
    g = flagged.select("_tail", strata).where(F.col("stratum").isNotNull()).groupBy("dim", "stratum").agg(
        F.sum("_tail").alias("n_tail"), F.count(F.lit(1)).alias("n_all")
    )
    w = Window.partitionBy("dim")
    return g.select(
        "dim",
        "stratum",
        "n_tail",
        "n_all",
        (100 * F.col("n_tail") / F.sum("n_tail").over(w)).alias("tail_pct"),
        (100 * F.col("n_all") / F.sum("n_all").over(w)).alias("overall_pct"),
    )


def error_contribution(preds: DataFrame, long_over: float = 120, short_under: float = 15) -> DataFrame:
    """Long and short episodes: count, MAE, bias and share of the total absolute error."""
    kind = F.when(F.col("actual") > long_over, "long").when(F.col("actual") < short_under, "short").otherwise("other")
    g = preds.groupBy(kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(abs_err()).alias("mae"), F.avg(err()).alias("bias"), F.sum(abs_err()).alias("_a")
    )
    w = Window.partitionBy(F.lit(0))
    return g.select(
        "kind",
        "n",
        (100 * F.col("n") / F.sum("n").over(w)).alias("pct"),
        "mae",
        "bias",
        (100 * F.col("_a") / F.sum("_a").over(w)).alias("error_share_pct"),
    ).where(F.col("kind") != "other")


def hardest_easiest(home_stats: DataFrame, k: int = 10, min_n: int = 10) -> DataFrame:
    """The k homes with the largest and the k with the smallest MAE among those with enough episodes."""
    enough = home_stats.where(F.col("n_episodes") >= min_n)
    hard = enough.orderBy(F.col("mae").desc(), "home_id").limit(k).withColumn("label", F.lit("hard"))
    easy = enough.orderBy("mae", "home_id").limit(k).withColumn("label", F.lit("easy"))
    return hard.unionByName(easy)


def group_profile(preds: DataFrame, labels: DataFrame, features: list[str]) -> DataFrame:
    """Feature means of the labelled homes' episodes. The label table has at most 2k rows."""
    return (
        preds.join(F.broadcast(labels.select("home_id", "label")), "home_id")
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f) for f in features])
    )


def improvement(metrics: DataFrame, baseline: str, col: str = "mae") -> DataFrame:
    """Percent by which each model lowers ``col`` against a named one."""
    b = metrics.where(F.col("model") == baseline).select(F.col(col).alias("_b"))
    return beside(metrics, b).select(
        "model", col, (100 * (F.col("_b") - F.col(col)) / F.col("_b")).alias("improvement_pct")
    )


def dataset_counts(df: DataFrame, by: list[str], unit: str = "episode_id") -> DataFrame:
    """Rows, homes and units per group, from pre-aggregated (group, home, unit) cells."""
    cells = df.groupBy(*by, "home_id", unit).agg(F.count(F.lit(1)).alias("_r"))
    units = cells.groupBy(*by, "home_id").agg(F.sum("_r").alias("_r"), F.count(F.lit(1)).alias("_u"))
    return units.groupBy(*by).agg(
        F.sum("_r").alias("n_rows"), F.count(F.lit(1)).alias("n_homes"), F.sum("_u").alias("n_units")
    )


