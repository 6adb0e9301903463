"""Time to the comfort boundary as survival data: segments that never cross are censored, not dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.operators.drift import STEP_MIN, with_boundary


def hazard_steps(segments: DataFrame, step_min: int = STEP_MIN) -> DataFrame:
    """One row per step of every eligible segment up to its crossing, with whether the next step crosses.

    Columns of the segment's step, ``elapsed_min``, ``at_risk`` (the next step was observed), ``event`` (it crosses) and ``censored`` (the last
    step of a segment that ends without crossing). The crossing step itself is no row: nothing is at risk there. So each
    segment ends in one row with ``event`` or one with ``censored``. A missing reading never crosses.
    """
    seg = Window.partitionBy("home_id", "month", "seg_rn")
    rows = with_boundary(segments).where("eligible")
    rows = rows.withColumns({"_crossing": F.min("_cross_at").over(seg), "_last": F.max("timestep_idx").over(seg)})
    rows = rows.where(F.col("_crossing").isNull() | (F.col("timestep_idx") < F.col("_crossing")))
    event = F.coalesce(F.col("timestep_idx") + 1 == F.col("_crossing"), F.lit(False))
    return rows.withColumns(
        {
            "elapsed_min": F.col("timestep_idx") * step_min,
            "at_risk": F.col("timestep_idx") < F.col("_last"),
            "event": event,
            "censored": F.col("_crossing").isNull() & (F.col("timestep_idx") == F.col("_last")),
        }
    ).drop("_crossing", "_last", "_cross_at")


def survival_curve(steps: DataFrame, strata: list[str], step: str = "timestep_idx") -> DataFrame:
    """Product-limit curve with Greenwood's variance: one row per stratum and step at which something is at risk.

    ``n_risk``, ``n_events`` and ``n_censored`` (at the step), then ``hazard`` and ``survival`` past the next step, its ``variance`` and the
    95 % bounds on the plain scale, cut to 0 and 1. Once all that are at risk cross, survival and variance are 0. Counts are map-side combined, and the running
    products go over one row per stratum and step, so a stratum with most rows is no hot task. Null strata are strata.
    """
    counts = steps.groupBy(*strata, step).agg(
        F.count_if("at_risk").alias("n_risk"), F.count_if(F.col("event") & F.col("at_risk")).alias("n_events"), F.count_if("censored").alias("n_censored")
    )
    upto = Window.partitionBy(*strata).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    n, d = F.col("n_risk").cast("double"), F.col("n_events").cast("double")
    over = F.max((d >= n).cast("int")).over(upto) == 1
    alive = d < n
    logs = F.sum(F.when(alive, F.log1p(-d / n)).otherwise(0.0)).over(upto)
    terms = F.sum(F.when(alive, d / (n * (n - d))).otherwise(0.0)).over(upto)
    out = counts.where("n_risk > 0").withColumns({"hazard": d / n, "survival": F.when(over, 0.0).otherwise(F.exp(logs)), "_terms": F.when(over, 0.0).otherwise(terms)})
    out = out.withColumn("variance", F.col("survival") * F.col("survival") * F.col("_terms")).drop("_terms")

    def bound(sign: int) -> Column:
        return F.least(F.greatest(F.col("survival") + sign * 1.959963984540054 * F.sqrt("variance"), F.lit(0.0)), F.lit(1.0))

    return out.withColumns({"lower": bound(-1), "upper": bound(1)})
