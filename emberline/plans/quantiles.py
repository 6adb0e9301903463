"""Exact, linearly interpolated quantiles that never hold one group's values in one task.

(1) A mergeable sketch brackets each quantile, (2) rows under the bracket are counted, (3) only the values inside
the bracket are ranked. Null and NaN are no values: they take no rank. This is the only way, for any number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.plans.lookup import beside
from emberline.plans.staging import stage

SKETCH = 10000


def agg_with_quantiles(
    df: DataFrame, by: list[str], aggs: list[Column], value: Column, probs: dict[str, float]
) -> DataFrame:
    """``groupBy(by).agg(*aggs)`` plus one exact quantile of ``value`` per entry of ``probs``.

    ``df`` is evaluated once: it is written with the value, and both read the columns they need.
    """
    df = stage(df.withColumn("_v", value.cast("double")), "quantile-input")
    quants = bracketed_quantiles(df, by, F.col("_v"), probs)
    base = df.groupBy(*by).agg(*aggs) if aggs else df.select(*by).distinct()
    if not by:
        return base.crossJoin(quants)
    cond = [base[c].eqNullSafe(quants[c]) for c in by]
    return base.join(quants, cond, "left").drop(*[quants[c] for c in by])


def quantiles(df: DataFrame, by: list[str], value: Column, probs: dict[str, float]) -> DataFrame:
    return agg_with_quantiles(df, by, [F.count(value).alias("n")], value, probs)


def bracketed_quantiles(df: DataFrame, by: list[str], value: Column, probs: dict[str, float]) -> DataFrame:
    """The quantiles alone; ``df`` is read three times, so it should be a table."""
    vals = df.select(*by, value.cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    slack = 3.0 / SKETCH
    low = F.array(*[F.lit(max(p - slack, 0.0)) for p in probs.values()])
    high = F.array(*[F.lit(min(p + slack, 1.0)) for p in probs.values()])
    sketch = vals.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("_v", low, SKETCH).alias("_lo"),
        F.percentile_approx("_v", high, SKETCH).alias("_hi"),
    )
    # In a small group one rank is wider than the slack, so all of its values are candidates.
    whole = F.col("_n") <= 2 * SKETCH
    brackets = sketch.select(
        *by,
        F.array(
            *[
                F.struct(
                    F.lit(n).alias("q"),
                    (F.lit(p) * (F.col("_n") - 1)).alias("t"),
                    F.when(whole | F.lit(p == 0), F.lit(float("-inf"))).otherwise(F.col("_lo")[i]).alias("lo"),
                    F.when(whole | F.lit(p == 1), F.lit(float("inf"))).otherwise(F.col("_hi")[i]).alias("hi"),
                )
                for i, (n, p) in enumerate(probs.items())
            ]
        ).alias("_b"),
    )
    if by:
        cond = [vals[c].eqNullSafe(brackets[c]) for c in by]
        rows = vals.join(brackets, cond).drop(*[brackets[c] for c in by])
    else:
        rows = beside(vals, brackets)  # a single row
    # Rows above every bracket never leave this stage; rows below one only add to its count.
    tagged = rows.select(
        *by, "_v", F.inline(F.filter("_b", lambda b: F.col("_v") <= b["hi"]))
    )
    counts = tagged.groupBy(
        *by, "q", "t", F.when(F.col("_v") >= F.col("lo"), F.col("_v")).alias("_v")
    ).agg(F.count(F.lit(1)).alias("_c"))
    run = Window.partitionBy(*by, "q").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("_end", F.sum("_c").over(run))

    def at(rank: Column) -> Column:
        inside = (rank >= F.col("_end") - F.col("_c")) & (rank < F.col("_end")) & F.col("_v").isNotNull()
        return F.max(F.when(inside, F.col("_v")))

    picked = ranked.groupBy(*by, "q", "t").agg(
        at(F.floor("t")).alias("_a"), at(F.ceil("t")).alias("_z")
    )
    found = F.when(
        F.col("_a").isNull() | F.col("_z").isNull(), F.raise_error(F.lit("quantile bracket missed its rank")).cast("double")
    ).otherwise(F.col("_a") + (F.col("t") - F.floor("t")) * (F.col("_z") - F.col("_a")))
    solved = picked.select(*by, "q", found.alias("_r"))
    return solved.groupBy(*by).agg(*[F.max(F.when(F.col("q") == n, F.col("_r"))).alias(n) for n in probs])
