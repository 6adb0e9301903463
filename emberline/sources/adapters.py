"""Telemetry-shaped views over the general tables the checks run on.

Every rule is a deterministic expression of the row, so the same view can be written in SQL. Sentinels
for missing readings (0 and NaN) are placed on purpose: the operators must survive them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions.scalar import nan_to_null, sentinel_to_null

# The events series is sparse (hours between readings of a home), so gap rules run with a day.
MAX_GAP_MIN = 1440.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _long(c: Column) -> Column:
    return F.floor(c).cast("long")


def raw_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_telemetry(table(spark, sf_dir, "events"))


def telemetry_stream(spark: SparkSession, sf_dir: str, files_per_batch: int = 8) -> DataFrame:
    """The telemetry view over the files of ``events`` as a stream."""
    schema = table(spark, sf_dir, "events").schema
    # A pattern, since a stream takes one file only by a pattern.
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/[e]vents.parquet")
    return clean(as_telemetry(events))


def as_telemetry(events: DataFrame) -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    eid = F.col("event_id")
    nan = F.lit(float("nan"))

    def dbl(c: Column) -> Column:
        return c.cast("double")

    error = F.col("event_type") == "error"
    return e.select(
        F.col("user_id").alias("home_id"),
        "ts",
        "event_id",
        (F.year("ts") * 100 + F.month("ts")).cast("int").alias("month"),
        F.when(eid % 97 == 5, F.lit(0.0)).otherwise(dbl(66 + _long(F.col("value")) % 12)).alias("indoor"),
        F.when(eid % 101 == 7, nan).otherwise(dbl(40 + (eid * 7) % 60)).alias("outdoor"),
        F.when(eid % 103 == 9, nan).otherwise(dbl(66 + 2 * (_long(eid / 400) % 3))).alias("heat_sp"),
        F.when(eid % 107 == 11, F.lit(0.0)).otherwise(dbl(74 + 2 * (_long(eid / 700) % 3))).alias("cool_sp"),
        F.when(eid % 7 == 3, nan).otherwise(dbl(20 + eid % 61)).alias("humidity"),
        F.when(eid % 109 == 13, nan).when(error & (eid % 2 == 0), F.lit(300.0)).otherwise(F.lit(0.0)).alias("heat_run"),
        F.when(error & (eid % 2 == 1), F.lit(300.0)).otherwise(F.lit(0.0)).alias("cool_run"),
    )


def clean(raw: DataFrame) -> DataFrame:
    """Temperatures: 0 and NaN are missing. Setpoints and the rest: NaN only."""
    return raw.withColumns(
        {
            **{c: sentinel_to_null(c) for c in ("indoor", "outdoor")},
            **{c: nan_to_null(c) for c in ("heat_sp", "cool_sp", "humidity", "heat_run", "cool_run")},
        }
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(raw_telemetry(spark, sf_dir))


def home_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """home_id, state: one row per home (customers stand in for homes, nations for states)."""
    cust = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("home_id"), "c_nationkey")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("state"))
    return cust.join(nation, "c_nationkey").select("home_id", "state")


def building_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Building registry in the shape of the fixed one, one row per supplier."""
    k = F.col("s_suppkey")

    def choose(n: Column, values: list[str]) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))

    return table(spark, sf_dir, "supplier").select(
        k.alias("building_no"),
        F.col("s_name").alias("id"),
        choose(F.col("s_nationkey"), ["cold", "hot", "mixed"]).alias("climate_zone"),
        (1000 * (k % 3 + 1)).cast("long").alias("floor_area_sqft"),
        choose(k, ["pre1980", "1980_2000", "post2000"]).alias("vintage"),
        choose(_long(k / 3), ["heatpump", "ac_resistance", "resistance_only"]).alias("hvac_type"),
        (5.0 + k % 10).cast("double").alias("hvac_capacity_kw"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comfort and load history: three policies per building (a group of homes) and half-month scenario."""
    pol = F.element_at(F.array(F.lit("baseline"), F.lit("precool"), F.lit("setback")), (F.col("event_id") % 3 + 1).cast("int"))
    raw = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    eid = F.col("event_id")
    return raw.select(
        pol.alias("policy"),
        (F.col("user_id") % 50).alias("building"),
        F.when(F.dayofmonth("ts") <= 15, "first_half").otherwise("second_half").alias("scenario"),
        F.col("ts").alias("timestamp"),
        "event_id",
        (66 + _long(F.col("value")) % 12).cast("double").alias("indoor_temp"),
        (F.col("value") / 10.0).alias("hvac_power_kw"),
        (66 + 2 * (_long(eid / 400) % 3)).cast("double").alias("heat_setpoint"),
        (74 + 2 * (_long(eid / 700) % 3)).cast("double").alias("cool_setpoint"),
        F.hour("ts").cast("long").alias("hour"),
    )


def hourly_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, step, consumption_kw: one row per event type and hour with readings."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    step = F.floor(F.unix_micros("ts") / F.lit(3600000000)).cast("long")
    return e.groupBy(F.col("event_type").alias("run"), step.alias("step")).agg(
        F.sum("value").alias("consumption_kw"), F.avg((66 + _long(F.col("value")) % 12 - 32) * 5.0 / 9.0).alias("temp_c")
    )


def forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts, temp: one outdoor value per two hours, at seven minutes past, so that most lookups fall between points."""
    two_hours = F.date_trunc("hour", F.col("ts") - F.make_interval(hours=F.hour("ts") % 2)) + F.make_interval(mins=F.lit(7))
    return telemetry(spark, sf_dir).where(F.col("outdoor").isNotNull()).groupBy(two_hours.alias("ts")).agg(F.avg("outdoor").alias("temp"))


def peak_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two windows for each day that has readings: 13-14 h and 17-20 h."""
    days = table(spark, sf_dir, "events").select(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("d")).distinct()
    hours = F.array(F.struct(F.lit(13).alias("a"), F.lit(14).alias("b")), F.struct(F.lit(17).alias("a"), F.lit(20).alias("b")))
    return days.select("d", F.inline(hours)).select(
        F.expr("d + make_interval(0,0,0,0,a,0,0)").alias("start"), F.expr("d + make_interval(0,0,0,0,b,0,0)").alias("end")
    )


def thermostat_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reading with a temperature as a controller state."""
    t = telemetry(spark, sf_dir).where(F.col("indoor").isNotNull() & F.col("outdoor").isNotNull())
    return t.select(
        F.col("event_id").alias("state_id"),
        "home_id",
        F.col("ts").alias("timestamp"),
        F.col("indoor").alias("indoor_temp_f"),
        F.col("outdoor").alias("outdoor_temp_f"),
        (F.coalesce(F.col("heat_run"), F.lit(0.0)) + F.coalesce(F.col("cool_run"), F.lit(0.0)) > 0).alias("system_running"),
        F.when(F.col("event_id") % 2 == 0, "heating").otherwise("cooling").alias("mode"),
    )


def measurement_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (home, month) with parallel arrays: the vectors stand in for a month of samples."""
    start = F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, cast(vec_id % 12 as int), 0, 0, 0, 0, 0)")
    return (
        table(spark, sf_dir, "embeddings")
        .withColumn("t0", start)
        .select(
            F.col("vec_id").alias("home_id"),
            (F.col("vec_id") % 12 + 1).cast("int").alias("month"),
            F.transform(
                F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: F.timestamp_micros(F.unix_micros("t0") + i.cast("long") * F.lit(300000000))
            ).alias("times"),
            F.transform("embedding", lambda x: (70 + 10 * x).cast("double")).alias("indoor"),
            F.transform("embedding", lambda x: (50 - 20 * x).cast("double")).alias("outdoor"),
        )
    )
