"""Inputs derived from the given tables, as DataFrames and as SQL fragments.

Loads and counters are kept in whole cents, so sums are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegrid.functions.timecols import epoch, from_epoch, shift
from tidegrid.operators.grid import resample
from tidegrid.operators.scan import Scan, running
from tidegrid.plans.registry import cte
from tidegrid.session import table

HOUR, SIX, DAY = 3600, 21600, 86400
TASK_EVENTS = 25_000


def obs_type(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_type").alias("series_id"), "ts", "value", "event_id")


cte("obs", "SELECT event_type AS series_id, ts, value, event_id FROM events")


def obs_fleet(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("series_id"), "ts", F.round(F.col("value") * 100).alias("value"), "event_id"
    )


cte("fleet", "SELECT CAST(user_id AS VARCHAR) AS series_id, ts, round(value * 100) AS value, event_id FROM events")


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Mean per type and hour on the complete grid, null where nothing was read."""
    return resample(obs_type(spark, sf), ["series_id"], HOUR, "mean")


def grid_ctes(prefix: str, src: str, interval: str, agg: str, empty: str = "b.y") -> None:
    cte(f"{prefix}_bins",
        f"SELECT series_id, time_bucket(INTERVAL '{interval}', ts) AS grid_ts, {agg} AS y FROM {src} GROUP BY 1, 2", src)
    cte(f"{prefix}_spine",
        f"SELECT series_id, unnest(generate_series(lo, hi, INTERVAL '{interval}')) AS grid_ts FROM "
        f"(SELECT series_id, min(grid_ts) AS lo, max(grid_ts) AS hi FROM {prefix}_bins GROUP BY 1)", f"{prefix}_bins")
    cte(prefix,
        f"SELECT s.series_id, s.grid_ts, {empty} AS y FROM {prefix}_spine s "
        f"LEFT JOIN {prefix}_bins b ON b.series_id = s.series_id AND b.grid_ts = s.grid_ts", f"{prefix}_spine")


grid_ctes("hourly", "obs", "1 hour", "avg(value)")
grid_ctes("half", "obs", "30 minutes", "avg(value)")
grid_ctes("load6", "fleet", "6 hours", "sum(value)", "coalesce(b.y, 0.0)")
grid_ctes("sparse6", "fleet", "6 hours", "sum(value)")


def half_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return resample(obs_type(spark, sf), ["series_id"], 1800, "mean")


def _fleet_tasks(spark: SparkSession, sf: str) -> int:
    """Tasks that the fleet's users are dealt to: a few hundred users each, as every cell becomes sixteen forecasts and more."""
    rows = table(spark, sf, "events").count()
    return max(-(-rows // TASK_EVENTS), int(spark.conf.get("spark.sql.shuffle.partitions")))


def load6(spark: SparkSession, sf: str) -> DataFrame:
    """Fleet load: cents per user and six hours, 0 where a user did nothing."""
    return resample(obs_fleet(spark, sf), ["series_id"], SIX, "sum", tasks=_fleet_tasks(spark, sf))


def sparse6(spark: SparkSession, sf: str) -> DataFrame:
    """The same grid with unmeasured cells instead of zeros."""
    return resample(obs_fleet(spark, sf), ["series_id"], SIX, "sum", empty_sum=None, tasks=_fleet_tasks(spark, sf))


def counter_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Running cents per type and day; resets each UTC day."""
    w = W.partitionBy("series_id", F.to_date("ts")).orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    return obs_type(spark, sf).select(
        "series_id", "ts", F.sum(F.round(F.col("value") * 100)).over(w).alias("value")
    )


cte("counter_daily",
    "SELECT series_id, ts, sum(round(value * 100)) OVER (PARTITION BY series_id, CAST(ts AS DATE) ORDER BY ts "
    "ROWS UNBOUNDED PRECEDING) AS value FROM obs", "obs")


def counter_life(spark: SparkSession, sf: str) -> DataFrame:
    """Running cents per type with brief dips (to 80 %) and dropouts (to 0)."""
    d = running(
        obs_type(spark, sf), ["series_id"], ["ts"], [Scan("total", "sum", F.round(F.col("value") * 100))]
    )
    v = F.when(F.col("event_id") % 211 == 0, F.lit(0.0)).when(
        F.col("event_id") % 97 == 0, F.col("total") * 0.8).otherwise(F.col("total"))
    return d.select("series_id", "ts", v.alias("value"))


cte("counter_life",
    "SELECT series_id, ts, CASE WHEN event_id % 211 = 0 THEN 0.0 WHEN event_id % 97 = 0 THEN total * CAST(0.8 AS DOUBLE) "
    "ELSE total END AS value FROM (SELECT *, sum(round(value * 100)) OVER (PARTITION BY series_id ORDER BY ts "
    "ROWS UNBOUNDED PRECEDING) AS total FROM obs)", "obs")

STEP = "INTERVAL '6 hours'"


def _spanned(load: DataFrame) -> DataFrame:
    """Adds the first and the last cell of each series, before forecasts multiply the rows."""
    w = W.partitionBy("series_id")
    return load.withColumns({"lo": F.min("grid_ts").over(w), "hi": F.max("grid_ts").over(w)})


def forecast_log(spark: SparkSession, sf: str) -> DataFrame:
    """Two models, issued at every midnight and noon, leads of 6 to 48 hours.

    seasonal_naive repeats the load of 48 hours before the target and changes
    version mid-month; last_value repeats the last full bin and has no version
    for every fifth user. Bands are +-20 %.
    """
    # a constant, spread by compiled code; times stay whole seconds until the rows are chosen
    each = [("seasonal_naive", k, 2 * DAY - k * SIX, 2 * DAY) for k in range(1, 9)] + [("last_value", k, SIX, SIX + k * SIX) for k in range(1, 9)]
    leads = F.array(*[F.struct(F.lit(m).alias("m"), *[F.lit(x).cast("long").alias(c) for c, x in zip("kit", rest)]) for m, *rest in each])
    d = _spanned(load6(spark, sf)).select("series_id", "y", epoch("grid_ts").alias("at"), epoch("lo").alias("lo"), epoch("hi").alias("hi"))
    d = d.withColumn("f", F.explode(leads)).withColumns({"i": F.col("at") + F.col("f.i"), "t": F.col("at") + F.col("f.t")})
    d = d.filter((F.pmod(F.col("i"), F.lit(43200)) == 0) & (F.col("i") >= F.col("lo")) & (F.col("i") <= F.col("hi"))).select(
        "series_id", F.col("f.m").alias("model_name"), F.col("y").alias("predicted"), from_epoch("i").alias("issued_at"),
        from_epoch("t").alias("target_dt"), (F.col("f.k") * 360).alias("lead_minutes"))
    old = F.col("issued_at") < F.lit("2024-01-16").cast("timestamp_ntz")
    version = F.when(F.col("model_name") == "seasonal_naive", F.when(old, "v1").otherwise("v2")).when(
        F.col("series_id").cast("long") % 5 != 0, "v1")
    return d.select(
        F.col("series_id").alias("experiment"), "model_name", version.alias("model_version"), "issued_at", "target_dt", "lead_minutes", "predicted",
        F.lit("point").alias("forecast_type"), (F.col("predicted") * 1.2).alias("upper"), (F.col("predicted") * 0.8).alias("lower"),
    )


cte("flog_base",
    "SELECT series_id, 'seasonal_naive' AS model_name, grid_ts + INTERVAL '48 hours' - k * INTERVAL '6 hours' AS issued_at, "
    "grid_ts + INTERVAL '48 hours' AS target_dt, k, y AS base FROM load6, unnest(generate_series(1, 8)) AS u(k) "
    "UNION ALL SELECT series_id, 'last_value', grid_ts + INTERVAL '6 hours', grid_ts + INTERVAL '6 hours' + k * INTERVAL '6 hours', k, y "
    "FROM load6, unnest(generate_series(1, 8)) AS u(k)", "load6")
cte("forecast_log",
    "SELECT b.series_id AS experiment, model_name, CASE WHEN model_name = 'seasonal_naive' THEN "
    "CASE WHEN issued_at < TIMESTAMP '2024-01-16' THEN 'v1' ELSE 'v2' END "
    "WHEN CAST(b.series_id AS BIGINT) % 5 <> 0 THEN 'v1' END AS model_version, issued_at, target_dt, "
    "CAST(k * 360 AS BIGINT) AS lead_minutes, base AS predicted, 'point' AS forecast_type, "
    "base * CAST(1.2 AS DOUBLE) AS upper, base * CAST(0.8 AS DOUBLE) AS lower "
    "FROM flog_base b JOIN (SELECT series_id, min(grid_ts) AS lo, max(grid_ts) AS hi FROM load6 GROUP BY 1) s USING (series_id) "
    "WHERE hour(issued_at) % 12 = 0 AND issued_at BETWEEN lo AND hi", "flog_base load6")


def actuals(spark: SparkSession, sf: str) -> DataFrame:
    return load6(spark, sf).select(F.col("series_id").alias("experiment"), "grid_ts", F.col("y").alias("value"))


cte("actuals", "SELECT series_id AS experiment, grid_ts, y AS value FROM load6", "load6")


def external_log(spark: SparkSession, sf: str) -> DataFrame:
    """Third-party forecasts: the load of 72 hours before, ``ext_b`` in another unit."""
    d = _spanned(load6(spark, sf)).select(
        "series_id", "y", "hi", shift("grid_ts", 3 * DAY).alias("target_dt"), F.explode(F.sequence(F.lit(1), F.lit(8))).alias("k")
    ).withColumn("source", F.explode(F.array(F.lit("ext_a"), F.lit("ext_b"))))
    d = d.withColumn("issued_at", from_epoch(epoch("target_dt") - F.col("k") * SIX)).filter((F.hour("issued_at") % 12) == 0)
    return d.filter(F.col("issued_at") <= F.col("hi")).select(
        F.col("series_id").alias("experiment"), "source", "issued_at", "target_dt",
        (F.col("k") * 360).cast("long").alias("lead_minutes"),
        F.when(F.col("source") == "ext_b", F.col("y") * 1000).otherwise(F.col("y")).alias("value"),
    )


cte("external_log",
    "SELECT l.series_id AS experiment, source, issued_at, target_dt, CAST(k * 360 AS BIGINT) AS lead_minutes, "
    "CASE WHEN source = 'ext_b' THEN y * 1000 ELSE y END AS value FROM (SELECT series_id, y, source, k, "
    "grid_ts + INTERVAL '72 hours' AS target_dt, grid_ts + INTERVAL '72 hours' - k * INTERVAL '6 hours' AS issued_at "
    "FROM load6, unnest(generate_series(1, 8)) AS u(k), (VALUES ('ext_a'), ('ext_b')) AS v(source)) l "
    "JOIN (SELECT series_id, max(grid_ts) AS hi FROM load6 GROUP BY 1) s USING (series_id) "
    "WHERE hour(issued_at) % 12 = 0 AND issued_at <= hi", "load6")


def daily_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Order cents per priority and day, null where no order came in."""
    o = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").alias("ts"),
        F.round(F.col("o_totalprice") * 100).alias("value"))
    d = resample(o, ["series_id"], DAY, "sum")
    return d.withColumn("y", F.when(F.col("y") != 0, F.col("y")))


cte("order_cents", "SELECT o_orderpriority AS series_id, o_orderdate AS ts, round(o_totalprice * 100) AS value FROM orders")
grid_ctes("daily_orders", "order_cents", "1 day", "sum(value)", "nullif(b.y, 0)")
