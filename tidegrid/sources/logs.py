"""Forecast logs: writing, pruning, statistics, published payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegrid.functions.timecols import epoch

# Fixed value: larger magnitudes are treated as corrupt.
SANE_LIMIT = 1e12

LOG_SCHEMA = ("experiment STRING, model_name STRING, issued_at TIMESTAMP_NTZ, target_dt TIMESTAMP_NTZ, lead_minutes BIGINT, "
              "predicted DOUBLE, forecast_type STRING, upper DOUBLE, lower DOUBLE, model_version STRING")


def sane(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) <= SANE_LIMIT), F.lit(False))


def log_forecast(forecasts: DataFrame) -> DataFrame:
    """Log rows of a snapshot: insane points are dropped, an insane band side becomes null."""
    lead = ((epoch("target_dt") - epoch("issued_at")) / 60).cast("long")
    d = forecasts.filter(sane(F.col("predicted")))
    return d.withColumns(
        {
            "lead_minutes": lead,
            "upper": F.when(sane(F.col("upper")), F.col("upper")),
            "lower": F.when(sane(F.col("lower")), F.col("lower")),
        }
    )


def append_log(rows: DataFrame, path: str) -> None:
    rows.withColumn("issue_date", F.to_date("issued_at")).write.mode("append").partitionBy("experiment", "issue_date").parquet(path)


def log_prune(log: DataFrame, before: str, include: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Log without rows issued before a cut-off.

    With ``include`` only the listed (model_name, model_version) cohorts are
    pruned, with ``exclude`` all but those. A null version matches null.
    """
    old = F.col("issued_at") < F.lit(before).cast("timestamp_ntz")
    if include is None and exclude is None:
        return log.filter(~old)
    listed = (include if include is not None else exclude).select(
        F.col("model_name").alias("__m"), F.col("model_version").alias("__v")
    ).distinct()
    same = (F.col("model_name") == F.col("__m")) & F.col("model_version").eqNullSafe(F.col("__v"))
    if include is not None:
        doomed = log.filter(old).join(listed, same, "left_anti")
    else:
        doomed = log.filter(old).join(listed, same, "left_semi")
    return log.filter(~old).unionByName(doomed)


def log_external(rows: DataFrame) -> DataFrame:
    """External trajectory rows with readable, finite values."""
    lead = ((epoch("target_dt") - epoch("issued_at")) / 60).cast("long")
    d = rows.withColumn("value", F.col("value").try_cast("double"))
    return d.filter(~F.isnan("value") & (F.abs("value") < float("inf"))).withColumn("lead_minutes", lead)


def run_history(runs: DataFrame, keep: int = 5) -> DataFrame:
    """The newest runs per experiment; equal run times keep the later version."""
    latest = runs.groupBy("experiment", "ran_at").agg(F.max_by("result", "version").alias("result"))
    w = W.partitionBy("experiment").orderBy(F.col("ran_at").desc())
    return latest.withColumn("run_rank", F.row_number().over(w).cast("long")).filter(F.col("run_rank") <= keep)


def publish_payload(log: DataFrame, by=("experiment", "model_name", "issued_at")) -> DataFrame:
    """One row per forecast with JSON lists of points and bands, four decimals, non-finite as null.

    A list is one forecast horizon, so it stays small however long the log is.
    """

    def points(c: str) -> Column:
        v = F.when(sane(F.col(c)), F.round(c, 4))
        entry = F.struct(F.col("target_dt").alias("t"), v.alias("v"))
        return F.sort_array(F.collect_list(entry))

    def text(c: str) -> Column:
        return F.to_json(
            F.transform(
                c, lambda e: F.struct(F.date_format(e["t"], "yyyy-MM-dd'T'HH:mm:ss").alias("datetime"), e["v"].alias("value"))
            ),
            {"ignoreNullFields": "false"},
        )

    d = log.groupBy(*by).agg(
        *[points(c).alias(f"__{c}") for c in ("predicted", "upper", "lower")], F.count(F.lit(1)).alias("n_points")
    )
    return d.select(
        *by, "n_points", text("__predicted").alias("forecast"), text("__upper").alias("upper"), text("__lower").alias("lower")
    )


def log_stats(log: DataFrame) -> DataFrame:
    """Rows and ranges per cohort."""
    return log.groupBy("experiment", "model_name", "model_version").agg(
        F.count(F.lit(1)).alias("n"), F.min("issued_at").alias("first_issued"), F.max("issued_at").alias("last_issued"),
        F.max("target_dt").alias("last_target"),
    )


def reforecast_targets(log: DataFrame) -> DataFrame:
    """Per experiment, how many targets were forecast at least twice."""
    per = log.groupBy("experiment", "target_dt").agg(F.min("issued_at").alias("a"), F.max("issued_at").alias("z"))
    return per.groupBy("experiment").agg(F.count_if(F.col("z") > F.col("a")).alias("multi_issue_targets"))


def cohort_probe(log: DataFrame, model: str, version: str, since: str, until: str) -> DataFrame:
    """Per experiment, the narrowest cohort with rows in the window: version, model, all or none."""
    w = log.filter(
        (F.col("issued_at") >= F.lit(since).cast("timestamp_ntz")) & (F.col("target_dt") <= F.lit(until).cast("timestamp_ntz"))
    )
    m = F.col("model_name") == model
    d = log.select("experiment").distinct().join(
        w.groupBy("experiment").agg(
            F.count_if(m & F.coalesce(F.col("model_version") == version, F.lit(False))).alias("n_version"),
            F.count_if(m).alias("n_model"), F.count(F.lit(1)).alias("n_all"),
        ),
        "experiment", "left",
    ).fillna(0)
    level = F.when(F.col("n_version") > 0, "version").when(F.col("n_model") > 0, "model").when(
        F.col("n_all") > 0, "all").otherwise("none")
    return d.withColumn("cohort", level)
