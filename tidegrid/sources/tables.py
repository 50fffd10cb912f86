"""Keyed history tables: insert, upsert, merge, incremental read, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.timecols import shift


def append_ignore(stored: DataFrame, new: DataFrame, key=("series_id", "ts")) -> DataFrame:
    """Rows of ``new`` whose key is not stored yet; of equal new keys the first version wins."""
    key = list(key)
    fresh = new.groupBy(*key).agg(F.min_by("value", "version").alias("value"))
    return fresh.join(stored.select(*key), key, "left_anti")


def upsert(stored: DataFrame, new: DataFrame, key=("series_id", "ts")) -> DataFrame:
    """Stored rows overwritten by key; among new rows the highest version wins."""
    key = list(key)
    both = stored.select(*key, "value", F.lit(None).cast("long").alias("version")).unionByName(
        new.select(*key, "value", F.col("version").cast("long").alias("version"))
    )
    return both.groupBy(*key).agg(
        F.max_by(F.struct("value"), F.coalesce("version", F.lit(-(2**62)))).getField("value").alias("value")
    )


def merge_keep_last(cached: DataFrame, fresh: DataFrame, key=("series_id", "ts")) -> DataFrame:
    """Union in which the fresh row wins on equal keys."""
    key = list(key)
    both = cached.select(*key, "value", F.lit(0).alias("r")).unionByName(fresh.select(*key, "value", F.lit(1).alias("r")))
    return both.groupBy(*key).agg(F.max_by(F.struct("value"), "r").getField("value").alias("value"))


def incremental_read(source: DataFrame, cached: DataFrame, start: str, seconds: int, keys=("series_id",)) -> DataFrame:
    """Rows newer than the cache, or the whole window where the cache starts too late."""
    keys = list(keys)
    begin = F.lit(start).cast("timestamp_ntz")
    marks = cached.groupBy(*keys).agg(F.min("ts").alias("__lo"), F.max("ts").alias("__hi"))
    d = source.filter(F.col("ts") >= begin).join(marks, keys, "left")
    covered = F.coalesce(F.col("__lo") <= shift(begin, seconds), F.lit(False))
    return d.filter(~covered | (F.col("ts") > F.col("__hi"))).withColumn("backfill", ~covered).drop("__lo", "__hi")


def retention(df: DataFrame, users: DataFrame, now: str, default_days: int = 365, key: str = "series_id") -> DataFrame:
    """Keep a table as long as the most demanding of its users asks. ``users`` holds (key, days)."""
    keep = users.groupBy(key).agg(F.max("days").alias("__days"))
    d = df.join(keep, key, "left")
    limit = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.coalesce("__days", F.lit(default_days)).cast("int"))
    return d.filter(F.col("ts") >= limit).drop("__days")
