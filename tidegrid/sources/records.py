"""Reading sensor records and forecast trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.timecols import as_col

# State words and their numeric meaning.
ON_WORDS = ["on", "true", "yes", "home", "open"]
OFF_WORDS = ["off", "false", "no", "not_home", "closed"]
UNKNOWN_WORDS = ["unknown", "unavailable", "none", ""]
# Keys of a trajectory entry, in order of preference.
TIME_KEYS = ["datetime", "period_start", "period_end", "time", "dt", "start"]
VALUE_KEYS = ["value", "pv_estimate", "state", "temperature", "cloud_coverage", "cloud_cover", "wind_speed",
              "precipitation", "humidity"]

RECORD_SCHEMA = "series_id STRING, state STRING, last_changed STRING, attributes MAP<STRING, STRING>"


def state_to_float(c) -> Column:
    """Words to 1/0, unknown words to null, everything else as a finite number or null."""
    w = F.lower(F.trim(as_col(c)))
    number = w.try_cast("double")
    finite = F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
    return F.when(w.isin(ON_WORDS), 1.0).when(w.isin(OFF_WORDS), 0.0).when(w.isin(UNKNOWN_WORDS), None).otherwise(finite)


def parse_timestamp(c) -> Column:
    """ISO-8601 with or without fraction, ``Z``, ``+01:00`` or ``+0100``; naive means UTC."""
    s = F.regexp_replace(F.trim(as_col(c)), r"([+-]\d{2})(\d{2})$", "$1:$2")
    s = F.when(s.rlike(r"(Z|[+-]\d{2}:\d{2})$"), s).otherwise(F.concat(s, F.lit("Z")))
    return s.try_cast("timestamp").cast("timestamp_ntz")


def read_records(spark, path: str) -> DataFrame:
    """JSON lines of raw sensor records."""
    return spark.read.schema(RECORD_SCHEMA).json(path)


def normalise_history(records: DataFrame, attribute_key: str | None = None, keep_null: bool = False) -> DataFrame:
    """Records to (series_id, ts, value). An absent attribute stays as a null row."""
    src = F.col("attributes").getItem(attribute_key) if attribute_key else F.col("state")
    d = records.select("series_id", parse_timestamp("last_changed").alias("ts"), state_to_float(src).alias("value"))
    d = d.filter(F.col("ts").isNotNull())
    return d if attribute_key or keep_null else d.filter(F.col("value").isNotNull())


def trajectory_points(df: DataFrame, attr: str, value_key: str | None = None) -> DataFrame:
    """Explode a forecast attribute (JSON text) into (ts, value, pos).

    The attribute is a map from time to number, or a list of entries. A list
    takes its keys from the first entry: the first known time key, and the
    given value key or the first known one. Unreadable entries are skipped.
    """
    text = F.col(attr)
    others = [c for c in df.columns if c != attr]
    is_list = F.ltrim(text).startswith("[")
    maps = F.from_json(F.when(~is_list, text), "map<string,string>")
    lists = F.from_json(F.when(is_list, text), "array<map<string,string>>")
    d = df.withColumn("__l", lists).withColumn("__m", F.map_entries(maps))
    first = F.map_keys(F.col("__l")[0])
    time_key = F.element_at(F.filter(F.array(*map(F.lit, TIME_KEYS)), lambda k: F.array_contains(first, k)), 1)
    known = F.element_at(F.filter(F.array(*map(F.lit, VALUE_KEYS)), lambda k: F.array_contains(first, k)), 1)
    if value_key:
        known = F.when(F.array_contains(first, value_key), F.lit(value_key)).otherwise(known)
    d = d.filter(F.col("__m").isNotNull() | (F.size("__l") > 0))
    d = d.withColumn("__tk", F.when(F.size("__l") > 0, time_key)).withColumn("__vk", F.when(F.size("__l") > 0, known))
    from_list = F.transform(
        "__l", lambda e: F.struct(e[F.col("__tk")].alias("key"), e[F.col("__vk")].alias("value"))
    )
    d = d.select(*others, F.posexplode(F.coalesce("__m", from_list)).alias("pos", "__e"))
    out = d.select(
        *others, "pos", parse_timestamp("__e.key").alias("ts"),
        F.trim("__e.value").try_cast("double").alias("value"),
    )
    return out.filter(F.col("ts").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value"))


def points_utc(points: DataFrame, keys, order: str = "pos") -> DataFrame:
    """Drop nulls and keep the first of equal times."""
    return points.filter(F.col("value").isNotNull()).groupBy(*keys, "ts").agg(F.min_by("value", order).alias("value"))
