"""Calendar columns from local wall-clock time."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.timecols import to_local


def calendar(df: DataFrame, ts: str = "grid_ts", tz: str = "UTC", interval_minutes: int = 60, cyclic: bool = True) -> DataFrame:
    """hour, dow (Monday 0), is_weekend, month, day, the slot of the day below one hour, and sine/cosine of hour and dow."""
    t = to_local(ts, tz)
    cols = {
        "hour": F.hour(t).cast("long"), "dow": F.weekday(t).cast("long"), "is_weekend": (F.weekday(t) >= 5).cast("long"),
        "month": F.month(t).cast("long"), "day": F.dayofmonth(t).cast("long"),
    }
    if interval_minutes < 60:
        cols["slot_of_day"] = F.floor((F.hour(t) * 60 + F.minute(t)) / interval_minutes)
    if cyclic:
        for name, x, period in (("hour", F.hour(t), 24), ("dow", F.weekday(t), 7)):
            cols[f"{name}_sin"] = F.sin(x * (2 * math.pi / period))
            cols[f"{name}_cos"] = F.cos(x * (2 * math.pi / period))
    return df.withColumns(cols)


def holiday_flag(df: DataFrame, holidays: DataFrame, ts: str = "grid_ts", tz: str = "UTC") -> DataFrame:
    """``holidays`` holds (day); a calendar's size is bounded by days, so the optimizer may broadcast it."""
    days = holidays.select(F.col("day").alias("__day"), F.lit(1).cast("long").alias("__h")).distinct()
    d = df.withColumn("__day", F.to_date(to_local(ts, tz))).join(days, "__day", "left")
    return d.withColumn("is_holiday", F.coalesce("__h", F.lit(0))).drop("__day", "__h")
