"""Filters, unit handling and series classification."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.timecols import as_col, local_day
from tidegrid.operators.scan import previous
from tidegrid.sources.logs import SANE_LIMIT

# Unit spellings and their size in kilo-units.
POWER_UNITS = {"w": 0.001, "watt": 0.001, "watts": 0.001, "kw": 1.0, "mw": 1000.0}
ENERGY_UNITS = {"wh": 0.001, "kwh": 1.0, "mwh": 1000.0}
# Fixed values of the corruption limit.
CORRUPT_FACTOR = 1e4
# Fixed values of the cumulative test.
CUMULATIVE_MIN_POINTS = 6
CUMULATIVE_SHARE = 0.8


def scale(c, factor) -> Column:
    return as_col(c) * F.coalesce(as_col(factor) if not isinstance(factor, (int, float)) else F.lit(float(factor)), F.lit(1.0))


def power_to_energy(c, interval_minutes: int) -> Column:
    return as_col(c) * F.lit(interval_minutes / 60.0)


def unit_class(unit) -> Column:
    """struct(dim, base) of a unit text."""
    u = F.lower(F.trim(as_col(unit)))
    dim = F.when(u.isNull() | (as_col(unit) == ""), "unknown").when(u.isin(list(POWER_UNITS)), "power").when(
        u.isin(list(ENERGY_UNITS)), "energy").otherwise("other")
    sizes = {**POWER_UNITS, **ENERGY_UNITS}
    table = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])
    return F.struct(dim.alias("dim"), F.coalesce(F.try_element_at(table, u), F.lit(1.0)).alias("base"))


def canonical_factor(dim, base, interval_hours: float) -> Column:
    """What one unit amounts to in kilo-energy per interval; 1 for unknown units."""
    d, b = as_col(dim), as_col(base)
    return F.when(d == "power", b * interval_hours).when(d == "energy", b).otherwise(F.lit(1.0))


def to_canonical_energy(df: DataFrame, keys, value: str, ts: str, interval_hours: float, out: str = "energy") -> DataFrame:
    """Energy per interval from columns ``dim``, ``base``, ``is_cumulative``; a cumulative fall is unknown."""
    d = previous(df, keys, [ts], "__pv", F.col(value))
    diff = F.col(value) - F.col("__pv")
    v = F.when(F.col("is_cumulative"), F.when(diff >= 0, diff)).otherwise(F.col(value))
    return d.withColumn(out, v * canonical_factor("dim", "base", interval_hours)).drop("__pv")


def from_canonical_energy(c, dim, base, interval_hours: float) -> Column:
    return as_col(c) / canonical_factor(dim, base, interval_hours)


def unit_suspect(dim, ratio, interval_hours: float) -> Column:
    """The kind of unit the values look to be in when their scale points to the other one."""
    d, r = as_col(dim), as_col(ratio)
    g = F.when(d == "energy", F.lit(1.0 / interval_hours)).when(d == "power", F.lit(interval_hours))
    hit = (r > 0) & (F.log(r) * F.log(g) > 0) & (F.abs(F.log(r)) > F.abs(F.log(g)) / 2)
    if abs(math.log(interval_hours)) < 1e-9:
        return F.lit(None).cast("string")
    return F.when(hit, F.when(d == "energy", "power").otherwise("energy"))


def _insane(v: Column, limit: Column) -> Column:
    return F.coalesce(F.isnan(v) | (F.abs(v) > limit), F.lit(True))


def corrupt_limits(actuals: DataFrame, keys, value: str = "value") -> DataFrame:
    return actuals.groupBy(*keys).agg(
        F.least(CORRUPT_FACTOR * F.max(F.abs(F.col(value))), F.lit(SANE_LIMIT)).alias("__limit")
    )


def drop_corrupt(df: DataFrame, actuals: DataFrame, keys, value: str = "value", actual: str = "value") -> DataFrame:
    """Rows within 10^4 times the largest actual of their key."""
    d = df.join(corrupt_limits(actuals, keys, actual), list(keys), "left")
    limit = F.coalesce("__limit", F.lit(SANE_LIMIT))
    return d.filter(~_insane(F.col(value), limit)).drop("__limit")


def corrupt_report(df: DataFrame, actuals: DataFrame, keys, value: str = "value", ts: str = "ts", actual: str = "value") -> DataFrame:
    """How many rows were dropped, their largest magnitude and the last time it happened."""
    d = df.join(corrupt_limits(actuals, keys, actual), list(keys), "left")
    bad = _insane(F.col(value), F.coalesce("__limit", F.lit(SANE_LIMIT)))
    return d.groupBy(*keys).agg(
        F.count_if(bad).alias("dropped"), F.max(F.when(bad, F.abs(F.col(value)))).alias("max_dropped"),
        F.max(F.when(bad, F.col(ts))).alias("last_dropped"),
    )


def exclude_dates(df: DataFrame, dates: DataFrame, ts: str = "ts", offset_hours: float = 0.0) -> DataFrame:
    """Without the listed local days. ``dates`` holds (day)."""
    return df.withColumn("__day", local_day(ts, None, offset_hours)).join(
        dates.select(F.col("day").alias("__day")), "__day", "left_anti"
    ).drop("__day")


def window_floor(df: DataFrame, now: str, days: int, reset_at: str | None = None, issued: str = "issued_at",
                 target: str = "target_dt") -> DataFrame:
    """Issued after the later of (now - days) and the reset, target already due."""
    n = F.lit(now).cast("timestamp_ntz")
    floor = n - F.make_dt_interval(F.lit(int(days)))
    if reset_at:
        floor = F.greatest(floor, F.lit(reset_at).cast("timestamp_ntz"))
    return df.filter((F.col(issued) >= floor) & (F.col(target) <= n))


def binary_detect(df: DataFrame, keys, value: str = "value", min_values: int = 2) -> DataFrame:
    """Whether every value of a key is 0 or 1 (with at least ``min_values`` readings)."""
    return df.groupBy(*keys).agg(
        (F.coalesce(F.bool_and(F.col(value).isin(0.0, 1.0)), F.lit(False)) & (F.count(value) >= min_values)).alias("is_binary")
    )


def looks_cumulative(df: DataFrame, keys, value: str = "value", ts: str = "ts") -> DataFrame:
    """At least 6 points, of whose steps at least 80 % do not fall."""
    d = previous(df.filter(F.col(value).isNotNull()), keys, [ts], "__pv", F.col(value))
    up = F.avg(F.when(F.col("__pv").isNotNull(), (F.col(value) >= F.col("__pv")).cast("double")))
    return d.groupBy(*keys).agg(
        (F.coalesce(up >= CUMULATIVE_SHARE, F.lit(False)) & (F.count(F.lit(1)) >= CUMULATIVE_MIN_POINTS)).alias("is_cumulative")
    )


def within_span(grid: DataFrame, points: DataFrame, keys, ts: str = "grid_ts", point_ts: str = "ts") -> DataFrame:
    """Grid cells between the first and the last published point."""
    span = points.groupBy(*keys).agg(F.min(point_ts).alias("__a"), F.max(point_ts).alias("__z"))
    return grid.join(span, list(keys)).filter((F.col(ts) >= F.col("__a")) & (F.col(ts) <= F.col("__z"))).drop("__a", "__z")


def null_guard(df: DataFrame, columns) -> DataFrame:
    return df.fillna(0.0, list(columns))


def null_report(df: DataFrame, columns) -> DataFrame:
    """Nulls replaced by ``null_guard``, one row per column."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return one.unpivot([], list(columns), "column_name", "n_null")


def covariate_status(df: DataFrame) -> DataFrame:
    """ok, partial or broken per covariate.

    Reads booleans ``state_numeric``, ``attr_path_ok``, ``service_future`` and
    the nullable ``attr_parsed`` (null: no future attribute configured).
    """
    lagged = F.col("state_numeric") | F.col("attr_path_ok")
    parsed = F.coalesce("attr_parsed", F.lit(False))
    failed = F.coalesce(~F.col("attr_parsed"), F.lit(False)) & ~F.col("service_future")
    future = (parsed & ~F.col("service_future")) | F.col("service_future")
    status = F.when(~lagged & ~future, "broken").when(failed, "partial").when(~lagged & future, "partial").otherwise("ok")
    return df.withColumn("status", status)


def trained_schema_pin(df: DataFrame, trained: list[str], keys, fills: DataFrame | None = None) -> DataFrame:
    """Columns in the order of training; absent ones come back, filled with the stored value.

    ``fills`` holds (keys, one column ``fill_<name>`` per covariate).
    """
    keys = list(keys)
    have = set(df.columns)
    others = [c for c in df.columns if c not in trained and c not in keys]
    d = df.join(fills, keys, "left") if fills is not None else df
    pinned = []
    for c in trained:
        base = F.col(c) if c in have else F.lit(None).cast("double")
        stored = F.col(f"fill_{c}") if fills is not None and f"fill_{c}" in fills.columns else F.lit(None).cast("double")
        pinned.append((base if c in have else F.coalesce(base, stored)).alias(c))
    return d.select(*keys, *[c for c in others if not c.startswith("fill_")], *pinned)
