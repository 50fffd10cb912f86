"""Subtracting sub-loads from a parent load."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegrid.functions.timecols import epoch, local_day, shift
from tidegrid.operators.scan import Scan, running

# Share of a day's totals above which a leftover makes the day unmeasured,
# and the load below which a ratio says nothing.
UNMEASURED_SHARE = 0.1
NEAR_ZERO_LOAD = 1e-9


class SubtractError(ValueError):
    """A subtracted sensor exceeds its allowed share of the load."""


def subtract_series(base: DataFrame, other: DataFrame, keys, seconds: int, fill: str = "ffill", ts: str = "grid_ts",
                    value: str = "y") -> DataFrame:
    """base - other on base's grid; unknown differences hold the last known one, and a head without one stays null.

    ``fill`` says what ``other`` is where it has no value: the last one
    (``ffill``), the next one (``bfill``), or the line between both, which
    holds the last value at the end (``interpolate``).
    """
    keys = list(keys)
    if fill not in ("ffill", "bfill", "interpolate"):
        raise ValueError(f"unknown fill {fill!r}")
    d = base.select(*keys, ts, F.col(value).alias("__b")).join(
        other.select(*keys, ts, F.col(value).alias("__o")), [*keys, ts], "left"
    )
    point = F.when(F.col("__o").isNotNull(), F.struct(epoch(ts).alias("t"), F.col("__o").alias("v")))
    sides = {"ffill": ["__p"], "bfill": ["__q"], "interpolate": ["__p", "__q"]}[fill]
    d = running(d, keys, [ts], [Scan(name, "last", point, backward=name == "__q") for name in sides])
    if fill == "interpolate":
        p, q, t = F.col("__p"), F.col("__q"), epoch(ts)
        line = p["v"] + (q["v"] - p["v"]) * (t - p["t"]) / (q["t"] - p["t"])
        filled = F.when(p.isNull() | q.isNull() | (p["t"] == q["t"]), p["v"]).otherwise(line)
    else:
        filled = F.col(sides[0])["v"]
    d = d.withColumn("__d", F.col("__b") - filled).drop("__b", "__o", *sides)
    return running(d, keys, [ts], [Scan(value, "last", F.col("__d"))]).drop("__d")


def aligned_sensors(load: DataFrame, sensors: DataFrame, config: DataFrame, keys, ts: str = "grid_ts",
                    value: str = "y") -> DataFrame:
    """One row per load cell and configured sensor, scaled; ``sub`` is null where the sensor is silent.

    ``config`` holds (keys, entity_id, scale, on_missing, max_fraction, max_violation_pct).
    """
    keys = list(keys)
    cells = load.select(*keys, ts, F.col(value).alias("load")).join(config, keys)
    got = sensors.select(*keys, "entity_id", ts, F.col(value).alias("__s"))
    return cells.join(got, [*keys, "entity_id", ts], "left").withColumn(
        "sub", F.col("__s") * F.coalesce("scale", F.lit(1.0))
    ).drop("__s")


def load_subtract(load: DataFrame, sensors: DataFrame, config: DataFrame, keys, ts: str = "grid_ts",
                  value: str = "y", clip: bool = True) -> DataFrame:
    """Net load per cell: (load, total_sub, raw_net, net, clipped).

    A silent sensor counts as zero (policy ``zero``), removes the cell (``drop``)
    or fails the job (``error``); a policy of any other name fails it as well.
    """
    keys = list(keys)
    per = aligned_sensors(load, sensors, config, keys, ts, value)
    where = F.concat(F.lit("sensor "), F.col("entity_id"), F.lit(" is silent at "), F.col(ts).cast("string"), F.lit(", policy "), F.coalesce("on_missing", F.lit("null")))
    silent = F.when(F.col("sub").isNull() & ~F.coalesce(F.col("on_missing").isin("zero", "drop"), F.lit(False)), F.raise_error(where))
    per = per.withColumn("sub", F.coalesce(silent.cast("double"), F.col("sub")))
    totals = per.groupBy(*keys, ts).agg(
        F.sum(F.coalesce("sub", F.lit(0.0))).alias("total_sub"),
        F.max(F.col("sub").isNull() & (F.col("on_missing") == "drop")).alias("__drop"),
    )
    d = load.select(*keys, ts, F.col(value).alias("load")).join(totals, [*keys, ts], "left")
    d = d.filter(~F.coalesce("__drop", F.lit(False))).withColumn("total_sub", F.coalesce("total_sub", F.lit(0.0)))
    d = d.withColumn("raw_net", F.col("load") - F.col("total_sub"))
    net = F.greatest(F.col("raw_net"), F.lit(0.0)) if clip else F.col("raw_net")
    return d.select(
        *keys, ts, "load", "total_sub", "raw_net",
        F.when(F.col("raw_net").isNotNull(), net).alias("net"),
        F.coalesce(F.col("raw_net") < 0, F.lit(False)).alias("clipped"),
    )


def subtract_guard(load: DataFrame, sensors: DataFrame, config: DataFrame, keys, ts: str = "grid_ts",
                   value: str = "y") -> DataFrame:
    """Per sensor: share of cells above the allowed fraction, and whether that breaks the limit."""
    per = aligned_sensors(load, sensors, config, list(keys), ts, value)
    valid = F.abs("load") > NEAR_ZERO_LOAD
    ratio = F.coalesce(F.abs("sub"), F.lit(0.0)) / F.abs("load")
    d = per.filter(valid).groupBy(*keys, "entity_id").agg(
        F.count(F.lit(1)).alias("n_valid"),
        F.max(ratio).alias("max_ratio"),
        F.count_if(ratio > F.col("max_fraction")).alias("violation_rows"),
        F.max("max_violation_pct").alias("limit_pct"),
    )
    pct = 100.0 * F.col("violation_rows") / F.col("n_valid")
    return d.withColumn("violation_pct", pct).withColumn("violated", pct > F.col("limit_pct"))


def enforce_guard(guard: DataFrame) -> None:
    """Raise for violations: the message names five sensors and counts the others."""
    bad = guard.filter("violated")
    some = bad.limit(5).collect()
    if some:
        more = bad.count() - len(some)
        named = "; ".join(f"{r['entity_id']}: {r['violation_pct']:.2f}% of rows" for r in some)
        raise SubtractError(named + (f"; and {more} more" if more else ""))


def carry_deficit(df: DataFrame, keys, raw: str = "raw_net", ts: str = "grid_ts", tz: str | None = None,
                  out: str = "net") -> DataFrame:
    """Carry a below-zero remainder into later cells of the local day.

    With S the running sum of the day and M = max(0, running max of S), the
    adjusted cell is M - previous M; null cells pass through.
    """
    keys = list(keys)
    d = df.withColumn("__day", local_day(ts, tz))
    w = W.partitionBy(*keys, "__day").orderBy(ts)
    frame = w.rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("__s", F.coalesce(F.sum(raw).over(frame), F.lit(0.0)))
    d = d.withColumn("__m", F.greatest(F.lit(0.0), F.max("__s").over(frame)))
    step = F.col("__m") - F.coalesce(F.lag("__m").over(w), F.lit(0.0))
    return d.withColumn(out, F.when(F.col(raw).isNotNull(), step)).drop("__day", "__s", "__m")


def day_leftovers(df: DataFrame, keys, raw: str = "raw_net", net: str = "net", ts: str = "grid_ts",
                  tz: str | None = None) -> DataFrame:
    """Per local day: what the day could not absorb, and whether it counts as unmeasured.

    A series' last day is still open and never unmeasured.
    """
    keys = list(keys)
    days = df.groupBy(*keys, local_day(ts, tz).alias("day")).agg(
        (F.sum(net) - F.sum(raw)).alias("leftover"),
        F.sum(F.when(F.col(raw).isNotNull(), F.col("total_sub"))).alias("day_sub"),
        F.sum(F.when(F.col(raw).isNotNull(), F.col("load"))).alias("day_load"),
    )
    last = days.groupBy(*keys).agg(F.max("day").alias("__open"))
    left = F.col("leftover")
    bad = (
        (F.col("day") != F.col("__open"))
        & (left > 1e-9)
        & (left > UNMEASURED_SHARE * F.col("day_sub"))
        & (left > UNMEASURED_SHARE * F.col("day_load"))
    )
    return days.join(last, keys).withColumn("unmeasured", F.coalesce(bad, F.lit(False))).drop("__open")


def mask_unmeasured_days(df: DataFrame, keys, raw: str = "raw_net", net: str = "net", ts: str = "grid_ts",
                         tz: str | None = None) -> DataFrame:
    keys = list(keys)
    bad = day_leftovers(df, keys, raw, net, ts, tz).filter("unmeasured").select(
        *keys, F.col("day").alias("__day"), F.lit(True).alias("__bad")
    )
    d = df.withColumn("__day", local_day(ts, tz)).join(bad, [*keys, "__day"], "left")
    return d.withColumn(net, F.when(F.col("__bad").isNull(), F.col(net))).drop("__day", "__bad")


def subtract_audit(load: DataFrame, sensors: DataFrame, config: DataFrame, keys, ts: str = "grid_ts",
                   value: str = "y") -> DataFrame:
    """Per sensor: present, missing and dropped cells, totals, worst ratio, leading and trailing gaps."""
    keys = list(keys)
    per = aligned_sensors(load, sensors, config, keys, ts, value)
    ratio = F.when(
        F.abs("load") > NEAR_ZERO_LOAD, F.coalesce(F.abs("sub"), F.lit(0.0)) / F.abs("load")
    )
    have = F.col("sub").isNotNull()
    d = per.groupBy(*keys, "entity_id").agg(
        F.count_if(have).alias("rows_present"),
        F.count_if(~have).alias("rows_missing"),
        F.count_if(~have & (F.col("on_missing") == "drop")).alias("rows_dropped"),
        F.sum(F.coalesce("sub", F.lit(0.0))).alias("sum_sub"),
        F.avg(F.coalesce("sub", F.lit(0.0))).alias("mean_sub"),
        F.max(ratio).alias("max_ratio"),
        F.min(ts).alias("__a"), F.max(ts).alias("__z"),
        F.min(F.when(have, F.col(ts))).alias("first_present"),
        F.max(F.when(have, F.col(ts))).alias("last_present"),
    )
    return d.withColumns(
        {
            "leading_gap": F.coalesce(F.col("first_present") > F.col("__a"), F.lit(True)),
            "trailing_gap": F.coalesce(F.col("last_present") < F.col("__z"), F.lit(False)),
        }
    ).drop("__a", "__z")


def net_actuals_rewrite(net: DataFrame, audit: DataFrame, keys, written: DataFrame | None = None,
                        cumulative: bool = True, rewrite_days: int = 2, ts: str = "grid_ts", value: str = "net",
                        tz: str | None = None) -> DataFrame:
    """The cells to store this cycle, with their local ``day``.

    Nothing before every sensor's leading gap has ended; for a cumulative
    target nothing on that first local day either, and unmeasured cells are
    kept as null. ``written`` holds (keys, newest): what was stored before is
    rewritten for its last ``rewrite_days`` only.
    """
    keys = list(keys)
    starts = audit.groupBy(*keys).agg(F.max("first_present").alias("__from"))
    d = net.join(starts, keys).filter(F.col(ts) >= F.col("__from")).withColumn("day", local_day(ts, tz))
    if cumulative:
        d = d.filter(F.col("day") > local_day("__from", tz))
    else:
        d = d.filter(F.col(value).isNotNull())
    if written is not None:
        newest = net.groupBy(*keys).agg(F.max(ts).alias("__max"))
        d = d.join(newest, keys).join(written.select(*keys, "newest"), keys, "left")
        tail = shift(F.least("__max", "newest"), -rewrite_days * 86400)
        d = d.filter(F.col("newest").isNull() | (F.col(ts) >= tail))
    return d.select(*keys, ts, "day", F.col(value).alias("value"))


def write_net_actuals(df: DataFrame, path: str) -> None:
    """Overwrite only the day partitions present in ``df``."""
    df.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def subtract_sources(config: DataFrame) -> DataFrame:
    """Resolve ``source`` = auto from the target's kind, and name the resampling it implies.

    Cumulative sources are decoded and summed per bin, all others averaged.
    """
    source = F.when(F.col("source") != "auto", F.col("source")).when(
        F.col("target_cumulative") & F.col("target_reset_daily"), F.lit("cumulative_daily")
    ).when(F.col("target_cumulative"), F.lit("cumulative_monotonic")).otherwise(F.lit("interval"))
    return config.withColumn("resolved", source).withColumn(
        "method", F.when(F.col("resolved").startswith("cumulative"), F.lit("sum")).otherwise(F.lit("mean"))
    )


def subtract_inputs(raw: DataFrame, sources: DataFrame, keys, seconds: int) -> DataFrame:
    """Sub-load cells per sensor according to ``subtract_sources``."""
    from tidegrid.operators.counters import decode_counter
    from tidegrid.operators.grid import resample

    keys = [*keys, "entity_id"]
    d = raw.join(sources.select(*keys, "resolved"), keys)
    minutes = max(1, seconds // 60)
    mean = resample(d.filter(F.col("resolved") == "interval"), keys, seconds, "mean")
    parts = [mean]
    for name, daily in (("cumulative_daily", True), ("cumulative_monotonic", False)):
        used = decode_counter(d.filter(F.col("resolved") == name), keys, minutes, reset_daily=daily)
        parts.append(resample(used, keys, seconds, "sum", value="use"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
