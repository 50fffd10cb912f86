"""Regular grids, gap filling and day totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegrid.functions.timecols import bin_epoch, epoch, from_epoch, local_day, time_bin
from tidegrid.operators.scan import STRETCH, Scan, running

METHODS = ("mean", "sum", "max", "min", "last")


def _bin_agg(method: str, value: str, ts: str):
    if method == "last":
        return F.max_by(value, ts)
    return {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min}[method](value)


def spine(bounds: DataFrame, keys: Sequence[str], lo: str, hi: str, seconds: int, out: str = "grid_ts") -> DataFrame:
    """Every grid point from ``lo`` to ``hi`` (both on the grid) per key.

    Exploded in two steps, so no row carries an array longer than one stretch.
    """
    step = F.lit(int(seconds)).cast("long")
    width = max(STRETCH, int(seconds))
    width -= width % int(seconds)
    d = bounds.filter(F.col(lo).isNotNull()).select(
        *keys, epoch(lo).alias("__lo"), epoch(hi).alias("__hi")
    ).filter("__lo <= __hi")
    d = d.withColumn(
        "__s", F.explode(F.sequence(F.col("__lo"), F.col("__hi"), F.lit(width).cast("long")))
    )
    last = F.least(F.col("__hi"), F.col("__s") + width - step)
    return d.select(*keys, F.explode(F.sequence(F.col("__s"), last, step)).alias("__g")).select(
        *keys, from_epoch("__g").alias(out)
    )


def binned(df: DataFrame, keys, seconds: int, method: str = "mean", ts: str = "ts", value: str = "value",
           out: str = "y") -> DataFrame:
    """One row per occupied bin."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, time_bin(ts, seconds).alias("grid_ts"))
        .agg(_bin_agg(method, value, ts).alias(out))
    )


def resample(df: DataFrame, keys, seconds: int, method: str = "mean", ts: str = "ts", value: str = "value",
             out: str = "y", empty_sum: float | None = 0.0, tasks: int | None = None) -> DataFrame:
    """Complete grid from the first to the last bin; an empty bin is ``empty_sum`` for ``sum``, else null.

    The bounds come from the bins, so the readings are passed over once. With
    ``tasks`` the bins are dealt to that many tasks by series before the grid is
    spread, and what is derived from it and joined by series needs no further
    shuffle; for many series, as a task gets whole ones.
    """
    bins = binned(df, keys, seconds, method, ts, value, out)
    if tasks:
        full = _spread(bins.repartition(tasks, *keys), list(keys), seconds, out)
        return full.fillna(empty_sum, [out]) if method == "sum" and empty_sum is not None else full
    span = bins.groupBy(*keys).agg(F.min("grid_ts").alias("__a"), F.max("grid_ts").alias("__z"))
    # a join by merging: the size of the file says little about the number of bins, so the optimizer would broadcast them
    full = spine(span, keys, "__a", "__z", seconds).join(bins.hint("merge"), [*keys, "grid_ts"], "left")
    return full.fillna(empty_sum, [out]) if method == "sum" and empty_sum is not None else full


def _spread(bins: DataFrame, keys, seconds: int, out: str) -> DataFrame:
    """Every occupied bin and the empty ones up to the next, in two steps as in ``spine``; no join."""
    step = F.lit(int(seconds)).cast("long")
    width = max(STRETCH, int(seconds))
    width -= width % int(seconds)
    w = W.partitionBy(*keys).orderBy("grid_ts")
    d = bins.select(*keys, out, epoch("grid_ts").alias("__t"), F.coalesce(epoch(F.lead("grid_ts").over(w)) - step, epoch("grid_ts")).alias("__hi"))
    d = d.withColumn("__s", F.explode(F.sequence(F.col("__t"), F.col("__hi"), F.lit(width).cast("long"))))
    last = F.least(F.col("__hi"), F.col("__s") + width - step)
    d = d.withColumn("__g", F.explode(F.sequence(F.col("__s"), last, step)))
    return d.select(*keys, from_epoch("__g").alias("grid_ts"), F.when(F.col("__g") == F.col("__t"), F.col(out)).alias(out))


def fill_hold(df: DataFrame, keys, value: str = "y", ts: str = "grid_ts", out: str | None = None) -> DataFrame:
    """Carry forward, then back-fill the head."""
    scans = [
        Scan("__p", "last", F.col(value)),
        Scan("__q", "last", F.col(value), backward=True),
    ]
    d = running(df, keys, [ts], scans)
    return d.withColumn(out or value, F.coalesce("__p", "__q")).drop("__p", "__q")


def fill_linear(df: DataFrame, keys, seconds: int, gap_max_minutes: int = 90, value: str = "y",
                ts: str = "grid_ts", out: str | None = None) -> DataFrame:
    """Linear between neighbours, at most ``gap_max`` cells into any gap.

    The first cells of a longer gap are filled as well; a trailing gap holds
    the last value up to the same limit; only the head is back-filled.
    """
    limit = max(1, int(gap_max_minutes // max(1, seconds // 60)))
    point = F.when(F.col(value).isNotNull(), F.struct(epoch(ts).alias("t"), F.col(value).alias("v")))
    d = running(df, keys, [ts], [Scan("__p", "last", point), Scan("__q", "last", point, backward=True)])
    t = epoch(ts)
    p, q = F.col("__p"), F.col("__q")
    steps = (t - p["t"]) / seconds
    line = p["v"] + (q["v"] - p["v"]) * (t - p["t"]) / (q["t"] - p["t"])
    filled = (
        F.when(F.col(value).isNotNull(), F.col(value))
        .when(p.isNull(), q["v"])
        .when(steps > limit, F.lit(None).cast("double"))
        .when(q.isNull(), p["v"])
        .otherwise(line)
    )
    return d.withColumn(out or value, filled).drop("__p", "__q")


def fill_mask(df: DataFrame, *_args, **_kw) -> DataFrame:
    """Gaps stay null."""
    return df


def resample_covariates(df: DataFrame, keys, seconds: int, methods: DataFrame) -> DataFrame:
    """Per-series aggregation: binary series take the last state and hold it, others the mean.

    ``methods`` holds (keys, method); series that are not listed use the mean.
    """
    bins = df.filter(F.col("value").isNotNull()).groupBy(*keys, time_bin("ts", seconds).alias("grid_ts")).agg(
        *[_bin_agg(m, "value", "ts").alias(f"__{m}") for m in METHODS]
    )
    span = df.filter(F.col("value").isNotNull()).groupBy(*keys).agg(
        time_bin(F.min("ts"), seconds).alias("__a"), time_bin(F.max("ts"), seconds).alias("__z")
    )
    d = spine(span, keys, "__a", "__z", seconds).join(bins, [*keys, "grid_ts"], "left")
    d = d.join(methods, list(keys), "left").withColumn("method", F.coalesce("method", F.lit("mean")))
    y = F.lit(None).cast("double")
    for m in METHODS:
        filled = F.coalesce(F.col(f"__{m}"), F.lit(0.0)) if m == "sum" else F.col(f"__{m}")
        y = F.when(F.col("method") == m, filled).otherwise(y)
    d = d.withColumn("y", y)
    d = running(d, keys, ["grid_ts"], [Scan("__p", "last", F.col("y"))])
    return d.select(
        *keys, "grid_ts", F.when(F.col("method") == "last", F.col("__p")).otherwise(F.col("y")).alias("y")
    )


def idle_fill(df: DataFrame, fill: float = 0.0, value: str = "y", ghi: str | None = "ghi",
              elevation: str | None = None, idle_value: float | None = None) -> DataFrame:
    """Night cells take ``fill``; without a sun column, nulls take ``idle_value``."""
    y = F.col(value)
    if ghi or elevation:
        night = (F.col(ghi) <= 0) if ghi else (F.col(elevation) < -0.833)
        return df.withColumn(value, F.when(night & (y.isNull() | (y != fill)), F.lit(float(fill))).otherwise(y))
    if idle_value is None:
        return df
    return df.withColumn(value, F.coalesce(y, F.lit(float(idle_value))))


def hold_stale_tail(df: DataFrame, keys, seconds: int, live: DataFrame, now: str) -> DataFrame:
    """Extend a grid to ``now`` with the live value when the newest cell is over two intervals old.

    ``live`` holds (keys, live_value).
    """
    now_ts = F.lit(now).cast("timestamp_ntz")
    newest = df.filter(F.col("y").isNotNull()).groupBy(*keys).agg(F.max("grid_ts").alias("__hi"))
    stale = newest.withColumn("__now", now_ts).filter(
        epoch("__now") - epoch("__hi") > 2 * seconds
    )
    tail = spine(
        stale.select(
            *keys,
            from_epoch(epoch("__hi") + seconds).alias("__a"),
            from_epoch(bin_epoch("__now", seconds)).alias("__z"),
        ),
        keys, "__a", "__z", seconds,
    ).join(live, list(keys)).filter(F.col("live_value").isNotNull())
    both = df.select(*keys, "grid_ts", "y", F.lit(0).alias("__r")).unionByName(
        tail.select(*keys, "grid_ts", F.col("live_value").alias("y"), F.lit(1).alias("__r"))
    )
    return both.groupBy(*keys, "grid_ts").agg(
        F.coalesce(F.max(F.when(F.col("__r") == 0, F.col("y"))), F.max(F.when(F.col("__r") == 1, F.col("y")))).alias("y"),
        F.max("__r").cast("boolean").alias("held"),
    )


def gap_runs(df: DataFrame, keys, seconds: int, value: str = "y", ts: str = "grid_ts") -> DataFrame:
    """Runs of missing cells as (start, end, n) on a complete grid."""
    measured = running(
        df.select(*keys, ts, value), keys, [ts], [Scan("__island", "count", F.col(value))]
    )
    return (
        measured.filter(F.col(value).isNull())
        .groupBy(*keys, "__island")
        .agg(F.min(ts).alias("gap_start"), F.max(ts).alias("gap_end"), F.count(F.lit(1)).alias("n"))
        .drop("__island")
    )


def gap_spans(df: DataFrame, keys, seconds: int, top: int = 3, value: str = "y", ts: str = "grid_ts") -> DataFrame:
    """The longest gaps per series."""
    w = W.partitionBy(*keys).orderBy(F.col("n").desc(), F.col("gap_start"))
    runs = gap_runs(df, keys, seconds, value, ts)
    return runs.withColumn("gap_rank", F.row_number().over(w).cast("long")).filter(F.col("gap_rank") <= top)


def daily_cumsum(df: DataFrame, keys, value: str = "y", ts: str = "grid_ts", tz: str | None = None,
                 offset_hours: float = 0.0, null_as_zero: bool = False, out: str = "day_total") -> DataFrame:
    """Running total within each local day."""
    v = F.coalesce(F.col(value), F.lit(0.0)) if null_as_zero else F.col(value)
    d = df.withColumn("__day", local_day(ts, tz, offset_hours))
    w = W.partitionBy(*keys, "__day").orderBy(ts).rowsBetween(W.unboundedPreceding, 0)
    return d.withColumn(out, F.sum(v).over(w)).drop("__day")


def complete_day_cumsum(df: DataFrame, keys, seconds: int, value: str = "y", ts: str = "grid_ts",
                        offset_hours: float = 0.0, out: str = "day_total") -> DataFrame:
    """Running total that becomes unknown once a bin of the day is unmeasured or absent."""
    off = int(offset_hours * 3600)
    bin_no = F.expr(f"pmod(unix_seconds(cast(`{ts}` as timestamp)) + {off}, 86400) div {seconds}") + 1
    d = df.withColumn("__day", local_day(ts, None, offset_hours))
    w = W.partitionBy(*keys, "__day").orderBy(ts).rowsBetween(W.unboundedPreceding, 0)
    total = F.when(F.count(value).over(w) == bin_no, F.sum(value).over(w))
    return d.withColumn(out, total).drop("__day")
