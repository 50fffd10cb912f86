"""Outlier clipping, variance transforms and shape statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegrid.functions.timecols import epoch
from tidegrid.operators.grid import resample
from tidegrid.operators.quantiles import exact_quantiles
from tidegrid.operators.scan import Scan, drop_halo, halo_window, running, with_halo

# Fixed values.
MAD_WIDTH = 3.5
BLOWUP_FACTOR = 10.0
LEVEL_SCALE_RANGE = (0.5, 2.0)
PSI_FLOOR = 1e-4
PSI_MODERATE, PSI_SIGNIFICANT = 0.1, 0.2


def clip_quantile(df: DataFrame, keys, q: float = 0.999, lower: str = "auto", positive_only: bool = False,
                  value: str = "y") -> DataFrame:
    """Clip to [lower, q-quantile]. lower: zero, off, symmetric (the 1-q quantile) or auto (zero for positive series)."""
    keys = list(keys)
    if lower == "auto":
        lower = "zero" if positive_only else "symmetric"
    lows = {"zero": F.lit(0.0), "off": F.col("__min"), "symmetric": F.col("__lo")}
    cuts = exact_quantiles(df, keys, value, {"__hi": q, "__lo": 1 - q, "__min": 0.0}, count="__n")
    d = df.join(cuts, keys, "left")
    v = F.greatest(F.least(F.col(value), F.col("__hi")), lows[lower])
    v = F.when(F.col(value).isNotNull() & (F.col("__n") >= 2), v).otherwise(F.col(value))
    return d.withColumn(value, v).drop("__hi", "__lo", "__min", "__n")


def clip_mad(df: DataFrame, keys, width: float = MAD_WIDTH, value: str = "y") -> DataFrame:
    """Clip to median +- width x MAD; a zero MAD leaves the series alone."""
    keys = list(keys)
    med = exact_quantiles(df, keys, value, {"__med": 0.5})
    d = df.join(med, keys, "left")
    mad = exact_quantiles(d.withColumn("__dev", F.abs(F.col(value) - F.col("__med"))), keys, "__dev", {"__mad": 0.5})
    d = d.join(mad, keys, "left")
    reach = width * F.col("__mad")
    v = F.greatest(F.least(F.col(value), F.col("__med") + reach), F.col("__med") - reach)
    keep = F.col(value).isNull() | (F.coalesce("__mad", F.lit(0.0)) == 0)
    return d.withColumn(value, F.when(keep, F.col(value)).otherwise(v)).drop("__med", "__mad")


def log_shift(df: DataFrame, keys, value: str = "y") -> DataFrame:
    """Parameters of ln(x + shift): 1 for non-negative series, else |min| + 1."""
    m = F.min(value)
    return df.groupBy(*keys).agg(F.when(m >= 0, F.lit(1.0)).otherwise(F.abs(m) + 1.0).alias("shift"), m.alias("lower"))


def fit_transform(df: DataFrame, keys, kind: str, value: str = "y") -> DataFrame:
    """Parameter table (keys, transform, shift, lower) of a transform."""
    m = F.min(value)
    shifts = {
        "log": F.when(m > 0, F.lit(0.0)).when(m == 0, F.lit(1.0)).otherwise(F.abs(m) + 1.0),
        "shifted_log": F.when(m >= 0, F.lit(1.0)).otherwise(F.abs(m) + 1.0),
        "sqrt": F.lit(None).cast("double"),
    }
    shifts["box_cox"] = shifts["shifted_log"]
    if kind not in shifts:
        raise ValueError(f"unknown transform {kind!r}")
    name = "shifted_log" if kind == "box_cox" else kind
    return df.groupBy(*keys).agg(F.lit(name).alias("transform"), shifts[kind].alias("shift"), m.cast("double").alias("lower"))


def apply_transform(df: DataFrame, params: DataFrame, keys, value: str = "y", pinned: bool = False) -> DataFrame:
    """Apply fitted parameters. ``pinned`` floors x + shift at min(1, lower + shift) for later windows."""
    d = df.join(params, list(keys), "left")
    arg = F.col(value) + F.col("shift")
    if pinned:
        arg = F.greatest(arg, F.least(F.lit(1.0), F.coalesce(F.col("lower") + F.col("shift"), F.lit(1.0))))
    out = F.when(F.col("transform") == "sqrt", F.sqrt(F.greatest(F.col(value), F.lit(0.0)))).when(
        F.col("transform").isNotNull(), F.ln(arg)).otherwise(F.col(value))
    return d.withColumn(value, F.when(F.col(value).isNotNull(), out)).drop("transform", "shift", "lower")


def invert_transform(df: DataFrame, params: DataFrame, keys, value: str = "y") -> DataFrame:
    d = df.join(params, list(keys), "left")
    out = F.when(F.col("transform") == "sqrt", F.col(value) * F.col(value)).when(
        F.col("transform").isNotNull(), F.exp(value) - F.col("shift")).otherwise(F.col(value))
    return d.withColumn(value, out).drop("transform", "shift", "lower")


def future_on_model_scale(future: DataFrame, record: DataFrame, keys, value: str = "value") -> DataFrame:
    """Future covariate values through the trained map; without a complete record the value is not used."""
    whole = record.filter(
        (F.col("transform") == "sqrt") | (F.col("shift").isNotNull() & F.col("lower").isNotNull())
    ).withColumn("__ok", F.lit(True))
    d = apply_transform(future, whole.drop("__ok"), keys, value, pinned=True)
    return d.join(whole.select(*keys, "__ok"), list(keys), "left").withColumn(
        value, F.when(F.col("__ok"), F.col(value))
    ).drop("__ok")


def blowup_clamp(pred: DataFrame, history: DataFrame, keys, value: str = "pred", observed: str = "y",
                 factor: float = BLOWUP_FACTOR) -> DataFrame:
    """Cap forecasts at ``factor`` times the largest observation; ``clamped`` marks the cells."""
    top = history.groupBy(*keys).agg((factor * F.max(observed)).alias("__cap"))
    d = pred.join(top, list(keys), "left")
    hit = F.coalesce((F.col("__cap") > 0) & (F.col(value) > F.col("__cap")), F.lit(False))
    return d.withColumn("clamped", hit).withColumn(value, F.when(hit, F.col("__cap")).otherwise(F.col(value))).drop("__cap")


def nonneg_floor(pred: DataFrame, history: DataFrame, keys, value: str = "pred", observed: str = "y") -> DataFrame:
    low = history.groupBy(*keys).agg(F.min(observed).alias("__min"))
    d = pred.join(low, list(keys), "left")
    v = F.when(F.col("__min") >= 0, F.greatest(F.col(value), F.lit(0.0))).otherwise(F.col(value))
    return d.withColumn(value, v).drop("__min")


def spikiness(df: DataFrame, keys, value: str = "y") -> DataFrame:
    """p99 over the mean magnitude: how much of the series sits in spikes."""
    keys = list(keys)
    both = F.array(
        F.struct(F.lit("p").alias("k"), F.col(value).alias("x")),
        F.struct(F.lit("m").alias("k"), F.when(F.col(value) != 0, F.abs(value)).alias("x")),
    )
    long = df.select(*keys, F.explode(both).alias("s")).select(*keys, F.col("s.k").alias("__k"), F.col("s.x").alias("__x"))
    q = exact_quantiles(long, [*keys, "__k"], "__x", {"p99": 0.99, "p50": 0.5}).groupBy(*keys).agg(
        F.max(F.when(F.col("__k") == "p", F.col("p99"))).alias("__p99"),
        F.max(F.when(F.col("__k") == "m", F.col("p50"))).alias("__mid"),
    )
    stats = df.groupBy(*keys).agg(F.avg(F.abs(value)).alias("__mean"), F.count(value).alias("__n"))
    eps = F.greatest(F.lit(1e-9), 1e-3 * F.coalesce("__mid", F.lit(0.0)))
    return stats.join(q, keys, "left").select(
        *keys, F.when(F.col("__n") >= 2, F.col("__p99") / (F.col("__mean") + eps)).alias("spikiness")
    )


def _resid_frame(df: DataFrame, keys, seconds: int, value: str, ts: str):
    lag = max(1, round(86400 / seconds))
    d = with_halo(df, ts, before=(lag + lag // 2 + 1) * seconds, after=(lag // 2 + 1) * seconds)
    w = halo_window(keys, ts)
    # A centred window of an even width takes one more row from the past.
    frame = w.rowsBetween(-(lag // 2), (lag - 1) // 2)
    base = F.when(F.count(value).over(frame) >= max(2, lag // 2), F.avg(value).over(frame))
    d = d.withColumn("__resid", F.col(value) - base)
    return drop_halo(d.withColumn("__before", F.lag("__resid", lag).over(w))), lag


def daily_autocorr(df: DataFrame, keys, seconds: int, value: str = "y", ts: str = "grid_ts") -> DataFrame:
    """Correlation of the detrended series with itself one day earlier, on a grid with gaps.

    Null with at most two days of cells or a constant side, 0 for a series
    that is all trend.
    """
    d, lag = _resid_frame(df, keys, seconds, value, ts)
    pair = F.col("__resid").isNotNull() & F.col("__before").isNotNull()
    a, b = F.when(pair, F.col("__resid")), F.when(pair, F.col("__before"))
    s = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp(value).alias("sy"), F.stddev_samp("__resid").alias("sr"),
        F.count(a).alias("np"), F.stddev_samp(a).alias("sa"), F.stddev_samp(b).alias("sb"), F.covar_samp(a, b).alias("c"),
    )
    r = (
        F.when((F.col("n") <= 2 * lag) | F.col("sy").isNull() | (F.col("sy") <= 0), None)
        .when(F.coalesce("sr", F.lit(0.0)) < 1e-6 * F.col("sy"), F.lit(0.0))
        .when((F.col("np") < 2) | (F.col("sa") < 1e-12) | (F.col("sb") < 1e-12), None)
        .otherwise(F.try_divide("c", F.col("sa") * F.col("sb")))  # F.corr raises an error as soon as one series is constant
    )
    return s.select(*keys, r.alias("daily_autocorr"))


def level_scale(df: DataFrame, keys, y: str = "y", fitted: str = "fitted", weight: str | None = None) -> DataFrame:
    """mean(y) / mean(fitted), clipped to [0.5, 2]."""
    w = F.col(weight) if weight else F.lit(1.0)
    top, bottom = F.sum(w * F.col(y)), F.sum(w * F.col(fitted))
    lo, hi = LEVEL_SCALE_RANGE
    ratio = F.when((bottom > 0) & (top > 0), F.greatest(F.least(top / bottom, F.lit(hi)), F.lit(lo))).otherwise(F.lit(1.0))
    return df.groupBy(*keys).agg(ratio.alias("level_scale"))


def recency_weight(df: DataFrame, keys, half_life_rows: float, ts: str = "grid_ts", out: str = "weight") -> DataFrame:
    """Exponential weights that double every half life and average to 1.

    Counted back from the newest row, so the exponent never grows with the series.
    """
    d = running(df, keys, [ts], [Scan("__back", "count", F.lit(1), inclusive=False, backward=True)])
    raw = F.exp(-F.col("__back") * F.lit(0.6931471805599453 / half_life_rows))
    d = d.withColumn("__w", raw)
    s = d.groupBy(*keys).agg((F.count(F.lit(1)) / F.sum("__w")).alias("__f"))
    return d.join(s, list(keys)).withColumn(out, F.col("__w") * F.col("__f")).drop("__w", "__f", "__back")


def ma_decompose(df: DataFrame, keys, seconds: int, half: int = 12, value: str = "y", ts: str = "grid_ts") -> DataFrame:
    """Centred moving-average trend and remainder; the ends average what there is."""
    d = with_halo(df, ts, before=(half + 1) * seconds, after=(half + 1) * seconds)
    w = halo_window(keys, ts).rowsBetween(-half, half)
    d = drop_halo(d.withColumn("trend", F.avg(value).over(w)))
    return d.withColumn("remainder", F.col(value) - F.col("trend"))


def psi_drift(train: DataFrame, test: DataFrame, keys, value: str = "y", min_train: int = 20, min_test: int = 5) -> DataFrame:
    """Population stability between two windows on the training deciles.

    Values outside the training range are ignored; equal edges collapse. Series
    with fewer than ``min_train`` or ``min_test`` values in a window (or none at
    all) come back with a null psi and the verdict ``insufficient``.
    """
    keys = list(keys)
    names = {f"q{i}": i / 10 for i in range(11)}
    q = exact_quantiles(train, keys, value, names, count="train_n")
    edges = q.select(
        *keys, "train_n", F.array_distinct(F.array(*names)).alias("edges"), F.col("q1").alias("train_p10"), F.col("q9").alias("train_p90")
    )
    tq = exact_quantiles(test, keys, value, {"test_p10": 0.1, "test_p90": 0.9}, count="test_n")

    def stats(d, tag):
        return d.groupBy(*keys).agg(F.avg(value).alias(f"{tag}_mean"), F.stddev_pop(value).alias(f"{tag}_std"))

    both = train.select(*keys, F.col(value).alias("__v"), F.lit(1).alias("__a")).unionByName(
        test.select(*keys, F.col(value).alias("__v"), F.lit(0).alias("__a"))
    ).filter(F.col("__v").isNotNull())
    e = F.col("edges")
    d = both.join(edges, keys).filter((F.col("__v") >= e[0]) & (F.col("__v") <= F.element_at(e, -1)))
    slot = F.least(F.size(F.filter(e, lambda x: x <= F.col("__v"))), F.size(e) - 1)
    bins = d.groupBy(*keys, slot.alias("__b")).agg(
        F.sum("__a").alias("__ta"), F.sum(1 - F.col("__a")).alias("__te")
    )
    slots = edges.filter(F.size("edges") >= 3).select(
        *keys, F.explode(F.sequence(F.lit(1), F.size("edges") - 1)).alias("__b")
    )
    full = slots.join(bins, [*keys, "__b"], "left").fillna(0, ["__ta", "__te"])
    w = W.partitionBy(*keys)
    p = F.greatest(F.col("__ta") / F.greatest(F.sum("__ta").over(w), F.lit(1)), F.lit(PSI_FLOOR))
    r = F.greatest(F.col("__te") / F.greatest(F.sum("__te").over(w), F.lit(1)), F.lit(PSI_FLOOR))
    psi = full.withColumns({"__p": p, "__r": r}).groupBy(*keys).agg(
        F.sum((F.col("__r") - F.col("__p")) * F.ln(F.col("__r") / F.col("__p"))).alias("psi")
    )
    out = stats(train, "train").join(stats(test, "test"), keys, "full").join(edges.drop("edges"), keys, "left").join(tq, keys, "left")
    out = out.join(psi, keys, "left").fillna(0, ["train_n", "test_n"])
    enough = (F.col("train_n") >= min_train) & (F.col("test_n") >= min_test)
    return out.withColumn("psi", F.when(enough, F.coalesce("psi", F.lit(0.0)))).withColumn(
        "verdict",
        F.when(~enough, "insufficient").when(F.col("psi") < PSI_MODERATE, "stable").when(F.col("psi") < PSI_SIGNIFICANT, "moderate shift").otherwise("significant shift"),
    )


def data_report(df: DataFrame, keys, interval_minutes: int, now: str, max_increment: float | None = None,
                gap_multiplier: int = 4, ts: str = "ts", value: str = "value", shape: str | None = "mean") -> DataFrame:
    """Health of each series: coverage, staleness, gaps, nulls, zero runs and a verdict.

    ``shape`` names how readings become grid cells (``mean``, ``sum``, ...) for
    ``spikiness`` and ``daily_autocorr``; None leaves both out. For a counter,
    hand in its decoded use and ``sum``.
    """
    keys = list(keys)
    d = running(
        df, keys, [ts],
        [
            Scan("__p", "last", F.struct(F.col(ts).alias("t"), F.col(value).alias("v")), inclusive=False),
            Scan("__nz", "count", F.when(F.col(value) != 0, F.lit(1))),
        ],
    )
    gap = (epoch(ts) - epoch("__p.t")) / 60.0
    base = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows_total"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
        F.max(gap).alias("biggest_gap_minutes"), F.count_if(gap > interval_minutes * gap_multiplier).alias("big_gap_count"),
        F.count(value).alias("__nn"), F.min(value).alias("value_min"), F.max(value).alias("value_max"),
        F.stddev_samp(value).alias("value_std"),
        F.count_if(F.col(value) - F.col("__p.v") > (max_increment if max_increment is not None else float("inf"))).alias("max_increment_hits"),
    )
    zeros = d.filter(F.col(value) == 0).groupBy(*keys, "__nz").agg(F.count(F.lit(1)).alias("__z")).groupBy(*keys).agg(
        F.max("__z").alias("max_zero_run"))
    med = exact_quantiles(df, keys, value, {"value_median": 0.5})
    out = base.join(zeros, keys, "left").join(med, keys, "left").fillna(0, ["max_zero_run"]).fillna(0.0, ["biggest_gap_minutes"])
    n = F.lit(now).cast("timestamp_ntz")
    out = out.withColumns(
        {
            "recorder_age_minutes": (epoch(n) - epoch("last_ts")) / 60.0,
            "rows_expected": F.greatest(F.lit(1), F.floor((epoch(n) - epoch("first_ts")) / (interval_minutes * 60))),
            "null_pct": F.round(100.0 * (1.0 - F.col("__nn") / F.col("rows_total")), 1),
        }
    )
    out = out.withColumn("coverage_pct", F.round(F.least(F.lit(100.0), 100.0 * F.col("rows_total") / F.col("rows_expected")), 1))
    alert = (F.col("big_gap_count") > 0) & (F.col("biggest_gap_minutes") > interval_minutes * 24)
    warn = (F.col("recorder_age_minutes") > interval_minutes * 4) | (F.col("coverage_pct") < 70) | (F.col("null_pct") > 5)
    verdict = F.when(alert, "alert").when(warn, "warning").otherwise("ok")
    out = out.withColumn("verdict", verdict).drop("__nn")
    if shape is None:
        return out
    grid = resample(df, keys, interval_minutes * 60, shape, ts=ts, value=value)
    rhythm = daily_autocorr(grid, keys, interval_minutes * 60)
    return out.join(spikiness(grid, keys), keys, "left").join(rhythm, keys, "left")


def report_rollup(report: DataFrame, expected: DataFrame, keys) -> DataFrame:
    """Series per verdict; expected series without any rows count as no-data."""
    d = expected.join(report.select(*keys, "verdict"), list(keys), "left")
    return d.groupBy(F.coalesce("verdict", F.lit("no-data")).alias("verdict")).agg(F.count(F.lit(1)).alias("n_series"))


def frame_diff(a: DataFrame, b: DataFrame, keys, columns) -> DataFrame:
    """Per column: differing cells, largest difference, null mismatches, first differing time, unmatched rows.

    The last key is the time column.
    """
    keys, columns = list(keys), list(columns)

    def long(d, tag):
        u = d.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
        return u.unpivot(keys, columns, "column_name", f"__{tag}").withColumn(f"__has_{tag}", F.lit(True))

    j = long(a, "a").join(long(b, "b"), [*keys, "column_name"], "full")
    both = F.col("__has_a").isNotNull() & F.col("__has_b").isNotNull()
    differs = both & ~F.col("__a").eqNullSafe(F.col("__b"))
    return j.groupBy("column_name").agg(
        F.count_if(differs).alias("n_diff"), F.max(F.when(both, F.abs(F.col("__a") - F.col("__b")))).alias("max_abs_diff"),
        F.count_if(both & (F.col("__a").isNull() != F.col("__b").isNull())).alias("null_mismatch"),
        F.min(F.when(differs, F.col(keys[-1]))).alias("first_diff"),
        F.count_if(F.col("__has_b").isNull()).alias("only_left"), F.count_if(F.col("__has_a").isNull()).alias("only_right"),
    )


def schema_diff(a: DataFrame, b: DataFrame) -> dict[str, list[str]]:
    ta, tb = dict(a.dtypes), dict(b.dtypes)
    return {
        "missing": sorted(set(ta) - set(tb)), "extra": sorted(set(tb) - set(ta)),
        "retyped": sorted(c for c in ta if c in tb and ta[c] != tb[c]),
    }


def column_fingerprint(df: DataFrame, keys, columns) -> DataFrame:
    """Order-free hash, mean, spread and null count per column."""
    keys = list(keys)
    u = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(keys, list(columns), "column_name", "v")
    return u.groupBy("column_name").agg(
        F.bit_xor(F.xxhash64(*keys, "column_name", "v")).alias("fingerprint"), F.avg("v").alias("mean"),
        F.stddev_pop("v").alias("std"), F.count_if(F.col("v").isNull()).alias("n_null"),
    )
