"""Error metrics as aggregate columns over ``y``, ``pred`` and training scales."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.quantiles import exact_quantiles
from tidegrid.operators.scan import drop_halo, halo_window, with_halo

# Fixed values.
PEAK_MIN_ACTIVE = 8
PEAK_MAX_EXCESS = 9.0
QUANTILE_LEVELS = [round(0.05 * k, 2) for k in range(1, 20)]
FORBIDDEN_WORDS = ("import", "exec", "__")
# Error function approximation 7.1.26 of the handbook of Abramowitz and Stegun.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: Column) -> Column:
    t = 1.0 / (1.0 + ERF_P * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return F.signum(x) * (1.0 - poly * F.exp(-x * x))


def two_sided_p(z: Column) -> Column:
    return 1.0 - erf(F.abs(z) / F.sqrt(F.lit(2.0)))


def _pair(y: str, p: str) -> tuple[Column, Column, Column]:
    ok = F.col(y).isNotNull() & F.col(p).isNotNull()
    return ok, F.when(ok, F.col(y)), F.when(ok, F.col(p))


def mae(y="y", p="pred") -> Column:
    return F.avg(F.abs(F.col(y) - F.col(p)))


def rmse(y="y", p="pred") -> Column:
    e = F.col(y) - F.col(p)
    return F.sqrt(F.avg(e * e))


def mape(y="y", p="pred") -> Column:
    return 100.0 * F.avg(F.when(F.col(y) != 0, F.abs((F.col(y) - F.col(p)) / F.col(y))))


def smape(y="y", p="pred") -> Column:
    d = F.abs(y) + F.abs(p)
    return 100.0 * F.avg(F.when(d != 0, 2.0 * F.abs(F.col(y) - F.col(p)) / d))


def mase(y="y", p="pred", scale="scale_1") -> Column:
    s = F.max(scale)
    return F.when(s > 0, mae(y, p) / s)


def seasonal_mase(y="y", p="pred", scale="scale_season") -> Column:
    return mase(y, p, scale)


def r_squared(y="y", p="pred") -> Column:
    ok, a, b = _pair(y, p)
    total = F.var_pop(a) * F.count(a)
    return F.when(total > 0, 1.0 - F.sum((a - b) * (a - b)) / total)


def pinball(q: float, y="y", p="pred") -> Column:
    e = F.col(y) - F.col(p)
    return F.avg(F.greatest(q * e, (q - 1.0) * e))


def peak_weighted_mae(y="y", p="pred", median="peak_median", spread="peak_spread") -> Column:
    """Needs the columns of ``peak_params``."""
    _, a, b = _pair(y, p)
    excess = F.least(F.greatest((a - F.col(median)) / F.col(spread), F.lit(0.0)), F.lit(PEAK_MAX_EXCESS))
    w = F.when(F.col(spread) > 0, 1.0 + excess).otherwise(F.when(a.isNotNull(), F.lit(1.0)))
    return F.sum(w * F.abs(a - b)) / F.sum(w)


def interval_coverage(y="y", lower="lower", upper="upper") -> Column:
    inside = (F.col(y) >= F.col(lower)) & (F.col(y) <= F.col(upper))
    return F.avg(inside.cast("double"))


def bias_pct(y="y", p="pred") -> Column:
    _, a, b = _pair(y, p)
    return F.when(F.sum(a) > 0, 100.0 * (F.sum(b) / F.sum(a) - 1.0))


def amplitude_ratio(y="y", p="pred") -> Column:
    _, a, b = _pair(y, p)
    return F.when(F.stddev_pop(a) > 0, F.stddev_pop(b) / F.stddev_pop(a))


def rounded(v: Column, places: int) -> Column:
    """``round`` of a double, decided in binary where that is safe; only values close to a half way are written out as decimals.

    Short, as a method of over 8000 bytes for a row stays interpreted; so a small negative value may become -0.0, which equals 0."""
    s = v * F.lit(10.0 ** places)
    whole = F.rint(s)
    safe = (F.abs(s - whole) < 0.499) & (F.abs(whole) < 1e12)
    return F.when(safe, whole / F.lit(10.0 ** places)).otherwise(F.round(v, places))


def crps(y: Column, quantiles: Column) -> Column:
    """Twice the mean pinball loss over the 19 levels, per row."""
    total = F.lit(0.0)
    for k, q in enumerate(QUANTILE_LEVELS):  # compiled; a loop over the array by lambdas would be interpreted row by row
        e = y - F.get(quantiles, F.lit(k))
        total = total + F.when(e >= 0, q * e).otherwise((q - 1.0) * e)
    return 2.0 * total / len(QUANTILE_LEVELS)


METRICS: dict[str, Callable[[], Column]] = {
    "mae": mae, "rmse": rmse, "mape": mape, "smape": smape, "mase": mase, "seasonal_mase": seasonal_mase,
    "r_squared": r_squared, "pinball_q90": lambda: pinball(0.9), "peak_weighted_mae": peak_weighted_mae,
    "coverage": interval_coverage,
}
HIGHER_IS_BETTER = {"r_squared", "coverage"}


def register(name: str, build: Callable[[], Column]) -> None:
    """Add a metric: a function that returns an aggregate column."""
    METRICS[name] = build


def register_custom(name: str, sql: str) -> None:
    """Add a metric written as a SQL aggregate over y_true and y_pred."""
    if any(w in sql.lower() for w in FORBIDDEN_WORDS):
        raise ValueError("expression uses a forbidden word")
    import re

    text = re.sub(r"\by_true\b", "y", re.sub(r"\by_pred\b", "pred", sql))
    METRICS[name] = lambda: F.expr(text)


def train_scales(train: DataFrame, keys, season: int, seconds: int, y: str = "y", ts: str = "grid_ts") -> DataFrame:
    """Mean absolute step and seasonal step of the training rows; short series use the plain step."""
    d = with_halo(train, ts, before=(season + 1) * seconds)
    w = halo_window(keys, ts)
    d = drop_halo(d.withColumns({"__d1": F.abs(F.col(y) - F.lag(y, 1).over(w)), "__ds": F.abs(F.col(y) - F.lag(y, season).over(w))}))
    s = d.groupBy(*keys).agg(F.avg("__d1").alias("scale_1"), F.avg("__ds").alias("__s"))
    return s.select(*keys, "scale_1", F.coalesce("__s", "scale_1").alias("scale_season"))


def peak_params(df: DataFrame, by, y: str = "y", p: str = "pred") -> DataFrame:
    """Median and spread that weight the peaks.

    The spread is p90 - median; where that is not positive, the p90 of the
    values above the median, if there are at least 8 of them.
    """
    by = list(by)
    ok = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).select(*by, y)
    q = exact_quantiles(ok, by, y, {"peak_median": 0.5, "__p90": 0.9})
    active = ok.join(q, by).filter(F.col(y) > F.col("peak_median"))
    a = exact_quantiles(active, by, y, {"__a90": 0.9}, count="__na")
    d = q.join(a, by, "left")
    first = F.col("__p90") - F.col("peak_median")
    second = F.when(F.col("__na") >= PEAK_MIN_ACTIVE, F.col("__a90") - F.col("peak_median"))
    return d.select(*by, "peak_median", F.when(first > 0, first).otherwise(second).alias("peak_spread"))


def compute_all(df: DataFrame, by, names: list[str], long: bool = True) -> DataFrame:
    """Every requested metric in one aggregation; unknown names are an error.

    A metric that is undefined for a group is null. Long form is (by, metric, value).
    """
    unknown = [n for n in names if n not in METRICS]
    if unknown:
        raise ValueError(f"unknown metrics {unknown}")
    if "peak_weighted_mae" in names and "peak_spread" not in df.columns:
        df = df.join(peak_params(df, by), list(by), "left")
    out = df.groupBy(*by).agg(*[METRICS[n]().cast("double").alias(n) for n in names])
    return out.unpivot(list(by), names, "metric", "value") if long else out


def daily_space(df: DataFrame, by, ts: str = "grid_ts", y: str = "y", p: str = "pred") -> DataFrame:
    """Sums per date; groups with fewer than two days are left out."""
    by = list(by)
    days = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*by, F.to_date(ts).alias("day")).agg(
        F.sum(y).alias(y), F.sum(p).alias(p))
    enough = days.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).filter("__n >= 2").drop("__n")
    return days.join(enough, by)
