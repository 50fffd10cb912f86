"""One-step models rolled forward over leads, for a whole fleet at once.

A ``Recipe`` names the features of a one-step model. The same recipe gives the
supervised rows (``supervised``, from complete grids) and the features of a
lead (``roll_forward``, from a buffer that predictions are appended to), so
training and forecasting cannot drift apart.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.calendar import calendar
from tidegrid.functions.timecols import epoch, from_epoch
from tidegrid.operators.features import tail_rows, target_features
from tidegrid.operators.forecast import future_cells, with_shares
from tidegrid.operators.grid import fill_hold
from tidegrid.session import cut_lineage


@dataclass(frozen=True)
class Recipe:
    """Features of a one-step model.

    ``windows`` give rolling mean, deviation and maximum of the cells before,
    ``clock`` names columns of ``calendar``, ``covariates`` columns known for
    future cells. With ``light`` (irradiance) lags of dark cells are 0 and dark
    cells are forecast as 0.
    """

    lags: tuple[int, ...]
    windows: tuple[int, ...] = ()
    diff: bool = False
    clock: tuple[str, ...] = ("hour",)
    covariates: tuple[str, ...] = ()
    light: str | None = None
    tz: str = "UTC"

    @property
    def names(self) -> list[str]:
        rolling = [f"y_rolling_{stat}_{n}" for n in self.windows for stat in ("mean", "std", "max")]
        return [*(f"y_lag_{k}" for k in self.lags), *rolling, *(["y_diff_1"] if self.diff else []), *self.clock, *self.covariates]

    @property
    def known(self) -> list[str]:
        """Columns a future cell must bring along."""
        return [*self.covariates, *([self.light] if self.light else [])]

    @property
    def reach(self) -> int:
        return max([*self.lags, *self.windows, 2 if self.diff else 1])


def history_features(grid: DataFrame, keys, seconds: int, recipe: Recipe) -> DataFrame:
    """(keys, grid_ts, y, features) of every measured cell. ``grid`` holds the recipe's known columns as well."""
    d = target_features(grid, keys, seconds // 60, max(recipe.lags), list(recipe.windows) or [2], ghi=recipe.light)
    d = calendar(d, tz=recipe.tz, interval_minutes=max(1, seconds // 60))
    return d.select(*keys, "grid_ts", "y", *[F.col(c).cast("double").alias(c) for c in recipe.names])


def supervised(grid: DataFrame, keys, seconds: int, recipe: Recipe, valid_share: float = 0.2, test_share: float = 0.0) -> DataFrame:
    """Rows with all features and a label, as ``fit_pooled`` takes them."""
    d = history_features(grid, keys, seconds, recipe).dropna(subset=["y", *recipe.names])
    d = with_shares(d, keys, valid_share, test_share).withColumn("label", F.col("y").cast("double"))
    return VectorAssembler(inputCols=recipe.names, outputCol="features").transform(d.drop("y"))


def model_step(model, recipe: Recipe) -> Callable[[DataFrame], DataFrame]:
    """``prediction`` by a fitted MLlib model."""
    va = VectorAssembler(inputCols=recipe.names, outputCol="features")
    return lambda d: model.transform(va.transform(d))


def weighted_step(weights: dict[str, float], intercept: float = 0.0) -> Callable[[DataFrame], DataFrame]:
    """``prediction`` by stated weights."""
    def step(d: DataFrame) -> DataFrame:
        total = F.lit(float(intercept))
        for name, w in weights.items():
            total = total + F.col(name) * w
        return d.withColumn("prediction", total)

    return step


def _start(grid: DataFrame, keys, seconds: int, horizon: int, recipe: Recipe, future: DataFrame | None) -> DataFrame:
    """(keys, issued_at, cells, light, ahead, status): the buffer, irradiance of its cells and of all leads, known values by lead."""
    need, columns = recipe.reach, [*keys, "grid_ts", "y", *([recipe.light] if recipe.light else [])]
    tail = fill_hold(tail_rows(grid.select(*columns), keys, seconds, need), keys)
    cell = F.struct("grid_ts", F.col("y").cast("double").alias("y"), (F.col(recipe.light) if recipe.light else F.lit(1)).cast("double").alias("light"))
    d = tail.groupBy(*keys).agg(F.max("grid_ts").alias("issued_at"), F.sort_array(F.collect_list(cell)).alias("__c"))
    d = d.select(*keys, "issued_at", F.col("__c.y").alias("cells"), F.col("__c.light").alias("light"))
    whole = (F.size("cells") == need) & ~F.exists("cells", lambda v: v.isNull())
    status = F.when(whole, "ok").otherwise("short")
    if not recipe.known:
        return d.withColumns({"status": status, "ahead": F.array().cast("array<struct<lead:bigint>>")})
    known = future.groupBy(*keys, F.col("grid_ts").alias("target_dt")).agg(*[F.max(c).cast("double").alias(c) for c in recipe.known])
    cells = future_cells(grid, keys, seconds, horizon).join(known, [*keys, "target_dt"], "left")
    ahead = cells.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("lead", *recipe.known))).alias("ahead"))
    gap = F.exists("ahead", lambda a: F.greatest(*[a[c].isNull().cast("int") for c in recipe.known], F.lit(0)) == 1)
    d = d.join(ahead, list(keys)).withColumn("status", F.when(~whole, "short").when(gap, "unknown").otherwise("ok"))
    return d.withColumn("light", F.concat("light", F.transform("ahead", lambda a: a[recipe.light]))) if recipe.light else d


def _features(d: DataFrame, recipe: Recipe, seconds: int, h: int) -> DataFrame:
    """The recipe's columns for lead ``h``; the buffer ends with lead ``h - 1``."""
    end = recipe.reach + h

    def cell(k):
        return F.element_at("cells", end - k)

    def lit_only(k, c):
        return F.when(F.element_at("light", end - k) > 0, c).otherwise(F.lit(0.0)) if recipe.light else c

    cols = {f"y_lag_{k}": lit_only(k, cell(k)) for k in recipe.lags}
    if recipe.diff:
        cols["y_diff_1"] = lit_only(1, cell(1) - cell(2))
    for c in recipe.covariates:
        cols[c] = F.element_at("ahead", h)[c]
    for n in recipe.windows:
        past = F.slice("cells", end - n, n)
        cols[f"y_rolling_mean_{n}"] = F.aggregate(past, F.lit(0.0), lambda a, x: a + x) / n
        cols[f"y_rolling_max_{n}"] = F.array_max(past)
    d = d.withColumns({**cols, "target_dt": from_epoch(epoch("issued_at") + h * seconds)})
    spread = {}
    for n in recipe.windows:
        mean = F.col(f"y_rolling_mean_{n}")
        squares = F.aggregate(F.transform(F.slice("cells", end - n, n), lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x)
        spread[f"y_rolling_std_{n}"] = F.sqrt(squares / (n - 1))
    d = calendar(d.withColumns(spread) if spread else d, "target_dt", recipe.tz, max(1, seconds // 60))
    return d.withColumns({c: F.col(c).cast("double") for c in recipe.clock})


def roll_forward(step: Callable[[DataFrame], DataFrame], grid: DataFrame, keys, seconds: int, horizon: int, recipe: Recipe,
                 future: DataFrame | None = None, checkpoint_every: int = 4, trace: bool = False) -> DataFrame:
    """(keys, issued_at, target_dt, lead, pred, status) after the last cell of every series.

    ``step`` adds ``prediction`` to rows with the recipe's features. The loop
    runs over leads, each step for the whole fleet; the buffer is as long as the
    recipe reaches plus the horizon. Gaps inside it hold the value before them.
    ``future`` holds (keys, grid_ts, known columns); of several rows of a cell
    the largest values count. Series with too few cells come back with null
    predictions as ``short``, those with an unknown covariate as ``unknown``.
    ``trace`` adds the features each prediction was made from, as an array.
    """
    keys = list(keys)
    if recipe.known and future is None:
        raise ValueError(f"future cells need {recipe.known}")
    if any(n < 2 for n in recipe.windows):
        raise ValueError("rolling windows span two cells or more")
    start = cut_lineage(_start(grid, keys, seconds, horizon, recipe, future))
    start = start.withColumn("used", F.array().cast("array<array<double>>"))
    d = start.filter("status = 'ok'")
    for h in range(1, horizon + 1):
        pred = F.col("prediction").cast("double")
        if recipe.light:
            pred = F.when(F.element_at("light", recipe.reach + h) <= 0, 0.0).otherwise(pred)
        used = F.concat("used", F.array(F.array(*recipe.names))) if trace else F.col("used")
        d = step(_features(d, recipe, seconds, h)).select(
            *keys, "issued_at", "light", "ahead", "status", F.concat("cells", F.array(pred)).alias("cells"), used.alias("used"))
        if h % checkpoint_every == 0 and h < horizon:
            d = cut_lineage(d)
    blank = F.array_repeat(F.lit(None).cast("double"), recipe.reach + horizon)
    rest = start.filter("status <> 'ok'").select(*keys, "issued_at", "light", "ahead", "status", blank.alias("cells"), "used")
    d = cut_lineage(d).unionByName(rest).withColumn("lead", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(horizon).cast("long"))))
    at = F.col("lead").cast("int")
    return d.select(*keys, "issued_at", from_epoch(epoch("issued_at") + F.col("lead") * seconds).alias("target_dt"), "lead",
                    F.element_at("cells", at + recipe.reach).alias("pred"), "status", *([F.try_element_at("used", at).alias("features")] if trace else []))
