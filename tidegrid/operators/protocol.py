"""Forecasters as a pair of steps: fit to a stored table of numbers, forecast by joins with that table.

A fitted model is rows of (keys, model, issued_at, part, at, value), the same
for every forecaster, so one table holds the models of a whole fleet. Fitting
and forecasting may happen in different jobs: ``forecast`` reads nothing else.
Series that a model cannot be fitted for have no rows and no forecast.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.timecols import epoch, from_epoch, to_local
from tidegrid.operators import forecast as fc
from tidegrid.operators.analytics import seasonal_profile
from tidegrid.operators.features import inference_window, sliding_windows


class Forecaster(Protocol):
    name: str

    def fit(self, grid: DataFrame, keys, seconds: int) -> DataFrame: ...

    def forecast(self, table: DataFrame, keys, seconds: int, horizon: int) -> DataFrame: ...


def _rows(d: DataFrame, keys, name: str, part: str, at, value) -> DataFrame:
    return d.select(*keys, F.lit(name).alias("model"), "issued_at", F.lit(part).alias("part"), at.cast("long").alias("at"), value.cast("double").alias("value"))


def _leads(table: DataFrame, keys, seconds: int, horizon: int, *facts) -> DataFrame:
    """(keys, issued_at, lead, target_dt, facts) of every fitted series."""
    d = table.groupBy(*keys, "issued_at").agg(*facts) if facts else table.select(*keys, "issued_at").distinct()
    d = d.withColumn("lead", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(horizon).cast("long"))))
    return d.withColumn("target_dt", from_epoch(epoch("issued_at") + F.col("lead") * seconds))


def _own(table: DataFrame, name: str, part: str) -> DataFrame:
    return table.filter((F.col("model") == name) & (F.col("part") == part))


@dataclass(frozen=True)
class Repeating:
    """Any forecast that repeats itself: one period of it is the model.

    ``once`` maps (grid, keys, seconds, period) to that period's forecast; a series
    shorter than the period repeats what it has.
    """

    name: str
    period: int
    once: Callable[[DataFrame, list, int, int], DataFrame]

    def fit(self, grid: DataFrame, keys, seconds: int) -> DataFrame:
        n = grid.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
        d = self.once(grid, list(keys), seconds, self.period).join(n, list(keys))
        if self.period > 1:
            d = d.filter(F.col("lead") <= F.col("__n"))
        return _rows(d, keys, self.name, "cell", F.col("lead") - 1, F.col("pred"))

    def forecast(self, table: DataFrame, keys, seconds: int, horizon: int) -> DataFrame:
        cells = _own(table, self.name, "cell")
        d = _leads(cells, keys, seconds, horizon, F.count(F.lit(1)).alias("__n")).withColumn("at", F.pmod(F.col("lead") - 1, F.col("__n")))
        return d.join(cells.select(*keys, "at", F.col("value").alias("pred")), [*keys, "at"]).select(*keys, "issued_at", "target_dt", "lead", "pred")


@dataclass(frozen=True)
class Straight:
    """Any forecast that is linear in its lead: level and slope are the model."""

    name: str
    once: Callable[[DataFrame, list, int, int], DataFrame]

    def fit(self, grid: DataFrame, keys, seconds: int) -> DataFrame:
        two = self.once(grid, list(keys), seconds, 2)
        d = two.groupBy(*keys, "issued_at").agg(*[F.max(F.when(F.col("lead") == h, F.col("pred"))).alias(f"__{h}") for h in (1, 2)])
        return _rows(d, keys, self.name, "level", F.lit(0), F.col("__1")).unionByName(_rows(d, keys, self.name, "slope", F.lit(0), F.col("__2") - F.col("__1")))

    def forecast(self, table: DataFrame, keys, seconds: int, horizon: int) -> DataFrame:
        own = table.filter(F.col("model") == self.name)
        facts = [F.max(F.when(F.col("part") == p, F.col("value"))).alias(f"__{p}") for p in ("level", "slope")]
        d = _leads(own, keys, seconds, horizon, *facts)
        return d.select(*keys, "issued_at", "target_dt", "lead", (F.col("__level") + F.col("__slope") * (F.col("lead") - 1)).alias("pred"))


@dataclass(frozen=True)
class Profile:
    """Means by slot of the day and weekend (``seasonal_profile``); a target without either has no prediction."""

    name: str = "profile"
    tz: str = "UTC"

    def fit(self, grid: DataFrame, keys, seconds: int) -> DataFrame:
        end = grid.groupBy(*keys).agg(F.max("grid_ts").alias("issued_at"))
        d = seasonal_profile(grid, keys, seconds, tz=self.tz).join(end, list(keys))
        return _rows(d, keys, self.name, "slot", F.col("slot") * 2 + F.col("weekend"), F.col("mean"))

    def forecast(self, table: DataFrame, keys, seconds: int, horizon: int) -> DataFrame:
        own, t = _own(table, self.name, "slot"), to_local("target_dt", self.tz)
        slot = F.floor((F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)) / seconds)
        d = _leads(own, keys, seconds, horizon).withColumn("at", slot * 2 + (F.weekday(t) >= 5).cast("long"))
        d = d.join(own.select(*keys, "at", F.col("value").alias("pred")), [*keys, "at"], "left")
        return d.select(*keys, "issued_at", "target_dt", "lead", "pred")


@dataclass(frozen=True)
class DirectLinear:
    """One linear model per lead, fitted on the windows of the whole fleet.

    Its rows are the weights (null keys, part ``weight <lead>``, the intercept at
    -1) and the last window of each series. Series shorter than the window have
    no rows.
    """

    name: str
    window: int
    horizon: int

    def fit(self, grid: DataFrame, keys, seconds: int) -> DataFrame:
        models = fc.direct_linear(sliding_windows(grid, keys, seconds, ["y"], self.window, self.horizon), self.horizon)
        weights = [(f"weight {h}", k, float(v)) for h, m in models.items() for k, v in enumerate([m.intercept, *m.coefficients], start=-1)]
        w = grid.sparkSession.createDataFrame(weights, "part string, at long, value double")  # horizon x window numbers
        types = {f.name: f.dataType for f in grid.schema}
        w = w.select(*[F.lit(None).cast(types[k]).alias(k) for k in keys], F.lit(self.name).alias("model"), F.lit(None).cast("timestamp_ntz").alias("issued_at"), "part", "at", "value")
        last = inference_window(grid, keys, seconds, ["y"], self.window).filter(F.size("past") == self.window)
        cells = last.select(*keys, F.col("anchor").alias("issued_at"), F.posexplode("past").alias("__i", "__x"))
        return w.unionByName(_rows(cells, keys, self.name, "window", F.col("__i"), F.col("__x")[0]))

    def forecast(self, table: DataFrame, keys, seconds: int, horizon: int) -> DataFrame:
        if horizon > self.horizon:
            raise ValueError(f"{self.name} was fitted for {self.horizon} leads")
        w = table.filter((F.col("model") == self.name) & F.col("part").startswith("weight ")).select(
            F.substring_index("part", " ", -1).cast("long").alias("lead"), "at", F.col("value").alias("__w"))
        cells = _own(table, self.name, "window")
        # The window as one array per series, the weights as one array per lead: both as long as the window.
        x = cells.groupBy(*keys, "issued_at").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("__x"))
        b = w.filter(F.col("lead") <= horizon).groupBy("lead").agg(F.sort_array(F.collect_list(F.struct("at", "__w"))).alias("__b"))
        d = x.withColumn("lead", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(horizon).cast("long")))).join(b, "lead")
        last, terms = F.element_at("__x", -1)["value"], F.zip_with("__x", F.slice("__b", 2, self.window), lambda a, c: (a["value"] - F.element_at("__x", -1)["value"]) * c["__w"])
        pred = F.aggregate(terms, last + F.element_at("__b", 1)["__w"], lambda s, v: s + v)
        return d.select(*keys, "issued_at", from_epoch(epoch("issued_at") + F.col("lead") * seconds).alias("target_dt"), "lead", pred.alias("pred"))


def standard(seconds: int) -> list[Forecaster]:
    """The closed-form forecasters of a grid, by the names the forecast log uses."""
    day = max(1, 86400 // seconds)
    return [
        Repeating("baseline_zero", 1, lambda g, k, s, n: fc.baseline_forecast(g, k, s, n, "zero")),
        Repeating("baseline_mean", 1, fc.baseline_forecast),
        Profile(),
        Repeating("previous_day", day, fc.previous_day),
        Repeating("seasonal_naive", 7 * day, lambda g, k, s, n: fc.seasonal_naive(g, k, s, n, 7 * day)),
        Repeating("daily_profile", day, fc.daily_profile),
        Straight("smoothing", lambda g, k, s, n: fc.exponential_smoothing(g, k, s, n, [0.3])),
        Straight("theta", lambda g, k, s, n: fc.exponential_smoothing(g, k, s, n, [0.3], theta=True)),
    ]


def fit_all(forecasters: list[Forecaster], grid: DataFrame, keys, seconds: int) -> DataFrame:
    return reduce(DataFrame.unionByName, [f.fit(grid, keys, seconds) for f in forecasters])


def forecast_all(forecasters: list[Forecaster], table: DataFrame, keys, seconds: int, horizon: int) -> DataFrame:
    """(keys, model, issued_at, target_dt, lead, pred) of every fitted model."""
    out = [f.forecast(table, keys, seconds, horizon).withColumn("model", F.lit(f.name)) for f in forecasters]
    return reduce(DataFrame.unionByName, out).select(*keys, "model", "issued_at", "target_dt", "lead", "pred")


def save_models(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").partitionBy("model").parquet(path)
