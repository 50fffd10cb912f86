"""Forecasters that run over a fleet of series at once.

``grid`` frames are (keys, grid_ts, y) on a complete grid. Every forecaster
returns (keys, issued_at, target_dt, lead, pred), issued at a series' last cell.
"""

from __future__ import annotations

import hashlib
import math
import os
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pandas as pd
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, LinearRegression, LinearRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegrid.functions.metrics import QUANTILE_LEVELS
from tidegrid.functions.timecols import epoch, from_epoch, lead_bucket, local_day, to_local
from tidegrid.operators.analytics import seasonal_profile
from tidegrid.operators.features import target_features, tail_rows
from tidegrid.operators.grid import fill_hold
from tidegrid.operators.horizon import level_offsets
from tidegrid.operators.quantiles import exact_quantiles
from tidegrid.operators.transform import level_scale
from tidegrid.session import cut_lineage, shared_dir

# Fixed values of the daily profile.
LEVEL_DAYS, LEVEL_HALF_LIFE, SCALE_CLIP = 7, 3.0, 4.0
# Cells of a series that one task folds.
STRETCH_CELLS = 1024
# Fixed values of the ablation rules (percent).
WORSE_WITHOUT_ALL, BETTER_WITHOUT_ALL, MATTERS, KEEP_AVERAGE, REMOVE_AVERAGE = 5.0, -3.0, 2.0, 3.0, -2.0


def future_cells(grid: DataFrame, keys, seconds: int, horizon: int) -> DataFrame:
    """(keys, issued_at, lead, target_dt) for the cells after the last one."""
    end = grid.groupBy(*keys).agg(F.max("grid_ts").alias("issued_at"))
    d = end.withColumn("lead", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(horizon).cast("long"))))
    return d.withColumn("target_dt", from_epoch(epoch("issued_at") + F.col("lead") * seconds))


def tail_array(grid: DataFrame, keys, seconds: int, n: int, held: bool = True) -> DataFrame:
    """The last ``n`` cells in order as ``tail``; gaps hold the value before them."""
    d = tail_rows(grid.select(*keys, "grid_ts", "y"), keys, seconds, n)
    if held:
        d = fill_hold(d, keys)
    cell = F.struct("grid_ts", "y")
    return d.groupBy(*keys).agg(F.max("grid_ts").alias("issued_at"), F.transform(F.sort_array(F.collect_list(cell)), lambda e: e["y"]).alias("tail"))


def baseline_forecast(grid: DataFrame, keys, seconds: int, horizon: int, kind: str = "mean") -> DataFrame:
    """Zero or mean with the quantiles of the whole history."""
    names = {f"q{round(q * 100)}": q for q in QUANTILE_LEVELS}
    q = exact_quantiles(grid, keys, "y", names)
    m = grid.groupBy(*keys).agg(F.avg("y").alias("__m"))
    pred = F.lit(0.0) if kind == "zero" else F.col("__m")
    d = future_cells(grid, keys, seconds, horizon).join(m, list(keys)).join(q, list(keys))
    return d.withColumn("pred", pred).drop("__m")


def profile_forecast(grid: DataFrame, keys, seconds: int, horizon: int, tz: str = "UTC") -> DataFrame:
    """Mean of the slot and weekend, else of the slot, else of everything."""
    p = seasonal_profile(grid, keys, seconds, tz=tz)
    t = to_local("target_dt", tz)
    d = future_cells(grid, keys, seconds, horizon).withColumns(
        {
            "slot": F.floor((F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)) / seconds),
            "weekend": (F.weekday(t) >= 5).cast("long"),
        }
    )
    d = d.join(p.select(*keys, "slot", "weekend", F.col("mean").alias("pred")), [*keys, "slot", "weekend"], "left")
    return d.drop("slot", "weekend")


def _repeat(tail: DataFrame, keys, seconds: int, horizon: int, period: int) -> DataFrame:
    d = tail.withColumn("lead", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(horizon).cast("long"))))
    n = F.size("tail")
    at = (n - F.least(n, F.lit(period)) + F.pmod(F.col("lead") - 1, F.least(n, F.lit(period)).cast("long")) + 1).cast("int")
    return d.select(
        *keys, "issued_at", from_epoch(epoch("issued_at") + F.col("lead") * seconds).alias("target_dt"), "lead",
        F.element_at("tail", at).alias("pred"),
    )


def previous_day(grid: DataFrame, keys, seconds: int, horizon: int) -> DataFrame:
    """The last measured day, repeated."""
    day = max(1, 86400 // seconds)
    return _repeat(tail_array(grid, keys, seconds, day), keys, seconds, horizon, day)


def seasonal_naive(grid: DataFrame, keys, seconds: int, horizon: int, period: int, reference_offset: bool = False) -> DataFrame:
    """The value one period before the target, repeating beyond the first period.

    ``reference_offset`` looks back one step less than a period.
    """
    p = period - 1 if reference_offset and period > 1 else period
    return _repeat(tail_array(grid, keys, seconds, p), keys, seconds, horizon, p)


def daily_profile(grid: DataFrame, keys, seconds: int, horizon: int, reference_offset: bool = False) -> DataFrame:
    """Shape of the last day, scaled to the recent level of daily totals.

    The level weighs up to 7 day totals with a half life of 3 days; the scale
    stays within a quarter and four, non-negative series below their maximum.
    """
    p = max(1, 86400 // seconds)
    t = tail_array(grid, keys, seconds, p * LEVEL_DAYS)
    days = F.greatest(F.lit(1), F.floor(F.size("tail") / p)).cast("int")
    totals = F.transform(
        F.sequence(F.lit(0), days - 1),
        lambda k: F.struct(
            F.pow(F.lit(0.5), k / LEVEL_HALF_LIFE).alias("w"),
            F.aggregate(F.slice("tail", F.greatest(F.lit(1), F.size("tail") - (k + 1) * p + 1), F.lit(p)), F.lit(0.0), lambda a, x: a + x).alias("s"),
        ),
    )
    t = t.withColumn("__t", totals)
    num = F.aggregate("__t", F.lit(0.0), lambda a, x: a + x["w"] * x["s"])
    den = F.aggregate("__t", F.lit(0.0), lambda a, x: a + x["w"])
    ref = F.col("__t")[0]["s"]
    ratio = F.when(ref > 1e-9, num / den / ref).otherwise(F.lit(1.0))
    t = t.withColumn("__scale", F.greatest(F.least(ratio, F.lit(SCALE_CLIP)), F.lit(1.0 / SCALE_CLIP)))
    step = p - 1 if reference_offset and p > 1 else p
    base = _repeat(t.select(*keys, "issued_at", "tail"), keys, seconds, horizon, step)
    span = grid.groupBy(*keys).agg(F.min("y").alias("__lo"), F.max("y").alias("__hi"))
    d = base.join(t.select(*keys, "__scale"), list(keys)).join(span, list(keys))
    v = F.col("pred") * F.col("__scale")
    cap = (F.col("__lo") >= 0) & (F.col("__hi") > 0)
    return d.withColumn("pred", F.when(cap, F.least(v, F.col("__hi"))).otherwise(v)).drop("__scale", "__lo", "__hi")


# ---- models ------------------------------------------------------------------------------------
def regressor(kind: str = "gbt", loss: str = "mse", nonneg: bool = True, seed: int = 7, **params):
    """An MLlib estimator for a model role and a loss.

    Tweedie needs non-negative targets and falls back to Huber otherwise.
    """
    cols = {"featuresCol": "features", "labelCol": "label"}
    if loss == "tweedie" and not nonneg:
        kind, loss = "linear", "huber"
    if loss == "tweedie":
        return GeneralizedLinearRegression(family="tweedie", variancePower=1.5, linkPower=0.0, regParam=0.1, **cols)
    if kind == "linear" or loss == "huber":
        return LinearRegression(loss="huber" if loss == "huber" else "squaredError", **cols, **params)
    if kind == "forest":
        return RandomForestRegressor(seed=seed, **{"numTrees": 20, "maxDepth": 6, **cols, **params})
    return GBTRegressor(seed=seed, lossType={"mse": "squared", "mae": "absolute"}[loss], validationIndicatorCol="is_valid",
                        **{"maxIter": 20, "maxDepth": 4, **cols, **params})


def with_shares(d: DataFrame, keys, valid_share: float, test_share: float) -> DataFrame:
    """Adds ``is_test`` for the newest share of each series' time and ``is_valid`` for the share before it."""
    span = d.groupBy(*keys).agg(F.min(epoch("grid_ts")).alias("__a"), F.max(epoch("grid_ts")).alias("__z"))
    age = (F.col("__z") - epoch("grid_ts")) / F.greatest(F.col("__z") - F.col("__a"), F.lit(1))
    d = d.join(span, list(keys)).withColumns({"is_test": age < test_share, "is_valid": (age >= test_share) & (age < test_share + valid_share)})
    return d.drop("__a", "__z")


def training_frame(grid: DataFrame, keys, interval_minutes: int, lags: list[int], valid_share: float = 0.2, test_share: float = 0.0) -> DataFrame:
    """Lag and slot features pooled over all series. The newest ``test_share`` of each series is for scoring only, the
    ``valid_share`` before it is the validation part."""
    d = target_features(grid, keys, interval_minutes, max(lags), [max(2, min(lags[-1], 4))])
    feats = [f"y_lag_{k}" for k in lags]
    d = d.withColumn("hour", F.hour("grid_ts").cast("double")).filter(F.col("y").isNotNull())
    d = d.filter(F.col(f"y_lag_{max(lags)}").isNotNull())
    d = with_shares(d, keys, valid_share, test_share)
    d = d.withColumn("label", F.col("y").cast("double"))
    return VectorAssembler(inputCols=[*feats, "hour"], outputCol="features").transform(d.select(*keys, "grid_ts", "label", "is_valid", "is_test", *feats, "hour"))


def fit_pooled(train: DataFrame, kind: str = "gbt", loss: str = "mse", **params):
    """One model for the fleet; tree growing and gradients run on all executors.

    Test rows are never seen. A Tweedie loss gives way to Huber if the training
    labels hold a negative value.
    """
    rows = train.filter("not is_test")
    if not (kind == "gbt" and loss in ("mse", "mae")):
        rows = rows.filter("not is_valid")
    signed = loss == "tweedie" and (rows.agg(F.min("label")).first()[0] or 0.0) < 0
    return regressor(kind, loss, not signed, **params).fit(rows)


def bias_corrected(model, train: DataFrame) -> DataFrame:
    """Level factor of a log-link fit over the training rows."""
    d = model.transform(train.filter("not is_valid and not is_test")).withColumn("__all", F.lit(0))
    return level_scale(d, ["__all"], "label", "prediction").drop("__all")


def feature_importance(model, names: list[str], spark) -> DataFrame:
    """Importances that add up to one."""
    raw = model.featureImportances.toArray() if hasattr(model, "featureImportances") else abs(model.coefficients.toArray())
    total = float(raw.sum()) or 1.0
    return spark.createDataFrame([(n, float(v) / total) for n, v in zip(names, raw)], "feature STRING, importance DOUBLE")


def direct_linear(windows: DataFrame, horizon: int) -> dict[int, LinearRegressionModel]:
    """One linear model per lead on windows whose last value is taken off (and added back when forecasting)."""
    base = windows.withColumn("__x", F.transform("past", lambda c: c[0])).withColumn("__last", F.element_at("__x", -1))
    base = base.withColumn("features", array_to_vector(F.transform("__x", lambda v: v - F.col("__last"))))
    return {
        h: LinearRegression(regParam=1.0, featuresCol="features", labelCol="label").fit(
            base.withColumn("label", F.element_at("labels", h) - F.col("__last")))
        for h in range(1, horizon + 1)
    }


def direct_forecast(models: dict[int, LinearRegressionModel], window: DataFrame, keys, seconds: int) -> DataFrame:
    """One row per lead. Windows shorter than the models ask for come back with null predictions and status ``short``."""
    need = next(iter(models.values())).numFeatures
    whole = F.size("past") == need
    leads = window.filter(~F.coalesce(whole, F.lit(False))).withColumn("lead", F.explode(F.array(*[F.lit(h).cast("long") for h in models])))
    short = leads.select(*keys, F.col("anchor").alias("issued_at"), from_epoch(epoch("anchor") + F.col("lead") * seconds).alias("target_dt"), "lead",
                         F.lit(None).cast("double").alias("pred"), F.lit("short").alias("status"))
    d = window.filter(whole)
    d = d.withColumn("__x", F.transform("past", lambda c: c[0])).withColumn("__last", F.element_at("__x", -1))
    d = d.withColumn("features", array_to_vector(F.transform("__x", lambda v: v - F.col("__last"))))
    out = None
    for h, m in models.items():
        one = m.transform(d).select(
            *keys, F.col("anchor").alias("issued_at"), from_epoch(epoch("anchor") + h * seconds).alias("target_dt"),
            F.lit(h).cast("long").alias("lead"), (F.col("prediction") + F.col("__last")).alias("pred"), F.lit("ok").alias("status"))
        out = one if out is None else out.unionByName(one)
    return out.unionByName(short)


def _stretch_fold(cells: Column, alpha: float) -> Column:
    """What one stretch does to the level L it starts from: the level becomes a L + b, and the squared one-step errors add up to
    uu - 2 L ua + L L aa."""
    def step(s, y):
        u = y - s["b"]
        return F.struct(
            (s["a"] * (1 - alpha)).alias("a"), (s["b"] + alpha * u).alias("b"), (s["uu"] + u * u).alias("uu"),
            (s["ua"] + u * s["a"]).alias("ua"), (s["aa"] + s["a"] * s["a"]).alias("aa"))

    start = F.struct(*[F.lit(v).alias(n) for n, v in (("a", 1.0), ("b", 0.0), ("uu", 0.0), ("ua", 0.0), ("aa", 0.0))])
    return F.aggregate(cells, start, step)


def exponential_smoothing(grid: DataFrame, keys, seconds: int, horizon: int, alphas: list[float], theta: bool = False, stretch: int = STRETCH_CELLS) -> DataFrame:
    """Simple smoothing over the whole history with the best of some fixed factors; ``theta`` adds half the linear drift.

    Smoothing is a linear recurrence, so each stretch of cells folds by itself
    and a series is a short list of stretches. Gaps hold the value before them.
    """
    keys = list(keys)
    span = grid.groupBy(*keys).agg(F.min(epoch("grid_ts")).alias("__a"), F.max("grid_ts").alias("issued_at"))
    d = fill_hold(grid.select(*keys, "grid_ts", "y"), keys).filter(F.col("y").isNotNull()).join(span, keys)
    d = d.withColumn("__i", (epoch("grid_ts") - F.col("__a")) / seconds).withColumn("__y", F.col("y").cast("double"))
    parts = d.groupBy(*keys, F.floor(F.col("__i") / stretch).alias("__c")).agg(F.sort_array(F.collect_list(F.struct("__i", "__y"))).alias("__s"))
    cells = F.transform("__s", lambda e: e["__y"])
    parts = parts.select(*keys, "__c", cells[0].alias("__first"), F.array(*[_stretch_fold(cells, a) for a in alphas]).alias("__f"))
    series = parts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__c", "__first", "__f"))).alias("__p"))

    def whole(n: int, alpha: float) -> Column:
        start = F.struct(F.element_at("__p", 1)["__first"].alias("l"), F.lit(0.0).alias("e"))

        def step(s, p):
            f, level = p["__f"][n], s["l"]
            return F.struct((f["a"] * level + f["b"]).alias("l"), (s["e"] + f["uu"] - 2 * level * f["ua"] + level * level * f["aa"]).alias("e"))

        end = F.aggregate("__p", start, step)
        return F.struct(end["e"].alias("sse"), F.lit(alpha).alias("alpha"), end["l"].alias("level"))

    t = series.withColumn("__best", F.array_min(F.array(*[whole(n, a) for n, a in enumerate(alphas)]))).join(span, keys)
    drift = d.groupBy(*keys).agg(F.coalesce(F.regr_slope("__y", "__i"), F.lit(0.0)).alias("__slope")) if theta else span.select(*keys, F.lit(0.0).alias("__slope"))
    d = t.join(drift, keys).withColumn("lead", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(horizon).cast("long"))))
    return d.select(
        *keys, "issued_at", from_epoch(epoch("issued_at") + F.col("lead") * seconds).alias("target_dt"), "lead",
        (F.col("__best.level") + 0.5 * F.col("__slope") * F.col("lead")).alias("pred"), F.col("__best.alpha").alias("alpha"))


def draw_params(space: dict[str, Sequence], draws: int, seed: int = 0) -> list[dict]:
    """Distinct candidates; a draw's value of a parameter follows from a hash, so a repeated search draws the same.

    ``space`` gives each parameter its choices, a list or a ``range``.
    """
    out: list[dict] = []
    for n in range(draws):
        pick = {k: v[int(hashlib.sha256(f"{seed}/{n}/{k}".encode()).hexdigest(), 16) % len(v)] for k, v in space.items()}
        if pick not in out:
            out.append(pick)
    return out


def halving(n: int, folds: list, score: Callable[[int, object], float], keep: float = 0.5, threads: int = 4) -> list[tuple[int, float, int, int]]:
    """(candidate, mean score, folds seen, round left) by successive halving, best first.

    Every round scores those still in on one more fold; then the better ``keep``
    share by mean score goes on (at least one, ties to the earlier candidate).
    All fits of a round run side by side.
    """
    seen: dict[int, list[float]] = {k: [] for k in range(n)}
    left, alive = {}, list(range(n))
    for r, fold in enumerate(folds):
        with ThreadPoolExecutor(threads) as pool:
            for k, v in zip(alive, pool.map(lambda c: score(c, fold), alive)):
                seen[k].append(v)
        order = sorted(alive, key=lambda k: (sum(seen[k]) / len(seen[k]), k))
        stay = len(order) if r == len(folds) - 1 else max(1, math.ceil(len(order) * keep))
        left.update({k: r for k in alive})
        alive = order[:stay]
    rows = [(k, sum(v) / len(v), len(v), left[k]) for k, v in seen.items() if v]
    return sorted(rows, key=lambda x: (-x[2], x[1], x[0]))


def parameter_search(folded: DataFrame, candidates: list[dict], kind: str = "forest", keep: float = 0.5) -> DataFrame:
    """(candidate, params, mae, n_folds, position) of (fold, role, features, label): candidates meet the folds in turn and the
    worse ones leave early. Those that saw more folds come first, then the smaller mean error."""
    path = os.path.join(shared_dir(folded.sparkSession), f"folds-{uuid.uuid4().hex}")
    folded.write.partitionBy("fold", "role").parquet(path)
    stored = folded.sparkSession.read.parquet(path)  # a fit reads its own fold and role only
    folds = sorted(r[0] for r in stored.select("fold").distinct().collect())  # one small number per fold
    ev = RegressionEvaluator(labelCol="label", predictionCol="prediction", metricName="mae")

    def score(n: int, fold) -> float:
        own = stored.filter(F.col("fold") == fold)
        model = regressor(kind, **candidates[n]).fit(own.filter("role = 'train'"))
        return float(ev.evaluate(model.transform(own.filter("role = 'test'"))))

    rows = [(n, str(sorted(candidates[n].items())), mae, seen, p) for p, (n, mae, seen, _) in enumerate(halving(len(candidates), folds, score, keep), start=1)]
    return folded.sparkSession.createDataFrame(rows, "candidate LONG, params STRING, mae DOUBLE, n_folds LONG, position LONG")


def _fold_files(folded: DataFrame) -> tuple[list, DataFrame]:
    """The folds, and their rows stored by fold and role, so that a fit reads its own rows only, in about as many tasks as there are cores."""
    path = os.path.join(shared_dir(folded.sparkSession), f"folds-{uuid.uuid4().hex}")
    rows = folded.drop("features")
    rows.write.partitionBy("fold", "role").parquet(path)
    rows = folded.sparkSession.read.schema(rows.schema).parquet(path)
    return sorted(r[0] for r in rows.select("fold").distinct().collect()), rows  # one small number per fold


def _errors(rows: DataFrame, folds: list, keys, arms: dict[str, list[str]], models: dict[str, Callable], threads: int) -> DataFrame:
    """(keys, fold, model, label, pred, arm) of all test rows; the fits of arms, folds and models run side by side."""
    def fitted(job):
        arm, fold, name = job
        part = VectorAssembler(inputCols=arms[arm], outputCol="features").transform(rows.filter(F.col("fold") == fold))
        model = models[name]().fit(part.filter("role = 'train'").select("features", "label"))
        scored = model.transform(part.filter("role = 'test'"))
        return scored.select(*keys, "fold", F.lit(name).alias("model"), "label", F.col("prediction").alias("pred"), F.lit(arm).alias("arm"))

    with ThreadPoolExecutor(threads) as pool:
        return reduce(DataFrame.unionByName, pool.map(fitted, [(arm, fold, name) for arm in arms for fold in folds for name in models]))


def fold_errors(folded: DataFrame, keys, columns: list[str], models: dict[str, Callable], threads: int = 4) -> DataFrame:
    """(keys, fold, model, label, pred) of all test rows of (keys, fold, role, label, columns): every model is fitted anew on each
    fold's training rows, pooled over the fleet. ``models`` gives a fresh estimator over ``features`` and ``label`` for each name."""
    folds, rows = _fold_files(folded)
    return _errors(rows, folds, keys, {"": columns}, models, threads).drop("arm")


def benchmark(folded: DataFrame, keys, columns: list[str], models: dict[str, Callable]) -> DataFrame:
    """(keys, model, mae, rmse, n_folds, position): errors averaged over the folds a series is tested in, best model first."""
    keys = list(keys)
    e = F.col("pred") - F.col("label")
    by_fold = fold_errors(folded, keys, columns, models).groupBy(*keys, "fold", "model").agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))
    mean = by_fold.groupBy(*keys, "model").agg(F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"), F.count("*").alias("n_folds"))
    return mean.withColumn("position", F.row_number().over(W.partitionBy(*keys).orderBy(F.round("mae", 6), "model")).cast("long"))


def ablation_errors(folded: DataFrame, keys, base: list[str], covariates: list[str], models: dict[str, Callable], crosses: dict[str, tuple[str, str]] | None = None,
                    threads: int = 4) -> DataFrame:
    """Error of every (keys, model, arm), each arm fitted anew on every fold with its own columns only.

    Arms are ``all``, ``none`` and ``without_<covariate>``. A cross (name to the
    two covariates it multiplies) is there only while both of them are.
    """
    keys, crosses = list(keys), crosses or {}
    folds, rows = _fold_files(folded.withColumns({name: F.col(a) * F.col(b) for name, (a, b) in crosses.items()}) if crosses else folded)
    arms = {"all": covariates, "none": [], **{f"without_{c}": [x for x in covariates if x != c] for c in covariates}}
    columns = {arm: [*base, *own, *[name for name, pair in crosses.items() if set(pair) <= set(own)]] for arm, own in arms.items()}
    out = _errors(rows, folds, keys, columns, models, threads)
    return out.groupBy(*keys, "model", "arm").agg(F.avg(F.abs(F.col("pred") - F.col("label"))).alias("mae"), F.count("*").alias("n"))


def ablation_report(arms: DataFrame, keys) -> DataFrame:
    """Percent change of each arm (keys, model, arm, mae) against the arm ``all``."""
    base = arms.filter(F.col("arm") == "all").select(*keys, "model", F.col("mae").alias("__base"))
    d = arms.join(base, [*keys, "model"])
    return d.withColumn("change_pct", F.when(F.col("__base") > 0, (F.col("mae") - F.col("__base")) / F.col("__base") * 100.0)).drop("__base")


def ablation_advice(report: DataFrame, keys) -> DataFrame:
    """(keys, arm, model, n_models, n_helps, n_hurts, avg_change, advice).

    Arm ``none`` is judged model by model. Each covariate is judged by the
    models that do not do better without any; fewer than two of them decide
    nothing (``undecided``), a majority gives ``likely`` advice, all give it
    plainly.
    """
    keys = list(keys)
    change = F.col("change_pct")
    none = report.filter("arm = 'none'")
    verdict = F.when(change > WORSE_WITHOUT_ALL, "keep").when(change < BETTER_WITHOUT_ALL, "remove").otherwise("neutral")
    alone = none.select(*keys, "arm", "model", F.lit(1).cast("long").alias("n_models"), (change > MATTERS).cast("long").alias("n_helps"), (change < -MATTERS).cast("long").alias("n_hurts"),
                        change.alias("avg_change"), verdict.alias("advice"))
    averse = none.filter(change < BETTER_WITHOUT_ALL).select(*keys, "model")
    d = report.filter("arm not in ('all', 'none')")
    judges = d.join(averse, [*keys, "model"], "left_anti").filter(change.isNotNull())
    votes = judges.groupBy(*keys, "arm").agg(
        F.count("*").alias("n_models"), F.count_if(change > MATTERS).alias("n_helps"), F.count_if(change < -MATTERS).alias("n_hurts"), F.avg("change_pct").alias("avg_change"))
    votes = d.select(*keys, "arm").distinct().join(votes, [*keys, "arm"], "left").fillna(0, ["n_models", "n_helps", "n_hurts"])
    n, up, down = F.col("n_models"), (F.col("n_helps"), F.col("avg_change") > KEEP_AVERAGE), (F.col("n_hurts"), F.col("avg_change") < REMOVE_AVERAGE)
    advice = F.when(n < 2, "undecided")
    for prefix, enough in (("", lambda k: k == n), ("likely ", lambda k: k > n / 2)):
        for word, (k, far) in (("keep", up), ("remove", down)):
            advice = advice.when(enough(k) & far, prefix + word)
    together = votes.select(*keys, "arm", F.lit(None).cast("string").alias("model"), "n_models", "n_helps", "n_hurts", "avg_change", advice.otherwise("neutral").alias("advice"))
    return alone.unionByName(together)


# ---- publishing --------------------------------------------------------------------------------
def conformal_band(forecast: DataFrame, quantiles: DataFrame, width: int, nonneg: bool = True, keys=("experiment",)) -> DataFrame:
    """Symmetric band from the bucket's half-width, else the pooled one; floored at 0."""
    d = forecast.withColumn("lead_bucket", lead_bucket("lead_minutes", width))
    pooled = quantiles.groupBy(*keys).agg(F.max("fallback").alias("__f"))
    d = d.join(quantiles.select(*keys, "lead_bucket", "q"), [*keys, "lead_bucket"], "left").join(pooled, list(keys), "left")
    half = F.coalesce("q", "__f")
    low = F.col("predicted") - half
    return d.withColumns({"upper": F.col("predicted") + half, "lower": F.greatest(low, F.lit(0.0)) if nonneg else low}).drop("q", "__f", "lead_bucket")


def asymmetric_band(forecast: DataFrame, pairs: DataFrame, level: float = 0.8, nonneg: bool = True, keys=("experiment",)) -> DataFrame:
    """Band from signed errors of forecasts of like size; it always contains the point."""
    tail = (1 - level) / 2
    d = level_offsets(pairs, forecast, keys, {"__lo": tail, "__hi": 1 - tail})
    low, high = F.col("predicted") + F.least("__lo", F.lit(0.0)), F.col("predicted") + F.greatest("__hi", F.lit(0.0))
    ok = F.col("__lo").isNotNull()
    return d.withColumns(
        {"upper": F.when(ok, high), "lower": F.when(ok, F.greatest(low, F.lit(0.0)) if nonneg else low)}
    ).drop("__lo", "__hi")


def cumulative_forecast(forecast: DataFrame, measured_today: DataFrame, tz: str = "UTC", reset_daily: bool = True, keys=("experiment",), by=("model_name",)) -> DataFrame:
    """Running sum per local day, today starting from the measured total; a negative prediction makes it unknown.

    ``measured_today`` holds (keys, day, total); ``by`` tells the forecasts of one key and issue apart.
    """
    keys = list(keys)
    d = forecast.withColumn("day", local_day("target_dt", tz))
    part = [*keys, *by, "issued_at", *(["day"] if reset_daily else [])]
    w = W.partitionBy(*part).orderBy("target_dt").rowsBetween(W.unboundedPreceding, 0)
    d = d.join(measured_today.select(*keys, "day", "total"), [*keys, "day"], "left") if reset_daily else d.withColumn("total", F.lit(0.0))
    same = F.col("day") == local_day("issued_at", tz)
    seed = F.when(same, F.coalesce("total", F.lit(0.0))).otherwise(F.lit(0.0)) if reset_daily else F.lit(0.0)
    neg = F.max((F.col("predicted") < 0).cast("int")).over(w)
    return d.withColumn("cumulative", F.when(neg == 0, seed + F.sum("predicted").over(w))).drop("total")


def champion_history(choices: DataFrame, keys=("experiment",)) -> DataFrame:
    """(keys, decided_at, model, version) to validity ranges; repeats of the same champion are merged."""
    keys = list(keys)
    w = W.partitionBy(*keys).orderBy("decided_at")
    same = F.col("model").eqNullSafe(F.lag("model").over(w)) & F.col("version").eqNullSafe(F.lag("version").over(w))
    d = choices.withColumn("__new", ~F.coalesce(same, F.lit(False)) | (F.row_number().over(w) == 1)).filter("__new")
    return d.select(*keys, "model", "version", F.col("decided_at").alias("valid_from"), F.lead("decided_at").over(w).alias("valid_to"))


def rollback(history: DataFrame, at: str, keys=("experiment",)) -> DataFrame:
    """The champion before the current one becomes current again from ``at``."""
    keys = list(keys)
    w = W.partitionBy(*keys).orderBy(F.col("valid_from").desc())
    d = history.withColumn("__r", F.row_number().over(w))
    back = d.filter("__r = 2").select(*keys, "model", "version", F.lit(at).cast("timestamp_ntz").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    closed = d.join(back.select(*keys, F.lit(True).alias("__b")), keys, "left").withColumn(
        "valid_to", F.when(F.col("__b") & (F.col("__r") == 1), F.lit(at).cast("timestamp_ntz")).otherwise(F.col("valid_to")))
    return closed.select(*keys, "model", "version", "valid_from", "valid_to").unionByName(back)


def prune_to_champion(log: DataFrame, champions: DataFrame, keys=("experiment",)) -> DataFrame:
    """Log rows of current champions; experiments without one keep everything."""
    cur = champions.filter(F.col("valid_to").isNull()).select(*keys, F.col("model").alias("__m"))
    d = log.join(cur, list(keys), "left")
    return d.filter(F.col("__m").isNull() | (F.col("model_name") == F.col("__m"))).drop("__m")


def holdout_display(windows: DataFrame, holdout: DataFrame, keys, seconds: int) -> DataFrame:
    """First step of every window at its own time; the rows no first step reaches take the last window's later steps.

    ``windows`` holds (keys, anchor, preds array).
    """
    keys = list(keys)
    first = windows.select(*keys, from_epoch(epoch("anchor") + seconds).alias("grid_ts"), F.element_at("preds", 1).alias("__a"))
    last = windows.groupBy(*keys).agg(F.max_by("preds", "anchor").alias("__p"), F.max("anchor").alias("__t"))
    tail = last.select(*keys, "__t", F.posexplode("__p").alias("__i", "__b")).filter("__i >= 1").select(
        *keys, from_epoch(epoch("__t") + (F.col("__i") + 1) * seconds).alias("grid_ts"), "__b")
    d = holdout.select(*keys, "grid_ts").join(first, [*keys, "grid_ts"], "left").join(tail, [*keys, "grid_ts"], "left")
    return d.select(*keys, "grid_ts", F.coalesce("__a", "__b").alias("pred"))


def future_covariates(cells: DataFrame, history: DataFrame, published: DataFrame, keys, role: str = "both", name: str = "cov") -> DataFrame:
    """Covariate for future cells: published values where its role allows, else the last historic value.

    A cell without a published value is flagged ``<name>_missing``.
    """
    keys = list(keys)
    last = history.filter(F.col(name).isNotNull()).groupBy(*keys).agg(F.max_by(name, "grid_ts").alias("__last"))
    d = cells.join(last, keys, "left")
    if role in ("future", "both"):
        d = d.join(published.select(*keys, F.col("grid_ts").alias("target_dt"), F.col(name).alias("__pub")), [*keys, "target_dt"], "left")
    else:
        d = d.withColumn("__pub", F.lit(None).cast("double"))
    return d.withColumns({name: F.coalesce("__pub", "__last"), f"{name}_missing": F.col("__pub").isNull().cast("long")}).drop("__pub", "__last")


def apply_forecaster(grid: DataFrame, keys, fn: Callable[[pd.DataFrame], pd.DataFrame], seconds: int, history: int, schema: str) -> DataFrame:
    """Own forecaster as a pandas function over the last ``history`` cells of each series."""
    return tail_rows(grid, keys, seconds, history).groupBy(*keys).applyInPandas(fn, schema)
