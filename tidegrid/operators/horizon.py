"""Scoring whole forecast horizons.

Points are (keys, model, origin, lead, target_dt, point, actual, usable); keys
name the series, ``lead`` counts cells from 1. Quantiles of all earlier errors
come from ``prefixes``, whose cost grows with the number of errors and origins;
only errors grouped by the size of the forecast still meet each origin one by one,
some origins at a time (``splits.thin_origins`` bounds those).

Nothing is stored: a task gets whole series and gives every row its quantiles.
Points that come dealt by series are not shuffled. Series of more than
``SERIES_ROWS`` points are spread over tasks instead and met by joins.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegrid.functions.metrics import QUANTILE_LEVELS, crps
from tidegrid.functions.timecols import epoch, to_local
from tidegrid.operators.align import meet
from tidegrid.operators.prefixes import at_moments, between, codes, lists, pair, prefix_quantiles, seen
from tidegrid.operators.quantiles import exact_quantiles
from tidegrid.operators.ranking import ratio_intervals
from tidegrid.session import stored

# Fixed values.
LEVEL_BINS = 8
MIN_RESIDUALS = 30
MIN_EVALUATION_DAYS = 14
TOTAL_TOLERANCE = 1.25
GUARDRAIL = "baseline_mean"
SERIES_ROWS = 1 << 16


def attach_actuals(points: DataFrame, actuals: DataFrame, keys, y: str = "y", ts: str = "grid_ts") -> DataFrame:
    a = actuals.select(*keys, F.col(ts).alias("target_dt"), F.col(y).alias("actual"))
    d = meet(points, a, [*keys, "target_dt"], "left")
    return d.withColumn("usable", F.col("actual").isNotNull() & F.col("point").isNotNull())


def residual_quantiles(points: DataFrame, keys, horizon: int, seconds: int, condition: str = "lead", lead_bucket: int = 1,
                       nonnegative: bool = False, tz: str = "UTC", series_rows: int = SERIES_ROWS, sized: DataFrame | None = None) -> DataFrame:
    """Adds the 19 quantiles ``q`` of every cell from the model's own earlier errors, and ``complete``: whether every model of the series
    has a measured cell with quantiles there.

    Only origins whose whole horizon was measured before count. Errors are
    grouped by lead bucket, by 3-hour block and weekend (``slot``), or by the
    size of the forecast (``level``); fewer than 30 borrow the pooled ones, and
    with fewer than 30 in all there are none. ``sized`` may have the same series in rows that cost less to count, such as
    the points before they met their actuals.
    """
    keys = list(keys)
    reach = horizon * seconds
    bucket = max(1, lead_bucket)
    if condition == "level":
        key = F.lit(0)
    elif condition == "lead":
        key = F.expr(f"(lead - 1) div {bucket}")
    elif condition == "slot":
        t = to_local("target_dt", tz)
        key = F.floor(F.hour(t) / 3) + 100 * (F.weekday(t) >= 5).cast("long")
    else:
        raise ValueError(f"unknown condition {condition!r}")
    sizes = (points if sized is None else sized).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).withColumn("large", F.col("rows") > series_rows)
    large = sizes.agg(F.max("large")).first()[0]
    # each column costs a task time for every row that is handed over
    small = points.withColumn("__key", key.cast("long")) if condition == "slot" else points
    small = small if not large else small.join(sizes.filter("large").select(*keys), keys, "left_anti")
    schema = points.withColumns({"complete": F.lit(None).cast("boolean"), "q": F.lit(None).cast("array<double>")}).schema
    out = small.groupBy(*keys).applyInArrow(lambda t: _evaluate(t, keys, reach, condition, bucket, nonnegative), schema)
    if large:
        hot = points.withColumn("__key", key.cast("long")).withColumn("__t", epoch("origin")).withColumn("__e", F.when(F.col("usable"), F.col("actual") - F.col("point")))
        hot = stored(hot.join(sizes.filter("large").select(*keys), keys, "left_semi"))
        out = out.unionByName(_finish(_evaluate_large(hot, keys, reach, condition), nonnegative).select(*out.columns))
    return out


def _evaluate(rows: pa.Table, keys: list[str], reach: int, condition: str, bucket: int, nonnegative: bool) -> pa.Table:
    """A whole series: adds ``q``, the forecast with the quantiles of the earlier errors, and ``complete``, whether every model of the series
    has a measured cell with quantiles there."""
    def numbers(name):
        return rows.column(name).cast(pa.float64()).to_numpy()

    named = np.logical_and.reduce([rows.column(name).is_valid().to_numpy() for name in [*keys, "model", "origin"]])
    t = rows.column("origin").cast(pa.int64()).fill_null(0).to_numpy() // 1_000_000
    point = numbers("point")
    e = np.where(named & rows.column("usable").fill_null(False).to_numpy(), numbers("actual") - point, np.nan)
    levels = np.array(QUANTILE_LEVELS)
    group = codes(rows, ["model"])
    _, of, n, q = at_moments(group, t, e, reach, levels)
    n, q = n[of], q[of]
    if condition == "level":
        own, own_q = _by_size(group, t, point, e, n, reach, levels)
    else:
        lead = rows.column("lead" if condition == "lead" else "__key")
        key = lead.cast(pa.int64()).fill_null(0).to_numpy()
        if condition == "lead":
            key = np.abs(key - 1) // bucket * np.sign(key - 1)
        _, of, own, own_q = at_moments(pair(group, np.unique(np.where(lead.is_valid().to_numpy(), key, key.min(initial=0) - 1), return_inverse=True)[1]), t, e, reach, levels)
        own, own_q = np.where(lead.is_valid().to_numpy(), own[of], 0), own_q[of]
    some = named & (n >= MIN_RESIDUALS)
    q = point[:, None] + np.where((own >= MIN_RESIDUALS)[:, None], own_q, q)
    ready = some & ~np.isnan(e)
    cell = codes(rows, ["origin", "lead"])
    complete = ready & (_each(cell, group, ready)[cell] == group.max(initial=-1) + 1)
    known = np.repeat(rows.column("point").is_valid().to_numpy()[some], len(levels))
    if nonnegative:  # of a missing forecast the greater is 0
        q, known = np.where((q < 0) | rows.column("point").is_null().to_numpy()[:, None], 0.0, q), None
    return rows.drop_columns(["__key"] if condition == "slot" else []).append_column("complete", pa.array(complete)).append_column("q", lists(q, some, known))


def _each(place: np.ndarray, model: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """How many different models each place has among the rows taken."""
    _, first = np.unique(pair(place[taken], model[taken]), return_index=True)
    return np.bincount(place[taken][first], minlength=int(place.max(initial=-1)) + 1)


def _by_size(group: np.ndarray, t: np.ndarray, point: np.ndarray, e: np.ndarray, n: np.ndarray, reach: int, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row: number and quantiles of the earlier errors of forecasts of its size; the bin edges move with every origin."""
    marks = np.array([k / LEVEL_BINS for k in range(1, LEVEL_BINS)])
    real = ~np.isnan(e)
    moment, of, _, edges = at_moments(group, t, np.where(real, point, np.nan), reach, marks)
    known, size = e[real], point[real]
    # a moment's rows that have enough errors ask for one bin each
    mine = (point[:, None] >= edges[of]).sum(axis=1)
    asks = np.flatnonzero(n >= MIN_RESIDUALS)
    place = of[asks] * LEVEL_BINS + mine[asks]
    own, own_q = np.zeros(len(t), np.int64), np.full((len(t), len(levels)), np.nan)
    for some, counts, taken in seen(group[real], t[real], known, group[moment], t[moment] - reach):
        here = asks[(place >= some.start * LEVEL_BINS) & (place < some.stop * LEVEL_BINS)]
        if not len(here):
            continue
        bins, sizes = np.zeros(len(taken), np.uint8), size[taken]
        for edge in edges[some].T:
            bins += sizes >= np.repeat(edge, counts)
        # short numbers are ordered by counting
        first = np.arange(0, (some.stop - some.start) * LEVEL_BINS, LEVEL_BINS)
        code = np.repeat(first.astype(np.uint16 if first[-1] < (1 << 16) - LEVEL_BINS else np.int64), counts) + bins
        many = np.bincount(code, minlength=len(first) * LEVEL_BINS)
        order = np.argsort(code, kind="stable")
        bin_of, back = np.unique((of[here] - some.start) * LEVEL_BINS + mine[here], return_inverse=True)
        begin = np.cumsum(many) - many
        own[here], own_q[here] = many[bin_of][back], between(known[taken[order]], begin[bin_of], many[bin_of], levels)[back]
    return own, own_q


def _evaluate_large(d: DataFrame, keys: list[str], reach: int, condition: str) -> DataFrame:
    """The same for series too long for a task, by joins."""
    g = [*keys, "model"]
    if condition == "level":
        d = _level_quantiles(d, g, reach)
    else:
        own = _past_quantiles(d, [*g, "__key"], reach, "__no", "__qo")
        pooled = _past_quantiles(d, g, reach, "__np", "__qp")
        d = d.join(own, [*g, "__key", "__t"], "left").join(pooled, [*g, "__t"], "left")
        q = F.when(F.col("__np") >= MIN_RESIDUALS, F.when(F.col("__no") >= MIN_RESIDUALS, F.col("__qo")).otherwise(F.col("__qp")))
        d = d.withColumn("__off", q)
    models = d.select(*keys, "model").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("__m"))
    ready = F.col("usable") & F.col("__off").isNotNull()
    there = F.size(F.collect_set(F.when(ready, F.col("model"))).over(W.partitionBy(*keys, "origin", "lead")))
    return d.withColumn("__there", there).join(models, keys, "left").withColumn("complete", F.coalesce(ready & (F.col("__there") == F.col("__m")), F.lit(False)))


def _past_quantiles(d: DataFrame, by, reach: int, n: str, q: str) -> DataFrame:
    """Per origin: number and quantiles of the errors made at least ``reach`` seconds earlier."""
    return prefix_quantiles(d, by, "__t", "__e", reach, QUANTILE_LEVELS, n, q)


def _finish(d: DataFrame, nonnegative: bool) -> DataFrame:
    floor = (lambda x: F.greatest(x, F.lit(0.0))) if nonnegative else (lambda x: x)
    q = F.transform("__off", lambda e: floor(F.col("point") + e))
    return d.withColumn("q", q).drop(*[c for c in d.columns if c.startswith("__")])


def _bin(edges: Column, v: Column) -> Column:
    return F.size(F.filter(edges, lambda e: e <= v))


def _level_quantiles(d: DataFrame, g, reach: int) -> DataFrame:
    """Past errors grouped by forecast size; the bin edges move with every origin."""
    levels = ", ".join(f"{q}D" for q in QUANTILE_LEVELS)
    known = F.when(F.col("__e").isNotNull(), F.col("point"))
    sizes = prefix_quantiles(d.withColumn("__k", known), g, "__t", "__k", reach, [k / LEVEL_BINS for k in range(1, LEVEL_BINS)], "__nk", "__edges")
    d = d.join(sizes.select(*g, "__t", F.array_distinct("__edges").alias("__edges")), [*g, "__t"], "left")
    d = d.join(_past_quantiles(d, g, reach, "__np", "__qp"), [*g, "__t"], "left")
    d = d.withColumn("__b", _bin(F.col("__edges"), F.col("point")))
    # One row per origin and occupied bin meets the earlier errors of its model; origins are thinned.
    want = d.filter(F.col("__np") >= MIN_RESIDUALS).select(*g, "__t", "__b", "__edges").distinct()
    past = d.filter(F.col("__e").isNotNull()).select(*g, F.col("__t").alias("__t0"), F.col("point").alias("__p0"), F.col("__e").alias("__e0"))
    hit = want.join(past, g).filter((F.col("__t0") <= F.col("__t") - reach) & (_bin(F.col("__edges"), F.col("__p0")) == F.col("__b")))
    own = hit.groupBy(*g, "__t", "__b").agg(F.expr(f"percentile(__e0, array({levels}))").alias("__qo"), F.count(F.lit(1)).alias("__no"))
    d = d.join(own, [*g, "__t", "__b"], "left")
    q = F.when(F.col("__np") >= MIN_RESIDUALS, F.when(F.col("__no") >= MIN_RESIDUALS, F.col("__qo")).otherwise(F.col("__qp")))
    return d.withColumn("__off", q)


def level_offsets(pairs: DataFrame, new: DataFrame, keys, probs: dict[str, float], bins: int = LEVEL_BINS,
                  min_samples: int = MIN_RESIDUALS) -> DataFrame:
    """Error quantiles for new forecasts (keys, predicted) from past pairs (keys, predicted, residual), by size.

    Linear in the number of pairs: edges, bins and quantiles are three grouped passes.
    """
    keys = list(keys)
    cuts = {f"__c{k}": k / bins for k in range(1, bins)}
    edges = exact_quantiles(pairs, keys, "predicted", cuts, count="__total").select(
        *keys, F.array_distinct(F.array(*cuts)).alias("__edges"), "__total"
    ).filter(F.col("__total") >= min_samples)
    binned = pairs.join(edges, keys).withColumn("__bin", _bin(F.col("__edges"), F.col("predicted")))
    own = exact_quantiles(binned, [*keys, "__bin"], "residual", probs, count="__n")
    pooled = exact_quantiles(pairs, keys, "residual", {f"__p_{n}": p for n, p in probs.items()})
    d = new.join(edges, keys, "left").withColumn("__bin", _bin(F.col("__edges"), F.col("predicted")))
    d = d.join(own, [*keys, "__bin"], "left").join(pooled, keys, "left")
    pick = {n: F.when(F.col("__total").isNotNull(), F.when(F.col("__n") >= min_samples, F.col(n)).otherwise(F.col(f"__p_{n}"))) for n in probs}
    return d.select(*new.columns, *[c.alias(n) for n, c in pick.items()])


def scorable(points: DataFrame, keys, lo: int = 1, hi: int = 17) -> DataFrame:
    """Cells that are measured and for which every model of the series has quantiles, with their CRPS and the ``band`` of two of the levels.

    A filter row by row; what follows needs ``q`` no more, and storing it would take most of the space."""
    band = F.struct(F.element_at("q", lo + 1).alias("lo"), F.element_at("q", hi + 1).alias("hi"))
    return points.filter("complete").withColumn("crps", crps(F.col("actual"), F.col("q"))).withColumn("band", band).drop("complete")


def scores(cells: DataFrame, keys) -> DataFrame:
    """One row per model: errors, CRPS, coverage and width of the band, bias and amplitude."""
    e = F.col("point") - F.col("actual")
    a, b = F.col("band.lo"), F.col("band.hi")
    return cells.groupBy(*keys, "model").agg(
        F.count_distinct("origin").alias("n_origins"), F.count(F.lit(1)).alias("n_points"), F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg("crps").alias("crps"),
        F.avg(((F.col("actual") >= a) & (F.col("actual") <= b)).cast("double")).alias("coverage"), F.avg(b - a).alias("width"),
        F.when(F.sum("actual") > 0, 100.0 * (F.sum("point") / F.sum("actual") - 1.0)).alias("bias_pct"),
        F.when(F.stddev_pop("actual") > 0, F.stddev_pop("point") / F.stddev_pop("actual")).alias("amplitude_ratio"),
    )


def by_lead(cells: DataFrame, keys, bucket: int) -> DataFrame:
    e = F.col("point") - F.col("actual")
    start = (F.expr(f"(lead - 1) div {bucket}") * bucket + 1).cast("long")
    return cells.groupBy(*keys, "model", start.alias("lead_start")).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg("crps").alias("crps"))


def period_totals(cells: DataFrame, points: DataFrame, keys, tz: str = "UTC") -> DataFrame:
    """Error of the total from the first cell to the end of its local day, by issue hour.

    Only origins whose day ends inside the horizon with every cell scorable.
    """
    def local(ts):
        # casts to an instant and back cost more than the sums
        return F.col(ts) if tz == "UTC" else to_local(ts, tz)

    by, day = [*keys, "model", "origin"], F.to_date(local("target_dt")).alias("__day")
    days = points.groupBy(*by, day).agg(F.min("target_dt").alias("__first"), F.max("target_dt").alias("__last"), F.count(F.lit(1)).alias("__need"))
    first = [F.min_by(c, "__first").alias(c) for c in ("__day", "__need")]
    need = days.groupBy(*by).agg(*first, F.min("__first").alias("__first"), F.max("__last").alias("__last")).dropna(subset=by)
    need = need.filter(F.to_date(local("__last")) > F.col("__day")).drop("__last")
    # first days and cells meet in one aggregation: cells are summed up where they are, and a row or two of each origin are shuffled
    got = cells.select(*by, day, "point", "actual", F.lit(1).alias("__one"))
    got = need.unionByName(got, allowMissingColumns=True).groupBy(*by, "__day").agg(
        F.max("__need").alias("__need"), F.max("__first").alias("__first"), F.count("__one").alias("__n"), (F.sum("point") - F.sum("actual")).alias("__e"))
    got = got.filter("__n = __need")
    f = local("__first")
    hour = F.hour(f) + F.minute(f) / 60.0
    return got.groupBy(*keys, "model", hour.alias("issue_hour")).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("__e") * F.col("__e"))).alias("rmse"), F.avg("__e").alias("bias"))


def period_total_rmse(totals: DataFrame, keys) -> DataFrame:
    return totals.groupBy(*keys, "model").agg(
        F.sqrt(F.sum(F.col("rmse") * F.col("rmse") * F.col("n")) / F.sum("n")).alias("period_total_rmse"))


def evidence(cells: DataFrame, keys, horizon: int, seconds: int) -> DataFrame:
    days = (F.max(epoch("origin")) - F.min(epoch("origin")) + horizon * seconds) / 86400.0
    return cells.groupBy(*keys).agg(days.alias("evaluation_days")).withColumn("enough", F.col("evaluation_days") >= MIN_EVALUATION_DAYS)


def eligibility(score: DataFrame, totals: DataFrame, keys, guardrail: str = GUARDRAIL) -> DataFrame:
    """Scores with ``period_total_rmse``, its ``limit`` and ``eligible``."""
    d = score.join(period_total_rmse(totals, keys), [*keys, "model"], "left")
    # a window, as a join would make all scores and totals once more for the guardrail
    ref = F.max(F.when(F.col("model") == guardrail, TOTAL_TOLERANCE * F.col("period_total_rmse"))).over(W.partitionBy(*keys))
    d = d.withColumn("limit", F.when(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]), ref))
    return d.withColumn("eligible", F.coalesce(F.col("period_total_rmse") <= F.col("limit"), F.lit(True)))


def select_by_crps(eligible: DataFrame, keys, candidates: list[str]) -> DataFrame:
    """Lowest CRPS among eligible candidates, or among all when none is eligible."""
    d = eligible.filter(F.col("model").isin(candidates) & F.col("crps").isNotNull())
    order = F.struct((~F.col("eligible")).cast("int"), F.round("crps", 9), F.col("model"))
    return d.groupBy(*keys).agg(F.min_by(F.struct("model", "crps", "eligible"), order).alias("w")).select(*keys, "w.*")


def objective(eligible: DataFrame) -> DataFrame:
    """CRPS, scaled up by how far an ineligible model exceeds its limit."""
    factor = F.when(~F.col("eligible") & (F.col("limit") > 0), F.col("period_total_rmse") / F.col("limit")).otherwise(F.lit(1.0))
    return eligible.withColumn("objective", F.col("crps") * factor)


def published_ranking(eligible: DataFrame, keys, candidates: list[str]) -> DataFrame:
    """Eligible models first, then CRPS; nothing where a candidate was not scored."""
    d = eligible.filter(F.col("model").isin(candidates))
    whole = d.filter(F.col("crps").isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") == len(candidates))
    w = W.partitionBy(*keys).orderBy((~F.col("eligible")).cast("int"), F.round("crps", 9), "model")
    return d.join(whole.drop("__n"), list(keys), "left_semi").withColumn("rank", F.row_number().over(w).cast("long"))


def origin_losses(cells: DataFrame, keys) -> DataFrame:
    e = F.col("point") - F.col("actual")
    return cells.groupBy(*keys, "model", "origin").agg(F.avg("crps").alias("crps"), F.avg(e * e).alias("sq_err"))


def paired_difference(losses: DataFrame, keys, candidate: str, incumbent: str, metric: str = "crps", n_boot: int = 2000, seed: int = 0) -> DataFrame:
    """Mean loss difference with a bootstrap over days.

    Days are reduced to (sum, count) first, so a resample adds up one pair per day.
    """
    def side(m, n):
        return losses.filter(F.col("model") == m).select(*keys, "origin", F.col(metric).alias(n))

    d = side(candidate, "a").join(side(incumbent, "b"), [*keys, "origin"]).withColumn("__d", F.col("a") - F.col("b"))
    days = d.groupBy(*keys, F.to_date("origin").alias("day")).agg(F.sum("__d").alias("s"), F.count("__d").cast("double").alias("c"))
    g = days.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("day", "s", "c"))).alias("__x"), (F.sum("s") / F.sum("c")).alias("mean"))
    g = ratio_intervals(g.withColumn("n_days", F.size("__x")).filter("n_days >= 2"), "__x", n_boot, seed)
    verdict = F.when(F.col("hi") < 0, "better").when(F.col("lo") > 0, "worse").otherwise("indistinguishable")
    return g.select(*keys, "mean", "lo", "hi", "n_days", verdict.alias("verdict"))
