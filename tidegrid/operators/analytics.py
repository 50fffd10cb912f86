"""Scoring a forecast log against what was measured later.

All functions take log rows (one row per experiment, model, version, issue
time and target) and, where needed, actuals on the same grid; grouping keys
always include the experiment, and every aggregate is mergeable or exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegrid.functions.timecols import epoch, lead_bucket, local_day, to_local
from tidegrid.operators.align import forecast_actual, keep_winners, max_bins, meet, seed_left_join, winner_cohort
from tidegrid.operators.quantiles import exact_quantiles
from tidegrid.operators.scan import Scan, previous, running

E = ["experiment"]
COHORT = ["model_name", "model_version"]
# Fixed values of the published analytics.
WARMUP_DAYS = 7
SCALE_RANGE = (0.25, 4.0)
WORST_MIN_N = 20
STALE_SHARE = 0.5


def _errors(p: str = "predicted", a: str = "actual") -> list[Column]:
    e = F.col(p) - F.col(a)
    return [
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("me"), F.count(F.lit(1)).alias("n"),
    ]


def scored(log: DataFrame, actuals: DataFrame, width: int, nonneg: bool = False) -> DataFrame:
    """Log rows with ``actual`` and ``lead_bucket``."""
    return forecast_actual(log, actuals, nonneg).withColumn("lead_bucket", lead_bucket("lead_minutes", width))


def lead_curves(rows: DataFrame) -> DataFrame:
    """Accuracy per lead bucket, for all cohorts together (``pooled``) and for each, in one pass."""
    d = rows.select(*E, "lead_bucket", *COHORT, "predicted", "actual")
    sets = d.groupingSets([["experiment", "lead_bucket"], ["experiment", "lead_bucket", *COHORT]], *E, "lead_bucket", *COHORT)
    out = sets.agg(*_errors(), F.grouping("model_name").alias("__g"))
    return out.withColumn("pooled", F.col("__g") == 1).drop("__g")


def revision(rows: DataFrame) -> DataFrame:
    """First against last forecast of each target that was forecast at least twice."""
    per = rows.groupBy(*E, "target_dt").agg(
        F.min_by("predicted", F.struct("issued_at", *COHORT)).alias("a"), F.max_by("predicted", F.struct("issued_at", *COHORT)).alias("z"),
        F.max("actual").alias("actual"), F.count(F.lit(1)).alias("k"),
    ).filter("k >= 2")
    d = per.groupBy(*E).agg(
        F.avg(F.abs(F.col("a") - F.col("actual"))).alias("first_mae"), F.avg(F.abs(F.col("z") - F.col("actual"))).alias("last_mae"),
        F.avg(F.col("a") - F.col("actual")).alias("first_me"), F.avg(F.col("z") - F.col("actual")).alias("last_me"),
        F.count(F.lit(1)).alias("n"),
    )
    gain = F.when(F.col("first_mae") > 0, (1 - F.col("last_mae") / F.col("first_mae")) * 100).otherwise(F.lit(0.0))
    return d.withColumn("improvement_pct", gain)


def typical_demand(actuals: DataFrame, nonneg: bool = False) -> DataFrame:
    v = F.col("value")
    d = actuals.filter(v.isNotNull() & (v >= 0)) if nonneg else actuals.filter(v.isNotNull())
    return d.groupBy(*E).agg(F.avg(F.abs(v)).alias("typical"))


def empty_reason(experiments: DataFrame, log: DataFrame, actuals: DataFrame) -> DataFrame:
    """ok, warming_up, no_overlap or no_actuals per experiment."""
    logged = log.groupBy(*E).agg(F.count(F.lit(1)).alias("n_log"))
    have = actuals.groupBy(*E).agg(F.count("value").alias("n_actual"))
    hit = forecast_actual(log, actuals).groupBy(*E).agg(F.count(F.lit(1)).alias("n_pairs"))
    d = experiments.join(logged, E, "left").join(have, E, "left").join(hit, E, "left").fillna(0)
    why = F.when(F.col("n_actual") == 0, "no_actuals").when(F.col("n_pairs") > 0, "ok").when(
        F.col("n_log") == 0, "warming_up").otherwise("no_overlap")
    return d.withColumn("reason", why)


def cumulative_forecasts(log: DataFrame, totals: DataFrame, seconds: int, scale: float = 1.0, offset_hours: float = 0.0) -> DataFrame:
    """Running day totals of every forecast, started from the measured total of the issue day.

    ``totals`` holds (experiment, grid_ts, day_total). A window covers one
    issuance and day, so it is as long as a day has bins.
    """
    d = seed_left_join(log, totals, seconds, offset_hours)
    w = W.partitionBy(*E, *COHORT, "issued_at", "target_day").orderBy("target_dt").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("predicted_cum", F.col("seed") + F.sum("predicted").over(w) * scale)
    t = totals.filter(F.col("day_total").isNotNull()).select(*E, F.col("grid_ts").alias("target_dt"), F.col("day_total").alias("actual_cum"))
    return meet(d.filter(F.col("predicted_cum").isNotNull()), t, [*E, "target_dt"])


def daily_cum_accuracy(cum: DataFrame, width: int) -> DataFrame:
    d = cum.withColumn("lead_bucket", lead_bucket("lead_minutes", width))
    return d.groupBy(*E, "lead_bucket").agg(*_errors("predicted_cum", "actual_cum"))


def end_of_day(cum: DataFrame) -> DataFrame:
    """The last same-day target of each issuance."""
    last = cum.filter(F.col("target_day") == F.col("issued_day")).groupBy(*E, *COHORT, "issued_at", "target_day").agg(
        F.max_by(F.struct("predicted_cum", "actual_cum"), "target_dt").alias("x")
    )
    e = F.col("x.predicted_cum") - F.col("x.actual_cum")
    return last.groupBy(*E).agg(
        F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("me"), F.avg("x.predicted_cum").alias("mean_predicted"),
        F.avg("x.actual_cum").alias("mean_actual"), F.count(F.lit(1)).alias("n"),
    )


def typical_day_max(totals: DataFrame) -> DataFrame:
    d = totals.filter(F.col("day_total").isNotNull()).groupBy(*E, F.to_date("grid_ts").alias("day")).agg(F.max("day_total").alias("m"))
    return d.groupBy(*E).agg(F.avg("m").alias("typical_day_max"))


def winning_rows(rows: DataFrame) -> DataFrame:
    """Per lead bucket the rows of its dominant cohort."""
    by = [*E, "lead_bucket"]
    counts = rows.groupBy(*by, *COHORT).agg(F.count(F.lit(1)).alias("n"))
    return keep_winners(rows, winner_cohort(counts, by), by)


def conformal_quantiles(rows: DataFrame, level: float = 0.8, min_samples: int = 10) -> DataFrame:
    """Band half-width per lead bucket; null where samples are few. ``fallback`` pools all buckets."""
    d = winning_rows(rows).select(
        *E, F.explode(F.array(F.col("lead_bucket"), F.lit(None).cast("long"))).alias("lead_bucket"),
        F.abs(F.col("predicted") - F.col("actual")).alias("__abs"),
    ).withColumn("__k", F.coalesce(F.col("lead_bucket").cast("string"), F.lit("pooled")))
    q = exact_quantiles(d, [*E, "__k"], "__abs", {"q": level}, count="n")
    w = W.partitionBy(*E)
    pool = F.col("__k") == "pooled"
    q = q.withColumns({"fallback": F.max(F.when(pool, F.col("q"))).over(w), "total": F.max(F.when(pool, F.col("n"))).over(w)})
    return q.filter(~pool).select(
        *E, F.col("__k").cast("long").alias("lead_bucket"), F.when(F.col("n") >= min_samples, F.col("q")).alias("q"), "n", "fallback", "total"
    )


def signed_residuals(rows: DataFrame) -> DataFrame:
    return winning_rows(rows).select(*E, "lead_bucket", "predicted", (F.col("actual") - F.col("predicted")).alias("residual"))


def _banded(rows: DataFrame) -> DataFrame:
    d = rows.filter(F.col("upper").isNotNull() & F.col("lower").isNotNull())
    return d.withColumn("hit", F.col("actual").between(F.col("lower"), F.col("upper")).cast("double"))


def coverage(rows: DataFrame, tz: str = "UTC") -> DataFrame:
    """Share of actuals inside the band as (kind, bucket, coverage, n).

    By lead on each bucket's dominant cohort; overall, by local hour and by
    weekday/weekend on the experiment's dominant cohort. Cohorts are compared
    after aggregation, so the rows are never joined with their winners.
    """
    d = _banded(rows)
    agg = [F.avg("hit").alias("coverage"), F.count(F.lit(1)).alias("n")]
    lead = winner_cohort(d.groupBy(*E, "lead_bucket", *COHORT).agg(*agg), [*E, "lead_bucket"]).select(
        *E, F.lit("lead").alias("kind"), F.col("lead_bucket").cast("string").alias("bucket"), "coverage", "n"
    )
    t = to_local("target_dt", tz)
    d = d.withColumn("hour", F.hour(t).cast("string")).withColumn("part", F.when(F.weekday(t) >= 5, "weekend").otherwise("weekday"))
    cells = d.groupBy(*E, *COHORT, "hour", "part").agg(F.sum("hit").alias("s"), F.count(F.lit(1)).alias("n"))
    best = winner_cohort(cells.groupBy(*E, *COHORT).agg(F.sum("n").alias("n")), E)
    cells = keep_winners(cells, best, E)
    sets = cells.groupingSets([["experiment"], ["experiment", "hour"], ["experiment", "part"]], *E, "hour", "part").agg(
        (F.sum("s") / F.sum("n")).alias("coverage"), F.sum("n").alias("n"), F.grouping("hour").alias("gh"), F.grouping("part").alias("gp")
    )
    kind = F.when(F.col("gh") == 0, "hour").when(F.col("gp") == 0, "part").otherwise("overall")
    rest = sets.select(*E, kind.alias("kind"), F.coalesce("hour", "part", F.lit("all")).alias("bucket"), "coverage", "n")
    return lead.unionByName(rest)


def worst_bucket(cov: DataFrame, nominal: float = 0.8) -> DataFrame:
    """The bucket with enough rows whose coverage is furthest from nominal."""
    d = cov.filter((F.col("kind") != "overall") & (F.col("n") >= WORST_MIN_N)).withColumn("dev", F.abs(F.round("coverage", 4) - nominal))
    order = F.struct(F.round("dev", 6), F.col("kind"), F.col("bucket"))
    return d.groupBy(*E).agg(F.max_by(F.struct("kind", "bucket", "coverage", "n"), order).alias("w")).select(*E, "w.*")


def _spread(d: DataFrame, mean: str, sq: str) -> DataFrame:
    """Population spread and CV in percent; a zero mean with spread has no CV and is dropped."""
    std = F.sqrt(F.greatest(F.col(sq) - F.col(mean) * F.col(mean), F.lit(0.0)))
    flat = F.abs(mean) < 1e-9
    d = d.withColumn("std", std)
    cv = F.when(flat & (F.col("std") < 1e-9), F.lit(0.0)).when(~flat, 100.0 * F.col("std") / F.abs(mean))
    return d.withColumn("cv_pct", cv)


def stability_cohorts(log: DataFrame) -> DataFrame:
    """Per target and cohort: how much the forecasts of different issue times scatter."""
    d = log.groupBy(*E, "target_dt", *COHORT).agg(
        F.avg("predicted").alias("mean"), F.avg(F.col("predicted") * F.col("predicted")).alias("__sq"),
        F.count_distinct("issued_at").alias("n_cycles"),
    ).filter("n_cycles >= 2")
    return _spread(d, "mean", "__sq").filter(F.col("cv_pct").isNotNull()).drop("__sq")


def stability(log: DataFrame) -> DataFrame:
    """Per target, the dominant cohort only."""
    d = log.groupBy(*E, "target_dt", *COHORT).agg(
        F.avg("predicted").alias("mean"), F.avg(F.col("predicted") * F.col("predicted")).alias("__sq"),
        F.count_distinct("issued_at").alias("n_cycles"),
    ).filter("n_cycles >= 2")
    best = winner_cohort(d, [*E, "target_dt"], "n_cycles")
    return _spread(best, "mean", "__sq").filter(F.col("cv_pct").isNotNull()).drop("__sq", *COHORT)


def stability_daily(log: DataFrame, offset_hours: float = 0.0) -> DataFrame:
    """Scatter of daily totals over the issuances that cover the whole day."""
    per = log.groupBy(*E, *COHORT, "issued_at", local_day("target_dt", None, offset_hours).alias("day")).agg(
        F.sum("predicted").alias("total"), F.count(F.lit(1)).alias("n_bins")
    )
    full = max_bins(per, [*E, *COHORT, "day"])
    d = full.groupBy(*E, "day", *COHORT).agg(
        F.avg("total").alias("mean_total"), F.avg(F.col("total") * F.col("total")).alias("__sq"),
        F.count_distinct("issued_at").alias("n_cycles"), F.max("n_bins").alias("max_bins"),
    ).filter("n_cycles >= 2")
    best = _spread(winner_cohort(d, [*E, "day"], "n_cycles"), "mean_total", "__sq")
    return best.withColumn("cv_pct", F.coalesce("cv_pct", F.lit(0.0))).drop("__sq", *COHORT)


def median_cv(stab: DataFrame, digits: int = 2) -> DataFrame:
    return exact_quantiles(stab.withColumn("__cv", F.round("cv_pct", digits)), E, "__cv", {"median_cv": 0.5}, count="n")


def retrain_events(log: DataFrame) -> DataFrame:
    d = log.filter(F.col("model_version").isNotNull())
    return d.groupBy(*E, *COHORT).agg(F.min("issued_at").alias("first_seen"), F.count(F.lit(1)).alias("n"))


def newest(df: DataFrame, keys, order: str, n: int) -> DataFrame:
    """The n newest rows per key; the limit is applied before the shuffle as well as after it."""
    w = W.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")


def evolution(log: DataFrame, actuals: DataFrame, n: int = 12) -> DataFrame:
    """Trajectories of the last n issue times with the actuals of their targets."""
    runs = newest(log.select(*E, "issued_at").distinct(), E, "issued_at", n)
    a = actuals.select(*E, F.col("grid_ts").alias("target_dt"), F.col("value").alias("actual"))
    d = log.join(runs, [*E, "issued_at"], "left_semi").join(a, [*E, "target_dt"], "left")
    return d.select(*E, *COHORT, "issued_at", "target_dt", "predicted", "actual")


def trajectory_targets(rows: DataFrame, n: int = 48) -> DataFrame:
    """The newest targets with at least two issue times, with their largest error."""
    d = rows.groupBy(*E, "target_dt").agg(
        F.count_distinct("issued_at").alias("n_issuances"), F.max(F.abs(F.col("predicted") - F.col("actual"))).alias("max_abs_error"),
        F.max("actual").alias("actual"),
    ).filter("n_issuances >= 2")
    return newest(d, E, "target_dt", n)


def trajectory(log: DataFrame, targets: DataFrame) -> DataFrame:
    """Every forecast for the given targets (experiment, target_dt)."""
    return log.join(targets.select(*E, "target_dt"), [*E, "target_dt"], "left_semi").select(
        *E, *COHORT, "target_dt", "issued_at", "lead_minutes", "predicted"
    )


# ---- comparison with other forecasts ---------------------------------------------------------
def latest_per_bin(log: DataFrame, value: str, by=()) -> DataFrame:
    """The newest forecast of each target, per source."""
    return log.filter(F.col(value).isNotNull()).groupBy(*E, *by, F.col("target_dt").alias("grid_ts")).agg(
        F.max_by(F.struct(F.col(value).alias("v"), "lead_minutes"), F.struct("issued_at", "lead_minutes")).alias("x")
    ).select(*E, *by, "grid_ts", F.col("x.v").alias(value), F.col("x.lead_minutes").alias("lead_minutes"))


def head_to_head(app: DataFrame, ext: DataFrame, actuals: DataFrame) -> DataFrame:
    """Own against each external source on the bins all three share."""
    a = actuals.filter(F.col("value").isNotNull()).select(*E, "grid_ts", F.col("value").alias("actual"))
    p = latest_per_bin(app, "predicted").select(*E, "grid_ts", "predicted")
    x = latest_per_bin(ext, "value", ["source"]).select(*E, "source", "grid_ts", "value")
    j = meet(meet(x, p, [*E, "grid_ts"]), a, [*E, "grid_ts"])
    ea, ex = F.col("predicted") - F.col("actual"), F.col("value") - F.col("actual")
    d = j.groupBy(*E, "source").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(ea)).alias("app_mae"), F.sqrt(F.avg(ea * ea)).alias("app_rmse"), F.avg(ea).alias("app_bias"),
        F.avg(F.abs(ex)).alias("ext_mae"), F.sqrt(F.avg(ex * ex)).alias("ext_rmse"), F.avg(ex).alias("ext_bias"),
        F.avg(F.abs("actual")).alias("mean_actual"), F.avg(F.abs("value")).alias("mean_ext"),
    )
    a4, x4 = F.round("app_mae", 4), F.round("ext_mae", 4)
    ratio = F.when((F.col("mean_actual") > 1e-9) & (F.col("mean_ext") > 1e-9), F.round(F.col("mean_ext") / F.col("mean_actual"), 2))
    return d.withColumns(
        {
            "winner": F.when(a4 < x4, "app").when(x4 < a4, "external").otherwise("tie"),
            "improvement_pct": F.when(x4 > 0, (x4 - a4) / x4 * 100.0),
            "app_pct": F.when(F.col("mean_actual") > 1e-9, F.col("app_mae") / F.col("mean_actual") * 100.0),
            "scale_ratio": ratio,
            "scale_mismatch": F.coalesce((ratio > SCALE_RANGE[1]) | (ratio < SCALE_RANGE[0]), F.lit(False)),
        }
    )


def standalone_metrics(ext: DataFrame, actuals: DataFrame) -> DataFrame:
    """Each source on its own overlap with the actuals."""
    a = actuals.filter(F.col("value").isNotNull()).select(*E, "grid_ts", F.col("value").alias("actual"))
    j = meet(latest_per_bin(ext, "value", ["source"]), a, [*E, "grid_ts"])
    d = j.groupBy(*E, "source").agg(*_errors("value"), F.count_distinct(F.to_date("grid_ts")).alias("days_logged"))
    return d.withColumn("warming", F.col("days_logged") < WARMUP_DAYS)


def daily_total_error(app: DataFrame, ext: DataFrame, actuals: DataFrame) -> DataFrame:
    """Daily sums on bins common to actual, own and external forecast."""
    a = actuals.filter(F.col("value").isNotNull()).select(*E, "grid_ts", F.col("value").alias("actual"))
    p = latest_per_bin(app, "predicted").select(*E, "grid_ts", "predicted")
    x = latest_per_bin(ext, "value", ["source"]).select(*E, "source", "grid_ts", "value")
    days = meet(meet(x, p, [*E, "grid_ts"]), a, [*E, "grid_ts"]).groupBy(*E, "source", F.to_date("grid_ts").alias("day")).agg(
        (F.sum("predicted") - F.sum("actual")).alias("da"), (F.sum("value") - F.sum("actual")).alias("dx")
    )
    return days.groupBy(*E, "source").agg(
        F.avg(F.abs("da")).alias("app_mae"), F.avg("da").alias("app_bias"), F.avg(F.abs("dx")).alias("ext_mae"),
        F.avg("dx").alias("ext_bias"), F.count(F.lit(1)).alias("days"),
    )


def lead_sums(log: DataFrame, actuals: DataFrame, width: int, value: str = "value", cumulative: bool = False, by=("source",)) -> DataFrame:
    """Mergeable error sums per lead bucket; a cumulative source is differenced inside each issuance."""
    d = log.withColumnRenamed(value, "__v")
    if cumulative:
        w = W.partitionBy(*E, *by, "issued_at").orderBy("target_dt")
        step = F.col("__v") - F.lag("__v").over(w)
        d = d.withColumn("__v", F.when(step >= 0, step))
    a = actuals.filter(F.col("value").isNotNull()).select(*E, F.col("grid_ts").alias("target_dt"), F.col("value").alias("actual"))
    d = meet(d.filter(F.col("__v").isNotNull()), a, [*E, "target_dt"]).withColumn("lead_bucket", lead_bucket("lead_minutes", width))
    e = F.col("__v") - F.col("actual")
    return d.groupBy(*E, *by, "lead_bucket").agg(
        F.sum(F.abs(e)).alias("abs_sum"), F.sum(e * e).alias("sq_sum"), F.sum(e).alias("signed_sum"), F.count(F.lit(1)).alias("n")
    )


def merge_sums(parts: list[DataFrame], by=("source",)) -> DataFrame:
    """Error sums of disjoint slices added up."""
    return reduce(DataFrame.unionByName, parts).groupBy(*E, *by, "lead_bucket").agg(
        *[F.sum(c).alias(c) for c in ("abs_sum", "sq_sum", "signed_sum", "n")]
    )


def skill_common_band(sums: DataFrame, reasons: DataFrame | None = None) -> DataFrame:
    """Scores over the lead buckets that every eligible source has.

    ``reasons`` holds (experiment, source, reason); a source with a reason is left out.
    """
    d = sums
    if reasons is not None:
        d = d.join(reasons.filter(F.col("reason").isNotNull()).select(*E, "source"), [*E, "source"], "left_anti")
    need = d.groupBy(*E).agg(F.count_distinct("source").alias("__k"))
    band = d.groupBy(*E, "lead_bucket").agg(F.count_distinct("source").alias("__n")).join(need, E).filter("__n = __k")
    j = d.join(band.select(*E, "lead_bucket"), [*E, "lead_bucket"])
    n = F.sum("n")
    return j.groupBy(*E, "source").agg(
        (F.sum("abs_sum") / n).alias("mae"), F.sqrt(F.sum("sq_sum") / n).alias("rmse"), (F.sum("signed_sum") / n).alias("bias"),
        n.alias("n"), F.min("lead_bucket").alias("band_from"), F.max("lead_bucket").alias("band_to"),
    )


def exclusion_reasons(h2h: DataFrame, sums: DataFrame, suspects: DataFrame | None = None) -> DataFrame:
    """Why a source is left out of the skill table, or null."""
    has = sums.select(*E, "source").distinct().withColumn("__has", F.lit(True))
    d = h2h.select(*E, "source", "scale_mismatch").join(has, [*E, "source"], "left")
    sus = F.lit(False)
    if suspects is not None:
        d = d.join(suspects.select(*E, "source", "suspect"), [*E, "source"], "left")
        sus = F.col("suspect").isNotNull()
    why = F.when(F.col("scale_mismatch"), "scale mismatch").when(sus, "unit looks wrong").when(
        F.col("__has").isNull(), "no overlapping forecasts yet")
    return d.select(*E, "source", why.alias("reason"))


def overlay(app: DataFrame, ext: DataFrame, actuals: DataFrame, sources: list[str], since: str, until: str) -> DataFrame:
    """One timeline of actual (held forward), own and external values, four decimals."""
    lo, hi = F.lit(since).cast("timestamp_ntz"), F.lit(until).cast("timestamp_ntz")

    def part(d, v, name):
        return d.filter(F.col("grid_ts").between(lo, hi)).select(*E, "grid_ts", F.lit(name).alias("k") if isinstance(name, str) else name.alias("k"), F.col(v).alias("v"))

    rows = part(actuals.filter(F.col("value").isNotNull()), "value", "actual").unionByName(
        part(latest_per_bin(app, "predicted"), "predicted", "app")
    ).unionByName(part(latest_per_bin(ext, "value", ["source"]), "value", F.col("source")))
    names = ["actual", "app", *sources]
    wide = rows.groupBy(*E, "grid_ts").pivot("k", names).agg(F.first("v"))
    d = running(wide, E, ["grid_ts"], [Scan("__held", "last", F.col("actual"))])
    return d.withColumn("actual", F.col("__held")).drop("__held").withColumns({n: F.round(n, 4) for n in names})


def timing(app: DataFrame, ext: DataFrame) -> DataFrame:
    """Median lead of the values shown, median update gap, and whether a source has gone stale."""
    p = latest_per_bin(app, "predicted").groupBy(*E).agg(F.count(F.lit(1)).alias("app_points"))
    x = latest_per_bin(ext, "value", ["source"])
    lead = exact_quantiles(x, [*E, "source"], "lead_minutes", {"median_lead": 0.5}, count="ext_points")
    runs = previous(ext.select(*E, "source", "issued_at").distinct(), [*E, "source"], ["issued_at"], "__p", F.col("issued_at"))
    runs = runs.withColumn("__gap", (epoch("issued_at") - epoch("__p")) / 60.0)
    gap = exact_quantiles(runs, [*E, "source"], "__gap", {"update_minutes": 0.5})
    d = lead.join(gap, [*E, "source"], "left").join(p, E, "left").fillna(0, ["app_points"])
    return d.withColumn("stale", (F.col("app_points") > 0) & (F.col("ext_points") < STALE_SHARE * F.col("app_points")))


def seasonal_profile(df: DataFrame, keys, seconds: int, value: str = "y", ts: str = "grid_ts", tz: str = "UTC",
                     quantiles: dict[str, float] | None = None) -> DataFrame:
    """Mean (and exact quantiles) by slot and weekend, with coarser levels for cells without data.

    Every (slot, weekend) cell gets the finest available level: 2 slot and
    weekend, 1 slot, 0 everything.
    """
    keys = list(keys)
    t = to_local(ts, tz)
    slot = F.floor((F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)) / seconds)
    d = df.filter(F.col(value).isNotNull()).select(*keys, slot.alias("slot"), (F.weekday(t) >= 5).cast("long").alias("weekend"), F.col(value).alias("__v"))
    sets = [keys, [*keys, "slot"], [*keys, "slot", "weekend"]]
    agg = d.groupingSets(sets, *keys, "slot", "weekend").agg(F.avg("__v").alias("mean"), F.count(F.lit(1)).alias("n"))
    frames = [agg.filter(F.col("slot").isNull()), agg.filter(F.col("slot").isNotNull() & F.col("weekend").isNull()), agg.filter(F.col("weekend").isNotNull())]
    cells = d.select(*keys).distinct().withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(86400 // seconds - 1).cast("long")))).withColumn(
        "weekend", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    names = ["mean"]
    if quantiles:
        names += list(quantiles)
        for n, level in enumerate(([], ["slot"], ["slot", "weekend"])):
            q = exact_quantiles(d, [*keys, *level], "__v", quantiles)
            frames[n] = frames[n].join(q, [*keys, *level])
    out = cells
    for n, (f, level) in enumerate(zip(frames, ([], ["slot"], ["slot", "weekend"]))):
        out = out.join(f.select(*keys, *level, *[F.col(c).alias(f"{c}_{n}") for c in names], F.lit(n).alias(f"l_{n}")), [*keys, *level], "left")
    pick = [F.coalesce(f"{c}_2", f"{c}_1", f"{c}_0").alias(c) for c in names]
    return out.select(*keys, "slot", "weekend", *pick, F.coalesce("l_2", "l_1", "l_0").alias("level"))


def calibration_status(rows: DataFrame, level: float = 0.8, per_day: float = 1.0) -> DataFrame:
    """Samples so far and needed for a band, and days until enough."""
    import math

    need = max(10, math.ceil(round(10 / (1 - level), 9)))
    d = rows.groupBy(*E).agg(F.count(F.lit(1)).alias("have"))
    return d.withColumns(
        {"need": F.lit(need).cast("long"), "ready": F.col("have") >= need, "eta_days": F.greatest(F.lit(0.0), (need - F.col("have")) / per_day)}
    )


def first_lead(curve: DataFrame) -> DataFrame:
    """The error of the first non-negative lead bucket as the headline."""
    d = curve.filter(F.col("pooled") & (F.col("lead_bucket") >= 0))
    return d.groupBy(*E).agg(F.min_by("mae", "lead_bucket").alias("headline_mae"), F.min("lead_bucket").alias("lead_bucket"))
