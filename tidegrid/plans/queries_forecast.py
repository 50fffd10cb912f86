"""Forecasters and publishing over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.functions import generators
from tidegrid.functions.pandas_metrics import metric_by
from tidegrid.functions.timecols import epoch, from_epoch, shift, time_bin
from tidegrid.operators import analytics as ag
from tidegrid.operators import features as wf
from tidegrid.operators import forecast as fc
from tidegrid.operators import protocol as pr
from tidegrid.operators import recursive as rc
from tidegrid.operators import splits as cv
from tidegrid.operators.recursive import Recipe
from tidegrid.plans import inputs as i
from tidegrid.plans.queries_eval import predictions
from tidegrid.plans.queries_sources import _trajectories as trajectories
from tidegrid.plans.registry import CHECKS, cte, query
from tidegrid.session import cut_lineage
from tidegrid.sources import logs
from tidegrid.streaming.jobs import new_folder

K = ["series_id"]
E = ["experiment"]
LAGS = [1, 2, 4, 8]


def rnd(df, **places):
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


cte("ahead", "SELECT series_id, max(grid_ts) AS issued_at, max(grid_ts) + k * INTERVAL '6 hours' AS target_dt, k AS lead FROM load6, unnest(generate_series(1, 8)) AS u(k) GROUP BY series_id, k", "load6")
cte("back", "SELECT series_id, y, row_number() OVER (PARTITION BY series_id ORDER BY grid_ts DESC) - 1 AS age FROM load6", "load6")


@query("FC1_baseline", "SELECT a.*, round(m, 4) AS pred, round(q10, 4) AS q10, round(q90, 4) AS q90 FROM ahead a JOIN (SELECT series_id, avg(y) AS m, quantile_cont(y, 0.1) AS q10, quantile_cont(y, 0.9) AS q90 FROM load6 GROUP BY 1) b USING (series_id)", "ahead load6")
def _(spark, sf):
    d = fc.baseline_forecast(i.load6(spark, sf), K, i.SIX, 8)
    return rnd(d.select(*K, "issued_at", "target_dt", "lead", "pred", "q10", "q90"), pred=4, q10=4, q90=4)


@query("FC2_seasonal_profile", """SELECT a.*, round(coalesce(c.m, b.m, o.m), 4) AS pred FROM ahead a LEFT JOIN (SELECT series_id, slot, weekend, avg(y) AS m FROM slots GROUP BY 1, 2, 3) c ON c.series_id = a.series_id AND c.slot = hour(target_dt) // 6 AND c.weekend = CASE WHEN isodow(target_dt) >= 6 THEN 1 ELSE 0 END
LEFT JOIN (SELECT series_id, slot, avg(y) AS m FROM slots GROUP BY 1, 2) b ON b.series_id = a.series_id AND b.slot = hour(target_dt) // 6 JOIN (SELECT series_id, avg(y) AS m FROM slots GROUP BY 1) o ON o.series_id = a.series_id""", "ahead slots")
def _(spark, sf):
    return rnd(fc.profile_forecast(i.load6(spark, sf), K, i.SIX, 8), pred=4)


@query("FC3_previous_day", "SELECT a.*, b.y AS pred FROM ahead a JOIN back b ON b.series_id = a.series_id AND b.age = 3 - (lead - 1) % 4", "ahead back")
def _(spark, sf):
    return fc.previous_day(i.load6(spark, sf), K, i.SIX, 8)


@query("FC4_seasonal_naive", "SELECT a.*, b.y AS pred FROM ahead a JOIN back b ON b.series_id = a.series_id AND b.age = 27 - (lead - 1) % 28", "ahead back")
def _(spark, sf):
    return fc.seasonal_naive(i.load6(spark, sf), K, i.SIX, 8, 28)


@query("FC5_daily_profile", """WITH d AS (SELECT series_id, age // 4 AS day, sum(y) AS s FROM back WHERE age < 28 GROUP BY 1, 2), z AS (SELECT series_id, CASE WHEN max(CASE WHEN day = 0 THEN s END) > 1e-9 THEN sum(pow(0.5, day / 3.0) * s) / sum(pow(0.5, day / 3.0)) / max(CASE WHEN day = 0 THEN s END) ELSE 1 END AS r FROM d GROUP BY 1)
SELECT a.*, round(least(b.y * greatest(least(r, 4), 0.25), hi), 4) AS pred FROM ahead a JOIN back b ON b.series_id = a.series_id AND b.age = 3 - (lead - 1) % 4 JOIN z ON z.series_id = a.series_id JOIN (SELECT series_id, CASE WHEN max(y) > 0 THEN max(y) ELSE 'inf'::DOUBLE END AS hi FROM load6 GROUP BY 1) h ON h.series_id = a.series_id""", "ahead back load6")
def _(spark, sf):
    return rnd(fc.daily_profile(i.load6(spark, sf), K, i.SIX, 8), pred=4)


def _train(spark, sf, **shares):
    return cut_lineage(fc.training_frame(i.load6(spark, sf), K, 360, LAGS, **shares))


def _mae(model, rows):
    return model.transform(rows).groupBy(*K).agg(F.avg(F.abs(F.col("prediction") - F.col("label"))).alias("mae"))


WEIGHTS = {"y_lag_1": 0.3, "y_lag_4": 0.2, "y_rolling_mean_4": 0.2, "y_rolling_std_4": 0.05, "y_rolling_max_8": 0.1, "y_diff_1": 0.1, "hour_cos": 5.0, "activity": 0.02}
RECIPE = Recipe((1, 2, 4, 8), (4, 8), True, ("hour", "hour_sin", "hour_cos"), ("activity",), "light")
# A week's delay makes the fleet's activity known for all leads; midnight cells play the dark ones.
cte("activity", "SELECT grid_ts + INTERVAL '7 days' AS grid_ts, sum(y) / 100 AS activity FROM load6 GROUP BY 1", "load6")


def _known(spark, sf, cells):
    week = i.load6(spark, sf).groupBy(shift("grid_ts", 7 * i.DAY).alias("grid_ts")).agg((F.sum("y") / 100).alias("activity"))
    d = cells.join(week, "grid_ts", "left").fillna(0.0, ["activity"])
    return d.withColumn("light", F.when(F.hour("grid_ts") == 0, 0.0).otherwise(1.0))


def _rolled(spark, sf, step):
    d = cut_lineage(_known(spark, sf, i.load6(spark, sf)))
    future = _known(spark, sf, fc.future_cells(d, K, i.SIX, 8).select(*K, F.col("target_dt").alias("grid_ts")))
    return rc.roll_forward(step(d), d, K, i.SIX, 8, RECIPE, future)


@query("FC6_recursive_features", """WITH RECURSIVE r AS (SELECT series_id, t AS issued_at, 0 AS h, list(y ORDER BY grid_ts) AS c FROM (SELECT *, max(grid_ts) OVER (PARTITION BY series_id) AS t FROM load6)
WHERE grid_ts > t - INTERVAL '48 hours' GROUP BY 1, 2 HAVING count(*) = 8
UNION ALL SELECT series_id, issued_at, h + 1, list_append(c, CASE WHEN hour(t) = 0 THEN 0.0 ELSE CASE WHEN hour(t - INTERVAL '6 hours') <> 0 THEN 0.3 * c[-1] + 0.1 * (c[-1] - c[-2]) ELSE 0 END + 0.2 * c[-4]
+ 0.2 * list_avg(c[-4:]) + 0.05 * list_aggregate(c[-4:], 'stddev_samp') + 0.1 * list_max(c[-8:]) + 5.0 * cos(hour(t) * 2 * pi() / 24) + 0.02 * coalesce(activity, 0) END)
FROM (SELECT *, issued_at + (h + 1) * INTERVAL '6 hours' AS t FROM r WHERE h < 8) LEFT JOIN activity ON activity.grid_ts = t)
SELECT a.*, round(c[8 + lead], 3) AS pred, CASE WHEN c IS NULL THEN 'short' ELSE 'ok' END AS status FROM ahead a LEFT JOIN (SELECT series_id, c FROM r WHERE h = 8) USING (series_id)""", "load6 ahead activity")
def _(spark, sf):
    return rnd(_rolled(spark, sf, lambda d: rc.weighted_step(WEIGHTS)), pred=3)


@query("FC6_forecast_cycle")
def _(spark, sf):
    # From history to what is published: fit, roll forward, bound, log, payload.
    def fitted(d):
        return rc.model_step(fc.fit_pooled(cut_lineage(rc.supervised(d, K, i.SIX, RECIPE)), "linear"), RECIPE)

    d = cut_lineage(_rolled(spark, sf, fitted)).filter("status = 'ok'").select(
        F.col("series_id").alias("experiment"), F.lit("linear").alias("model_name"), "issued_at", "target_dt", F.greatest("pred", F.lit(0.0)).alias("predicted"),
        (F.col("lead") * 360).alias("lead_minutes"))
    band = fc.conformal_band(d, cut_lineage(ag.conformal_quantiles(_rows(spark, sf))), 720)
    return logs.publish_payload(logs.log_forecast(band))


@query("FC7_boosted_trees")
def _(spark, sf):
    t = _train(spark, sf, test_share=0.2)
    return rnd(_mae(fc.fit_pooled(t, "gbt"), t.filter("is_test")), mae=2)


@query("FC8_loss_choice")
def _(spark, sf):
    t = _train(spark, sf)
    out = None
    for loss in ("mse", "huber", "tweedie"):
        e = _mae(fc.fit_pooled(t, "linear", loss), t.filter("is_valid")).withColumn("loss", F.lit(loss))
        out = e if out is None else out.unionByName(e)
    return rnd(out, mae=2)


@query("FC9_feature_importance")
def _(spark, sf):
    m = fc.fit_pooled(_train(spark, sf), "forest")
    return rnd(fc.feature_importance(m, [f"y_lag_{k}" for k in LAGS] + ["hour"], spark), importance=4)


@query("FC10_direct_linear")
def _(spark, sf):
    d = i.load6(spark, sf)
    w = cut_lineage(wf.sliding_windows(d, K, i.SIX, ["y"], 8, 8))
    # one short window a series, read once for each lead
    last = cut_lineage(wf.inference_window(d, K, i.SIX, ["y"], 8))
    return rnd(fc.direct_forecast(fc.direct_linear(w, 8), last, K, i.SIX), pred=3)


cte("smooth", """SELECT series_id, sum(CASE WHEN age = top THEN pow(CAST(0.7 AS DOUBLE), age) ELSE CAST(0.3 AS DOUBLE) * pow(CAST(0.7 AS DOUBLE), age) END * y) AS l, regr_slope(y, top - age) AS b
FROM (SELECT *, max(age) OVER (PARTITION BY series_id) AS top FROM back) GROUP BY 1""", "back")


@query("FC11_exponential_smoothing", "SELECT a.*, CAST(0.3 AS DOUBLE) AS alpha, round(l, 4) AS pred FROM ahead a JOIN smooth USING (series_id)", "ahead smooth")
def _(spark, sf):
    return rnd(fc.exponential_smoothing(i.load6(spark, sf), K, i.SIX, 8, [0.3]), pred=4)


@query("FC11_theta", "SELECT a.*, CAST(0.3 AS DOUBLE) AS alpha, round(l + 0.5 * coalesce(b, 0) * lead, 4) AS pred FROM ahead a JOIN smooth USING (series_id)", "ahead smooth")
def _(spark, sf):
    return rnd(fc.exponential_smoothing(i.load6(spark, sf), K, i.SIX, 8, [0.3], theta=True), pred=4)


@query("FC11_smoothing_grid", """WITH h AS (SELECT series_id, list({'l': CAST(y AS DOUBLE), 'e': CAST(0 AS DOUBLE)} ORDER BY age DESC) AS ys FROM back GROUP BY 1),
f AS (SELECT series_id, alpha, list_reduce(ys, lambda s, x: {'l': s.l + alpha * (x.l - s.l), 'e': s.e + (x.l - s.l) * (x.l - s.l)}) AS r FROM h, (VALUES (CAST(0.1 AS DOUBLE)), (0.3), (0.5), (0.8)) AS g(alpha)),
best AS (SELECT series_id, arg_min(alpha, r.e) AS alpha, arg_min(r.l, r.e) AS l FROM f GROUP BY 1)
SELECT a.*, alpha, round(l, 4) AS pred FROM ahead a JOIN best USING (series_id)""", "ahead back")
def _(spark, sf):
    return rnd(fc.exponential_smoothing(i.load6(spark, sf), K, i.SIX, 8, [0.1, 0.3, 0.5, 0.8]), pred=4)


def _folded(spark, sf):
    """Training rows with their role in each of the CV1 folds."""
    rows = fc.training_frame(i.load6(spark, sf), K, 360, LAGS, 0.0)
    numbered = cv.number_rows(rows, K)
    return cv.assign_folds(numbered, cv.fold_table(numbered.select(*K, "n_rows").distinct(), K), K)


@query("BM1_fitted_models")
def _(spark, sf):
    models = {"linear": lambda: fc.regressor("linear"), "robust": lambda: fc.regressor("linear", "huber"), "forest": lambda: fc.regressor("forest")}
    return rnd(fc.benchmark(_folded(spark, sf), K, [f"y_lag_{k}" for k in LAGS] + ["hour"], models), mae=2, rmse=2)


@query("FC12_parameter_search")
def _(spark, sf):
    d = fc.parameter_search(_folded(spark, sf), fc.draw_params({"numTrees": [5, 10, 20], "maxDepth": range(2, 7)}, 6))
    return rnd(d, mae=2)


@query("FC13_covariate_ablation")
def _(spark, sf):
    ev = i.table(spark, sf, "events").filter(F.col("event_type").isin("click", "view"))
    cell = [F.col("user_id").cast("string").alias("series_id"), time_bin("ts", i.SIX).alias("grid_ts")]
    side = ev.groupBy(*cell).agg(*[F.count_if(F.col("event_type") == c).cast("double").alias(c) for c in ("click", "view")])
    d = _folded(spark, sf).drop("features").join(side, [*K, "grid_ts"], "left").fillna(0.0, ["click", "view"])
    models = {"linear": lambda: fc.regressor("linear"), "robust": lambda: fc.regressor("linear", "huber")}
    arms = fc.ablation_errors(d, K, [f"y_lag_{k}" for k in LAGS] + ["hour"], ["click", "view"], models, {"click_x_view": ("click", "view")})
    return rnd(fc.ablation_advice(fc.ablation_report(cut_lineage(arms), K), K), avg_change=4)


cte("half_q", "SELECT experiment, lead_bucket, CASE WHEN count(*) >= 10 THEN quantile_cont(abs(predicted - actual), 0.8) END AS q FROM won GROUP BY 1, 2", "won")
cte("fresh", "SELECT experiment, model_name, issued_at, target_dt, lead_minutes, predicted FROM forecast_log", "forecast_log")


def _fresh(spark, sf):
    return i.forecast_log(spark, sf).select("experiment", "model_name", "issued_at", "target_dt", "lead_minutes", "predicted")


def _rows(spark, sf):
    return ag.scored(i.forecast_log(spark, sf), i.actuals(spark, sf), 720)


@query("FC14_conformal_band", """SELECT f.*, round(predicted + coalesce(q, p), 4) AS upper, round(greatest(predicted - coalesce(q, p), 0), 4) AS lower FROM fresh f LEFT JOIN half_q h ON h.experiment = f.experiment AND h.lead_bucket = f.lead_minutes // 720 * 720
JOIN (SELECT experiment, quantile_cont(abs(predicted - actual), 0.8) AS p FROM won GROUP BY 1) w ON w.experiment = f.experiment""", "fresh half_q won")
def _(spark, sf):
    return rnd(fc.conformal_band(_fresh(spark, sf), cut_lineage(ag.conformal_quantiles(_rows(spark, sf))), 720), upper=4, lower=4)


@query("FC14_asymmetric_band", """WITH e AS (SELECT experiment, list_sort(list_distinct(quantile_cont(predicted, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]))) AS edges, quantile_cont(actual - predicted, 0.1) AS pl, quantile_cont(actual - predicted, 0.9) AS ph FROM won GROUP BY 1 HAVING count(*) >= 30),
b AS (SELECT w.experiment, len(list_filter(edges, lambda x: x <= predicted)) AS b, count(*) AS n, quantile_cont(actual - predicted, 0.1) AS lo, quantile_cont(actual - predicted, 0.9) AS hi FROM won w JOIN e USING (experiment) GROUP BY 1, 2)
SELECT f.*, round(predicted + greatest(CASE WHEN n >= 30 THEN hi ELSE ph END, 0), 3) AS upper, round(greatest(predicted + least(CASE WHEN n >= 30 THEN lo ELSE pl END, 0), 0), 3) AS lower FROM fresh f LEFT JOIN e USING (experiment) LEFT JOIN b ON b.experiment = f.experiment AND b.b = len(list_filter(edges, lambda x: x <= predicted))""", "fresh won")
def _(spark, sf):
    pairs = cut_lineage(ag.signed_residuals(_rows(spark, sf)).select("experiment", "predicted", "residual"))
    return rnd(fc.asymmetric_band(_fresh(spark, sf), pairs), upper=3, lower=3)


@query("FC15_cumulative_forecast", """SELECT f.*, CAST(target_dt AS DATE) AS day, CASE WHEN CAST(target_dt AS DATE) = CAST(issued_at AS DATE) THEN coalesce(t.total, 0) ELSE 0 END + sum(predicted) OVER (PARTITION BY f.experiment, model_name, issued_at, CAST(target_dt AS DATE) ORDER BY target_dt ROWS UNBOUNDED PRECEDING) AS cumulative FROM fresh f
LEFT JOIN (SELECT experiment, CAST(grid_ts AS DATE) AS day, sum(value) AS total FROM actuals WHERE hour(grid_ts) < 12 GROUP BY 1, 2) t ON t.experiment = f.experiment AND t.day = CAST(target_dt AS DATE)""", "fresh actuals")
def _(spark, sf):
    today = i.actuals(spark, sf).filter(F.hour("grid_ts") < 12).groupBy(*E, F.to_date("grid_ts").alias("day")).agg(F.sum("value").alias("total"))
    return fc.cumulative_forecast(_fresh(spark, sf), today)


cte("choices", "SELECT experiment, CAST(issued_at AS DATE) AS decided_at, arg_min(model_name, predicted * 1000 + CASE model_name WHEN 'last_value' THEN 0 ELSE 1 END) AS model FROM forecast_log GROUP BY 1, 2", "forecast_log")
cte("champions", "SELECT experiment, model, valid_from, lead(valid_from) OVER (PARTITION BY experiment ORDER BY valid_from) AS valid_to FROM (SELECT experiment, model, CAST(decided_at AS TIMESTAMP) AS valid_from, lag(model) OVER (PARTITION BY experiment ORDER BY decided_at) AS p FROM choices) WHERE p IS DISTINCT FROM model", "choices")


def _champions(spark, sf):
    d = i.forecast_log(spark, sf).withColumn("issued_at", F.date_trunc("day", "issued_at").cast("timestamp_ntz"))
    order = F.col("predicted") * 1000 + F.when(F.col("model_name") == "last_value", 0).otherwise(1)
    c = d.groupBy(*E, F.col("issued_at").alias("decided_at")).agg(F.min_by("model_name", order).alias("model"))
    return fc.champion_history(c.withColumn("version", F.lit("v1")))


@query("FC16_champion_history", "SELECT experiment, model, valid_from, valid_to FROM champions", "champions")
def _(spark, sf):
    return _champions(spark, sf).drop("version")


@query("FC16_champion_prune", "SELECT l.experiment, l.model_name, l.issued_at, l.target_dt FROM forecast_log l JOIN champions c ON c.experiment = l.experiment AND c.valid_to IS NULL AND c.model = l.model_name", "forecast_log champions")
def _(spark, sf):
    return fc.prune_to_champion(i.forecast_log(spark, sf), _champions(spark, sf)).select(*E, "model_name", "issued_at", "target_dt")


@query("FC17_holdout_display", """WITH w AS (SELECT experiment AS series_id, model_name AS model, issued_at, list(predicted ORDER BY target_dt) AS p FROM forecast_log GROUP BY 1, 2, 3), l AS (SELECT series_id, model, arg_max(p, issued_at) AS p, max(issued_at) AS t FROM w GROUP BY 1, 2)
SELECT h.series_id, l.model, h.grid_ts, coalesce(w.p[1], CASE WHEN h.grid_ts > l.t + INTERVAL '6 hours' THEN l.p[CAST(epoch(h.grid_ts - l.t) / 21600 AS BIGINT)] END) AS pred FROM load6 h JOIN l ON l.series_id = h.series_id LEFT JOIN w ON w.series_id = h.series_id AND w.model = l.model AND w.issued_at = h.grid_ts - INTERVAL '6 hours'""", "forecast_log load6")
def _(spark, sf):
    d = i.forecast_log(spark, sf).withColumnsRenamed({"experiment": "series_id", "model_name": "model", "issued_at": "anchor"})
    p = F.transform(F.sort_array(F.collect_list(F.struct("target_dt", "predicted"))), lambda e: e["predicted"])
    w = d.groupBy(*K, "model", "anchor").agg(p.alias("preds"))
    holdout = i.load6(spark, sf).join(w.select(*K, "model").distinct(), K)
    return fc.holdout_display(w, holdout, [*K, "model"], i.SIX)


@query("FC18_future_covariates", """SELECT a.*, coalesce(p.y, l.y) AS cov, CASE WHEN p.y IS NULL THEN 1 ELSE 0 END AS cov_missing FROM ahead a LEFT JOIN (SELECT series_id, grid_ts + INTERVAL '24 hours' AS t, y FROM sparse6) p ON p.series_id = a.series_id AND p.t = a.target_dt JOIN (SELECT series_id, arg_max(y, grid_ts) AS y FROM sparse6 WHERE y IS NOT NULL GROUP BY 1) l ON l.series_id = a.series_id""", "ahead sparse6")
def _(spark, sf):
    h = i.sparse6(spark, sf).withColumnRenamed("y", "cov")
    pub = h.withColumn("grid_ts", shift("grid_ts", i.DAY))
    return fc.future_covariates(fc.future_cells(i.load6(spark, sf), K, i.SIX, 8), h, pub, K)


@query("UD1_pandas_metric", "SELECT series_id, model, fold, round(avg(abs(y - pred)), 4) AS mae FROM preds WHERE pred IS NOT NULL GROUP BY 1, 2, 3", "preds")
def _(spark, sf):
    d = predictions(spark, sf).filter("pred is not null")
    return rnd(metric_by(d, [*K, "model", "fold"], lambda y, p: (y - p).abs().mean(), K, out="mae"), mae=4)


@query("UD2_pandas_forecaster", "SELECT series_id, max(grid_ts) + INTERVAL '6 hours' AS target_dt, CAST(1 AS BIGINT) AS lead, arg_max(y, grid_ts) AS pred FROM load6 GROUP BY 1", "load6")
def _(spark, sf):
    import pandas as pd

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.sort_values("grid_ts").iloc[-1]
        return pd.DataFrame({"series_id": [row["series_id"]], "target_dt": [row["grid_ts"] + pd.Timedelta(hours=6)], "lead": [1], "pred": [row["y"]]})

    return fc.apply_forecaster(i.load6(spark, sf), K, last, i.SIX, 28, "series_id string, target_dt timestamp_ntz, lead long, pred double")


def _fitted(*names: tuple[str, str]) -> str:
    """The SQL of registered forecasters, one below the other; those of ``names`` are (query, model)."""
    return " UNION ALL ".join(f"SELECT series_id, '{model}' AS model, target_dt, lead, pred FROM ({CHECKS[name][1]})" for name, model in names)


STORED = (("FC1_baseline", "baseline_mean"), ("FC2_seasonal_profile", "profile"), ("FC3_previous_day", "previous_day"), ("FC4_seasonal_naive", "seasonal_naive"),
          ("FC5_daily_profile", "daily_profile"), ("FC11_exponential_smoothing", "smoothing"), ("FC11_theta", "theta"))


@query("UD2_stored_models", _fitted(*STORED) + " UNION ALL SELECT series_id, 'baseline_zero', target_dt, lead, 0.0 FROM ahead", "ahead load6 slots back smooth")
def _(spark, sf):
    # Fitted, written, and forecast from what was written.
    path, models = new_folder(spark, "models"), pr.standard(i.SIX)
    pr.save_models(pr.fit_all(models, cut_lineage(i.load6(spark, sf)), K, i.SIX), path)
    d = pr.forecast_all(models, spark.read.parquet(path), K, i.SIX, 8)
    return rnd(d.select(*K, "model", "target_dt", "lead", "pred"), pred=4)


@query("UD3_grid_cells", "SELECT series_id, grid_ts FROM load6_spine", "load6_spine")
def _(spark, sf):
    # Stretches of a series are separate partitions of the table function.
    generators.register(spark)
    b = i.obs_fleet(spark, sf).groupBy(*K).agg(epoch(time_bin(F.min("ts"), i.SIX)).alias("a"), epoch(time_bin(F.max("ts"), i.SIX)).alias("z"))
    d = b.withColumn("s", F.explode(F.sequence("a", "z", F.lit(8 * i.DAY).cast("long"))))
    spans = d.select(F.col("series_id").alias("key"), from_epoch("s").alias("lo"), from_epoch(F.least("z", F.col("s") + 8 * i.DAY - i.SIX)).alias("hi"), F.lit(i.SIX).alias("seconds"))
    return spark.sql("SELECT key AS series_id, grid_ts FROM grid_cells(TABLE(SELECT * FROM {spans}) PARTITION BY (key, lo))", spans=spans)


@query("UD3_trajectory_cells", "SELECT experiment, model_name, issued_at, target_dt AS ts, predicted AS value FROM forecast_log WHERE lead_minutes <> 720", "forecast_log")
def _(spark, sf):
    generators.register(spark)
    own = ["experiment", "model_name", "issued_at"]
    t = trajectories(spark, sf).select(F.to_json(F.struct(*own)).alias("key"), F.col("attr").alias("text"))
    d = spark.sql("SELECT key, ts, value FROM trajectory_cells(TABLE(SELECT * FROM {t}))", t=t)
    k = F.from_json("key", "experiment string, model_name string, issued_at timestamp_ntz")
    return d.select(*[k[c].alias(c) for c in own], "ts", "value")
