"""Scoring of the derived forecast and external logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.operators import align as jn
from tidegrid.operators import analytics as ag
from tidegrid.operators.grid import daily_cumsum
from tidegrid.plans import inputs as i
from tidegrid.plans.registry import cte, query
from tidegrid.session import cut_lineage

E = ["experiment"]
W = 360


def rnd(df, **places):
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


def _rows(spark, sf):
    return ag.scored(i.forecast_log(spark, sf), i.actuals(spark, sf), 720)


def _totals(spark, sf):
    return daily_cumsum(i.actuals(spark, sf), E, "value")


def _cum(spark, sf):
    return ag.cumulative_forecasts(i.forecast_log(spark, sf), _totals(spark, sf), i.SIX)


cte("scored", """SELECT l.*, a.value AS actual, (l.lead_minutes // 720) * 720 AS lead_bucket FROM forecast_log l JOIN actuals a ON a.experiment = l.experiment AND a.grid_ts = l.target_dt""", "forecast_log actuals")
ERR = "round(avg(abs(predicted - actual)), 4) AS mae, round(sqrt(avg((predicted - actual) ** 2)), 4) AS rmse, round(avg(predicted - actual), 4) AS me, count(*) AS n"


@query("AG1_lead_curve", f"SELECT experiment, lead_bucket, {ERR} FROM scored GROUP BY 1, 2", "scored")
def _(spark, sf):
    d = ag.lead_curves(_rows(spark, sf)).filter("pooled").drop("pooled", "model_name", "model_version")
    return rnd(d, mae=4, rmse=4, me=4)


@query("AG2_lead_curve_cohorts", f"SELECT experiment, lead_bucket, model_name, model_version, {ERR} FROM scored GROUP BY 1, 2, 3, 4", "scored")
def _(spark, sf):
    return rnd(ag.lead_curves(_rows(spark, sf)).filter("not pooled").drop("pooled"), mae=4, rmse=4, me=4)


@query("AG3_revision_improvement", """SELECT experiment, round(avg(abs(a - actual)), 4) AS first_mae, round(avg(abs(z - actual)), 4) AS last_mae, round(avg(a - actual), 4) AS first_me, round(avg(z - actual), 4) AS last_me, count(*) AS n,
round(CASE WHEN avg(abs(a - actual)) > 0 THEN (1 - avg(abs(z - actual)) / avg(abs(a - actual))) * 100 ELSE 0 END, 4) AS improvement_pct FROM
(SELECT DISTINCT experiment, target_dt, actual, first_value(predicted) OVER w AS a, last_value(predicted) OVER w AS z, count(*) OVER (PARTITION BY experiment, target_dt) AS k FROM scored
WINDOW w AS (PARTITION BY experiment, target_dt ORDER BY issued_at, model_name, model_version ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) WHERE k >= 2 GROUP BY 1""", "scored")
def _(spark, sf):
    return rnd(ag.revision(_rows(spark, sf)), first_mae=4, last_mae=4, first_me=4, last_me=4, improvement_pct=4)


@query("AG4_typical_demand", "SELECT experiment, round(avg(abs(value)), 4) AS typical FROM actuals GROUP BY 1", "actuals")
def _(spark, sf):
    return rnd(ag.typical_demand(i.actuals(spark, sf)), typical=4)


@query("AG5_empty_reason", """WITH l AS (SELECT experiment, target_dt FROM forecast_log UNION ALL SELECT experiment || '-late', target_dt + INTERVAL '3650 days' FROM forecast_log),
a AS (SELECT experiment, grid_ts FROM actuals UNION ALL SELECT experiment || s, grid_ts FROM actuals, (VALUES ('-late'), ('-warm')) AS x(s)),
e AS (SELECT DISTINCT experiment || s AS experiment FROM actuals, (VALUES (''), ('-late'), ('-warm'), ('-quiet')) AS x(s))
SELECT e.experiment, CASE WHEN e.experiment NOT IN (SELECT experiment FROM a) THEN 'no_actuals' WHEN EXISTS (SELECT 1 FROM l JOIN a ON a.experiment = l.experiment AND a.grid_ts = l.target_dt WHERE l.experiment = e.experiment) THEN 'ok'
WHEN e.experiment NOT IN (SELECT experiment FROM l) THEN 'warming_up' ELSE 'no_overlap' END AS reason FROM e""", "forecast_log actuals")
def _(spark, sf):
    # Next to every experiment: one whose forecasts lie years ahead, one without forecasts and one without anything.
    def also(d, *ends):
        return d.withColumn("__end", F.explode(F.array(*[F.lit(e) for e in ("", *ends)]))).withColumn("experiment", F.concat("experiment", "__end"))

    a = i.actuals(spark, sf)
    log = also(i.forecast_log(spark, sf), "-late")
    log = log.withColumn("target_dt", F.when(F.col("__end") == "-late", F.col("target_dt") + F.expr("interval 3650 days")).otherwise(F.col("target_dt"))).drop("__end")
    d = ag.empty_reason(also(a.select(*E).distinct(), "-late", "-warm", "-quiet").select(*E), log, also(a, "-late", "-warm").drop("__end"))
    return d.select(*E, "reason")


cte("cum", """SELECT s.*, seed + sum(predicted) OVER (PARTITION BY s.experiment, model_name, model_version, issued_at, target_day ORDER BY target_dt ROWS UNBOUNDED PRECEDING) AS predicted_cum, d.day_total AS actual_cum
FROM seeded s LEFT JOIN day_totals d ON d.experiment = s.experiment AND d.grid_ts = s.target_dt""", "seeded day_totals")


@query("AG6_daily_cum_accuracy", """SELECT experiment, (lead_minutes // 720) * 720 AS lead_bucket, round(avg(abs(predicted_cum - actual_cum)), 4) AS mae, round(sqrt(avg((predicted_cum - actual_cum) ** 2)), 4) AS rmse,
round(avg(predicted_cum - actual_cum), 4) AS me, count(*) AS n FROM cum WHERE actual_cum IS NOT NULL GROUP BY 1, 2""", "cum")
def _(spark, sf):
    return rnd(ag.daily_cum_accuracy(_cum(spark, sf), 720), mae=4, rmse=4, me=4)


@query("AG7_end_of_day", """SELECT experiment, round(avg(abs(p - a)), 4) AS mae, round(avg(p - a), 4) AS me, round(avg(p), 4) AS mean_predicted, round(avg(a), 4) AS mean_actual, count(*) AS n FROM
(SELECT experiment, model_name, model_version, issued_at, target_day, arg_max(predicted_cum, target_dt) AS p, arg_max(actual_cum, target_dt) AS a FROM cum WHERE target_day = issued_day AND actual_cum IS NOT NULL GROUP BY 1, 2, 3, 4, 5) GROUP BY 1""", "cum")
def _(spark, sf):
    return rnd(ag.end_of_day(_cum(spark, sf)), mae=4, me=4, mean_predicted=4, mean_actual=4)


@query("AG8_typical_day_max", "SELECT experiment, round(avg(m), 4) AS typical_day_max FROM (SELECT experiment, CAST(grid_ts AS DATE) AS d, max(day_total) AS m FROM day_totals GROUP BY 1, 2) GROUP BY 1", "day_totals")
def _(spark, sf):
    return rnd(ag.typical_day_max(_totals(spark, sf)), typical_day_max=4)


cte("bucket_win", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY experiment, lead_bucket ORDER BY n DESC, model_version DESC NULLS LAST, model_name) AS rn FROM
(SELECT experiment, lead_bucket, model_name, model_version, count(*) AS n FROM scored GROUP BY 1, 2, 3, 4)) WHERE rn = 1""", "scored")
cte("won", "SELECT s.* FROM scored s JOIN bucket_win w ON w.experiment = s.experiment AND w.lead_bucket = s.lead_bucket AND w.model_name = s.model_name AND w.model_version IS NOT DISTINCT FROM s.model_version", "scored bucket_win")


@query("AG9_conformal_quantiles", """SELECT p.*, f.fallback, f.total FROM (SELECT experiment, lead_bucket, count(*) AS n, CASE WHEN count(*) >= 10 THEN round(quantile_cont(abs(predicted - actual), 0.8), 4) END AS q FROM won GROUP BY 1, 2) p
JOIN (SELECT experiment, round(quantile_cont(abs(predicted - actual), 0.8), 4) AS fallback, count(*) AS total FROM won GROUP BY 1) f USING (experiment)""", "won")
def _(spark, sf):
    return rnd(ag.conformal_quantiles(_rows(spark, sf)), q=4, fallback=4)


@query("AG9_signed_residuals", "SELECT experiment, lead_bucket, round(sum(actual - predicted), 2) AS total, count(*) AS n FROM won GROUP BY 1, 2", "won")
def _(spark, sf):
    return ag.signed_residuals(_rows(spark, sf)).groupBy(*E, "lead_bucket").agg(F.round(F.sum("residual"), 2).alias("total"), F.count(F.lit(1)).alias("n"))


cte("overall_win", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY n DESC, model_version DESC NULLS LAST, model_name) AS rn FROM
(SELECT experiment, model_name, model_version, count(*) AS n FROM scored GROUP BY 1, 2, 3)) WHERE rn = 1""", "scored")
cte("dominant", """SELECT s.*, CASE WHEN actual BETWEEN lower AND upper THEN 1.0 ELSE 0.0 END AS hit, hour(timezone('Australia/Sydney', timezone('UTC', target_dt))) AS h, isodow(timezone('Australia/Sydney', timezone('UTC', target_dt))) >= 6 AS we
FROM scored s JOIN overall_win w ON w.experiment = s.experiment AND w.model_name = s.model_name AND w.model_version IS NOT DISTINCT FROM s.model_version""", "scored overall_win")
cte("coverage_all", """SELECT experiment, 'lead' AS kind, CAST(lead_bucket AS VARCHAR) AS bucket, round(avg(CASE WHEN actual BETWEEN lower AND upper THEN 1.0 ELSE 0.0 END), 4) AS coverage, count(*) AS n FROM won GROUP BY 1, 3, lead_bucket
UNION ALL SELECT experiment, 'overall', 'all', round(avg(hit), 4), count(*) FROM dominant GROUP BY 1 UNION ALL SELECT experiment, 'hour', CAST(h AS VARCHAR), round(avg(hit), 4), count(*) FROM dominant GROUP BY 1, h
UNION ALL SELECT experiment, 'part', CASE WHEN we THEN 'weekend' ELSE 'weekday' END, round(avg(hit), 4), count(*) FROM dominant GROUP BY 1, we""", "won dominant")


@query("AG10_coverage_by", "SELECT * FROM coverage_all", "coverage_all")
def _(spark, sf):
    return rnd(ag.coverage(_rows(spark, sf), "Australia/Sydney"), coverage=4)


@query("AG11_worst_bucket", """SELECT experiment, kind, bucket, coverage, n FROM (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY round(abs(coverage - 0.8), 6) DESC, kind DESC, bucket DESC) AS r FROM coverage_all WHERE kind <> 'overall' AND n >= 20) WHERE r = 1""", "coverage_all")
def _(spark, sf):
    return rnd(ag.worst_bucket(ag.coverage(_rows(spark, sf), "Australia/Sydney")), coverage=4)


cte("stab_all", """SELECT experiment, target_dt, model_name, model_version, avg(predicted) AS mean, sqrt(greatest(avg(predicted * predicted) - avg(predicted) * avg(predicted), 0)) AS std, count(DISTINCT issued_at) AS n_cycles FROM forecast_log GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT issued_at) >= 2""", "forecast_log")
CV = "CASE WHEN abs(mean) < 1e-9 AND std < 1e-9 THEN 0 WHEN abs(mean) >= 1e-9 THEN round(100 * std / abs(mean), 2) END"


@query("AG12_stability", f"""SELECT experiment, target_dt, round(mean, 4) AS mean, round(std, 4) AS std, n_cycles, {CV} AS cv_pct FROM (SELECT *, row_number() OVER (PARTITION BY experiment, target_dt ORDER BY n_cycles DESC, model_version DESC NULLS LAST, model_name) AS rn FROM stab_all) WHERE rn = 1 AND {CV} IS NOT NULL""", "stab_all")
def _(spark, sf):
    return rnd(ag.stability(i.forecast_log(spark, sf)), mean=4, std=4, cv_pct=2)


cte("stab_daily", """SELECT experiment, day, mean_total, sqrt(greatest(sq - mean_total * mean_total, 0)) AS std, n_cycles, mb AS max_bins FROM (SELECT *, row_number() OVER (PARTITION BY experiment, day ORDER BY n_cycles DESC, model_version DESC NULLS LAST, model_name) AS rn FROM
(SELECT experiment, day, model_name, model_version, avg(daily_total) AS mean_total, avg(daily_total * daily_total) AS sq, count(DISTINCT issued_at) AS n_cycles, max(n_bins) AS mb FROM full_days GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT issued_at) >= 2)) WHERE rn = 1""", "full_days")
DCV = "CASE WHEN abs(mean_total) > 1e-9 THEN round(100 * std / abs(mean_total), 2) ELSE 0 END"


@query("AG13_stability_daily", f"""SELECT s.experiment, day, round(mean_total, 3) AS mean_total, round(std, 3) AS std, n_cycles, max_bins, {DCV} AS cv_pct, m.median_cv FROM stab_daily s
JOIN (SELECT experiment, round(median({DCV}), 2) AS median_cv FROM stab_daily GROUP BY 1) m USING (experiment)""", "stab_daily")
def _(spark, sf):
    d = ag.stability_daily(i.forecast_log(spark, sf))
    med = ag.median_cv(d).select(*E, "median_cv")
    return rnd(d.join(med, E), mean_total=3, std=3, cv_pct=2, median_cv=2)


@query("AG14_stability_cohorts", f"SELECT experiment, target_dt, model_name, model_version, round(mean, 4) AS mean, round(std, 4) AS std, n_cycles, {CV} AS cv_pct FROM stab_all WHERE {CV} IS NOT NULL", "stab_all")
def _(spark, sf):
    return rnd(ag.stability_cohorts(i.forecast_log(spark, sf)), mean=4, std=4, cv_pct=2)


@query("AG15_retrain_events", "SELECT experiment, model_name, model_version, min(issued_at) AS first_seen, count(*) AS n FROM forecast_log WHERE model_version IS NOT NULL GROUP BY 1, 2, 3", "forecast_log")
def _(spark, sf):
    return ag.retrain_events(i.forecast_log(spark, sf))


@query("AG16_evolution", """SELECT l.experiment, model_name, model_version, l.issued_at, target_dt, predicted, value AS actual FROM (SELECT *, dense_rank() OVER (PARTITION BY experiment ORDER BY issued_at DESC) AS r FROM forecast_log) l
LEFT JOIN actuals a ON a.experiment = l.experiment AND a.grid_ts = l.target_dt WHERE r <= 12""", "forecast_log actuals")
def _(spark, sf):
    return ag.evolution(i.forecast_log(spark, sf), i.actuals(spark, sf))


cte("traj_targets", """SELECT experiment, target_dt, n_issuances, max_abs_error, actual FROM (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY target_dt DESC) AS r FROM
(SELECT experiment, target_dt, count(DISTINCT issued_at) AS n_issuances, max(abs(predicted - actual)) AS max_abs_error, max(actual) AS actual FROM scored GROUP BY 1, 2 HAVING count(DISTINCT issued_at) >= 2)) WHERE r <= 48""", "scored")


@query("AG17_trajectory", "SELECT * FROM traj_targets", "traj_targets")
def _(spark, sf):
    return ag.trajectory_targets(_rows(spark, sf))


@query("AG17_trajectory_rows", """SELECT l.experiment, model_name, model_version, l.target_dt, issued_at, lead_minutes, predicted FROM forecast_log l JOIN (SELECT experiment, max(target_dt) AS target_dt FROM traj_targets GROUP BY 1) t
ON t.experiment = l.experiment AND t.target_dt = l.target_dt""", "forecast_log traj_targets")
def _(spark, sf):
    t = ag.trajectory_targets(_rows(spark, sf), 1)
    return ag.trajectory(i.forecast_log(spark, sf), t)


cte("app_bins", "SELECT experiment, target_dt AS grid_ts, arg_max(predicted, issued_at) AS predicted FROM forecast_log WHERE model_name = 'seasonal_naive' GROUP BY 1, 2", "forecast_log")
cte("ext_bins", "SELECT experiment, source, target_dt AS grid_ts, arg_max(value, issued_at) AS value, arg_max(lead_minutes, issued_at) AS lead_minutes FROM external_log GROUP BY 1, 2, 3", "external_log")
cte("three", "SELECT experiment, source, grid_ts, x.value, p.predicted, a.value AS actual FROM ext_bins x JOIN app_bins p USING (experiment, grid_ts) JOIN actuals a USING (experiment, grid_ts)", "ext_bins app_bins actuals")
cte("h2h", """SELECT *, CASE WHEN app_mae < ext_mae THEN 'app' WHEN ext_mae < app_mae THEN 'external' ELSE 'tie' END AS winner, round(CASE WHEN ext_mae > 0 THEN (ext_mae - app_mae) / ext_mae * 100 END, 4) AS improvement_pct,
CASE WHEN ma > 1e-9 AND mx > 1e-9 THEN round(mx / ma, 2) END AS scale_ratio, coalesce(CASE WHEN ma > 1e-9 AND mx > 1e-9 THEN round(mx / ma, 2) > 4 OR round(mx / ma, 2) < 0.25 END, false) AS scale_mismatch FROM
(SELECT experiment, source, count(*) AS n, round(avg(abs(predicted - actual)), 4) AS app_mae, round(sqrt(avg((predicted - actual) ** 2)), 4) AS app_rmse, round(avg(predicted - actual), 4) AS app_bias, round(avg(abs(value - actual)), 4) AS ext_mae,
round(sqrt(avg((value - actual) ** 2)), 4) AS ext_rmse, round(avg(value - actual), 4) AS ext_bias, avg(abs(actual)) AS ma, avg(abs(value)) AS mx FROM three GROUP BY 1, 2)""", "three")


def _app(spark, sf):
    return i.forecast_log(spark, sf).filter("model_name = 'seasonal_naive'")


def _h2h(spark, sf):
    return ag.head_to_head(_app(spark, sf), i.external_log(spark, sf), i.actuals(spark, sf))


@query("AG18_head_to_head", "SELECT experiment, source, n, app_mae, app_rmse, app_bias, ext_mae, ext_rmse, ext_bias, winner, improvement_pct FROM h2h", "h2h")
def _(spark, sf):
    d = _h2h(spark, sf).drop("mean_actual", "mean_ext", "app_pct", "scale_ratio", "scale_mismatch")
    return rnd(d, **{c: 4 for c in ("app_mae", "app_rmse", "app_bias", "ext_mae", "ext_rmse", "ext_bias", "improvement_pct")})


@query("AG19_standalone_metrics", """SELECT experiment, source, round(avg(abs(x.value - a.value)), 4) AS mae, round(sqrt(avg((x.value - a.value) ** 2)), 4) AS rmse, round(avg(x.value - a.value), 4) AS me, count(*) AS n,
count(DISTINCT CAST(grid_ts AS DATE)) AS days_logged, count(DISTINCT CAST(grid_ts AS DATE)) < 7 AS warming FROM ext_bins x JOIN actuals a USING (experiment, grid_ts) GROUP BY 1, 2""", "ext_bins actuals")
def _(spark, sf):
    return rnd(ag.standalone_metrics(i.external_log(spark, sf), i.actuals(spark, sf)), mae=4, rmse=4, me=4)


@query("AG20_daily_total_error", """SELECT experiment, source, round(avg(abs(da)), 4) AS app_mae, round(avg(da), 4) AS app_bias, round(avg(abs(dx)), 4) AS ext_mae, round(avg(dx), 4) AS ext_bias, count(*) AS days FROM
(SELECT experiment, source, CAST(grid_ts AS DATE) AS d, sum(predicted) - sum(actual) AS da, sum(value) - sum(actual) AS dx FROM three GROUP BY 1, 2, 3) GROUP BY 1, 2""", "three")
def _(spark, sf):
    d = ag.daily_total_error(_app(spark, sf), i.external_log(spark, sf), i.actuals(spark, sf))
    return rnd(d, app_mae=4, app_bias=4, ext_mae=4, ext_bias=4)


@query("AG21_scale_mismatch", "SELECT experiment, source, scale_ratio, scale_mismatch FROM h2h", "h2h")
def _(spark, sf):
    return _h2h(spark, sf).select(*E, "source", "scale_ratio", "scale_mismatch")


cte("sums", """SELECT experiment, source, (lead_minutes // 720) * 720 AS lead_bucket, sum(abs(e.value - a.value)) AS abs_sum, sum((e.value - a.value) ** 2) AS sq_sum, sum(e.value - a.value) AS signed_sum, count(*) AS n
FROM external_log e JOIN actuals a USING (experiment) WHERE a.grid_ts = e.target_dt GROUP BY 1, 2, 3""", "external_log actuals")


def _sums(spark, sf):
    e, a = i.external_log(spark, sf), i.actuals(spark, sf)
    early = F.col("issued_at") < F.lit("2024-01-15").cast("timestamp_ntz")
    return ag.merge_sums([ag.lead_sums(e.filter(early), a, 720), ag.lead_sums(e.filter(~early), a, 720)])


@query("AG22_leadcurve_sums", "SELECT * FROM sums", "sums")
def _(spark, sf):
    return _sums(spark, sf)


@query("AG22_leadcurve_cumulative", """SELECT experiment, source, (lead_minutes // 720) * 720 AS lead_bucket, sum(abs(d - a.value)) AS abs_sum, sum((d - a.value) ** 2) AS sq_sum, sum(d - a.value) AS signed_sum, count(*) AS n FROM
(SELECT experiment, source, target_dt, lead_minutes, value - lag(value) OVER (PARTITION BY experiment, source, issued_at ORDER BY target_dt) AS d FROM external_log) e JOIN actuals a USING (experiment) WHERE a.grid_ts = e.target_dt AND d >= 0 GROUP BY 1, 2, 3""", "external_log actuals")
def _(spark, sf):
    return ag.lead_sums(i.external_log(spark, sf), i.actuals(spark, sf), 720, cumulative=True)


@query("AG23_skill_common_band", """WITH r AS (SELECT experiment, source FROM h2h WHERE NOT scale_mismatch), e AS (SELECT s.* FROM sums s JOIN r USING (experiment, source)),
b AS (SELECT experiment, lead_bucket FROM e GROUP BY 1, 2 HAVING count(DISTINCT source) = (SELECT count(DISTINCT source) FROM e x WHERE x.experiment = e.experiment))
SELECT experiment, source, round(sum(abs_sum) / sum(n), 4) AS mae, round(sqrt(sum(sq_sum) / sum(n)), 4) AS rmse, round(sum(signed_sum) / sum(n), 4) AS bias, CAST(sum(n) AS BIGINT) AS n, min(lead_bucket) AS band_from, max(lead_bucket) AS band_to
FROM e JOIN b USING (experiment, lead_bucket) GROUP BY 1, 2""", "h2h sums")
def _(spark, sf):
    s = cut_lineage(_sums(spark, sf))
    d = ag.skill_common_band(s, ag.exclusion_reasons(_h2h(spark, sf), s))
    return rnd(d, mae=4, rmse=4, bias=4)


@query("AG24_overlay", """WITH k AS (SELECT experiment, grid_ts FROM actuals UNION SELECT experiment, grid_ts FROM app_bins UNION SELECT experiment, grid_ts FROM ext_bins)
SELECT k.experiment, k.grid_ts, last_value(a.value IGNORE NULLS) OVER (PARTITION BY k.experiment ORDER BY k.grid_ts ROWS UNBOUNDED PRECEDING) AS actual, p.predicted AS app, xa.value AS ext_a, xb.value AS ext_b FROM k
LEFT JOIN actuals a ON a.experiment = k.experiment AND a.grid_ts = k.grid_ts LEFT JOIN app_bins p ON p.experiment = k.experiment AND p.grid_ts = k.grid_ts
LEFT JOIN ext_bins xa ON xa.experiment = k.experiment AND xa.grid_ts = k.grid_ts AND xa.source = 'ext_a' LEFT JOIN ext_bins xb ON xb.experiment = k.experiment AND xb.grid_ts = k.grid_ts AND xb.source = 'ext_b'
WHERE k.grid_ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-02-05'""", "actuals app_bins ext_bins")
def _(spark, sf):
    return ag.overlay(_app(spark, sf), i.external_log(spark, sf), i.actuals(spark, sf), ["ext_a", "ext_b"], "2024-01-10", "2024-02-05")


@query("AG25_timing", """SELECT x.experiment, x.source, median(lead_minutes) AS median_lead, count(*) AS ext_points, g.update_minutes, coalesce(p.n, 0) AS app_points, coalesce(p.n, 0) > 0 AND count(*) < 0.5 * coalesce(p.n, 0) AS stale FROM ext_bins x
JOIN (SELECT experiment, source, median(gap) AS update_minutes FROM (SELECT experiment, source, (epoch(issued_at) - epoch(lag(issued_at) OVER (PARTITION BY experiment, source ORDER BY issued_at))) / 60 AS gap FROM (SELECT DISTINCT experiment, source, issued_at FROM external_log)) GROUP BY 1, 2) g
ON g.experiment = x.experiment AND g.source = x.source LEFT JOIN (SELECT experiment, count(*) AS n FROM app_bins GROUP BY 1) p ON p.experiment = x.experiment GROUP BY 1, 2, g.update_minutes, p.n""", "ext_bins external_log app_bins")
def _(spark, sf):
    return ag.timing(_app(spark, sf), i.external_log(spark, sf))


cte("slots", "SELECT series_id, grid_ts, y, hour(grid_ts) // 6 AS slot, CASE WHEN isodow(grid_ts) >= 6 THEN 1 ELSE 0 END AS weekend FROM load6", "load6")
cte("profile", """SELECT c.series_id, c.slot, c.weekend, coalesce(d.mean, b.mean, a.mean) AS mean, coalesce(d.q50, b.q50, a.q50) AS q50, coalesce(d.q90, b.q90, a.q90) AS q90, CASE WHEN d.mean IS NOT NULL THEN 2 WHEN b.mean IS NOT NULL THEN 1 ELSE 0 END AS level FROM
(SELECT DISTINCT series_id, s.slot, w.weekend FROM slots, (VALUES (0), (1), (2), (3)) AS s(slot), (VALUES (0), (1)) AS w(weekend)) c
LEFT JOIN (SELECT series_id, avg(y) AS mean, median(y) AS q50, quantile_cont(y, 0.9) AS q90 FROM fslots GROUP BY 1) a ON a.series_id = c.series_id
LEFT JOIN (SELECT series_id, slot, avg(y) AS mean, median(y) AS q50, quantile_cont(y, 0.9) AS q90 FROM fslots GROUP BY 1, 2) b ON b.series_id = c.series_id AND b.slot = c.slot
LEFT JOIN (SELECT series_id, slot, weekend, avg(y) AS mean, median(y) AS q50, quantile_cont(y, 0.9) AS q90 FROM fslots GROUP BY 1, 2, 3) d ON d.series_id = c.series_id AND d.slot = c.slot AND d.weekend = c.weekend""", "slots fslots")
cte("fslots", "SELECT * FROM slots", "slots")


@query("AG26_seasonal_profile", "SELECT series_id, slot, weekend, round(mean, 4) AS mean, round(q50, 4) AS q50, round(q90, 4) AS q90, level FROM profile", "profile")
def _(spark, sf):
    return rnd(ag.seasonal_profile(i.load6(spark, sf), ["series_id"], i.SIX, quantiles={"q50": 0.5, "q90": 0.9}), mean=4, q50=4, q90=4)


@query("AG27_calibration_status", "SELECT experiment, count(*) AS have, 100 AS need, count(*) >= 100 AS ready, greatest(0, (100 - count(*)) / 32.0) AS eta_days FROM scored GROUP BY 1", "scored")
def _(spark, sf):
    return ag.calibration_status(_rows(spark, sf), 0.9, 32.0)


@query("AG28_median_step", "SELECT series_id, round(median(gap), 4) AS median_step, round(quantile_cont(gap, 0.9), 4) AS p90_gap FROM fleet_gaps GROUP BY 1", "fleet_gaps")
def _(spark, sf):
    return rnd(jn.gap_stats(i.obs_fleet(spark, sf), ["series_id"]), median_step=4, p90_gap=4)


@query("AG29_first_lead", f"SELECT experiment, lead_bucket, round(avg(abs(predicted - actual)), 4) AS headline_mae FROM scored WHERE lead_bucket = 0 GROUP BY 1, 2", "scored")
def _(spark, sf):
    return rnd(ag.first_lead(ag.lead_curves(_rows(spark, sf))), headline_mae=4)
