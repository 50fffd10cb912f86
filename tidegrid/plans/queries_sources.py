"""Records, tables, logs, predicates, transforms and set operations over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.functions import predicates as pf
from tidegrid.functions.timecols import shift
from tidegrid.operators import sets as so
from tidegrid.operators import transform as tr
from tidegrid.plans import inputs as i
from tidegrid.plans.registry import cte, query
from tidegrid.session import table
from tidegrid.sources import logs, records, tables

K = ["series_id"]
E_ = ["experiment"]


def rnd(df, **places):
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


# ---- records -------------------------------------------------------------------------------
# Event rows written as raw sensor records: state words, four time notations, one attribute.
cte("records", """SELECT event_type AS series_id, event_id, ts AS true_ts, CASE event_id % 12 WHEN 0 THEN ' ON ' WHEN 1 THEN 'closed'
WHEN 2 THEN 'unavailable' WHEN 3 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS state, value, props,
CASE event_id % 12 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE value END AS num,
CASE event_id % 4 WHEN 2 THEN ts - INTERVAL '1 hour' WHEN 3 THEN ts - INTERVAL '90 minutes' ELSE ts END AS utc FROM events""")


def _records(spark, sf):
    e = table(spark, sf, "events")
    k = F.col("event_id")
    state = F.when(k % 12 == 0, " ON ").when(k % 12 == 1, "closed").when(k % 12 == 2, "unavailable").when(
        k % 12 == 3, "n/a").otherwise(F.col("value").cast("string"))
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    suffix = F.when(k % 4 == 0, "Z").when(k % 4 == 1, "").when(k % 4 == 2, "+01:00").otherwise("+0130")
    when = F.when(k % 101 == 0, F.lit("yesterday")).otherwise(F.concat(text, suffix))
    attrs = F.when(k % 7 != 0, F.create_map(F.lit("k"), F.get_json_object("props", "$.k")))
    return e.select(F.col("event_type").alias("series_id"), "event_id", state.alias("state"), when.alias("last_changed"), attrs.alias("attributes"))


@query("IO1_normalise_history", "SELECT series_id, utc AS ts, num AS value FROM records WHERE num IS NOT NULL AND event_id % 101 <> 0", "records")
def _(spark, sf):
    return records.normalise_history(_records(spark, sf))


@query("IO2_state_to_float", "SELECT event_id, num AS value FROM records", "records")
def _(spark, sf):
    return _records(spark, sf).select("event_id", records.state_to_float("state").alias("value"))


@query("IO3_parse_timestamp", "SELECT event_id, CASE WHEN event_id % 101 <> 0 THEN utc END AS ts FROM records", "records")
def _(spark, sf):
    return _records(spark, sf).select("event_id", records.parse_timestamp("last_changed").alias("ts"))


@query("IO4_attribute_history", """SELECT series_id, utc AS ts, CASE WHEN event_id % 7 <> 0 THEN CAST(props ->> '$.k' AS DOUBLE) END AS value
FROM records WHERE event_id % 101 <> 0""", "records")
def _(spark, sf):
    return records.normalise_history(_records(spark, sf), attribute_key="k")


def _trajectories(spark, sf):
    log = i.forecast_log(spark, sf)
    text = F.date_format("target_dt", "yyyy-MM-dd'T'HH:mm:ss")
    v = F.when(F.col("lead_minutes") == 720, F.lit("n/a")).otherwise(F.col("predicted").cast("string"))
    entry = F.struct(text.alias("period_start"), v.alias("pv_estimate"))
    grouped = log.groupBy("experiment", "model_name", "issued_at")
    as_list = grouped.agg(F.to_json(F.collect_list(entry)).alias("attr"))
    as_map = grouped.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(text, v)))).alias("attr"))
    odd = F.col("experiment").cast("long") % 2 == 1
    return as_list.filter(odd).unionByName(as_map.filter(~odd))


@query("IO5_parse_trajectory", """SELECT experiment, model_name, issued_at, target_dt AS ts, predicted AS value FROM forecast_log
WHERE lead_minutes <> 720""", "forecast_log")
def _(spark, sf):
    return records.trajectory_points(_trajectories(spark, sf), "attr").drop("pos")


@query("IO6_points_utc", """SELECT experiment, source, target_dt AS ts, arg_min(value, issued_at) AS value FROM external_log
GROUP BY 1, 2, 3""", "external_log")
def _(spark, sf):
    pts = i.external_log(spark, sf).select("experiment", "source", F.col("target_dt").alias("ts"), "value", F.col("issued_at").alias("pos"))
    return records.points_utc(pts, [*E_, "source"])


# ---- tables --------------------------------------------------------------------------------
# Stored: readings before the 20th. New: readings from the 15th on, in two versions.
cte("stored", "SELECT series_id, ts, value FROM fleet WHERE ts < TIMESTAMP '2024-01-20'", "fleet")


def _stored(spark, sf):
    return i.obs_fleet(spark, sf).filter("ts < timestamp_ntz'2024-01-20'").select("series_id", "ts", "value")


def _new(spark, sf):
    d = i.obs_fleet(spark, sf).filter("ts >= timestamp_ntz'2024-01-15'").withColumn("version", F.explode(F.sequence(F.lit(1), F.lit(2))))
    return d.select("series_id", "ts", (F.col("value") * 10 + F.col("version")).alias("value"), "version")


@query("IO7_append_ignore", "SELECT series_id, ts, value * 10 + 1 AS value FROM fleet WHERE ts >= TIMESTAMP '2024-01-20'", "fleet")
def _(spark, sf):
    return tables.append_ignore(_stored(spark, sf), _new(spark, sf))


@query("IO8_upsert", "SELECT series_id, ts, CASE WHEN ts >= TIMESTAMP '2024-01-15' THEN value * 10 + 2 ELSE value END AS value FROM fleet", "fleet")
def _(spark, sf):
    return tables.upsert(_stored(spark, sf), _new(spark, sf))


@query("IO9_merge_keep_last", "SELECT series_id, ts, CASE WHEN ts >= TIMESTAMP '2024-01-15' THEN value * 10 + 1 ELSE value END AS value FROM fleet", "fleet")
def _(spark, sf):
    return tables.merge_keep_last(_stored(spark, sf), _new(spark, sf).filter("version = 1"))


@query("IO10_incremental_read", """WITH m AS (SELECT series_id, min(ts) AS lo, max(ts) AS hi FROM stored WHERE CAST(series_id AS BIGINT) % 3 > 0
AND ts >= TIMESTAMP '2024-01-02' - INTERVAL '1 day' * (CAST(series_id AS BIGINT) % 3 - 1) GROUP BY 1)
SELECT f.series_id, f.ts, f.value, NOT coalesce(lo <= TIMESTAMP '2024-01-02 06:00:00', false) AS backfill FROM fleet f LEFT JOIN m USING (series_id)
WHERE f.ts >= TIMESTAMP '2024-01-02' AND (NOT coalesce(lo <= TIMESTAMP '2024-01-02 06:00:00', false) OR f.ts > hi)""", "fleet stored")
def _(spark, sf):
    uid = F.col("series_id").cast("long")
    cached = _stored(spark, sf).filter(uid % 3 > 0).filter(
        F.col("ts") >= F.lit("2024-01-02").cast("timestamp_ntz") - F.make_dt_interval((uid % 3 - 1).cast("int")))
    return tables.incremental_read(i.obs_fleet(spark, sf).drop("event_id"), cached, "2024-01-02", i.SIX)


@query("IO11_retention", """SELECT f.series_id, f.ts, f.value FROM fleet f LEFT JOIN (SELECT series_id, max(days) AS days FROM
(SELECT DISTINCT series_id, CAST(series_id AS BIGINT) % 10 AS days FROM fleet UNION ALL SELECT DISTINCT series_id, 12 FROM fleet
WHERE CAST(series_id AS BIGINT) % 4 = 0) WHERE CAST(series_id AS BIGINT) % 7 > 0 GROUP BY 1) k USING (series_id)
WHERE f.ts >= TIMESTAMP '2024-02-01' - INTERVAL '1 day' * coalesce(days, 20)""", "fleet")
def _(spark, sf):
    d = i.obs_fleet(spark, sf).drop("event_id")
    uid = F.col("series_id").cast("long")
    ids = d.select("series_id").distinct()
    users = ids.withColumn("days", uid % 10).unionByName(ids.filter(uid % 4 == 0).withColumn("days", F.lit(12).cast("long"))).filter(uid % 7 > 0)
    return tables.retention(d, users, "2024-02-01", default_days=20)


# ---- logs ----------------------------------------------------------------------------------
@query("IO12_log_forecast", """SELECT experiment, model_name, issued_at, target_dt, lead_minutes, predicted,
CASE WHEN lead_minutes = 720 THEN NULL ELSE upper END AS upper, lower FROM forecast_log WHERE lead_minutes NOT IN (360, 1080)""", "forecast_log")
def _(spark, sf):
    k = F.col("lead_minutes")
    d = i.forecast_log(spark, sf).withColumns({
        "predicted": F.when(k == 360, F.lit(float("nan"))).when(k == 1080, F.lit(1e13)).otherwise(F.col("predicted")),
        "upper": F.when(k == 720, F.lit(float("inf"))).otherwise(F.col("upper"))}).drop("lead_minutes")
    return logs.log_forecast(d).select("experiment", "model_name", "issued_at", "target_dt", "lead_minutes", "predicted", "upper", "lower")


@query("IO13_log_prune", """SELECT experiment, model_name, model_version, issued_at, target_dt FROM forecast_log WHERE
NOT (issued_at < TIMESTAMP '2024-01-10' AND NOT (model_name = 'last_value' AND model_version IS NULL))""", "forecast_log")
def _(spark, sf):
    log = i.forecast_log(spark, sf)
    keep = log.filter("model_name = 'last_value' and model_version is null").select("model_name", "model_version").distinct()
    return logs.log_prune(log, "2024-01-10", exclude=keep).select("experiment", "model_name", "model_version", "issued_at", "target_dt")


@query("IO14_log_external", """SELECT experiment, source, issued_at, target_dt, lead_minutes, value FROM external_log
WHERE lead_minutes <> 360""", "external_log")
def _(spark, sf):
    d = i.external_log(spark, sf).drop("lead_minutes")
    near = F.col("target_dt") == shift("issued_at", i.SIX)
    d = d.withColumn("value", F.when(near & (F.col("source") == "ext_a"), "n/a").when(near, "Infinity").otherwise(F.col("value").cast("string")))
    return logs.log_external(d)


@query("IO15_run_history", """SELECT experiment, ran_at, result, run_rank FROM (SELECT series_id AS experiment, CAST(ts AS DATE) AS ran_at, arg_max(value, ts) AS result,
row_number() OVER (PARTITION BY series_id ORDER BY CAST(ts AS DATE) DESC) AS run_rank FROM fleet GROUP BY series_id, CAST(ts AS DATE)) WHERE run_rank <= 5""", "fleet")
def _(spark, sf):
    d = i.obs_fleet(spark, sf).select(F.col("series_id").alias("experiment"), F.to_date("ts").alias("ran_at"), F.col("value").alias("result"), F.col("ts").alias("version"))
    return logs.run_history(d)


def _points(column: str) -> str:
    entry = f"""'{{"datetime":"' || strftime(target_dt, '%Y-%m-%dT%H:%M:%S') || '","value":' || coalesce(CAST(round({column}, 4) AS VARCHAR), 'null') || '}}'"""
    return f"'[' || string_agg({entry}, ',' ORDER BY target_dt) || ']'"


cte("odd_log", """SELECT experiment, model_name, issued_at, target_dt, predicted, CASE WHEN lead_minutes = 720 THEN NULL ELSE upper END AS upper,
CASE WHEN lead_minutes = 360 THEN NULL ELSE lower END AS lower FROM forecast_log""", "forecast_log")


@query("IO16_publish_payload", f"""SELECT experiment, model_name, issued_at, count(*) AS n_points, {_points('predicted')} AS forecast, {_points('upper')} AS upper,
{_points('lower')} AS lower FROM odd_log GROUP BY 1, 2, 3""", "odd_log")
def _(spark, sf):
    # Null and non-finite bounds are both published as null.
    lead = F.col("lead_minutes")
    log = i.forecast_log(spark, sf).withColumns({
        "upper": F.when(lead != 720, F.col("upper")), "lower": F.when(lead == 360, F.lit(float("inf"))).otherwise(F.col("lower"))})
    return logs.publish_payload(log)


@query("IO17_log_stats", """SELECT s.*, m.multi_issue_targets FROM (SELECT experiment, model_name, model_version, count(*) AS n, min(issued_at) AS first_issued,
max(issued_at) AS last_issued, max(target_dt) AS last_target FROM forecast_log GROUP BY 1, 2, 3) s JOIN (SELECT experiment, count(*) AS multi_issue_targets
FROM (SELECT experiment, target_dt FROM forecast_log GROUP BY 1, 2 HAVING count(DISTINCT issued_at) >= 2) GROUP BY 1) m USING (experiment)""", "forecast_log")
def _(spark, sf):
    log = i.forecast_log(spark, sf)
    return logs.log_stats(log).join(logs.reforecast_targets(log), "experiment")


@query("IO18_cohort_probe", """SELECT experiment, n_version, n_model, n_all, CASE WHEN n_version > 0 THEN 'version' WHEN n_model > 0 THEN 'model'
WHEN n_all > 0 THEN 'all' ELSE 'none' END AS cohort FROM (SELECT experiment,
count(*) FILTER (WHERE w AND model_name = 'last_value' AND model_version = 'v1') AS n_version, count(*) FILTER (WHERE w AND model_name = 'last_value') AS n_model,
count(*) FILTER (WHERE w) AS n_all FROM (SELECT *, issued_at >= TIMESTAMP '2024-01-10' AND target_dt <= TIMESTAMP '2024-01-20' AS w FROM forecast_log) GROUP BY 1)""", "forecast_log")
def _(spark, sf):
    return logs.cohort_probe(i.forecast_log(spark, sf), "last_value", "v1", "2024-01-10", "2024-01-20")


# ---- predicates ----------------------------------------------------------------------------
@query("PF1_scale", "SELECT series_id, ts, value * (CASE WHEN series_id = 'click' THEN 1000 ELSE 1 END) AS value FROM obs", "obs")
def _(spark, sf):
    d = i.obs_type(spark, sf).withColumn("f", F.when(F.col("series_id") == "click", F.lit(1000.0)))
    return d.select("series_id", "ts", pf.scale("value", "f").alias("value"))


@query("PF2_power_to_energy", "SELECT series_id, grid_ts, y * 6 AS energy FROM load6", "load6")
def _(spark, sf):
    return i.load6(spark, sf).select("series_id", "grid_ts", pf.power_to_energy("y", 360).alias("energy"))


cte("units", """SELECT *, CASE WHEN unit IS NULL THEN 'unknown' WHEN lower(trim(unit)) IN ('w', 'kw') THEN 'power' WHEN lower(trim(unit)) IN ('wh', 'mwh') THEN 'energy'
ELSE 'other' END AS dim, CAST(CASE WHEN lower(trim(unit)) IN ('w', 'wh') THEN 0.001 WHEN lower(trim(unit)) = 'mwh' THEN 1000 ELSE 1 END AS DOUBLE) AS base FROM
(SELECT event_type AS series_id, ts, value, event_id, CASE event_type WHEN 'click' THEN ' W ' WHEN 'view' THEN 'kW' WHEN 'error' THEN 'MWh' WHEN 'purchase' THEN 'wh' WHEN 'signup' THEN 'L' END AS unit FROM events)""")


def _units(spark, sf):
    m = F.create_map(*[F.lit(x) for x in ("click", " W ", "view", "kW", "error", "MWh", "purchase", "wh", "signup", "L")])
    d = i.obs_type(spark, sf).withColumn("unit", F.try_element_at(m, F.col("series_id")))
    u = pf.unit_class("unit")
    return d.withColumn("dim", u["dim"]).withColumn("base", u["base"])


@query("PF3_unit_classify", "SELECT event_id, dim, base FROM units", "units")
def _(spark, sf):
    return _units(spark, sf).select("event_id", "dim", "base")


@query("PF4_to_canonical_energy", """SELECT series_id, ts, round(v * f, 9) AS energy, round(value / f, 6) AS native FROM (SELECT series_id, ts, value,
CASE WHEN series_id IN ('error', 'purchase') THEN CASE WHEN value - p >= 0 THEN value - p END ELSE value END AS v,
CASE dim WHEN 'power' THEN base * 0.5 WHEN 'energy' THEN base ELSE 1 END AS f FROM (SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY ts) AS p FROM units))""", "units")
def _(spark, sf):
    d = _units(spark, sf).withColumn("is_cumulative", F.col("series_id").isin("error", "purchase"))
    d = pf.to_canonical_energy(d, K, "value", "ts", 0.5)
    return d.select("series_id", "ts", F.round("energy", 9).alias("energy"), F.round(pf.from_canonical_energy("value", "dim", "base", 0.5), 6).alias("native"))


@query("PF5_unit_suspect", """SELECT experiment, source, round(ratio, 6) AS ratio, CASE WHEN ratio > 0 AND ratio < 1 AND abs(ln(ratio)) > ln(6) / 2 THEN 'power' END AS suspect FROM
(SELECT e.experiment, e.source, avg(abs(e.value) / CASE WHEN source = 'ext_b' THEN 6000 ELSE 1 END) / avg(abs(a.value)) AS ratio FROM external_log e
JOIN actuals a ON a.experiment = e.experiment AND a.grid_ts = e.target_dt GROUP BY 1, 2)""", "external_log actuals")
def _(spark, sf):
    a = i.actuals(spark, sf).withColumnRenamed("grid_ts", "target_dt").withColumnRenamed("value", "actual")
    e = i.external_log(spark, sf).withColumn("value", F.when(F.col("source") == "ext_b", F.col("value") / 6000).otherwise(F.col("value")))
    r = e.join(a, ["experiment", "target_dt"]).groupBy("experiment", "source").agg((F.avg(F.abs("value")) / F.avg(F.abs("actual"))).alias("ratio"))
    return r.withColumn("suspect", pf.unit_suspect(F.lit("energy"), "ratio", 6.0)).withColumn("ratio", F.round("ratio", 6))


@query("PF6_drop_corrupt", """SELECT experiment, count(*) FILTER (WHERE bad) AS dropped, max(CASE WHEN bad THEN abs(v) END) AS max_dropped, max(CASE WHEN bad THEN target_dt END) AS last_dropped,
count(*) FILTER (WHERE NOT bad) AS kept FROM (SELECT e.experiment, e.target_dt, e.value * CASE WHEN hour(e.target_dt) = 6 THEN 100 ELSE 1 END AS v,
abs(e.value * CASE WHEN hour(e.target_dt) = 6 THEN 100 ELSE 1 END) > l.lim AS bad FROM external_log e JOIN (SELECT experiment, least(10000 * max(abs(value)), 1e12) AS lim FROM actuals GROUP BY 1) l USING (experiment)) GROUP BY 1""",
       "external_log actuals")
def _(spark, sf):
    e = i.external_log(spark, sf).withColumn("value", F.col("value") * F.when(F.hour("target_dt") == 6, 100).otherwise(1))
    a = i.actuals(spark, sf)
    kept = pf.drop_corrupt(e, a, E_).groupBy(*E_).agg(F.count(F.lit(1)).alias("kept"))
    return pf.corrupt_report(e, a, E_, ts="target_dt").join(kept, E_)


@query("PF7_exclude_dates", """SELECT series_id, ts, value FROM fleet WHERE CAST(ts + INTERVAL '2 hours' AS DATE) NOT IN
(SELECT CAST(ts AS DATE) FROM fleet GROUP BY 1 HAVING day(CAST(ts AS DATE)) % 7 = 3)""", "fleet")
def _(spark, sf):
    d = i.obs_fleet(spark, sf).drop("event_id")
    days = d.select(F.to_date("ts").alias("day")).distinct().filter(F.dayofmonth("day") % 7 == 3)
    return pf.exclude_dates(d, days, offset_hours=2.0)


@query("PF8_window_floor", """SELECT experiment, model_name, issued_at, target_dt FROM forecast_log WHERE issued_at >= greatest(TIMESTAMP '2024-01-28' - INTERVAL '14 days',
TIMESTAMP '2024-01-16 12:00:00') AND target_dt <= TIMESTAMP '2024-01-28'""", "forecast_log")
def _(spark, sf):
    return pf.window_floor(i.forecast_log(spark, sf), "2024-01-28", 14, "2024-01-16 12:00:00").select("experiment", "model_name", "issued_at", "target_dt")


@query("PF9_binary_detect", """SELECT series_id, bool_and(v IN (0, 1)) AND count(v) >= 2 AS is_binary FROM (SELECT series_id, CASE WHEN CAST(series_id AS BIGINT) % 2 = 0
THEN event_id % 2 ELSE value END AS v FROM fleet) GROUP BY 1""", "fleet")
def _(spark, sf):
    d = i.obs_fleet(spark, sf).withColumn("value", F.when(F.col("series_id").cast("long") % 2 == 0, (F.col("event_id") % 2).cast("double")).otherwise(F.col("value")))
    return pf.binary_detect(d, K)


@query("PF10_looks_cumulative", """SELECT series_id, coalesce(avg(CASE WHEN p IS NOT NULL THEN CAST(value >= p AS DOUBLE) END) >= 0.8, false) AND count(*) >= 6 AS is_cumulative
FROM (SELECT series_id, value, lag(value) OVER (PARTITION BY series_id ORDER BY ts) AS p FROM (SELECT series_id, ts, value FROM fleet UNION ALL
SELECT series_id, ts, value FROM counter_daily)) GROUP BY 1""", "fleet counter_daily")
def _(spark, sf):
    d = i.obs_fleet(spark, sf).select("series_id", "ts", "value").unionByName(i.counter_daily(spark, sf))
    return pf.looks_cumulative(d, K)


@query("PF11_within_span", """SELECT g.experiment, g.grid_ts, g.value FROM actuals g JOIN (SELECT experiment, min(target_dt) AS a, max(target_dt) AS z FROM external_log
GROUP BY 1) s ON s.experiment = g.experiment AND g.grid_ts BETWEEN a AND z""", "actuals external_log")
def _(spark, sf):
    pts = i.external_log(spark, sf)
    return pf.within_span(i.actuals(spark, sf), pts, E_, point_ts="target_dt")


@query("PF13_null_guard", """SELECT 'y' AS column_name, count(*) - count(y) AS n_null, sum(coalesce(y, 0)) AS total FROM sparse6""", "sparse6")
def _(spark, sf):
    d = i.sparse6(spark, sf)
    guarded = pf.null_guard(d, ["y"]).select("y").unpivot([], ["y"], "column_name", "v")
    total = guarded.groupBy("column_name").agg(F.sum("v").alias("total"))
    return pf.null_report(d, ["y"]).join(total, "column_name")


@query("PF14_covariate_status", """SELECT event_id, CASE WHEN NOT (sn OR ap) AND NOT (coalesce(parsed, false) OR svc) THEN 'broken' WHEN NOT coalesce(parsed, true) AND NOT svc THEN 'partial'
WHEN NOT (sn OR ap) THEN 'partial' ELSE 'ok' END AS status FROM (SELECT event_id, num IS NOT NULL AS sn, event_id % 5 = 0 AS ap, event_id % 11 = 0 AS svc,
CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS parsed FROM records)""", "records")
def _(spark, sf):
    k = F.col("event_id")
    d = _records(spark, sf).select(
        "event_id", records.state_to_float("state").isNotNull().alias("state_numeric"), (k % 5 == 0).alias("attr_path_ok"),
        (k % 11 == 0).alias("service_future"), F.when(k % 3 == 1, True).when(k % 3 == 2, False).alias("attr_parsed"))
    return pf.covariate_status(d).select("event_id", "status")


@query("PF15_trained_schema_pin", """SELECT series_id, grid_ts, y, med AS cov_b, y * 2 AS cov_a FROM load6 JOIN (SELECT series_id, median(y) AS med FROM load6 GROUP BY 1) USING (series_id)""", "load6")
def _(spark, sf):
    from tidegrid.operators.quantiles import exact_quantiles

    d = i.load6(spark, sf).withColumn("cov_a", F.col("y") * 2)
    fills = exact_quantiles(d, K, "y", {"fill_cov_b": 0.5})
    return pf.trained_schema_pin(d, ["cov_b", "cov_a"], [*K], fills)


# ---- transforms ----------------------------------------------------------------------------
@query("TR1_clip_quantile", """SELECT l.series_id, l.grid_ts, round(greatest(least(y, hi), 0), 6) AS y FROM load6 l JOIN (SELECT series_id, quantile_cont(y, 0.95) AS hi FROM load6 GROUP BY 1) q USING (series_id)""", "load6")
def _(spark, sf):
    return rnd(tr.clip_quantile(i.load6(spark, sf), K, 0.95, positive_only=True), y=6)


@query("TR2_clip_mad", """WITH m AS (SELECT series_id, median(y) AS med FROM load6 GROUP BY 1), d AS (SELECT series_id, med, median(abs(y - med)) AS mad FROM load6 JOIN m USING (series_id) GROUP BY 1, 2)
SELECT l.series_id, l.grid_ts, round(CASE WHEN mad = 0 THEN y ELSE greatest(least(y, med + 3.5 * mad), med - 3.5 * mad) END, 6) AS y FROM load6 l JOIN d USING (series_id)""", "load6")
def _(spark, sf):
    return rnd(tr.clip_mad(i.load6(spark, sf), K), y=6)


@query("TR3_log_invert", """SELECT series_id, grid_ts, round(ln(x + s), 6) AS logged, round(x, 4) AS back FROM (SELECT *, CASE WHEN min(x) OVER (PARTITION BY series_id) >= 0 THEN 1
ELSE abs(min(x) OVER (PARTITION BY series_id)) + 1 END AS s FROM (SELECT series_id, grid_ts, y - CASE WHEN CAST(series_id AS BIGINT) % 2 = 0 THEN 500 ELSE 0 END AS x FROM load6))""", "load6")
def _(spark, sf):
    d = i.load6(spark, sf).withColumn("y", F.col("y") - F.when(F.col("series_id").cast("long") % 2 == 0, 500.0).otherwise(0.0))
    p = tr.log_shift(d, K)
    logged = d.join(p, K).withColumn("logged", F.ln(F.col("y") + F.col("shift")))
    return logged.select(*K, "grid_ts", F.round("logged", 6).alias("logged"), F.round(F.exp("logged") - F.col("shift"), 4).alias("back"))


@query("TR4_transform_invert", """SELECT series_id, grid_ts, round(ln(y + CASE WHEN lo > 0 THEN 0 WHEN lo = 0 THEN 1 ELSE abs(lo) + 1 END), 6) AS log_y, round(sqrt(y), 6) AS sqrt_y, round(y, 4) AS back
FROM (SELECT *, min(y) OVER (PARTITION BY series_id) AS lo FROM load6)""", "load6")
def _(spark, sf):
    d = i.load6(spark, sf)
    p = tr.fit_transform(d, K, "log")
    logged = tr.apply_transform(d, p, K)
    back = tr.invert_transform(logged, p, K).withColumnRenamed("y", "back")
    root = tr.apply_transform(d, tr.fit_transform(d, K, "sqrt"), K).withColumnRenamed("y", "sqrt_y")
    out = logged.withColumnRenamed("y", "log_y").join(root, [*K, "grid_ts"]).join(back, [*K, "grid_ts"])
    return rnd(out, log_y=6, sqrt_y=6, back=4)


@query("TR5_transform_record", """SELECT l.series_id, l.grid_ts, round(ln(greatest(y - 300 + s, least(1, lo + s))), 6) AS y FROM load6 l JOIN (SELECT series_id, min(y) AS lo,
CASE WHEN min(y) >= 0 THEN 1 ELSE abs(min(y)) + 1 END AS s FROM load6 WHERE grid_ts < TIMESTAMP '2024-01-20' GROUP BY 1) p USING (series_id) WHERE l.grid_ts >= TIMESTAMP '2024-01-20'""", "load6")
def _(spark, sf):
    d = i.load6(spark, sf)
    record = tr.fit_transform(d.filter("grid_ts < timestamp_ntz'2024-01-20'"), K, "shifted_log")
    future = d.filter("grid_ts >= timestamp_ntz'2024-01-20'").withColumn("y", F.col("y") - 300)
    return rnd(tr.future_on_model_scale(future, record, K, "y"), y=6)


cte("pred3", "SELECT series_id, grid_ts, y, lag(y) OVER (PARTITION BY series_id ORDER BY grid_ts) * 30 - 2000 AS pred FROM load6", "load6")


def _pred3(spark, sf):
    from tidegrid.operators.scan import previous

    return previous(i.load6(spark, sf), K, ["grid_ts"], "pred", F.col("y") * 30 - 2000)


@query("TR6_blowup_clamp", """SELECT series_id, grid_ts, coalesce(cap > 0 AND pred > cap, false) AS clamped, CASE WHEN cap > 0 AND pred > cap THEN cap ELSE pred END AS pred FROM pred3
JOIN (SELECT series_id, 10 * max(y) AS cap FROM load6 GROUP BY 1) USING (series_id)""", "pred3 load6")
def _(spark, sf):
    p = _pred3(spark, sf)
    return tr.blowup_clamp(p.drop("y"), i.load6(spark, sf), K).select(*K, "grid_ts", "clamped", "pred")


@query("TR7_nonneg_floor", "SELECT series_id, grid_ts, CASE WHEN pred IS NOT NULL THEN greatest(pred, 0) ELSE 0 END AS pred FROM pred3", "pred3")
def _(spark, sf):
    return tr.nonneg_floor(_pred3(spark, sf).drop("y"), i.load6(spark, sf), K).select(*K, "grid_ts", "pred")


@query("TR8_spikiness", """SELECT series_id, round(quantile_cont(y, 0.99) / (avg(abs(y)) + greatest(1e-9, 1e-3 * coalesce(median(abs(y)) FILTER (WHERE y <> 0), 0))), 6) AS spikiness FROM load6 GROUP BY 1""", "load6")
def _(spark, sf):
    return rnd(tr.spikiness(i.load6(spark, sf), K), spikiness=6)


cte("hourly_resid", """SELECT series_id, grid_ts, y, CASE WHEN count(y) OVER w >= 12 THEN y - avg(y) OVER w END AS resid FROM hourly
WINDOW w AS (PARTITION BY series_id ORDER BY grid_ts ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING)""", "hourly")


@query("TR9_daily_autocorr", """SELECT series_id, round(corr(resid, b), 6) AS daily_autocorr FROM (SELECT *, lag(resid, 24) OVER (PARTITION BY series_id ORDER BY grid_ts) AS b FROM hourly_resid) GROUP BY 1""", "hourly_resid")
def _(spark, sf):
    return rnd(tr.daily_autocorr(i.hourly(spark, sf), K, 3600), daily_autocorr=6)


@query("TR10_level_scale", """SELECT series_id, round(CASE WHEN sum(pred) > 0 AND sum(y) > 0 THEN greatest(least(sum(y) / sum(pred), 2), 0.5) ELSE 1 END, 6) AS level_scale FROM pred3 WHERE pred IS NOT NULL GROUP BY 1""", "pred3")
def _(spark, sf):
    return rnd(tr.level_scale(_pred3(spark, sf).filter("pred is not null"), K, fitted="pred"), level_scale=6)


@query("TR11_recency_weight", """SELECT series_id, grid_ts, round(w * count(*) OVER (PARTITION BY series_id) / sum(w) OVER (PARTITION BY series_id), 6) AS weight FROM (SELECT *,
exp(ln(2) / 28 * row_number() OVER (PARTITION BY series_id ORDER BY grid_ts)) AS w FROM load6)""", "load6")
def _(spark, sf):
    return rnd(tr.recency_weight(i.load6(spark, sf), K, 28).select(*K, "grid_ts", "weight"), weight=6)


@query("TR12_ma_decompose", """SELECT series_id, grid_ts, round(avg(y) OVER w, 6) AS trend, round(y - avg(y) OVER w, 6) AS remainder FROM load6
WINDOW w AS (PARTITION BY series_id ORDER BY grid_ts ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)""", "load6")
def _(spark, sf):
    return rnd(tr.ma_decompose(i.load6(spark, sf), K, i.SIX).drop("y"), trend=6, remainder=6)


@query("TR13_psi_drift", """WITH a AS (SELECT series_id, y FROM load6 WHERE grid_ts < TIMESTAMP '2024-01-15'), b AS (SELECT series_id, y FROM load6 WHERE grid_ts >= TIMESTAMP '2024-01-22'),
q AS (SELECT series_id, count(*) AS train_n, list_sort(list_distinct(quantile_cont(y, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e, quantile_cont(y, 0.1) AS train_p10, quantile_cont(y, 0.9) AS train_p90,
avg(y) AS train_mean, stddev_pop(y) AS train_std FROM a GROUP BY 1),
t AS (SELECT series_id, count(*) AS test_n, quantile_cont(y, 0.1) AS test_p10, quantile_cont(y, 0.9) AS test_p90, avg(y) AS test_mean, stddev_pop(y) AS test_std FROM b GROUP BY 1),
v AS (SELECT series_id, y, 1 AS isa FROM a UNION ALL SELECT series_id, y, 0 FROM b),
c AS (SELECT v.series_id, least(len(list_filter(e, lambda x: x <= y)), len(e) - 1) AS slot, sum(isa) AS na, sum(1 - isa) AS nb FROM v JOIN q USING (series_id) WHERE y BETWEEN e[1] AND e[-1] GROUP BY 1, 2),
f AS (SELECT s.series_id, s.slot, coalesce(na, 0) AS na, coalesce(nb, 0) AS nb FROM (SELECT series_id, unnest(generate_series(1, len(e) - 1)) AS slot FROM q WHERE len(e) >= 3) s LEFT JOIN c ON c.series_id = s.series_id AND c.slot = s.slot),
p AS (SELECT series_id, greatest(na / greatest(sum(na) OVER (PARTITION BY series_id), 1), 1e-4) AS pa, greatest(nb / greatest(sum(nb) OVER (PARTITION BY series_id), 1), 1e-4) AS pb FROM f),
z AS (SELECT series_id, sum((pb - pa) * ln(pb / pa)) AS psi FROM p GROUP BY 1)
SELECT series_id, coalesce(train_n, 0) AS train_n, coalesce(test_n, 0) AS test_n, round(train_p10, 4) AS train_p10, round(train_p90, 4) AS train_p90, round(test_p10, 4) AS test_p10, round(test_p90, 4) AS test_p90, round(train_mean, 4) AS train_mean, round(train_std, 4) AS train_std,
round(test_mean, 4) AS test_mean, round(test_std, 4) AS test_std, CASE WHEN train_n >= 20 AND test_n >= 5 THEN round(coalesce(psi, 0), 4) END AS psi, CASE WHEN NOT coalesce(train_n >= 20 AND test_n >= 5, false) THEN 'insufficient'
WHEN coalesce(psi, 0) < 0.1 THEN 'stable' WHEN psi < 0.2 THEN 'moderate shift' ELSE 'significant shift' END AS verdict
FROM q FULL JOIN t USING (series_id) LEFT JOIN z USING (series_id)""", "load6")
def _(spark, sf):
    d = i.load6(spark, sf)
    out = tr.psi_drift(d.filter("grid_ts < timestamp_ntz'2024-01-15'"), d.filter("grid_ts >= timestamp_ntz'2024-01-22'"), K)
    return rnd(out, **{c: 4 for c in out.columns if c not in ("series_id", "train_n", "test_n", "verdict")})


cte("spiky", "SELECT series_id, ts, CASE WHEN event_id % 5 = 0 THEN 0 ELSE value END AS value FROM fleet WHERE event_id % 19 <> 0", "fleet")
i.grid_ctes("spiky6", "spiky", "6 hours", "avg(value)")
cte("spiky_shape", """SELECT series_id, CASE WHEN count(y) >= 2 THEN quantile_cont(y, 0.99) / (avg(abs(y)) + greatest(1e-9, 1e-3 * coalesce(median(abs(y)) FILTER (WHERE y <> 0), 0))) END AS spikiness,
CASE WHEN count(*) <= 8 OR coalesce(stddev_samp(y), 0) <= 0 THEN NULL WHEN coalesce(stddev_samp(r), 0) < 1e-6 * stddev_samp(y) THEN 0
WHEN count(r * b) < 2 OR stddev_samp(CASE WHEN b IS NOT NULL THEN r END) < 1e-12 OR stddev_samp(CASE WHEN r IS NOT NULL THEN b END) < 1e-12 THEN NULL ELSE corr(r, b) END AS daily_autocorr FROM
(SELECT *, lag(r, 4) OVER (PARTITION BY series_id ORDER BY grid_ts) AS b FROM (SELECT *, CASE WHEN count(y) OVER w >= 2 THEN y - avg(y) OVER w END AS r FROM spiky6
WINDOW w AS (PARTITION BY series_id ORDER BY grid_ts ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING))) GROUP BY 1""", "spiky6")


@query("TR14_data_report", """WITH l AS (SELECT *, (epoch_us(date_trunc('second', ts)) - epoch_us(date_trunc('second', lag(ts) OVER w))) / 60e6 AS gap, value - lag(value) OVER w AS dv,
count(CASE WHEN value <> 0 THEN 1 END) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nz FROM (SELECT series_id, ts, CASE WHEN event_id % 19 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 0 ELSE value END AS value FROM fleet) WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
z AS (SELECT series_id, max(n) AS max_zero_run FROM (SELECT series_id, nz, count(*) AS n FROM l WHERE value = 0 GROUP BY 1, 2) GROUP BY 1),
b AS (SELECT series_id, count(*) AS rows_total, min(ts) AS first_ts, max(ts) AS last_ts, coalesce(max(gap), 0) AS biggest_gap_minutes, count(*) FILTER (WHERE gap > 1440) AS big_gap_count, count(value) AS nn, min(value) AS value_min, max(value) AS value_max,
stddev_samp(value) AS value_std, median(value) AS value_median, count(*) FILTER (WHERE dv > 5000) AS max_increment_hits FROM l GROUP BY 1),
c AS (SELECT *, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(date_trunc('second', last_ts))) / 60e6 AS age, greatest(1, CAST(floor((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(date_trunc('second', first_ts))) / (360 * 60e6)) AS BIGINT)) AS rows_expected, round(100.0 * (1.0 - nn / rows_total), 1) AS null_pct FROM b),
d AS (SELECT *, round(least(100.0, 100.0 * rows_total / rows_expected), 1) AS coverage_pct FROM c)
SELECT series_id, rows_total, rows_expected, coverage_pct, null_pct, round(age, 1) AS recorder_age_minutes, round(biggest_gap_minutes, 1) AS biggest_gap_minutes, big_gap_count, value_min, value_max, round(value_std, 4) AS value_std, round(value_median, 4) AS value_median, max_increment_hits,
coalesce(max_zero_run, 0) AS max_zero_run, CASE WHEN big_gap_count > 0 AND biggest_gap_minutes > 8640 THEN 'alert' WHEN age > 1440 OR coverage_pct < 70 OR null_pct > 5 THEN 'warning' ELSE 'ok' END AS verdict,
round(spikiness, 6) AS spikiness, round(daily_autocorr, 6) AS daily_autocorr FROM d LEFT JOIN z USING (series_id) LEFT JOIN spiky_shape USING (series_id)""", "fleet spiky_shape")
def _(spark, sf):
    d = i.obs_fleet(spark, sf).withColumn("value", F.when(F.col("event_id") % 19 == 0, None).when(F.col("event_id") % 5 == 0, 0.0).otherwise(F.col("value")))
    out = tr.data_report(d.drop("event_id"), K, 360, "2024-01-31", max_increment=5000.0).drop("first_ts", "last_ts")
    return rnd(out, recorder_age_minutes=1, biggest_gap_minutes=1, value_std=4, value_median=4, spikiness=6, daily_autocorr=6)


@query("TR15_frame_diff", """WITH a AS (SELECT series_id, grid_ts, y FROM load6 WHERE grid_ts < TIMESTAMP '2024-01-25'), b AS (SELECT series_id, grid_ts, CASE WHEN hour(grid_ts) = 6 THEN y + 1 WHEN day(grid_ts) = 9 THEN NULL ELSE y END AS y FROM load6 WHERE grid_ts >= TIMESTAMP '2024-01-03')
SELECT 'y' AS column_name, count(*) FILTER (WHERE h AND g AND ay IS DISTINCT FROM b_y) AS n_diff, max(abs(ay - b_y)) FILTER (WHERE h AND g) AS max_abs_diff, count(*) FILTER (WHERE h AND g AND (ay IS NULL) <> (b_y IS NULL)) AS null_mismatch,
min(grid_ts) FILTER (WHERE h AND g AND ay IS DISTINCT FROM b_y) AS first_diff, count(*) FILTER (WHERE g IS NULL) AS only_left, count(*) FILTER (WHERE h IS NULL) AS only_right FROM
(SELECT coalesce(a.grid_ts, b.grid_ts) AS grid_ts, a.y AS ay, b.y AS b_y, CASE WHEN a.series_id IS NOT NULL THEN true END AS h, CASE WHEN b.series_id IS NOT NULL THEN true END AS g FROM a FULL JOIN b ON a.series_id = b.series_id AND a.grid_ts = b.grid_ts)""", "load6")
def _(spark, sf):
    d = i.load6(spark, sf)
    b = d.filter("grid_ts >= timestamp_ntz'2024-01-03'").withColumn("y", F.when(F.hour("grid_ts") == 6, F.col("y") + 1).when(F.dayofmonth("grid_ts") == 9, None).otherwise(F.col("y")))
    return tr.frame_diff(d.filter("grid_ts < timestamp_ntz'2024-01-25'"), b, [*K, "grid_ts"], ["y"])


@query("TR16_column_fingerprint")
def _(spark, sf):
    return rnd(tr.column_fingerprint(i.load6(spark, sf), [*K, "grid_ts"], ["y"]), mean=6, std=6)


# ---- set operations ------------------------------------------------------------------------
cte("two_halves", "SELECT experiment, target_dt, value, source FROM external_log WHERE lead_minutes <= 720", "external_log")


@query("SO1_union_dedup", "SELECT series_id, ts, CASE WHEN ts >= TIMESTAMP '2024-01-15' THEN value * 10 + 2 ELSE value END AS value FROM fleet", "fleet")
def _(spark, sf):
    n = _new(spark, sf)
    return so.union_dedup([_stored(spark, sf), n.filter("version = 1"), n.filter("version = 2")], [*K, "ts"])


@query("SO2_combine_first", "SELECT series_id, grid_ts, coalesce(s.y, l.y) AS y FROM load6 l LEFT JOIN sparse6 s USING (series_id, grid_ts)", "load6 sparse6")
def _(spark, sf):
    return so.combine_first([i.sparse6(spark, sf), i.load6(spark, sf)], [*K, "grid_ts"], "y")


@query("SO3_intersect", """SELECT experiment, target_dt FROM external_log INTERSECT SELECT experiment, target_dt FROM forecast_log INTERSECT SELECT experiment, grid_ts FROM actuals""", "external_log forecast_log actuals")
def _(spark, sf):
    a = i.actuals(spark, sf).withColumnRenamed("grid_ts", "target_dt")
    return so.intersect_keys([i.external_log(spark, sf), i.forecast_log(spark, sf), a], ["experiment", "target_dt"])


@query("SO4_except_days", "SELECT series_id, grid_ts, y FROM load6 WHERE CAST(grid_ts AS DATE) NOT IN (SELECT CAST(ts AS DATE) FROM fleet WHERE day(ts) % 7 = 3)", "load6 fleet")
def _(spark, sf):
    days = i.obs_fleet(spark, sf).select(F.to_date("ts").alias("day")).distinct().filter(F.dayofmonth("day") % 7 == 3)
    return so.except_days(i.load6(spark, sf), days)


@query("SO5_union_timeline", """SELECT experiment, target_dt AS ts FROM external_log UNION SELECT experiment, target_dt FROM forecast_log UNION SELECT experiment, grid_ts FROM actuals""", "external_log forecast_log actuals")
def _(spark, sf):
    fs = [i.external_log(spark, sf).withColumnRenamed("target_dt", "ts"), i.forecast_log(spark, sf).withColumnRenamed("target_dt", "ts"), i.actuals(spark, sf).withColumnRenamed("grid_ts", "ts")]
    return so.union_timeline(fs, ["experiment", "ts"])


@query("SO6_collapse_unchanged", """WITH RECURSIVE runs AS (SELECT *, row_number() OVER (PARTITION BY experiment, source ORDER BY issued_at) AS i FROM (SELECT DISTINCT experiment, source, issued_at FROM external_log)),
p AS (SELECT experiment, source, i, target_dt, max(round(value, 4)) AS v FROM external_log JOIN runs USING (experiment, source, issued_at) WHERE value IS NOT NULL GROUP BY ALL),
near AS (SELECT a.experiment, a.source, a.i, b.i AS j, bool_or(abs(b.v - a.v) > greatest(1e-4, CAST(0.005 AS DOUBLE) * abs(b.v))) AS moved FROM p a JOIN p b ON a.experiment = b.experiment AND a.source = b.source AND a.target_dt = b.target_dt AND a.i < b.i GROUP BY ALL),
links AS (SELECT a.experiment, a.source, a.i, min(b.i) AS j FROM runs a JOIN runs b ON a.experiment = b.experiment AND a.source = b.source AND a.i < b.i LEFT JOIN near n ON n.experiment = a.experiment AND n.source = a.source AND n.i = a.i AND n.j = b.i WHERE coalesce(n.moved, true) GROUP BY ALL),
kept(experiment, source, i) AS (SELECT experiment, source, i FROM runs WHERE i = 1 UNION ALL SELECT k.experiment, k.source, l.j FROM kept k JOIN links l ON l.experiment = k.experiment AND l.source = k.source AND l.i = k.i)
SELECT experiment, source, count(*) AS kept FROM kept GROUP BY 1, 2""", "external_log")
def _(spark, sf):
    return so.collapse_unchanged(i.external_log(spark, sf)).groupBy("experiment", "source").agg(F.count_distinct("issued_at").alias("kept"))


@query("SO6_changed_since_previous", """WITH c AS (SELECT *, lag(issued_at) OVER (PARTITION BY experiment, source ORDER BY issued_at) AS prev FROM (SELECT DISTINCT experiment, source, issued_at FROM external_log))
SELECT e.experiment, e.source, e.issued_at, coalesce(bool_or(abs(e.value - p.value) > greatest(1e-4, CAST(0.005 AS DOUBLE) * abs(e.value))), false) OR count(p.value) = 0 AS changed FROM external_log e
JOIN c USING (experiment, source, issued_at) LEFT JOIN external_log p ON p.experiment = e.experiment AND p.source = e.source AND p.issued_at = c.prev AND p.target_dt = e.target_dt GROUP BY 1, 2, 3""", "external_log")
def _(spark, sf):
    return so.changed_since_previous(i.external_log(spark, sf))


@query("SO7_backfill_copy", """WITH own AS (SELECT experiment, issued_at, target_dt, value FROM external_log WHERE source = 'ext_a' AND issued_at >= TIMESTAMP '2024-01-15'),
f AS (SELECT experiment, min(issued_at) AS first FROM own GROUP BY 1)
SELECT * FROM own UNION ALL SELECT e.experiment, issued_at, target_dt, min(value) FROM external_log e LEFT JOIN f USING (experiment) WHERE first IS NULL OR issued_at < first GROUP BY 1, 2, 3""", "external_log")
def _(spark, sf):
    e = i.external_log(spark, sf)
    return so.backfill_copy(e.filter("source = 'ext_a' and issued_at >= timestamp_ntz'2024-01-15'"), e)


@query("SO8_prefer_source", """SELECT experiment, issued_at, target_dt, coalesce(max(CASE WHEN source = 'ext_b' THEN value END), max(value)) AS value, bool_or(source = 'ext_b') AS from_preferred FROM external_log GROUP BY 1, 2, 3""", "external_log")
def _(spark, sf):
    return so.prefer_source(i.external_log(spark, sf), ["experiment", "issued_at", "target_dt"], F.col("source") == "ext_b")
