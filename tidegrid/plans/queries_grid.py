"""Grids, gaps, counters and net load over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.functions.timecols import time_bin
from tidegrid.operators import counters as cn
from tidegrid.operators import grid as rg
from tidegrid.operators import netload as ls
from tidegrid.plans import inputs as i
from tidegrid.plans.registry import cte, query

K = ["series_id"]


def r6(name: str):
    return F.round(F.col(name), 6).alias(name)


@query("RG1_time_bin", """SELECT series_id, time_bucket(INTERVAL '30 minutes', ts) AS grid_ts, count(*) AS n
FROM obs GROUP BY 1, 2""", "obs")
def _(spark, sf):
    return i.obs_type(spark, sf).groupBy("series_id", time_bin("ts", 1800).alias("grid_ts")).agg(
        F.count(F.lit(1)).alias("n"))


@query("RG2_resample", """SELECT s.series_id, s.grid_ts, round(b.mean_y, 6) AS mean_y, coalesce(b.sum_y, 0.0) AS sum_y,
b.max_y, b.min_y, b.last_y FROM hourly_spine s LEFT JOIN (SELECT series_id, time_bucket(INTERVAL '1 hour', ts) AS grid_ts,
avg(value) AS mean_y, sum(round(value * 100)) AS sum_y, max(value) AS max_y, min(value) AS min_y, arg_max(value, ts) AS last_y
FROM obs GROUP BY 1, 2) b ON b.series_id = s.series_id AND b.grid_ts = s.grid_ts""", "hourly_spine obs")
def _(spark, sf):
    o = i.obs_type(spark, sf)
    d = rg.resample(o, K, 3600, "mean", out="mean_y")
    for m in ("sum", "max", "min", "last"):
        src = o.withColumn("value", F.round(F.col("value") * 100)) if m == "sum" else o
        d = d.join(rg.resample(src, K, 3600, m, out=f"{m}_y"), [*K, "grid_ts"])
    return d.withColumn("mean_y", F.round("mean_y", 6))


@query("RG3_spine", "SELECT series_id, grid_ts FROM load6_spine", "load6_spine")
def _(spark, sf):
    o = i.obs_fleet(spark, sf)
    b = o.groupBy(*K).agg(time_bin(F.min("ts"), i.SIX).alias("a"), time_bin(F.max("ts"), i.SIX).alias("z"))
    return rg.spine(b, K, "a", "z", i.SIX)


cte("half_ffill", """SELECT series_id, grid_ts, coalesce(last_value(y IGNORE NULLS) OVER w,
first_value(y IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY grid_ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS y
FROM half WINDOW w AS (PARTITION BY series_id ORDER BY grid_ts ROWS UNBOUNDED PRECEDING)""", "half")


@query("RG4_fill_ffill", "SELECT series_id, grid_ts, round(y, 6) AS y FROM half_ffill", "half_ffill")
def _(spark, sf):
    return rg.fill_hold(i.half_hourly(spark, sf), K).withColumn("y", F.round("y", 6))


cte("orders_neighbours", """SELECT series_id, grid_ts, y,
last_value(CASE WHEN y IS NOT NULL THEN grid_ts END IGNORE NULLS) OVER w AS t0, last_value(y IGNORE NULLS) OVER w AS v0,
first_value(CASE WHEN y IS NOT NULL THEN grid_ts END IGNORE NULLS) OVER f AS t1, first_value(y IGNORE NULLS) OVER f AS v1
FROM daily_orders WINDOW w AS (PARTITION BY series_id ORDER BY grid_ts ROWS UNBOUNDED PRECEDING),
f AS (PARTITION BY series_id ORDER BY grid_ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""", "daily_orders")


@query("RG5_fill_interpolate", """SELECT series_id, grid_ts, round(CASE WHEN y IS NOT NULL THEN y WHEN v0 IS NULL THEN v1
WHEN (epoch(grid_ts) - epoch(t0)) / 86400 > 2 THEN NULL WHEN v1 IS NULL THEN v0
ELSE v0 + (v1 - v0) * (epoch(grid_ts) - epoch(t0)) / (epoch(t1) - epoch(t0)) END, 4) AS y FROM orders_neighbours""",
       "orders_neighbours")
def _(spark, sf):
    d = rg.fill_linear(i.daily_orders(spark, sf), K, i.DAY, gap_max_minutes=2 * 1440)
    return d.withColumn("y", F.round("y", 4))


@query("RG6_fill_mask", "SELECT series_id, count(*) AS cells, count(y) AS measured FROM daily_orders GROUP BY 1", "daily_orders")
def _(spark, sf):
    return rg.fill_mask(i.daily_orders(spark, sf)).groupBy(*K).agg(
        F.count(F.lit(1)).alias("cells"), F.count("y").alias("measured"))


@query("RG7_covariate_resample", """SELECT series_id, grid_ts, round(CASE WHEN series_id IN ('click', 'error')
THEN last_value(lastv IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY grid_ts ROWS UNBOUNDED PRECEDING) ELSE y END, 6) AS y
FROM (SELECT h.series_id, h.grid_ts, h.y, l.lastv FROM hourly h LEFT JOIN (SELECT series_id,
time_bucket(INTERVAL '1 hour', ts) AS grid_ts, arg_max(value, ts) AS lastv FROM obs GROUP BY 1, 2) l
ON l.series_id = h.series_id AND l.grid_ts = h.grid_ts)""", "hourly obs")
def _(spark, sf):
    o = i.obs_type(spark, sf)
    methods = o.select(*K).distinct().withColumn(
        "method", F.when(F.col("series_id").isin("click", "error"), F.lit("last")).otherwise(F.lit("mean")))
    return rg.resample_covariates(o, K, 3600, methods).withColumn("y", F.round("y", 6))


@query("RG8_idle_fill", """SELECT series_id, grid_ts, round(CASE WHEN hour(grid_ts) NOT BETWEEN 6 AND 19
AND (y IS NULL OR y <> 0) THEN 0.0 ELSE y END, 6) AS y FROM hourly""", "hourly")
def _(spark, sf):
    sun = F.when(F.hour("grid_ts").between(6, 19), F.lit(100.0)).otherwise(F.lit(0.0))
    d = rg.idle_fill(i.hourly(spark, sf).withColumn("ghi", sun), 0.0)
    return d.select("series_id", "grid_ts", r6("y"))


@query("RG9_hold_stale_tail", """WITH n AS (SELECT series_id, max(grid_ts) AS hi FROM sparse6 WHERE y IS NOT NULL GROUP BY 1),
tail AS (SELECT series_id, unnest(generate_series(hi + INTERVAL '6 hours', TIMESTAMP '2024-02-01 00:00:00', INTERVAL '6 hours')) AS grid_ts
FROM n WHERE epoch(TIMESTAMP '2024-02-01 03:00:00') - epoch(hi) > 2 * 21600)
SELECT series_id, grid_ts, y, false AS held FROM sparse6 UNION ALL SELECT series_id, grid_ts, CAST(7 AS DOUBLE), true FROM tail""",
       "sparse6")
def _(spark, sf):
    d = i.sparse6(spark, sf)
    live = d.select(*K).distinct().withColumn("live_value", F.lit(7.0))
    return rg.hold_stale_tail(d, K, i.SIX, live, "2024-02-01 03:00:00")


@query("RG10_gap_spans", """WITH m AS (SELECT series_id, grid_ts, y, count(y) OVER (PARTITION BY series_id ORDER BY grid_ts
ROWS UNBOUNDED PRECEDING) AS island FROM daily_orders), g AS (SELECT series_id, min(grid_ts) AS gap_start, max(grid_ts) AS gap_end,
count(*) AS n FROM m WHERE y IS NULL GROUP BY series_id, island)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY n DESC, gap_start) AS gap_rank FROM g) WHERE gap_rank <= 3""",
       "daily_orders")
def _(spark, sf):
    return rg.gap_spans(i.daily_orders(spark, sf), K, i.DAY)


@query("RG11_daily_cumsum", """SELECT series_id, grid_ts, sum(y) OVER (PARTITION BY series_id, CAST(grid_ts + INTERVAL '2 hours' AS DATE)
ORDER BY grid_ts ROWS UNBOUNDED PRECEDING) AS day_total FROM load6""", "load6")
def _(spark, sf):
    return rg.daily_cumsum(i.load6(spark, sf), K, offset_hours=2.0, null_as_zero=True).select(*K, "grid_ts", "day_total")


@query("RG12_complete_day_cumsum", """SELECT series_id, grid_ts, CASE WHEN count(y) OVER w = hour(grid_ts) // 6 + 1
THEN sum(y) OVER w END AS day_total FROM sparse6 WINDOW w AS (PARTITION BY series_id, CAST(grid_ts AS DATE) ORDER BY grid_ts
ROWS UNBOUNDED PRECEDING)""", "sparse6")
def _(spark, sf):
    return rg.complete_day_cumsum(i.sparse6(spark, sf), K, i.SIX).select(*K, "grid_ts", "day_total")


cte("daily_lag", """SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY ts) AS prev,
lag(ts) OVER (PARTITION BY series_id ORDER BY ts) AS prev_ts, lead(value) OVER (PARTITION BY series_id ORDER BY ts) AS nxt
FROM counter_daily""", "counter_daily")
cte("daily_restart", """SELECT *, coalesce(value < CAST(0.9 AS DOUBLE) * prev, false) OR
coalesce(CAST(ts AS DATE) <> CAST(prev_ts AS DATE) AND value < prev, false) AS restart FROM daily_lag""", "daily_lag")
cte("daily_segment", """SELECT *, CAST(sum(CASE WHEN restart THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY ts
ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM daily_restart""", "daily_restart")
cte("daily_high", """SELECT *, max(value) OVER (PARTITION BY series_id, segment ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING
AND 1 PRECEDING) AS high FROM daily_segment""", "daily_segment")
cte("daily_rise", """SELECT *, CASE WHEN restart THEN value ELSE greatest(coalesce(value - high, 0.0), 0.0) END AS rise,
(epoch_us(ts) - epoch_us(prev_ts)) / 3.6e9 AS elapsed FROM daily_high""", "daily_high")


@query("CN1_restart_detect", "SELECT series_id, ts, restart, segment FROM daily_segment", "daily_segment")
def _(spark, sf):
    return cn.detect_restarts(i.counter_daily(spark, sf), K, reset_daily=True).select(*K, "ts", "restart", "segment")


cte("life_lag", "SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY ts) AS prev FROM counter_life", "counter_life")
cte("glitches", """SELECT * FROM (SELECT c.series_id, c.ts AS t0, c.prev, min(r.ts) AS t1, arg_min(r.value, r.ts) AS ve FROM life_lag c
JOIN counter_life r ON r.series_id = c.series_id AND r.ts > c.ts
AND epoch_us(r.ts) - epoch_us(c.ts) <= 3600000000
AND (r.value >= c.prev OR r.value > c.value + 0.25 * (c.prev - c.value))
WHERE c.value >= 0.5 * c.prev AND c.value < CAST(0.9 AS DOUBLE) * c.prev GROUP BY 1, 2, 3) WHERE ve >= prev""", "life_lag counter_life")


@query("CN2_glitch_hold", """SELECT l.series_id, l.ts, coalesce(h.prev, l.value) AS value, h.prev IS NOT NULL AS held FROM counter_life l
LEFT JOIN (SELECT r.series_id, r.ts, arg_min(g.prev, g.t0) AS prev FROM counter_life r JOIN glitches g
ON g.series_id = r.series_id AND r.ts >= g.t0 AND r.ts < g.t1 GROUP BY 1, 2) h ON h.series_id = l.series_id AND h.ts = l.ts""",
       "counter_life glitches")
def _(spark, sf):
    return cn.hold_glitches(i.counter_life(spark, sf), K)


@query("CN3_undone_drop", """WITH d AS (SELECT series_id, ts AS t0, value, prev FROM life_lag WHERE value < CAST(0.9 AS DOUBLE) * prev),
u AS (SELECT d.series_id, d.t0, d.prev, min(r.ts) AS t1, arg_min(r.value, r.ts) AS ve FROM d JOIN counter_life r
ON r.series_id = d.series_id AND r.ts > d.t0 AND r.value > d.value GROUP BY 1, 2, 3),
k AS (SELECT * FROM u WHERE ve >= CAST(0.9 AS DOUBLE) * prev)
SELECT l.series_id, l.ts, l.value, count(k.t0) > 0 AS undone FROM counter_life l LEFT JOIN k ON k.series_id = l.series_id
AND l.ts >= k.t0 AND (l.ts < k.t1 OR (l.ts = k.t1 AND k.ve = k.prev)) GROUP BY 1, 2, 3""", "life_lag counter_life")
def _(spark, sf):
    return cn.mark_undone_drops(i.counter_life(spark, sf), K)


@query("CN4_running_high_increment", """SELECT series_id, ts, CASE WHEN prev IS NULL THEN 0.0 ELSE rise END AS use
FROM daily_rise""", "daily_rise")
def _(spark, sf):
    d = cn.running_high(i.counter_daily(spark, sf), K, 30, reset_daily=True)
    return d.select(*K, "ts", F.when(F.col("first"), F.lit(0.0)).otherwise(F.col("rise")).alias("use"))


@query("CN5_rate_cap", """WITH r AS (SELECT *, rise > 0 AND NOT restart AS rising FROM daily_rise),
f AS (SELECT *, sum(CASE WHEN rising THEN 1 ELSE 0 END) OVER (PARTITION BY series_id, segment ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM r),
e AS (SELECT series_id, rise, rise / elapsed AS rate FROM f WHERE rising AND elapsed > 0 AND elapsed * 60.0 / 30 <= 1.5
AND NOT (segment > 0 AND nth = 1) AND NOT coalesce(nxt < value, false)),
p AS (SELECT series_id, count(*) AS n, quantile_cont(rate, 0.99) AS p99, median(rise) AS mid FROM e GROUP BY 1),
z AS (SELECT s.series_id, CASE WHEN p.n >= 20 THEN 2 * p99 ELSE 0 END AS cap_per_hour, CASE WHEN p.n >= 20 THEN mid ELSE coalesce(p95, 1.0) END AS cap_floor
FROM (SELECT series_id, quantile_cont(rise, 0.95) FILTER (WHERE rise > 0) AS p95 FROM daily_rise GROUP BY 1) s LEFT JOIN p USING (series_id))
SELECT series_id, round(cap_per_hour, 4) AS cap_per_hour, round(cap_floor, 4) AS cap_floor,
round(greatest(cap_per_hour * 0.5, cap_floor), 4) AS dip_limit FROM z""", "daily_rise")
def _(spark, sf):
    d = cn.running_high(i.counter_daily(spark, sf), K, 30, reset_daily=True)
    caps = cn.rate_caps(d, K, 30)
    return caps.select(*K, *[F.round(c, 4).alias(c) for c in ("cap_per_hour", "cap_floor", "dip_limit")])


@query("CN6_accepted_level")
def _(spark, sf):
    d = cn.decode_counter(i.counter_life(spark, sf), K, 30)
    return d.select(*K, "ts", F.round("use", 4).alias("use"))


@query("CN7_diff_reset_guard", """SELECT series_id, grid_ts, CASE WHEN y - p >= 0 THEN y - p END AS d FROM
(SELECT *, lag(y) OVER (PARTITION BY series_id ORDER BY grid_ts) AS p FROM load6)""", "load6")
def _(spark, sf):
    return cn.diff_reset_guard(i.load6(spark, sf), K).select(*K, "grid_ts", "d")


cte("increments", """WITH b AS (SELECT series_id, time_bucket(INTERVAL '30 minutes', ts) AS grid_ts, CASE WHEN count(prev) = count(*) THEN
sum(CASE WHEN value < CAST(0.9 AS DOUBLE) * prev THEN value ELSE value - prev END) END AS value FROM daily_lag GROUP BY 1, 2),
s AS (SELECT series_id, unnest(generate_series(min(grid_ts), max(grid_ts), INTERVAL '30 minutes')) AS grid_ts FROM b GROUP BY 1)
SELECT s.series_id, s.grid_ts, CASE WHEN b.series_id IS NULL THEN 0.0 ELSE b.value END AS value FROM s LEFT JOIN b
ON b.series_id = s.series_id AND b.grid_ts = s.grid_ts""", "daily_lag")


@query("CN8_increment_actuals", "SELECT * FROM increments", "increments")
def _(spark, sf):
    return cn.increment_actuals(i.counter_daily(spark, sf), K, 1800)


@query("CN9_net_increments", """SELECT series_id, time_bucket(INTERVAL '12 hours', grid_ts) AS grid_ts, sum(y) AS value FROM sparse6
GROUP BY 1, 2""", "sparse6")
def _(spark, sf):
    d = i.sparse6(spark, sf).withColumnRenamed("grid_ts", "ts")
    return cn.net_increments(d, K, 43200, value="y")


@query("CN10_raw_grid", """SELECT series_id, time_bucket(INTERVAL '30 minutes', ts) AS grid_ts, round(avg(value), 4) AS mean_value,
arg_max(value, ts) AS last_value FROM counter_daily GROUP BY 1, 2""", "counter_daily")
def _(spark, sf):
    c = i.counter_daily(spark, sf)
    mean = cn.raw_grid(c, K, 1800).select(*K, "grid_ts", F.round("value", 4).alias("mean_value"))
    return mean.join(cn.raw_grid(c, K, 1800, last=True).withColumnRenamed("value", "last_value"), [*K, "grid_ts"])


# Net load: per user, all events are the load, clicks and views are its sub-loads.
SENSORS = "('click', 'view')"
i.cte("sub_load", """SELECT CAST(user_id AS VARCHAR) AS series_id, time_bucket(INTERVAL '6 hours', ts) AS grid_ts,
event_type AS entity_id, sum(round(value * 100)) AS y FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2, 3""")
cte("aligned", """SELECT l.series_id, l.grid_ts, c.entity_id, l.y AS load, s.y * c.scale AS sub, c.on_missing FROM load6 l,
(VALUES ('click', CAST(1.25 AS DOUBLE), 'zero'), ('view', CAST(1.5 AS DOUBLE), 'zero')) AS c(entity_id, scale, on_missing) LEFT JOIN sub_load s
ON s.series_id = l.series_id AND s.grid_ts = l.grid_ts AND s.entity_id = c.entity_id""", "load6 sub_load")
cte("net", """SELECT series_id, grid_ts, any_value(load) AS load, sum(coalesce(sub, 0.0)) AS total_sub,
any_value(load) - sum(coalesce(sub, 0.0)) AS raw_net FROM aligned GROUP BY 1, 2""", "aligned")
cte("carried", """SELECT *, m - coalesce(lag(m) OVER (PARTITION BY series_id, CAST(grid_ts AS DATE) ORDER BY grid_ts), 0) AS net FROM
(SELECT *, greatest(0, max(s) OVER (PARTITION BY series_id, CAST(grid_ts AS DATE) ORDER BY grid_ts ROWS UNBOUNDED PRECEDING)) AS m FROM
(SELECT *, sum(raw_net) OVER (PARTITION BY series_id, CAST(grid_ts AS DATE) ORDER BY grid_ts ROWS UNBOUNDED PRECEDING) AS s FROM net))""", "net")
cte("leftovers", """SELECT d.*, day <> max(day) OVER (PARTITION BY series_id) AND leftover > 1e-9 AND leftover > 0.1 * day_sub
AND leftover > 0.1 * day_load AS unmeasured FROM (SELECT series_id, CAST(grid_ts AS DATE) AS day, sum(net) - sum(raw_net) AS leftover,
sum(total_sub) AS day_sub, sum(load) AS day_load FROM carried GROUP BY 1, 2) d""", "carried")


def _net_inputs(spark, sf):
    ev = i.table(spark, sf, "events").filter(F.col("event_type").isin("click", "view"))
    sensors = ev.groupBy(
        F.col("user_id").cast("string").alias("series_id"), time_bin("ts", i.SIX).alias("grid_ts"),
        F.col("event_type").alias("entity_id")
    ).agg(F.sum(F.round(F.col("value") * 100)).alias("y"))
    load = i.load6(spark, sf)
    entity = F.explode(F.array(
        F.struct(F.lit("click").alias("e"), F.lit(1.25).alias("s")), F.struct(F.lit("view").alias("e"), F.lit(1.5).alias("s"))))
    config = load.select(*K).distinct().withColumn("x", entity).select(
        *K, F.col("x.e").alias("entity_id"), F.col("x.s").alias("scale"), F.lit("zero").alias("on_missing"),
        F.lit(1.0).alias("max_fraction"), F.lit(5.0).alias("max_violation_pct"))
    return load, sensors, config


def _net(spark, sf):
    return ls.load_subtract(*_net_inputs(spark, sf), K)


def _carried(spark, sf):
    return ls.carry_deficit(_net(spark, sf).drop("net"), K)


cte("click_pair", """SELECT l.series_id, l.grid_ts, l.y AS b, s.y AS o FROM load6 l LEFT JOIN (SELECT * FROM sub_load WHERE entity_id = 'click') s
ON s.series_id = l.series_id AND s.grid_ts = l.grid_ts""", "load6 sub_load")
HELD = """SELECT series_id, grid_ts, last_value(d IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY grid_ts ROWS UNBOUNDED PRECEDING) AS y FROM
(SELECT series_id, grid_ts, {} AS d FROM {} WINDOW p AS (PARTITION BY series_id ORDER BY grid_ts ROWS UNBOUNDED PRECEDING),
q AS (PARTITION BY series_id ORDER BY grid_ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


def _minus_click(spark, sf, fill):
    load, sensors, _ = _net_inputs(spark, sf)
    d = ls.subtract_series(load, sensors.filter("entity_id = 'click'").drop("entity_id"), K, i.SIX, fill)
    return d.withColumn("y", F.round("y", 6)) if fill == "interpolate" else d


@query("LS1_subtract_series", HELD.format("b - last_value(o IGNORE NULLS) OVER p", "click_pair"), "click_pair")
def _(spark, sf):
    return _minus_click(spark, sf, "ffill")


@query("LS1_subtract_next", HELD.format("b - first_value(o IGNORE NULLS) OVER q", "click_pair"), "click_pair")
def _(spark, sf):
    return _minus_click(spark, sf, "bfill")


@query("LS1_subtract_line", "SELECT series_id, grid_ts, round(y, 6) AS y FROM (" + HELD.format(
    "b - CASE WHEN q0 IS NULL OR pt = qt THEN p0 ELSE p0 + (q0 - p0) * (epoch(grid_ts) - pt) / (qt - pt) END", """(SELECT *,
last_value(o IGNORE NULLS) OVER p AS p0, last_value(CASE WHEN o IS NOT NULL THEN epoch(grid_ts) END IGNORE NULLS) OVER p AS pt,
first_value(o IGNORE NULLS) OVER q AS q0, first_value(CASE WHEN o IS NOT NULL THEN epoch(grid_ts) END IGNORE NULLS) OVER q AS qt FROM click_pair
WINDOW p AS (PARTITION BY series_id ORDER BY grid_ts ROWS UNBOUNDED PRECEDING),
q AS (PARTITION BY series_id ORDER BY grid_ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""") + ")", "click_pair")
def _(spark, sf):
    return _minus_click(spark, sf, "interpolate")


@query("LS2_load_subtract_drop", """SELECT series_id, grid_ts, any_value(load) AS load, sum(sub) AS total_sub, any_value(load) - sum(sub) AS raw_net,
greatest(any_value(load) - sum(sub), 0) AS net, any_value(load) - sum(sub) < 0 AS clipped FROM aligned GROUP BY 1, 2 HAVING count(sub) = count(*)""", "aligned")
def _(spark, sf):
    load, sensors, config = _net_inputs(spark, sf)
    return ls.load_subtract(load, sensors, config.withColumn("on_missing", F.lit("drop")), K)


@query("LS2_load_subtract", """SELECT series_id, grid_ts, load, total_sub, raw_net, greatest(raw_net, 0) AS net,
raw_net < 0 AS clipped FROM net""", "net")
def _(spark, sf):
    return _net(spark, sf)


@query("LS3_subtract_guard", """SELECT *, violation_pct > 5 AS violated FROM (SELECT series_id, entity_id, count(*) AS n_valid,
round(max(coalesce(abs(sub), 0) / abs(load)), 6) AS max_ratio, count(*) FILTER (WHERE coalesce(abs(sub), 0) / abs(load) > 1) AS violation_rows,
CAST(5 AS DOUBLE) AS limit_pct, round(100.0 * count(*) FILTER (WHERE coalesce(abs(sub), 0) / abs(load) > 1) / count(*), 6) AS violation_pct
FROM aligned WHERE abs(load) > 1e-9 GROUP BY 1, 2)""", "aligned")
def _(spark, sf):
    d = ls.subtract_guard(*_net_inputs(spark, sf), K)
    return d.withColumn("max_ratio", F.round("max_ratio", 6)).withColumn("violation_pct", F.round("violation_pct", 6))


@query("LS4_carry_deficit", "SELECT series_id, grid_ts, raw_net, round(net, 6) AS net FROM carried", "carried")
def _(spark, sf):
    return _carried(spark, sf).select(*K, "grid_ts", "raw_net", r6("net"))


@query("LS5_unmeasured_days", """SELECT c.series_id, c.grid_ts, CASE WHEN NOT l.unmeasured THEN round(c.net, 6) END AS net FROM carried c
JOIN leftovers l ON l.series_id = c.series_id AND l.day = CAST(c.grid_ts AS DATE)""", "carried leftovers")
def _(spark, sf):
    return ls.mask_unmeasured_days(_carried(spark, sf), K).select(*K, "grid_ts", r6("net"))


cte("audit", """SELECT series_id, entity_id, count(sub) AS rows_present, count(*) - count(sub) AS rows_missing, CAST(0 AS BIGINT) AS rows_dropped,
round(sum(coalesce(sub, 0)), 4) AS sum_sub, round(avg(coalesce(sub, 0)), 4) AS mean_sub,
round(max(CASE WHEN abs(load) > 1e-9 THEN coalesce(abs(sub), 0) / abs(load) END), 6) AS max_ratio,
min(CASE WHEN sub IS NOT NULL THEN grid_ts END) AS first_present, max(CASE WHEN sub IS NOT NULL THEN grid_ts END) AS last_present,
coalesce(min(CASE WHEN sub IS NOT NULL THEN grid_ts END) > min(grid_ts), true) AS leading_gap,
coalesce(max(CASE WHEN sub IS NOT NULL THEN grid_ts END) < max(grid_ts), false) AS trailing_gap FROM aligned GROUP BY 1, 2""", "aligned")


@query("LS6_subtract_audit", "SELECT * FROM audit", "audit")
def _(spark, sf):
    d = ls.subtract_audit(*_net_inputs(spark, sf), K)
    return d.withColumns({c: F.round(c, n) for c, n in (("sum_sub", 4), ("mean_sub", 4), ("max_ratio", 6))})


@query("LS7_net_actuals_rewrite", """WITH f AS (SELECT series_id, max(first_present) AS start FROM audit GROUP BY 1),
x AS (SELECT series_id, max(grid_ts) AS mx FROM carried GROUP BY 1)
SELECT c.series_id, c.grid_ts, CAST(c.grid_ts AS DATE) AS day, round(c.net, 6) AS value FROM carried c JOIN f USING (series_id)
JOIN x USING (series_id) WHERE c.grid_ts >= start AND CAST(c.grid_ts AS DATE) > CAST(start AS DATE)
AND c.grid_ts >= least(mx, TIMESTAMP '2024-01-20') - INTERVAL '2 days'""", "carried audit")
def _(spark, sf):
    audit = ls.subtract_audit(*_net_inputs(spark, sf), K)
    written = audit.select(*K).distinct().withColumn("newest", F.lit("2024-01-20").cast("timestamp_ntz"))
    d = ls.net_actuals_rewrite(_carried(spark, sf), audit, K, written)
    return d.withColumn("value", F.round("value", 6))


@query("LS8_subtract_source", """SELECT series_id, entity_id, source, resolved, CASE WHEN resolved LIKE 'cumulative%' THEN 'sum'
ELSE 'mean' END AS method FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS series_id, event_type AS entity_id,
CASE WHEN event_type = 'view' THEN 'interval' ELSE 'auto' END AS source, CASE WHEN event_type = 'view' THEN 'interval'
WHEN user_id % 3 = 0 THEN 'cumulative_daily' WHEN user_id % 3 = 1 THEN 'cumulative_monotonic' ELSE 'interval' END AS resolved FROM events)""")
def _(spark, sf):
    ev = i.table(spark, sf, "events").select("user_id", F.col("event_type").alias("entity_id")).distinct()
    cfg = ev.select(
        F.col("user_id").cast("string").alias("series_id"), "entity_id",
        F.when(F.col("entity_id") == "view", F.lit("interval")).otherwise(F.lit("auto")).alias("source"),
        (F.col("user_id") % 3 < 2).alias("target_cumulative"), (F.col("user_id") % 3 == 0).alias("target_reset_daily"))
    return ls.subtract_sources(cfg).select("series_id", "entity_id", "source", "resolved", "method")
