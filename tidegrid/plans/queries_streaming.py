"""Streaming jobs run to completion over the given tables.

An append-mode window is emitted once the watermark has passed it. Jobs over
windows therefore read a table that ends with a mark later than all events.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.functions.timecols import epoch, time_bin
from tidegrid.plans import inputs as i
from tidegrid.plans import queries_sources  # noqa: F401  (its SQL checks a stream as well)
from tidegrid.plans.registry import CHECKS, query
from tidegrid.session import stored, table
from tidegrid.streaming import jobs as st

K = ["series_id"]


def _closed(spark, sf):
    """The events in order of time, then the end mark, several files a batch."""
    src = st.new_folder(spark, "closed")
    e = st.event_time(table(spark, sf, "events")).select(F.col("event_type").alias("series_id"), "ts", "value", "event_id")
    e.repartitionByRange(8, "ts").write.parquet(src)
    st.append_end(spark, src, "series_id", "2 days")
    return st.read_files(spark, src, spark.read.parquet(src).schema, per_batch=8)


def _done(spark, stream, name, mode="append"):
    out = st.new_folder(spark, name)
    st.run_available(stream, out, mode)
    d = st.result(spark, out)
    return d.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in d.dtypes])


def _in_turns(spark, rows, turn, turns, job, foreach=None):
    """Deliver the rows turn by turn; the job stops after each delivery and goes on from its stored state with the next."""
    src, out = st.new_folder(spark, "turns"), st.new_folder(spark, "out")
    rows = stored(rows.withColumn("__turn", turn))
    for k in range(turns):
        rows.filter(F.col("__turn") == k).drop("__turn").write.mode("append").parquet(src)
        st.run_available(job(st.read_files(spark, src, rows.drop("__turn").schema)), out, foreach=foreach and foreach(out))
    d = st.result(spark, out)
    return d.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in d.dtypes])


def _by_time(rows, ts, turns):
    """Number of the equal stretch of time a row lies in."""
    a, z = rows.agg(F.min(epoch(ts)), F.max(epoch(ts))).first()
    return F.floor((epoch(ts) - (a or 0)) / (((z or 0) - (a or 0)) // turns + 1))


@query("ST1_first_write_wins", "SELECT series_id, date_trunc('hour', ts) AS ts, arg_min(value, event_id % 3 * 1000000000000 + event_id) AS value FROM obs GROUP BY 1, 2", "obs")
def _(spark, sf):
    # Three deliveries over the same days: rows of the later ones are late, and stay only where their hour is new.
    e = st.event_time(i.obs_type(spark, sf)).withColumn("ts", F.date_trunc("hour", "ts"))
    return _in_turns(spark, e, F.col("event_id") % 3, 3, lambda s: s, lambda out: st.first_write_wins(out, K, arrival="event_id")).select(*K, "ts", "value")


@query("ST2_tumbling", "SELECT series_id, time_bucket(INTERVAL '30 minutes', ts) AS grid_ts, round(sum(value), 4) AS sum_y, round(avg(value), 6) AS mean_y, count(*) AS n FROM obs GROUP BY 1, 2", "obs")
def _(spark, sf):
    d = _done(spark, st.tumbling(_closed(spark, sf), K, "30 minutes"), "tumbling")
    return d.withColumn("sum_y", F.round("sum_y", 4)).withColumn("mean_y", F.round("mean_y", 6))


@query("ST3_sliding", """SELECT series_id, e AS grid_ts, round(avg(value), 6) AS mean_y, max(value) AS max_y, round(stddev_samp(value), 5) AS std_y, count(*) AS n FROM
(SELECT series_id, value, unnest(generate_series(time_bucket(INTERVAL '30 minutes', ts) + INTERVAL '30 minutes', time_bucket(INTERVAL '30 minutes', ts) + INTERVAL '3 hours', INTERVAL '30 minutes')) AS e FROM obs) GROUP BY 1, 2""", "obs")
def _(spark, sf):
    d = _done(spark, st.sliding(_closed(spark, sf), K, "3 hours", "30 minutes"), "sliding")
    return d.withColumn("mean_y", F.round("mean_y", 6)).withColumn("std_y", F.round("std_y", 5))


@query("ST4_counter_state", "SELECT series_id, ts, CASE WHEN prev IS NULL THEN 0.0 WHEN elapsed * 60.0 / 30 > 1.5 THEN rise ELSE least(rise, 4000) END AS use FROM daily_rise", "daily_rise")
def _(spark, sf):
    # A running total needs whole days, so the counter is prepared as a table and streamed from there.
    c = st.event_time(i.counter_daily(spark, sf))
    return _in_turns(spark, c, _by_time(c, "ts", 6), 6, lambda s: st.decode_counter(s, 30, 4000.0, True)).select(*K, "ts", "use")


@query("ST5_unchanged_suppression", CHECKS["SO6_collapse_unchanged"][1], CHECKS["SO6_collapse_unchanged"][0])
def _(spark, sf):
    e = i.external_log(spark, sf)
    rows = e.groupBy("experiment", "source", F.col("issued_at").cast("timestamp").alias("issued_at")).agg(
        F.sort_array(F.collect_list(F.struct(epoch("target_dt").alias("t"), F.round("value", 4).alias("v")))).alias("p")
    ).select("experiment", "source", "issued_at", F.col("p.t").alias("targets"), F.col("p.v").alias("vals"))
    d = _in_turns(spark, rows, _by_time(rows, "issued_at", 6), 6, st.suppress_unchanged)
    return d.groupBy("experiment", "source").agg(F.count_distinct("issued_at").alias("kept"))


@query("ST6_silence_sessions", """SELECT series_id, min(ts) AS started, max(ts) + INTERVAL '2 hours' AS silent_from, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM
(SELECT series_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY series_id ORDER BY ts) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS b FROM obs)) GROUP BY series_id, s""", "obs")
def _(spark, sf):
    return _done(spark, st.sessions(_closed(spark, sf), K, "2 hours"), "sessions")


@query("ST6_silent_series")
def _(spark, sf):
    schema = table(spark, sf, "events").schema
    e = st.event_time(st.read_files(spark, sf, schema, "events.parquet"))
    return _done(spark, st.silent_series(e.select(F.col("user_id").cast("string").alias("series_id"), "ts"), 3 * 3600), "silent")


@query("ST7_online_accuracy", "SELECT experiment, model_name, lead_minutes // 720 * 720 AS lead_bucket, sum(abs(predicted - actual)) AS abs_sum, sum((predicted - actual) ** 2) AS sq_sum, sum(predicted - actual) AS signed_sum, count(*) AS n FROM scored GROUP BY 1, 2, 3", "scored")
def _(spark, sf):
    # Stretches of time come one after the other and the watermark clears each, so the state is a few of them, not the whole log.
    # The forecasts of one target wait for its actual as one row.
    src_f, src_a, out = (st.new_folder(spark, n) for n in ("log", "actuals", "sums"))
    a = i.actuals(spark, sf).withColumn("grid_ts", F.col("grid_ts").cast("timestamp"))
    first, last = a.agg(F.min(epoch("grid_ts")), F.max(epoch("grid_ts"))).first()
    log = i.forecast_log(spark, sf).groupBy("experiment", F.col("target_dt").cast("timestamp").alias("target_dt")).agg(
        F.collect_list(F.struct("model_name", "lead_minutes", "predicted")).alias("forecasts"))
    turns = max(1, min(8, ((last or 0) - (first or 0)) // i.DAY))

    def turn(ts):
        width = ((last or 0) - (first or 0)) // turns + 1
        return F.greatest(F.lit(0), F.least(F.lit(turns - 1), F.floor((epoch(ts) - (first or 0)) / width)))

    sides = [(src_f, stored(log.withColumn("__turn", turn("target_dt")))), (src_a, stored(a.withColumn("__turn", turn("grid_ts"))))]
    for k in range(turns):
        for src, rows in sides:
            rows.filter(F.col("__turn") == k).drop("__turn").write.mode("append").parquet(src)
        f, m = (st.read_files(spark, src, rows.drop("__turn").schema) for src, rows in sides)
        scored = st.join_actuals(f, m).withColumn("f", F.explode("forecasts")).select("experiment", "f.*", "actual")
        st.run_available(scored, out, foreach=st.accumulate_sums(out, 720))
    return st.summed(spark, out)


@query("ST8_late_rewrite", "SELECT series_id, time_bucket(INTERVAL '30 minutes', ts) AS grid_ts, CAST(ts AS DATE) AS day, sum(round(value * 100)) AS value FROM obs GROUP BY 1, 2, 3", "obs")
def _(spark, sf):
    out, src = st.new_folder(spark, "rewrite"), st.new_folder(spark, "readings")
    # Two deliveries: every third reading arrives late, in the second one.
    late = F.col("event_id") % 3 == 0
    o = i.obs_type(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    for part in (o.filter(~late), o.filter(late)):
        part.repartitionByRange(8, "ts").write.mode("append").parquet(src)
    s = st.read_files(spark, src, spark.read.parquet(src).schema, per_batch=8)

    def bins(raw):
        return raw.groupBy(*K, time_bin("ts", 1800).alias("grid_ts"), "day").agg(F.sum(F.round(F.col("value") * 100)).alias("value"))

    st.run_available(s, out, foreach=st.rewrite_days(out, bins))
    return st.result(spark, out).select(*K, "grid_ts", "day", "value")
