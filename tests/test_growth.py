"""Plans and results that matter on larger or odder tables than the given ones."""

from __future__ import annotations

import datetime
import zoneinfo

import pytest
from pyspark.sql import functions as F

from conftest import SMALL

import __spark_entry__ as entry
from tidegrid.functions import metrics
from tidegrid.functions.pandas_metrics import metric_by, pandas_metric
from tidegrid.operators import align, features, grid, horizon, ranking, sets, transform
from tidegrid.plans import inputs
from tidegrid.streaming import jobs as st


def _plan(df) -> list[str]:
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def test_issuances_are_merged_not_broadcast(spark):
    log = spark.range(40).select(
        F.lit("x").alias("experiment"), F.lit("a").alias("source"), (F.col("id") * 43200).cast("timestamp").cast("timestamp_ntz").alias("issued_at"),
        F.explode(F.sequence(F.lit(1), F.lit(8))).alias("k"), (F.col("id") * 1.0).alias("value"),
    ).withColumn("target_dt", F.timestamp_seconds(F.unix_seconds(F.col("issued_at").cast("timestamp")) + F.col("k") * 21600).cast("timestamp_ntz"))
    d = sets.changed_since_previous(log)
    assert not [x for x in _plan(d) if "BroadcastHashJoin" in x and ("issued_at" in x or "__prev" in x)]
    assert d.filter("changed").count() == 40


def _points(spark, origins=90):
    d = spark.range(origins).select(
        F.explode(F.array(F.lit("x"), F.lit("y"))).alias("series_id"), F.timestamp_seconds(F.col("id") * 43200).cast("timestamp_ntz").alias("origin"))
    d = d.withColumn("model", F.explode(F.array(F.lit("a"), F.lit("b")))).withColumn("lead", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(4).cast("long"))))
    d = d.withColumn("target_dt", F.timestamp_seconds(F.unix_seconds(F.col("origin").cast("timestamp")) + F.col("lead") * 21600).cast("timestamp_ntz"))
    noise = F.pmod(F.xxhash64("series_id", "origin", "model", "lead"), F.lit(1000)) / 7.0
    d = d.withColumn("point", 100 + noise).withColumn("actual", F.when(F.col("lead") + F.day("origin") % 9 != 2, 120 + F.pmod(F.xxhash64("target_dt"), F.lit(97))))
    return d.withColumn("usable", F.col("actual").isNotNull())


def test_horizon_points_are_dealt_once(spark):
    """One pass over whole series; no join with quantiles, whose arrays would be shuffled and stored."""
    d = horizon.by_lead(horizon.scorable(horizon.residual_quantiles(_points(spark), ["series_id"], 4, 21600), ["series_id"]), ["series_id"], 2)
    plan = "\n".join(_plan(d))
    assert plan.count("FlatMapGroupsInArrow") == 1 and "Join" not in plan
    assert d.count() == 8


@pytest.mark.parametrize("condition", ["lead", "slot", "level"])
def test_long_series_get_the_same_quantiles(spark, condition):
    def rows(limit):
        d = horizon.residual_quantiles(_points(spark), ["series_id"], 4, 21600, condition, 2, series_rows=limit)
        return {(r.series_id, r.model, r.origin, r.lead): (r.complete, r.q and [round(x, 6) for x in r.q]) for r in d.collect()}

    small, large = rows(1 << 16), rows(0)
    assert small == large
    assert any(q for _, q in small.values()) and any(c for c, _ in small.values()) and not all(c for c, _ in small.values())


def test_reach_counts_observations_at_equal_times(frame):
    obs = frame([("a", 0, 1.0)] * 9 + [("a", 60 * 24, 2.0)])
    # eight gaps of 0 and one of a day: the 90th percentile lies a fifth of the way between the two largest
    assert [round(r.reach) for r in align.asof_reach(obs, ["series_id"], 3600).collect()] == [34560]


def test_a_fold_does_not_fill_its_head_from_later_values(frame):
    d = frame([("a", 0, None), ("a", 360, 5.0), ("a", 720, None), ("a", 1080, 9.0)], ts="grid_ts", value="y")
    rows = features.fold_rebuild(d, ["series_id"], 360, windows=[3], n_lags=2).orderBy("grid_ts").collect()
    assert [r.y_lag_1 for r in rows] == [None, None, 5.0, 5.0]


def test_counter_readings_of_one_time_are_all_scored(spark):
    src, out = st.new_folder(spark, "equal"), st.new_folder(spark, "out")
    for rows in ([(10, 100.0), (20, 107.0), (20, 104.0)], [(20, 109.0), (30, 110.0)]):
        d = spark.createDataFrame(rows, "m long, value double").select(F.lit("a").alias("series_id"), F.timestamp_micros(F.col("m") * 60_000_000).alias("ts"), "value")
        d.coalesce(1).write.mode("append").parquet(src)
        st.run_available(st.decode_counter(st.read_files(spark, src, d.schema), 30, 50.0), out)
    assert [r["use"] for r in st.result(spark, out).orderBy("ts", "value").collect()] == [0.0, 4.0, 3.0, 2.0, 1.0]


def test_a_constant_series_has_no_autocorrelation(frame):
    d = frame([("a", 360 * k, 5.0) for k in range(12)] + [("b", 360 * k, float(k % 4)) for k in range(12)], ts="grid_ts", value="y")
    got = {r.series_id: r.daily_autocorr for r in transform.daily_autocorr(d, ["series_id"], 21600).collect()}
    assert got["a"] is None and got["b"] > 0.8


def test_a_met_row_is_a_joined_row(spark):
    """Duplicates multiply and nulls match nothing, as in a join."""
    left = spark.createDataFrame([("a", 1, 10.0), ("a", 1, 11.0), ("a", 2, 12.0), (None, 1, 13.0), ("b", None, 14.0)], "k string, t long, v double")
    right = spark.createDataFrame([("a", 1, 1.0), ("a", 1, None), ("c", 2, 3.0), (None, 1, 4.0), ("b", None, 5.0)], "k string, t long, w double")
    for how in ("inner", "left"):
        got, want = align.meet(left, right, ["k", "t"], how), left.join(right, ["k", "t"], how).select("k", "t", "v", "w")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_grid_dealt_by_series_is_the_same_grid(frame):
    d = frame([("a", 0, 1.0), ("a", 10, 2.0), ("a", 60 * 24 * 80, 3.0), ("b", 360, None), ("b", 720, 4.0)])
    for empty in (0.0, None):
        plain, dealt = (grid.resample(d, ["series_id"], 21600, "sum", empty_sum=empty, tasks=n) for n in (None, 3))
        assert sorted(map(str, plain.collect())) == sorted(map(str, dealt.collect())) and plain.columns == dealt.columns


def _shuffles_of_forecasts(df) -> list[str]:
    return [x for x in _plan(df) if "Exchange hashpartitioning" in x and ("target_dt" in x or "ENSURE_REQUIREMENTS" in x and "grid_ts" in x)]


@pytest.mark.parametrize("name", ["HZ2_residual_quantiles", "HZ3_by_lead", "AG6_daily_cum_accuracy", "AG9_signed_residuals", "AG10_coverage_by"])
def test_forecasts_meet_actuals_where_they_are(spark, name):
    """The bins are dealt by series; the many forecasts made from them are neither shuffled nor met by broadcasts."""
    d = entry.queries()[name](spark, SMALL)
    assert not _shuffles_of_forecasts(d) and not [x for x in _plan(d) if "BroadcastHashJoin" in x and "target_dt" in x]


def test_horizons_are_filled_where_they_are(spark):
    """A horizon is short, so its cells need no summaries by stretch, nor the shuffles that carry them over."""
    plan = _plan(entry.queries()["JN6_interp_align_future"](spark, SMALL))
    assert not [x for x in plan if "Join" in x or "Exchange hashpartitioning(experiment" in x and "ENSURE_REQUIREMENTS" in x]


def test_unchanged_issuances_of_long_and_short_keys(spark):
    """Rows walked in a task and rows linked over tasks keep the same issuances; nothing of a key is stored or shuffled again."""
    value = F.when(F.col("id") % 11 == 3, None).when(F.col("id") % 13 == 5, float("nan")).when(F.col("id") % 17 == 2, float("inf")).otherwise(100 + F.floor(F.col("id") / 4) * 0.3)
    log = spark.range(60).select(
        F.explode(F.array(F.lit("x"), F.lit("y"), F.lit(None))).alias("experiment"), F.lit("a").alias("source"),
        F.timestamp_seconds(F.col("id") * 3600).cast("timestamp_ntz").alias("issued_at"), "id", value.alias("value"))
    log = log.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(3)))).select(
        "experiment", "source", "issued_at", F.timestamp_seconds(F.floor(F.col("id") / 20 + F.col("k")) * 86400).cast("timestamp_ntz").alias("target_dt"),
        F.when(F.col("experiment") == "y", F.col("value") + F.col("k") * (F.col("id") % 7)).otherwise(F.col("value")).alias("value"))
    log = log.withColumn("target_dt", F.when(F.pmod(F.xxhash64("issued_at", "target_dt"), F.lit(9)) > 0, F.col("target_dt")))
    short, long = (sorted(map(str, sets.collapse_unchanged(log, series_rows=n).collect())) for n in (1 << 16, 0))
    assert short == long and 6 < len(short) < log.count()
    dealt = log.repartition(4, "experiment")
    assert sum("Exchange hashpartitioning" in x for x in _plan(sets.collapse_unchanged(dealt))) == 1


def test_suppressed_series_share_a_state(spark):
    """Many series to a call and a state, and a state that outlives a delivery."""
    d = spark.range(30).select(
        F.concat(F.lit("e"), F.col("id") % 5).alias("experiment"), F.lit("s").alias("source"), F.timestamp_seconds(F.col("id") * 3600).alias("issued_at"),
        F.array(F.lit(1).cast("long")).alias("targets"), F.array(100 + 0.4 * F.floor(F.col("id") / 5)).alias("vals"))
    got = []
    for shares in (1, 7):
        src, out = st.new_folder(spark, "shares"), st.new_folder(spark, "out")
        for a in (0, 10, 20):
            d.filter(f"vals[0] >= {100 + 0.4 * a / 5 - 0.1} AND vals[0] < {100 + 0.4 * (a + 10) / 5 - 0.1}").coalesce(1).write.mode("append").parquet(src)
            st.run_available(st.suppress_unchanged(st.read_files(spark, src, d.schema), shares), out)
        got.append(sorted(map(str, st.result(spark, out).collect())))
    # 100.0, then the first that is over 0.5 % away: 100.8, 101.6
    assert got[0] == got[1] and len(got[0]) == 15


def test_online_scores_come_by_stretches_of_time(spark, monkeypatch):
    """The whole log at once would be the state of the join."""
    runs, run = [], st.run_available
    monkeypatch.setattr(st, "run_available", lambda *a, **k: (runs.append(a[1]), run(*a, **k)))
    got = entry.queries()["ST7_online_accuracy"](spark, SMALL).agg(F.sum("n")).first()[0]
    rows = align.forecast_actual(inputs.forecast_log(spark, SMALL), inputs.actuals(spark, SMALL)).count()
    assert got == rows > 0 and len(runs) > 4 and len(set(runs)) == 1


def test_pairs_of_errors_are_made_in_the_task(spark):
    """Short and long series, also with nulls, get the same test; no pair of errors is shuffled."""
    d = spark.range(90).select(
        F.explode(F.array(F.lit("x"), F.lit("y"), F.lit(None))).alias("series_id"), F.timestamp_seconds(F.col("id") * 3600).cast("timestamp_ntz").alias("grid_ts"), "id")
    d = d.withColumn("model", F.explode(F.array(*map(F.lit, "abc")))).withColumn("err", F.when(F.col("id") % 13 != 4, F.sin(F.col("id") + F.length("series_id")) + F.ascii("model") % 5))
    d = d.filter("NOT (model = 'c' AND id % 3 = 1)")
    one, other = (sorted((r.series_id, r.model_a, r.model_b, r.n, round(r.dm, 6), round(r.p_value, 6)) for r in ranking.dm_all_pairs(d, ["series_id"], "grid_ts", series_rows=n).collect()) for n in (1 << 16, 0))
    assert one == other and len(one) == 6
    pairs = ranking._pairs(d.dropna(subset=["series_id"]), ["series_id", "grid_ts"], "err").withColumnsRenamed({"va": "ea", "vb": "eb"})
    single = ranking.diebold_mariano(pairs, ["series_id", "model_a", "model_b"], "grid_ts")
    assert sorted((r.series_id, r.model_a, r.model_b, r.n, round(r.dm, 6), round(r.p_value, 6)) for r in single.collect()) == one
    plan = "\n".join(_plan(ranking.dm_all_pairs(d, ["series_id"], "grid_ts")))
    assert plan.count("FlatMapGroupsInArrow") == 1 and "Join" not in plan


def test_small_groups_of_a_metric_are_handed_over_together(spark):
    d = spark.range(300).select(
        F.when(F.col("id") % 7 > 0, F.col("id") % 4).cast("string").alias("series_id"), (F.col("id") % 5).alias("fold"),
        F.when(F.col("id") % 11 != 3, F.col("id") * 1.5).alias("y"), F.when(F.col("id") % 5 != 2, F.col("id") * 1.0).alias("pred"))
    fn = lambda y, p: (y - p).abs().mean()
    got, want = metric_by(d, ["series_id", "fold"], fn, ["series_id"]), d.groupBy("series_id", "fold").agg(pandas_metric(fn)("y", "pred").alias("metric"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert not [x for x in _plan(got) if "Exchange hashpartitioning" in x and "fold" in x.split("ENSURE")[0].split("hashpartitioning")[1]]


def test_resamples_of_many_series_share_their_draws(spark):
    """The numbers of the draws made row by row in SQL, one pass over the ranks, nothing met twice."""
    ranks = spark.range(900).select(
        (F.col("id") % 60).cast("string").alias("series_id"), F.concat(F.lit("m"), F.col("id") % 3).alias("model"), F.floor(F.col("id") / 180).alias("fold"),
        F.when(F.col("id") != 7, F.pmod(F.xxhash64("id"), F.lit(29)) / 7).alias("fold_rank")).filter("id % 60 > 9 OR fold < id % 4")
    got = ranking.rank_bootstrap(ranks, ["series_id"], 200)
    v = F.transform(F.sort_array(F.collect_list(F.struct("fold", "fold_rank"))), lambda e: e["fold_rank"])
    plain = ranks.groupBy("series_id", "model").agg(v.alias("v")).withColumn("n", F.size("v")).filter("n >= 2")
    mean = lambda xs, n: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / n
    plain = plain.withColumn("m", F.sort_array(ranking._resampled(F.col("v"), F.col("n"), 200, 42, mean)))
    plain = plain.select("series_id", "model", ranking._array_quantile(F.col("m"), 0.025).alias("rank_lo"), ranking._array_quantile(F.col("m"), 0.975).alias("rank_hi"))
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect())) and got.count() > 50
    ranked = ranking.composite_rank(ranks, ["series_id"], ["m0", "m1", "m2"]).join(got, ["series_id", "model"], "left")
    assert "\n".join(_plan(ranking.tie_flags(ranked, ["series_id"]))).count("MapInArrow") == 1


def test_trajectories_are_read_where_they_are_made(spark):
    """A table function that keeps nothing between rows needs no shuffle of the payloads, nor a call for each of them."""
    plan = _plan(entry.queries()["UD3_trajectory_cells"](spark, SMALL))
    assert [x for x in plan if "ArrowEvalPythonUDTF" in x] and not [x for x in plan if "Exchange hashpartitioning(key" in x]


@pytest.mark.parametrize("name", ["AG18_head_to_head", "AG22_leadcurve_sums"])
def test_external_forecasts_meet_where_they_are(spark, name):
    """Own and external forecasts and actuals lie together; on larger tables a join would shuffle all of them."""
    plan = _plan(entry.queries()[name](spark, SMALL))
    assert not [x for x in plan if "Join" in x and ("grid_ts" in x or "target_dt" in x)]


def test_rounding_in_binary_is_rounding(spark):
    """Half ways, neighbours of half ways, large and odd values."""
    rows = [k / 16000 for k in range(40000)] + [0.0005, 1.0005, 2.3455, 1e9 + 0.0005, 8e11 + 0.0625, 4.5e15, 1e300, 2.5e-324, float("nan"), float("inf"), None]
    d = spark.createDataFrame([(x,) for r in rows for x in ([r] if r is None else [r, -r])], "v double")
    assert d.filter(~metrics.rounded(F.col("v"), 3).eqNullSafe(F.round("v", 3))).count() == 0


def test_crps_of_odd_rows(spark):
    levels = metrics.QUANTILE_LEVELS
    rows = [(2.0, [0.3 * k for k in range(19)]), (float("nan"), [1.0] * 19), (1.0, [1.0] * 18 + [None]), (1.0, [1.0] * 18), (None, [1.0] * 19), (1.0, None)]
    got = [r.c for r in spark.createDataFrame(rows, "y double, q array<double>").select(metrics.crps(F.col("y"), F.col("q")).alias("c")).collect()]
    assert abs(got[0] - 2 * sum(max(p * (2 - v), (p - 1) * (2 - v)) for p, v in zip(levels, rows[0][1])) / 19) < 1e-12
    assert got[1] != got[1] and got[2:] == [None] * 4


@pytest.mark.parametrize("name", ["HZ2_level_quantiles", "HZ3_by_lead"])
def test_rows_of_horizons_are_compiled(spark, name):
    """Nothing is done to each of the many points by lambdas, which are interpreted; sizes are counted before actuals are met."""
    d = entry.queries()[name](spark, SMALL)
    assert not [x for x in _plan(d) if "lambdafunction" in x]


@pytest.mark.parametrize("tz", ["UTC", "America/New_York"])
def test_totals_of_first_days(spark, tz):
    """Forecasts and cells meet in one aggregation; origins whose first day is not whole, or that have no second day, are left out."""
    zone = zoneinfo.ZoneInfo(tz)
    points = _points(spark, 20).filter("NOT (series_id = 'y' AND lead > 1 AND day(origin) = 3)")
    points = points.unionByName(points.withColumns({"series_id": F.lit(None).cast("string")}).limit(9)).localCheckpoint()
    cells = points.filter("usable AND series_id IS NOT NULL").localCheckpoint()
    got = horizon.period_totals(cells, points, ["series_id"], tz)
    assert not [x for x in _plan(got) if "Join" in x]
    origins, want = {}, {}
    day = lambda t: t.replace(tzinfo=datetime.UTC).astimezone(zone).date()
    for r in points.collect():
        origins.setdefault((r.series_id, r.model, r.origin), []).append(r.target_dt)
    for (series, model, origin), targets in origins.items():
        first = min(targets)
        mine = [r for r in cells.filter((F.col("series_id") == series) & (F.col("model") == model) & (F.col("origin") == origin)).collect() if day(r.target_dt) == day(first)] if series else []
        if mine and day(max(targets)) > day(first) and len(mine) == sum(day(t) == day(first) for t in targets):
            hour = first.replace(tzinfo=datetime.UTC).astimezone(zone).hour
            want.setdefault((series, model, float(hour)), []).append(sum(r.point - r.actual for r in mine))
    assert want and {(r.series_id, r.model, r.issue_hour): (r.n, round(r.bias, 6), round(r.rmse, 6)) for r in got.collect()} == {
        k: (len(v), round(sum(v) / len(v), 6), round((sum(x * x for x in v) / len(v)) ** 0.5, 6)) for k, v in want.items()}


def test_scores_and_totals_are_made_once(spark):
    """The guardrail's limit comes from the rows that are there; a join would make all scores and totals again for it."""
    points = _points(spark, 60).withColumn("model", F.when(F.col("model") == "a", horizon.GUARDRAIL).otherwise(F.col("model")))
    cells = points.filter("usable").withColumns({"crps": F.abs(F.col("point") - F.col("actual")), "band": F.struct(F.col("point").alias("lo"), (F.col("point") + 9).alias("hi"))}).localCheckpoint()
    totals = horizon.period_totals(cells, points, ["series_id"])
    got = horizon.eligibility(horizon.scores(cells, ["series_id"]), totals, ["series_id"])
    assert sum("Join" in x for x in _plan(got)) == 1
    rmse = {(r.series_id, r.model): r.period_total_rmse for r in horizon.period_total_rmse(totals, ["series_id"]).collect()}
    rows = got.collect()
    assert len(rows) == len(rmse) == 4
    for r in rows:
        limit = horizon.TOTAL_TOLERANCE * rmse[r.series_id, horizon.GUARDRAIL]
        assert abs(r.limit - limit) < 1e-9 and r.eligible == (rmse[r.series_id, r.model] <= limit)
    alone = horizon.eligibility(horizon.scores(cells.filter("model = 'b'"), ["series_id"]), totals, ["series_id"]).collect()
    assert [(r.limit, r.eligible) for r in alone] == [(None, True)] * 2


@pytest.mark.parametrize("missing", [0, 1])
def test_resampled_days_share_their_draws(spark, missing):
    """The numbers of the draws made row by row in SQL; nothing is resampled by lambdas."""
    losses = spark.range(2600).select(
        (F.col("id") % 40).cast("string").alias("series_id"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("model"),
        F.timestamp_seconds(F.floor(F.col("id") / 40) * 43200).cast("timestamp_ntz").alias("origin")).filter("series_id > 9 OR origin < timestamp_ntz'1970-01-05'")
    value = F.pmod(F.xxhash64("series_id", "origin", "model"), F.lit(1009)) / 7.0
    # of two of the series a whole day is missing, or single losses
    losses = losses.withColumn("crps", F.when(F.lit(missing == 0) | (F.col("series_id") > 1) | (F.day("origin") != 2) | (F.col("series_id") == 1) & (F.hour("origin") == 0), value)).localCheckpoint()
    got = horizon.paired_difference(losses, ["series_id"], "a", "b", n_boot=300)
    assert not [x for x in _plan(got) if "aggregate(" in x]
    d = losses.filter("model = 'a'").withColumnRenamed("crps", "a").join(losses.filter("model = 'b'").withColumnRenamed("crps", "b"), ["series_id", "origin"]).withColumn("d", F.col("a") - F.col("b"))
    days = d.groupBy("series_id", F.to_date("origin").alias("day")).agg(F.sum("d").alias("s"), F.count("d").cast("double").alias("c"))
    g = days.groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("day", "s", "c"))).alias("x"), (F.sum("s") / F.sum("c")).alias("mean")).withColumn("n_days", F.size("x"))
    total = lambda xs, n: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x["s"]) / F.aggregate(xs, F.lit(0.0), lambda a, x: a + x["c"])
    g = g.withColumn("m", F.sort_array(ranking._resampled(F.col("x"), F.col("n_days"), 300, 0, total)))
    want = g.select("series_id", "mean", ranking._array_quantile(F.col("m"), 0.025).alias("lo"), ranking._array_quantile(F.col("m"), 0.975).alias("hi"), "n_days")
    assert sorted(map(str, got.drop("verdict").collect())) == sorted(map(str, want.collect())) and got.count() == 40
    assert (got.filter("lo IS NULL").count() > 0) == (missing > 0)
