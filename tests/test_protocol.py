"""Stored models forecast in another session what the direct functions forecast, and table functions read like the native ones."""

import random

import pytest
from pyspark.sql import functions as F

from tidegrid.functions import generators
from tidegrid.operators import forecast as fc
from tidegrid.operators import protocol as pr
from tidegrid.operators.features import inference_window, sliding_windows
from tidegrid.sources import records
from tidegrid.streaming.jobs import new_folder

K, SIX = ["series_id"], 21600


def by_lead(d):
    return {(r["series_id"], r["lead"]): r["pred"] for r in d.collect()}


def test_models_survive_the_session(frame, spark):
    rng = random.Random(4)
    grid = frame([(s, 360 * k, rng.uniform(0, 9)) for s, n in (("a", 60), ("b", 45), ("c", 3)) for k in range(n)], ts="grid_ts", value="y").cache()
    models = [*pr.standard(SIX), pr.DirectLinear("direct", 6, 5)]
    path = new_folder(spark, "models")
    pr.save_models(pr.fit_all(models, grid, K, SIX), path)
    other = spark.newSession()
    other.conf.set("spark.sql.session.timeZone", "UTC")
    got = pr.forecast_all(models, other.read.parquet(path), K, SIX, 5).collect()
    found = {(r["model"], r["series_id"], r["lead"]): r["pred"] for r in got}
    w = sliding_windows(grid, K, SIX, ["y"], 6, 5)
    direct = fc.direct_forecast(fc.direct_linear(w, 5), inference_window(grid, K, SIX, ["y"], 6), K, SIX).filter("status = 'ok'")
    want = {
        "baseline_mean": fc.baseline_forecast(grid, K, SIX, 5), "profile": fc.profile_forecast(grid, K, SIX, 5), "previous_day": fc.previous_day(grid, K, SIX, 5),
        "seasonal_naive": fc.seasonal_naive(grid, K, SIX, 5, 28), "daily_profile": fc.daily_profile(grid, K, SIX, 5),
        "theta": fc.exponential_smoothing(grid, K, SIX, 5, [0.3], theta=True), "direct": direct,
    }
    for name, d in want.items():
        assert {k[1:]: v for k, v in found.items() if k[0] == name} == pytest.approx(by_lead(d)), name
    with pytest.raises(ValueError):
        models[-1].forecast(other.read.parquet(path), K, SIX, 6)


def test_trajectory_cells_read_what_the_native_form_reads(spark):
    texts = ['{"2024-01-01T00:00:00": "1.5", "2024-01-01T01:00:00+01:00": 2}', '[{"period_start": "2024-01-01T02:00:00", "pv_estimate": "n/a"}, {"period_start": "2024-01-01T03:00:00", "pv_estimate": 4}]',
             "[]", "{}", "nonsense", "[1]", None]
    d = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "key string, text string")
    generators.register(spark)
    got = spark.sql("SELECT key, ts, value FROM trajectory_cells(TABLE(SELECT * FROM {d}) PARTITION BY key)", d=d)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, records.trajectory_points(d, "text").select("key", "ts", "value").collect()))
    spans = spark.createDataFrame([("a", 0, 7200), ("b", 3600, 0), ("c", None, 0)], "key string, lo long, hi long").select(
        "key", *[F.timestamp_seconds(c).cast("timestamp_ntz").alias(c) for c in ("lo", "hi")], F.lit(3600).alias("seconds"))
    cells = spark.sql("SELECT key, grid_ts FROM grid_cells(TABLE(SELECT * FROM {s}) PARTITION BY (key, lo))", s=spans).collect()
    assert sorted((r["key"], r["grid_ts"].hour) for r in cells) == [("a", 0), ("a", 1), ("a", 2)]
