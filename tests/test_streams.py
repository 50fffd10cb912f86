"""Streams fed in several batches give what the batch operators give."""

import numpy as np
from pyspark.sql import functions as F

from tidegrid.operators import counters as cn
from tidegrid.operators import sets as so
from tidegrid.operators.analytics import lead_sums
from tidegrid.plans import inputs as i
from tidegrid.streaming import jobs as st

from conftest import SMALL

K = ["series_id"]


def test_counter_state_survives_batches(spark):
    c = i.counter_daily(spark, SMALL)
    src, out = st.new_folder(spark, "c"), st.new_folder(spark, "o")
    for k in range(5):
        lo, hi = 1 + 6 * k, 7 + 6 * k
        c.filter((F.dayofmonth("ts") >= lo) & (F.dayofmonth("ts") < hi)).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(src)
    stream = st.read_files(spark, src, spark.read.parquet(src).schema, per_batch=1)
    st.run_available(st.decode_counter(stream, 30, 3000.0, True), out)
    got = st.result(spark, out).select(*K, F.col("ts").cast("timestamp_ntz").alias("ts"), "use")
    d = cn.running_high(c, K, 30, reset_daily=True)
    want = d.select(*K, "ts", F.when(F.col("first"), 0.0).when(F.col("gap_row"), F.col("rise")).otherwise(F.least("rise", F.lit(3000.0))).alias("w"))
    j = want.join(got, [*K, "ts"], "left").toPandas()
    assert len(j) == c.count()
    np.testing.assert_allclose(j["use"], j["w"])


def test_suppression_equals_collapse(spark):
    from tidegrid.plans.catalog import QUERIES

    key = ["experiment", "source"]
    a = QUERIES["ST5_unchanged_suppression"](spark, SMALL).toPandas().sort_values(key).reset_index(drop=True)
    b = QUERIES["SO6_collapse_unchanged"](spark, SMALL).toPandas().sort_values(key).reset_index(drop=True)
    assert a.equals(b)


def test_collapse_compares_with_the_last_kept(spark):
    rows = [("e", "s", f"2024-01-01 0{h}:00:00", "2024-01-02 00:00:00", v) for h, v in enumerate([100.0, 100.4, 100.8, 101.2, 101.3])]
    log = spark.createDataFrame(rows, "experiment string, source string, issued_at string, target_dt string, value double").withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("issued_at", "target_dt")})
    kept = sorted(r["value"] for r in so.collapse_unchanged(log).collect())
    assert kept == [100.0, 100.8]


def test_sums_of_slices_add_up(spark):
    e, a = i.external_log(spark, SMALL), i.actuals(spark, SMALL)
    whole = lead_sums(e, a, 720).agg(F.sum("n")).first()[0]
    part = F.col("issued_at") < F.lit("2024-01-10").cast("timestamp_ntz")
    assert whole == lead_sums(e.filter(part), a, 720).agg(F.sum("n")).first()[0] + lead_sums(e.filter(~part), a, 720).agg(F.sum("n")).first()[0]
