"""Rules that no query can show: failing policies, one-sided fills, late rows, folders on a cluster."""

import pytest
from pyspark.sql import functions as F

from tidegrid import session
from tidegrid.operators import netload as ls
from tidegrid.operators import transform as tr
from tidegrid.streaming import jobs as st

K = ["series_id"]


@pytest.mark.parametrize(("fill", "want"), [("ffill", [None, None, 8, 8, 6, 6]), ("bfill", [8, 8, 8, 6, 6, 6]), ("interpolate", [None, None, 8, 7, 6, 6])])
def test_fills_are_one_sided(frame, fill, want):
    load = frame([("a", 60 * k, 10) for k in range(6)], ts="grid_ts", value="y")
    sub = frame([("a", 120, 2), ("a", 240, 4)], ts="grid_ts", value="y")
    out = ls.subtract_series(load, sub, K, 3600, fill).orderBy("grid_ts").collect()
    assert [r["y"] for r in out] == want


def test_silent_sensors(spark, frame):
    load = frame([("a", 60 * k, 10) for k in range(3)], ts="grid_ts", value="y")
    sensors = frame([("a", 60, 4)], ts="grid_ts", value="y").withColumn("entity_id", F.lit("s"))

    def net(policy, sensors=sensors):
        config = spark.createDataFrame([("a", "s", 1.0, policy, 1.0, 5.0)], "series_id string, entity_id string, scale double, on_missing string, max_fraction double, max_violation_pct double")
        return [r["net"] for r in ls.load_subtract(load, sensors, config, K).orderBy("grid_ts").collect()]

    assert net("zero") == [10, 6, 10] and net("drop") == [6]
    for policy in ("error", "ignore", None):
        with pytest.raises(Exception, match="sensor s is silent"):
            net(policy)
    everywhere = frame([("a", 60 * k, 1) for k in range(3)], ts="grid_ts", value="y").withColumn("entity_id", F.lit("s"))
    assert net("error", everywhere) == [9, 9, 9]


def test_guard_counts_what_it_does_not_name(spark):
    rows = [(f"s{k}", 10.0 + k, True) for k in range(8)]
    with pytest.raises(ls.SubtractError, match="and 3 more"):
        ls.enforce_guard(spark.createDataFrame(rows, "entity_id string, violation_pct double, violated boolean"))


def test_short_series_stay_in_the_drift_table(frame):
    train = frame([("a", k, k % 7) for k in range(30)] + [("b", k, k) for k in range(3)], value="y")
    test = frame([("a", k, k % 7) for k in range(30)] + [("c", k, k) for k in range(30)], value="y")
    out = {r["series_id"]: (r["train_n"], r["test_n"], r["verdict"]) for r in tr.psi_drift(train, test, K).collect()}
    assert out == {"a": (30, 30, "stable"), "b": (3, 0, "insufficient"), "c": (0, 30, "insufficient")}


def test_late_rows_are_kept_while_their_key_is_unseen(spark):
    src, out = st.new_folder(spark, "late"), st.new_folder(spark, "out")
    deliveries = [[("a", "2024-01-05 00:00:00", 1.0), ("a", "2024-01-05 00:00:00", 1.0)], [("a", "2024-01-01 00:00:00", 2.0)], [("a", "2024-01-05 00:00:00", 9.0), ("b", "2024-01-01 00:00:00", 3.0)]]
    for rows in deliveries:
        d = spark.createDataFrame(rows, "series_id string, at string, value double").select("series_id", F.col("at").cast("timestamp").alias("ts"), "value")
        d.coalesce(1).write.mode("append").parquet(src)
        stream = st.read_files(spark, src, d.schema)
        st.run_available(stream, out, foreach=st.first_write_wins(out, K))  # each delivery is a run of its own
    got = sorted((r["series_id"], r["value"]) for r in st.result(spark, out).collect())
    assert got == [("a", 1.0), ("a", 2.0), ("b", 3.0)]


def test_late_counter_readings_are_marked(spark):
    src, out = st.new_folder(spark, "late"), st.new_folder(spark, "out")
    for rows in ([(10, 100.0), (30, 104.0)], [(20, 102.0), (40, 105.0)]):
        d = spark.createDataFrame(rows, "m long, value double").select(F.lit("a").alias("series_id"), F.timestamp_micros(F.col("m") * 60_000_000).alias("ts"), "value")
        d.coalesce(1).write.mode("append").parquet(src)
        st.run_available(st.decode_counter(st.read_files(spark, src, d.schema), 30, 50.0), out)
    assert [r["use"] for r in st.result(spark, out).orderBy("ts").collect()] == [0.0, None, 4.0, 1.0]


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": lambda self, key, default=None: default})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
