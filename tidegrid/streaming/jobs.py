"""The batch semantics as Structured Streaming jobs.

Event times must be ``timestamp`` here (watermarks do not take ``timestamp_ntz``);
``event_time`` casts. Results go to folders that a replayed batch overwrites.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidegrid.functions.timecols import lead_bucket
from tidegrid.operators.counters import RESTART_RATIO
from tidegrid.operators.sets import _moved
from tidegrid.session import shared_dir


# States that suppressed series are dealt to.
SHARES = 512


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def read_files(spark: SparkSession, path: str, schema, pattern: str = "*.parquet", per_batch: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if per_batch:
        r = r.option("maxFilesPerTrigger", per_batch)
    return r.parquet(path)


def new_folder(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def run_available(stream: DataFrame, out: str, mode: str = "append", foreach: Callable | None = None) -> None:
    """Process what is there and stop; a later run goes on from the same folder."""
    w = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", os.path.join(out, "_state"))
    w = w.foreachBatch(foreach) if foreach else w.format("parquet").option("path", os.path.join(out, "data"))
    w.start().awaitTermination()


def result(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(os.path.join(out, "data"))


def first_write_wins(out: str, keys, ts: str = "ts", arrival: str | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch: of each (keys, ts) the row that came first stays, however late it is.

    A batch is checked against the keys stored by earlier batches, restricted to
    the days it touches; its rows go to a folder of its own, so a replay
    overwrites. Of equal keys within a batch the one with the smallest
    ``arrival`` is taken, without that column any one.
    """
    key = [*keys, ts]

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if arrival:
            others = [c for c in batch.columns if c not in key]
            first = batch.groupBy(*key).agg(F.min_by(F.struct(*others), arrival).alias("__r"))
            rows = first.select(*key, *[F.col("__r")[c].alias(c) for c in others])
        else:
            rows = batch.dropDuplicates(key)
        rows = rows.withColumn("day", F.to_date(ts))
        if batch_id:
            days = rows.select("day").distinct()
            stored = result(spark, out).filter(F.col("batch_id") < batch_id).join(days, "day", "left_semi")
            held = stored.select(*[F.col(k).alias(f"__{k}") for k in key])
            match = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]
            rows = rows.join(held, match, "left_anti")
        rows.write.mode("overwrite").partitionBy("day").parquet(os.path.join(out, "data", f"batch_id={batch_id}"))

    return write


END = "end of stream"


def append_end(spark: SparkSession, path: str, key: str, after: str, ts: str = "ts") -> None:
    """Add a reading of the made-up series ``END`` later than all others, so that the watermark passes every open window.
    Its own window stays open and is never given out."""
    d = spark.read.parquet(path)
    last = d.agg(F.max(ts).alias(ts)).select((F.col(ts) + F.expr(f"interval {after}")).alias(ts), F.lit(END).alias(key))
    others = [F.lit(None).cast(f.dataType).alias(f.name) for f in d.schema if f.name not in (ts, key)]
    last.select(ts, key, *others).select(*d.columns).write.mode("append").parquet(path)


def tumbling(stream: DataFrame, keys, width: str, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    d = stream.withWatermark(ts, delay).groupBy(*keys, F.window(ts, width)).agg(
        F.sum("value").alias("sum_y"), F.avg("value").alias("mean_y"), F.count(F.lit(1)).alias("n"))
    return d.select(*keys, F.col("window.start").alias("grid_ts"), "sum_y", "mean_y", "n")


def sliding(stream: DataFrame, keys, width: str, step: str, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Rolling statistics of the window that ends at each step."""
    d = stream.withWatermark(ts, delay).groupBy(*keys, F.window(ts, width, step)).agg(
        F.avg("value").alias("mean_y"), F.max("value").alias("max_y"), F.stddev_samp("value").alias("std_y"), F.count(F.lit(1)).alias("n"))
    return d.select(*keys, F.col("window.end").alias("grid_ts"), "mean_y", "max_y", "std_y", "n")


def _decode(key, batches: Iterator[pd.DataFrame], state: GroupState, interval_minutes: int, cap: float, reset_daily: bool):
    prev, high, seen = state.get if state.exists else (None, None, None)
    rows = pd.concat(list(batches)).sort_values(["ts", "value"])
    out = []
    for ts, v in zip(rows["ts"], rows["value"]):
        at = ts.value // 1000
        if seen is not None and at < seen:
            out.append((*key, ts, v, None))  # older than what has been scored already: kept, without a use of its own
            continue
        use = 0.0
        if prev is None:
            high = v
        else:
            gap = (at - seen) / 6e7 / interval_minutes > 1.5
            midnight = reset_daily and at // 86_400_000_000 != seen // 86_400_000_000
            if v < RESTART_RATIO * prev or (midnight and v < prev):
                use, high = v, v
            else:
                use, high = max(v - high, 0.0), max(v, high)
            use = use if gap else min(use, cap)
        out.append((*key, ts, v, use))
        prev, seen = v, at
    if seen is not None:
        state.update((float(prev), float(high), int(seen)))
    yield pd.DataFrame(out, columns=["series_id", "ts", "value", "use"]).astype({"use": "float64"})


def decode_counter(stream: DataFrame, interval_minutes: int, cap: float, reset_daily: bool = False) -> DataFrame:
    """Use per reading above the running high, with a fixed cap; state is three numbers per series. A reading that comes after a
    later one has been scored gets a null use; readings of one time are scored in the order of their values."""
    def fn(key, batches, state):
        return _decode(key, batches, state, interval_minutes, cap, reset_daily)

    return stream.groupBy("series_id").applyInPandasWithState(
        fn, "series_id string, ts timestamp, value double, use double", "prev double, high double, seen long", "append",
        GroupStateTimeout.NoTimeout)


def _suppress(batches: Iterator[pd.DataFrame], state: GroupState):
    kept = {}
    if state.exists:
        *names, many, targets, vals = state.get
        z = 0
        for *name, n in zip(*names, many):
            a, z = z, z + n
            kept[tuple(name)] = dict(zip(targets[a:z], vals[a:z]))
    rows = pd.concat(list(batches)).sort_values("issued_at")
    out = []
    for *name, issued, ts, vs in zip(*(rows[c] for c in ("experiment", "source", "issued_at", "targets", "vals"))):
        new, last = dict(zip(ts.tolist(), vs.tolist())), kept.get(tuple(name))
        if last is None or _moved(new, last):
            kept[tuple(name)] = new
            out.append((*name, issued))
    if kept:
        state.update((*map(list, zip(*kept)), [len(k) for k in kept.values()], [t for k in kept.values() for t in k], [v for k in kept.values() for v in k.values()]))
    yield pd.DataFrame(out, columns=["experiment", "source", "issued_at"])


def suppress_unchanged(stream: DataFrame, shares: int = SHARES) -> DataFrame:
    """Issuances (experiment, source, issued_at, targets, vals) that differ from the last kept one.

    Series are dealt by hash to ``shares`` states, as a call for each series costs more than its rows; a state holds the last
    kept issuance of every series of its share. A running stream has to keep its number of shares.
    """
    shared = stream.withColumn("share", F.pmod(F.xxhash64("experiment", "source"), F.lit(shares)))
    return shared.groupBy("share").applyInPandasWithState(
        lambda key, batches, state: _suppress(batches, state), "experiment string, source string, issued_at timestamp",
        "experiments array<string>, sources array<string>, many array<int>, targets array<long>, vals array<double>", "append",
        GroupStateTimeout.NoTimeout)


def sessions(stream: DataFrame, keys, gap: str, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Stretches without silence longer than ``gap``."""
    d = stream.withWatermark(ts, delay).groupBy(*keys, F.session_window(ts, gap)).agg(F.count(F.lit(1)).alias("n"))
    return d.select(*keys, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("silent_from"), "n")


def _silence(key, batches: Iterator[pd.DataFrame], state: GroupState, gap_ms: int):
    if state.hasTimedOut:
        last = state.get[0]
        state.remove()
        yield pd.DataFrame({"series_id": [key[0]], "last_seen": [pd.Timestamp(last, unit="us")]})
        return
    last = max((b["ts"].max().value // 1000 for b in batches if len(b)), default=None)
    if state.exists:
        last = state.get[0] if last is None else max(last, state.get[0])
    if last is not None:
        state.update((int(last),))
        state.setTimeoutTimestamp(max(last // 1000 + gap_ms, state.getCurrentWatermarkMs() + 1))


def silent_series(stream: DataFrame, gap_seconds: int, delay: str = "1 hour") -> DataFrame:
    """Series whose newest reading the watermark has left behind by more than the gap."""
    def fn(key, batches, state):
        return _silence(key, batches, state, gap_seconds * 1000)

    return stream.withWatermark("ts", delay).groupBy("series_id").applyInPandasWithState(
        fn, "series_id string, last_seen timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def join_actuals(log: DataFrame, actuals: DataFrame, delay: str = "2 days", reach: str = "3 days") -> DataFrame:
    """Forecasts meet their actuals as they arrive; both sides expire by watermark."""
    a = actuals.select(F.col("experiment").alias("ae"), F.col("grid_ts").alias("at"), F.col("value").alias("actual")).withWatermark("at", delay)
    f = log.withWatermark("target_dt", delay)
    on = (F.col("experiment") == F.col("ae")) & (F.col("target_dt") == F.col("at")) & (
        F.col("at") >= F.col("target_dt") - F.expr(f"interval {reach}"))
    return f.join(a, on).drop("ae", "at")


def accumulate_sums(out: str, width: int, by=("model_name",)) -> Callable[[DataFrame, int], None]:
    """foreachBatch: error sums of a batch in a folder of its own, so a replay overwrites instead of adding."""
    def write(batch: DataFrame, batch_id: int) -> None:
        e = F.col("predicted") - F.col("actual")
        d = batch.withColumn("lead_bucket", lead_bucket("lead_minutes", width)).groupBy("experiment", *by, "lead_bucket").agg(
            F.sum(F.abs(e)).alias("abs_sum"), F.sum(e * e).alias("sq_sum"), F.sum(e).alias("signed_sum"), F.count(F.lit(1)).alias("n"))
        d.write.mode("overwrite").parquet(os.path.join(out, "data", f"batch_id={batch_id}"))

    return write


def summed(spark: SparkSession, out: str, by=("model_name",)) -> DataFrame:
    d = result(spark, out)
    return d.groupBy("experiment", *by, "lead_bucket").agg(*[F.sum(c).alias(c) for c in ("abs_sum", "sq_sum", "signed_sum", "n")])


def rewrite_days(out: str, recompute: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """foreachBatch: store the readings, then recompute and overwrite the days they touch.

    ``recompute`` maps raw readings to rows with a ``day`` column. Only touched
    day partitions are read back, and only they are replaced.
    """
    raw, data = os.path.join(out, "raw"), os.path.join(out, "data")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("day", F.to_date("ts")).withColumn("batch_id", F.lit(batch_id))
        (rows.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id", "day").parquet(raw))
        stored = spark.read.parquet(raw)
        touched = stored.filter(F.col("batch_id") == batch_id).select("day").distinct()
        days = recompute(stored.join(touched, "day", "left_semi").drop("batch_id"))
        (days.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("day").parquet(data))

    return write
