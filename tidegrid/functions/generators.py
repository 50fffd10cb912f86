"""Table functions for SQL: grids and trajectories as rows.

``register`` makes them known to a session. Each input partition is read as a
stream and nothing is kept between rows, so memory does not follow a partition.
``grid.spine`` and ``records.trajectory_points`` do the same work natively.

    SELECT * FROM grid_cells(TABLE(SELECT key, lo, hi, seconds FROM spans) PARTITION BY (key, lo))
    SELECT * FROM trajectory_cells(TABLE(SELECT key, text FROM payloads))
"""

from __future__ import annotations

import json
import math
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf, udtf

from tidegrid.sources.records import TIME_KEYS, VALUE_KEYS


@udtf(returnType="key string, grid_ts timestamp_ntz")
class GridCells:
    """Rows (key, lo, hi, seconds) to every cell from ``lo`` to ``hi``; nothing where a bound is null or ``hi`` is before ``lo``."""

    def eval(self, row):
        if row["lo"] is None or row["hi"] is None:
            return
        at, step = row["lo"], timedelta(seconds=int(row["seconds"]))
        while at <= row["hi"]:
            yield row["key"], at
            at += step


def _number(v):
    try:
        x = float(v)
    except (TypeError, ValueError):
        return None
    return None if math.isnan(x) else x


def _moment(v):
    try:
        at = datetime.fromisoformat(v)
    except (TypeError, ValueError):
        return None
    return at if at.tzinfo is None else at.replace(tzinfo=None) - at.utcoffset()


def _points(text) -> list[tuple]:
    try:
        found = json.loads(text)
    except (TypeError, ValueError):
        return []
    if isinstance(found, dict):
        return list(found.items())
    if isinstance(found, list) and found and isinstance(found[0], dict):
        when, what = (next((k for k in names if k in found[0]), None) for names in (TIME_KEYS, VALUE_KEYS))
        return [(e.get(when), e.get(what)) for e in found if isinstance(e, dict)]
    return []


@arrow_udtf(returnType="key string, ts timestamp_ntz, value double, pos int")
class TrajectoryCells:
    """Rows (key, text) to the readable points of a JSON map or list; unreadable text gives no rows. Rows come and go in batches."""

    def eval(self, rows: pa.RecordBatch):
        of, ts, values, places = [], [], [], []
        for n, text in enumerate(rows.column("text").to_pylist()):
            for pos, (t, v) in enumerate(_points(text)):
                at, value = _moment(t), _number(v)
                if at is not None and value is not None:
                    of.append(n)
                    ts.append(at)
                    values.append(value)
                    places.append(pos)
        key = rows.column("key").take(pa.array(of, pa.int32()))
        yield pa.table({"key": key, "ts": pa.array(ts, pa.timestamp("us")), "value": pa.array(values, pa.float64()), "pos": pa.array(places, pa.int32())})


def register(spark: SparkSession) -> None:
    spark.udtf.register("grid_cells", GridCells)
    spark.udtf.register("trajectory_cells", TrajectoryCells)
