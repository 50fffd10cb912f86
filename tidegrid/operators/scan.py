"""Ordered scans that do not put a whole series into one task.

A window partitioned by the series alone sends one series to one task, and one
series may hold a third of all rows. Both helpers below partition by (series,
stretch of time) instead and stay exact:

* ``running``  unbounded frames (hold, sum, max, count, previous row): a local
  window inside each stretch, plus the carry of all earlier stretches, taken
  from one summary row per stretch.
* ``with_halo`` bounded frames (lags, rolling statistics): the rows that the
  next stretch looks back on are copied into it and dropped afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegrid.functions.timecols import epoch

DAY = 86400
STRETCH = 32 * DAY


@dataclass(frozen=True)
class Scan:
    """One running column.

    kind: ``last`` (newest non-null), ``sum``, ``max``, ``min`` or ``count``
    (non-null). ``inclusive`` counts the current row; ``backward`` reads the
    rows after it instead of those before it. Wrap a value in ``struct`` to
    make ``last`` see null rows too.
    """

    name: str
    kind: str
    col: Column
    inclusive: bool = True
    backward: bool = False


def _local(s: Scan, tmp: str, w_fwd, w_bwd) -> Column:
    w = w_bwd if s.backward else w_fwd
    frame = w.rowsBetween(W.unboundedPreceding, 0 if s.inclusive else -1)
    c = F.col(tmp)
    if s.kind == "last":
        return F.last(c, ignorenulls=True).over(frame)
    return {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}[s.kind](c).over(frame)


def _total(s: Scan, tmp: str, order: Sequence[str]) -> Column:
    c = F.col(tmp)
    if s.kind == "last":
        pick = F.min if s.backward else F.max
        return pick(F.when(c.isNotNull(), F.struct(*order, c.alias("v")))).getField("v")
    return {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}[s.kind](c)


def _carry(s: Scan, w_fwd, w_bwd) -> Column:
    w = (w_bwd if s.backward else w_fwd).rowsBetween(W.unboundedPreceding, -1)
    c = F.col(f"__t_{s.name}")
    if s.kind == "last":
        return F.last(c, ignorenulls=True).over(w)
    return {"sum": F.sum, "max": F.max, "min": F.min, "count": F.sum}[s.kind](c).over(w)


def _merge(s: Scan, local: str, carry: str) -> Column:
    a, b = F.col(local), F.col(carry)
    if s.kind == "last":
        return F.coalesce(a, b)
    if s.kind == "sum":
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
    if s.kind == "count":
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    if s.kind == "max":
        return F.when(a.isNull() | (b > a), b).otherwise(a)
    return F.when(a.isNull() | (b < a), b).otherwise(a)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    scans: Sequence[Scan],
    stretch: int = STRETCH,
) -> DataFrame:
    """Add running columns. ``order[0]`` must be a timestamp, later ones break ties."""
    keys, order = list(keys), list(order)
    d = df.withColumn("__c", F.floor(epoch(order[0]) / stretch))
    for s in scans:
        d = d.withColumn(f"__v_{s.name}", s.col)
    totals = d.groupBy(*keys, "__c").agg(
        *[_total(s, f"__v_{s.name}", order).alias(f"__t_{s.name}") for s in scans]
    )
    cf = W.partitionBy(*keys).orderBy("__c")
    cb = W.partitionBy(*keys).orderBy(F.col("__c").desc())
    carries = totals.select(
        *keys, "__c", *[_carry(s, cf, cb).alias(f"__k_{s.name}") for s in scans]
    )
    d = d.join(carries, [*keys, "__c"], "left")
    lf = W.partitionBy(*keys, "__c").orderBy(*order)
    lb = W.partitionBy(*keys, "__c").orderBy(*[F.col(o).desc() for o in order])
    locals_ = {f"__l_{s.name}": _local(s, f"__v_{s.name}", lf, lb) for s in scans}
    d = d.withColumns(locals_)
    merged = [_merge(s, f"__l_{s.name}", f"__k_{s.name}").alias(s.name) for s in scans]
    names = {s.name for s in scans}
    return d.select(*[c for c in df.columns if c not in names], *merged)


def previous(df: DataFrame, keys, order, name: str, col: Column, stretch: int = STRETCH) -> DataFrame:
    """The value on the row before (null rows count)."""
    out = running(df, keys, order, [Scan(name, "last", F.struct(col.alias("v")), inclusive=False)], stretch)
    return out.withColumn(name, F.col(name).getField("v"))


def following(df: DataFrame, keys, order, name: str, col: Column, stretch: int = STRETCH) -> DataFrame:
    """The value on the row after (null rows count)."""
    scan = Scan(name, "last", F.struct(col.alias("v")), inclusive=False, backward=True)
    return running(df, keys, order, [scan], stretch).withColumn(name, F.col(name).getField("v"))


def with_halo(
    df: DataFrame, ts: str, before: int, after: int = 0, stretch: int | None = None
) -> DataFrame:
    """Copy rows into every stretch that looks ``before``/``after`` seconds at them.

    Adds ``__c`` (stretch) and ``__own``; compute windows over (keys, ``__c``)
    and finish with ``drop_halo``. The copies amount to (before + after) /
    stretch of the rows.
    """
    stretch = stretch or max(STRETCH, 4 * (before + after))
    e = epoch(ts)
    lo, hi = F.floor((e - after) / stretch), F.floor((e + before) / stretch)
    return df.withColumn("__c", F.explode(F.sequence(lo, hi))).withColumn(
        "__own", F.col("__c") == F.floor(e / stretch)
    )


def halo_window(keys: Sequence[str], ts: str):
    return W.partitionBy(*keys, "__c").orderBy(ts)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter("__own").drop("__c", "__own")


def by_density(df: DataFrame, keys: Sequence[str], ts: str, rows: int, name: str = "__c", splitters: int = 256) -> DataFrame:
    """Adds numbers that rise with time, so that each (key, number) holds about ``rows`` rows, however they lie in time.

    A key's splitters are approximate quantiles of its own times; a key of n rows uses every n / rows-th part of them."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    cuts = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__rows"), F.percentile_approx(at, [k / splitters for k in range(1, splitters)], 10 * splitters).alias("__cuts")
    )
    parts = F.least(F.ceil(F.col("__rows") / rows), F.lit(splitters))
    place = F.size(F.filter("__cuts", lambda c: c < at))
    return df.join(cuts, list(keys)).withColumn(name, F.floor(place * parts / splitters).cast("long")).drop("__rows", "__cuts")
