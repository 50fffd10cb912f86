"""Exact quantiles of groups of any size.

The built-in exact percentile keeps a group's distinct values in one task. Here
equal values are first counted per (group, value), which spreads a hot group;
a histogram over fine, order-preserving buckets then says in which buckets the
wanted ranks lie, and only those buckets are ordered. Linear interpolation
between ranks, as ``quantile_cont``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Buckets per doubling of magnitude: each is about 4e-5 wide relative to its value.
RESOLUTION = 16384
_SHIFT = 1100 * RESOLUTION


def _bucket(v: Column) -> Column:
    mag = F.floor(F.log2(F.abs(v)) * RESOLUTION) + _SHIFT
    return F.when(v > 0, mag).when(v < 0, -mag).otherwise(F.lit(0)).cast("long")


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    count: str | None = None,
) -> DataFrame:
    """One row per group with a column per named probability (and the count)."""
    keys = list(keys)
    anchor = keys or ["__all"]
    d = df if keys else df.withColumn("__all", F.lit(0))
    vc = (
        d.filter(F.col(value).isNotNull())
        .groupBy(*anchor, F.col(value).cast("double").alias("__v"))
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__b", _bucket(F.col("__v")))
    )
    hist = vc.groupBy(*anchor, "__b").agg(F.sum("__n").alias("__hn"))
    w = W.partitionBy(*anchor).orderBy("__b")
    hist = hist.withColumns(
        {
            "__hi": F.sum("__hn").over(w.rowsBetween(W.unboundedPreceding, 0)),
            "__tot": F.sum("__hn").over(W.partitionBy(*anchor)),
        }
    ).withColumn("__lo", F.col("__hi") - F.col("__hn"))
    ps = list(probs.items())
    spots = [(F.col("__tot") - 1) * F.lit(float(p)) for _, p in ps]
    hit = F.lit(False)
    for s in spots:
        for k in (F.floor(s), F.ceil(s)):
            hit = hit | ((F.col("__lo") <= k) & (k < F.col("__hi")))
    wanted = hist.filter(hit).select(*anchor, "__b", "__lo", "__tot")
    wb = W.partitionBy(*anchor, "__b").orderBy("__v").rowsBetween(W.unboundedPreceding, 0)
    ranked = vc.join(wanted, [*anchor, "__b"]).withColumn("__e", F.col("__lo") + F.sum("__n").over(wb))
    ranked = ranked.withColumn("__s", F.col("__e") - F.col("__n"))
    aggs = [F.max("__tot").alias("__tot")]
    for i, s in enumerate(spots):
        for tag, k in (("l", F.floor(s)), ("h", F.ceil(s))):
            at = (F.col("__s") <= k) & (k < F.col("__e"))
            aggs.append(F.max(F.when(at, F.col("__v"))).alias(f"__{tag}{i}"))
    picked = ranked.groupBy(*anchor).agg(*aggs)
    out = []
    for i, (name, p) in enumerate(ps):
        s = (F.col("__tot") - 1) * F.lit(float(p))
        frac = s - F.floor(s)
        lo, hi = F.col(f"__l{i}"), F.col(f"__h{i}")
        out.append((lo + (hi - lo) * frac).alias(name))
    if count:
        out.append(F.col("__tot").alias(count))
    return picked.select(*keys, *out)
