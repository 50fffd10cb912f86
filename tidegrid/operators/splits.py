"""Time-ordered train/test splits and forecast origins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegrid.operators.scan import Scan, running

# Origins per fold.
ORIGIN_STRIDE = 7
MAX_ORIGINS = 24


def number_rows(df: DataFrame, keys, ts: str = "grid_ts", seconds: int | None = None) -> DataFrame:
    """0-based position ``rn`` and series length ``n_rows``.

    On a complete grid (``seconds`` given) the position follows from the first
    timestamp, otherwise rows are counted.
    """
    keys = list(keys)
    span = df.groupBy(*keys).agg(F.min(ts).alias("__a"), F.count(F.lit(1)).alias("n_rows"))
    if seconds:
        d = df.join(span, keys).withColumn("rn", F.expr(f"(unix_seconds(cast(`{ts}` as timestamp)) - unix_seconds(cast(__a as timestamp))) div {int(seconds)}"))
    else:
        d = running(df, keys, [ts], [Scan("rn", "count", F.lit(1), inclusive=False)]).join(span, keys)
    return d.drop("__a")


def fold_table(lengths: DataFrame, keys, folds: int = 5, embargo: int = 2, strategy: str = "walk_forward", n: str = "n_rows") -> DataFrame:
    """Half-open row ranges (train_lo, train_hi, test_lo, test_hi) per fold.

    walk_forward: growing training set, equal test blocks at the end.
    sliding_window: training set of fixed size, evenly spaced test blocks.
    """
    d = lengths.select(*keys, F.col(n).cast("long").alias("__n"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(folds - 1).cast("long"))).alias("fold"))
    size = F.greatest(F.lit(1).cast("long"), F.expr(f"__n div {folds + 1}"))
    d = d.withColumn("__size", size)
    if strategy == "walk_forward":
        d = d.withColumns({"test_lo": F.col("__n") - F.col("__size") * (folds - F.col("fold")), "__tr": F.lit(None).cast("long")})
    elif strategy == "sliding_window":
        d = d.withColumn("__tr", F.greatest("__size", F.expr(f"(__n - __size - {embargo}) div 2")))
        first = F.col("__tr") + embargo
        last = F.greatest(first, F.col("__n") - F.col("__size"))
        step = F.rint(F.col("fold") * (last - first) / max(1, folds - 1)).cast("long")
        d = d.withColumn("test_lo", first + step)
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    zero = F.lit(0).cast("long")
    d = d.withColumns(
        {"test_hi": F.least(F.col("test_lo") + F.col("__size"), F.col("__n")), "train_hi": F.greatest(zero, F.col("test_lo") - embargo)}
    )
    d = d.withColumn("train_lo", F.greatest(zero, F.col("train_hi") - F.coalesce("__tr", F.col("train_hi"))))
    d = d.filter((F.col("train_hi") > F.col("train_lo")) & (F.col("test_hi") > F.col("test_lo")) & (F.col("test_lo") < F.col("__n")))
    return d.select(*keys, "fold", "train_lo", "train_hi", "test_lo", "test_hi")


def assign_folds(numbered: DataFrame, folds: DataFrame, keys) -> DataFrame:
    """Rows with (fold, role); a row appears once per fold that uses it."""
    rn = F.col("rn")
    role = F.when((rn >= F.col("test_lo")) & (rn < F.col("test_hi")), "test").when(
        (rn >= F.col("train_lo")) & (rn < F.col("train_hi")), "train")
    d = numbered.join(folds, list(keys)).withColumn("role", role).filter(F.col("role").isNotNull())
    return d.drop("train_lo", "train_hi", "test_lo", "test_hi")


def holdout(numbered: DataFrame, share: float = 0.8) -> DataFrame:
    cut = F.floor(F.col("n_rows") * share)
    return numbered.withColumn("role", F.when(F.col("rn") < cut, "train").otherwise("test"))


def data_checks(df: DataFrame, keys, folds: int = 5, value: str = "y", ablation_min: int = 100) -> DataFrame:
    """Whether a series is long enough to benchmark and for an ablation."""
    d = df.groupBy(*keys).agg(F.count(value).alias("measured"))
    return d.withColumns(
        {
            "status": F.when(F.col("measured") < folds * 10, "too short").otherwise("ok"),
            "ablation_ok": F.col("measured") >= ablation_min,
        }
    )


def thin_origins(origins: DataFrame, keys, order: str = "rn", stride: int = ORIGIN_STRIDE, limit: int = MAX_ORIGINS) -> DataFrame:
    """Every ``stride``-th origin of a fold, evenly thinned to at most ``limit``."""
    w = W.partitionBy(*keys).orderBy(order)
    d = origins.withColumn("__i", F.row_number().over(w) - 1).filter(F.col("__i") % stride == 0)
    d = d.withColumn("__k", F.expr(f"__i div {stride}")).withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(*keys)))
    # Position k is taken when some slot i of `limit` rounds (half to even) to it.
    near = F.sequence(F.lit(0), F.lit(limit - 1))
    hit = F.exists(near, lambda i: F.rint(i * (F.col("__n") - 1) / (limit - 1)) == F.col("__k"))
    return d.filter((F.col("__n") <= limit) | hit).drop("__i", "__k", "__n")
