"""Unions, intersections and de-duplication of keyed frames."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.scan import Scan, previous, running
from tidegrid.session import cut_lineage, stored

# How far a value may move and still count as unchanged.
UNCHANGED_ABS = 1e-4
UNCHANGED_REL = 0.005
# Keys of more rows are spread over tasks.
SERIES_ROWS = 1 << 16


def union_dedup(frames: list[DataFrame], keys, value: str = "value", keep: str = "last") -> DataFrame:
    """Union by key; of equal keys the frame listed last (or first) wins."""
    tagged = [d.select(*keys, value, F.lit(n).alias("__n")) for n, d in enumerate(frames)]
    both = reduce(DataFrame.unionByName, tagged)
    pick = F.max_by if keep == "last" else F.min_by
    return both.groupBy(*keys).agg(pick(F.struct(value), "__n").getField(value).alias(value))


def combine_first(frames: list[DataFrame], keys, value: str = "value") -> DataFrame:
    """The first frame with a non-null value wins."""
    tagged = [d.select(*keys, value, F.lit(n).alias("__n")) for n, d in enumerate(frames)]
    both = reduce(DataFrame.unionByName, tagged)
    order = F.when(F.col(value).isNotNull(), F.col("__n"))
    return both.groupBy(*keys).agg(F.min_by(value, order).alias(value))


def intersect_keys(frames: list[DataFrame], keys) -> DataFrame:
    return reduce(lambda a, b: a.intersect(b), [d.select(*keys) for d in frames])


def except_days(df: DataFrame, days: DataFrame, ts: str = "grid_ts") -> DataFrame:
    return df.join(days.select(F.col("day").alias("__d")), F.to_date(ts) == F.col("__d"), "left_anti")


def union_timeline(frames: list[DataFrame], keys) -> DataFrame:
    return reduce(DataFrame.unionByName, [d.select(*keys) for d in frames]).distinct()


def _moved(new: dict, kept: dict) -> bool:
    """The rule for two issuances (target to value) in hand, as a stream has them."""
    shared = new.keys() & kept.keys()
    return not shared or any(abs(new[k] - kept[k]) > max(UNCHANGED_ABS, UNCHANGED_REL * abs(new[k])) for k in shared)


def _next_moved(points: DataFrame, runs: DataFrame, keys) -> DataFrame:
    """(keys, i, next): for each issuance the first later one that differs from it on their common targets, or has none.

    Issuances look ahead over 1, then 2, 4, ... further ones; only those that have not met a different one go on. One without
    common targets differs, so no look goes far beyond a horizon.
    """
    last = runs.groupBy(*keys).agg(F.max("i").alias("__last"))
    waiting, found, width, reach = runs.select(*keys, "i").join(last, keys), None, 1, 0
    while True:
        ahead = waiting.withColumn("j", F.explode(F.sequence(F.col("i") + reach + 1, F.col("i") + reach + width))).filter("j <= __last").drop("__last")
        mine = ahead.join(points.select(*keys, "i", "target_dt", F.col("v").alias("__a")), [*keys, "i"], "left")
        theirs = mine.join(points.select(*keys, F.col("i").alias("j"), "target_dt", F.col("v").alias("__b")), [*keys, "j", "target_dt"], "left")
        moved = F.abs(F.col("__b") - F.col("__a")) > F.greatest(F.lit(UNCHANGED_ABS), UNCHANGED_REL * F.abs(F.col("__b")))
        pairs = theirs.groupBy(*keys, "i", "j").agg((F.coalesce(F.bool_or(moved), F.lit(False)) | (F.count("__b") == 0)).alias("moved"))
        hits = cut_lineage(pairs.filter("moved").groupBy(*keys, "i").agg(F.min("j").alias("next")))
        found = hits if found is None else found.unionByName(hits)
        reach, width = reach + width, 2 * width
        waiting = cut_lineage(waiting.join(hits, [*keys, "i"], "left_anti").filter(F.col("i") + reach < F.col("__last")))
        if waiting.isEmpty():
            return found


def collapse_unchanged(log: DataFrame, keys=("experiment", "source"), value: str = "value", series_rows: int = SERIES_ROWS) -> DataFrame:
    """Drop issuances that repeat the last kept one on their common targets.

    A task walks along the issuances of whole keys, and nothing is stored; a log that comes dealt by some of the keys is not
    shuffled. Keys of more than ``series_rows`` rows are spread over tasks instead. Values are compared to four decimals, null
    values not at all; rows without a key or time of issue are dropped.
    """
    keys = list(keys)
    log = log.dropna(subset=[*keys, "issued_at"])
    sizes = log.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).withColumn("large", F.col("rows") > series_rows)
    large = sizes.agg(F.max("large")).first()[0]
    small = log if not large else log.join(sizes.filter("NOT large").select(*keys), keys, "left_semi")
    out = small.withColumn("__v", F.round(value, 4).cast("double")).groupBy(*keys).applyInArrow(_walk, log.schema)
    if large:
        hot = stored(log.join(sizes.filter("large").select(*keys), keys, "left_semi"))
        out = out.unionByName(_collapse_long(hot, keys, value))
    return out


def _walk(rows: pa.Table) -> pa.Table:
    """The rows of the kept issuances of one key."""
    issue, target = (np.asarray(pc.rank(rows.column(c), "ascending", tiebreaker="dense")).astype(np.int64) - 1 for c in ("issued_at", "target_dt"))
    some = pc.and_(rows.column("__v").is_valid(), rows.column("target_dt").is_valid()).to_numpy()
    i, t, v = issue[some], target[some], rows.column("__v").fill_null(0.0).to_numpy()[some]
    order = np.lexsort((t, i))
    i, t, v = i[order], t[order], v[order]
    first = np.flatnonzero(np.append(True, (np.diff(i) != 0) | (np.diff(t) != 0))[: len(i)])
    i, t, v = i[first], t[first], np.maximum.reduceat(v, first) if len(first) else v
    n = int(issue.max(initial=-1)) + 1
    at = np.searchsorted(i, np.arange(n + 1))
    # NaN counts as the largest number, as in a comparison of columns
    limit = np.maximum(UNCHANGED_ABS, UNCHANGED_REL * np.abs(v))
    value, of, last, kept = np.zeros(int(target.max(initial=-1)) + 1), np.full(int(target.max(initial=-1)) + 1, -1), -1, np.zeros(n, bool)
    with np.errstate(invalid="ignore"):
        for k in range(n):
            own = slice(at[k], at[k + 1])
            shared = of[t[own]] == last if last >= 0 else np.zeros(at[k + 1] - at[k], bool)
            move, most = np.abs(v[own] - value[t[own]])[shared], limit[own][shared]
            if not shared.any() or ((move > most) | (np.isnan(move) & ~np.isnan(most))).any():
                value[t[own]], of[t[own]], last, kept[k] = v[own], k, k, True
    return rows.drop_columns(["__v"]).filter(pa.array(kept[issue]))


def _collapse_long(log: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The same for keys too long for a task.

    The kept ones are the chain from a key's first issuance along the links to
    the next that moved. Links are followed by doubling: what is known to be kept
    jumps by 1, 2, 4, ... links at once, so a chain of any length takes a
    logarithm of rounds.
    """
    runs = cut_lineage(running(log.select(*keys, "issued_at").distinct(), keys, ["issued_at"], [Scan("i", "count", F.lit(1))]))
    points = cut_lineage(
        log.filter(F.col(value).isNotNull()).join(runs, [*keys, "issued_at"]).groupBy(*keys, "i", "target_dt").agg(F.max(F.round(value, 4)).alias("v"))
    )
    jump = cut_lineage(_next_moved(points, runs, keys))
    kept = runs.filter("i = 1").select(*keys, "i")
    while not jump.isEmpty():
        reached = kept.join(jump, [*keys, "i"]).select(*keys, F.col("next").alias("i"))
        kept = cut_lineage(kept.unionByName(reached).distinct())
        further = jump.select(*keys, F.col("i").alias("next"), F.col("next").alias("__to"))
        jump = cut_lineage(jump.join(further, [*keys, "next"]).select(*keys, "i", F.col("__to").alias("next")))
    named = runs.join(kept, [*keys, "i"]).select(*keys, "issued_at")
    return log.join(named, [*keys, "issued_at"], "left_semi")


def changed_since_previous(log: DataFrame, keys=("experiment", "source"), value: str = "value") -> DataFrame:
    """Issuances that differ from the one directly before them.

    All sides grow with the log, whatever the size of the file it is derived from, so they are merged and never broadcast.
    """
    keys = list(keys)
    runs = log.select(*keys, "issued_at").distinct()
    chain = previous(runs, keys, ["issued_at"], "__prev", F.col("issued_at"))
    d = log.join(chain.hint("merge"), [*keys, "issued_at"])
    before = log.select(*keys, F.col("issued_at").alias("__prev"), "target_dt", F.col(value).alias("__pv"))
    j = d.join(before.hint("merge"), [*keys, "__prev", "target_dt"], "left")
    moved = F.abs(F.col(value) - F.col("__pv")) > F.greatest(F.lit(UNCHANGED_ABS), UNCHANGED_REL * F.abs(F.col(value)))
    return j.groupBy(*keys, "issued_at").agg(
        (F.coalesce(F.bool_or(moved), F.lit(False)) | (F.count("__pv") == 0)).alias("changed")
    )


def backfill_copy(own: DataFrame, other: DataFrame, key: str = "experiment", value: str = "value") -> DataFrame:
    """Own rows plus the other table's rows issued before the earliest own row, one per (issued, target)."""
    first = own.groupBy(key).agg(F.min("issued_at").alias("__first"))
    copied = (
        other.join(first, key, "left")
        .filter(F.col("__first").isNull() | (F.col("issued_at") < F.col("__first")))
        .groupBy(key, "issued_at", "target_dt").agg(F.min(value).alias(value))
    )
    return own.select(key, "issued_at", "target_dt", value).unionByName(copied)


def prefer_source(df: DataFrame, keys, preferred, value: str = "value") -> DataFrame:
    """Of exact duplicates the row with ``preferred`` set wins."""
    rank = F.when(preferred, F.lit(0)).otherwise(F.lit(1))
    return df.groupBy(*keys).agg(
        F.min_by(F.struct(value), rank).getField(value).alias(value), (F.min(rank) == 0).alias("from_preferred")
    )
