"""Ranking models over folds and testing their differences."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tidegrid.functions.metrics import HIGHER_IS_BETTER, two_sided_p
from tidegrid.operators.scan import Scan, running
from tidegrid.session import stored

# Fixed values.
UNSTABLE_RATIO = 10.0
UNSTABLE_CV = 1.0
# Groups of more rows are spread over tasks.
SERIES_ROWS = 1 << 16
# Rows whose resamples are held at once.
DRAWN_ROWS = 1 << 10


def fold_summary(long: DataFrame, keys) -> DataFrame:
    """Mean and population spread over folds of (keys, model, fold, metric, value)."""
    return long.groupBy(*keys, "model", "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("n_folds")
    )


def model_positions(models: list[str]) -> Column:
    table = F.create_map(*[F.lit(x) for n, m in enumerate(models) for x in (m, n)])
    return table[F.col("model")]


def with_completeness(long: DataFrame, keys) -> DataFrame:
    """Adds ``complete``: the model was scored in every fold that any model was scored in.

    A window holds one series' models x folds x metrics.
    """
    w = W.partitionBy(*keys, "model")
    scored = F.size(F.collect_set(F.when(F.col("value").isNotNull(), F.col("fold"))).over(w))
    d = long.withColumns({"__f": scored, "__all": F.size(F.collect_set("fold").over(w))})
    return d.withColumn("complete", F.col("__f") == F.max("__all").over(W.partitionBy(*keys))).drop("__f", "__all")


def complete_models(long: DataFrame, keys) -> DataFrame:
    """(keys, model, complete)."""
    return with_completeness(long, keys).select(*keys, "model", "complete").distinct()


def fold_ranks(long: DataFrame, keys, models: list[str], metrics: list[str], production: str) -> DataFrame:
    """Weighted rank of every complete model per fold.

    Ranks are not shared; equal values keep the order of registration. The
    production metric outweighs the others.
    """
    use = [m for m in metrics if m not in HIGHER_IS_BETTER]
    if production not in HIGHER_IS_BETTER and production not in use:
        use.append(production)
    weight = max(1, (len(use) - 1) * 3 // 2)
    d = with_completeness(long, keys).filter(F.col("complete") & F.col("metric").isin(use))
    d = d.withColumns({"__v": F.coalesce(F.round("value", 9), F.lit(float("inf"))), "__pos": model_positions(models)})
    cell = W.partitionBy(*keys, "fold", "metric")
    d = d.withColumns({"__r": F.row_number().over(cell.orderBy("__v", "__pos")), "__best": F.min("__v").over(cell)})
    d = d.filter(F.col("__best") < float("inf"))
    w = F.when(F.col("metric") == production, F.lit(weight)).otherwise(F.lit(1))
    return d.groupBy(*keys, "model", "fold").agg((F.sum(F.col("__r") * w) / F.sum(w)).alias("fold_rank"))


def composite_rank(ranks: DataFrame, keys, models: list[str]) -> DataFrame:
    d = ranks.groupBy(*keys, "model").agg(F.avg("fold_rank").alias("mean_rank")).withColumn("__pos", model_positions(models))
    w = W.partitionBy(*keys).orderBy(F.round("mean_rank", 9), "__pos")
    return d.withColumn("final_rank", F.row_number().over(w).cast("long")).drop("__pos")


def _resampled(values: Column, n: Column, iters: int, seed: int, reduce_) -> Column:
    """``iters`` resamples with hash-based draws, so that a recomputed task repeats them."""
    def one(b):
        picks = F.transform(F.sequence(F.lit(1), n), lambda i: F.pmod(F.xxhash64(F.lit(seed), b, i), n.cast("long")).cast("int") + 1)
        return reduce_(F.transform(picks, lambda i: F.element_at(values, i)), n)

    return F.transform(F.sequence(F.lit(1), F.lit(iters)), one)


def _array_quantile(sorted_array: Column, p: float) -> Column:
    pos = (F.size(sorted_array) - 1) * F.lit(p)
    lo = F.floor(pos).cast("int")
    a, b = F.element_at(sorted_array, lo + 1), F.element_at(sorted_array, F.ceil(pos).cast("int") + 1)
    return a + (b - a) * (pos - lo)


def rank_bootstrap(ranks: DataFrame, keys, iters: int = 1000, seed: int = 42) -> DataFrame:
    """95 % interval of the mean rank from resampled folds; all models share the draws."""
    own = [*keys, "model"]
    cell = F.struct("fold", F.col("fold_rank").cast("double").alias("r"))
    d = ranks.groupBy(*own).agg(F.sort_array(F.collect_list(cell)).alias("__c"))
    d = d.select(*own, F.transform("__c", lambda e: e["r"]).alias("__v")).filter(F.size("__v") >= 2)
    ends = [StructField("rank_lo", DoubleType()), StructField("rank_hi", DoubleType())]
    return d.mapInArrow(lambda batches: (_rank_intervals(b, iters, seed) for b in batches), StructType([*d.drop("__v").schema.fields, *ends]))


def _hashed(value: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` of 32-bit whole numbers, going on from ``seed``."""
    p1, p2, p3, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    h = (seed + p5 + np.uint64(4)) ^ (value.astype(np.uint64) & np.uint64(0xFFFFFFFF)) * p1
    h = (h << np.uint64(23) | h >> np.uint64(41)) * p2 + p3
    h = (h ^ h >> np.uint64(33)) * p2
    h = (h ^ h >> np.uint64(29)) * p3
    return h ^ h >> np.uint64(32)


def _drawn(iters: int, seed: int) -> np.ndarray:
    """The state of each resample, from which ``_picked`` goes on."""
    return _hashed(np.arange(1, iters + 1), _hashed(np.array([seed]), np.array([42], np.uint64)))


def _picked(draw: np.ndarray, k: int, n: int) -> np.ndarray:
    """The ``k``-th of the ``n`` places that each resample picks, from 0."""
    return np.mod(_hashed(np.array([k]), draw).astype(np.int64), np.int64(n))


def _ends(means: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the 95 % interval of each row of means, and which are not null; null means, which are not ``whole``, come first."""
    means, missing, iters = np.where(whole, means, -np.inf), (~whole).sum(axis=1), means.shape[1]
    spots = [(iters - 1) * p for p in (0.025, 0.975)]
    means = np.partition(means, sorted({f(s) for s in spots for f in (math.floor, math.ceil)}), axis=1)
    out = []
    for spot in spots:
        low = math.floor(spot)
        a, b = means[:, low], means[:, math.ceil(spot)]
        with np.errstate(invalid="ignore"):  # of null means
            out.append(a + (b - a) * (spot - low))
    return np.array(out), np.array([missing <= math.floor(spot) for spot in spots])


def ratio_intervals(sums: DataFrame, cells: str, iters: int, seed: int) -> DataFrame:
    """Adds ``lo`` and ``hi``, the 95 % interval of the ratio of two totals, from resamples of ``cells``: an array of (..., s, c).

    Draws and sums are those of ``_resampled``, made once for all rows with as many cells."""
    d = sums.select(*[c for c in sums.columns if c != cells], F.transform(cells, lambda x: x["s"]).alias("__s"), F.transform(cells, lambda x: x["c"]).alias("__c"))
    ends = [StructField("lo", DoubleType()), StructField("hi", DoubleType())]
    return d.mapInArrow(lambda batches: (_ratio_intervals(b, iters, seed) for b in batches), StructType([*d.drop("__s", "__c").schema.fields, *ends]))


def _ratio_intervals(rows: pa.RecordBatch, iters: int, seed: int) -> pa.RecordBatch:
    s, c = rows.columns[-2:]
    lengths = pc.list_value_length(s).to_numpy()
    starts = [x.offsets.to_numpy() for x in (s, c)]
    known = s.values.is_valid().to_numpy(zero_copy_only=False)
    s, c = (x.values.fill_null(0.0).to_numpy() for x in (s, c))
    out, valid = np.zeros((2, rows.num_rows)), np.ones((2, rows.num_rows), bool)
    draw = _drawn(iters, seed)
    for n in np.unique(lengths):
        every = np.flatnonzero(lengths == n)
        picks = [_picked(draw, k, n) for k in range(1, n + 1)]
        for mine in np.split(every, range(DRAWN_ROWS // 8, len(every), DRAWN_ROWS // 8)):
            # places by rows, so that a pick reads the cells of all rows at once
            own = [np.ascontiguousarray(x[at[mine][:, None] + np.arange(n)].T) for x, at in ((s, starts[0]), (c, starts[1]), (known, starts[0]))]
            total, count, whole = np.zeros((iters, len(mine))), np.zeros((iters, len(mine))), np.ones((iters, len(mine)), bool)
            for at in picks:
                total += own[0][at]
                count += own[1][at]
                whole &= own[2][at]
            out[:, mine], valid[:, mine] = _ends(np.divide(total, count, out=np.zeros_like(total), where=whole).T, whole.T)
    ends = [pa.array(x, mask=~v) for x, v in zip(out, valid)]
    return pa.RecordBatch.from_arrays([*rows.columns[:-2], *ends], names=[*rows.schema.names[:-2], "lo", "hi"])


def _rank_intervals(rows: pa.RecordBatch, iters: int, seed: int) -> pa.RecordBatch:
    """The draws of ``_resampled``, made once for all rows with the same number of folds; means are summed in its order."""
    vectors = rows.column(rows.num_columns - 1)
    lengths, start, flat = pc.list_value_length(vectors).to_numpy(), vectors.offsets.to_numpy(), vectors.values
    known, flat = flat.is_valid().to_numpy(zero_copy_only=False), flat.fill_null(0.0).to_numpy()
    out, valid = np.zeros((2, rows.num_rows)), np.ones((2, rows.num_rows), bool)
    draw = _drawn(iters, seed)
    for n in np.unique(lengths):
        every = np.flatnonzero(lengths == n)
        for mine in np.split(every, range(DRAWN_ROWS, len(every), DRAWN_ROWS)):
            total, whole = np.zeros((len(mine), iters)), np.ones((len(mine), iters), bool)
            for k in range(1, n + 1):
                at = start[mine][:, None] + _picked(draw, k, n)[None, :]
                total += flat[at]
                whole &= known[at]
            out[:, mine], valid[:, mine] = _ends(total / n, whole)
    ends = [pa.array(x, mask=~v) for x, v in zip(out, valid)]
    return pa.RecordBatch.from_arrays([*rows.columns[:-1], *ends], names=[*rows.schema.names[:-1], "rank_lo", "rank_hi"])


def tie_flags(ranked: DataFrame, keys) -> DataFrame:
    """``tied`` where a model's interval overlaps the leader's."""
    leader = W.partitionBy(*keys)
    d = ranked.withColumns({f"__{end}": F.max(F.when(F.col("final_rank") == 1, F.col(f"rank_{end}"))).over(leader) for end in ("lo", "hi")})
    over = (F.col("rank_lo") <= F.col("__hi")) & (F.col("rank_hi") >= F.col("__lo"))
    return d.withColumn("tied", F.coalesce(over, F.lit(False))).withColumn(
        "label", F.concat(F.when(F.col("tied") & (F.col("final_rank") > 1), "T").otherwise(""), F.col("final_rank").cast("string"))
    ).drop("__lo", "__hi")


def instability(long: DataFrame, keys, metric: str) -> DataFrame:
    """Models whose worst fold is ten times the median one, or whose spread reaches the mean."""
    d = long.filter((F.col("metric") == metric) & F.col("value").isNotNull()).groupBy(*keys, "model").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.median("value").alias("median"), F.max("value").alias("worst"),
    ).filter("n >= 2")
    ratio = F.when(F.col("median") > 0, F.col("worst") / F.col("median")).otherwise(F.lit(float("inf")))
    why = F.when(F.col("mean") <= 0, None).when(ratio >= UNSTABLE_RATIO, "blow-up").when(F.col("std") / F.col("mean") >= UNSTABLE_CV, "spread")
    return d.select(*keys, "model", why.isNotNull().alias("unstable"), why.alias("reason"))


def _pairs(d: DataFrame, on: list[str], value: str) -> DataFrame:
    """Each pair of models once; the number of pairs depends on the models only."""
    a = d.select(*on, F.col("model").alias("model_a"), F.col(value).alias("va"))
    b = d.select(*on, F.col("model").alias("model_b"), F.col(value).alias("vb"))
    return a.join(b, on).filter(F.col("model_a") < F.col("model_b"))


def pairwise_fold_test(long: DataFrame, keys, metric: str) -> DataFrame:
    """Mean fold difference over its standard error with a two-sided normal p."""
    d = _pairs(long.filter((F.col("metric") == metric) & F.col("value").isNotNull()), [*keys, "fold"], "value")
    diff = F.col("va") - F.col("vb")
    s = d.groupBy(*keys, "model_a", "model_b").agg(
        F.avg(diff).alias("mean_diff"), F.stddev_samp(diff).alias("__sd"), F.count(F.lit(1)).alias("n")).filter("n >= 2")
    z = F.when(F.col("__sd") > 1e-12, F.col("mean_diff") / (F.col("__sd") / F.sqrt("n"))).otherwise(F.lit(0.0))
    p = two_sided_p(z)
    return s.withColumns({"statistic": z, "p_value": p}).drop("__sd")


def diebold_mariano(pairs: DataFrame, keys, ts: str, reference_p: bool = False, series_rows: int = SERIES_ROWS) -> DataFrame:
    """Test of equal squared error from (keys, ts, ea, eb).

    Newey-West variance with bandwidth ceil(4 (n/100)^(2/9)), the plain
    variance where that is not positive. The p-value is two-sided;
    ``reference_p`` halves it. A task counts whole groups; those of more than
    ``series_rows`` rows are spread over tasks.
    """
    keys = list(keys)
    d = pairs.dropna(subset=keys).select(*keys, ts, (F.col("ea") * F.col("ea") - F.col("eb") * F.col("eb")).cast("double").alias("__d"))

    def one(rows: pa.Table) -> pa.Table:
        order = np.argsort(_places(rows, ts), kind="stable")
        some, value = rows.column("__d").is_valid().to_numpy()[order], rows.column("__d").fill_null(0.0).to_numpy()[order]
        n = [len(order)] if len(order) > 1 else []
        return rows.select(keys).slice(0, len(n)).append_column("n", pa.array(n, pa.int64())).append_column("dm", pa.array([_statistic(value, some) for _ in n], pa.float64()))

    small, large = _by_size(d, keys, series_rows)
    out = small.groupBy(*keys).applyInArrow(one, StructType([*[d.schema[k] for k in keys], *_TESTED]))
    return _with_p(out if large is None else out.unionByName(_test_long(large, keys, ts)), reference_p)


_TESTED = [StructField("n", LongType()), StructField("dm", DoubleType())]


def _by_size(d: DataFrame, keys: list[str], series_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the keys that fit a task; and those of the others, stored."""
    sizes = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).withColumn("large", F.col("rows") > series_rows)
    if not sizes.agg(F.max("large")).first()[0]:
        return d, None
    return (d.join(sizes.filter("NOT large").select(*keys), keys, "left_semi"), stored(d.join(sizes.filter("large").select(*keys), keys, "left_semi")))


def _places(rows: pa.Table, name: str) -> np.ndarray:
    return np.asarray(pc.rank(rows.column(name), "ascending", null_placement="at_start", tiebreaker="dense")).astype(np.int64) - 1


def _statistic(d: np.ndarray, some: np.ndarray) -> float:
    """From two or more differences in order of time; those not in ``some`` are null and add nothing to a sum."""
    n, known = len(d), int(some.sum())
    if not known:
        return 0.0
    mean = float(np.where(some, d, 0.0).sum()) / known
    x = np.where(some, d - mean, 0.0)
    h = max(1, min(math.ceil(4.0 * (n / 100.0) ** (2.0 / 9.0)), n - 1))
    plain = float((x * x).sum()) / known
    var = plain + sum(2.0 * (1.0 - k / (h + 1.0)) * float((x[k:] * x[:-k]).sum()) / (n - k) for k in range(1, h + 1))
    var = plain if var <= 0 else var
    return 0.0 if var <= 0 else mean / math.sqrt(var / n)


def _with_p(tested: DataFrame, reference_p: bool) -> DataFrame:
    return tested.withColumn("p_value", two_sided_p(F.col("dm")) * (0.5 if reference_p else 1.0))


def _test_long(d: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """The same for groups too long for a task, by joins: (keys, n, dm)."""
    d = running(d.select(*keys, ts, "__d"), keys, [ts], [Scan("__rn", "count", F.lit(1))])
    s = d.groupBy(*keys).agg(F.avg("__d").alias("__mean"), F.count(F.lit(1)).alias("n")).filter("n >= 2")
    h = F.greatest(F.lit(1), F.least(F.ceil(4.0 * F.pow(F.col("n") / 100.0, F.lit(2.0 / 9.0))), F.col("n") - 1)).cast("int")
    s = s.withColumn("__h", h)
    c = d.join(s, keys).withColumn("__x", F.col("__d") - F.col("__mean")).select(*keys, "__rn", "__x", "n", "__h", "__mean")
    lagged = c.select(*keys, (F.col("__rn")).alias("__r0"), F.col("__x").alias("__x0"), "n", "__h", F.explode(F.sequence(F.lit(1), F.col("__h"))).alias("__lag")).withColumn("__rn", F.col("__r0") + F.col("__lag"))
    cov = lagged.join(c.select(*keys, "__rn", F.col("__x").alias("__x1")), [*keys, "__rn"]).groupBy(*keys, "__lag").agg(
        (F.sum(F.col("__x0") * F.col("__x1")) / (F.max("n") - F.col("__lag"))).alias("__g"), F.max("__h").alias("__h"))
    hac = cov.groupBy(*keys).agg(F.sum(2.0 * (1.0 - F.col("__lag") / (F.col("__h") + 1.0)) * F.col("__g")).alias("__gs"))
    g0 = c.groupBy(*keys).agg(F.avg(F.col("__x") * F.col("__x")).alias("__g0"))
    out = s.join(g0, keys).join(hac, keys, "left")
    var = F.col("__g0") + F.coalesce("__gs", F.lit(0.0))
    var = F.when(var > 0, var).otherwise(F.col("__g0"))
    stat = F.when(var > 0, F.col("__mean") / F.sqrt(var / F.col("n"))).otherwise(F.lit(0.0))
    return out.select(*keys, "n", stat.alias("dm"))


def dm_all_pairs(errors: DataFrame, keys, ts: str, reference_p: bool = False, series_rows: int = SERIES_ROWS) -> DataFrame:
    """``diebold_mariano`` for each pair of models in (keys, model, ts, err).

    A task gets whole series and makes their pairs, which are not shuffled; only series of more than ``series_rows`` errors are
    paired by joins.
    """
    keys = list(keys)
    e = errors.dropna(subset=[*keys, "model", ts]).select(*keys, "model", ts, F.col("err").cast("double").alias("err"))

    def every(rows: pa.Table) -> pa.Table:
        at, model = _places(rows, ts), _places(rows, "model")
        some, err = rows.column("err").is_valid().to_numpy(), rows.column("err").fill_null(0.0).to_numpy()
        order = np.lexsort((at, model))
        own = np.split(order, np.flatnonzero(np.diff(model[order])) + 1)
        found = []
        for k, a in enumerate(own):
            for b in own[k + 1:]:
                # as a join: every row of one time meets all of the other model
                low, many = np.searchsorted(at[b], at[a]), np.searchsorted(at[b], at[a], "right") - np.searchsorted(at[b], at[a])
                n = int(many.sum())
                if n > 1:
                    x, y = np.repeat(a, many), b[np.arange(n) - np.repeat(np.cumsum(many) - many - low, many)]
                    found.append((a[0], b[0], n, _statistic(err[x] * err[x] - err[y] * err[y], some[x] & some[y])))
        first, second, n, dm = ([f[c] for f in found] for c in range(4))
        out = rows.select(keys).take(pa.array(first, pa.int64()))
        for name, column in (("model_a", rows.column("model").take(pa.array(first, pa.int64()))), ("model_b", rows.column("model").take(pa.array(second, pa.int64())))):
            out = out.append_column(name, column)
        return out.append_column("n", pa.array(n, pa.int64())).append_column("dm", pa.array(dm, pa.float64()))

    small, large = _by_size(e, keys, series_rows)
    kind = e.schema["model"].dataType
    schema = StructType([*[e.schema[k] for k in keys], StructField("model_a", kind), StructField("model_b", kind), *_TESTED])
    out = _with_p(small.groupBy(*keys).applyInArrow(every, schema), reference_p)
    if large is None:
        return out
    p = _pairs(large, [*keys, ts], "err").withColumnsRenamed({"va": "ea", "vb": "eb"})
    return out.unionByName(diebold_mariano(p, [*keys, "model_a", "model_b"], ts, reference_p, series_rows))


def confidence_set(errors: DataFrame, keys, ts: str, alpha: float = 0.1, reference_p: bool = False) -> DataFrame:
    """The best model by squared error and all that cannot be told from it at alpha / (k - 1)."""
    mse = errors.groupBy(*keys, "model").agg(F.avg(F.col("err") * F.col("err")).alias("mse"))
    best = mse.groupBy(*keys).agg(F.min_by("model", F.struct(F.round("mse", 6), "model")).alias("best"), F.count(F.lit(1)).alias("k"))
    e = errors.join(best, list(keys))
    lead = e.filter(F.col("model") == F.col("best")).select(*keys, ts, F.col("err").alias("ea"))
    rest = e.filter(F.col("model") != F.col("best")).select(*keys, ts, "model", F.col("err").alias("eb"))
    dm = diebold_mariano(rest.join(lead, [*keys, ts]), [*keys, "model"], ts, reference_p)
    d = mse.join(best, list(keys)).join(dm.select(*keys, "model", "p_value"), [*keys, "model"], "left")
    inside = (F.col("model") == F.col("best")) | (F.col("p_value") > alpha / F.greatest(F.col("k") - 1, F.lit(1)))
    return d.select(*keys, "model", "mse", F.coalesce(inside, F.lit(True)).alias("in_set"))


def paired_table(long: DataFrame, keys, metric: str) -> DataFrame:
    """All pairs tested on the square root of their fold metrics."""
    d = long.filter((F.col("metric") == metric) & F.col("value").isNotNull()).withColumn("err", F.sqrt(F.abs("value")))
    d = d.withColumn("__ts", F.timestamp_seconds(F.col("fold")).cast("timestamp_ntz"))
    return dm_all_pairs(d.select(*keys, "model", "__ts", "err"), keys, "__ts")


def naive_skill(summary: DataFrame, keys, baseline: str = "seasonal_naive", metric: str = "mae") -> DataFrame:
    d = summary.filter(F.col("metric") == metric)
    base = d.filter(F.col("model") == baseline).select(*keys, F.col("mean").alias("naive"))
    return d.join(base, list(keys)).select(
        *keys, "model", F.col("mean").alias("mae"), F.when(F.col("naive") > 0, 1.0 - F.col("mean") / F.col("naive")).alias("skill"))


def regime_check(rows: DataFrame, keys, flags: list[str]) -> DataFrame:
    """Folds in which train and test are both fully imputed, per missing flag."""
    d = rows.groupBy(*keys, "fold", "role").agg(*[F.bool_and(F.col(f) == 1).alias(f) for f in flags])
    long = d.select(*keys, "fold", "role", *flags).unpivot([*keys, "fold", "role"], flags, "flag", "all_imputed")
    both = long.groupBy(*keys, "flag", "fold").agg(
        (F.bool_and("all_imputed") & (F.count_distinct("role") == 2)).alias("bad"))
    return both.groupBy(*keys, "flag").agg(F.count_if("bad").alias("bad_folds"), F.count(F.lit(1)).alias("folds"))
