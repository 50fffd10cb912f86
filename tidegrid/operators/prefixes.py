"""Order statistics of everything up to a moment, for many moments at once.

A window over all earlier rows sorts a growing frame again for every moment.
Here a group's values are ranked once and laid out by time as a wavelet matrix:
bit by bit, counts of zeros lead each (moment, rank) to its value, so a group of
n values and q questions costs (n + q) log n. Groups of up to ``SHORT_ROWS`` values
lie in order of value instead, and each moment marks those it has seen: n steps a
moment, but of a nanosecond. Groups are dealt to tasks many at a
time. A group above ``CELL_ROWS`` is cut into cells by its own value quantiles;
running histograms of the cells over time say in which cell a rank lies, and the
cells are then solved like groups of their own, so no task holds such a group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CELL_ROWS = 1 << 16
CELLS = 64
TASK_ROWS = 1 << 17
SHORT_ROWS = 1 << 11
# Marks that are held at once.
MARKS = 1 << 21


class WaveletMatrix:
    """k-th smallest of any run of a sequence of small whole numbers."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.zeros = []
        for bit in reversed(range(self.bits)):
            one = (values >> bit & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]))
            values = np.concatenate([values[~one], values[one]])

    def kth(self, begin: np.ndarray, end: np.ndarray, k: np.ndarray) -> np.ndarray:
        """For each run [begin, end) its ``k``-th smallest number, from 0."""
        found = np.zeros(len(k), np.int64)
        for level, zeros in enumerate(self.zeros):
            a, b = zeros[begin], zeros[end]
            up = k >= b - a
            k = np.where(up, k - (b - a), k)
            begin, end = np.where(up, begin - a + zeros[-1], a), np.where(up, end - b + zeros[-1], b)
            found |= up.astype(np.int64) << (self.bits - 1 - level)
        return found


class _Groups:
    """Values of many groups, ordered by time and ranked within their group."""

    def __init__(self, group: np.ndarray, at: np.ndarray, value: np.ndarray):
        self.times = np.unique(at)
        self.key = np.sort(self._code(group, np.searchsorted(self.times, at)))
        by_time = np.lexsort((at, group))
        by_value = np.lexsort((value, group))
        self.ordered = value[by_value]
        n = int(group.max(initial=-1)) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=n))])
        rank = np.empty(len(value), np.int64)
        rank[by_value] = np.arange(len(value)) - self.first[group[by_value]]
        self.matrix = WaveletMatrix(rank[by_time])

    def _code(self, group: np.ndarray, moment: np.ndarray) -> np.ndarray:
        return group * (len(self.times) + 1) + moment

    def seen(self, group: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Run of each group's values up to and with a moment."""
        group = np.minimum(group, len(self.first) - 1)
        end = np.searchsorted(self.key, self._code(group, np.searchsorted(self.times, until, "right")))
        return self.first[group], np.maximum(end, self.first[group])

    def kth(self, group: np.ndarray, begin: np.ndarray, end: np.ndarray, k: np.ndarray) -> np.ndarray:
        return self.ordered[self.first[group] + self.matrix.kth(begin, end, k)]


def _ranks(n: np.ndarray, probs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower rank of each probability among ``n`` values, and how far the quantile lies behind it."""
    spot = (n[:, None] - 1) * probs[None, :]
    low = np.floor(spot)
    return low.astype(np.int64), spot - low


def at_moments(group: np.ndarray, at: np.ndarray, value: np.ndarray, reach: int, probs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Groups that are here as a whole: a row of each of their moments, the moment of each row, numbers and quantiles (NaN where there are none)."""
    real = ~np.isnan(value)
    _, moment, of = np.unique(pair(group, np.unique(at, return_inverse=True)[1]), return_index=True, return_inverse=True)
    g = group[moment]
    sizes = np.bincount(group[real])
    if sizes.max(initial=0) <= SHORT_ROWS and len(sizes) <= len(group) // 16:
        n, q = np.zeros(len(moment), np.int64), np.full((len(moment), len(probs)), np.nan)
        for mine, counts, taken in seen(group[real], at[real], value[real], g, at[moment] - reach):
            n[mine] = counts
            q[mine] = between(value[real][taken], np.cumsum(counts) - counts, counts, probs)
        return moment, of, n, q
    groups = _Groups(group[real], at[real], value[real])
    begin, end = groups.seen(g, at[moment] - reach)
    n = end - begin
    some = np.flatnonzero(n)
    low, share = _ranks(n[some], probs)
    flat = [np.repeat(x[some], len(probs)) for x in (g, begin, end)]
    a = groups.kth(*flat, low.reshape(-1))
    b = groups.kth(*flat, np.minimum(low + 1, n[some, None] - 1).reshape(-1))
    q = np.full((len(moment), len(probs)), np.nan)
    q[some] = (a + (b - a) * share.reshape(-1)).reshape(-1, len(probs))
    return moment, of, n, q


def seen(group: np.ndarray, at: np.ndarray, value: np.ndarray, g: np.ndarray, until: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Moments ``until`` of groups ``g``, in order of groups and some at a time: which, how many values each has seen, and the places of
    those, one moment after the other and in order of value."""
    by_value = np.lexsort((value, group))
    times = at[by_value]
    first = np.searchsorted(group[by_value], np.arange(int(g.max(initial=-1)) + 2))
    ends = np.searchsorted(g, np.arange(len(first)))
    start, held, counts, taken = 0, 0, [], []
    for k, (low, high) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        step = max(1, MARKS // max(high - low, 1))
        for a in range(ends[k], ends[k + 1], step):
            b = min(a + step, ends[k + 1])
            marks = until[a:b, None] >= times[None, low:high]
            counts.append(np.count_nonzero(marks, axis=1))
            taken.append(by_value[low + np.flatnonzero(marks) - np.repeat(np.arange(b - a) * (high - low), counts[-1])])
            held += marks.size
            if held >= MARKS or b == len(g):
                yield slice(start, b), np.concatenate(counts), np.concatenate(taken)
                start, held, counts, taken = b, 0, [], []


def between(values: np.ndarray, begin: np.ndarray, counts: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """Quantiles of runs of ordered values (NaN for a run of none)."""
    if not len(values):
        return np.full((len(counts), len(probs)), np.nan)
    low, share = _ranks(np.maximum(counts, 1), probs)
    top = np.maximum(counts - 1, 0)[:, None]
    a, b = (values[np.minimum(begin[:, None] + np.minimum(x, top), len(values) - 1)] for x in (low, low + 1))
    return np.where(counts[:, None] > 0, a + (b - a) * share, np.nan)


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for each pair of two."""
    return a * (int(b.max(initial=0)) + 1) + b


def codes(rows: pa.Table, by: list[str]) -> np.ndarray:
    """A number from 0 for each combination of values, nulls included."""
    out = np.zeros(rows.num_rows, np.int64)
    for name in by:
        index = rows.column(name).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        out = np.unique(pair(out, index), return_inverse=True)[1]
    return out


def lists(q: np.ndarray, some: np.ndarray, known: np.ndarray | None = None) -> pa.ListArray:
    """The rows of ``q`` as lists, null where ``some`` is false; with ``known`` only those of their values are not null."""
    ends = np.concatenate([[0], np.cumsum(np.where(some, q.shape[1], 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, mask=np.append(~some, False)), pa.array(q[some].reshape(-1), mask=None if known is None or known.all() else ~known))


def _solve(rows: pa.Table, by: list[str], reach: int, probs: np.ndarray) -> pa.Table:
    """Groups that are here as a whole: number and quantiles at every moment."""
    at, value = rows.column("at").to_numpy(), rows.column("value").to_numpy().astype(np.float64)
    moment, _, n, q = at_moments(codes(rows, by), at, value, reach, probs)
    taken = rows.select([*by, "at"]).take(pa.array(moment))
    return taken.append_column("n", pa.array(n, pa.int64())).append_column("q", lists(q, n > 0))


def _pick(table: pd.DataFrame, by: list[str], reach: int) -> pd.DataFrame:
    """Cells of large groups: the value behind each rank that was asked for."""
    group = table.groupby([*by, "cell"], sort=False, dropna=False).ngroup().to_numpy()
    real = table["slot"].isna().to_numpy()
    groups = _Groups(group[real], table["at"].to_numpy()[real], table["value"].to_numpy(np.float64)[real])
    asked = table[~real]
    g, k = group[~real], asked["k"].to_numpy(np.int64)
    begin, end = groups.seen(g, asked["at"].to_numpy() - reach)
    return asked[[*by, "at", "slot"]].assign(slot=asked["slot"].astype("int32"), value=groups.kth(g, begin, end, k))


def prefix_quantiles(df: DataFrame, by: Sequence[str], at: str, value: str, reach: int, probs: Sequence[float], n: str = "n", q: str = "q",
                     cell_rows: int = CELL_ROWS, cells: int = CELLS) -> DataFrame:
    """For each group and each of its moments ``at`` (whole numbers): how many non-null values lie at least ``reach`` before it, and
    their quantiles at ``probs`` as an array (null where there are none). Linear interpolation between ranks. Rows without a key or a moment take no part."""
    by, probs = list(by), [float(p) for p in probs]
    d = df.select(*by, F.col(at).cast("long").alias("at"), F.col(value).cast("double").alias("value")).dropna(subset=[*by, "at"])
    types = dict(d.dtypes)
    keys = ", ".join(f"`{c}` {types[c]}" for c in by)
    sizes = d.groupBy(*by).agg(F.count("value").alias("rows")).withColumn("large", F.col("rows") > cell_rows)
    total, large = sizes.agg(F.sum("rows"), F.max("large")).first()
    tasks = max(1, -(-(total or 0) // TASK_ROWS), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    levels = np.array(probs)
    small = d if not large else d.join(sizes.filter("NOT large").select(*by), by, "left_semi")
    dealt = small.withColumn("task", F.pmod(F.xxhash64(*by), F.lit(tasks)))
    out = dealt.groupBy("task").applyInArrow(lambda t: _solve(t, by, reach, levels), f"{keys}, at long, n long, q array<double>")
    if large:
        out = out.unionByName(_large(d.join(sizes.filter("large").select(*by), by, "left_semi"), by, keys, reach, levels, cells, tasks))
    return out.select(*by, F.col("at").alias(at), F.col("n").alias(n), F.col("q").alias(q))


def _large(d: DataFrame, by: list[str], keys: str, reach: int, probs: np.ndarray, cells: int, tasks: int) -> DataFrame:
    edges = d.groupBy(*by).agg(F.percentile_approx("value", [k / cells for k in range(1, cells)], 100 * cells).alias("edges"))
    placed = d.join(edges, by).withColumn("cell", F.size(F.filter("edges", lambda e: e < F.col("value")))).drop("edges")
    counts = placed.filter("value IS NOT NULL").groupBy(*by, "cell", (F.col("at") + reach).alias("at")).agg(F.count(F.lit(1)).alias("c"))
    moments = d.select(*by, "at").distinct()
    asked = moments.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))).withColumn("asks", F.lit(True))
    events = asked.join(counts, [*by, "cell", "at"], "full").withColumn("c", F.coalesce("c", F.lit(0)))
    # one running count for each cell, so a large group is spread over its cells
    before = events.withColumn("c", F.sum("c").over(W.partitionBy(*by, "cell").orderBy("at"))).filter("asks")
    across = before.withColumn("upto", F.sum("c").over(W.partitionBy(*by, "at").orderBy("cell"))).withColumn("n", F.sum("c").over(W.partitionBy(*by, "at")))
    ranks = []
    for k, p in enumerate(probs.tolist()):
        low = F.floor((F.col("n") - 1) * F.lit(p))
        ranks += [F.struct(F.lit(2 * k).alias("slot"), low.alias("r")), F.struct(F.lit(2 * k + 1).alias("slot"), F.least(low + 1, F.col("n") - 1).alias("r"))]
    first = F.col("upto") - F.col("c")
    wanted = across.filter("c > 0").select(*by, "at", "cell", first.alias("first"), "upto", F.explode(F.array(*ranks)).alias("s"))
    wanted = wanted.filter("s.r >= first AND s.r < upto").select(*by, "at", "cell", "s.slot", (F.col("s.r") - F.col("first")).alias("k"), F.lit(None).cast("double").alias("value"))
    items = placed.filter("value IS NOT NULL").select(*by, "at", "cell", F.lit(None).cast("int").alias("slot"), F.lit(None).cast("long").alias("k"), "value")
    both = items.unionByName(wanted).withColumn("task", F.pmod(F.xxhash64(*by, "cell"), F.lit(tasks)))
    found = both.groupBy("task").applyInPandas(lambda t: _pick(t, by, reach), f"{keys}, at long, slot int, value double")
    wide = found.groupBy(*by, "at").agg(*[F.max(F.when(F.col("slot") == s, F.col("value"))).alias(f"v{s}") for s in range(2 * len(probs))])
    quantiles = []
    for k, p in enumerate(probs.tolist()):
        spot = (F.col("n") - 1) * F.lit(p)
        quantiles.append(F.col(f"v{2 * k}") + (F.col(f"v{2 * k + 1}") - F.col(f"v{2 * k}")) * (spot - F.floor(spot)))
    sizes = across.groupBy(*by, "at").agg(F.max("n").alias("n"))
    joined = sizes.join(wide, [*by, "at"], "left")
    return joined.select(*by, "at", "n", F.when(F.col("n") > 0, F.array(*quantiles)).alias("q"))
