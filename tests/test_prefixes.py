"""Order statistics of prefixes against plain sorting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import prefixes
from tidegrid.operators.prefixes import WaveletMatrix, at_moments, prefix_quantiles

PROBS = [0.0, 0.05, 0.5, 0.77, 1.0]


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 300, 1000)
    begin = rng.integers(0, 999, 500)
    end = np.array([rng.integers(b + 1, 1001) for b in begin])
    k = np.array([rng.integers(0, e - b) for b, e in zip(begin, end)])
    want = [np.sort(values[b:e])[i] for b, e, i in zip(begin, end, k)]
    assert WaveletMatrix(values).kth(begin, end, k).tolist() == want


def _rows(seed, hot):
    rng = np.random.default_rng(seed)
    rows = []
    for key, n in (("a", hot), ("b", 40), (None, 25), ("empty", 6)):
        for k in range(n):
            value = None if key == "empty" or rng.random() < 0.1 else float(rng.choice([0.0, -1.5, 7.0, round(rng.normal(), 3)]))
            rows.append((key, k % 2, int(rng.integers(0, n // 2)) * 10, value))
    return rows


@pytest.mark.parametrize(("cell_rows", "cells"), [(1 << 16, 64), (50, 7), (1, 3)])
def test_prefix_quantiles(spark, cell_rows, cells):
    rows = _rows(cells, 600)
    df = spark.createDataFrame(rows, "key string, part int, at long, value double")
    got = {(r.key, r.part, r.at): (r.n, r.q) for r in prefix_quantiles(df, ["key", "part"], "at", "value", 25, PROBS, cell_rows=cell_rows, cells=cells).collect()}
    assert set(got) == {r[:3] for r in rows if r[0] is not None}
    for (key, part, at), (n, q) in got.items():
        seen = [v for k, p, t, v in rows if (k, p) == (key, part) and v is not None and t <= at - 25]
        assert n == len(seen)
        assert q is None if not seen else np.allclose(q, np.quantile(seen, PROBS))


def test_no_rows(spark):
    df = spark.createDataFrame([], "key string, at long, value double").withColumn("more", F.lit(1))
    assert prefix_quantiles(df, ["key"], "at", "value", 0, PROBS).count() == 0


@pytest.mark.parametrize("marks", [1 << 21, 500])
def test_short_groups_mark_what_they_have_seen(monkeypatch, marks):
    """The same numbers as from the wavelet matrix, also when the marks do not fit at once."""
    rng = np.random.default_rng(5)
    group, at = rng.integers(0, 7, 900), rng.integers(0, 60, 900)
    value = np.where((rng.random(900) < 0.1) | (group == 3), np.nan, rng.normal(size=900).round(1))
    monkeypatch.setattr(prefixes, "MARKS", marks)
    short = at_moments(group, at, value, 5, np.array(PROBS))
    monkeypatch.setattr(prefixes, "SHORT_ROWS", 0)
    for a, b in zip(short, at_moments(group, at, value, 5, np.array(PROBS))):
        assert np.array_equal(a, b, equal_nan=True)
