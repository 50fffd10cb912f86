"""Scans, quantiles and folds against plain pandas, with stretches far shorter than the series."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidegrid.operators import features as wf
from tidegrid.operators import grid as rg
from tidegrid.operators import netload as ls
from tidegrid.operators.quantiles import exact_quantiles
from tidegrid.operators.scan import Scan, drop_halo, halo_window, running, with_halo

K = ["series_id"]


def _series(seed, n=300, holes=0.3, names=("a", "b")):
    r = np.random.default_rng(seed)
    return [(s, 30 * k, None if r.random() < holes else round(float(r.normal(50, 20)), 2)) for s in names for k in range(n)]


def test_running_matches_pandas(frame):
    d = frame(_series(1))
    scans = [
        Scan("held", "last", F.col("value")), Scan("ahead", "last", F.col("value"), backward=True),
        Scan("total", "sum", F.col("value")), Scan("top", "max", F.col("value"), inclusive=False), Scan("seen", "count", F.col("value")),
    ]
    got = running(d, K, ["ts"], scans, stretch=7200).toPandas().sort_values(["series_id", "ts"])
    for _, g in got.groupby("series_id"):
        v = g["value"]
        np.testing.assert_allclose(g["held"], v.ffill())
        np.testing.assert_allclose(g["ahead"], v.bfill())
        np.testing.assert_allclose(g["total"], v.cumsum().ffill())
        np.testing.assert_allclose(g["top"], v.cummax().ffill().shift(1))
        assert (g["seen"].to_numpy() == v.notna().cumsum().to_numpy()).all()


def test_halo_matches_pandas(frame):
    d = with_halo(frame(_series(2)), "ts", before=6 * 1800, stretch=4 * 1800)
    w = halo_window(K, "ts")
    d = drop_halo(d.withColumns({"lag5": F.lag("value", 5).over(w), "m": F.avg("value").over(w.rowsBetween(-4, 0))}))
    got = d.toPandas().sort_values(["series_id", "ts"])
    assert len(got) == 600
    for _, g in got.groupby("series_id"):
        np.testing.assert_allclose(g["lag5"], g["value"].shift(5))
        np.testing.assert_allclose(g["m"], g["value"].rolling(5, min_periods=1).mean())


def test_exact_quantiles(spark, frame):
    rows = _series(3, 500, 0.2, ("a", "b", "c")) + [("flat", k, 7.0) for k in range(50)] + [("one", 0, -3.5)]
    rows += [("wide", k, (-1) ** k * 10.0 ** (k % 13 - 6)) for k in range(101)]
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = exact_quantiles(frame(rows), K, "value", probs, count="n").toPandas().set_index("series_id")
    for s, g in pd.DataFrame(rows, columns=["s", "m", "v"]).groupby("s"):
        v = g["v"].dropna().astype(float)
        assert got.loc[s, "n"] == len(v)
        for name, p in probs.items():
            assert abs(got.loc[s, name] - np.quantile(v, p)) <= 1e-9 * max(1, abs(np.quantile(v, p)))


def test_interpolate_fills_the_first_cells_of_a_long_gap(frame):
    v = [None, 1, None, None, None, None, 6, 7, None, None, None, None, None]
    d = rg.fill_linear(frame([("a", 30 * k, x) for k, x in enumerate(v)], "grid_ts", "y"), K, 1800, 90)
    got = [None if pd.isna(x) else x for x in d.toPandas().sort_values("grid_ts")["y"]]
    assert got == [1, 1, 2, 3, 4, None, 6, 7, 7, 7, 7, None, None]


def test_carry_deficit_keeps_the_day_total(frame):
    r = np.random.default_rng(4)
    rows = [("a", 30 * k, None if r.random() < 0.1 else float(r.integers(-40, 60))) for k in range(48 * 20)]
    got = ls.carry_deficit(frame(rows, "grid_ts", "raw_net"), K).toPandas().sort_values("grid_ts")
    for _, day in got.groupby(got["grid_ts"].dt.date):
        debt = 0.0
        for raw, net in zip(day["raw_net"], day["net"]):
            if np.isnan(raw):
                assert np.isnan(net)
                continue
            want = max(raw + debt, 0.0)
            debt = min(raw + debt, 0.0)
            assert abs(net - want) < 1e-9


def test_causal_impute_matches_expanding_median(frame):
    rows = _series(5, 200, 0.4)
    got = wf.causal_impute(frame(rows, "grid_ts", "y"), K).toPandas().sort_values(["series_id", "grid_ts"])
    want = pd.DataFrame(rows, columns=["series_id", "m", "v"]).astype({"v": float})
    for s, g in want.groupby("series_id"):
        v = g["v"]
        full = v.fillna(v.expanding().median().shift(1)).fillna(v.dropna().iloc[0])
        np.testing.assert_allclose(got[got["series_id"] == s]["y"].to_numpy(), full.to_numpy())


def test_empty_and_single_inputs(frame):
    empty = frame([]).filter("value is not null")
    assert rg.resample(empty, K, 1800).count() == 0
    one = rg.resample(frame([("a", 5, 3.0)]), K, 1800, "sum").collect()
    assert len(one) == 1 and one[0]["y"] == 3.0
    assert exact_quantiles(empty, K, "value", {"p": 0.5}).count() == 0
    none = wf.causal_impute(frame([("a", 0, None), ("a", 30, None)], "grid_ts", "y"), K).collect()
    assert [r["y"] for r in none] == [0.0, 0.0]
