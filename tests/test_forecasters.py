"""Ablation, smoothing over whole histories, and series too short for a model."""

import random

import pytest
from pyspark.sql import functions as F

from tidegrid.operators import forecast as fc
from tidegrid.operators import recursive as rc

K = ["series_id"]


def test_smoothing_reads_the_whole_history(frame):
    rng = random.Random(1)
    data = {"a": [rng.uniform(0, 9) for _ in range(300)], "b": [5.0], "c": [1.0, None, 3.0, None]}
    grid = frame([(s, 360 * k, v) for s, vs in data.items() for k, v in enumerate(vs)], ts="grid_ts", value="y")
    want = {}
    for s, vs in data.items():
        best = None
        for alpha in (0.05, 0.4, 0.9):
            level, error, held = None, 0.0, None
            for v in vs:
                held = v if v is not None else held
                level = held if level is None else level
                error += (held - level) ** 2
                level += alpha * (held - level)
            best = min(best or (error, alpha, level), (error, alpha, level))
        want[s] = (best[1], best[2])
    for stretch in (1024, 7, 1):
        out = fc.exponential_smoothing(grid, K, 21600, 1, [0.05, 0.4, 0.9], stretch=stretch).collect()
        assert {r["series_id"]: (r["alpha"], pytest.approx(r["pred"])) for r in out} == want


def test_short_series_come_back(frame):
    grid = frame([("long", 360 * k, k % 4) for k in range(60)] + [("short", 360 * k, k) for k in range(3)], ts="grid_ts", value="y")
    recipe = rc.Recipe((1, 4))
    model = fc.fit_pooled(rc.supervised(grid, K, 21600, recipe), "linear")
    out = rc.roll_forward(rc.model_step(model, recipe), grid, K, 21600, 3, recipe).collect()
    assert sorted((r["series_id"], r["lead"], r["status"], r["pred"] is None) for r in out) == [(s, h, "ok" if s == "long" else "short", s == "short") for s in ("long", "short") for h in (1, 2, 3)]


def test_features_of_a_lead_are_those_of_the_extended_series(frame, spark):
    rng = random.Random(5)
    both = frame([(s, 360 * k, rng.uniform(0, 9)) for s in ("a", "b") for k in range(40)], ts="grid_ts", value="y")
    both = both.withColumns({"light": F.when(F.hour("grid_ts") == 0, 0.0).otherwise(1.0), "cov": F.dayofmonth("grid_ts") * 1.0})
    recipe = rc.Recipe((1, 2, 5), (3, 6), True, ("hour", "dow_sin"), ("cov",), "light")
    cells = fc.future_cells(both, K, 21600, 9).select(*K, F.col("target_dt").alias("grid_ts"))
    future = cells.withColumns({"light": F.when(F.hour("grid_ts") == 0, 0.0).otherwise(1.0), "cov": F.dayofmonth("grid_ts") * 1.0})
    step = rc.weighted_step({"y_lag_1": 0.4, "y_lag_5": 0.1, "y_rolling_mean_3": 0.3, "y_rolling_std_6": 0.2, "y_rolling_max_3": 0.1, "y_diff_1": 0.2, "cov": 0.05, "dow_sin": 1.0})
    out = rc.roll_forward(step, both, K, 21600, 9, recipe, future, checkpoint_every=4, trace=True).cache()
    extended = both.unionByName(future.join(out.select(*K, F.col("target_dt").alias("grid_ts"), F.col("pred").alias("y")), [*K, "grid_ts"]))
    want = {(r["series_id"], r["grid_ts"]): [r[c] for c in recipe.names] for r in rc.history_features(extended, K, 21600, recipe).collect()}
    rows = out.collect()
    assert len(rows) == 18
    for r in rows:
        assert r["features"] == pytest.approx(want[(r["series_id"], r["target_dt"])])
        assert (r["pred"] == 0) == (r["target_dt"].hour == 0)
    hidden = future.filter("series_id <> 'b' or cov < 12")
    states = rc.roll_forward(step, both, K, 21600, 9, recipe, hidden).groupBy("series_id", "status").count().collect()
    assert sorted(map(tuple, states)) == [("a", "ok", 9), ("b", "unknown", 9)]


def test_a_signed_target_gives_up_tweedie(frame):
    grid = frame([("a", 360 * k, (k % 4) - 2) for k in range(60)], ts="grid_ts", value="y")
    assert type(fc.fit_pooled(fc.training_frame(grid, K, 360, [1, 4]), "linear", "tweedie")).__name__ == "LinearRegressionModel"
    whole = frame([("a", 360 * k, k % 4) for k in range(60)], ts="grid_ts", value="y")
    assert type(fc.fit_pooled(fc.training_frame(whole, K, 360, [1, 4]), "linear", "tweedie")).__name__ == "GeneralizedLinearRegressionModel"


def test_ablation_finds_what_matters(spark):
    rng, rows = random.Random(2), []
    for k in range(400):
        x, noise, other = (rng.uniform(-1, 1) for _ in range(3))
        rows.append(("s", k % 2, "test" if rng.random() < 0.3 else "train", 1.0, x, noise, 3 * x + 0.2 * other))
    d = spark.createDataFrame(rows, "series_id string, fold long, role string, one double, x double, noise double, label double")
    models = {"plain": lambda: fc.regressor("linear"), "robust": lambda: fc.regressor("linear", "huber")}
    arms = fc.ablation_errors(d, K, ["one"], ["x", "noise"], models, {"cross": ("x", "noise")})
    assert {r["arm"] for r in arms.collect()} == {"all", "none", "without_x", "without_noise"}
    advice = {(r["arm"], r["model"]): r["advice"] for r in fc.ablation_advice(fc.ablation_report(arms, K), K).collect()}
    assert advice[("without_x", None)] == "keep" and advice[("without_noise", None)] != "keep"
    assert advice[("none", "plain")] == advice[("none", "robust")] == "keep"


# change in per cent without everything, then without the covariate, for each model; and the advice
RULES = [
    ([(10, 4), (10, 5), (10, 6)], "keep"),
    ([(10, 9), (10, 5), (10, 1)], "likely keep"),
    ([(10, -3), (10, -4), (10, -5)], "remove"),
    ([(10, -5), (10, -3), (10, 0)], "likely remove"),
    ([(10, 2.5), (10, 2.5), (10, 2.5)], "neutral"),
    ([(10, 9), (10, -9), (10, 0)], "neutral"),
    ([(-4, 9), (-5, 9), (10, 9)], "undecided"),
    ([(-4, -90), (10, 5), (10, 5)], "keep"),
]


def test_advice_rules(spark):
    rows = []
    for n, (models, _) in enumerate(RULES):
        for m, (none, without) in enumerate(models):
            rows += [(f"s{n}", f"m{m}", "all", 100.0), (f"s{n}", f"m{m}", "none", 100.0 + none), (f"s{n}", f"m{m}", "without_c", 100.0 + without)]
    report = fc.ablation_report(spark.createDataFrame(rows, "series_id string, model string, arm string, mae double"), K)
    out = fc.ablation_advice(report, K)
    assert {r["series_id"]: r["advice"] for r in out.filter(F.col("arm") == "without_c").collect()} == {f"s{n}": want for n, (_, want) in enumerate(RULES)}
    alone = {(r["series_id"], r["model"]): r["advice"] for r in out.filter("arm = 'none'").collect()}
    assert alone[("s0", "m0")] == "keep" and alone[("s6", "m0")] == "remove"


def test_the_better_model_leads_the_benchmark(spark):
    rng = random.Random(3)
    rows = [("s", k % 3, "test" if k % 4 == 0 else "train", x := rng.uniform(-1, 1), abs(x) + 0.01 * rng.random()) for k in range(600)]
    d = spark.createDataFrame(rows, "series_id string, fold long, role string, x double, label double")
    out = fc.benchmark(d, K, ["x"], {"line": lambda: fc.regressor("linear"), "forest": lambda: fc.regressor("forest")}).orderBy("position").collect()
    assert [(r["model"], r["n_folds"]) for r in out] == [("forest", 3), ("line", 3)] and out[0]["mae"] < out[1]["mae"] / 2


def test_halving_lets_losers_leave():
    error, asked = [5, 3, 9, 1, 7, 3], []

    def score(k, fold):
        asked.append((k, fold))
        return error[k] + (10 if (k, fold) == (3, "z") else 0)

    out = fc.halving(6, ["x", "y", "z"], score)
    assert sorted(k for k, f in asked if f == "y") == [1, 3, 5] and sorted(k for k, f in asked if f == "z") == [1, 3]
    assert [(k, n) for k, _, n, _ in out] == [(1, 3), (3, 3), (5, 2), (0, 1), (4, 1), (2, 1)]
    assert fc.halving(0, ["x"], score) == [] and len(fc.halving(1, ["x", "y"], score)) == 1


def test_draws_repeat():
    space = {"a": range(5), "b": ["u", "v"]}
    assert fc.draw_params(space, 8, 1) == fc.draw_params(space, 8, 1) != fc.draw_params(space, 8, 2)
    assert all(d["a"] in range(5) and d["b"] in "uv" for d in fc.draw_params(space, 8))


def test_a_fit_reads_its_own_fold(spark):
    d = spark.range(60).select(
        F.lit("s").alias("series_id"), (F.col("id") % 3).alias("fold"), F.when(F.col("id") % 4 == 0, "test").otherwise("train").alias("role"),
        (F.col("id") % 5).cast("double").alias("x"), (F.col("id") % 5 * 2.0).alias("label"))
    e = fc.fold_errors(d, K, ["x"], {"linear": lambda: fc.regressor("linear")})
    plan = e._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(") == 3  # the test rows of three folds
    assert e.count() == 15 and e.filter(F.abs(F.col("pred") - F.col("label")) > 1e-6).count() == 0
