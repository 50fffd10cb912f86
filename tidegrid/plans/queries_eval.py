"""Splits, metrics, ranking and horizon scoring over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.functions import metrics as mt
from tidegrid.functions.metrics import rounded
from tidegrid.operators import analytics as ag
from tidegrid.operators import horizon as hz
from tidegrid.operators import ranking as bm
from tidegrid.operators import splits as cv
from tidegrid.operators.scan import drop_halo, halo_window, with_halo
from tidegrid.plans import inputs as i
from tidegrid.plans.registry import cte, query
from tidegrid.session import cut_lineage, stored

K = ["series_id"]
MODELS = ["seasonal_naive", "previous", "mean", "zero", "profile"]


def rnd(df, **places):
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


def nudge(df, *columns):
    """Keeps exact halves off the rounding border, on which two engines may differ."""
    return df.withColumns({c: F.col(c) + 1e-7 for c in columns})


# ---- predictions: the fleet load x walk-forward folds x five simple models ---------------------
cte("numbered", "SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY grid_ts) - 1 AS rn, count(*) OVER (PARTITION BY series_id) AS n_rows, lag(y, 4) OVER (PARTITION BY series_id ORDER BY grid_ts) AS y4, lag(y, 1) OVER (PARTITION BY series_id ORDER BY grid_ts) AS y1 FROM load6", "load6")
cte("walk", "SELECT series_id, fold, 0 AS train_lo, greatest(0, n - s * (5 - fold) - 2) AS train_hi, n - s * (5 - fold) AS test_lo, least(n - s * (5 - fold) + s, n) AS test_hi FROM (SELECT series_id, count(*) AS n, greatest(1, count(*) // 6) AS s FROM load6 GROUP BY 1), unnest(generate_series(0, 4)) AS u(fold)", "load6")
cte("folds", "SELECT d.series_id, fold, CASE WHEN rn >= test_lo AND rn < test_hi THEN 'test' ELSE 'train' END AS role, grid_ts, y, y1, y4, rn FROM numbered d JOIN walk f ON f.series_id = d.series_id AND ((rn >= test_lo AND rn < test_hi) OR (rn >= train_lo AND rn < train_hi))", "numbered walk")
cte("fold_mean", "SELECT series_id, fold, avg(y) AS m FROM folds WHERE role = 'train' GROUP BY 1, 2", "folds")
cte("fold_slot", "SELECT series_id, fold, hour(grid_ts) AS h, avg(y) AS m FROM folds WHERE role = 'train' GROUP BY 1, 2, 3", "folds")
cte("preds", """SELECT t.series_id, t.fold, t.grid_ts, t.y, u.model, CASE u.model WHEN 'seasonal_naive' THEN y4 WHEN 'previous' THEN y1 WHEN 'mean' THEN a.m WHEN 'zero' THEN 0 ELSE coalesce(b.m, a.m) END AS pred
FROM folds t JOIN fold_mean a ON a.series_id = t.series_id AND a.fold = t.fold LEFT JOIN fold_slot b ON b.series_id = t.series_id AND b.fold = t.fold AND b.h = hour(t.grid_ts),
(VALUES ('seasonal_naive'), ('previous'), ('mean'), ('zero'), ('profile')) AS u(model) WHERE t.role = 'test'""", "folds fold_mean fold_slot")


def _folds(spark, sf):
    d = with_halo(i.load6(spark, sf), "grid_ts", 5 * i.SIX)
    w = halo_window(K, "grid_ts")
    d = drop_halo(d.withColumns({"y4": F.lag("y", 4).over(w), "y1": F.lag("y", 1).over(w)}))
    d = cv.number_rows(d, K, seconds=i.SIX)
    table = cv.fold_table(d.select(*K, "n_rows").distinct(), K)
    return cv.assign_folds(d, table, K)


def predictions(spark, sf):
    f = _folds(spark, sf)
    train = f.filter("role = 'train'")
    slots = train.groupBy(*K, "fold", F.hour("grid_ts").alias("h")).agg(F.sum("y").alias("s"), F.count("y").alias("n"))
    means = slots.groupBy(*K, "fold").agg((F.sum("s") / F.sum("n")).alias("a"))
    test = f.filter("role = 'test'").withColumn("h", F.hour("grid_ts"))
    test = test.join(means, [*K, "fold"]).join(slots.select(*K, "fold", "h", (F.col("s") / F.col("n")).alias("b")), [*K, "fold", "h"], "left")
    pred = {"seasonal_naive": F.col("y4"), "previous": F.col("y1"), "mean": F.col("a"), "zero": F.lit(0.0), "profile": F.coalesce("b", "a")}
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), pred[m].alias("pred")) for m in MODELS])).alias("p")
    return test.select(*K, "fold", "grid_ts", "y", each).select(*K, "fold", "grid_ts", "y", "p.model", "p.pred")


cte("scales", "SELECT series_id, fold, avg(abs(d1)) AS s1, coalesce(avg(abs(d4)), avg(abs(d1))) AS s4 FROM (SELECT series_id, fold, y - lag(y, 1) OVER w AS d1, y - lag(y, 4) OVER w AS d4 FROM folds WHERE role = 'train' WINDOW w AS (PARTITION BY series_id, fold ORDER BY grid_ts)) GROUP BY 1, 2", "folds")
METRIC_SQL = {
    "mae": "avg(abs(y - pred))", "rmse": "sqrt(avg((y - pred) ** 2))", "mape": "100 * avg(CASE WHEN y <> 0 THEN abs((y - pred) / y) END)",
    "smape": "100 * avg(CASE WHEN abs(y) + abs(pred) <> 0 THEN 2 * abs(y - pred) / (abs(y) + abs(pred)) END)",
    "mase": "CASE WHEN max(s1) > 0 THEN avg(abs(y - pred)) / max(s1) END", "seasonal_mase": "CASE WHEN max(s4) > 0 THEN avg(abs(y - pred)) / max(s4) END",
    "r_squared": "CASE WHEN var_pop(y) > 0 THEN 1 - sum((y - pred) ** 2) / (var_pop(y) * count(y)) END",
    "pinball_q90": "avg(greatest(0.9 * (y - pred), (0.9 - 1) * (y - pred)))", "coverage": "avg(CASE WHEN y >= pred * 0.8 AND y <= pred * 1.2 THEN 1.0 ELSE 0 END)",
}
cte("metrics_wide", "SELECT p.series_id, p.fold, model, " + ", ".join(f"{v} AS {k}" for k, v in METRIC_SQL.items()) + " FROM preds p JOIN scales s ON s.series_id = p.series_id AND s.fold = p.fold GROUP BY 1, 2, 3", "preds scales")


def _with_scales(spark, sf):
    train = _folds(spark, sf).filter("role = 'train'")
    s = mt.train_scales(train, [*K, "fold"], 4, i.SIX)
    p = predictions(spark, sf).join(s, [*K, "fold"])
    return p.withColumns({"lower": F.col("pred") * 0.8, "upper": F.col("pred") * 1.2})


RANKED = ["mae", "rmse", "mase", "seasonal_mase"]


def _long(spark, sf):
    return mt.compute_all(_with_scales(spark, sf), [*K, "model", "fold"], RANKED)


for _n, _name in enumerate(("mae", "rmse", "mape", "smape", "mase", "seasonal_mase", "r_squared"), start=1):

    def _metric(spark, sf, name=_name):
        d = mt.compute_all(_with_scales(spark, sf), [*K, "model", "fold"], [name], long=False)
        return d.select(*K, "model", "fold", F.round(name, 6).alias(name))

    query(f"MT{_n}_{_name}", f"SELECT series_id, model, fold, round({_name}, 6) AS {_name} FROM metrics_wide", "metrics_wide")(_metric)


@query("MT8_pinball_q90", "SELECT series_id, model, fold, round(pinball_q90, 6) AS pinball_q90 FROM metrics_wide", "metrics_wide")
def _(spark, sf):
    return rnd(mt.compute_all(predictions(spark, sf), [*K, "model", "fold"], ["pinball_q90"], long=False), pinball_q90=6)


@query("MT9_peak_weighted_mae", """WITH a AS (SELECT series_id, model, median(y) AS med, quantile_cont(y, 0.9) AS p90 FROM preds WHERE pred IS NOT NULL GROUP BY 1, 2), b AS (SELECT p.series_id, p.model, count(*) AS n, quantile_cont(y, 0.9) AS a90 FROM preds p JOIN a USING (series_id, model) WHERE y > med AND pred IS NOT NULL GROUP BY 1, 2),
c AS (SELECT a.*, CASE WHEN p90 - med > 0 THEN p90 - med WHEN n >= 8 THEN a90 - med END AS spread FROM a LEFT JOIN b USING (series_id, model)),
w AS (SELECT p.series_id, p.model, abs(y - pred) AS e, CASE WHEN spread > 0 THEN 1 + least(greatest((y - med) / spread, 0), 9) ELSE 1 END AS w FROM preds p JOIN c USING (series_id, model) WHERE pred IS NOT NULL)
SELECT series_id, model, round(sum(w * e) / sum(w), 4) AS peak_weighted_mae FROM w GROUP BY 1, 2""", "preds")
def _(spark, sf):
    return rnd(mt.compute_all(predictions(spark, sf), [*K, "model"], ["peak_weighted_mae"], long=False), peak_weighted_mae=4)


@query("MT10_coverage", "SELECT series_id, model, fold, round(coverage, 6) AS coverage FROM metrics_wide", "metrics_wide")
def _(spark, sf):
    return rnd(mt.compute_all(_with_scales(spark, sf), [*K, "model", "fold"], ["coverage"], long=False), coverage=6)


ALL = list(METRIC_SQL)


@query("MT11_compute_all", "SELECT series_id, model, fold, m AS metric, round(v, 6) AS value FROM (SELECT series_id, model, fold, unnest(['" + "', '".join(ALL) + "']) AS m, unnest([" + ", ".join(f"CAST({m} AS DOUBLE)" for m in ALL) + "]) AS v FROM metrics_wide)", "metrics_wide")
def _(spark, sf):
    return rnd(mt.compute_all(_with_scales(spark, sf), [*K, "model", "fold"], ALL), value=6)


@query("MT12_custom_metric", "SELECT series_id, model, fold, round(max(abs(y - pred)) / (1 + avg(y)), 6) AS worst_share FROM preds GROUP BY 1, 2, 3", "preds")
def _(spark, sf):
    mt.register_custom("worst_share", "max(abs(y_true - y_pred)) / (1 + avg(y_true))")
    return rnd(mt.compute_all(predictions(spark, sf), [*K, "model", "fold"], ["worst_share"], long=False), worst_share=6)


@query("MT13_crps", "SELECT experiment, model_name, lead_minutes, round(2 * avg((SELECT avg(greatest(q * 0.05 * (actual - predicted * (0.5 + 0.05 * q)), (q * 0.05 - 1) * (actual - predicted * (0.5 + 0.05 * q)))) FROM (SELECT unnest(generate_series(1, 19)) AS q))) + 1e-7, 4) AS crps FROM scored GROUP BY 1, 2, 3", "scored")
def _(spark, sf):
    d = ag.scored(i.forecast_log(spark, sf), i.actuals(spark, sf), 720)
    q = F.transform(F.sequence(F.lit(1), F.lit(19)), lambda k: F.col("predicted") * (0.5 + 0.05 * k))
    return rnd(d.groupBy("experiment", "model_name", "lead_minutes").agg((F.avg(mt.crps(F.col("actual"), q)) + 1e-7).alias("crps")), crps=4)


@query("MT14_daily_space", "SELECT series_id, model, fold, round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p) ** 2)), 4) AS rmse FROM (SELECT series_id, model, fold, CAST(grid_ts AS DATE) AS d, sum(y) AS y, sum(pred) AS p FROM preds WHERE pred IS NOT NULL GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3 HAVING count(*) >= 2", "preds")
def _(spark, sf):
    by = [*K, "model", "fold"]
    return rnd(mt.compute_all(mt.daily_space(predictions(spark, sf), by), by, ["mae", "rmse"], long=False), mae=4, rmse=4)


@query("MT15_bias_amplitude", "SELECT series_id, model, round(CASE WHEN sum(y) > 0 THEN 100 * (sum(pred) / sum(y) - 1) END, 4) AS bias_pct, round(CASE WHEN stddev_pop(y) > 0 THEN stddev_pop(pred) / stddev_pop(y) END, 4) AS amplitude_ratio, round(avg(pred * 0.4), 4) AS width FROM preds WHERE pred IS NOT NULL GROUP BY 1, 2", "preds")
def _(spark, sf):
    d = predictions(spark, sf).groupBy(*K, "model").agg(mt.bias_pct().alias("bias_pct"), mt.amplitude_ratio().alias("amplitude_ratio"), F.avg(F.col("pred") * 0.4).alias("width"))
    return rnd(d, bias_pct=4, amplitude_ratio=4, width=4)


# ---- splits --------------------------------------------------------------------------------
@query("FLAGSHIP_fold_accuracy", "SELECT series_id, fold, model, count(pred) AS n, round(avg(abs(y - pred)), 4) AS mae, round(sqrt(avg((y - pred) ** 2)), 4) AS rmse FROM preds GROUP BY 1, 2, 3", "preds")
def _(spark, sf):
    d = predictions(spark, sf).groupBy(*K, "fold", "model").agg(F.count("pred").alias("n"), mt.mae().alias("mae"), mt.rmse().alias("rmse"))
    return rnd(d, mae=4, rmse=4)


@query("CV1_walk_forward", "SELECT series_id, fold, train_lo, train_hi, test_lo, test_hi FROM walk", "walk")
def _(spark, sf):
    d = i.load6(spark, sf).groupBy(*K).agg(F.count(F.lit(1)).alias("n_rows"))
    return cv.fold_table(d, K)


@query("CV1_assigned_rows", "SELECT series_id, fold, role, grid_ts FROM folds", "folds")
def _(spark, sf):
    return _folds(spark, sf).select(*K, "fold", "role", "grid_ts")


@query("CV2_sliding_window", """WITH s AS (SELECT series_id, n, z, greatest(z, (n - z - 2) // 2) AS tr FROM (SELECT series_id, count(*) AS n, greatest(1, count(*) // 6) AS z FROM load6 GROUP BY 1)),
t AS (SELECT *, tr + 2 + CAST(round_even(fold * (greatest(tr + 2, n - z) - tr - 2) / 4.0, 0) AS BIGINT) AS a FROM s, unnest(generate_series(0, 4)) AS u(fold))
SELECT series_id, fold, greatest(0, greatest(0, a - 2) - tr) AS train_lo, greatest(0, a - 2) AS train_hi, a AS test_lo, least(a + z, n) AS test_hi FROM t""", "load6")
def _(spark, sf):
    d = i.load6(spark, sf).groupBy(*K).agg(F.count(F.lit(1)).alias("n_rows"))
    return cv.fold_table(d, K, strategy="sliding_window")


@query("CV3_holdout", "SELECT series_id, grid_ts, CASE WHEN rn < floor(n_rows * 0.8) THEN 'train' ELSE 'test' END AS role FROM numbered", "numbered")
def _(spark, sf):
    return cv.holdout(cv.number_rows(i.load6(spark, sf), K, seconds=i.SIX)).select(*K, "grid_ts", "role")


@query("CV4_data_checks", "SELECT series_id, count(y) AS measured, CASE WHEN count(y) < 50 THEN 'too short' ELSE 'ok' END AS status, count(y) >= 60 AS ablation_ok FROM sparse6 GROUP BY 1", "sparse6")
def _(spark, sf):
    return cv.data_checks(i.sparse6(spark, sf), K, ablation_min=60)


# ---- ranking -------------------------------------------------------------------------------
@query("BM1_fold_scoring", "SELECT series_id, model, fold, count(pred) AS n, round(avg(abs(y - pred)), 4) AS mae, round(sqrt(avg((y - pred) ** 2)), 4) AS rmse FROM preds GROUP BY 1, 2, 3", "preds")
def _(spark, sf):
    d = predictions(spark, sf).groupBy(*K, "model", "fold").agg(F.count("pred").alias("n"), mt.mae().alias("mae"), mt.rmse().alias("rmse"))
    return rnd(d, mae=4, rmse=4)


cte("long_metrics", "SELECT series_id, model, fold, m AS metric, v AS value FROM (SELECT series_id, model, fold, unnest(['mae', 'rmse', 'mase', 'seasonal_mase']) AS m, unnest([mae, rmse, mase, seasonal_mase]) AS v FROM metrics_wide)", "metrics_wide")


@query("BM2_mean_over_folds", "SELECT series_id, model, metric, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, count(value) AS n_folds FROM long_metrics GROUP BY 1, 2, 3", "long_metrics")
def _(spark, sf):
    return rnd(bm.fold_summary(_long(spark, sf), K), mean=4, std=4)


POS = "CASE model WHEN 'seasonal_naive' THEN 0 WHEN 'previous' THEN 1 WHEN 'mean' THEN 2 WHEN 'zero' THEN 3 ELSE 4 END"
cte("fold_rank", f"""SELECT series_id, model, fold, sum(r * CASE WHEN metric = 'mae' THEN 4 ELSE 1 END) / sum(CASE WHEN metric = 'mae' THEN 4 ELSE 1 END) AS fold_rank FROM
(SELECT *, row_number() OVER (PARTITION BY series_id, fold, metric ORDER BY coalesce(round(value, 9), 'inf'::DOUBLE), {POS}) AS r, min(coalesce(round(value, 9), 'inf'::DOUBLE)) OVER (PARTITION BY series_id, fold, metric) AS best FROM long_metrics) WHERE best < 'inf'::DOUBLE GROUP BY 1, 2, 3""", "long_metrics")


@query("BM3_composite_rank", f"SELECT series_id, model, round(mean_rank, 6) AS mean_rank, row_number() OVER (PARTITION BY series_id ORDER BY round(mean_rank, 9), {POS}) AS final_rank FROM (SELECT series_id, model, avg(fold_rank) AS mean_rank FROM fold_rank GROUP BY 1, 2)", "fold_rank")
def _(spark, sf):
    return rnd(bm.composite_rank(bm.fold_ranks(_long(spark, sf), K, MODELS, RANKED, "mae"), K, MODELS), mean_rank=6)


def _ranked(spark, sf):
    r = cut_lineage(bm.fold_ranks(_long(spark, sf), K, MODELS, RANKED, "mae"))
    return bm.composite_rank(r, K, MODELS).join(bm.rank_bootstrap(r, K), [*K, "model"], "left")


@query("BM4_rank_bootstrap")
def _(spark, sf):
    return rnd(_ranked(spark, sf), mean_rank=6, rank_lo=6, rank_hi=6)


@query("BM5_tie_flag")
def _(spark, sf):
    return bm.tie_flags(_ranked(spark, sf), K).select(*K, "model", "final_rank", "tied", "label")


@query("BM6_instability", """SELECT series_id, model, reason IS NOT NULL AS unstable, reason FROM (SELECT series_id, model, CASE WHEN avg(value) <= 0 THEN NULL WHEN CASE WHEN median(value) > 0 THEN max(value) / median(value) ELSE 'inf'::DOUBLE END >= 10 THEN 'blow-up'
WHEN stddev_pop(value) / avg(value) >= 1 THEN 'spread' END AS reason FROM long_metrics WHERE metric = 'mae' AND value IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2)""", "long_metrics")
def _(spark, sf):
    return bm.instability(_long(spark, sf), K, "mae")


def _p(z: str) -> str:
    x = f"(abs({z}) / sqrt(2.0))"
    t = f"(1.0 / (1.0 + 0.3275911 * {x}))"
    return f"(((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t} * exp(-{x} * {x}))"


cte("mae_pairs", "SELECT a.series_id, a.fold, a.model AS model_a, b.model AS model_b, a.value - b.value AS d FROM long_metrics a JOIN long_metrics b ON a.series_id = b.series_id AND a.fold = b.fold AND a.metric = 'mae' AND b.metric = 'mae' AND a.model < b.model", "long_metrics")


@query("BM7_pairwise_fold_test", f"""SELECT series_id, model_a, model_b, round(mean_diff, 4) AS mean_diff, n, round(z, 4) AS statistic, round({_p('z')}, 4) AS p_value FROM (SELECT series_id, model_a, model_b, avg(d) AS mean_diff, count(d) AS n, CASE WHEN stddev_samp(d) > 1e-12 THEN avg(d) / (stddev_samp(d) / sqrt(count(d))) ELSE 0 END AS z FROM mae_pairs GROUP BY 1, 2, 3 HAVING count(d) >= 2)""", "mae_pairs")
def _(spark, sf):
    return rnd(bm.pairwise_fold_test(_long(spark, sf), K, "mae"), mean_diff=4, statistic=4, p_value=4)


cte("errs", "SELECT series_id, model, grid_ts, pred - y AS err FROM preds WHERE pred IS NOT NULL", "preds")


def dm_ctes(prefix: str, src: str, need: str, keys: str) -> None:
    """Diebold-Mariano from a relation with (keys, ts, d)."""
    cte(f"{prefix}_rn", f"SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ts) AS rn, avg(d) OVER (PARTITION BY {keys}) AS m, count(*) OVER (PARTITION BY {keys}) AS n FROM ({src})", need)
    cte(f"{prefix}_h", f"SELECT {keys}, max(m) AS m, max(n) AS n, greatest(1, least(CAST(ceil(4 * pow(max(n) / 100.0, 2.0 / 9)) AS BIGINT), max(n) - 1)) AS h, avg((d - m) ** 2) AS g0 FROM {prefix}_rn GROUP BY {keys} HAVING max(n) >= 2", f"{prefix}_rn")
    join = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    jh = " AND ".join(f"a.{k.strip()} = x.{k.strip()}" for k in keys.split(","))
    ka = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    cte(f"{prefix}_g", f"SELECT {ka}, l AS lag, sum((a.d - a.m) * (b.d - b.m)) / (max(a.n) - l) AS g, max(x.h) AS h FROM {prefix}_rn a JOIN {prefix}_h x ON {jh} JOIN (SELECT unnest(generate_series(1, 60)) AS l) q ON l <= x.h JOIN {prefix}_rn b ON {join} AND b.rn = a.rn + l GROUP BY {ka}, l", f"{prefix}_rn {prefix}_h")
    cte(f"{prefix}", f"SELECT {ka}, n, CASE WHEN v > 0 THEN m / sqrt(v / n) ELSE 0 END AS dm FROM (SELECT a.*, CASE WHEN g0 + coalesce(s, 0) > 0 THEN g0 + coalesce(s, 0) ELSE g0 END AS v FROM {prefix}_h a LEFT JOIN (SELECT {keys}, sum(2 * (1 - lag / (h + 1.0)) * g) AS s FROM {prefix}_g GROUP BY {keys}) x ON {jh}) a", f"{prefix}_h {prefix}_g")


dm_ctes("dm", "SELECT a.series_id, a.model AS model_a, b.model AS model_b, a.grid_ts AS ts, a.err * a.err - b.err * b.err AS d FROM errs a JOIN errs b ON a.series_id = b.series_id AND a.grid_ts = b.grid_ts AND a.model < b.model", "errs", "series_id, model_a, model_b")


def _errs(spark, sf):
    p = predictions(spark, sf).filter("pred is not null")
    return p.select(*K, "model", "grid_ts", (F.col("pred") - F.col("y")).alias("err"))


@query("BM8_diebold_mariano", f"SELECT series_id, model_a, model_b, n, round(dm, 4) AS dm, round({_p('dm')}, 4) AS p_value FROM dm", "dm")
def _(spark, sf):
    return rnd(bm.dm_all_pairs(stored(_errs(spark, sf)), K, "grid_ts"), dm=4, p_value=4)


cte("mse", "SELECT series_id, model, avg(err * err) AS mse FROM errs GROUP BY 1, 2", "errs")
cte("best_mse", "SELECT series_id, model AS best FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(mse, 6), model) AS r FROM mse) WHERE r = 1", "mse")
dm_ctes("mcs", "SELECT e.series_id, e.model, e.grid_ts AS ts, l.err * l.err - e.err * e.err AS d FROM errs e JOIN best_mse b ON b.series_id = e.series_id JOIN errs l ON l.series_id = e.series_id AND l.grid_ts = e.grid_ts AND l.model = b.best WHERE e.model <> b.best", "errs best_mse", "series_id, model")


@query("BM9_model_confidence_set", f"SELECT m.series_id, m.model, round(mse, 2) AS mse, m.model = best OR coalesce({_p('dm')} > 0.1 / 4, true) AS in_set FROM mse m JOIN best_mse b ON b.series_id = m.series_id LEFT JOIN mcs x ON x.series_id = m.series_id AND x.model = m.model", "mse best_mse mcs")
def _(spark, sf):
    return rnd(bm.confidence_set(stored(_errs(spark, sf)), K, "grid_ts"), mse=2)


dm_ctes("pdm", "SELECT a.series_id, a.model AS model_a, b.model AS model_b, a.fold AS ts, abs(a.value) - abs(b.value) AS d FROM long_metrics a JOIN long_metrics b ON a.series_id = b.series_id AND a.fold = b.fold AND a.metric = 'mae' AND b.metric = 'mae' AND a.model < b.model", "long_metrics", "series_id, model_a, model_b")


@query("BM10_paired_table", f"SELECT series_id, model_a, model_b, n, round(dm, 3) AS dm, round({_p('dm')}, 3) AS p_value FROM pdm", "pdm")
def _(spark, sf):
    return rnd(bm.paired_table(cut_lineage(_long(spark, sf)), K, "mae"), dm=3, p_value=3)


@query("BM11_naive_skill", """WITH s AS (SELECT series_id, model, avg(value) AS mae FROM long_metrics WHERE metric = 'mae' GROUP BY 1, 2) SELECT s.series_id, s.model, round(s.mae, 4) AS mae, round(CASE WHEN n.mae > 0 THEN 1 - s.mae / n.mae END, 4) AS skill FROM s JOIN s n ON n.series_id = s.series_id AND n.model = 'seasonal_naive'""", "long_metrics")
def _(spark, sf):
    return rnd(bm.naive_skill(bm.fold_summary(_long(spark, sf), K), K), mae=4, skill=4)


@query("BM12_regime_check", """WITH f AS (SELECT f.series_id, fold, role, CASE WHEN s.y IS NULL THEN 1 ELSE 0 END AS cov_missing FROM folds f JOIN sparse6 s USING (series_id, grid_ts)), g AS (SELECT series_id, fold, role, bool_and(cov_missing = 1) AS a FROM f GROUP BY 1, 2, 3)
SELECT series_id, 'cov_missing' AS flag, count(*) FILTER (WHERE bad) AS bad_folds, count(*) AS folds FROM (SELECT series_id, fold, bool_and(a) AND count(DISTINCT role) = 2 AS bad FROM g GROUP BY 1, 2) GROUP BY 1""", "folds sparse6")
def _(spark, sf):
    s = i.sparse6(spark, sf).select(*K, "grid_ts", F.col("y").isNull().cast("int").alias("cov_missing"))
    return bm.regime_check(_folds(spark, sf).join(s, [*K, "grid_ts"]), K, ["cov_missing"])


# ---- horizon scoring -----------------------------------------------------------------------
H = 8
cte("hz_points", """SELECT experiment AS series_id, model_name AS model, issued_at AS origin, lead_minutes // 360 AS lead, target_dt, predicted AS point FROM forecast_log
UNION ALL SELECT l.experiment, 'baseline_mean', l.issued_at, l.lead_minutes // 360, l.target_dt, m.m FROM forecast_log l JOIN (SELECT series_id, avg(y) AS m FROM load6 GROUP BY 1) m ON m.series_id = l.experiment WHERE l.model_name = 'last_value'""", "forecast_log load6")
cte("hz_all", "SELECT p.*, a.y AS actual, CASE WHEN a.y IS NOT NULL THEN a.y - point END AS e FROM hz_points p LEFT JOIN load6 a ON a.series_id = p.series_id AND a.grid_ts = p.target_dt", "hz_points load6")
LV = "[" + ", ".join(str(q) for q in mt.QUANTILE_LEVELS) + "]"
PAST = "ORDER BY origin RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL '48 hours' PRECEDING"


def _past_sql(key: str) -> str:
    return f"""SELECT *, CASE WHEN np >= 30 THEN list_transform(CASE WHEN no >= 30 THEN qo ELSE qp END, lambda x: greatest(point + x, 0)) END AS q FROM (SELECT *, count(e) OVER o AS no, count(e) OVER p AS np, quantile_cont(e, {LV}) OVER o AS qo, quantile_cont(e, {LV}) OVER p AS qp
FROM hz_all WINDOW o AS (PARTITION BY series_id, model, {key} {PAST}), p AS (PARTITION BY series_id, model {PAST}))"""


cte("hz_q", _past_sql("(lead - 1) // 2"), "hz_all")
cte("hz_slot", _past_sql("hour(target_dt) // 3 + CASE WHEN isodow(target_dt) >= 6 THEN 100 ELSE 0 END"), "hz_all")
cte("hz_cells", f"""SELECT c.*, 2 * list_sum(list_transform(generate_series(1, 19), lambda k: greatest(k * 0.05 * (actual - q[k]), (k * 0.05 - 1) * (actual - q[k])))) / 19 AS crps FROM hz_q c JOIN (SELECT series_id, origin, lead FROM hz_q WHERE q IS NOT NULL AND actual IS NOT NULL GROUP BY 1, 2, 3 HAVING count(DISTINCT model) = 3) f
ON f.series_id = c.series_id AND f.origin = c.origin AND f.lead = c.lead""", "hz_q")


def hz_forecasts(spark, sf):
    log = i.forecast_log(spark, sf).select(F.col("experiment").alias("series_id"), F.col("model_name").alias("model"), F.col("issued_at").alias("origin"), (F.col("lead_minutes") / 360).cast("long").alias("lead"), "target_dt", F.col("predicted").alias("point"))
    mean = i.load6(spark, sf).groupBy(*K).agg(F.avg("y").alias("__mean"))
    d = log.join(mean.hint("merge"), K).withColumn("__x", F.explode(F.array(F.lit(False), F.lit(True)))).filter("NOT __x OR model = 'last_value'")
    return d.withColumns({"model": F.when(F.col("__x"), "baseline_mean").otherwise(F.col("model")), "point": F.when(F.col("__x"), F.col("__mean")).otherwise(F.col("point"))}).drop("__x", "__mean")


def hz_points(spark, sf):
    return hz.attach_actuals(hz_forecasts(spark, sf), i.load6(spark, sf), K)


def hz_quantiles(spark, sf, condition="lead"):
    return hz.residual_quantiles(hz_points(spark, sf), K, H, i.SIX, condition, 2, nonnegative=True, sized=hz_forecasts(spark, sf))


def hz_cells(spark, sf):
    return hz.scorable(hz_quantiles(spark, sf), K)


@query("HZ1_evaluate_origins", "SELECT series_id, model, origin, lead, point, actual, round(crps, 4) AS crps FROM hz_cells", "hz_cells")
def _(spark, sf):
    return rnd(hz_cells(spark, sf).select(*K, "model", "origin", "lead", "point", "actual", "crps"), crps=4)


@query("HZ1_scores", """SELECT series_id, model, count(DISTINCT origin) AS n_origins, count(*) AS n_points, round(avg(abs(point - actual)), 4) AS mae, round(sqrt(avg((point - actual) ** 2)), 4) AS rmse, round(avg(crps) + 1e-7, 4) AS crps, round(avg(CASE WHEN actual >= q[2] AND actual <= q[18] THEN 1.0 ELSE 0 END), 4) AS coverage,
round(avg(q[18] - q[2]) + 1e-7, 3) AS width, round(CASE WHEN sum(actual) > 0 THEN 100 * (sum(point) / sum(actual) - 1) END, 4) AS bias_pct, round(CASE WHEN stddev_pop(actual) > 0 THEN stddev_pop(point) / stddev_pop(actual) END, 4) AS amplitude_ratio FROM hz_cells GROUP BY 1, 2""", "hz_cells")
def _(spark, sf):
    d = nudge(hz.scores(hz_cells(spark, sf), K), "crps", "width")
    return rnd(d, mae=4, rmse=4, crps=4, coverage=4, width=3, bias_pct=4, amplitude_ratio=4)


ALL_LEVELS = "SELECT series_id, model, origin, lead, " + ", ".join(f"round(q[{n}], 3) AS q{5 * n:02d}" for n in range(1, 20)) + " FROM "


def _all_levels(d):
    return d.select(*K, "model", "origin", "lead", *[rounded(F.get("q", F.lit(n - 1)), 3).alias(f"q{5 * n:02d}") for n in range(1, 20)])


@query("HZ2_residual_quantiles", ALL_LEVELS + "hz_q", "hz_q")
def _(spark, sf):
    return _all_levels(hz_quantiles(spark, sf))


@query("HZ2_slot_quantiles", ALL_LEVELS + "hz_slot", "hz_slot")
def _(spark, sf):
    return _all_levels(hz_quantiles(spark, sf, "slot"))


cte("hz_level", f"""WITH w AS (SELECT *, list_sort(list_distinct(quantile_cont(CASE WHEN e IS NOT NULL THEN point END, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) OVER p)) AS edges, count(e) OVER p AS np, quantile_cont(e, {LV}) OVER p AS qp FROM hz_all WINDOW p AS (PARTITION BY series_id, model {PAST})),
b AS (SELECT *, len(list_filter(edges, lambda x: x <= point)) AS b FROM w),
o AS (SELECT d.series_id, d.model, d.origin, d.b, quantile_cont(h.e, {LV}) AS qo, count(*) AS no FROM (SELECT DISTINCT series_id, model, origin, b, edges FROM b WHERE np >= 30) d JOIN hz_all h ON h.series_id = d.series_id AND h.model = d.model AND h.e IS NOT NULL AND h.origin <= d.origin - INTERVAL '48 hours' AND len(list_filter(d.edges, lambda x: x <= h.point)) = d.b GROUP BY 1, 2, 3, 4)
SELECT b.series_id, b.model, b.origin, lead, CASE WHEN np >= 30 THEN list_transform(CASE WHEN no >= 30 THEN qo ELSE qp END, lambda x: greatest(point + x, 0)) END AS q FROM b LEFT JOIN o ON o.series_id = b.series_id AND o.model = b.model AND o.origin = b.origin AND o.b = b.b""", "hz_all")


@query("HZ2_level_quantiles", ALL_LEVELS + "hz_level", "hz_level")
def _(spark, sf):
    return _all_levels(hz_quantiles(spark, sf, "level"))


@query("HZ3_by_lead", "SELECT series_id, model, (lead - 1) // 2 * 2 + 1 AS lead_start, round(avg(abs(point - actual)), 4) AS mae, round(sqrt(avg((point - actual) ** 2)), 4) AS rmse, round(avg(crps) + 1e-7, 4) AS crps FROM hz_cells GROUP BY 1, 2, 3", "hz_cells")
def _(spark, sf):
    return rnd(nudge(hz.by_lead(hz_cells(spark, sf), K, 2), "crps"), mae=4, rmse=4, crps=4)


@query("HZ4_evidence", "SELECT series_id, (epoch(max(origin)) - epoch(min(origin)) + 172800) / 86400 AS evaluation_days, (epoch(max(origin)) - epoch(min(origin)) + 172800) / 86400 >= 14 AS enough FROM hz_cells GROUP BY 1", "hz_cells")
def _(spark, sf):
    return hz.evidence(hz_cells(spark, sf), K, H, i.SIX)


cte("hz_day", "SELECT series_id, model, origin, min(target_dt) AS f, max(target_dt) AS l FROM hz_points GROUP BY 1, 2, 3 HAVING CAST(max(target_dt) AS DATE) > CAST(min(target_dt) AS DATE)", "hz_points")
cte("hz_need", "SELECT p.series_id, p.model, p.origin, d.f, count(*) AS need FROM hz_points p JOIN hz_day d USING (series_id, model, origin) WHERE CAST(target_dt AS DATE) = CAST(f AS DATE) GROUP BY 1, 2, 3, 4", "hz_points hz_day")
cte("hz_totals", """SELECT series_id, model, CAST(hour(f) AS DOUBLE) AS issue_hour, count(*) AS n, sqrt(avg(e * e)) AS rmse, avg(e) AS bias FROM (SELECT c.series_id, c.model, c.origin, d.f, sum(point) - sum(actual) AS e FROM hz_cells c JOIN hz_need d USING (series_id, model, origin)
WHERE CAST(target_dt AS DATE) = CAST(f AS DATE) GROUP BY 1, 2, 3, 4, d.need HAVING count(*) = d.need) GROUP BY 1, 2, 3""", "hz_cells hz_need")
cte("hz_elig", """SELECT s.*, t.total, r.total * 1.25 AS lim, coalesce(t.total <= r.total * 1.25, true) AS eligible FROM (SELECT series_id, model, avg(crps) AS crps FROM hz_cells GROUP BY 1, 2) s LEFT JOIN (SELECT series_id, model, sqrt(sum(rmse * rmse * n) / sum(n)) AS total FROM hz_totals GROUP BY 1, 2) t USING (series_id, model)
LEFT JOIN (SELECT series_id, sqrt(sum(rmse * rmse * n) / sum(n)) AS total FROM hz_totals WHERE model = 'baseline_mean' GROUP BY 1) r USING (series_id)""", "hz_cells hz_totals")


def _eligible(spark, sf):
    cells = stored(hz_cells(spark, sf).drop("q"))
    return hz.eligibility(hz.scores(cells, K), hz.period_totals(cells, hz_forecasts(spark, sf), K), K)


@query("MT16_period_total_rmse", "SELECT series_id, model, issue_hour, n, round(rmse, 4) AS rmse, round(bias, 4) AS bias FROM hz_totals", "hz_totals")
def _(spark, sf):
    return rnd(hz.period_totals(hz_cells(spark, sf), hz_forecasts(spark, sf), K), rmse=4, bias=4)


CAND = ["seasonal_naive", "last_value"]


@query("HZ5_select_by_crps", "SELECT series_id, model, round(crps, 4) AS crps, eligible FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY NOT eligible, round(crps, 9), model) AS r FROM hz_elig WHERE model <> 'baseline_mean') WHERE r = 1", "hz_elig")
def _(spark, sf):
    return rnd(hz.select_by_crps(_eligible(spark, sf), K, CAND), crps=4)


@query("HZ6_paired_difference")
def _(spark, sf):
    d = hz.paired_difference(stored(hz.origin_losses(hz_cells(spark, sf), K)), K, "last_value", "seasonal_naive")
    return rnd(d, mean=4, lo=4, hi=4)


@query("HZ7_objective", "SELECT series_id, model, round(crps * CASE WHEN NOT eligible AND lim > 0 THEN total / lim ELSE 1 END + 1e-7, 3) AS objective FROM hz_elig", "hz_elig")
def _(spark, sf):
    return hz.objective(_eligible(spark, sf)).select(*K, "model", F.round(F.col("objective") + 1e-7, 3).alias("objective"))


@query("HZ8_published_ranking", "SELECT series_id, model, row_number() OVER (PARTITION BY series_id ORDER BY NOT eligible, round(crps, 9), model) AS rank FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS k FROM hz_elig WHERE model <> 'baseline_mean') WHERE k = 2", "hz_elig")
def _(spark, sf):
    return hz.published_ranking(_eligible(spark, sf), K, CAND).select(*K, "model", "rank")


# ---- top-k ---------------------------------------------------------------------------------
@query("TK1_newest_issuances", "SELECT experiment, issued_at FROM (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY issued_at DESC) AS r FROM (SELECT DISTINCT experiment, issued_at FROM forecast_log)) WHERE r <= 12", "forecast_log")
def _(spark, sf):
    return ag.newest(i.forecast_log(spark, sf).select("experiment", "issued_at").distinct(), ["experiment"], "issued_at", 12)


@query("TK2_newest_runs", "SELECT series_id, fold FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY fold DESC) AS r FROM walk) WHERE r <= 3", "walk")
def _(spark, sf):
    d = i.load6(spark, sf).groupBy(*K).agg(F.count(F.lit(1)).alias("n_rows"))
    return ag.newest(cv.fold_table(d, K), K, "fold", 3).select(*K, "fold")


@query("TK3_first_last", "SELECT series_id, arg_min(value, ts) AS first_value, arg_max(value, ts) AS last_value FROM fleet GROUP BY 1", "fleet")
def _(spark, sf):
    return i.obs_fleet(spark, sf).groupBy(*K).agg(F.min_by("value", "ts").alias("first_value"), F.max_by("value", "ts").alias("last_value"))


@query("TK4_origin_thinning", """WITH s AS (SELECT series_id, grid_ts, (rn - 1) // 2 AS k, count(*) OVER (PARTITION BY series_id) AS n FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY grid_ts) AS rn FROM load6) WHERE (rn - 1) % 2 = 0)
SELECT series_id, grid_ts FROM s WHERE n <= 24 OR k IN (SELECT CAST(round_even(j * (s.n - 1) / 23.0, 0) AS BIGINT) FROM (SELECT unnest(generate_series(0, 23)) AS j))""", "load6")
def _(spark, sf):
    return cv.thin_origins(i.load6(spark, sf), K, "grid_ts", stride=2).select(*K, "grid_ts")


@query("TK5_leaderboard_order", "SELECT series_id, model, row_number() OVER (PARTITION BY series_id ORDER BY round(v, 6) ASC NULLS LAST, model) AS position FROM (SELECT series_id, model, avg(CASE WHEN y <> 0 THEN abs((y - pred) / y) END) AS v FROM preds GROUP BY 1, 2)", "preds")
def _(spark, sf):
    from pyspark.sql import Window

    d = predictions(spark, sf).groupBy(*K, "model").agg((mt.mape() / 100).alias("v"))
    w = Window.partitionBy(*K).orderBy(F.round("v", 6).asc_nulls_last(), "model")
    return d.select(*K, "model", F.row_number().over(w).cast("long").alias("position"))


@query("TK6_longest_gaps", "SELECT series_id, n FROM (SELECT series_id, n, row_number() OVER (PARTITION BY series_id ORDER BY n DESC, gap_start) AS r FROM (SELECT series_id, min(grid_ts) AS gap_start, count(*) AS n FROM (SELECT series_id, grid_ts, y, count(y) OVER (PARTITION BY series_id ORDER BY grid_ts ROWS UNBOUNDED PRECEDING) AS g FROM sparse6) WHERE y IS NULL GROUP BY series_id, g)) WHERE r <= 3", "sparse6")
def _(spark, sf):
    from tidegrid.operators.grid import gap_spans

    return gap_spans(i.sparse6(spark, sf), K, i.SIX).select(*K, "n")
