"""Registered queries of the classification (wine) and regression (fire) studies."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import folds as CV
from ..operators import knn as K
from ..operators import metrics as M
from ..operators import models as ML
from ..operators import profile as P
from ..operators.bagging import BagGrid, bagged_cv_grid, bagged_predictions
from ..operators.linear import least_squares
from ..operators.sampling import contiguous_folds, kfold, split_random
from ..session import cache, folder_state, materialize
from ..sources.fixtures import SEED, fixture
from .deliveries import deliveries
from .delivery_models import COEFFICIENTS_SQL, coefficient_rows
from .delivery_queries import dsql
from .linear_sql import lm_ctes, recursive
from .model_sql import FF, WF, fsql, wsql
from .modeling import (FIRE_FEATURES, REGION_CODES, WINE_FEATURES, apply_minmax, apply_standard, fire_sets,
                       minmax_params, standard_params, wine_binary, wine_sets)
from .registry import register

K_WINE, K_FIRE = 11, 15


def _r(c, n=6):
    return F.round(c, n).alias(c)


@register("binarize_target", wsql("SELECT row_id, quality FROM z0"))
def q_binarize(spark, sf_dir):
    return wine_binary(spark, sf_dir).select("row_id", "quality")


@register("class_counts", wsql("SELECT quality, CAST(COUNT(*) AS BIGINT) AS n FROM wine GROUP BY quality"))
def q_class_counts(spark, sf_dir):
    return P.value_counts(fixture(spark, sf_dir, "wine"), ["quality"], "n")


STATS = [("count", "CAST(COUNT({c}) AS DOUBLE)"), ("mean", "AVG({c})"), ("std", "STDDEV_SAMP({c})"),
         ("min", "CAST(MIN({c}) AS DOUBLE)"), ("25%", "quantile_cont({c}, 0.25)"), ("50%", "quantile_cont({c}, 0.5)"),
         ("75%", "quantile_cont({c}, 0.75)"), ("max", "CAST(MAX({c}) AS DOUBLE)")]


@register("describe", wsql(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{s}' AS stat, round({e.format(c=c)}, 6) AS value FROM z0"
    for c in WF for s, e in STATS)))
def q_describe(spark, sf_dir):
    return P.describe(wine_binary(spark, sf_dir), WINE_FEATURES)


@register("zscore_filter", wsql("SELECT row_id FROM wclean"))
def q_zscore(spark, sf_dir):
    return wine_sets(spark, sf_dir).clean.select("row_id")


@register("split_stratified", wsql("""
SELECT row_id, quality, CASE WHEN rk <= ceil(gn * CAST(0.2 AS DOUBLE)) THEN 'test' ELSE 'train' END AS split FROM ws"""))
def q_split_stratified(spark, sf_dir):
    from ..operators.sampling import split_stratified
    return split_stratified(wine_sets(spark, sf_dir).clean, ["row_id"], "quality", 0.2, SEED) \
        .select("row_id", "quality", "split")


@register("oversample", wsql("SELECT row_id, quality, copy_index FROM wtrain"))
def q_oversample(spark, sf_dir):
    return wine_sets(spark, sf_dir).train.select("row_id", "quality", F.col("copy_index").cast("int"))


@register("kfold_stratified", wsql("""
SELECT row_id, quality, CAST((row_number() OVER (PARTITION BY quality ORDER BY md5(concat_ws('|', '42', row_id)), row_id) - 1) % 5
       AS BIGINT) AS fold FROM wtrain_raw"""))
def q_kfold_stratified(spark, sf_dir):
    return kfold(wine_sets(spark, sf_dir).train_raw, ["row_id"], 5, SEED, strata=["quality"]) \
        .select("row_id", "quality", "fold")


@register("scale_minmax", wsql("SELECT row_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in WF) + " FROM smm"))
def q_scale_minmax(spark, sf_dir):
    s = wine_sets(spark, sf_dir)
    t = apply_minmax(s.test, minmax_params(s.train, WINE_FEATURES))
    return t.select("row_id", *[_r(c) for c in WINE_FEATURES])


@register("scale_standard", wsql("SELECT row_id, " + ", ".join(
    f"round(({c} - mu_{c}) / (CASE WHEN sd_{c} <> 0 THEN sd_{c} ELSE 1.0 END), 6) AS {c}" for c in WF)
    + " FROM wtest, sdp"))
def q_scale_standard(spark, sf_dir):
    s = wine_sets(spark, sf_dir)
    t = apply_standard(s.test, standard_params(s.train, WINE_FEATURES))
    return t.select("row_id", *[_r(c) for c in WINE_FEATURES])


_KNN: dict = cache()


def wine_knn_predictions(spark, sf_dir):
    """Test-set votes of the neighbours on z-scores, written once per application for the metrics."""
    key = ("wine", spark.sparkContext.applicationId, sf_dir, folder_state(spark, sf_dir))
    if key not in _KNN:
        s = wine_sets(spark, sf_dir)
        train, test = _wine_standard(spark, sf_dir)
        pred = K.knn_classify(test, train, WINE_FEATURES, K_WINE, "row_id", ["row_id", "copy_index"], "quality")
        _KNN[key] = materialize(s.test.select("row_id", "quality").join(pred, "row_id"), "knn-wine")
    return _KNN[key]


def _wine_standard(spark, sf_dir):
    """(train, test) as z-scores: the scaling of the neighbours and the trees."""
    s = wine_sets(spark, sf_dir)
    params = standard_params(s.train, WINE_FEATURES)
    return apply_standard(s.train, params), apply_standard(s.test, params)


def _wine_minmax(spark, sf_dir):
    """(train, test) between 0 and 1: the scaling of the logistic regression and the perceptron."""
    s = wine_sets(spark, sf_dir)
    params = minmax_params(s.train, WINE_FEATURES)
    return apply_minmax(s.train, params), apply_minmax(s.test, params)


@register("knn_classification", wsql("SELECT row_id, round(probability, 6) AS probability, prediction FROM wpred"))
def q_knn_classification(spark, sf_dir):
    return wine_knn_predictions(spark, sf_dir).select("row_id", _r("probability"), "prediction")


@register("metric_accuracy", wsql("SELECT round(AVG(CAST(quality = prediction AS DOUBLE)), 6) AS accuracy FROM wpred"))
def q_accuracy(spark, sf_dir):
    return M.accuracy(wine_knn_predictions(spark, sf_dir), "quality", "prediction").select(_r("accuracy"))


@register("confusion_matrix", wsql("""
SELECT quality AS actual, CAST(SUM(CASE WHEN prediction = 0 THEN 1 ELSE 0 END) AS BIGINT) AS pred_0,
       CAST(SUM(CASE WHEN prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pred_1 FROM wpred GROUP BY quality"""))
def q_confusion(spark, sf_dir):
    return M.confusion_matrix(wine_knn_predictions(spark, sf_dir), "quality", "prediction")


_CLS = """
SELECT class, precision, recall, f1, support FROM (
  SELECT class, p AS precision, r AS recall, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1, support FROM (
    SELECT CAST(c AS VARCHAR) AS class,
           CASE WHEN pp > 0 THEN tp / pp ELSE 0.0 END AS p, CASE WHEN ap > 0 THEN tp / ap ELSE 0.0 END AS r, CAST(ap AS DOUBLE) AS support
    FROM (SELECT c, SUM(CASE WHEN quality = c AND prediction = c THEN 1.0 ELSE 0.0 END) AS tp,
                 SUM(CASE WHEN prediction = c THEN 1.0 ELSE 0.0 END) AS pp, SUM(CASE WHEN quality = c THEN 1.0 ELSE 0.0 END) AS ap
          FROM wpred, (SELECT 0 AS c UNION ALL SELECT 1) cs GROUP BY c) a) b) per"""


@register("classification_report", wsql("""
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM per
UNION ALL SELECT 'macro avg', round(AVG(precision), 6), round(AVG(recall), 6), round(AVG(f1), 6), SUM(support) FROM per
UNION ALL SELECT 'weighted avg', round(SUM(precision * support) / SUM(support), 6), round(SUM(recall * support) / SUM(support), 6),
                 round(SUM(f1 * support) / SUM(support), 6), SUM(support) FROM per""", [("per", _CLS)]))
def q_classification_report(spark, sf_dir):
    rep = M.classification_report(wine_knn_predictions(spark, sf_dir), "quality", "prediction")
    return rep.select("class", *[_r(c) for c in ("precision", "recall", "f1")], "support")


@register("roc_curve", wsql("""
SELECT threshold, round(cfp / nn, 6) AS fpr, round(ctp / pp, 6) AS tpr FROM (
  SELECT threshold, SUM(tp) OVER w AS ctp, SUM(fp) OVER w AS cfp, SUM(tp) OVER () AS pp, SUM(fp) OVER () AS nn
  FROM (SELECT probability AS threshold, SUM(CAST(quality AS DOUBLE)) AS tp, SUM(CAST(1 - quality AS DOUBLE)) AS fp
        FROM wpred GROUP BY probability) g
  WINDOW w AS (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) c"""))
def q_roc_curve(spark, sf_dir):
    roc = M.roc_curve(wine_knn_predictions(spark, sf_dir), "quality", "probability")
    return roc.select("threshold", _r("fpr"), _r("tpr"))


@register("roc_auc", wsql("""
SELECT round((SUM(pos * avg_rank) - SUM(pos) * (SUM(pos) + 1) / 2.0) / (SUM(pos) * (SUM(cnt) - SUM(pos))), 6) AS auc
FROM (SELECT pos, cnt, COALESCE(SUM(cnt) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
             + (cnt + 1) / 2.0 AS avg_rank
      FROM (SELECT probability AS s, SUM(CAST(quality AS DOUBLE)) AS pos, COUNT(*) AS cnt FROM wpred GROUP BY probability) g) r"""))
def q_roc_auc(spark, sf_dir):
    return M.roc_auc(wine_knn_predictions(spark, sf_dir), "quality", "probability").select(_r("auc"))


@register("log_loss", wsql("""
SELECT round(AVG(-(quality * ln(least(greatest(probability, 1e-7), 1 - 1e-7))
                   + (1 - quality) * ln(1 - least(greatest(probability, 1e-7), 1 - 1e-7)))), 6) AS log_loss FROM wpred"""))
def q_log_loss(spark, sf_dir):
    return M.log_loss(wine_knn_predictions(spark, sf_dir), "quality", "probability").select(_r("log_loss"))


# ---- fire (regression) -------------------------------------------------------------------

@register("split_random", fsql("""
SELECT row_id, CASE WHEN rk <= ceil(n * CAST(0.2 AS DOUBLE)) THEN 'test' ELSE 'train' END AS split FROM fr"""))
def q_split_random(spark, sf_dir):
    return split_random(fixture(spark, sf_dir, "fires"), ["row_id"], 0.2, SEED).select("row_id", "split")


@register("kfold", fsql("""
SELECT row_id, CAST((row_number() OVER (ORDER BY md5(concat_ws('|', '42', row_id)), row_id) - 1) % 5 AS BIGINT) AS fold
FROM ftrain"""))
def q_kfold(spark, sf_dir):
    return kfold(fire_sets(spark, sf_dir).train, ["row_id"], 5, SEED).select("row_id", "fold")


def fire_knn_predictions(spark, sf_dir, k=K_FIRE, with_seconds: bool = False):
    """Test-set kNN predictions, written once per application (the search is the
    expensive part; the leaderboard and the metrics reuse it) with its search time."""
    import time
    key = (spark.sparkContext.applicationId, sf_dir, folder_state(spark, sf_dir), k)
    if key not in _KNN:
        s = fire_sets(spark, sf_dir)
        t0 = time.time()
        pred = K.knn_regress(s.test, s.train, FIRE_FEATURES, k, "row_id", ["row_id"], "fire_area")
        out = materialize(s.test.select("row_id", "fire_area").join(pred, "row_id"), "knn-pred")
        _KNN[key] = (out, time.time() - t0)
    return _KNN[key] if with_seconds else _KNN[key][0]


def fire_knn_train_predictions(spark, sf_dir, k=K_FIRE):
    """Predictions of the training rows from all training rows, written once per application."""
    key = ("train", spark.sparkContext.applicationId, sf_dir, folder_state(spark, sf_dir), k)
    if key not in _KNN:
        train = fire_sets(spark, sf_dir).train
        rows = train.withColumn("_id", F.struct("row_id", "fire_area"))
        pred = K.knn_regress(rows, train, FIRE_FEATURES, k, "_id", ["row_id"], "fire_area")
        _KNN[key] = materialize(pred.select("_id.*", "prediction"), "knn-train")
    return _KNN[key]


@register("kfold_contiguous", fsql("""
SELECT row_id, CAST(CASE WHEN r < n % 5 * (n // 5 + 1) THEN r // (n // 5 + 1) ELSE (r - n % 5 * (n // 5 + 1)) // (n // 5) + n % 5 END AS BIGINT) AS fold
FROM (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS r, COUNT(*) OVER () AS n FROM ftrain)"""))
def q_kfold_contiguous(spark, sf_dir):
    """Five folds of consecutive rows, as an unshuffled grid search cuts them."""
    return contiguous_folds(fire_sets(spark, sf_dir).train.select("row_id"), ["row_id"], 5).select("row_id", "fold")


@register("kfold_ten", fsql("""
SELECT fold, CAST(COUNT(*) AS BIGINT) AS n, CAST(MIN(row_id) AS BIGINT) AS first_row, CAST(MAX(row_id) AS BIGINT) AS last_row FROM (
  SELECT row_id, CAST((row_number() OVER (ORDER BY md5(concat_ws('|', '42', row_id)), row_id) - 1) % 10 AS BIGINT) AS fold FROM ftrain)
GROUP BY fold"""))
def q_kfold_ten(spark, sf_dir):
    """Sizes and ends of ten shuffled folds."""
    return kfold(fire_sets(spark, sf_dir).train, ["row_id"], 10, SEED).groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"))


@register("knn_regression", fsql("SELECT row_id, round(prediction, 4) AS prediction FROM fpred"))
def q_knn_regression(spark, sf_dir):
    return fire_knn_predictions(spark, sf_dir).select("row_id", _r("prediction", 4))


# Mean label of the 15 nearest training rows of every training row (itself among them), and the fitted line.
_FIRE_DISTANCE = " + ".join(f"(q.{c} - r.{c}) * (q.{c} - r.{c})" for c in FF)
FIRE_METRIC_CTES = [
    ("fnear_train", f"""
SELECT q.row_id, q.fire_area, list_avg(min_by(r.fire_area, ROW({_FIRE_DISTANCE}, r.row_id), {K_FIRE})) AS prediction
FROM ftrain q, ftrain r GROUP BY q.row_id, q.fire_area"""),
    *lm_ctes("ftrain", {c: c for c in FIRE_FEATURES}, "fire_area"),
    ("fall", "SELECT *, 'test' AS split FROM ftest UNION ALL SELECT *, 'train' FROM ftrain"),
    ("fscored", f"""
SELECT 'knn' AS model, 'test' AS split, fire_area, prediction FROM fpred
UNION ALL SELECT 'knn', 'train', fire_area, prediction FROM fnear_train
UNION ALL SELECT 'linear_regression', split, fire_area,
  m[1][{len(FF) + 2}] + {" + ".join(f"m[{i}][{len(FF) + 2}] * {c}" for i, c in enumerate(FF, 2))} FROM fall, lmb"""),
]


@register("metric_regression", recursive(fsql("""
SELECT model, split, round(AVG(abs(fire_area - prediction)), 4) AS mae, round(AVG((fire_area - prediction) * (fire_area - prediction)), 4) AS mse,
       round(sqrt(AVG((fire_area - prediction) * (fire_area - prediction))), 4) AS rmse, CAST(COUNT(*) AS BIGINT) AS n
FROM fscored GROUP BY model, split""", FIRE_METRIC_CTES)))
def q_metric_regression(spark, sf_dir):
    """Errors on the training and the test rows of the two models that SQL can state: the neighbours and the linear regression."""
    s = fire_sets(spark, sf_dir)
    line = least_squares(s.train, FIRE_FEATURES, "fire_area").prediction()
    parts = []
    for split, rows, near in (("test", s.test, fire_knn_predictions(spark, sf_dir)), ("train", s.train, fire_knn_train_predictions(spark, sf_dir))):
        for model, pred in (("knn", near), ("linear_regression", rows.withColumn("prediction", line))):
            parts.append(pred.select(F.lit(model).alias("model"), F.lit(split).alias("split"), "fire_area", "prediction"))
    m = M.regression_metrics(reduce(DataFrame.unionByName, parts), "fire_area", "prediction", by=("model", "split"))
    return m.select("model", "split", _r("mae", 4), _r("mse", 4), _r("rmse", 4), F.col("n").cast("bigint"))


@register("metric_rmse", fsql("""
SELECT round(sqrt(AVG((fire_area - prediction) * (fire_area - prediction))), 4) AS rmse,
       CAST(SUM(CASE WHEN prediction IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_predictions FROM fpred"""))
def q_metric_rmse(spark, sf_dir):
    return M.rmse(fire_knn_predictions(spark, sf_dir), "fire_area", "prediction") \
        .select(_r("rmse", 4), F.col("null_predictions").cast("bigint"))


@register("decode_lookup", fsql("""
SELECT row_id, CAST(row_id % 7 AS INTEGER) AS region,
       CASE row_id % 7 WHEN 0 THEN 'NSW' WHEN 1 THEN 'NT' WHEN 2 THEN 'QL' WHEN 3 THEN 'SA' WHEN 4 THEN 'TA'
                       WHEN 5 THEN 'VI' ELSE 'WA' END AS region_name FROM fires"""))
def q_decode_lookup(spark, sf_dir):
    """Coded region -> name through a small broadcast dictionary (7 fixed rows)."""
    from ..operators.cleaning import decode_lookup
    codes = spark.createDataFrame(REGION_CODES, "code int, region_name string")
    f = fixture(spark, sf_dir, "fires").select("row_id", (F.col("row_id") % 7).cast("int").alias("region"))
    return decode_lookup(f, "region", codes, "code", "region_name")


# The order priorities and statuses of the stand-in, in alphabetical order.
ORDER_TYPES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
VEHICLE_TYPES = ["F", "O", "P"]


@register("dummy_encode", dsql(
    "SELECT row_id, " + ", ".join(
        [f"CAST(order_type = '{v}' AS INTEGER) AS \"order_type_{v}\"" for v in ORDER_TYPES[1:]]
        + [f"CAST(vehicle_type = '{v}' AS INTEGER) AS \"vehicle_type_{v}\"" for v in VEHICLE_TYPES[1:]])
    + " FROM clean"))
def q_dummy_encode(spark, sf_dir):
    """Treatment coding of two categorical predictors (first level alphabetically dropped)."""
    d = deliveries(spark, sf_dir).select("row_id", "order_type", "vehicle_type")
    out = ML.dummy_encode(d, ["order_type", "vehicle_type"])
    return out.drop("order_type", "vehicle_type")




# ---- MLlib models (no SQL equivalent: checked by properties in tests) ---------------------

def _fire_data(spark, sf_dir):
    return fire_sets(spark, sf_dir)


def _regression_row(name, pred, label="fire_area"):
    m = M.regression_metrics(pred, label, "prediction")
    return m.select(F.lit(name).alias("model"), _r("mae", 6), _r("mse", 6), _r("rmse", 6), F.col("n").cast("bigint"))


@register("linreg", recursive(fsql(
    "SELECT term, round(estimate, 9) AS estimate FROM lm", lm_ctes("ftrain", {c: c for c in FIRE_FEATURES}, "fire_area_exact"))))
def q_linreg(spark, sf_dir):
    """OLS on the noise-free fire target: recovers 0.003, 0.02, -0.01, 1.5 and intercept 2."""
    s = _fire_data(spark, sf_dir)
    model = ML.linear_regression(s.train, FIRE_FEATURES, "fire_area_exact")
    return ML.coefficients_table(model, FIRE_FEATURES, spark).select("term", F.round("estimate", 9).alias("estimate"))


@register("linreg_noisy", recursive(fsql(COEFFICIENTS_SQL, lm_ctes("ftrain", {c: c for c in FIRE_FEATURES}, "fire_area"))))
def q_linreg_noisy(spark, sf_dir):
    """OLS on the noisy fire target, with standard errors, t and p."""
    return coefficient_rows(spark, least_squares(_fire_data(spark, sf_dir).train, FIRE_FEATURES, "fire_area"))


def _rf(spark, sf_dir):
    s = _fire_data(spark, sf_dir)
    return ML.random_forest(s.train, FIRE_FEATURES, "fire_area", num_trees=20, max_depth=8), s


@register("rf_regression")
def q_rf(spark, sf_dir):
    model, s = _rf(spark, sf_dir)
    return _regression_row("random_forest", ML.predict(model, s.test, FIRE_FEATURES, ["fire_area"]))


@register("feature_importance")
def q_feature_importance(spark, sf_dir):
    model, _ = _rf(spark, sf_dir)
    return ML.feature_importance(model, FIRE_FEATURES, spark)


@register("gbt_regression")
def q_gbt(spark, sf_dir):
    s = _fire_data(spark, sf_dir)
    model = ML.gradient_boosting(s.train, FIRE_FEATURES, "fire_area", max_iter=30, step=0.1, max_depth=3)
    return _regression_row("gradient_boosting", ML.predict(model, s.test, FIRE_FEATURES, ["fire_area"]))


# The study's grid: 5 x 3 x 3 x 7 = 315 points.
BAG_GRID = BagGrid(tuple(FIRE_FEATURES), (10, 20, 50, 100, 200), (0.5, 0.7, 1.0), (0.5, 0.7, 1.0), (3, 5, 7, 9, 15, 18, 21), SEED)
_BAGS: dict = cache()
TABLE_BAG = BagGrid(tuple(FIRE_FEATURES), (50,), (1.0,), (1.0,), (9,), SEED)


def bagged_knn_grid(spark, sf_dir):
    """The grid's 315 scores, written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, folder_state(spark, sf_dir))
    if key not in _BAGS:
        train = materialize(kfold(_fire_data(spark, sf_dir).train, ["row_id"], 5, SEED), "fire-folds")
        _BAGS[key] = materialize(bagged_cv_grid(train, BAG_GRID, "row_id", "fire_area", "fold"), "bag-grid")
    return _BAGS[key]


@register("bagged_knn_grid")
def q_bagged_knn_grid(spark, sf_dir):
    """Bagged neighbours: mean R^2 over five folds of every point of the study's grid."""
    return bagged_knn_grid(spark, sf_dir).select("n_estimators", "max_samples", "max_features", "n_neighbors", _r("r2"))


def bagged_knn_predictions(spark, sf_dir):
    """Test-set predictions of the best grid point (the first of equals), trained on all training rows."""
    s = _fire_data(spark, sf_dir)
    p = bagged_knn_grid(spark, sf_dir).orderBy(F.desc("r2"), "n_estimators", "max_samples", "max_features", "n_neighbors").first()
    best = BagGrid(BAG_GRID.features, (p["n_estimators"],), (p["max_samples"],), (p["max_features"],), (p["n_neighbors"],), SEED)
    preds = bagged_predictions(s.test, s.train, best, "row_id", "fire_area")
    return s.test.select("row_id", "fire_area").join(preds, "row_id").select("row_id", "fire_area", F.element_at("preds", 1).alias("prediction"))


@register("bagged_knn")
def q_bagged_knn(spark, sf_dir):
    """Test error of bagged neighbour regression at the best point of the grid."""
    return _regression_row("bagged_knn", bagged_knn_predictions(spark, sf_dir))


def _classification_row(name, pred):
    """(model, metric, value) rows: test accuracy and ROC AUC."""
    acc = M.accuracy(pred, "quality", "prediction").select(F.lit("accuracy").alias("metric"),
                                                           F.round("accuracy", 6).alias("value"))
    auc = M.roc_auc(pred, "quality", "probability").select(F.lit("auc").alias("metric"), F.round("auc", 6).alias("value"))
    return acc.unionByName(auc).select(F.lit(name).alias("model"), "metric", "value")


@register("logreg")
def q_logreg(spark, sf_dir):
    tr, te = _wine_minmax(spark, sf_dir)
    model = ML.logistic_regression(tr, WINE_FEATURES, "quality", C=1.0)
    pred = ML.predict(model, te, WINE_FEATURES, ["row_id", "quality"])
    return _classification_row("logistic_regression", pred.withColumn("prediction", F.col("prediction").cast("int")))


@register("decision_tree")
def q_decision_tree(spark, sf_dir):
    tr, te = _wine_standard(spark, sf_dir)
    model = ML.decision_tree(tr, WINE_FEATURES, "quality", max_depth=10)
    pred = ML.predict(model, te, WINE_FEATURES, ["row_id", "quality"])
    return _classification_row("decision_tree", pred.withColumn("prediction", F.col("prediction").cast("int")))


@register("mlp_classifier")
def q_mlp(spark, sf_dir):
    tr, te = _wine_minmax(spark, sf_dir)
    model = ML.mlp(tr, WINE_FEATURES, "quality", max_iter=100)
    pred = ML.predict(model, te, WINE_FEATURES, ["row_id", "quality"])
    return _classification_row("mlp", pred.withColumn("prediction", F.col("prediction").cast("int")))


@register("grid_search")
def q_grid_search(spark, sf_dir):
    """Random-forest grid (trees x depth) scored by 5-fold CV R^2 on hash folds, in parallel."""
    from pyspark.ml.regression import RandomForestRegressor
    s = _fire_data(spark, sf_dir)
    # kept for twenty fits, their scores and the neighbours; not written, since MLlib's samples depend on the partitions
    train = kfold(s.train, ["row_id"], 5, SEED, name="fold").withColumn("fold", F.col("fold").cast("int")).persist(StorageLevel.MEMORY_AND_DISK)
    est = RandomForestRegressor(featuresCol="features", labelCol="fire_area", seed=SEED)
    _, table = ML.grid_search(train, FIRE_FEATURES, "fire_area", est, {"numTrees": [10, 20], "maxDepth": [4, 8]},
                              fold_col="fold", folds=5, metric="r2")
    # the reference's kNN grid: n_neighbors in {15, 18, 21}, 5-fold CV, R^2
    knn_table = materialize(K.knn_cv_grid(train, FIRE_FEATURES, "fire_area", "row_id", [15, 18, 21], "fold"), "knn-grid")
    train.unpersist()
    return table.select(F.lit("random_forest").alias("model"), "params", _r("cv_metric")).unionByName(
        knn_table.select(F.lit("knn").alias("model"), "params", _r("cv_metric")))


FOLDS, INNER = 5, 3
K_CHOICES = list(range(6, 50, 5))
_IDS = ["row_id", "copy_index"]


def _rounded(table):
    return table.select("fold", "n", *[_r(c) for c in ("accuracy", "mean_accuracy", "sd_accuracy")], "best", _r("test_accuracy"))


def _folded(pair, strata=("quality",)):
    """(train with its folds, written; test with the columns of train) of scaled sets."""
    train, test = pair
    return materialize(kfold(train, _IDS, FOLDS, SEED, strata=list(strata), name="fold"), "wine-folds"), test.withColumn("copy_index", F.lit(None).cast("int"))


def _classified(model, df):
    out = ML.predict(model, df, WINE_FEATURES, [*_IDS, "quality"])
    return out.withColumn("prediction", F.col("prediction").cast("int"))


@register("logreg_folds")
def q_logreg_folds(spark, sf_dir):
    """Logistic regression on min-max features in five stratified folds; the best fold's model on the test rows."""
    train, test = _folded(_wine_minmax(spark, sf_dir))
    fit = lambda df: ML.logistic_regression(df, WINE_FEATURES, "quality", C=1.0)
    return _rounded(CV.best_fold(train, test, "fold", FOLDS, "quality", fit, _classified))


@register("mlp_folds")
def q_mlp_folds(spark, sf_dir):
    """The perceptron on min-max features in five plain folds; the best fold's model on the test rows."""
    train, test = _folded(_wine_minmax(spark, sf_dir), ())
    fit = lambda df: ML.mlp(df, WINE_FEATURES, "quality", max_iter=100)
    return _rounded(CV.best_fold(train, test, "fold", FOLDS, "quality", fit, _classified))


# The study's grid: depths 20, 30, 40; 20, 30 or 40 rows to split; 20, 32 or 64 rows in a leaf; sqrt or log2 of the eleven
# features (3 either way); gini or entropy.  A leaf of 20 rows already needs 40 to split, and a tree that stays under 20
# levels is the same for every depth, so these are the points that differ.
TREE_GRID = [(leaf, impurity) for leaf in (20, 32, 64) for impurity in ("gini", "entropy")]


def _tree_by_inner_folds(df):
    """Grid point of the best mean accuracy over three inner folds, fitted again on all rows of ``df``."""
    inner = materialize(kfold(df.drop("inner"), _IDS, INNER, SEED, strata=["quality"], name="inner"), "wine-inner")

    def tree(rows, leaf, impurity):
        return ML.feature_tree(rows, WINE_FEATURES, "quality", 3, max_depth=30, impurity=impurity, min_instances=leaf)

    def score(point):
        _, oof = CV.out_of_fold(inner, "inner", INNER, lambda rows: tree(rows, *point), _classified, parallel=INNER)
        return oof.groupBy("inner").agg(F.avg((F.col("quality") == F.col("prediction")).cast("double")).alias("a")).agg(F.avg("a")).first()[0]

    scores = CV.side_by_side([lambda p=p: score(p) for p in TREE_GRID], parallel=3)
    return tree(inner, *TREE_GRID[max(range(len(scores)), key=lambda i: (scores[i], -i))])


@register("nested_cv")
def q_nested_cv(spark, sf_dir):
    """Decision tree on z-scores: five stratified outer folds, a grid searched over three inner folds in each; the best
    outer fold's tree on the test rows."""
    train, test = _folded(_wine_standard(spark, sf_dir))
    return _rounded(CV.best_fold(train, test, "fold", FOLDS, "quality", _tree_by_inner_folds, _classified, parallel=2))


def _fold_votes(train, test, ids, k):
    return K.knn_classify(test.withColumn("_id", F.struct(*ids)), train, WINE_FEATURES, k, "_id", _IDS, "quality") \
        .select("_id.*", "prediction")


def _k_by_inner_folds(df):
    """(rows, k): the k of the best mean accuracy over three inner folds, the smallest of equals."""
    inner = materialize(kfold(df, _IDS, INNER, SEED, strata=["quality"], name="inner"), "wine-inner")
    votes = K.knn_cv_predictions(inner, WINE_FEATURES, "quality", _IDS, K_CHOICES, "inner")
    right = [F.avg(((F.col(f"p{k}") > 0.5).cast("int") == F.col("quality")).cast("double")).alias(f"a{k}") for k in K_CHOICES]
    row = votes.groupBy("inner").agg(*right).agg(*[F.avg(f"a{k}").alias(f"a{k}") for k in K_CHOICES]).first()
    return inner.drop("inner"), max(K_CHOICES, key=lambda k: (round(row[f"a{k}"], 12), -k))


def _vote(model, df):
    rows, k = model
    return df.select(*_IDS, "quality").join(_fold_votes(rows, df, _IDS, k).withColumnRenamed("copy_index", "_copy").withColumnRenamed("row_id", "_row"),
                                            (F.col("row_id") == F.col("_row")) & F.col("copy_index").eqNullSafe(F.col("_copy"))).drop("_row", "_copy")


def _distance_sql(q, r):
    return " + ".join(f"({q}.{c} - {r}.{c}) * ({q}.{c} - {r}.{c})" for c in WF)


def _majority_sql(nearest: str, k: str) -> str:
    """Majority of the first ``k`` of a list of neighbour labels; a tie is 0."""
    return f"CAST(list_sum(list_slice({nearest}, 1, {k})) * 2 > least({k}, len({nearest})) AS INTEGER)"


KNN_FOLD_CTES = [
    ("sr2", "SELECT *, COALESCE(copy_index, -1) AS rc, md5(concat_ws('|', '42', row_id, copy_index)) AS h FROM sr"),
    ("outer_", "SELECT *, (row_number() OVER (PARTITION BY quality ORDER BY h, row_id, rc) - 1) % 5 AS fold FROM sr2"),
    ("inner_", """
SELECT o.*, f.j AS o_fold, (row_number() OVER (PARTITION BY f.j, quality ORDER BY h, row_id, rc) - 1) % 3 AS i_fold
FROM outer_ o, range(5) f(j) WHERE o.fold <> f.j"""),
    ("inner_near", f"""
SELECT q.o_fold, q.i_fold, q.row_id, q.rc, q.quality, list(r.quality ORDER BY {_distance_sql('q', 'r')}, r.row_id, r.rc)[1:46] AS near
FROM inner_ q JOIN inner_ r ON r.o_fold = q.o_fold AND r.i_fold <> q.i_fold GROUP BY ALL"""),
    ("inner_score", f"""
SELECT o_fold, k, AVG(a) AS a FROM (
  SELECT o_fold, i_fold, k, AVG(CAST({_majority_sql('near', 'k')} = quality AS DOUBLE)) AS a
  FROM inner_near, (SELECT unnest({K_CHOICES}) AS k) GROUP BY o_fold, i_fold, k) GROUP BY o_fold, k"""),
    ("chosen", "SELECT o_fold, k FROM inner_score QUALIFY row_number() OVER (PARTITION BY o_fold ORDER BY round(a, 12) DESC, k) = 1"),
    ("outer_near", f"""
SELECT q.fold, q.row_id, q.rc, q.quality, list(r.quality ORDER BY {_distance_sql('q', 'r')}, r.row_id, r.rc)[1:46] AS near
FROM outer_ q JOIN outer_ r ON r.fold <> q.fold GROUP BY ALL"""),
    ("outer_score", f"""
SELECT fold, k, COUNT(*) AS n, AVG(CAST({_majority_sql('near', 'k')} = quality AS DOUBLE)) AS accuracy
FROM outer_near JOIN chosen ON o_fold = fold GROUP BY fold, k"""),
    ("best_", "SELECT fold AS b, k FROM outer_score ORDER BY accuracy DESC, fold LIMIT 1"),
    ("test_near", f"""
SELECT q.row_id, t.quality, k, list(r.quality ORDER BY {_distance_sql('q', 'r')}, r.row_id, r.rc)[1:46] AS near
FROM sq q JOIN wtest t ON t.row_id = q.row_id, best_ JOIN outer_ r ON r.fold <> b GROUP BY ALL"""),
]


@register("knn_folds", wsql(f"""
SELECT fold, CAST(n AS BIGINT) AS n, round(accuracy, 6) AS accuracy, round(AVG(accuracy) OVER (), 6) AS mean_accuracy,
       round(STDDEV_POP(accuracy) OVER (), 6) AS sd_accuracy, fold = b AS best,
       CASE WHEN fold = b THEN (SELECT round(AVG(CAST({_majority_sql('near', 'k')} = quality AS DOUBLE)), 6) FROM test_near) END AS test_accuracy
FROM outer_score, (SELECT b FROM best_)""", KNN_FOLD_CTES))
def q_knn_folds(spark, sf_dir):
    """Nearest neighbours on z-scores: five stratified outer folds, k of 6, 11, ... 46 chosen over three inner folds in
    each; the best outer fold's rows and k on the test rows."""
    train, test = _folded(_wine_standard(spark, sf_dir))
    return _rounded(CV.best_fold(train, test, "fold", FOLDS, "quality", _k_by_inner_folds, _vote, parallel=5))


def _bagged_table_predictions(s):
    preds = bagged_predictions(s.test, s.train, TABLE_BAG, "row_id", "fire_area")
    out = s.test.select("row_id", "fire_area").join(preds, "row_id").select("row_id", "fire_area", F.element_at("preds", 1).alias("prediction"))
    return materialize(out, "bag-table")


@register("classifier_evaluation", wsql("""
SELECT n, round(accuracy, 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, round(auc, 6) AS auc, round(loss, 6) AS log_loss
FROM (SELECT CAST(COUNT(*) AS BIGINT) AS n, AVG(CAST(quality = prediction AS DOUBLE)) AS accuracy,
             AVG(-(quality * ln(least(greatest(probability, 1e-7), 1 - 1e-7)) + (1 - quality) * ln(1 - least(greatest(probability, 1e-7), 1 - 1e-7)))) AS loss FROM wpred),
     (SELECT SUM(precision * support) / SUM(support) AS p, SUM(recall * support) / SUM(support) AS r, SUM(f1 * support) / SUM(support) AS f FROM per),
     (SELECT AVG(CASE WHEN a.probability > b.probability THEN 1.0 WHEN a.probability = b.probability THEN 0.5 ELSE 0.0 END) AS auc
      FROM wpred a, wpred b WHERE a.quality = 1 AND b.quality = 0)""", [("per", _CLS)]))
def q_classifier_evaluation(spark, sf_dir):
    """All scores of one set of predictions in one row."""
    e = M.evaluate(wine_knn_predictions(spark, sf_dir), "quality", "prediction", "probability")
    return e.select("n", *[_r(c) for c in ("accuracy", "precision", "recall", "f1", "auc", "log_loss")])


@register("classifier_table")
def q_classifier_table(spark, sf_dir):
    """Test scores of the four wine classifiers side by side, best accuracy first."""
    scaled = {"minmax": _wine_minmax(spark, sf_dir), "standard": _wine_standard(spark, sf_dir)}
    fits = {"logistic_regression": ("minmax", lambda d: ML.logistic_regression(d, WINE_FEATURES, "quality", C=1.0)),
            "decision_tree": ("standard", lambda d: ML.feature_tree(d, WINE_FEATURES, "quality", 3, max_depth=30, min_instances=20)),
            "mlp": ("minmax", lambda d: ML.mlp(d, WINE_FEATURES, "quality", max_iter=100))}

    def predictions(name):
        kind, fit = fits[name]
        train, test = scaled[kind]
        out = ML.predict(fit(train), test, WINE_FEATURES, ["row_id", "quality"])
        return out.withColumn("prediction", F.col("prediction").cast("int"))

    parts = dict(zip(fits, CV.side_by_side([lambda n=n: predictions(n) for n in fits])))
    parts["knn"] = wine_knn_predictions(spark, sf_dir)
    out = None
    for name, pred in sorted(parts.items()):
        e = M.evaluate(pred, "quality", "prediction", "probability").select(F.lit(name).alias("model"), "n", *[_r(c) for c in ("accuracy", "precision", "recall", "f1", "auc", "log_loss")])
        out = e if out is None else out.unionByName(e)
    return out.withColumn("rank", F.rank().over(Window.orderBy(F.desc("accuracy"))).cast("bigint"))  # one row per model


@register("model_leaderboard")
def q_leaderboard(spark, sf_dir):
    """Test-set MAE / MSE / RMSE of every regression model with its fit time (driver-side
    timer around the fitting actions), ranked by RMSE."""
    s = _fire_data(spark, sf_dir)
    lr, t_lr = ML.timed(ML.linear_regression, s.train, FIRE_FEATURES, "fire_area")
    (rf, _), t_rf = ML.timed(_rf, spark, sf_dir)
    gbt, t_gbt = ML.timed(ML.gradient_boosting, s.train, FIRE_FEATURES, "fire_area", max_iter=30)
    knn_pred, t_knn = fire_knn_predictions(spark, sf_dir, with_seconds=True)
    bag_pred, t_bag = ML.timed(_bagged_table_predictions, s)
    rows = [(_regression_row("bagged_knn", bag_pred), t_bag),
            (_regression_row("linear_regression", ML.predict(lr, s.test, FIRE_FEATURES, ["fire_area"])), t_lr),
            (_regression_row("knn", knn_pred), t_knn),
            (_regression_row("random_forest", ML.predict(rf, s.test, FIRE_FEATURES, ["fire_area"])), t_rf),
            (_regression_row("gradient_boosting", ML.predict(gbt, s.test, FIRE_FEATURES, ["fire_area"])), t_gbt)]
    out = None
    for df, t in rows:
        df = df.withColumn("fit_seconds", F.lit(round(t, 3)))
        out = df if out is None else out.unionByName(df)
    return out.withColumn("rank", F.rank().over(Window.orderBy("rmse")).cast("bigint"))


@register("kde_by_group", wsql("""
SELECT s.quality, CAST(g.i AS BIGINT) AS grid_index, round(s.g0 + g.i * s.step, 6) AS x,
       round(SUM(exp(-pow((s.g0 + g.i * s.step - z0.f11) / s.h, 2) / 2.0)) / (s.n * s.h * sqrt(2 * pi())), 6) AS density
FROM z0 JOIN st3 s ON s.quality = z0.quality, range(64) g(i)
WHERE z0.f11 IS NOT NULL
GROUP BY s.quality, g.i, s.g0, s.step, s.n, s.h""", [
    ("st", "SELECT quality, COUNT(*) AS n, STDDEV_SAMP(f11) AS sd, MIN(f11) AS lo, MAX(f11) AS hi FROM z0 "
           "WHERE f11 IS NOT NULL GROUP BY quality"),
    ("st2", "SELECT *, sd * pow(CAST(n AS DOUBLE), -0.2) AS h FROM st"),
    ("st3", "SELECT *, lo - 3.0 * h AS g0, (hi + 3.0 * h - (lo - 3.0 * h)) / 63 AS step FROM st2")]))
def q_kde(spark, sf_dir):
    """Density of the last feature per (binary) class on a 64-point grid."""
    return P.kde_by_group(wine_binary(spark, sf_dir), "f11", "quality", 64)


@register("kde_by_feature", wsql("""
SELECT s.feature, s.quality, CAST(g.i AS BIGINT) AS grid_index, round(s.g0 + g.i * s.step, 6) AS x,
       round(SUM(exp(-pow((s.g0 + g.i * s.step - l.v) / s.h, 2) / 2.0)) / (s.n * s.h * sqrt(2 * pi())), 6) AS density
FROM long l JOIN st3 s ON s.quality = l.quality AND s.feature = l.feature, range(64) g(i)
GROUP BY s.feature, s.quality, g.i, s.g0, s.step, s.n, s.h""", [
    ("long", " UNION ALL ".join(f"SELECT '{c}' AS feature, quality, CAST({c} AS DOUBLE) AS v FROM z0 WHERE {c} IS NOT NULL"
                                for c in WINE_FEATURES)),
    ("st", "SELECT feature, quality, COUNT(*) AS n, STDDEV_SAMP(v) AS sd, MIN(v) AS lo, MAX(v) AS hi FROM long GROUP BY ALL"),
    ("st2", "SELECT *, sd * pow(CAST(n AS DOUBLE), -0.2) AS h FROM st"),
    ("st3", "SELECT *, lo - 3.0 * h AS g0, (hi + 3.0 * h - (lo - 3.0 * h)) / 63 AS step FROM st2")]))
def q_kde_features(spark, sf_dir):
    """Densities of all features per (binary) class, each on a 64-point grid of its own."""
    return P.kde_by_feature(wine_binary(spark, sf_dir), WINE_FEATURES, "quality", 64)
