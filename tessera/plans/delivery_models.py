"""Registered queries of the delivery-time models: the linear model and its fit on data held out."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import significant
from ..operators import linear as L
from ..operators.sampling import split_quantile
from ..session import cache, folder_state, scratch_path, write_read
from ..sources.fixtures import SEED
from .deliveries import deliveries
from .delivery_queries import dsql
from .linear_sql import lm_ctes, recursive, significant_sql
from .registry import register

LABEL = "delivery_time_min"
FACTORS = ["order_type", "vehicle_type", "weather_type", "traffic_level"]
NUMBERS = ["temperature", "distance"]
# The levels of the stand-in's categories in alphabetical order; the first is the base level.
LEVELS = {"order_type": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], "vehicle_type": ["F", "O", "P"],
          "weather_type": [f"W{i}" for i in range(7)], "traffic_level": ["High", "Low", "Moderate", "Very High", "Very Low"]}

_SETS: dict = cache()


def delivery_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(train, test): 80 % of each quantile group of the delivery time, written once."""
    key = (spark.sparkContext.applicationId, sf_dir, folder_state(spark, sf_dir))
    if key not in _SETS:
        path = scratch_path(spark, "deliveries-" + hashlib.sha1(str(key).encode()).hexdigest()[:12])
        # read by every step of the split: the raw text is parsed once
        rows = write_read(deliveries(spark, sf_dir).select("row_id", *FACTORS, *NUMBERS, LABEL).dropna(), f"{path}/rows")
        _SETS[key] = write_read(split_quantile(rows, LABEL, ["row_id"], 0.8, SEED, name="in_train"), f"{path}/split")
    flagged = _SETS[key]
    return flagged.where("in_train").drop("in_train"), flagged.where(~F.col("in_train")).drop("in_train")


SPLIT_CTES = [
    ("whole", f"SELECT row_id, {', '.join(FACTORS + NUMBERS)}, {LABEL} FROM clean WHERE {' AND '.join(f'{c} IS NOT NULL' for c in FACTORS + NUMBERS + [LABEL])}"),
    ("breaks", f"SELECT list_distinct(quantile_cont({LABEL}, [0, 0.25, 0.5, 0.75, 1])) AS b FROM whole"),
    ("grouped", f"SELECT w.*, greatest(1, len(list_filter(b, lambda x: x < {LABEL}))) AS g FROM whole w, breaks"),
    ("ranked", "SELECT *, row_number() OVER (PARTITION BY g ORDER BY md5(concat_ws('|', '42', row_id)), row_id) AS rk, COUNT(*) OVER (PARTITION BY g) AS gn FROM grouped"),
    ("dtrain", "SELECT * FROM ranked WHERE rk <= ceil(gn * CAST(0.8 AS DOUBLE))"),
    ("dtest", "SELECT * FROM ranked WHERE rk > ceil(gn * CAST(0.8 AS DOUBLE))"),
]
TERMS = {f"{c}_{v}": f"CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END" for c in FACTORS for v in LEVELS[c][1:]} | {c: c for c in NUMBERS}
LM_CTES = SPLIT_CTES + lm_ctes("dtrain", TERMS, LABEL)


def _fit(spark, sf_dir):
    train, test = delivery_sets(spark, sf_dir)
    levels = L.levels_of(train, FACTORS)
    train, dummies = L.dummy_columns(train, levels)
    test, _ = L.dummy_columns(test, levels)
    return L.least_squares(train, [*dummies, *NUMBERS], LABEL), test


@register("delivery_split", dsql("SELECT row_id, rk <= ceil(gn * CAST(0.8 AS DOUBLE)) AS in_train FROM ranked", SPLIT_CTES))
def q_delivery_split(spark, sf_dir):
    train, test = delivery_sets(spark, sf_dir)
    return train.select("row_id", F.lit(True).alias("in_train")).unionByName(test.select("row_id", F.lit(False).alias("in_train")))


def coefficient_rows(spark, fit):
    table = spark.createDataFrame(fit.table(), "term string, estimate double, std_error double, t_value double, p_value double")
    return table.select("term", *[significant(c, 6).alias(c) for c in ("estimate", "std_error", "t_value")], F.round("p_value", 6).alias("p_value"))


COEFFICIENTS_SQL = "SELECT term, " + ", ".join(f"{significant_sql(c)} AS {c}" for c in ("estimate", "std_error", "t_value")) + ", round(p_value, 6) AS p_value FROM lm"


@register("lm_delivery", recursive(dsql(COEFFICIENTS_SQL, LM_CTES)))
def q_lm_delivery(spark, sf_dir):
    """Delivery time on order, vehicle, temperature, weather, traffic and distance: estimates, errors, t and p."""
    return coefficient_rows(spark, _fit(spark, sf_dir)[0])


@register("lm_delivery_fit", recursive(dsql(f"""
SELECT CAST(n AS BIGINT) AS n_train, CAST(n - rank AS BIGINT) AS df, {significant_sql('sqrt(rss / (n - rank))')} AS sigma,
       round(1 - rss / tss, 8) AS r_squared, round(1 - (rss / (n - rank)) / (tss / (n - 1)), 8) AS adj_r_squared,
       {significant_sql('((tss - rss) / (rank - 1)) / (rss / (n - rank))')} AS f_statistic, CAST(n_test AS BIGINT) AS n_test, {significant_sql('rmse')} AS rmse_test
FROM lm_fit, (SELECT COUNT(*) AS n_test, sqrt(AVG(pow({LABEL} - ({' + '.join(f'm[{i}][{len(TERMS) + 2}] * ({e})' for i, e in enumerate(['1.0', *TERMS.values()], 1))}), 2))) AS rmse
              FROM dtest, lmb)""", LM_CTES)))
def q_lm_delivery_fit(spark, sf_dir):
    """Fit of the linear model on the training part, and its error on the rows held out."""
    fit, test = _fit(spark, sf_dir)
    scored = test.agg(F.count(F.lit(1)).alias("n_test"), F.sqrt(F.avg(F.pow(F.col(LABEL) - fit.prediction(), 2))).alias("rmse"))
    sigma2, n = fit.rss / fit.df, fit.rows
    return scored.select(
        F.lit(n).cast("bigint").alias("n_train"), F.lit(fit.df).cast("bigint").alias("df"), significant(F.lit(sigma2 ** 0.5), 6).alias("sigma"),
        F.round(F.lit(1 - fit.rss / fit.tss), 8).alias("r_squared"), F.round(F.lit(1 - sigma2 / (fit.tss / (n - 1))), 8).alias("adj_r_squared"),
        significant(F.lit((fit.tss - fit.rss) / (fit.rank - 1) / sigma2), 6).alias("f_statistic"), "n_test", significant("rmse", 6).alias("rmse_test"))
