"""Registered queries of the ratings study (readers, splits, top-k, bias models)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import round_to_day, title_year, truncate_label
from ..operators import bias as B
from ..operators.joins import anti_join_rows, join_nullsafe
from ..operators.metrics import rmse
from ..operators.sampling import sample_values
from ..session import cache, folder_state, fresh_path, materialize
from ..sources.fixtures import SEED, fixture
from ..sources.readers import read_delimited, write_delimited
from .ratings import FACTORS, KEYS, ratings_working_set, rating_sets
from .ratings_sql import bias_ctes, grid_lams, lam_list, predict_sql, rsql
from .registry import register

R6 = 6


def _sets(spark, sf_dir):
    return rating_sets(spark, sf_dir)


@register("scan_delimited", rsql("""
SELECT userid, movieid, rating, CAST(epoch(rated_at) AS BIGINT) AS ts FROM ratings"""))
def q_scan_delimited(spark, sf_dir):
    """Ratings as '::'-separated lines (userId::movieId::rating::timestamp), read back typed."""
    r = fixture(spark, sf_dir, "ratings").select("userid", "movieid", "rating",
                                                 F.unix_timestamp("rated_at").alias("ts"))
    path = fresh_path(spark, "dat")
    write_delimited(r, path, "::")
    schema = T.StructType([T.StructField("userid", T.LongType()), T.StructField("movieid", T.LongType()),
                           T.StructField("rating", T.DoubleType()), T.StructField("ts", T.LongType())])
    return read_delimited(spark, path, schema, "::")


@register("join_left", rsql("SELECT userid, movieid, rating, title, genres FROM ml"))
def q_join_left(spark, sf_dir):
    return ratings_working_set(spark, sf_dir).select("userid", "movieid", "rating", "title", "genres")


@register("round_to_day", rsql("SELECT userid, movieid, day FROM ml"))
def q_round_to_day(spark, sf_dir):
    r = fixture(spark, sf_dir, "ratings")
    return r.select("userid", "movieid", round_to_day("rated_at").alias("day"))


@register("title_year", rsql("""
SELECT movieid, TRY_CAST(NULLIF(regexp_extract(title, '\\((\\d{4})\\)', 1), '') AS INTEGER) AS year_publication FROM movies"""))
def q_title_year(spark, sf_dir):
    m = fixture(spark, sf_dir, "movies")
    return m.select("movieid", title_year("title").alias("year_publication"))


@register("truncate_label", rsql("SELECT movieid, substring(genres, 1, 15) AS label FROM movies"))
def q_truncate_label(spark, sf_dir):
    return fixture(spark, sf_dir, "movies").select("movieid", truncate_label("genres", 15).alias("label"))


@register("split_quantile", rsql("""
SELECT userid, movieid, true AS in_holdout FROM h_in UNION ALL SELECT userid, movieid, false AS in_holdout FROM h_out"""))
def q_split_quantile(spark, sf_dir):
    from ..operators.sampling import split_quantile
    ml = ratings_working_set(spark, sf_dir)
    return split_quantile(ml, "rating", KEYS, 0.1, SEED, name="in_holdout").select("userid", "movieid", "in_holdout")


@register("join_semi", rsql("SELECT userid, movieid FROM final_holdout"))
def q_join_semi(spark, sf_dir):
    return _sets(spark, sf_dir).holdout.select(*KEYS)


@register("join_anti", rsql("SELECT userid, movieid FROM removed"))
def q_join_anti(spark, sf_dir):
    """Rows set aside for the hold-out that are in it no longer: an anti join on all common columns."""
    s = _sets(spark, sf_dir)
    return materialize(anti_join_rows(s.holdout.unionByName(s.removed), s.holdout).select(*KEYS), "anti")


@register("union_by_name", rsql("SELECT userid, movieid, rating FROM edx"))
def q_union_by_name(spark, sf_dir):
    return _sets(spark, sf_dir).edx.select(*KEYS, "rating")


@register("holdout_repair", rsql("""
SELECT 'edx' AS part, CAST(COUNT(*) AS BIGINT) AS n_rows FROM edx
UNION ALL SELECT 'holdout', CAST(COUNT(*) AS BIGINT) FROM final_holdout
UNION ALL SELECT 'removed', CAST(COUNT(*) AS BIGINT) FROM removed"""))
def q_holdout_repair(spark, sf_dir):
    s = _sets(spark, sf_dir)
    parts = [(name, df) for name, df in (("edx", s.edx), ("holdout", s.holdout), ("removed", s.removed))]
    out = None
    for name, df in parts:
        one = df.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows")).select(F.lit(name).alias("part"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


@register("complement_rows", rsql("SELECT userid, movieid FROM test0"))
def q_complement_rows(spark, sf_dir):
    s = _sets(spark, sf_dir)
    return s.edx.select(*KEYS).join(s.train.select(*KEYS), KEYS, "left_anti")


@register("sample_values", rsql("""
SELECT genres FROM (SELECT DISTINCT genres FROM edx) t ORDER BY md5(concat_ws('|', '42', genres)), genres LIMIT 10"""))
def q_sample_values(spark, sf_dir):
    return sample_values(_sets(spark, sf_dir).edx, "genres", 10, SEED)


def _item_means(df):
    return df.groupBy("movieid").agg(F.first("title").alias("title"), F.count(F.lit(1)).cast("bigint").alias("n_ratings"),
                                     F.avg("rating").alias("mean_rating"))


ITEM_MEANS = "SELECT movieid, any_value(title) AS title, CAST(COUNT(*) AS BIGINT) AS n_ratings, AVG(rating) AS mean_rating FROM edx GROUP BY movieid"


@register("topk_items", rsql(f"""
SELECT movieid, title, n_ratings, round(mean_rating, 6) AS mean_rating FROM ({ITEM_MEANS}) t
ORDER BY mean_rating DESC, movieid LIMIT 6"""))
def q_topk_items(spark, sf_dir):
    m = _item_means(_sets(spark, sf_dir).edx)
    return m.orderBy(F.col("mean_rating").desc(), "movieid").limit(6) \
        .withColumn("mean_rating", F.round("mean_rating", R6))


@register("bottomk_items", rsql(f"""
SELECT movieid, title, n_ratings, round(mean_rating, 6) AS mean_rating FROM ({ITEM_MEANS}) t
ORDER BY mean_rating, movieid LIMIT 6"""))
def q_bottomk_items(spark, sf_dir):
    m = _item_means(_sets(spark, sf_dir).edx)
    return m.orderBy("mean_rating", "movieid").limit(6).withColumn("mean_rating", F.round("mean_rating", R6))


@register("bottomk_users", rsql("""
SELECT userid, n_ratings, round(mean_rating, 6) AS mean_rating
FROM (SELECT userid, CAST(COUNT(*) AS BIGINT) AS n_ratings, AVG(rating) AS mean_rating FROM edx GROUP BY userid) t
ORDER BY mean_rating, userid LIMIT 10"""))
def q_bottomk_users(spark, sf_dir):
    u = _sets(spark, sf_dir).edx.groupBy("userid").agg(F.count(F.lit(1)).cast("bigint").alias("n_ratings"),
                                                       F.avg("rating").alias("mean_rating"))
    return u.orderBy("mean_rating", "userid").limit(10).withColumn("mean_rating", F.round("mean_rating", R6))


@register("topk_mean", rsql(f"""
SELECT 'most_rated' AS items, round(AVG(mean_rating), 6) AS mean_of_means
FROM (SELECT * FROM ({ITEM_MEANS}) t ORDER BY n_ratings DESC, movieid LIMIT 20) a
UNION ALL
SELECT 'least_rated', round(AVG(mean_rating), 6)
FROM (SELECT * FROM ({ITEM_MEANS}) t ORDER BY n_ratings, movieid LIMIT 20) b"""))
def q_topk_mean(spark, sf_dir):
    m = _item_means(_sets(spark, sf_dir).edx)
    most = m.orderBy(F.col("n_ratings").desc(), "movieid").limit(20) \
        .agg(F.round(F.avg("mean_rating"), R6).alias("mean_of_means")).select(F.lit("most_rated").alias("items"), "mean_of_means")
    least = m.orderBy("n_ratings", "movieid").limit(20) \
        .agg(F.round(F.avg("mean_rating"), R6).alias("mean_of_means")).select(F.lit("least_rated").alias("items"), "mean_of_means")
    return most.unionByName(least)


@register("agg_carry_attribute", rsql("""
SELECT movieid, any_value(title) AS title, any_value(genres) AS genres, CAST(COUNT(*) AS BIGINT) AS n_ratings,
       round(AVG(rating), 6) AS mean_rating FROM edx GROUP BY movieid"""))
def q_carry_attribute(spark, sf_dir):
    """title and genres depend on movieid alone, so any value of the group is the value."""
    return _sets(spark, sf_dir).edx.groupBy("movieid").agg(
        F.any_value("title").alias("title"), F.any_value("genres").alias("genres"),
        F.count(F.lit(1)).cast("bigint").alias("n_ratings"), F.round(F.avg("rating"), R6).alias("mean_rating"))


@register("daily_mean", rsql("SELECT day, round(AVG(rating), 6) AS mean_rating FROM edx GROUP BY day"))
def q_daily_mean(spark, sf_dir):
    return _sets(spark, sf_dir).edx.groupBy("day").agg(F.round(F.avg("rating"), R6).alias("mean_rating"))


@register("yearly_mean", rsql("""
SELECT year_publication, round(AVG(rating), 6) AS mean_rating FROM edx GROUP BY year_publication"""))
def q_yearly_mean(spark, sf_dir):
    return _sets(spark, sf_dir).edx.groupBy("year_publication").agg(F.round(F.avg("rating"), R6).alias("mean_rating"))


@register("cross_one_row", rsql("""
SELECT userid, movieid, round(rating - (SELECT AVG(rating) FROM edx), 6) AS residual FROM edx"""))
def q_cross_one_row(spark, sf_dir):
    edx = _sets(spark, sf_dir).edx
    mu = edx.agg(F.avg("rating")).first()[0]  # the one-row relation is a scalar
    return edx.select("userid", "movieid", F.round(F.col("rating") - F.lit(mu), R6).alias("residual"))


# ---- bias models -----------------------------------------------------------------------

def _fit(spark, sf_dir, factors, lambdas=(0.0,), on="train"):
    s = _sets(spark, sf_dir)
    return B.fit(getattr(s, on), "rating", factors, lambdas), s


@register("bias_mean_rmse", rsql("""
SELECT round(sqrt(AVG((rating - mu) * (rating - mu))), 6) AS rmse FROM test, (SELECT AVG(rating) AS mu FROM train) m"""))
def q_bias_mean_rmse(spark, sf_dir):
    s = _sets(spark, sf_dir)
    mu = s.train.agg(F.avg("rating")).first()[0]
    return rmse(s.test.withColumn("pred", F.lit(mu)), "rating", "pred").select(F.round("rmse", R6).alias("rmse"))


def _coef_sql(factor, factors, lam):
    body = f"SELECT k AS {factor}, round(b, 6) AS b_{factor} FROM b_{factor}"
    return rsql(body, bias_ctes("train", lam_list([lam]), factors))


@register("bias_item", _coef_sql("movieid", ["movieid"], 0))
def q_bias_item(spark, sf_dir):
    m, _ = _fit(spark, sf_dir, ["movieid"])
    return B.coefficients(m, "movieid").withColumn("b_movieid", F.round("b_movieid", R6))


@register("bias_user", _coef_sql("userid", ["movieid", "userid"], 0))
def q_bias_user(spark, sf_dir):
    m, _ = _fit(spark, sf_dir, ["movieid", "userid"])
    return B.coefficients(m, "userid").withColumn("b_userid", F.round("b_userid", R6))


@register("bias_regularized", _coef_sql("movieid", ["movieid"], 5))
def q_bias_regularized(spark, sf_dir):
    m, _ = _fit(spark, sf_dir, ["movieid"], [5.0])
    return B.coefficients(m, "movieid").withColumn("b_movieid", F.round("b_movieid", R6))


@register("bias_five_factor", rsql(
    "SELECT userid, movieid, round(pred, 6) AS pred FROM (" + predict_sql("test", FACTORS) + ") p",
    bias_ctes("train", lam_list([0]), FACTORS)))
def q_bias_five_factor(spark, sf_dir):
    m, s = _fit(spark, sf_dir, FACTORS)
    p = B.predict(m, s.test)
    return p.select("userid", "movieid", F.round("pred_l0", R6).alias("pred"))


@register("join_left_nullsafe", rsql(
    "SELECT t.userid, t.movieid, t.year_publication, round(b.b, 6) AS b_year_publication FROM test t "
    "LEFT JOIN b_year_publication b ON b.k IS NOT DISTINCT FROM t.year_publication",
    bias_ctes("train", lam_list([0]), FACTORS)))
def q_join_left_nullsafe(spark, sf_dir):
    m, s = _fit(spark, sf_dir, FACTORS)
    coef = B.coefficients(m, "year_publication")
    j = join_nullsafe(s.test.select("userid", "movieid", "year_publication"), coef, ["year_publication"], "left")
    return j.withColumn("b_year_publication", F.round("b_year_publication", R6))


def _ladder_sql():
    parts = []
    for k in range(len(FACTORS) + 1):
        fs = FACTORS[:k]
        pre = f"s{k}_"
        if k == 0:
            parts.append("SELECT CAST(0 AS BIGINT) AS factors, round(sqrt(AVG((rating - mu) * (rating - mu))), 6) AS rmse "
                         "FROM test, (SELECT AVG(rating) AS mu FROM train) m0")
            continue
        parts.append(f"SELECT CAST({k} AS BIGINT) AS factors, round(sqrt(AVG((rating - pred) * (rating - pred))), 6) AS rmse "
                     f"FROM ({predict_sql('test', fs, pre)}) p{k}")
    ctes = []
    for k in range(1, len(FACTORS) + 1):
        ctes += bias_ctes("train", lam_list([0]), FACTORS[:k], f"s{k}_")
    return rsql(" UNION ALL ".join(parts), ctes)


@register("model_log", _ladder_sql())
def q_model_log(spark, sf_dir):
    """RMSE ladder: mean only, then one more factor per row (lambda 0), as a result log."""
    s = _sets(spark, sf_dir)
    mu = s.train.agg(F.avg("rating")).first()[0]
    log = rmse(s.test.withColumn("pred", F.lit(mu)), "rating", "pred").select(
        F.lit(0).cast("bigint").alias("factors"), F.round("rmse", R6).alias("rmse"))
    whole = B.fit(s.train, "rating", FACTORS)  # the stages of a prefix are the first stages of the whole
    for k in range(1, len(FACTORS) + 1):
        r = rmse(B.predict(B.prefix(whole, k), s.test), "rating", "pred_l0").select(
            F.lit(k).cast("bigint").alias("factors"), F.round("rmse", R6).alias("rmse"))
        log = log.unionByName(r)
    return log


_CURVES: dict = cache()


def lambda_curve(spark, sf_dir):
    """(lambda, rmse) curve of the 5-factor model on the inner split, computed once per
    application and input folder (41 rows, kept as a written table)."""
    key = (spark.sparkContext.applicationId, sf_dir, folder_state(spark, sf_dir))
    if key not in _CURVES:
        s = _sets(spark, sf_dir)
        _CURVES[key] = materialize(B.grid_curve(s.train, s.test, "rating", FACTORS, B.LAMBDA_GRID), "lambda-curve")
    return _CURVES[key]


@register("bias_lambda_grid", rsql(
    "SELECT lam AS lambda, round(sqrt(AVG((rating - pred) * (rating - pred))), 6) AS rmse FROM ("
    + predict_sql("test", FACTORS) + ") p GROUP BY lam",
    bias_ctes("train", grid_lams(), FACTORS)))
def q_bias_lambda_grid(spark, sf_dir):
    return lambda_curve(spark, sf_dir).select("lambda", F.round("rmse", R6).alias("rmse"))


def _final_sql():
    grid = bias_ctes("train", grid_lams(), FACTORS, "g_")
    curve = ("curve", "SELECT lam, sqrt(AVG((rating - pred) * (rating - pred))) AS rmse FROM ("
             + predict_sql("test", FACTORS, "g_") + ") p GROUP BY lam")
    best = ("best", "SELECT lam FROM curve ORDER BY rmse, lam LIMIT 1")
    final = bias_ctes("edx", "SELECT lam FROM best", FACTORS, "f_")
    body = ("SELECT lam AS lambda, round(sqrt(AVG((rating - pred) * (rating - pred))), 6) AS rmse, "
            "CAST(SUM(CASE WHEN pred IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_predictions, "
            "CAST(COUNT(*) AS BIGINT) AS n FROM (" + predict_sql("final_holdout", FACTORS, "f_") + ") p GROUP BY lam")
    return rsql(body, grid + [curve, best] + final)


@register("bias_final", _final_sql())
def q_bias_final(spark, sf_dir):
    """Best lambda on the inner split, refit on the whole working set, score the hold-out."""
    s = _sets(spark, sf_dir)
    lam = B.best_lambda(lambda_curve(spark, sf_dir))
    final = B.fit(s.edx, "rating", FACTORS, [lam])
    r = rmse(B.predict(final, s.holdout), "rating", "pred_l0")
    return r.select(F.lit(lam).alias("lambda"), F.round("rmse", R6).alias("rmse"),
                    F.col("null_predictions").cast("bigint"), F.col("n").cast("bigint"))

