"""The eleven analytic reports over the car-sales star schema.

Shape shared by all of them: aggregate the fact on its surrogate key first
(partial + final hash aggregate, so the shuffle carries one row per key and
map task), join the small aggregate to its dimension, then rank / window over
the aggregate.  Money stays DECIMAL until the last step; ratios are computed
from the exact sums as DOUBLE; outputs are BIGINT / DOUBLE / STRING.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import pct_change
from ..operators.windows import global_ntile, rank_top_k, share_of_total
from ..sources.fixtures import LUXURY_CATEGORIES, PIVOT_YEARS
from .warehouse import Star

# The market categories listed in the pivot (the stand-in part types).
PIVOT_CATEGORIES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


def _d(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def exact_avg(total, n, scale: int = 2) -> Column:
    """round(total / n, scale) for a DECIMAL total (at most 4 places) and a positive count,
    half away from zero as on exact numbers; integer arithmetic only, so no binary rounding
    tie can flip the last digit."""
    signed = F.col(total) if isinstance(total, str) else total
    t = F.abs(signed)
    c = (F.col(n) if isinstance(n, str) else n).cast("decimal(38,0)")
    units = (t * 10000).cast("decimal(38,0)")
    step = 10 ** (4 - scale)
    q = (units * 2 + c * step).cast("decimal(38,0)")
    den = (c * (2 * step)).cast("decimal(38,0)")
    exact_quotient = (q - F.pmod(q, den)) / den  # q div den, exact
    rounded = exact_quotient.cast("double") / F.lit(float(10 ** scale))
    return F.when(signed < 0, -rounded).otherwise(rounded)


def monthly_sales(star: Star, fill_months: bool = False) -> DataFrame:
    """Sales per month present in the time dimension.  ``fill_months`` adds a calendar
    spine (every month between the first and the last, one row each) with 0 sales where
    nothing was sold, so LAG compares with the previous calendar month instead of the
    previous row (the reference compares rows)."""
    per_time = star.fact_sales.groupBy("time_dim_id").agg(F.sum("sell_price").alias("total_month_sales"))
    m = per_time.join(star.dim_time.withColumnRenamed("time_id", "time_dim_id"), "time_dim_id") \
        .select("year", "month_number", "month_name", "total_month_sales")
    if not fill_months:
        return m
    bounds = star.dim_time.agg(F.min("month_start").alias("lo"), F.max("month_start").alias("hi"))
    spine = bounds.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 MONTH"))).alias("d")).select(
        F.year("d").cast("bigint").alias("year"), F.month("d").cast("bigint").alias("month_number"),
        F.date_format("d", "MMMM").alias("month_name"))
    return spine.join(m.drop("month_name"), ["year", "month_number"], "left") \
        .withColumn("total_month_sales", F.coalesce("total_month_sales", F.lit(0).cast("decimal(38,4)")))


def report_top3_distributors(star: Star, k: int = 3) -> DataFrame:
    per_dist = star.fact_sales.groupBy("dist_dim_id").agg(
        F.sum("sell_price").alias("s"), F.sum("units_sold").alias("u"))
    totals = per_dist.join(star.dim_distributor.select("dist_dim_id", "state", "distributor_name"), "dist_dim_id") \
        .groupBy("state", "distributor_name").agg(F.sum("s").alias("total_sales"),
                                                  F.sum("u").cast("bigint").alias("total_units"))
    ranked = rank_top_k(totals, ["state"], [F.col("total_sales").desc()], k, name="distributor_rank")
    return ranked.select("state", "distributor_name", _d("total_sales").alias("total_sales"), "total_units",
                         F.col("distributor_rank").cast("bigint").alias("distributor_rank")) \
        .orderBy(F.col("state").asc_nulls_last(), "distributor_rank")


def report_brand_share(star: Star) -> DataFrame:
    per_car = star.fact_sales.groupBy("car_dim_id", "time_dim_id").agg(F.sum("sell_price").alias("s"))
    brand_year = (per_car.join(star.dim_car.select("car_dim_id", "make"), "car_dim_id")
                  .join(star.dim_time.select(F.col("time_id").alias("time_dim_id"), "year"), "time_dim_id")
                  .groupBy("year", "make").agg(F.sum("s").alias("total_brand_sales")))
    year_total = F.sum("total_brand_sales").over(Window.partitionBy("year"))
    share = F.when(year_total != 0, _d("total_brand_sales") / _d(year_total) * F.lit(100.0))
    return brand_year.select("year", "make", _d("total_brand_sales").alias("total_brand_sales"),
                             F.round(share, 2).alias("percent_of_year_sales")) \
        .orderBy("year", F.col("percent_of_year_sales").desc_nulls_first())


def report_mom_change(star: Star, fill_months: bool = False) -> DataFrame:
    m = monthly_sales(star, fill_months)
    prev = F.lag("total_month_sales", 1).over(Window.orderBy("year", "month_number"))
    out = m.withColumn("previous_month_sales", prev)
    change = F.when(F.col("previous_month_sales").isNotNull() & (F.col("previous_month_sales") != 0),
                    _d(F.col("total_month_sales") - F.col("previous_month_sales"))
                    / _d("previous_month_sales") * F.lit(100.0))
    return out.select("year", "month_name", "month_number", _d("total_month_sales").alias("total_month_sales"),
                      _d("previous_month_sales").alias("previous_month_sales"),
                      F.round(change, 2).alias("percentage_change")).orderBy("year", "month_number")


def report_moving_avg(star: Star) -> DataFrame:
    w = Window.orderBy("year", "month_number").rowsBetween(-1, 1)
    avg = exact_avg(F.sum("total_month_sales").over(w), F.count(F.lit(1)).over(w), 2)
    return monthly_sales(star).select(
        "year", "month_name", "month_number", _d("total_month_sales").alias("total_month_sales"),
        avg.alias("centered_3_month_moving_avg")).orderBy("year", "month_number")


def report_yoy_change(star: Star, fill_months: bool = False) -> DataFrame:
    prev = F.lag("total_month_sales", 1).over(Window.partitionBy("month_number").orderBy("year"))
    m = monthly_sales(star, fill_months).withColumn("previous_year_sales", prev)
    return m.select("year", "month_name", _d("total_month_sales").alias("total_month_sales"),
                    _d("previous_year_sales").alias("previous_year_sales"),
                    _d(F.abs(F.col("total_month_sales") - F.col("previous_year_sales"))).alias("absolute_difference"),
                    "month_number").orderBy("year", "month_number").drop("month_number")


def report_cumulative(star: Star) -> DataFrame:
    w = Window.partitionBy("year").orderBy("month_number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = monthly_sales(star)
    return m.select("year", "month_name", _d("total_month_sales").alias("total_month_sales"),
                    _d(F.sum("total_month_sales").over(w)).alias("cumulative_sales_by_year"), "month_number") \
        .orderBy("year", "month_number").drop("month_number")


def report_country_units(star: Star) -> DataFrame:
    """Units and average list price per country; the average is over sales, not cars."""
    per = star.fact_sales.groupBy("car_dim_id", "origin_dim_id").agg(F.sum("units_sold").alias("u"),
                                                                      F.count(F.lit(1)).alias("n"))
    j = (per.join(star.dim_car.select("car_dim_id", "retail_price"), "car_dim_id")
         .join(star.dim_car_origin.select(F.col("origin_id").alias("origin_dim_id"), "country"), "origin_dim_id"))
    agg = j.groupBy("country").agg(
        F.sum("u").cast("bigint").alias("total_units_sold"),
        F.sum(F.col("retail_price") * F.col("n")).alias("total_price"),
        F.sum("n").alias("n"))
    return agg.select("country", "total_units_sold",
                      exact_avg("total_price", "n", 2).alias("average_retail_price")) \
        .orderBy(F.col("total_units_sold").desc_nulls_first())


def pivot_category(star: Star, categories=PIVOT_CATEGORIES) -> DataFrame:
    """Target market x category: two sums per listed category.  Unlisted and NULL
    categories are ignored but their target market keeps its (NULL) row."""
    per_car = star.fact_sales.groupBy("car_dim_id").agg(F.sum("units_sold").alias("u"),
                                                         F.sum("sell_price").alias("s"))
    j = per_car.join(star.dim_car.select("car_dim_id", "target_market", "market_category"), "car_dim_id")
    p = j.groupBy("target_market").pivot("market_category", list(categories)) \
        .agg(F.sum("u").alias("units"), F.sum("s").alias("sales"))
    cols = [F.col("target_market")]
    for c in categories:
        cols.append(F.col(f"{c}_units").cast("bigint").alias(f"{c.lower()}_units"))
        cols.append(_d(f"{c}_sales").alias(f"{c.lower()}_sales"))
    return p.select(*cols).orderBy(F.col("target_market").asc_nulls_last())


def report_category_age_share(star: Star) -> DataFrame:
    per = star.fact_sales.groupBy("car_dim_id", "cust_dim_id").agg(F.sum("sell_price").alias("s"))
    j = (per.join(star.dim_car.select("car_dim_id", "market_category").where(F.col("market_category").isNotNull()),
                  "car_dim_id")
         .join(star.dim_customer_data.select("cust_dim_id", "age_bucket"), "cust_dim_id")
         .groupBy("market_category", "age_bucket").agg(F.sum("s").alias("total_sales")))
    total = F.sum("total_sales").over(Window.partitionBy("market_category"))
    share = F.when(total != 0, _d("total_sales") / _d(total) * F.lit(100.0))
    return j.select("market_category", "age_bucket", _d("total_sales").alias("total_sales"),
                    F.round(share, 2).alias("percent_of_category_sales")) \
        .orderBy("market_category", "age_bucket")


def report_discount_trend(star: Star, categories=LUXURY_CATEGORIES) -> DataFrame:
    cars = star.dim_car.where(F.col("market_category").isin(*categories)).select("car_dim_id", "retail_price")
    per = star.fact_sales.groupBy("car_dim_id", "time_dim_id").agg(
        F.sum("discount_amount").alias("d"), F.count(F.lit(1)).alias("n"))
    j = per.join(cars, "car_dim_id").join(
        star.dim_time.select(F.col("time_id").alias("time_dim_id"), "year", "month_number", "month_name"),
        "time_dim_id")
    monthly = j.groupBy("year", "month_number", "month_name").agg(
        F.sum("d").alias("sd"), F.sum(F.col("retail_price") * F.col("n")).alias("sr"))
    monthly = monthly.withColumn("avg_discount_percent", _d("sd") / _d("sr") * F.lit(100.0))
    prev = F.lag("avg_discount_percent", 1).over(Window.orderBy("year", "month_number"))
    t = monthly.withColumn("prev", prev)
    return t.select("year", "month_name", F.round("avg_discount_percent", 2).alias("avg_discount_percent"),
                    F.round("prev", 2).alias("previous_month_avg_discount"),
                    F.round(pct_change("avg_discount_percent", "prev"), 2).alias("discount_trend_percent_change"),
                    "month_number").orderBy("year", "month_number").drop("month_number")


def report_growth_quintile(star: Star, years=PIVOT_YEARS) -> DataFrame:
    y0, y1 = years
    # the fact is partitioned by sale year: the filter prunes partitions at the scan
    per = (star.fact_sales.where(F.col("sale_year").isin(y0, y1))
           .groupBy("car_dim_id", F.col("sale_year").alias("year")).agg(F.sum("units_sold").alias("u")))
    j = per.join(star.dim_car.select("car_dim_id", "make", "model", F.col("year").alias("car_model_year")),
                 "car_dim_id")
    p = j.groupBy("make", "model", "car_model_year").pivot("year", [y0, y1]).agg(F.sum("u"))
    g = p.select("make", "model", "car_model_year",
                 F.coalesce(F.col(str(y0)), F.lit(0)).cast("bigint").alias("u0"),
                 F.coalesce(F.col(str(y1)), F.lit(0)).cast("bigint").alias("u1"))
    g = g.where(F.col("u0") > 0).withColumn("growth", (F.col("u1") - F.col("u0")) / F.col("u0") * F.lit(100.0))
    q = global_ntile(g, [F.col("growth").desc_nulls_last(), F.col("make").asc(), F.col("model").asc(),
                         F.col("car_model_year").asc()], 5, name="growth_percentile")
    return q.select("make", "model", F.col("car_model_year").cast("bigint").alias("car_model_year"),
                    F.col("u1").alias(f"units_{y1}"), F.round("growth", 2).alias("percent_growth"),
                    "growth_percentile") \
        .orderBy("growth_percentile", F.col("percent_growth").desc_nulls_first(), "make", "model")
