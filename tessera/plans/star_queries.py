"""Registered queries over the car-sales star schema (load, audits, the 11 reports)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.fixtures import PIVOT_YEARS
from . import reports as R
from .registry import register
from .star_sql import PER_BRAND, PER_CATEGORY_AGE, PER_DISTRIBUTOR, per_discount, star_sql
from .warehouse import load_star

CATS = R.PIVOT_CATEGORIES
LUX = "'PROMO', 'LARGE'"
Y0, Y1 = PIVOT_YEARS


def _star(spark, sf_dir):
    return load_star(spark, sf_dir)


@register("report_top3_distributors", star_sql("""
SELECT a.state, a.distributor_name, CAST(a.sales AS DOUBLE) AS total_sales, CAST(a.units AS BIGINT) AS total_units,
       CAST(1 + COUNT(b.sales) AS BIGINT) AS distributor_rank
FROM per_distributor a LEFT JOIN per_distributor b ON b.state IS NOT DISTINCT FROM a.state AND b.sales > a.sales
GROUP BY ALL HAVING COUNT(b.sales) < 3""", [PER_DISTRIBUTOR]))
def q_top3(spark, sf_dir):
    return R.report_top3_distributors(_star(spark, sf_dir))


@register("report_brand_share", star_sql("""
SELECT p.year, p.make, CAST(p.sales AS DOUBLE) AS total_brand_sales,
       ROUND(CAST(p.sales AS DOUBLE) / CAST(NULLIF(t.sales, 0) AS DOUBLE) * 100.0, 2) AS percent_of_year_sales
FROM per_brand p JOIN (SELECT year, SUM(sales) AS sales FROM per_brand GROUP BY year) t USING (year)""", [PER_BRAND]))
def q_brand_share(spark, sf_dir):
    return R.report_brand_share(_star(spark, sf_dir))


@register("report_mom_change", star_sql("""
SELECT year, month_name, month_number, CAST(total_month_sales AS DOUBLE) AS total_month_sales,
       CAST(prev AS DOUBLE) AS previous_month_sales,
       ROUND(CASE WHEN prev IS NOT NULL AND prev <> 0
                  THEN CAST(total_month_sales - prev AS DOUBLE) / CAST(prev AS DOUBLE) * 100.0 END, 2) AS percentage_change
FROM (SELECT *, LAG(total_month_sales, 1) OVER (ORDER BY year, month_number) AS prev FROM monthly_sales) t"""))
def q_mom(spark, sf_dir):
    return R.report_mom_change(_star(spark, sf_dir))


@register("report_moving_avg", star_sql("""
SELECT year, month_name, month_number, CAST(total_month_sales AS DOUBLE) AS total_month_sales,
       CAST((2 * CAST(SUM(total_month_sales) OVER w * 10000 AS HUGEINT) + 100 * COUNT(*) OVER w)
            // (200 * COUNT(*) OVER w) AS DOUBLE) / 100.0 AS centered_3_month_moving_avg
FROM monthly_sales
WINDOW w AS (ORDER BY year, month_number ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"""))
def q_moving_avg(spark, sf_dir):
    return R.report_moving_avg(_star(spark, sf_dir))


@register("report_yoy_change", star_sql("""
SELECT year, month_name, CAST(total_month_sales AS DOUBLE) AS total_month_sales, CAST(prev AS DOUBLE) AS previous_year_sales,
       CAST(ABS(total_month_sales - prev) AS DOUBLE) AS absolute_difference
FROM (SELECT *, LAG(total_month_sales, 1) OVER (PARTITION BY month_number ORDER BY year) AS prev FROM monthly_sales) t"""))
def q_yoy(spark, sf_dir):
    return R.report_yoy_change(_star(spark, sf_dir))


@register("report_cumulative", star_sql("""
SELECT year, month_name, CAST(total_month_sales AS DOUBLE) AS total_month_sales,
       CAST(SUM(total_month_sales) OVER (PARTITION BY year ORDER BY month_number
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS cumulative_sales_by_year
FROM monthly_sales"""))
def q_cumulative(spark, sf_dir):
    return R.report_cumulative(_star(spark, sf_dir))


@register("report_country_units", star_sql("""
SELECT country, CAST(SUM(units) AS BIGINT) AS total_units_sold,
       CAST((2 * CAST(SUM(price) * 10000 AS HUGEINT) + 100 * COUNT(*)) // (200 * COUNT(*)) AS DOUBLE) / 100.0
         AS average_retail_price
FROM (SELECT g.country, f.units_sold AS units, c.retail_price AS price FROM dim_car_origin g, dim_car c, fact_sales f
      WHERE f.origin_dim_id = g.origin_id AND f.car_dim_id = c.car_dim_id)
GROUP BY country"""))
def q_country_units(spark, sf_dir):
    return R.report_country_units(_star(spark, sf_dir))


#: units and sales of every category in every market
MARKET_CELLS = ("cells", """
SELECT target_market AS market, market_category AS category, CAST(SUM(units_sold) AS BIGINT) AS units, CAST(SUM(sell_price) AS DOUBLE) AS sales
FROM dim_car NATURAL JOIN fact_sales GROUP BY ALL""")


def _cell(category: str, measure: str) -> str:
    return f"(SELECT {measure} FROM cells x WHERE x.market = m.market AND x.category = '{category}') AS {category.lower()}_{measure}"


@register("pivot_category", star_sql(
    "SELECT market AS target_market, " + ", ".join(_cell(c, v) for c in CATS for v in ("units", "sales"))
    + " FROM (SELECT DISTINCT market FROM cells) m", [MARKET_CELLS]))
def q_pivot_category(spark, sf_dir):
    return R.pivot_category(_star(spark, sf_dir))


@register("report_category_age_share", star_sql("""
SELECT p.market_category, p.age_bucket, CAST(p.sales AS DOUBLE) AS total_sales,
       ROUND(CAST(p.sales AS DOUBLE) / CAST(NULLIF(t.sales, 0) AS DOUBLE) * 100.0, 2) AS percent_of_category_sales
FROM per_category_age p JOIN (SELECT market_category, SUM(sales) AS sales FROM per_category_age GROUP BY ALL) t
USING (market_category)""", [PER_CATEGORY_AGE]))
def q_category_age_share(spark, sf_dir):
    return R.report_category_age_share(_star(spark, sf_dir))


@register("report_discount_trend", star_sql("""
SELECT year, month_name, ROUND(pct, 2) AS avg_discount_percent, ROUND(earlier, 2) AS previous_month_avg_discount,
       ROUND((pct - earlier) / NULLIF(earlier, 0) * 100.0, 2) AS discount_trend_percent_change
FROM (SELECT *, LAG(pct) OVER (ORDER BY month_start) AS earlier FROM per_discount)""", [per_discount(LUX)]))
def q_discount_trend(spark, sf_dir):
    return R.report_discount_trend(_star(spark, sf_dir))


#: units of every car in each year it was sold in; growth of those sold in the first year; their place, best growth first
GROWTH = [
    ("yearly", """
SELECT make, model, c.year AS built, m.year AS sold, SUM(units_sold) AS units
FROM dim_time m, dim_car c, fact_sales f WHERE m.time_id = f.time_dim_id AND c.car_dim_id = f.car_dim_id GROUP BY ALL"""),
    ("grown", f"""
SELECT a.make, a.model, a.built, COALESCE(b.units, 0) AS now, (COALESCE(b.units, 0) - a.units) / a.units * 100.0 AS growth
FROM (FROM yearly WHERE sold = {Y0} AND units > 0) a LEFT JOIN (FROM yearly WHERE sold = {Y1}) b USING (make, model, built)"""),
    ("placed", "SELECT *, COUNT(*) OVER () AS n, row_number() OVER (ORDER BY growth DESC, make, model, built) - 1 AS place FROM grown"),
]


@register("report_growth_quintile", star_sql(f"""
SELECT make, model, CAST(built AS BIGINT) AS car_model_year, CAST(now AS BIGINT) AS units_{Y1}, ROUND(growth, 2) AS percent_growth,
       CAST(CASE WHEN place < n % 5 * (n // 5 + 1) THEN place // (n // 5 + 1) ELSE (place - n % 5) // (n // 5) END + 1 AS BIGINT) AS growth_percentile
FROM placed""", GROWTH))
def q_growth_quintile(spark, sf_dir):
    return R.report_growth_quintile(_star(spark, sf_dir))


@register("fact_sales", star_sql("""
SELECT car_dim_id, dist_dim_id, cust_dim_id, time_dim_id, origin_dim_id, CAST(units_sold AS BIGINT) AS units_sold,
       CAST(sell_price AS DOUBLE) AS sell_price, CAST(discount_amount AS DOUBLE) AS discount_amount
FROM fact_sales"""))
def q_fact_sales(spark, sf_dir):
    f = _star(spark, sf_dir).fact_sales
    return f.select("car_dim_id", "dist_dim_id", "cust_dim_id", "time_dim_id", "origin_dim_id",
                    F.col("units_sold").cast("bigint").alias("units_sold"),
                    F.col("sell_price").cast("double").alias("sell_price"),
                    F.col("discount_amount").cast("double").alias("discount_amount"))


# ---- load, keys, audits ------------------------------------------------------------------

from ..functions.scalar import age_bucket as _age_bucket  # noqa: E402
from ..functions.scalar import age_years as _age_years  # noqa: E402
from ..operators.joins import fanout_audit, fk_audit  # noqa: E402
from ..sources.fixtures import AS_OF, fixture  # noqa: E402
from ..sources.tables import read_table  # noqa: E402
from .star_sql import STAR_FIXTURES  # noqa: E402,F401

STAR_TABLES = ["dim_car", "dim_car_origin", "dim_distributor", "dim_time", "customer_prep", "dim_customer_data",
               "fact_sales"]


@register("dim_car", star_sql("""
SELECT car_dim_id, make, model, CAST(year AS INTEGER) AS year, market_category, target_market, vehicle_style, vehicle_size, driven_wheels,
       number_of_doors, fuel_type, transmission_type, CAST(retail_price AS DOUBLE) AS retail_price, car_id FROM dim_car"""))
def q_dim_car(spark, sf_dir):
    """The car dimension with all of its attributes."""
    return _star(spark, sf_dir).dim_car.withColumn("retail_price", F.col("retail_price").cast("double"))


@register("load_star", star_sql(" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, CAST(COUNT(*) AS BIGINT) AS n_rows FROM {t}" for t in STAR_TABLES)))
def q_load_star(spark, sf_dir):
    """Row count of every table written by the load (read back from storage)."""
    star = _star(spark, sf_dir)
    out = None
    for t in STAR_TABLES:
        one = getattr(star, t).agg(F.count(F.lit(1)).cast("bigint").alias("n_rows")) \
            .select(F.lit(t).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


@register("dim_time", star_sql("""
SELECT time_id, month_name, month_number, quarter_name, quarter_number, year FROM dim_time"""))
def q_dim_time(spark, sf_dir):
    return _star(spark, sf_dir).dim_time.select("time_id", "month_name", "month_number", "quarter_name",
                                                "quarter_number", "year")


@register("salary_quintile", star_sql("""
SELECT customer_id, gender, educational_level, age_bucket, CAST(salary_range AS BIGINT) AS salary_range FROM customer_prep"""))
def q_salary_quintile(spark, sf_dir):
    return _star(spark, sf_dir).customer_prep.select("customer_id", "gender", "educational_level", "age_bucket",
                                                     "salary_range")


@register("surrogate_key", star_sql("SELECT origin_id, make, country, region FROM dim_car_origin"))
def q_surrogate_key(spark, sf_dir):
    return _star(spark, sf_dir).dim_car_origin.select("origin_id", "make", "country", "region")


@register("join_inner", star_sql("""
SELECT dist_dim_id, distributor_name, city, state, region, distributor_id FROM dim_distributor"""))
def q_join_inner(spark, sf_dir):
    return _star(spark, sf_dir).dim_distributor.select("dist_dim_id", "distributor_name", "city", "state", "region",
                                                       "distributor_id")


@register("join_expr_key", star_sql("""
SELECT dt.time_id, CAST(COUNT(*) AS BIGINT) AS n_sales, CAST(SUM(so.sell_price) AS DOUBLE) AS sales
FROM sell_orders_data so JOIN dim_time dt ON dt.year = year(so.sell_date) AND dt.month_number = month(so.sell_date)
GROUP BY dt.time_id"""))
def q_join_expr_key(spark, sf_dir):
    """Sales matched to the month dimension on expressions of the sale date."""
    star = _star(spark, sf_dir)
    per_date = star.sell_orders.groupBy("sell_date").agg(F.count(F.lit(1)).alias("n"), F.sum("sell_price").alias("s"))
    tm = star.dim_time.select("time_id", "year", "month_number")
    j = per_date.join(tm, (F.year("sell_date") == tm["year"]) & (F.month("sell_date") == tm["month_number"]))
    return j.groupBy("time_id").agg(F.sum("n").cast("bigint").alias("n_sales"), F.sum("s").cast("double").alias("sales"))


@register("join_profile_key", star_sql("""
SELECT csd.customer_id, dcu.cust_dim_id FROM customer_prep csd JOIN dim_customer_data dcu
ON dcu.gender = csd.gender AND dcu.educational_level = csd.educational_level AND dcu.age_bucket = csd.age_bucket
   AND dcu.salary_range = csd.salary_range"""))
def q_join_profile_key(spark, sf_dir):
    star = _star(spark, sf_dir)
    keys = ["gender", "educational_level", "age_bucket", "salary_range"]
    return star.customer_prep.join(star.dim_customer_data, keys).select("customer_id", "cust_dim_id")


@register("join_fanout_audit", star_sql("""
SELECT l.make, l.left_rows, CAST(COALESCE(r.right_matches, 0) AS BIGINT) AS right_matches,
       CAST(l.left_rows * COALESCE(r.right_matches, 0) AS BIGINT) AS joined_rows
FROM (SELECT dc.make, CAST(COUNT(*) AS BIGINT) AS left_rows FROM sell_orders_data so JOIN dim_car dc ON so.car_id = dc.car_id
      GROUP BY dc.make) l
LEFT JOIN (SELECT make, COUNT(*) AS right_matches FROM dim_car_origin GROUP BY make) r ON l.make = r.make"""))
def q_join_fanout_audit(spark, sf_dir):
    star = _star(spark, sf_dir)
    so = star.sell_orders.join(star.dim_car.select("car_id", "make"), "car_id")
    return fanout_audit(so.select("make"), star.dim_car_origin.select("make"), "make") \
        .withColumn("left_rows", F.col("left_rows").cast("bigint"))


@register("fk_audit", star_sql("""
SELECT 'car_id' AS fk_column, CAST(COUNT(*) AS BIGINT) AS orphan_rows, CAST(COUNT(DISTINCT car_id) AS BIGINT) AS orphan_keys
FROM sell_orders_data WHERE car_id NOT IN (SELECT car_id FROM dim_car)
UNION ALL
SELECT 'distributor_id', CAST(COUNT(*) AS BIGINT), CAST(COUNT(DISTINCT distributor_id) AS BIGINT)
FROM sell_orders_data WHERE distributor_id NOT IN (SELECT distributor_id FROM dim_distributor)
UNION ALL
SELECT 'customer_id', CAST(COUNT(*) AS BIGINT), CAST(COUNT(DISTINCT customer_id) AS BIGINT)
FROM sell_orders_data WHERE customer_id NOT IN (SELECT customer_id FROM customer_prep)"""))
def q_fk_audit(spark, sf_dir):
    """Sales whose keys have no dimension row (the inner-join load drops them silently)."""
    star = _star(spark, sf_dir)
    so = star.sell_orders
    parts = [fk_audit(so, "car_id", star.dim_car, "car_id"),
             fk_audit(so, "distributor_id", star.dim_distributor, "distributor_id"),
             fk_audit(so, "customer_id", star.customer_prep, "customer_id")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("fk_column", F.col("orphan_rows").cast("bigint"), F.col("orphan_keys").cast("bigint"))


@register("load_reconcile", star_sql("""
SELECT 'dim_car' AS table_name, (SELECT CAST(COUNT(*) AS BIGINT) FROM cars) AS source_rows,
       (SELECT CAST(COUNT(*) AS BIGINT) FROM dim_car) AS target_rows, (SELECT MIN(car_dim_id) FROM dim_car) AS min_key
UNION ALL
SELECT 'dim_car_origin', (SELECT CAST(COUNT(*) AS BIGINT) FROM car_make_country),
       (SELECT CAST(COUNT(*) AS BIGINT) FROM dim_car_origin), (SELECT MIN(origin_id) FROM dim_car_origin)"""))
def q_load_reconcile(spark, sf_dir):
    star = _star(spark, sf_dir)

    def one(name, src, tgt, key):
        # both counts in one aggregate over the union of the two sides
        both = src.select(F.lit("s").alias("side"), F.lit(None).cast("bigint").alias("k")) \
            .unionByName(tgt.select(F.lit("t").alias("side"), F.col(key).cast("bigint").alias("k")))
        return both.agg(F.sum((F.col("side") == "s").cast("bigint")).alias("source_rows"),
                        F.sum((F.col("side") == "t").cast("bigint")).alias("target_rows"),
                        F.min("k").alias("min_key")) \
            .select(F.lit(name).alias("table_name"), "source_rows", "target_rows", "min_key")

    return one("dim_car", fixture(spark, sf_dir, "cars"), star.dim_car, "car_dim_id").unionByName(
        one("dim_car_origin", fixture(spark, sf_dir, "car_make_country"), star.dim_car_origin, "origin_id"))


@register("scan_table", "SELECT * FROM nation")
def q_scan_table(spark, sf_dir):
    return read_table(spark, sf_dir, "nation")


@register("conform_schema", star_sql("""
SELECT CAST(id AS BIGINT) AS id, make, model, CAST(year AS BIGINT) AS year, market_category, target_market,
       CAST(retail_price AS DOUBLE) AS retail_price FROM cars"""))
def q_conform_schema(spark, sf_dir):
    """Cast the source to the declared target schema (names, order, types) with ``DataFrame.to``."""
    from pyspark.sql import types as T
    target = T.StructType([T.StructField("id", T.LongType()), T.StructField("make", T.StringType()),
                           T.StructField("model", T.StringType()), T.StructField("year", T.LongType()),
                           T.StructField("market_category", T.StringType()), T.StructField("target_market", T.StringType()),
                           T.StructField("retail_price", T.DoubleType())])
    return fixture(spark, sf_dir, "cars").to(target)


AGE_SQL = ("2024 - year(birthday) - CASE WHEN month(birthday) > 1 OR (month(birthday) = 1 AND day(birthday) > 1) "
           "THEN 1 ELSE 0 END")


@register("age_years", star_sql(f"SELECT id, CAST({AGE_SQL} AS BIGINT) AS age_years FROM customers_data"))
def q_age_years(spark, sf_dir):
    return fixture(spark, sf_dir, "customers_data").select("id", _age_years("birthday", AS_OF).alias("age_years"))


@register("age_bucket", star_sql(f"""
SELECT id, CASE WHEN a < 25 THEN 'Under 25' WHEN a BETWEEN 25 AND 40 THEN '25-40' ELSE 'Over 40' END AS age_bucket
FROM (SELECT id, {AGE_SQL} AS a FROM customers_data) t"""))
def q_age_bucket(spark, sf_dir):
    return fixture(spark, sf_dir, "customers_data").select("id", _age_bucket("birthday", AS_OF).alias("age_bucket"))


@register("filter_between", star_sql(f"""
SELECT id, CAST({AGE_SQL} AS BIGINT) AS age_years FROM customers_data WHERE {AGE_SQL} BETWEEN 25 AND 40"""))
def q_filter_between(spark, sf_dir):
    c = fixture(spark, sf_dir, "customers_data").select("id", _age_years("birthday", AS_OF).alias("age_years"))
    return c.where(F.col("age_years").between(25, 40))


@register("agg_sum_multi_key", star_sql("""
SELECT state, distributor_name, CAST(sales AS DOUBLE) AS total_sales, CAST(units AS BIGINT) AS total_units
FROM per_distributor""", [PER_DISTRIBUTOR]))
def q_agg_sum_multi_key(spark, sf_dir):
    star = _star(spark, sf_dir)
    per = star.fact_sales.groupBy("dist_dim_id").agg(F.sum("sell_price").alias("s"), F.sum("units_sold").alias("u"))
    j = per.join(star.dim_distributor.select("dist_dim_id", "state", "distributor_name"), "dist_dim_id")
    return j.groupBy("state", "distributor_name").agg(F.sum("s").cast("double").alias("total_sales"),
                                                      F.sum("u").cast("bigint").alias("total_units"))


@register("agg_ratio_of_sums", star_sql("""
SELECT dc.target_market,
       round(CAST(SUM(fs.discount_amount) AS DOUBLE) / CAST(SUM(dc.retail_price) AS DOUBLE) * 100.0, 4) AS discount_percent
FROM fact_sales fs JOIN dim_car dc ON fs.car_dim_id = dc.car_dim_id GROUP BY dc.target_market"""))
def q_agg_ratio_of_sums(spark, sf_dir):
    """Weighted discount: sum of discounts over sum of list prices, not a mean of ratios."""
    star = _star(spark, sf_dir)
    per = star.fact_sales.groupBy("car_dim_id").agg(F.sum("discount_amount").alias("d"), F.count(F.lit(1)).alias("n"))
    j = per.join(star.dim_car.select("car_dim_id", "target_market", "retail_price"), "car_dim_id")
    g = j.groupBy("target_market").agg(F.sum("d").alias("sd"), F.sum(F.col("retail_price") * F.col("n")).alias("sr"))
    return g.select("target_market", F.round(F.col("sd").cast("double") / F.col("sr").cast("double") * F.lit(100.0), 4)
                    .alias("discount_percent"))


@register("pivot_years", star_sql(f"""
SELECT dc.make, dc.model, CAST(dc.year AS BIGINT) AS car_model_year,
       CAST(SUM(CASE WHEN dt.year = {Y0} THEN fs.units_sold END) AS BIGINT) AS units_{Y0},
       CAST(SUM(CASE WHEN dt.year = {Y1} THEN fs.units_sold END) AS BIGINT) AS units_{Y1}
FROM fact_sales fs JOIN dim_car dc ON fs.car_dim_id = dc.car_dim_id JOIN dim_time dt ON fs.time_dim_id = dt.time_id
WHERE dt.year IN ({Y0}, {Y1})
GROUP BY dc.make, dc.model, dc.year"""))
def q_pivot_years(spark, sf_dir):
    star = _star(spark, sf_dir)
    per = (star.fact_sales.where(F.col("sale_year").isin(Y0, Y1))  # partition pruning
           .groupBy("car_dim_id", F.col("sale_year").alias("year")).agg(F.sum("units_sold").alias("u")))
    j = per.join(star.dim_car.select("car_dim_id", "make", "model", F.col("year").alias("car_model_year")), "car_dim_id")
    p = j.groupBy("make", "model", "car_model_year").pivot("year", [Y0, Y1]).agg(F.sum("u"))
    return p.select("make", "model", F.col("car_model_year").cast("bigint").alias("car_model_year"),
                    F.col(str(Y0)).cast("bigint").alias(f"units_{Y0}"), F.col(str(Y1)).cast("bigint").alias(f"units_{Y1}"))


@register("sort_nulls", star_sql("""
SELECT id, market_category,
       CAST(row_number() OVER (ORDER BY market_category DESC NULLS FIRST, id) AS BIGINT) AS sort_position
FROM cars"""))
def q_sort_nulls(spark, sf_dir):
    """Oracle-style descending order (NULLs first) made visible as a position column."""
    from ..operators.windows import global_row_number
    cars = fixture(spark, sf_dir, "cars").select("id", "market_category")
    return global_row_number(cars, [F.col("market_category").desc_nulls_first(), F.col("id").asc()],
                             name="sort_position")


@register("filter_in", star_sql(f"""
SELECT car_dim_id, market_category FROM dim_car WHERE market_category IN ({LUX})"""))
def q_filter_in(spark, sf_dir):
    from ..sources.fixtures import LUXURY_CATEGORIES
    return _star(spark, sf_dir).dim_car.where(F.col("market_category").isin(*LUXURY_CATEGORIES)) \
        .select("car_dim_id", "market_category")


@register("distinct_rows", star_sql("SELECT DISTINCT make, country, region FROM car_make_country"))
def q_distinct_rows(spark, sf_dir):
    return fixture(spark, sf_dir, "car_make_country").select("make", "country", "region").distinct()
