"""Car-sales star schema: five dimensions and one fact table.

The load mirrors INSERT-SELECT + COMMIT: each table is written once (a
Spark job commit is all-or-nothing per table) and read back, so reports and
later stages cut lineage at the table boundary instead of re-running the
five-way join.  Tables live below ``spark.checkpoint.dir`` (shared storage
on a cluster), so a lost executor only re-runs its own tasks.
"""

from __future__ import annotations

import hashlib
import threading
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalar import age_bucket, month_start
from ..operators.windows import global_ntile, surrogate_key
from ..session import cache, folder_state, scratch_path, write_read
from ..sources.fixtures import AS_OF, fixture


@dataclass(frozen=True)
class Star:
    dim_car: DataFrame
    dim_car_origin: DataFrame
    dim_distributor: DataFrame
    dim_time: DataFrame
    customer_prep: DataFrame
    dim_customer_data: DataFrame
    fact_sales: DataFrame
    sell_orders: DataFrame  # the written source rows of the fact


def _asc(*cols):
    return [F.col(c).asc_nulls_last() for c in cols]


# The target tables as they are declared: names, order and types of the columns.
SCHEMAS = {
    "dim_car": "car_dim_id bigint, make string, model string, year int, market_category string, target_market string, "
               "vehicle_style string, vehicle_size string, driven_wheels string, number_of_doors string, fuel_type string, "
               "transmission_type string, retail_price decimal(12,2), car_id bigint",
    "dim_car_origin": "origin_id bigint, make string, country string, region string",
    "dim_distributor": "dist_dim_id bigint, distributor_name string, city string, state string, region string, distributor_id bigint",
    "dim_time": "time_id bigint, month_start date, month_name string, month_number bigint, quarter_name string, quarter_number bigint, year bigint",
    "dim_customer_data": "cust_dim_id bigint, gender string, educational_level string, age_bucket string, salary_range bigint",
    "fact_sales": "car_dim_id bigint, dist_dim_id bigint, cust_dim_id bigint, time_dim_id bigint, origin_dim_id bigint, units_sold int, "
                  "sell_price decimal(18,4), discount_amount decimal(19,4), sale_year bigint",
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """``df`` in the declared schema of a target table; a missing column or a type that does not fit is an error."""
    return df.to(StructType.fromDDL(SCHEMAS[table]))


# ---- dimension builders (pure DataFrame -> DataFrame) ---------------------------------

def build_dim_car(cars: DataFrame) -> DataFrame:
    base = cars.select("make", "model", "year", "market_category", "target_market", "vehicle_style", "vehicle_size", "driven_wheels",
                       F.col("number_of_doors_n").alias("number_of_doors"), "fuel_type", "transmission_type", "retail_price",
                       F.col("id").alias("car_id"))
    return surrogate_key(base, _asc("car_id"), "car_dim_id")


def build_dim_car_origin(make_country: DataFrame) -> DataFrame:
    base = make_country.select("make", "country", "region").distinct()
    return surrogate_key(base, _asc("make", "country", "region"), "origin_id")


def build_dim_distributor(distributors: DataFrame, dist_region: DataFrame) -> DataFrame:
    base = distributors.join(dist_region, "state").select(
        F.col("company_name").alias("distributor_name"), "city", "state", "region",
        F.col("id").alias("distributor_id"))
    return surrogate_key(base, _asc("distributor_id", "region"), "dist_dim_id")


def build_dim_time(sell_orders: DataFrame) -> DataFrame:
    months = sell_orders.select(month_start("sell_date").alias("month_start")).distinct()
    base = months.select(
        "month_start",
        F.date_format("month_start", "MMMM").alias("month_name"),
        F.month("month_start").cast("bigint").alias("month_number"),
        F.concat(F.lit("Q"), F.quarter("month_start").cast("string")).alias("quarter_name"),
        F.quarter("month_start").cast("bigint").alias("quarter_number"),
        F.year("month_start").cast("bigint").alias("year"))
    return surrogate_key(base, _asc("month_start"), "time_id")


def build_customer_prep(customers: DataFrame, as_of: date = AS_OF) -> DataFrame:
    """One row per customer with the profile attributes; the salary quintile is computed
    once here and shared by the profile dimension and the fact load."""
    base = customers.select(F.col("id").alias("customer_id"), "gender", "educational_level",
                            age_bucket("birthday", as_of).alias("age_bucket"), "annual_income")
    q = global_ntile(base, [F.col("annual_income").asc_nulls_last(), F.col("customer_id").asc()], 5,
                     name="salary_range")
    return q.drop("annual_income")


def build_dim_customer_data(customer_prep: DataFrame) -> DataFrame:
    keys = ["gender", "educational_level", "age_bucket", "salary_range"]
    base = customer_prep.select(*keys).distinct()
    return surrogate_key(base, _asc(*keys), "cust_dim_id")


def build_fact_sales(sell_orders: DataFrame, dim_car: DataFrame, dim_distributor: DataFrame,
                     dim_time: DataFrame, dim_car_origin: DataFrame, customer_prep: DataFrame,
                     dim_customer_data: DataFrame) -> DataFrame:
    """Five inner joins, as the reference load: a sale without a match in any dimension is
    dropped and a MAKE with two origins is counted twice (see ``join_fanout_audit``)."""
    keys = ["gender", "educational_level", "age_bucket", "salary_range"]
    # The dimensions are written tables: the planner sizes each from its files and
    # broadcasts it below spark.sql.autoBroadcastJoinThreshold, shuffling otherwise.
    # Customer -> profile key first: the fact then meets one customer-sized table, not two.
    cust_key = customer_prep.join(dim_customer_data, keys).select("customer_id", "cust_dim_id")
    # The tables that may be too large to broadcast come first, while the sales have few columns.
    car = dim_car.select("car_dim_id", "car_id", "make", "retail_price")
    dist = dim_distributor.select("dist_dim_id", "distributor_id")
    tm = dim_time.select("time_id", F.col("year").alias("_y"), F.col("month_number").alias("_m"))
    origin = dim_car_origin.select("origin_id", "make")
    f = (sell_orders.join(cust_key, "customer_id")
         .join(car, "car_id")
         .withColumn("_y", F.year("sell_date").cast("bigint"))
         .withColumn("_m", F.month("sell_date").cast("bigint"))
         .join(dist, "distributor_id")
         .join(tm, ["_y", "_m"])
         .join(origin, "make"))
    return f.select("car_dim_id", "dist_dim_id", "cust_dim_id",
                    F.col("time_id").alias("time_dim_id"), F.col("origin_id").alias("origin_dim_id"),
                    F.lit(1).cast("int").alias("units_sold"), "sell_price",
                    (F.col("retail_price") - F.col("sell_price")).alias("discount_amount"),
                    F.col("_y").alias("sale_year"))


# ---- the load ------------------------------------------------------------------------

_LOCK = threading.Lock()
_LOADED: dict[tuple, Star] = cache()


def load_star(spark: SparkSession, sf_dir: str, as_of: date = AS_OF) -> Star:
    """Build and write the star schema once per application and input folder."""
    key = (spark.sparkContext.applicationId, sf_dir, folder_state(spark, sf_dir), as_of)
    with _LOCK:
        if key in _LOADED:
            return _LOADED[key]
        tag = hashlib.sha1(str(key).encode()).hexdigest()[:12]
        base = scratch_path(spark, f"star-{tag}")

        def fx(name):
            return fixture(spark, sf_dir, name)

        def load(df, table, **kw):
            return write_read(conform(df, table), f"{base}/{table}", **kw)

        # the sales are read more than once (months, fact, audits): their three-way source join runs once
        sell_orders = write_read(fx("sell_orders_data"), f"{base}/sell_orders")
        dim_car = load(build_dim_car(fx("cars")), "dim_car")
        dim_origin = load(build_dim_car_origin(fx("car_make_country")), "dim_car_origin")
        dim_dist = load(build_dim_distributor(fx("car_distributors"), fx("car_dist_region")), "dim_distributor")
        dim_time = load(build_dim_time(sell_orders), "dim_time")
        prep = write_read(build_customer_prep(fx("customers_data"), as_of), f"{base}/customer_prep")
        dim_cust = load(build_dim_customer_data(prep), "dim_customer_data")
        # the fact is partitioned by sale year: year-filtered reports prune partitions
        fact = load(build_fact_sales(sell_orders, dim_car, dim_dist, dim_time, dim_origin, prep, dim_cust), "fact_sales", partition_by="sale_year")
        star = Star(dim_car, dim_origin, dim_dist, dim_time, prep, dim_cust, fact, sell_orders)
        _LOADED[key] = star
        return star
