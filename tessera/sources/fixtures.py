"""Deterministic stand-ins for the study inputs, derived from the base tables.

The SQL text below is the input contract of FIXTURES.md section B.  It runs
unchanged on Spark and on DuckDB (except list indexing), so every query has an
independent oracle.  Table references are written ``{name}``: Spark binds them
to DataFrames through ``spark.sql(text, name=df)`` (no global views), the
oracle renders them as plain view names.
"""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from .tables import read_table

# Fixed values of the stand-ins (FIXTURES.md section B and D).
AS_OF = date(2024, 1, 1)
SEED = 42
PIVOT_YEARS = (1999, 2000)
LUXURY_CATEGORIES = ("PROMO", "LARGE")
CLIP_PROVINCE = "NATION_15"
COAST_PROVINCES = ("NATION_10", "NATION_15")
ANCHOR_PROVINCE_ID = 0
ANCHOR_CITY_ID = 0
DUPLICATED_DELIVERY_ID = "3000"
DELIVERY_PERSON = "DEL3"

FIXTURE_SQL: dict[str, str] = {
    "cars": """
SELECT p_partkey AS id, p_brand AS make, p_name AS model, CAST(2000 + p_partkey % 24 AS INT) AS year,
       CASE WHEN p_partkey % 41 = 0 THEN NULL ELSE p_type END AS market_category,
       'TM' || CAST(p_size % 5 AS STRING) AS target_market,
       CASE p_size % 4 WHEN 0 THEN 'Sedan' WHEN 1 THEN 'Coupe' WHEN 2 THEN 'Wagon' ELSE '4dr SUV' END AS vehicle_style,
       CASE p_size % 3 WHEN 0 THEN 'Compact' WHEN 1 THEN 'Midsize' ELSE 'Large' END AS vehicle_size,
       CASE p_partkey % 3 WHEN 0 THEN 'front wheel drive' WHEN 1 THEN 'rear wheel drive' ELSE 'all wheel drive' END AS driven_wheels,
       CASE WHEN p_partkey % 67 = 0 THEN NULL ELSE CAST(2 + p_size % 3 AS STRING) END AS number_of_doors_n,
       CASE WHEN p_partkey % 53 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN 'regular unleaded' ELSE 'diesel' END AS fuel_type,
       CASE WHEN p_partkey % 5 < 3 THEN 'AUTOMATIC' ELSE 'MANUAL' END AS transmission_type,
       CAST(p_retailprice AS DECIMAL(12,2)) AS retail_price
FROM {part}""",
    "car_make_country": """
SELECT DISTINCT p_brand AS make, n_name AS country, r_name AS region
FROM {part} JOIN {nation} ON n_nationkey = CAST(replace(p_brand, 'Brand#', '') AS INT) - 1
JOIN {region} ON r_regionkey = n_regionkey""",
    "car_distributors": """
SELECT s_suppkey AS id, s_name AS company_name, 'City' || CAST(s_suppkey % 7 AS STRING) AS city, n_name AS state
FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey""",
    "car_dist_region": """
SELECT n_name AS state, r_name AS region FROM {nation} JOIN {region} ON r_regionkey = n_regionkey""",
    "customers_data": """
SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
       c_mktsegment AS educational_level,
       DATE '1950-01-01' + CAST((c_custkey * 7919) % 20000 AS INT) AS birthday,
       CAST(c_acctbal AS DECIMAL(12,2)) AS annual_income
FROM {customer}""",
    "sell_orders_data": """
SELECT l_partkey AS car_id, l_suppkey AS distributor_id, o_custkey AS customer_id,
       CAST(o_orderdate AS DATE) AS sell_date,
       CAST(CAST(p_retailprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS sell_price
FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey JOIN {part} ON p_partkey = l_partkey""",
    "movies": """
SELECT p_partkey AS movieid,
       p_name || CASE WHEN p_partkey % 97 = 0 THEN '' ELSE ' (' || CAST(1950 + p_partkey % 60 AS STRING) || ')' END AS title,
       p_type || '|' || p_brand AS genres
FROM {part}""",
    "ratings": """
SELECT o_custkey AS userid, l_partkey AS movieid,
       CAST(0.5 * (1 + (CAST(min(l_quantity) AS INT) - 1) % 10) AS DOUBLE) AS rating,
       min(o_orderdate) + INTERVAL 13 HOURS AS rated_at
FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey GROUP BY o_custkey, l_partkey""",
    "deliveries_raw": """
SELECT CAST(o_orderkey - CASE WHEN o_orderkey % 3000 = 1 THEN 1 ELSE 0 END AS STRING) AS id, o_orderkey AS row_id,
       'DEL' || CAST(o_custkey % 200 AS STRING) AS delivery_person_id,
       CAST(15 + o_orderkey % 36 AS INT) AS delivery_person_age,
       CAST(1 + (o_orderkey % 51) / 10.0 AS DOUBLE) AS delivery_person_ratings,
       CAST(9 + (o_custkey * 31 % 4000) / 1000.0 AS DOUBLE) AS restaurant_latitude,
       CAST(74 + (o_custkey * 17 % 4000) / 1000.0 AS DOUBLE) AS restaurant_longitude,
       CAST(9 + (o_custkey * 31 % 4000) / 1000.0 + (o_orderkey % 90) / 1000.0 AS DOUBLE) AS delivery_loc_latitude,
       CAST(74 + (o_custkey * 17 % 4000) / 1000.0 + (o_orderkey % 70) / 1000.0 AS DOUBLE) AS delivery_loc_longitude,
       o_orderpriority AS order_type, o_orderstatus AS vehicle_type,
       CAST(15 + (o_orderkey * 17 % 200) / 10.0 AS DOUBLE) AS temperature,
       CAST(o_orderkey % 101 AS DOUBLE) AS humidity,
       CAST(CASE WHEN o_orderkey % 100 = 0 THEN 1.46 ELSE 0.0 END AS DOUBLE) AS precipitation,
       'W' || CAST(o_orderkey % 7 AS STRING) AS weather_type, CAST(NULL AS BOOLEAN) AS x,
       CASE o_orderkey % 5 WHEN 0 THEN 'Very Low' WHEN 1 THEN 'Low' WHEN 2 THEN 'Moderate' WHEN 3 THEN 'High' ELSE 'Very High' END AS traffic_level,
       CASE WHEN o_orderkey % 50 IN (0, 1) THEN '#VALUE!' ELSE CAST(CAST(1 + (o_orderkey * 13 % 2900) / 100.0 AS DECIMAL(10,2)) AS STRING) END AS distance_raw,
       CASE WHEN o_orderkey % 50 = 0 THEN '#VALUE!' WHEN o_orderkey % 50 = 2 THEN '' ELSE CAST(CAST(10 + (o_orderkey * 13 % 2900) / 60.0 + 4 * (o_orderkey % 5) AS DECIMAL(10,2)) AS STRING) END AS target_raw
FROM {orders}""",
    "wine": """
SELECT vec_id AS row_id,
       CAST(element_at(embedding, 1) AS DOUBLE) AS f1, CAST(element_at(embedding, 2) AS DOUBLE) AS f2,
       CAST(element_at(embedding, 3) AS DOUBLE) AS f3, CAST(element_at(embedding, 4) AS DOUBLE) AS f4,
       CAST(element_at(embedding, 5) AS DOUBLE) AS f5, CAST(element_at(embedding, 6) AS DOUBLE) AS f6,
       CAST(element_at(embedding, 7) AS DOUBLE) AS f7, CAST(element_at(embedding, 8) AS DOUBLE) AS f8,
       CAST(element_at(embedding, 9) AS DOUBLE) AS f9, CAST(element_at(embedding, 10) AS DOUBLE) AS f10,
       CAST(element_at(embedding, 11) AS DOUBLE) AS f11,
       CAST(3 + label % 6 AS INT) AS quality
FROM {embeddings}""",
    "fires": """
SELECT o_orderkey AS row_id, o_totalprice / 1000 AS brightness, c_acctbal / 100 AS radiative_power,
       CAST(o_orderkey % 100 AS DOUBLE) AS relative_humidity, CAST((o_custkey % 50) / 100.0 AS DOUBLE) AS soil_water,
       0.003 * (o_totalprice / 1000) + 0.02 * (c_acctbal / 100) - 0.01 * (o_orderkey % 100) + 1.5 * ((o_custkey % 50) / 100.0) + 2.0 AS fire_area_exact,
       0.003 * (o_totalprice / 1000) + 0.02 * (c_acctbal / 100) - 0.01 * (o_orderkey % 100) + 1.5 * ((o_custkey % 50) / 100.0) + 2.0 + ((o_orderkey * 7919) % 101 - 50) / 100.0 AS fire_area
FROM {orders} JOIN {customer} ON c_custkey = o_custkey""",
    "quakes": """
SELECT event_id AS id, CAST(-86000 + (event_id * 7919) % 4001 AS BIGINT) AS x_md, CAST(8000 + (event_id * 104729) % 4001 AS BIGINT) AS y_md,
       CAST(2 + (event_id * 31 % 61) / 10.0 AS DECIMAL(3,1)) AS magnitude, ts AS fecha
FROM {events}""",
    "provinces_bbox": """
SELECT n_nationkey AS id, n_name AS name, CAST(-86000 + 800 * (n_nationkey % 5) AS BIGINT) AS x0,
       CAST(8000 + 800 * floor(n_nationkey / 5.0) AS BIGINT) AS y0
FROM {nation} WHERE n_nationkey % 6 <> 5""",
    "cities": """
SELECT s_suppkey AS id, s_name AS nombre, CAST(-86000 + (s_suppkey * 6101) % 4001 AS BIGINT) AS x_md,
       CAST(8000 + (s_suppkey * 3571) % 4001 AS BIGINT) AS y_md
FROM {supplier}""",
}

FIXTURES = tuple(FIXTURE_SQL)
_REF = re.compile(r"\{(\w+)\}")


def tables_of(name: str) -> list[str]:
    return sorted(set(_REF.findall(FIXTURE_SQL[name])))


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One stand-in table as a lazy DataFrame over the base parquet tables."""
    text = FIXTURE_SQL[name]
    frames = {t: read_table(spark, sf_dir, t) for t in tables_of(name)}
    return spark.sql(text, **frames)


def fixture_duckdb_sql(name: str) -> str:
    """The same stand-in for the DuckDB oracle (plain view names, list indexing)."""
    text = _REF.sub(lambda m: m.group(1), FIXTURE_SQL[name])
    return re.sub(r"element_at\((\w+), (\d+)\)", r"\1[\2]", text).strip()
