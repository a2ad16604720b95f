"""Adapters from the studies' original input files to the schemas the library uses.

The registered queries read stand-ins derived from the parquet test tables; these
functions let the same plans run on the original files (FIXTURES.md section A).
Dirty text columns are read as strings and typed leniently downstream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import round_to_day, title_year
from ..session import materialize
from .readers import read_delimited

RATINGS_SCHEMA = T.StructType([T.StructField("userid", T.LongType()), T.StructField("movieid", T.LongType()),
                               T.StructField("rating", T.DoubleType()), T.StructField("ts", T.LongType())])
MOVIES_SCHEMA = T.StructType([T.StructField("movieid", T.LongType()), T.StructField("title", T.StringType()),
                              T.StructField("genres", T.StringType())])

# Header of the delivery-time CSV and the names the cleaning job uses.
DELIVERY_COLUMNS = [
    ("ID", "id", "string"), ("Delivery_person_ID", "delivery_person_id", "string"),
    ("Delivery_person_Age", "delivery_person_age", "int"), ("Delivery_person_Ratings", "delivery_person_ratings", "double"),
    ("Restaurant_latitude", "restaurant_latitude", "double"), ("Restaurant_longitude", "restaurant_longitude", "double"),
    ("Delivery_location_latitude", "delivery_loc_latitude", "double"),
    ("Delivery_location_longitude", "delivery_loc_longitude", "double"),
    ("Type_of_order", "order_type", "string"), ("Type_of_vehicle", "vehicle_type", "string"),
    ("temperature", "temperature", "double"), ("humidity", "humidity", "double"),
    ("precipitation", "precipitation", "double"), ("weather_description", "weather_type", "string"),
    ("X", "x", "string"), ("Traffic_Level", "traffic_level", "string"),
    ("Distance (km)", "distance_raw", "string"), ("TARGET", "target_raw", "string"),
]


def read_ratings_files(spark: SparkSession, ratings_path: str, movies_path: str) -> DataFrame:
    """ratings.dat and movies.dat ('::'-separated) -> the working set of the bias model
    (userid, movieid, rating, rated_at, title, genres, day, year_publication)."""
    r = read_delimited(spark, ratings_path, RATINGS_SCHEMA, "::")
    m = read_delimited(spark, movies_path, MOVIES_SCHEMA, "::")
    ml = r.join(m, "movieid", "left").withColumn("rated_at", F.timestamp_seconds("ts"))
    return ml.select("userid", "movieid", "rating", "rated_at", "title", "genres",
                     round_to_day("rated_at").alias("day"), title_year("title").alias("year_publication"))


def read_deliveries_csv(spark: SparkSession, path: str) -> DataFrame:
    """The delivery-time CSV with its header -> the raw table of the cleaning job.  Every
    field is read as text and typed leniently, so a stray value never fails the read;
    ``row_id`` numbers the rows once (the table is written, so the ids stay fixed)."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    cols = []
    for src, dst, typ in DELIVERY_COLUMNS:
        c = F.col(f"`{src}`")
        cols.append((c if typ == "string" else F.expr(f"try_cast(nullif(trim(`{src}`), '') AS {typ})")).alias(dst))
    typed = raw.select(*cols).withColumn("row_id", F.monotonically_increasing_id())
    return materialize(typed, "deliveries-csv")
