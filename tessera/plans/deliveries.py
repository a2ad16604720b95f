"""Delivery-time study: the cleaning pipeline over the raw delivery table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import cleaning as C
from ..sources.fixtures import fixture

COORDS = ("restaurant_latitude", "restaurant_longitude", "delivery_loc_latitude", "delivery_loc_longitude")


def typed_deliveries(raw: DataFrame) -> DataFrame:
    """Dirty text columns to numbers; unreadable values become NULL."""
    return C.lenient_columns(raw, {"distance_raw": "distance", "target_raw": "delivery_time_min"})


def clean_deliveries(raw: DataFrame) -> DataFrame:
    """Drop rows missing both distance and time, impute missing distances from the
    coordinates, drop rows without a time, drop the empty column, round coordinates."""
    t = typed_deliveries(raw)
    t = C.drop_both_missing(t, "distance", "delivery_time_min")
    t = C.impute_haversine(t, "distance", *COORDS)
    t = C.drop_missing(t, ["delivery_time_min"]).drop("distance_raw", "target_raw", "x")
    return C.round_columns(t, COORDS, 4)


def deliveries_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "deliveries_raw")


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_deliveries(deliveries_raw(spark, sf_dir))
