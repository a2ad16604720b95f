"""Registered queries of the cleaning and profiling jobs (delivery-time study)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import guarded_ratio
from ..operators import cleaning as C
from ..operators import profile as P
from ..session import fresh_path, materialize
from .deliveries import COORDS, deliveries, deliveries_raw, typed_deliveries
from .oracle import fx, with_ctes
from .registry import register

RAW_COLS = ["id", "row_id", "delivery_person_id", "delivery_person_age", "delivery_person_ratings",
            "restaurant_latitude", "restaurant_longitude", "delivery_loc_latitude", "delivery_loc_longitude",
            "order_type", "vehicle_type", "temperature", "humidity", "precipitation", "weather_type", "x",
            "traffic_level", "distance_raw", "target_raw"]
CLEAN_COLS = ["id", "row_id", "delivery_person_id", "delivery_person_age", "delivery_person_ratings", *COORDS,
              "order_type", "vehicle_type", "temperature", "humidity", "precipitation", "weather_type",
              "traffic_level", "distance", "delivery_time_min"]
NUMERIC = ["delivery_person_age", "delivery_person_ratings", *COORDS, "temperature", "humidity", "precipitation",
           "distance", "delivery_time_min"]

HAV = ("2 * 6378137.0 * atan2(sqrt(pow(sin((radians(delivery_loc_latitude) - radians(restaurant_latitude)) / 2), 2)"
       " + cos(radians(restaurant_latitude)) * cos(radians(delivery_loc_latitude))"
       " * pow(sin((radians(delivery_loc_longitude) - radians(restaurant_longitude)) / 2), 2)),"
       " sqrt(1 - (pow(sin((radians(delivery_loc_latitude) - radians(restaurant_latitude)) / 2), 2)"
       " + cos(radians(restaurant_latitude)) * cos(radians(delivery_loc_latitude))"
       " * pow(sin((radians(delivery_loc_longitude) - radians(restaurant_longitude)) / 2), 2)))) / 1000.0")

DELIVERY_CTES = fx("deliveries_raw") + [
    ("typed", """
SELECT *, TRY_CAST(NULLIF(TRIM(distance_raw), '') AS DOUBLE) AS distance,
          TRY_CAST(NULLIF(TRIM(target_raw), '') AS DOUBLE) AS delivery_time_min
FROM deliveries_raw"""),
    ("clean", f"""
SELECT id, row_id, delivery_person_id, delivery_person_age, delivery_person_ratings,
       round(restaurant_latitude, 4) AS restaurant_latitude, round(restaurant_longitude, 4) AS restaurant_longitude,
       round(delivery_loc_latitude, 4) AS delivery_loc_latitude, round(delivery_loc_longitude, 4) AS delivery_loc_longitude,
       order_type, vehicle_type, temperature, humidity, precipitation, weather_type, traffic_level,
       COALESCE(distance, {HAV}) AS distance, delivery_time_min
FROM typed
WHERE NOT (distance IS NULL AND delivery_time_min IS NULL) AND delivery_time_min IS NOT NULL"""),
]


def dsql(body: str, extra=None) -> str:
    return with_ctes(DELIVERY_CTES + list(extra or []), body)


def _round_coords_sql(cols):
    return ", ".join(f"round({c}, 6) AS {c}" if c in COORDS else c for c in cols)


def _round_coords(df, names=None):
    return df.select(*[F.round(c, 6).alias(c) if c in COORDS else F.col(c) for c in (names or df.columns)])


@register("scan_csv", dsql(f"SELECT {_round_coords_sql(RAW_COLS)} FROM deliveries_raw"))
def q_scan_csv(spark, sf_dir):
    """Write the raw table as CSV with a header, read it back with an explicit schema
    (coordinates rounded to 6 places: the stand-in's raw doubles differ by engine)."""
    from ..sources.readers import read_csv, write_csv
    raw = deliveries_raw(spark, sf_dir).select(*RAW_COLS)
    path = fresh_path(spark, "csv")
    write_csv(raw, path)
    return _round_coords(read_csv(spark, path, raw.schema))


@register("lenient_cast", dsql("SELECT row_id, distance, delivery_time_min FROM typed"))
def q_lenient_cast(spark, sf_dir):
    return typed_deliveries(deliveries_raw(spark, sf_dir)).select("row_id", "distance", "delivery_time_min")


@register("filter_null_logic", dsql("""
SELECT row_id, distance, delivery_time_min FROM typed WHERE NOT (distance IS NULL AND delivery_time_min IS NULL)"""))
def q_filter_null_logic(spark, sf_dir):
    t = typed_deliveries(deliveries_raw(spark, sf_dir))
    return C.drop_both_missing(t, "distance", "delivery_time_min").select("row_id", "distance", "delivery_time_min")


@register("drop_missing", dsql("SELECT row_id FROM clean"))
def q_drop_missing(spark, sf_dir):
    return deliveries(spark, sf_dir).select("row_id")


@register("impute_haversine", dsql("SELECT row_id, round(distance, 6) AS distance FROM clean"))
def q_impute_haversine(spark, sf_dir):
    return deliveries(spark, sf_dir).select("row_id", F.round("distance", 6).alias("distance"))


RENAMED = ["ID", "Row_ID", "Delivery_person_ID", "Age", "Ratings", "Restaurant_latitude", "Restaurant_longitude",
           "Delivery_location_latitude", "Delivery_location_longitude", "Type_of_order", "Type_of_vehicle",
           "temperature", "humidity", "precipitation", "weather_description", "X", "Traffic_Level",
           "Distance_km", "TARGET"]


@register("rename_all", dsql("SELECT " + ", ".join(
    (f"round({a}, 6) AS {b}" if a in COORDS else f"{a} AS {b}") for a, b in zip(RAW_COLS, RENAMED))
    + " FROM deliveries_raw"))
def q_rename_all(spark, sf_dir):
    return C.rename_all(_round_coords(deliveries_raw(spark, sf_dir), RAW_COLS), RENAMED)


@register("drop_columns", dsql("SELECT " + _round_coords_sql(
    [c for c in RAW_COLS if c not in ("x", "distance_raw", "target_raw")]) + " FROM deliveries_raw"))
def q_drop_columns(spark, sf_dir):
    return _round_coords(deliveries_raw(spark, sf_dir).select(*RAW_COLS).drop("x", "distance_raw", "target_raw"))


@register("project_alias", dsql("""
SELECT row_id, delivery_person_id AS courier_id, delivery_person_age AS courier_age FROM deliveries_raw"""))
def q_project_alias(spark, sf_dir):
    return deliveries_raw(spark, sf_dir).select("row_id", F.col("delivery_person_id").alias("courier_id"),
                                                F.col("delivery_person_age").alias("courier_age"))


@register("derive_columns", dsql("""
SELECT row_id, round(restaurant_latitude, 4) AS restaurant_latitude, round(restaurant_longitude, 4) AS restaurant_longitude,
       CAST(1 AS BIGINT) AS units FROM deliveries_raw"""))
def q_derive_columns(spark, sf_dir):
    return deliveries_raw(spark, sf_dir).withColumns({
        "restaurant_latitude": F.round("restaurant_latitude", 4),
        "restaurant_longitude": F.round("restaurant_longitude", 4),
        "units": F.lit(1).cast("bigint")}).select("row_id", "restaurant_latitude", "restaurant_longitude", "units")


@register("filter_compare", dsql("""
SELECT row_id, delivery_person_id, delivery_person_age, delivery_person_ratings FROM clean
WHERE delivery_person_age = 15 OR delivery_person_ratings > 5"""))
def q_filter_compare(spark, sf_dir):
    d = deliveries(spark, sf_dir)
    return d.where((F.col("delivery_person_age") == 15) | (F.col("delivery_person_ratings") > 5)) \
        .select("row_id", "delivery_person_id", "delivery_person_age", "delivery_person_ratings")


@register("first_per_key", dsql("""
SELECT delivery_person_id, row_id, delivery_person_age
FROM (SELECT *, row_number() OVER (PARTITION BY delivery_person_id ORDER BY row_id) AS rn FROM clean) t WHERE rn = 1"""))
def q_first_per_key(spark, sf_dir):
    d = deliveries(spark, sf_dir)
    return C.first_per_key(d, ["delivery_person_id"], ["row_id"]) \
        .select("delivery_person_id", "row_id", "delivery_person_age")


DUP_COLS = [c for c in CLEAN_COLS if c not in ("id", "row_id", "delivery_person_id")]


@register("duplicate_rows", dsql(f"""
SELECT CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS duplicate_rows, CAST(COALESCE(SUM(n), 0) AS BIGINT) AS total_rows
FROM (SELECT COUNT(*) AS n FROM clean GROUP BY {", ".join(DUP_COLS)}) g"""))
def q_duplicate_rows(spark, sf_dir):
    return C.duplicate_row_count(deliveries(spark, sf_dir).select(*DUP_COLS))


FACTORS = ["order_type", "vehicle_type", "weather_type", "traffic_level"]


@register("factor_levels", dsql(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, level, CAST(row_number() OVER (ORDER BY level) AS BIGINT) AS level_index "
    f"FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS level FROM clean WHERE {c} IS NOT NULL) t{i}"
    for i, c in enumerate(FACTORS))))
def q_factor_levels(spark, sf_dir):
    return C.factor_levels(deliveries(spark, sf_dir), FACTORS)


@register("agg_value_counts", dsql("SELECT id, CAST(COUNT(*) AS BIGINT) AS appearances FROM clean GROUP BY id"))
def q_value_counts(spark, sf_dir):
    return P.value_counts(deliveries(spark, sf_dir), ["id"], "appearances")


@register("agg_group_means", dsql("""
SELECT vehicle_type, CAST(COUNT(*) AS BIGINT) AS appearances, round(AVG(delivery_time_min), 6) AS avg_delivery_time,
       round(AVG(distance), 6) AS delivery_distance FROM clean GROUP BY vehicle_type"""))
def q_group_means(spark, sf_dir):
    return P.group_means(deliveries(spark, sf_dir), ["vehicle_type"],
                         {"avg_delivery_time": "delivery_time_min", "delivery_distance": "distance"}, scale=6)


STAT_COLS = ["distance", "delivery_time_min", "delivery_person_age", "delivery_person_ratings"]


@register("agg_global_stats", dsql(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(AVG({c}), 6) AS mean, round(CAST(MIN({c}) AS DOUBLE), 6) AS min, "
    f"round(CAST(MAX({c}) AS DOUBLE), 6) AS max FROM clean" for c in STAT_COLS)))
def q_global_stats(spark, sf_dir):
    return P.global_stats(deliveries(spark, sf_dir), STAT_COLS)


@register("agg_count_distinct", dsql("""
SELECT CAST(COUNT(DISTINCT id) AS BIGINT) AS distinct_ids, CAST(COUNT(DISTINCT delivery_person_id) AS BIGINT) AS couriers,
       CAST(COUNT(*) AS BIGINT) AS n_rows FROM clean"""))
def q_count_distinct(spark, sf_dir):
    return deliveries(spark, sf_dir).agg(F.count_distinct("id").cast("bigint").alias("distinct_ids"),
                                         F.count_distinct("delivery_person_id").cast("bigint").alias("couriers"),
                                         F.count(F.lit(1)).cast("bigint").alias("n_rows"))


@register("agg_distinct_per_group", dsql("""
SELECT delivery_person_id, CAST(COUNT(DISTINCT delivery_person_age) AS BIGINT) AS distinct_ages
FROM clean GROUP BY delivery_person_id"""))
def q_distinct_per_group(spark, sf_dir):
    return P.distinct_per_group(deliveries(spark, sf_dir), "delivery_person_id", "delivery_person_age", "distinct_ages")


TYPED_COLS = RAW_COLS + ["distance", "delivery_time_min"]


@register("null_profile", dsql(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(COUNT(*) - COUNT({c}) AS BIGINT) AS null_count FROM typed" for c in TYPED_COLS)))
def q_null_profile(spark, sf_dir):
    return P.null_profile(typed_deliveries(deliveries_raw(spark, sf_dir)), TYPED_COLS)


@register("location_popularity", dsql("""
SELECT restaurant_latitude, restaurant_longitude, order_count, mean_delivery_time,
       order_count = MAX(order_count) OVER () AS is_most, order_count = MIN(order_count) OVER () AS is_least
FROM (SELECT restaurant_latitude, restaurant_longitude, CAST(COUNT(*) AS BIGINT) AS order_count,
             round(AVG(delivery_time_min), 6) AS mean_delivery_time
      FROM clean GROUP BY restaurant_latitude, restaurant_longitude) t
QUALIFY is_most OR is_least"""))
def q_location_popularity(spark, sf_dir):
    """Most and least popular restaurant locations (all ties) with their mean time; the
    extremes are two scalars, then a filter – no ranking of every location in one task."""
    g = deliveries(spark, sf_dir).groupBy("restaurant_latitude", "restaurant_longitude").agg(
        F.count(F.lit(1)).cast("bigint").alias("order_count"),
        F.round(F.avg("delivery_time_min"), 6).alias("mean_delivery_time"))
    g = materialize(g, "locations")
    hi, lo = g.agg(F.max("order_count"), F.min("order_count")).first()
    return g.select("*", (F.col("order_count") == hi).alias("is_most"), (F.col("order_count") == lo).alias("is_least")) \
        .where(F.col("is_most") | F.col("is_least"))


@register("histogram", dsql("""
SELECT s.bin, lo + s.bin * w AS bin_lo, lo + (s.bin + 1) * w AS bin_hi, CAST(COALESCE(c.n, 0) AS BIGINT) AS n
FROM (SELECT range AS bin FROM range(30)) s
CROSS JOIN (SELECT CAST(MIN(delivery_person_age) AS DOUBLE) AS lo,
                   (CAST(MAX(delivery_person_age) AS DOUBLE) - CAST(MIN(delivery_person_age) AS DOUBLE)) / 30 AS w FROM clean) r
LEFT JOIN (SELECT CAST(least(floor((CAST(delivery_person_age AS DOUBLE) - r2.lo) / r2.w), 29) AS BIGINT) AS bin, COUNT(*) AS n
           FROM clean, (SELECT CAST(MIN(delivery_person_age) AS DOUBLE) AS lo,
                   (CAST(MAX(delivery_person_age) AS DOUBLE) - CAST(MIN(delivery_person_age) AS DOUBLE)) / 30 AS w FROM clean) r2
           GROUP BY 1) c ON c.bin = s.bin"""))
def q_histogram(spark, sf_dir):
    return P.histogram(deliveries(spark, sf_dir), "delivery_person_age", 30)


BIN_WIDTH = 2.5


@register("histogram_width", dsql("""
SELECT b.bin, lo + b.bin * 2.5 AS bin_lo, lo + (b.bin + 1) * 2.5 AS bin_hi, CAST(COUNT(c.distance) AS BIGINT) AS n
FROM (SELECT floor(MIN(distance) / 2.5) * 2.5 AS lo, floor((MAX(distance) - floor(MIN(distance) / 2.5) * 2.5) / 2.5) AS last FROM clean) r
JOIN (SELECT range AS bin FROM range(100000)) b ON b.bin <= last
LEFT JOIN clean c ON floor((c.distance - lo) / 2.5) = b.bin GROUP BY b.bin, lo"""))
def q_histogram_width(spark, sf_dir):
    """Counts by bins of a given width, which start at a multiple of it."""
    return P.histogram(deliveries(spark, sf_dir), "distance", binwidth=BIN_WIDTH)


@register("histogram_by_group", dsql("""
SELECT b.bin, t.traffic_level, lo + b.bin * w AS bin_lo, lo + (b.bin + 1) * w AS bin_hi, CAST(COUNT(c.row_id) AS BIGINT) AS n
FROM (SELECT CAST(MIN(delivery_person_age) AS DOUBLE) AS lo, (MAX(delivery_person_age) - MIN(delivery_person_age)) / 10.0 AS w FROM clean) r
CROSS JOIN (SELECT range AS bin FROM range(10)) b CROSS JOIN (SELECT DISTINCT traffic_level FROM clean) t
LEFT JOIN clean c ON c.traffic_level = t.traffic_level AND least(floor((c.delivery_person_age - lo) / w), 9) = b.bin
GROUP BY b.bin, t.traffic_level, lo, w"""))
def q_histogram_by_group(spark, sf_dir):
    """Counts by ten bins for every traffic level, empty bins included."""
    return P.histogram(deliveries(spark, sf_dir), "delivery_person_age", 10, by=["traffic_level"])


@register("boxplot_stats", dsql("""
SELECT traffic_level, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(MIN(CASE WHEN delivery_time_min BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN delivery_time_min END), 6) AS whisker_lo,
       round(MAX(CASE WHEN delivery_time_min BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN delivery_time_min END), 6) AS whisker_hi,
       CAST(SUM(CASE WHEN delivery_time_min BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN 0 ELSE 1 END) AS BIGINT) AS outliers,
       CAST(COUNT(*) AS BIGINT) AS n
FROM clean JOIN (SELECT traffic_level AS tl, quantile_cont(delivery_time_min, 0.25) AS q1,
                        quantile_cont(delivery_time_min, 0.5) AS median, quantile_cont(delivery_time_min, 0.75) AS q3
                 FROM clean GROUP BY traffic_level) q ON q.tl = clean.traffic_level
GROUP BY traffic_level, q1, median, q3"""))
def q_boxplot(spark, sf_dir):
    return P.boxplot_stats(deliveries(spark, sf_dir), "delivery_time_min", ["traffic_level"])


@register("order_by_median", dsql("""
SELECT traffic_level, median, CAST(row_number() OVER (ORDER BY median, traffic_level) AS BIGINT) AS median_rank
FROM (SELECT traffic_level, quantile_cont(delivery_time_min, 0.5) AS median FROM clean GROUP BY traffic_level) t"""))
def q_order_by_median(spark, sf_dir):
    return P.order_by_median(deliveries(spark, sf_dir), "traffic_level", "delivery_time_min")


@register("binned_scatter", dsql("""
SELECT CAST(floor(delivery_person_age / 1.0) AS BIGINT) AS x_bin, CAST(floor(delivery_time_min / 5.0) AS BIGINT) AS y_bin,
       CAST(COUNT(*) AS BIGINT) AS n FROM clean GROUP BY 1, 2"""))
def q_binned_scatter(spark, sf_dir):
    return P.binned_scatter(deliveries(spark, sf_dir), "delivery_person_age", "delivery_time_min", 1.0, 5.0)


def _corr_sql():
    parts = []
    for i, a in enumerate(NUMERIC):
        for b in NUMERIC[i:]:
            r = (f"round(CASE WHEN stddev_samp({a}) > 0 AND stddev_samp({b}) > 0 THEN covar_samp({a}, {b}) "
                 f"/ (stddev_samp({a}) * stddev_samp({b})) END, 2)")
            parts.append(f"SELECT '{a}' AS var1, '{b}' AS var2, {r} AS value FROM clean")
            if a != b:
                parts.append(f"SELECT '{b}' AS var1, '{a}' AS var2, {r} AS value FROM clean")
    return " UNION ALL ".join(parts)


@register("correlation_matrix", dsql(_corr_sql()))
def q_correlation(spark, sf_dir):
    return P.correlation_matrix(deliveries(spark, sf_dir), NUMERIC, 2)


MELT_VALUES = ["avg_delivery_time", "delivery_distance"]


@register("melt", dsql(" UNION ALL ".join(
    f"SELECT vehicle_type, '{v}' AS variable, {v} AS value FROM (SELECT vehicle_type, round(AVG(delivery_time_min), 6) "
    f"AS avg_delivery_time, round(AVG(distance), 6) AS delivery_distance FROM clean GROUP BY vehicle_type) w"
    for v in MELT_VALUES)))
def q_melt(spark, sf_dir):
    wide = P.group_means(deliveries(spark, sf_dir), ["vehicle_type"],
                         {"avg_delivery_time": "delivery_time_min", "delivery_distance": "distance"}, scale=6)
    return wide.unpivot(["vehicle_type"], MELT_VALUES, "variable", "value")


@register("table_profile", dsql(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({i + 1} AS BIGINT) AS position, CAST(COUNT({c}) AS BIGINT) AS non_null, "
    f"CAST(COUNT(*) AS BIGINT) AS n_rows FROM clean" for i, c in enumerate(CLEAN_COLS))))
def q_table_profile(spark, sf_dir):
    d = deliveries(spark, sf_dir).select(*CLEAN_COLS)
    wide = d.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in d.columns])
    structs = [F.struct(F.lit(c).alias("column_name"), F.lit(i + 1).cast("bigint").alias("position"),
                        F.col(c).cast("bigint").alias("non_null"), F.col("_n").cast("bigint").alias("n_rows"))
               for i, c in enumerate(d.columns)]
    return wide.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


@register("numeric_columns", dsql("""
SELECT column_name, (SELECT CAST(COUNT(*) AS BIGINT) FROM clean) AS n_rows
FROM (UNPIVOT (SELECT typeof(COLUMNS(*)) FROM clean LIMIT 1) ON * INTO NAME column_name VALUE kind)
WHERE kind IN ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT', 'HUGEINT', 'FLOAT', 'DOUBLE') OR kind LIKE 'DECIMAL%'"""))
def q_numeric_columns(spark, sf_dir):
    d = deliveries(spark, sf_dir)
    names = C.numeric_columns(d)
    # the schema is metadata; the row count shows the columns belong to the scanned table
    n = d.agg(F.count(F.lit(1)).alias("n_rows"))
    return n.select(F.explode(F.array(*[F.lit(c) for c in names])).alias("column_name"), "n_rows")


@register("preview", dsql("SELECT * REPLACE (round(distance, 6) AS distance) FROM clean ORDER BY row_id LIMIT 10"))
def q_preview(spark, sf_dir):
    """First rows in key order (Spark has no row order of its own); the imputed distance is
    rounded to 6 places because the engines' trigonometry differs in the last bits."""
    return deliveries(spark, sf_dir).orderBy("row_id").limit(10).withColumn("distance", F.round("distance", 6))


@register("guarded_ratio", dsql("""
SELECT row_id, round(CASE WHEN precipitation IS NOT NULL AND precipitation <> 0 THEN humidity / precipitation END, 6) AS ratio
FROM deliveries_raw"""))
def q_guarded_ratio(spark, sf_dir):
    return deliveries_raw(spark, sf_dir).select("row_id", F.round(guarded_ratio("humidity", "precipitation"), 6)
                                                .alias("ratio"))


@register("null_default", dsql("SELECT row_id, COALESCE(distance, 0) AS distance FROM typed"))
def q_null_default(spark, sf_dir):
    return typed_deliveries(deliveries_raw(spark, sf_dir)).select(
        "row_id", F.coalesce("distance", F.lit(0.0)).alias("distance"))


@register("pk_audit", dsql("""
SELECT id, CAST(COUNT(*) AS BIGINT) AS n FROM deliveries_raw GROUP BY id HAVING COUNT(*) > 1"""))
def q_pk_audit(spark, sf_dir):
    from ..operators.joins import pk_audit
    return pk_audit(deliveries_raw(spark, sf_dir), ["id"]).withColumn("n", F.col("n").cast("bigint"))




@register("haversine", dsql(f"SELECT row_id, round({HAV} * 1000.0, 3) AS distance_m FROM deliveries_raw"))
def q_haversine(spark, sf_dir):
    from ..functions.scalar import haversine_m
    d = deliveries_raw(spark, sf_dir)
    return d.select("row_id", F.round(haversine_m(*COORDS), 3).alias("distance_m"))


@register("arith_scalar", dsql("""
SELECT row_id, abs(delivery_person_age - humidity) AS abs_diff, delivery_person_age + humidity AS total,
       delivery_person_age * 2 AS doubled, round(humidity / delivery_person_age, 6) AS ratio,
       round(sqrt(humidity), 6) AS root FROM deliveries_raw"""))
def q_arith_scalar(spark, sf_dir):
    d = deliveries_raw(spark, sf_dir)
    age, hum = F.col("delivery_person_age"), F.col("humidity")
    return d.select("row_id", F.abs(age - hum).alias("abs_diff"), (age + hum).alias("total"),
                    (age * 2).alias("doubled"), F.round(hum / age, 6).alias("ratio"), F.round(F.sqrt(hum), 6).alias("root"))


@register("round_modes", dsql("""
SELECT row_id, CAST(round(CAST(distance_raw AS DECIMAL(10,2)), 1) AS DOUBLE) AS half_up,
       CAST(round_even(CAST(distance_raw AS DECIMAL(10,2)), 1) AS DOUBLE) AS half_even
FROM deliveries_raw WHERE TRY_CAST(distance_raw AS DECIMAL(10,2)) IS NOT NULL"""))
def q_round_modes(spark, sf_dir):
    """Oracle rounds exact numbers half away from zero, R rounds half to even: both on
    exact decimals (no binary ties)."""
    d = deliveries_raw(spark, sf_dir).withColumn("_d", F.expr("try_cast(distance_raw AS DECIMAL(10,2))"))
    return d.where(F.col("_d").isNotNull()).select(
        "row_id", F.round("_d", 1).cast("double").alias("half_up"), F.bround("_d", 1).cast("double").alias("half_even"))
