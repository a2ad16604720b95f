"""Data-cleaning operators (typing, filtering, imputation, deduplication)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import haversine_km, lenient_cast


def lenient_columns(df: DataFrame, columns: dict[str, str], to: str = "double") -> DataFrame:
    """``{source: target}``: add ``target`` = text of ``source`` as ``to``; bad text -> NULL."""
    return df.withColumns({dst: lenient_cast(src, to) for src, dst in columns.items()})


def drop_both_missing(df: DataFrame, a: str, b: str) -> DataFrame:
    """Keep rows where not both ``a`` and ``b`` are missing."""
    return df.where(~(F.col(a).isNull() & F.col(b).isNull()))


def drop_missing(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(subset))


def impute_haversine(df: DataFrame, target: str, lat1: str, lon1: str, lat2: str, lon2: str) -> DataFrame:
    """Missing ``target`` := great-circle distance (km) between the two coordinate pairs,
    for every missing row (not only the first few)."""
    return df.withColumn(target, F.coalesce(F.col(target), haversine_km(lat1, lon1, lat2, lon2)))


def rename_all(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.toDF(*names)


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in ascending ``order`` (``distinct(key, .keep_all=TRUE)``).

    ``min_by`` is an aggregate: each task keeps one candidate per key before the
    shuffle, so a key holding a third of all rows never lands whole in one task (a
    row_number window would sort all of its rows there).  ``order`` must be unique."""
    rest = [c for c in df.columns if c not in key]
    best = F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(*key).agg(best.alias("_first")).select(*key, *[F.col(f"_first.{c}").alias(c) for c in rest])


def duplicate_row_count(df: DataFrame) -> DataFrame:
    """Rows equal (NULL-safe) to an earlier row: count(*) - number of distinct rows."""
    g = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"),
                 F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("total_rows"))


def factor_levels(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Alphabetical level table (R factor order): column, level, level_index (1-based).

    All columns are read in one pass; levels are numbered over ranges of (column, level), so that a column with very
    many levels is not numbered in one task."""
    from .windows import global_row_number
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("level")) for c in columns])).alias("p"))
    levels = pairs.select("p.column_name", "p.level").where(F.col("level").isNotNull()).distinct()
    numbered = global_row_number(levels, ["column_name", "level"], "_n")
    first = numbered.groupBy("column_name").agg(F.min("_n").alias("_first"))
    return numbered.join(first, "column_name").select("column_name", "level", (F.col("_n") - F.col("_first") + 1).cast("bigint").alias("level_index"))


def decode_lookup(df: DataFrame, column: str, mapping: DataFrame, code: str, label: str) -> DataFrame:
    """Replace coded values by labels through a lookup table of any size (the planner picks the join)."""
    return df.join(mapping.select(F.col(code).alias(column), label), column, "left")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def zscore_filter(df: DataFrame, columns: Sequence[str], threshold: float = 3.0) -> DataFrame:
    """Sequential z-score filter: for each column in order, recompute mean and sample sd on
    the rows that survived so far and keep |z| <= threshold.  A zero or undefined sd
    removes every row (the comparison is undefined, as in pandas).

    The steps depend on each other, so each column costs one aggregate job that returns
    two numbers; the filters then enter the plan as literals, leaving a flat chain of
    predicates that Catalyst fuses into one scan-and-filter stage."""
    out = df
    for c in columns:
        mu, sd = out.agg(F.avg(c), F.stddev_samp(c)).first()
        if sd is None or mu is None or not sd > 0:
            return out.where(F.lit(False))
        out = out.where(F.abs((F.col(c) - F.lit(mu)) / F.lit(sd)) <= threshold)
    return out


def binarize_target(df: DataFrame, column: str, threshold, name: str | None = None) -> DataFrame:
    return df.withColumn(name or column, (F.col(column) > threshold).cast("int"))


def round_columns(df: DataFrame, columns: Sequence[str], scale: int) -> DataFrame:
    return df.withColumns({c: F.round(c, scale) for c in columns})
