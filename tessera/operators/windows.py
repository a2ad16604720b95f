"""Window operators, including a global row number that does not funnel into one task.

A window without ``partitionBy`` runs in a single task.  That is fine on
aggregates (one row per month, per model), but not for per-customer or
per-car tables.  ``global_row_number`` range-partitions the rows on the sort
key, numbers rows inside each partition and adds the row count of all earlier
partitions (a table with one row per partition, broadcast back).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(cols: Sequence) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def global_row_number(df: DataFrame, order: Sequence, name: str = "row_number",
                      num_partitions: int | None = None, with_total: str | None = None) -> DataFrame:
    """1-based position of each row in the total order ``order`` (must be a total order).

    The rows are range-partitioned on the sort key and written once, with their range
    partition id as a column, to the shared checkpoint folder: the per-partition
    numbering and the per-partition counts then read one fixed assignment (two
    evaluations of a range shuffle need not agree once the optimiser pushes different
    filters into them).  Cost: a sampling pass, one range shuffle written once, one
    shuffle + local sort by partition id, and a table with one row per partition.  No
    step holds more than one range of rows.  One path for every size.
    """
    from ..session import materialize
    spark = df.sparkSession
    ocols = _cols(order)
    n_parts = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(n_parts, *ocols).withColumn("_pid", F.spark_partition_id()),
                         "ranged")
    local = ranged.withColumn("_lrn", F.row_number().over(Window.partitionBy("_pid").orderBy(*ocols)))
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    prior = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_n").over(prior), F.lit(0)).alias("_off"),
        F.sum("_n").over(Window.partitionBy()).alias("_total"))
    # offsets has exactly one row per range partition: a size bound we choose.
    out = local.join(F.broadcast(offsets), "_pid").withColumn(name, (F.col("_off") + F.col("_lrn")).cast("bigint"))
    if with_total:
        out = out.withColumn(with_total, F.col("_total").cast("bigint"))
    return out.drop("_pid", "_lrn", "_off", "_total")


def global_cumsum(df: DataFrame, order: Sequence, values: Sequence[str], prefix: str = "cum_") -> DataFrame:
    """Running sums of ``values`` over the total order ``order`` (rows up to and including
    the current one), without a single-task window: range-partition on
    the order, write once with the partition id, running sums inside each partition,
    plus the totals of all earlier partitions (one row per partition, broadcast)."""
    from ..session import materialize
    ocols = _cols(order)
    vals = list(values)
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(n_parts, *ocols).withColumn("_pid", F.spark_partition_id()), "ranged")
    local_w = Window.partitionBy("_pid").orderBy(*ocols).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.select("*", *[F.sum(v).over(local_w).alias(f"_l_{v}") for v in vals])
    totals = ranged.groupBy("_pid").agg(*[F.sum(v).alias(f"_t_{v}") for v in vals])
    prior = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", *[F.coalesce(F.sum(f"_t_{v}").over(prior), F.lit(0)).alias(f"_o_{v}") for v in vals])
    out = local.join(F.broadcast(offsets), "_pid")  # one row per range partition
    out = out.select("*", *[(F.col(f"_o_{v}") + F.col(f"_l_{v}")).alias(f"{prefix}{v}") for v in vals])
    return out.drop("_pid", *[f"_l_{v}" for v in vals], *[f"_o_{v}" for v in vals])


def ntile_from_rank(rank, total, buckets: int) -> Column:
    """NTILE(buckets) from a 1-based row number and the row count (SQL NTILE semantics:
    the first ``total % buckets`` tiles hold one extra row)."""
    r, n = F.col(rank) if isinstance(rank, str) else rank, F.col(total) if isinstance(total, str) else total
    q = F.floor(n / buckets)
    m = n - q * buckets
    big = m * (q + 1)
    return F.when(r <= big, F.floor((r - 1) / (q + 1)) + 1) \
        .otherwise(m + F.floor((r - 1 - big) / q) + 1).cast("bigint")


def global_ntile(df: DataFrame, order: Sequence, buckets: int, name: str = "ntile") -> DataFrame:
    """NTILE over the whole table without a single-partition window."""
    ranked = global_row_number(df, order, name="_grn", with_total="_gn")
    return ranked.withColumn(name, ntile_from_rank("_grn", "_gn", buckets)).drop("_grn", "_gn")


def surrogate_key(df: DataFrame, order: Sequence, name: str) -> DataFrame:
    """Identity-style key 1..n in the order of the natural key (stable across runs)."""
    return global_row_number(df, order, name=name)


def rank_top_k(df: DataFrame, partition: Sequence, order: Sequence, k: int, name: str = "rank") -> DataFrame:
    """RANK() per partition, keep rank <= k (ties can return more than k rows).
    Spark plans a partial WindowGroupLimit before the shuffle."""
    w = Window.partitionBy(*_cols(partition)).orderBy(*_cols(order))
    return df.withColumn(name, F.rank().over(w)).where(F.col(name) <= k)


def share_of_total(value, partition: Sequence) -> Column:
    """value / SUM(value) OVER (PARTITION BY ...) ; NULL when the total is 0."""
    v = F.col(value) if isinstance(value, str) else value
    total = F.sum(v).over(Window.partitionBy(*_cols(partition)))
    return F.when(total != 0, v / total)
