"""Join helpers: NULL-safe keys and integrity audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def join_nullsafe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join where NULL keys match NULL keys (dplyr's default); keys appear once."""
    r = right
    for k in keys:
        r = r.withColumnRenamed(k, f"_r_{k}")
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"_r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])


def semi_join_all(df: DataFrame, others: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Chained semi joins, each on its own key: keep rows whose keys all exist."""
    out = df
    for other, key in others:
        out = out.join(other.select(key).distinct(), key, "left_semi")
    return out


def keys_not_in(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Distinct values of ``key`` (not NULL) that ``df`` has and ``other`` has not."""
    return df.select(key).where(F.col(key).isNotNull()).distinct().join(other.select(key).distinct(), key, "left_anti")


def flag_unmatched(df: DataFrame, others: Sequence[tuple[DataFrame, str]], name: str) -> DataFrame:
    """``df`` with a flag: true for rows that :func:`semi_join_all` drops, a key being NULL or absent on the other side.

    The absent keys are found among distinct keys and written.  The rows meet only these, so they stay where they are
    while the absent keys fit a broadcast."""
    gone = F.lit(False)
    out = df
    for i, (other, key) in enumerate(others):
        absent = materialize(keys_not_in(df, other, key), "absent-keys").select(F.col(key).alias(f"_absent{i}"))
        out = out.join(absent, out[key] == absent[f"_absent{i}"], "left")
        gone = gone | F.col(key).isNull() | F.col(f"_absent{i}").isNotNull()
    return out.withColumn(name, gone).drop(*[f"_absent{i}" for i in range(len(others))])


def anti_join_rows(df: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of ``df`` with no equal row (NULL-safe, all common columns) in ``other``."""
    cols = [c for c in df.columns if c in other.columns]
    o = other.select(*cols)
    for c in cols:
        o = o.withColumnRenamed(c, f"_o_{c}")
    cond = None
    for c in cols:
        e = df[c].eqNullSafe(o[f"_o_{c}"])
        cond = e if cond is None else cond & e
    return df.join(o, cond, "left_anti")


def fk_audit(fact: DataFrame, fk: str, dim: DataFrame, pk: str) -> DataFrame:
    """Orphan foreign keys: one row (fk_column, orphan_rows, orphan_keys).  The join meets one row per key, not the fact."""
    keys = fact.groupBy(fk).agg(F.count(F.lit(1)).alias("_rows"))
    orphans = keys.join(dim.select(F.col(pk).alias(fk)), fk, "left_anti")
    return orphans.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("orphan_rows"), F.count(fk).alias("orphan_keys")) \
        .select(F.lit(fk).alias("fk_column"), "orphan_rows", "orphan_keys")


def pk_audit(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their multiplicity."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def fanout_audit(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How an inner join on a non-unique key changes row counts, per key value."""
    rc = right.groupBy(key).agg(F.count(F.lit(1)).alias("right_matches"))
    lc = left.groupBy(key).agg(F.count(F.lit(1)).alias("left_rows"))
    return lc.join(rc, key, "left") \
        .select(key, "left_rows", F.coalesce("right_matches", F.lit(0)).cast("bigint").alias("right_matches"),
                (F.col("left_rows") * F.coalesce("right_matches", F.lit(0))).cast("bigint").alias("joined_rows"))
