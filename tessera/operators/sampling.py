"""Reproducible splits, folds and resampling.

Randomness is a hash: ``md5(seed | key)`` orders rows, so the same rows are
chosen on any cluster size, partitioning or retry (``randomSplit`` is neither
exact in size nor stable under repartitioning).  Exact sizes need ranks
inside each stratum; ``hash_rank`` gets them from buckets of the hash itself,
so a stratum holding a third of all rows is spread over many tasks instead of
landing in one window partition.
"""

from __future__ import annotations

import math

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .joins import join_nullsafe


def hash_key(seed: int, keys: Sequence[str]) -> Column:
    """md5 of 'seed|k1|k2…' (hex text, identical in Spark and DuckDB)."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


# Target rows per hash bucket.
BUCKET_TARGET_ROWS = 50_000


def bucket_digits(n_rows: int) -> int:
    """Hex digits of the hash that give buckets of about ``BUCKET_TARGET_ROWS`` rows
    (1 digit = 16 buckets per stratum, 2 digits = 256, and so on)."""
    if n_rows <= BUCKET_TARGET_ROWS:
        return 1
    return max(1, math.ceil(math.log(n_rows / BUCKET_TARGET_ROWS, 16)))


def hash_rank(df: DataFrame, seed: int, keys: Sequence[str], strata: Sequence[str] = (), name: str = "hrank",
              size_name: str | None = None, digits: int | None = None) -> DataFrame:
    """1-based rank of each row inside its stratum in the order (md5(seed|keys), keys),
    plus the stratum size.

    The leading hex digits of the hash form a bucket whose order is the sort order, so
    rank = rows in earlier buckets of the stratum + row number inside the bucket; the
    number of digits follows the row count (about 50,000 rows per bucket).  The
    per-bucket counts give the offsets.  Numbering and
    offsets are both keyed by (stratum, bucket): the offsets join lands on the
    partitioning the numbering window already produced, so only the small count table
    moves, and even a stratum holding a third of all rows is spread over many tasks.
    Every column is deterministic, so repeated evaluation agrees."""
    st = list(strata)
    # one non-NULL text key per stratum (NULL is a stratum of its own)
    g = F.to_json(F.struct(*[F.col(c) for c in st])) if st else F.lit("")
    digits = digits or bucket_digits(df.count())
    d = df.withColumn("_h", hash_key(seed, keys)).withColumn("_b", F.substring("_h", 1, digits)) \
        .withColumn("_g", g)
    per_bucket = d.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_bn"))
    prior = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select("_g", "_b", F.coalesce(F.sum("_bn").over(prior), F.lit(0)).alias("_boff"),
                                F.sum("_bn").over(Window.partitionBy("_g")).alias("_gn"))
    local = d.withColumn("_lr", F.row_number().over(
        Window.partitionBy("_g", "_b").orderBy("_h", *[F.col(k) for k in keys])))
    out = local.join(offsets, ["_g", "_b"])
    out = out.withColumn(name, (F.col("_boff") + F.col("_lr")).cast("bigint"))
    if size_name:
        out = out.withColumn(size_name, F.col("_gn").cast("bigint"))
    return out.drop("_h", "_b", "_g", "_lr", "_boff", "_gn")


#: leading hex digits of the hash that number the buckets of a split (4,096 of them per stratum at most)
SPLIT_DIGITS = 3


def split_exact(df: DataFrame, keys: Sequence[str], fraction: float, seed: int, strata: Sequence[str] = (),
                name: str = "in_sample", digits: int = SPLIT_DIGITS) -> DataFrame:
    """Flag the ceil(fraction * n) rows per stratum (all rows if no strata) that come first in hash order.

    The last row's hash is found by selection: counts of the hash's leading digits tell in which bucket of a stratum
    it lies, and only the hashes of that one bucket are ranked.  The flag is then a comparison with one hash per
    stratum: rows are not shuffled, sorted or numbered.  ``keys`` tell rows apart; rows with the same keys fall on the
    same side."""
    st = list(strata)
    # one non-NULL text key per stratum (NULL is a stratum of its own)
    g = F.to_json(F.struct(*[F.col(c) for c in st])) if st else F.lit("")
    d = df.withColumn("_split_hash", hash_key(seed, keys)).withColumn("_split_stratum", g)
    narrow = d.select("_split_stratum", "_split_hash", F.substring("_split_hash", 1, digits).alias("_b"))
    counts = narrow.groupBy("_split_stratum", "_b").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("_split_stratum")
    counts = counts.select("_split_stratum", "_b", "_n", F.sum("_n").over(whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"),
                           F.ceil(F.sum("_n").over(whole) * F.lit(float(fraction))).alias("_want"))
    last = counts.where((F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("_n") < F.col("_want"))) \
        .select("_split_stratum", "_b", (F.col("_want") - F.col("_upto") + F.col("_n")).alias("_need"))
    last = materialize(last, "split-buckets")  # one row per stratum
    place = F.row_number().over(Window.partitionBy("_split_stratum").orderBy("_split_hash"))
    cut = narrow.join(last, ["_split_stratum", "_b"]).withColumn("_place", place).where(F.col("_place") == F.col("_need")).select("_split_stratum", F.col("_split_hash").alias("_split_cut"))
    if not st:
        row = cut.first()
        flag = F.col("_split_hash") <= F.lit(row["_split_cut"]) if row is not None else F.lit(False)
        return d.withColumn(name, flag).drop("_split_hash", "_split_stratum")
    return d.join(materialize(cut, "split-cuts"), "_split_stratum", "left").withColumn(name, F.coalesce(F.col("_split_hash") <= F.col("_split_cut"), F.lit(False))) \
        .drop("_split_hash", "_split_stratum", "_split_cut")


def split_random(df: DataFrame, keys: Sequence[str], test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """train_test_split: ceil(test_fraction * n) rows go to test; column ``split``."""
    s = split_exact(df, keys, test_fraction, seed, name="_t")
    return s.withColumn("split", F.when(F.col("_t"), "test").otherwise("train")).drop("_t")


def split_stratified(df: DataFrame, keys: Sequence[str], label: str, test_fraction: float = 0.2,
                     seed: int = 42) -> DataFrame:
    s = split_exact(df, keys, test_fraction, seed, strata=[label], name="_t")
    return s.withColumn("split", F.when(F.col("_t"), "test").otherwise("train")).drop("_t")


def quantile_group(df: DataFrame, y: str, groups: int = 5, name: str = "qgroup") -> DataFrame:
    """Interval of ``y`` between its distinct quantile breaks (0, 1/(g-1), …, 1), lowest
    break included in the first interval.  One aggregate for the breaks (g numbers)."""
    from .profile import exact_quantiles
    probs = [i / (groups - 1) for i in range(groups)]
    row = exact_quantiles(df, y, probs).first()
    breaks = sorted(set(float(v) for v in row)) if row is not None else []
    arr = F.array(*[F.lit(float(b)) for b in breaks])
    return df.withColumn(name, F.greatest(F.lit(1), F.size(F.filter(arr, lambda b: b < F.col(y))))
                         .cast("bigint"))


def split_quantile(df: DataFrame, y: str, keys: Sequence[str], fraction: float, seed: int = 42,
                   name: str = "in_sample") -> DataFrame:
    """createDataPartition on a numeric target: sample within quantile groups of ``y``."""
    g = quantile_group(df, y, name="_qg")
    return split_exact(g, keys, fraction, seed, strata=["_qg"], name=name).drop("_qg")


def kfold(df: DataFrame, keys: Sequence[str], k: int, seed: int = 42, strata: Sequence[str] = (),
          name: str = "fold") -> DataFrame:
    """Fold 0..k-1 = (hash rank - 1) mod k, inside each stratum when given (stratified)."""
    r = hash_rank(df, seed, keys, strata, name="_r")
    return r.withColumn(name, F.pmod(F.col("_r") - 1, F.lit(k)).cast("bigint")).drop("_r")


def contiguous_folds(df: DataFrame, order: Sequence, k: int, name: str = "fold") -> DataFrame:
    """Fold 0..k-1 of consecutive rows in the total order ``order`` (unshuffled k-fold): the first n mod k folds hold one
    row more.  Rows are numbered over ranges of the order, not in one task."""
    from .windows import global_row_number
    numbered = global_row_number(df, order, "_fold_row", with_total="_fold_rows")
    row, size = F.col("_fold_row") - 1, F.floor(F.col("_fold_rows") / k)
    longer = F.col("_fold_rows") % k * (size + 1)  # rows of the folds with one more
    fold = F.when(row < longer, F.floor(row / (size + 1))).otherwise(F.floor((row - longer) / F.greatest(size, F.lit(1))) + F.col("_fold_rows") % k)
    return numbered.withColumn(name, fold.cast("bigint")).drop("_fold_row", "_fold_rows")


def oversample(df: DataFrame, label: str, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Random over-sampling with replacement until every class has the majority count.

    Extra row j (0-based) of a class with n rows copies the class row whose in-class rank
    is 1 + md5(seed|label|j) mod n.  The deficits stay a table with one row per class; their
    indices are made in chunks that are spread over the tasks, and the copies are an equi-join
    on (class, rank): no class is generated or gathered in one task, there is no cross join,
    and any number of classes will do."""
    ranked = hash_rank(df, seed, keys, [label], name="_rk", size_name="_n")
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_cn"))
    target = counts.agg(F.max("_cn")).first()[0] or 0
    originals = ranked.drop("_rk", "_n").withColumn("copy_index", F.lit(None).cast("int"))
    chunk = 10_000
    missing = counts.where(F.col("_cn") < target).withColumn("_d", F.lit(target) - F.col("_cn"))
    chunks = missing.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_d") - 1, F.lit(chunk).cast("bigint")))) \
        .repartition(label, "_from")
    extra = chunks.withColumn("_j", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + chunk, F.col("_d")) - 1)))
    pick = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(label).cast("string"),
                                                F.col("_j").cast("string"))), 1, 15), 16, 10).cast("decimal(20,0)")
    extra = extra.withColumn("_rk", (F.pmod(pick, F.col("_cn")) + 1).cast("bigint")).select(label, "_rk", "_j")
    copies = join_nullsafe(ranked, extra, [label, "_rk"], "inner").drop("_rk", "_n") \
        .withColumn("copy_index", F.col("_j").cast("int")).drop("_j")
    return originals.unionByName(copies)


def sample_values(df: DataFrame, column: str, k: int, seed: int = 42) -> DataFrame:
    """k distinct values in hash order (R ``sample(unique(x), k)`` with a reproducible rule)."""
    d = df.select(column).distinct()
    return d.orderBy(hash_key(seed, [column]), column).limit(k)
