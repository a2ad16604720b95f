"""Ratings study: working set, hold-out split with repair, inner train/test split.

The splits are written once per application (below ``spark.checkpoint.dir``)
and read back: every model stage re-reads them, and recomputing a hashed,
range-sorted split on each pass would multiply the work.
"""

from __future__ import annotations

import hashlib
import threading
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import round_to_day, title_year
from ..operators.joins import flag_unmatched
from ..operators.sampling import split_quantile
from ..session import cache, folder_state, materialize, scratch_path, write_read
from ..sources.fixtures import SEED, fixture

KEYS = ["userid", "movieid"]
FACTORS = ["movieid", "userid", "genres", "day", "year_publication"]


def ratings_working_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ratings LEFT JOIN movies, with the rounded day and the publication year."""
    r, m = fixture(spark, sf_dir, "ratings"), fixture(spark, sf_dir, "movies")
    ml = r.join(m, "movieid", "left")
    return ml.select("userid", "movieid", "rating", "rated_at", "title", "genres",
                     round_to_day("rated_at").alias("day"), title_year("title").alias("year_publication"))


def holdout_split(flagged: DataFrame, keep=materialize) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edx, final_holdout, removed) of rows flagged ``_h``: keep only hold-out rows whose user and item occur in the
    rest, return the others.  The flagged rows with their verdict are written by ``keep``."""
    edx0 = flagged.where(~F.col("_h")).drop("_h")
    temp = keep(flag_unmatched(flagged.where("_h").drop("_h"), [(edx0, "movieid"), (edx0, "userid")], "_gone"), "holdout")
    removed = temp.where("_gone").drop("_gone")
    return edx0.unionByName(removed), temp.where(~F.col("_gone")).drop("_gone"), removed


def inner_split(flagged: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, test, test_before_filter) of rows flagged ``_t``: test keeps only users and items seen in train."""
    train = flagged.where("_t").drop("_t")
    test0 = flagged.where(~F.col("_t")).drop("_t")
    test = flag_unmatched(test0, [(train, "movieid"), (train, "userid")], "_gone").where(~F.col("_gone")).drop("_gone")
    return train, test, test0


@dataclass(frozen=True)
class RatingSets:
    ml: DataFrame
    edx: DataFrame
    holdout: DataFrame
    removed: DataFrame
    train: DataFrame
    test: DataFrame
    test0: DataFrame


_LOCK = threading.Lock()
_SETS: dict[tuple, RatingSets] = cache()


def rating_sets(spark: SparkSession, sf_dir: str, seed: int = SEED) -> RatingSets:
    key = (spark.sparkContext.applicationId, sf_dir, folder_state(spark, sf_dir), seed)
    with _LOCK:
        if key in _SETS:
            return _SETS[key]
        tag = hashlib.sha1(str(key).encode()).hexdigest()[:12]
        base = scratch_path(spark, f"ratings-{tag}")

        def keep(df, name):
            return write_read(df, f"{base}/{name}")

        ml = keep(ratings_working_set(spark, sf_dir), "ml")
        # each split is computed once and written; every derived set is a filter of it
        flagged = keep(split_quantile(ml, "rating", KEYS, 0.1, seed, name="_h"), "holdout_flags")
        edx, final, removed = holdout_split(flagged, keep)
        flagged2 = keep(split_quantile(edx, "rating", KEYS, 0.8, seed, name="_t"), "train_flags")
        train, test, test0 = inner_split(flagged2)
        test = keep(test, "test")
        sets = RatingSets(ml, flagged2.drop("_t"), final, removed, train, test, test0)
        _SETS[key] = sets
        return sets
