"""Classification (wine) and regression (fire) studies: preparation pipelines.

Order as in the reference: recode the target, sequential z-score filter (target
included), stratified 80/20 split, over-sample the training part only, fit the
scalers on the (over-sampled) training part and apply them to both parts.
"""

from __future__ import annotations

import hashlib
import threading
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cleaning import binarize_target, zscore_filter
from ..operators.sampling import oversample, split_random, split_stratified
from ..session import cache, folder_state, scratch_path, write_read
from ..sources.fixtures import SEED, fixture

WINE_FEATURES = [f"f{i}" for i in range(1, 12)]
FIRE_FEATURES = ["brightness", "radiative_power", "relative_humidity", "soil_water"]
# Region codes of the fire data and their names.
REGION_CODES = [(0, "NSW"), (1, "NT"), (2, "QL"), (3, "SA"), (4, "TA"), (5, "VI"), (6, "WA")]


def minmax_params(train: DataFrame, cols) -> dict[str, tuple[float, float]]:
    row = train.agg(*[F.min(c).alias(f"mn_{c}") for c in cols], *[F.max(c).alias(f"mx_{c}") for c in cols]).first()
    return {c: (row[f"mn_{c}"], row[f"mx_{c}"]) for c in cols}


def apply_minmax(df: DataFrame, params: dict) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(mn)) / F.lit((mx - mn) if mx != mn else 1.0)
                           for c, (mn, mx) in params.items()})


def standard_params(train: DataFrame, cols) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation (scikit-learn's StandardScaler)."""
    row = train.agg(*[F.avg(c).alias(f"mu_{c}") for c in cols], *[F.stddev_pop(c).alias(f"sd_{c}") for c in cols]).first()
    return {c: (row[f"mu_{c}"], row[f"sd_{c}"]) for c in cols}


def apply_standard(df: DataFrame, params: dict) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(mu)) / F.lit(sd if sd else 1.0) for c, (mu, sd) in params.items()})


def wine_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binarize_target(fixture(spark, sf_dir, "wine"), "quality", 5)


@dataclass(frozen=True)
class WineSets:
    clean: DataFrame
    train: DataFrame      # over-sampled
    test: DataFrame
    train_raw: DataFrame  # before over-sampling


_LOCK = threading.Lock()
_CACHE: dict[tuple, object] = cache()


def _keep(spark, base, df, name):
    return write_read(df, f"{base}/{name}")


def wine_sets(spark: SparkSession, sf_dir: str, seed: int = SEED) -> WineSets:
    key = ("wine", spark.sparkContext.applicationId, sf_dir, folder_state(spark, sf_dir), seed)
    with _LOCK:
        if key not in _CACHE:
            base = scratch_path(spark, "wine-" + hashlib.sha1(str(key).encode()).hexdigest()[:12])
            clean = _keep(spark, base, zscore_filter(wine_binary(spark, sf_dir), [*WINE_FEATURES, "quality"]), "clean")
            split = split_stratified(clean, ["row_id"], "quality", 0.2, seed)
            train_raw = _keep(spark, base, split.where(F.col("split") == "train").drop("split"), "train_raw")
            test = _keep(spark, base, split.where(F.col("split") == "test").drop("split"), "test")
            train = _keep(spark, base, oversample(train_raw, "quality", ["row_id"], seed), "train")
            _CACHE[key] = WineSets(clean, train, test, train_raw)
        return _CACHE[key]


@dataclass(frozen=True)
class FireSets:
    all: DataFrame
    train: DataFrame
    test: DataFrame


def fire_sets(spark: SparkSession, sf_dir: str, seed: int = SEED) -> FireSets:
    key = ("fire", spark.sparkContext.applicationId, sf_dir, folder_state(spark, sf_dir), seed)
    with _LOCK:
        if key not in _CACHE:
            base = scratch_path(spark, "fire-" + hashlib.sha1(str(key).encode()).hexdigest()[:12])
            fires = fixture(spark, sf_dir, "fires")
            split = split_random(fires, ["row_id"], 0.2, seed)
            train = _keep(spark, base, split.where(F.col("split") == "train").drop("split"), "train")
            test = _keep(spark, base, split.where(F.col("split") == "test").drop("split"), "test")
            _CACHE[key] = FireSets(fires, train, test)
        return _CACHE[key]
