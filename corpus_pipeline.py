"""The corpus pipeline: quality rules, near-duplicate removal, benchmark decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; its result is written as
Parquet below the shared checkpoint folder and read again as the next stage's documents.  All stages but the
last return the columns of ``documents``.

Null and empty texts fail the quality rules and go there; a table without rows passes through all stages; extra
columns pass unchanged up to the last stage; repeated rows are near duplicates of each other, and one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, packing, pii, quality, simhash
from tessera.llm.tables import materialize, read


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that are boilerplate of their host."""
    return quality.keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their benchmark passages; one that was nothing else goes."""
    return decontaminate.remove_contamination(docs, read(spark, sf_dir, "benchmark")).where(F.btrim("text") != "")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.mask_personal_data(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place in it."""
    return packing.digest(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: near-duplicate components and token ids are not expressible in SQL; the tests compare with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
