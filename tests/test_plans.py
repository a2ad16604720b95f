"""Plan properties that matter at scale, asserted on the physical plans."""

import pytest

import __spark_entry__ as entry

from .conftest import SF_SMALL

BAD = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")
KEYS = ["report_top3_distributors", "report_growth_quintile", "pivot_category", "fact_sales", "st_contains",
        "quakes_at_sea", "distance_join_polygon", "offshore_near_coast", "dissolve_outline", "bias_lambda_grid",
        "split_stratified", "oversample", "knn_regression", "roc_curve", "boxplot_stats", "first_per_key",
        "load_reconcile", "clip_by_hull", "kde_by_group", "histogram"]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", KEYS)
def test_no_quadratic_or_row_udf_operators(spark, key):
    plan = _plan(entry.queries()[key](spark, SF_SMALL))
    assert not [b for b in BAD if b in plan], plan


def test_filters_reach_the_scan_of_a_written_table(spark):
    from pyspark.sql import functions as F
    from tessera.plans.warehouse import load_star
    star = load_star(spark, SF_SMALL)
    df = star.dim_time.where(F.col("year").isin(1999, 2000)).select("time_id")
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(year" in text or "PushedFilters: [IsNotNull(year), In(year" in text, text


def test_scan_reads_only_the_needed_columns(spark):
    from tessera.sources.fixtures import fixture
    df = fixture(spark, SF_SMALL, "sell_orders_data")
    text = df._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in text.splitlines() if "lineitem" in line and "ReadSchema" in line]
    assert scans and all("l_tax" not in s and "l_shipdate" not in s and "l_returnflag" not in s for s in scans)


def test_year_filtered_report_prunes_fact_partitions(spark):
    from pyspark.sql import functions as F
    from tessera.plans.warehouse import load_star
    star = load_star(spark, SF_SMALL)
    df = star.fact_sales.where(F.col("sale_year").isin(1999, 2000)).select("car_dim_id")
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(sale_year" in text or "PartitionFilters: [sale_year" in text, text
