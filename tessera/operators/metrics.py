"""Evaluation metrics as aggregates over a prediction DataFrame.

All metrics are one aggregate pass (ROC/AUC: one aggregate to distinct scores,
then a window over that much smaller table)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rmse(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """sqrt(mean((y - p)^2)) over rows with a prediction, and the count of missing ones."""
    err = F.col(label) - F.col(pred)
    return df.groupBy(*by).agg(F.sqrt(F.avg(err * err)).alias("rmse"),
                               F.sum(F.col(pred).isNull().cast("bigint")).alias("null_predictions"),
                               F.count(F.lit(1)).alias("n"))


def regression_metrics(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    err = F.col(label) - F.col(pred)
    return df.groupBy(*by).agg(F.avg(F.abs(err)).alias("mae"), F.avg(err * err).alias("mse"),
                               F.sqrt(F.avg(err * err)).alias("rmse"), F.count(F.lit(1)).alias("n"))


def accuracy(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"),
                               F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, label: str, pred: str, classes=(0, 1)) -> DataFrame:
    """Rows: actual class, one for every class even without rows; columns pred_<c>; zero-filled."""
    counts = df.groupBy(F.col(label).alias("actual")).pivot(pred, list(classes)).count()
    kind = df.schema[label].dataType
    absent = df.sparkSession.createDataFrame([(str(c),) for c in classes], "actual string") \
        .select(F.col("actual").cast(kind).alias("actual")).join(counts.select("actual"), "actual", "left_anti")
    return counts.unionByName(absent, allowMissingColumns=True) \
        .select("actual", *[F.coalesce(F.col(str(c)), F.lit(0)).cast("bigint").alias(f"pred_{c}") for c in classes])


def classification_report(df: DataFrame, label: str, pred: str, classes=(0, 1)) -> DataFrame:
    """precision, recall, F1, support per class + macro and weighted averages (0 when a
    divisor is 0, as scikit-learn's zero_division default reports)."""
    aggs = []
    for c in classes:
        aggs += [F.sum(((F.col(label) == c) & (F.col(pred) == c)).cast("double")).alias(f"tp{c}"),
                 F.sum((F.col(pred) == c).cast("double")).alias(f"pp{c}"),
                 F.sum((F.col(label) == c).cast("double")).alias(f"ap{c}")]
    row = df.agg(*aggs)
    rows = []
    for c in classes:
        p = F.when(F.col(f"pp{c}") > 0, F.col(f"tp{c}") / F.col(f"pp{c}")).otherwise(0.0)
        r = F.when(F.col(f"ap{c}") > 0, F.col(f"tp{c}") / F.col(f"ap{c}")).otherwise(0.0)
        f1 = F.when((p + r) > 0, 2 * p * r / (p + r)).otherwise(0.0)
        rows.append(F.struct(F.lit(str(c)).alias("class"), p.alias("precision"), r.alias("recall"),
                             f1.alias("f1"), F.col(f"ap{c}").alias("support")))
    per = row.select(F.explode(F.array(*rows)).alias("s")).select("s.*")
    summary = per.agg(
        F.struct(F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"),
                 F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.sum("support").alias("support")).alias("m"),
        F.struct(F.lit("weighted avg").alias("class"),
                 (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("precision"),
                 (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("recall"),
                 (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1"),
                 F.sum("support").alias("support")).alias("w"))
    return per.unionByName(summary.select("m.*")).unionByName(summary.select("w.*"))


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, highest first.  Aggregate to distinct
    scores, then a distributed prefix sum over descending thresholds (no single-task
    window even when every score is distinct)."""
    from .windows import global_cumsum
    per = df.groupBy(F.col(score).alias("threshold")).agg(
        F.sum(F.col(label).cast("double")).alias("tp"), F.sum((1 - F.col(label)).cast("double")).alias("fp"))
    tot = per.agg(F.sum("tp").alias("P"), F.sum("fp").alias("N")).first()
    cum = global_cumsum(per, [F.col("threshold").desc()], ["tp", "fp"])
    P, N = tot["P"] or 0.0, tot["N"] or 0.0
    return cum.select(F.col("threshold").cast("double"),
                      (F.col("cum_fp") / F.lit(N) if N > 0 else F.lit(None).cast("double")).alias("fpr"),
                      (F.col("cum_tp") / F.lit(P) if P > 0 else F.lit(None).cast("double")).alias("tpr"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Rank-sum AUC with average ranks for ties (Mann–Whitney), exact (no score binning).
    The rows below each distinct score come from a distributed prefix sum."""
    from .windows import global_cumsum
    per = df.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("double")).alias("pos"),
                                                  F.count(F.lit(1)).alias("cnt"))
    cum = global_cumsum(per, [F.col("s")], ["cnt"])
    ranked = cum.withColumn("avg_rank", (F.col("cum_cnt") - F.col("cnt")) + (F.col("cnt") + 1) / 2.0)
    agg = ranked.agg(F.sum(F.col("pos") * F.col("avg_rank")).alias("rsum"), F.sum("pos").alias("P"),
                     F.sum("cnt").alias("n"))
    nneg = F.col("n") - F.col("P")
    return agg.select(F.when((F.col("P") > 0) & (nneg > 0),
                             (F.col("rsum") - F.col("P") * (F.col("P") + 1) / 2.0) / (F.col("P") * nneg))
                      .alias("auc"))


def log_loss(df: DataFrame, label: str, prob: str, eps: float = 1e-7) -> DataFrame:
    p = F.least(F.greatest(F.col(prob), F.lit(eps)), F.lit(1 - eps))
    y = F.col(label).cast("double")
    return df.agg(F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"))


def evaluate(df: DataFrame, label: str, pred: str, prob: str, classes=(0, 1)) -> DataFrame:
    """One row of all scores of a binary classifier's predictions: n, accuracy, precision, recall and F1 (averages
    weighted by class size), auc and log_loss."""
    report = classification_report(df, label, pred, classes).where(F.col("class") == "weighted avg").select("precision", "recall", "f1")
    parts = [accuracy(df, label, pred).select("accuracy", F.col("n").cast("bigint").alias("n")), report, roc_auc(df, label, prob), log_loss(df, label, prob)]
    values = {}
    for part in parts:
        values |= part.first().asDict()  # one row each
    names = ["n", "accuracy", "precision", "recall", "f1", "auc", "log_loss"]
    return df.sparkSession.createDataFrame([tuple(values[c] for c in names)], ", ".join(f"{c} {'bigint' if c == 'n' else 'double'}" for c in names))
