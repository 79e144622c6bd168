"""Metrics of model versions, computed from their predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark import config
from riskspark.functions.columns import finite
from riskspark.operators.metrics import auc_of_counts, f1_by, rates, roc_auc
from riskspark.session import cut_lineage

METRICS = ("f1", "roc_auc")


def metric_rows(
    predictions: DataFrame,
    label: str = "y_true",
    score: str = "p1",
    threshold: float = config.DECISION_THRESHOLD,
) -> DataFrame:
    """``version, registered_at, metric, value``: one row per version and metric."""
    by = ["version", "registered_at"]
    f1 = f1_by(predictions, label, score, by, threshold)
    auc = roc_auc(predictions, label, score, by)
    return f1.select(*by, F.lit("f1").alias("metric"), F.col("f1").alias("value")).unionByName(
        auc.select(*by, F.lit("roc_auc").alias("metric"), F.col("roc_auc").alias("value"))
    )


def score_counts(predictions: DataFrame, label: str = "y_true", score: str = "p1") -> DataFrame:
    """Positives and negatives per version and distinct score: all that F1 and ROC-AUC follow from.

    Rows without a score are one more entry: they count as not predicted in F1 and not at all in ROC-AUC.
    """
    y = F.col(label)
    return predictions.groupBy("version", "registered_at", finite(predictions, score).alias("score")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))


def add_score_counts(
    predictions: DataFrame, path: str, batch: str, label: str = "y_true", score: str = "p1"
) -> None:
    """Add new predictions to a stored table of counts, in one read of them.

    The counts lie by batch; a batch that is sent again replaces itself. Counts of batches add up.
    """
    counts = score_counts(predictions, label, score).withColumn("batch", F.lit(batch))
    writer = counts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("batch").parquet(path)


def read_score_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("batch")


def metrics_of_counts(counts: DataFrame, threshold: float = config.DECISION_THRESHOLD) -> DataFrame:
    """The rows of ``metric_rows`` from counts per score. No prediction is read again.

    Scores are ranked bucket by bucket of the score, as for single rows; a score that many batches have is added up first.
    """
    by = ["version", "registered_at"]
    merged = cut_lineage(counts.groupBy(*by, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "scores")
    said = F.coalesce(F.col("score") >= threshold, F.lit(False))
    cells = merged.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(said, F.col("pos"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(said, F.col("neg"))), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.when(~said, F.col("pos"))), F.lit(0)).alias("fn"),
        F.coalesce(F.sum(F.when(~said, F.col("neg"))), F.lit(0)).alias("tn"))
    f1 = rates(cells)
    auc = auc_of_counts(merged.where("score IS NOT NULL"), by, "score")
    return f1.select(*by, F.lit("f1").alias("metric"), F.col("f1").alias("value")).unionByName(
        auc.select(*by, F.lit("roc_auc").alias("metric"), F.col("roc_auc").alias("value")))


def metric_history(rows: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """One row per version with ``metric_<name>`` columns, newest first."""
    wide = rows.groupBy("version", "registered_at").pivot("metric", list(metrics)).agg(F.max("value"))
    return wide.select(
        "version", "registered_at", *[F.col(m).alias(f"metric_{m}") for m in metrics]
    ).orderBy(F.desc("registered_at"), "version")


def compare_versions(rows: DataFrame, first: str, second: str) -> DataFrame:
    """``metric, version1, version2, improvement`` over the metrics either version has.

    A missing metric stays missing in its column and counts as 0 in the difference.
    """
    # One row per version and metric: stored, so that the metrics are computed once.
    rows = cut_lineage(rows.filter(F.col("version").isin(first, second)), "metrics")
    known = {r["version"] for r in rows.select("version").distinct().collect()}
    for version in (first, second):
        if version not in known:
            raise ValueError(f"No metrics are known of version {version}.")
    sides = [
        rows.filter(F.col("version") == version).select("metric", F.col("value").alias(name))
        for version, name in ((first, "version1"), (second, "version2"))
    ]
    zero = F.lit(0.0)
    return (
        sides[0]
        .join(sides[1], "metric", "full_outer")
        .withColumn("improvement", F.coalesce("version2", zero) - F.coalesce("version1", zero))
    )
