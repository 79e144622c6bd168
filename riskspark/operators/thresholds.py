"""Decision thresholds against business cost."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark import config
from riskspark.functions.columns import null_double
from riskspark.operators.metrics import rates

SWEEP_COLUMNS = (
    "threshold", "precision", "recall", "f1", "cost", "youden", "tp", "fp", "tn", "fn",
)


def threshold_grid(start: float = 0.1, stop: float = 0.9, step: float = 0.01) -> list[float]:
    """The floats of an evenly stepped range, bit for bit as array libraries produce them.

    They add multiples of ``(start + step) - start``, which is not exactly ``step``.
    """
    delta = (start + step) - start
    return [start + i * delta for i in range(math.ceil((stop - start) / step))]


def _by_bucket(
    df: DataFrame, label: str, score: str, thresholds: Sequence[float], by: Sequence[str]
) -> DataFrame:
    """Class counts per score bucket; a bucket number is how many thresholds the score reaches."""
    infinity = float("inf")
    lowest = F.lit(-infinity)
    value = F.coalesce(F.nanvl(F.col(score).cast("double"), null_double()), lowest)
    rows = df.select(*by, F.col(label).alias("y"), value.alias("s"))
    return (
        Bucketizer(
            inputCol="s", outputCol="b", splits=[-infinity, *thresholds, infinity], handleInvalid="keep"
        )
        .transform(rows)
        .groupBy(*by, F.col("b").cast("int").alias("b"))
        .agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    )


def confusion_at(
    df: DataFrame, label: str, score: str, thresholds: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """tn, fp, fn, tp at every threshold (ascending, distinct), from one pass over the rows.

    Each score is looked up once by binary search. What is shuffled are the class counts of at
    most ``len(thresholds) + 1`` buckets per task; a bucket with number b then counts as
    predicted positive at the first b thresholds. No row is paired with every threshold.
    """
    grid = sorted(set(float(t) for t in thresholds))
    buckets = _by_bucket(df, label, score, grid, by)
    spread = buckets.withColumn(
        "t", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("v")) for i, t in enumerate(grid)]))
    )
    passed = F.col("t.i") < F.col("b")

    def total(column: str, chosen: Column) -> Column:
        return F.sum(F.when(chosen, F.col(column)).otherwise(F.lit(0)))

    return spread.groupBy(*by, F.col("t.v").alias("threshold")).agg(
        total("neg", ~passed).alias("tn"),
        total("neg", passed).alias("fp"),
        total("pos", ~passed).alias("fn"),
        total("pos", passed).alias("tp"),
    )


def _cost(cost_fp: float, cost_fn: float) -> Column:
    return F.col("fp") * F.lit(cost_fp) + F.col("fn") * F.lit(cost_fn)


def threshold_sweep(
    df: DataFrame,
    label: str,
    score: str,
    cost_fp: float = config.COST_FALSE_POSITIVE,
    cost_fn: float = config.COST_FALSE_NEGATIVE,
    thresholds: Sequence[float] | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """All threshold metrics at the 80 grid points (or at ``thresholds``)."""
    counts = confusion_at(df, label, score, thresholds or threshold_grid(), by)
    return rates(counts).withColumn("cost", _cost(cost_fp, cost_fn)).select(*by, *SWEEP_COLUMNS)


def best_threshold(sweep: DataFrame, metric: str = "cost", by: Sequence[str] = ()) -> DataFrame:
    """The sweep row with the lowest cost, or the highest f1 or youden; ties go to the lowest threshold."""
    whole = F.struct(*SWEEP_COLUMNS)
    if metric == "cost":
        pick = F.min_by(whole, F.struct(F.col("cost"), F.col("threshold")))
    elif metric in ("f1", "youden"):
        pick = F.max_by(whole, F.struct(F.col(metric), -F.col("threshold")))
    else:
        raise ValueError(f"The best threshold is by cost, f1 or youden, not by {metric}.")
    return sweep.groupBy(*by).agg(pick.alias("best")).select(*by, "best.*")


def optimal_threshold(sweep: DataFrame, metric: str = "cost") -> float:
    row = best_threshold(sweep, metric).first()
    return row["threshold"]


def compare_thresholds(
    df: DataFrame,
    label: str,
    score: str,
    thresholds: Sequence[float] = (0.3, 0.5, 0.7),
    cost_fp: float = config.COST_FALSE_POSITIVE,
    cost_fn: float = config.COST_FALSE_NEGATIVE,
) -> DataFrame:
    """Metrics with the nested confusion matrix at a few thresholds, in one pass."""
    counts = rates(confusion_at(df, label, score, thresholds))
    return counts.select(
        "threshold",
        "precision",
        "recall",
        "f1",
        _cost(cost_fp, cost_fn).alias("total_cost"),
        F.struct("tn", "fp", "fn", "tp").alias("confusion_matrix"),
    )


def evaluate_at_threshold(
    df: DataFrame,
    label: str,
    score: str,
    threshold: float | None,
    cost_fp: float = config.COST_FALSE_POSITIVE,
    cost_fn: float = config.COST_FALSE_NEGATIVE,
) -> DataFrame:
    if threshold is None:
        raise ValueError("No threshold given. Take one from best_threshold().")
    return compare_thresholds(df, label, score, (threshold,), cost_fp, cost_fn)


def compact(comparison: DataFrame) -> DataFrame:
    return comparison.select("threshold", "precision", "recall", "f1", "total_cost")
