"""Performance log: one row per batch of predictions, and statistics over recent rows."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark import config
from riskspark.sources.sinks import DAY


def log_sums(prediction: str = "prediction", p1: str = "p1", p0: str | None = "p0") -> list[Column]:
    """What the log row is made of, as sums that can be added up again."""
    confidence = F.greatest(F.col(p0), F.col(p1)) if p0 else F.col(p1)
    return [
        F.count(F.lit(1)).alias("n"),
        F.sum(p1).alias("p"),
        F.sum(F.col(prediction).cast("double")).alias("r"),
        F.sum(confidence).alias("c"),
    ]


def log_columns() -> list[Column]:
    """The log row from its sums."""
    return [
        F.col("n").alias("num_predictions"),
        *[
            F.try_divide(F.col(total), F.col("n").cast("double")).alias(name)
            for total, name in (("p", "mean_probability"), ("r", "prediction_rate"), ("c", "avg_confidence"))
        ],
    ]


def batch_log(
    df: DataFrame,
    timestamp: str | Column,
    prediction: str = "prediction",
    p1: str = "p1",
    p0: str | None = "p0",
) -> DataFrame:
    """One log row per distinct ``timestamp`` (the batch).

    With one probability only (``p0=None``) confidence is that probability.
    """
    when = F.col(timestamp) if isinstance(timestamp, str) else timestamp
    sums = df.groupBy(when.alias("timestamp")).agg(*log_sums(prediction, p1, p0))
    return sums.select("timestamp", *log_columns())


def recent(log: DataFrame, as_of: datetime | str, days: int = config.LOG_DAYS) -> DataFrame:
    """Rows from ``days`` days before ``as_of`` on, that instant included.

    Of a log that lies by day (``sources.sinks``) only the folders of those days are read.
    """
    kind = log.schema["timestamp"].dataType.simpleString()
    start = F.lit(as_of).cast(kind) - F.make_dt_interval(F.lit(days))
    rows = log.filter(F.col("timestamp") >= start)
    return rows.filter(F.col(DAY) >= start.cast("date")) if DAY in log.columns else rows


def performance_stats(
    log: DataFrame, as_of: datetime | str, days: int = config.LOG_DAYS, weighted: bool = False
) -> DataFrame:
    """One row of totals over the recent log, no row if there is nothing in it.

    Averages are over log rows; ``weighted`` counts each row with its predictions.
    """
    if weighted:
        def mean(name: str) -> Column:
            share = F.sum(F.col(name) * F.col("num_predictions"))
            return F.try_divide(share, F.sum("num_predictions").cast("double"))
    else:
        mean = F.avg
    return (
        recent(log, as_of, days)
        .agg(
            F.sum("num_predictions").alias("total_predictions"),
            mean("prediction_rate").alias("avg_prediction_rate"),
            mean("avg_confidence").alias("avg_confidence"),
            F.count(F.lit(1)).alias("__rows"),
        )
        .filter("__rows > 0")
        .drop("__rows")
        .withColumn("days_monitored", F.lit(days).cast("long"))
    )


def parse_timestamps(df: DataFrame, columns: Sequence[str] = ("timestamp",)) -> DataFrame:
    return df.withColumns({c: F.to_timestamp(c) for c in columns})
