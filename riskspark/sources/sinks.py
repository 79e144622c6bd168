"""Sinks: append-only logs, drift results and the drift reference table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of the log: the day of the rows, and the batch that wrote them.
DAY, BATCH = "log_day", "batch"


def append_log(rows: DataFrame, path: str) -> None:
    """Add rows to a plain log. Appending never reads or rewrites what is there; a retry adds the rows again."""
    rows.write.mode("append").parquet(path)


def append_batch(rows: DataFrame, path: str, batch: str, timestamp: str = "timestamp") -> None:
    """Add the rows of a batch to the performance log; the same batch written again replaces itself.

    Rows lie by day and batch, one file each. A batch writes its own folders and no other, so that appending
    never reads or rewrites what is there, a retry after a failure leaves the rows once, and a reader of recent rows
    opens the folders of recent days only. ``batch`` names the batch: letters, digits, ``-``, ``_`` and ``.``.
    Rows of a batch that is written again must cover the same days; those of a day it no longer has would stay.
    Rows without a timestamp lie in a folder of their own.
    """
    if not re.fullmatch(r"[A-Za-z0-9._-]+", batch):
        raise ValueError(f"The batch is named by letters, digits, '-', '_' and '.', not {batch!r}.")
    dated = rows.withColumns({DAY: F.to_date(timestamp), BATCH: F.lit(batch)})
    (
        dated.repartition(DAY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(DAY, BATCH).parquet(path)
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log; one that was written by batch also has ``log_day`` and ``batch``, and ``perflog.recent`` reads recent days only.

    Columns that only some batches have are NULL for the others.
    """
    log = spark.read.option("mergeSchema", "true").parquet(path)
    kinds = {c: F.col(c).cast(k) for c, k in ((DAY, "date"), (BATCH, "string")) if c in log.columns}
    return log.withColumns(kinds) if kinds else log


def append_aligned(log: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of both, matched by column name; a column only one of them has is NULL."""
    return log.unionByName(rows, allowMissingColumns=True)


def write_drift_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def save_reference(df: DataFrame, path: str) -> DataFrame:
    """Keep a table as the drift reference and hand back the stored copy."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
