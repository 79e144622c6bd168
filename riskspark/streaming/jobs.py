"""Structured Streaming: scoring, the performance log as a windowed aggregate, drift per batch."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from riskspark.operators.drift import drift_report_against, drift_summary, prepare_reference
from riskspark.operators.perflog import log_columns, log_sums
from riskspark.operators.preprocess import Preprocessor
from riskspark.plans.scoring import score
from riskspark.session import intermediates

#: Work through what is there and end. ``{"processingTime": "1 minute"}`` goes on for ever.
ONCE = {"availableNow": True}


def stream_scores(
    applications: DataFrame,
    state: Preprocessor,
    model: Model,
    keep: Sequence[str],
    path: str,
    checkpoint: str,
    trigger: Mapping[str, object] = ONCE,
) -> StreamingQuery:
    """Score a stream of applications into an append-only table; each record is scored once."""
    return (
        score(applications, state, model, keep, lenient=True)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def windowed_log(
    scored: DataFrame,
    time: str,
    window: str = "1 day",
    slide: str | None = None,
    late: str = "1 hour",
    prediction: str = "prediction",
    p1: str = "p1",
    p0: str | None = "p0",
) -> DataFrame:
    """The performance log as tumbling or sliding windows of event time.

    State is one running aggregate per open window; rows more than ``late`` behind the newest
    are dropped. Sliding windows are added up from tumbling ones as long as the slide: a row is
    then aggregated once, not once per window it belongs to. The same frame works on a batch
    table, where the watermark has no effect.
    """
    timed = scored.withColumn("__time", F.col(time).cast("timestamp")).withWatermark("__time", late)
    stepwise = slide is not None and _multiple(window, slide)
    if slide is None or stepwise:
        first = F.window("__time", slide or window)
    else:
        first = F.window("__time", window, slide)
    sums = timed.groupBy(first.alias("w")).agg(*log_sums(prediction, p1, p0))
    if stepwise:
        whole = F.window(F.window_time("w"), window, slide)
        sums = sums.groupBy(whole.alias("w")).agg(*[F.sum(c).alias(c) for c in ("n", "p", "r", "c")])
    return sums.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *log_columns()
    )


SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def _multiple(window: str, slide: str) -> bool:
    """Whether a window such as ``1 day`` is a whole number of slides such as ``1 hour``."""
    sizes = []
    for text in (window, slide):
        number, _, unit = text.strip().partition(" ")
        unit = unit.strip().lower().removesuffix("s")
        if not number.isdigit() or unit not in SECONDS:
            return False
        sizes.append(int(number) * SECONDS[unit])
    return sizes[0] % sizes[1] == 0


def stream_log(
    log: DataFrame, path: str, checkpoint: str, trigger: Mapping[str, object] = ONCE
) -> StreamingQuery:
    """Append each window to the log once, when it is closed."""
    return (
        log.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def stream_drift(
    current: DataFrame,
    reference: DataFrame,
    columns: Sequence[str],
    path: str,
    checkpoint: str,
    trigger: Mapping[str, object] = ONCE,
    **limits,
) -> StreamingQuery:
    """Compare every micro-batch with a fixed reference; one summary row per batch.

    The values of the reference are counted once, when the stream starts; its rows are not read again. A batch adds the
    counts of its own values. It writes its own folder, so that a batch that is run again replaces its result.
    """
    numeric = [f.name for f in current.schema if isinstance(f.dataType, T.NumericType)]
    prepared = prepare_reference(reference, columns, numeric)

    def compare(batch: DataFrame, batch_id: int) -> None:
        with intermediates(batch.sparkSession):
            summary = drift_summary(drift_report_against(prepared, batch.select(*columns), **limits))
            summary.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        current.writeStream.foreachBatch(compare)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
