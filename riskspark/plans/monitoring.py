"""Monitoring jobs: drift of a scored table and the performance log built from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from riskspark.operators.drift import drift_report, drift_summary, drift_tests
from riskspark.operators.perflog import batch_log
from riskspark.session import cut_lineage
from riskspark.sources.sinks import append_batch, write_drift_results


def check_drift(
    reference: DataFrame | None,
    current: DataFrame,
    columns: Sequence[str] | None = None,
    results_path: str | None = None,
    **limits,
) -> tuple[DataFrame, DataFrame]:
    """The report per column and its one-row summary; test results go to ``results_path``."""
    report = cut_lineage(drift_report(reference, current, columns, **limits))
    if results_path:
        write_drift_results(drift_tests(report), results_path)
    return report, drift_summary(report)


def log_scored(scored: DataFrame, timestamp: str, path: str, batch: str) -> None:
    """Add a batch of scored rows to the log; the same batch logged again replaces itself."""
    append_batch(batch_log(scored, timestamp), path, batch)
