"""Exploratory reports over the whole table, each in one or two passes."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark import config
from riskspark.functions.columns import available, binary_label, finite, numeric_columns, present
from riskspark.operators.quality import high_missing_profile, leakage_columns


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first, missing values left out."""
    return (
        df.select(present(df, column).alias(column))
        .filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), column)
    )


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct non-missing values per column, exact."""
    counts = df.agg(*[F.count_distinct(present(df, c)).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column", "distinct_values")


def class_balance(df: DataFrame, label: str = "default") -> DataFrame:
    """Share of positives r and the imbalance ratio (1-r)/r."""
    rate = F.avg(F.col(label).cast("double"))
    return df.agg(rate.alias("default_rate")).withColumn(
        "imbalance_ratio", F.try_divide(1 - F.col("default_rate"), F.col("default_rate"))
    )


def value_ranges(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Smallest and largest finite value per column, in one pass. Columns without any are left out."""
    bounds = [F.min(finite(df, c)).alias(f"{c}__lo") for c in columns]
    bounds += [F.max(finite(df, c)).alias(f"{c}__hi") for c in columns]
    row = df.agg(*bounds).first()
    return {c: (row[f"{c}__lo"], row[f"{c}__hi"]) for c in columns if row[f"{c}__lo"] is not None}


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 50) -> DataFrame:
    """Equal-width histogram of each column: ``feature, bin, bin_start, bin_end, count``.

    A pass for the ranges, then one for the counts. Rows are combined to at most
    ``bins`` x ``len(columns)`` groups per task before the shuffle. Empty bins are not listed.
    """
    ranges = value_ranges(df, columns)
    parts = []
    for name, (low, high) in ranges.items():
        if low == high:
            low, high = low - 0.5, high + 0.5
        value = finite(df, name)
        step = F.floor((value - F.lit(low)) / F.lit(high - low) * F.lit(bins)).cast("int")
        parts.append(
            F.struct(
                F.lit(name).alias("feature"),
                # least() alone would skip a missing value and put it into the last bin.
                F.when(step.isNotNull(), F.least(step, F.lit(bins - 1))).alias("bin"),
                F.lit(low).alias("low"),
                F.lit((high - low) / bins).alias("width"),
            )
        )
    if not parts:
        empty = "feature string, bin int, bin_start double, bin_end double, count long"
        return df.sparkSession.createDataFrame([], empty)
    counts = (
        df.select(F.inline(F.array(*parts)))
        .filter(F.col("bin").isNotNull())
        .groupBy("feature", "bin", "low", "width")
        .agg(F.count("*").alias("count"))
    )
    start = F.col("low") + F.col("bin") * F.col("width")
    return counts.select(
        "feature", "bin", start.alias("bin_start"), (start + F.col("width")).alias("bin_end"), "count"
    )


def pearson(x: Column, y: Column) -> Column:
    """Pearson correlation over the rows where both sides are present.

    NULL when a side is constant, where the built-in ``corr`` divides by zero.
    """
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), spread)


def correlation_with(
    df: DataFrame, target: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """Correlation of each numeric column (or the given ones) with ``target``, all in one aggregate."""
    chosen = list(columns) if columns else numeric_columns(df)
    # Every column is cleaned once per row, below the aggregate that uses it several times.
    rows = df.select(*[finite(df, c).alias(c) for c in dict.fromkeys([*chosen, target])])
    wide = rows.agg(*[pearson(F.col(c), F.col(target)).alias(c) for c in chosen])
    return wide.unpivot([], chosen, "feature", "correlation")


def strongest(correlations: DataFrame, n: int = 10) -> DataFrame:
    return (
        correlations.filter(F.col("correlation").isNotNull())
        .orderBy(F.desc("correlation"), "feature")
        .limit(n)
    )


def weakest(correlations: DataFrame, n: int = 10) -> DataFrame:
    return (
        correlations.filter(F.col("correlation").isNotNull())
        .orderBy("correlation", F.desc("feature"))
        .limit(n)
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Full symmetric matrix in long form; each pair is computed once."""
    names = available(df, columns)
    pairs = list(combinations(names, 2)) + [(c, c) for c in names]
    at = {c: f"c{i}" for i, c in enumerate(names)}
    rows = df.select(*[finite(df, c).alias(at[c]) for c in names])
    # On the diagonal only whether a column varies at all matters.
    entries = [
        F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), (
            pearson(F.col(at[a]), F.col(at[b])) if a != b else F.when(F.max(at[a]) > F.min(at[a]), F.lit(1.0))
        ).alias("correlation"))
        for a, b in pairs
    ]
    long = rows.agg(F.array(*entries).alias("entries")).select(F.inline("entries"))
    mirror = long.filter("feature_a <> feature_b").select(
        F.col("feature_b").alias("feature_a"), F.col("feature_a").alias("feature_b"), "correlation"
    )
    return long.unionByName(mirror)


def eda_summary(
    df: DataFrame,
    status: str = config.TARGET,
    positives: Sequence[str] = config.EDA_DEFAULT_STATUSES,
    keywords: Sequence[str] = config.EDA_LEAKAGE_KEYWORDS,
) -> DataFrame:
    """One row: rows, columns, default rate, leaking columns, columns mostly missing."""
    sparse = high_missing_profile(df).agg(F.count("*").alias("n"))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(binary_label(df, status, positives).cast("double")).alias("default_rate"),
    ).select(
        "rows",
        F.lit(len(df.columns)).cast("long").alias("columns"),
        "default_rate",
        F.lit(len(leakage_columns(df.columns, keywords))).cast("long").alias("leakage_columns"),
        sparse.scalar().alias("high_missing_columns"),
    )
