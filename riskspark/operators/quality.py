"""Data quality: missing values, leaking columns, and the column rules built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark import config
from riskspark.functions.columns import is_missing


def leakage_columns(
    columns: Sequence[str], keywords: Sequence[str] = config.LEAKAGE_KEYWORDS
) -> list[str]:
    """Columns whose lower-cased name contains a keyword, in table order. Reads no data."""
    return [c for c in columns if any(k in c.lower() for k in keywords)]


def drop_leakage(df: DataFrame, keywords: Sequence[str] = config.LEAKAGE_KEYWORDS) -> DataFrame:
    return df.drop(*leakage_columns(df.columns, keywords))


def missing_counts(df: DataFrame) -> DataFrame:
    """One row per column: ``column``, ``missing_count``, ``rows``.

    All columns are counted in a single aggregate, so the table is read once and only one
    partial row per task is shuffled.
    """
    counts = df.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count_if(is_missing(df, c)).alias(c) for c in df.columns],
    )
    return counts.unpivot(["__rows"], list(df.columns), "column", "missing_count").select(
        "column", "missing_count", F.col("__rows").alias("rows")
    )


def missing_profile(df: DataFrame) -> DataFrame:
    """Missing count and percent (2 places) per column."""
    percent = F.bround(F.try_divide(F.col("missing_count") * 100.0, F.col("rows")), 2)
    return missing_counts(df).select("column", "missing_count", percent.alias("missing_percent"))


def most_missing(df: DataFrame, n: int = 20) -> DataFrame:
    return missing_profile(df).orderBy(F.desc("missing_percent"), "column").limit(n)


def high_missing_profile(df: DataFrame, percent: float = 100 * config.MISSING_LIMIT) -> DataFrame:
    """The report's view: rounded percent strictly above the limit."""
    return missing_profile(df).filter(F.col("missing_percent") > percent)


def high_missing_columns(df: DataFrame, limit: float = config.MISSING_LIMIT) -> list[str]:
    """Names of the columns whose missing share is strictly above ``limit``."""
    rows = missing_counts(df).filter(F.col("missing_count") > F.col("rows") * F.lit(limit))
    found = {r["column"] for r in rows.select("column").collect()}
    return [c for c in df.columns if c in found]


def drop_high_missing(df: DataFrame, limit: float = config.MISSING_LIMIT) -> DataFrame:
    return df.drop(*high_missing_columns(df, limit))


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "columns", F.lit(len(df.columns)).cast("long")
    )
