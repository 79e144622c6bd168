"""Sorted dictionaries: the rank of every distinct value of a column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskspark.session import cut_lineage


def distinct_categories(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, value`` for every distinct text value; missing counts as ``'missing'``.

    The distinct is combined per task, so a value held by many rows is shuffled once per task.
    """
    entries = F.array(*[
        F.struct(
            F.lit(c).alias("column"),
            F.coalesce(F.col(c).cast("string"), F.lit("missing")).alias("value"),
        )
        for c in columns
    ])
    return df.select(F.inline(entries)).distinct()


def group_sizes(df: DataFrame, by: str) -> dict[str, int]:
    """Rows per group; for tables with few groups, such as one per column."""
    return {r[by]: r["n"] for r in df.groupBy(by).agg(F.count("*").alias("n")).collect()}


def rank_within(
    df: DataFrame, by: str, value: str, name: str, largest: int, group_limit: int = 1_000_000
) -> DataFrame:
    """Add ``name``: the 0-based rank of ``value`` inside each ``by`` group of distinct rows.

    If the ``largest`` group has up to ``group_limit`` rows, one window ranks each. A longer group (a text
    column with nearly as many values as rows) is range-partitioned first, ranked inside each
    range, and shifted by the sizes of the ranges before it. The ranges are written out before
    they are counted, so a task that is run again sees the same ranges.
    """
    small = Window.partitionBy(by).orderBy(value)
    if largest <= group_limit:
        return df.withColumn(name, (F.row_number().over(small) - 1).cast("long"))

    ranged = cut_lineage(
        df.repartitionByRange(by, value).withColumn("__range", F.spark_partition_id())
    )
    before = Window.partitionBy(by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        ranged.groupBy(by, "__range")
        .agg(F.count("*").alias("n"))
        .select(by, "__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))
    )
    inside = Window.partitionBy(by, "__range").orderBy(value)
    return (
        ranged.withColumn("__rank", F.row_number().over(inside) - 1)
        .join(sizes, [by, "__range"])
        .withColumn(name, (F.col("__rank") + F.col("__offset")).cast("long"))
        .drop("__range", "__rank", "__offset")
    )


def category_dictionary(
    df: DataFrame, columns: Sequence[str], group_limit: int = 1_000_000
) -> tuple[DataFrame, dict[str, int]]:
    """``column, value, code`` with codes in sorted value order, from 0, and entries per column.

    The distinct values are stored, so that ``df`` is read once.
    """
    values = cut_lineage(distinct_categories(df, columns), "categories")
    sizes = group_sizes(values, "column")
    largest = max(sizes.values(), default=0)
    return rank_within(values, "column", "value", "code", largest, group_limit), sizes
