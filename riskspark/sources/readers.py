"""Readers (CSV, JSON records, parquet) that return lazy DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.sources.schemas import LOAN_SCHEMA, MISSING_TOKENS


def read_loans_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType = LOAN_SCHEMA,
    keep_others: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """Read a loan CSV, or every file of a folder; ``.csv.gz`` works too.

    Columns are found by header name. The missing-value tokens become NULL and the columns
    of ``schema`` are cast strictly; ``keep_others`` passes further columns along as text.
    Files whose headers differ are refused. A gzip file is one task however big it is;
    ``partitions`` spreads its rows before anything else is done with them.
    """
    header = spark.read.csv(path, header=True).columns
    text = T.StructType([T.StructField(name, T.StringType()) for name in header])
    raw = spark.read.schema(text).csv(path, header=True, enforceSchema=False)
    if partitions:
        raw = raw.repartition(partitions)
    types = {f.name: f.dataType for f in schema}
    return raw.select([
        F.when(~F.col(name).isin(*MISSING_TOKENS), F.col(name))
        .cast(types.get(name, T.StringType()))
        .alias(name)
        for name in header
        if keep_others or name in types
    ])


def read_first_rows(df: DataFrame, n: int, order: str | None = None) -> DataFrame:
    """The first ``n`` rows; with ``order`` the choice is the same on every run."""
    return df.orderBy(order).limit(n) if order else df.limit(n)


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON records, one per line. A record that does not parse keeps its text."""
    wide = T.StructType(list(schema.fields) + [T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(wide).json(path, mode="PERMISSIVE")


def read_reference(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A drift reference from CSV, typed as the table that will be compared with it."""
    return read_loans_csv(spark, path, like.schema)
