"""Where queries register themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from workload.views import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query, with the SQL DuckDB can check it against if there is one."""

    def register(run: Query) -> Query:
        def prepared(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return run(spark, folder)

        QUERIES[name] = prepared
        if oracle is not None:
            ORACLES[name] = with_views(oracle, *views) if views else oracle.strip()
        return run

    return register


def rounded(df: DataFrame, places: int = 6, *columns: str) -> DataFrame:
    """Round the named (default: all) double columns; sums of doubles differ in the last digits."""
    chosen = columns or [f.name for f in df.schema if f.dataType.simpleString() == "double"]
    return df.withColumns({c: F.round(c, places) for c in chosen})


def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def r6(column: Column) -> Column:
    return F.round(column, 6)
