"""Running totals over a sorted value without a one-task window.

``Window.orderBy(value)`` without a partition key puts every row into one task. Here the value
axis is cut into buckets of about equal row counts; rows are first combined to one row per
distinct value, a window runs inside each bucket, and the totals of the buckets to the left
are added. A value that holds a large share of the rows collapses to a single row before
anything is sorted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import Window, WindowSpec
from pyspark.sql import functions as F

from riskspark.functions.columns import finite
from riskspark.operators.marks import quantile_marks


def bucket_number(df: DataFrame) -> int:
    """A few buckets per shuffle partition, so that partitions get about equal shares."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(8, min(4 * partitions, 2000))


def cut_points(
    df: DataFrame, columns: Sequence[str], buckets: int | None = None
) -> dict[str, list[float]]:
    """Approximate quantiles of each column, taken in one pass over the table.

    At most ``buckets - 1`` numbers per column reach the driver. They only decide where a
    bucket ends, so their error has no effect on results.
    """
    n = buckets or bucket_number(df)
    shares = [i / n for i in range(1, n)]
    found, _, _ = quantile_marks(df, {c: finite(df, c) for c in columns}, shares)
    return {c: sorted(set(found[c])) for c in columns}


def add_buckets(df: DataFrame, cuts: Mapping[str, Sequence[float]], suffix: str = "__bucket") -> DataFrame:
    """Add the bucket number of each column: how many of its cut points are at or below the value.

    The lookup is a binary search in the JVM. Missing values must have been replaced before.
    """
    infinity = float("inf")
    names = [c for c in cuts if cuts[c]]
    out = df.withColumns({f"{c}{suffix}": F.lit(0) for c in cuts if not cuts[c]})
    if not names:
        return out
    found = Bucketizer(
        inputCols=names,
        outputCols=[f"{c}{suffix}" for c in names],
        splitsArray=[[-infinity, *cuts[c], infinity] for c in names],
        handleInvalid="keep",
    ).transform(out)
    # Never NULL: otherwise a join on the bucket filters each side on its own, and the two
    # sides of running_totals no longer start from the same shuffle.
    return found.withColumns(
        {f"{c}{suffix}": F.coalesce(F.col(f"{c}{suffix}").cast("int"), F.lit(0)) for c in names}
    )


def smaller_in_bucket(by: Sequence[str], bucket: str, value: str) -> WindowSpec:
    """The rows of the same bucket with a smaller value."""
    inside = Window.partitionBy(*by, bucket).orderBy(value)
    return inside.rowsBetween(Window.unboundedPreceding, -1)


def earlier_buckets(by: Sequence[str], bucket: str) -> WindowSpec:
    """The buckets to the left, over a table with one row per bucket."""
    across = Window.partitionBy(*by).orderBy(bucket)
    return across.rowsBetween(Window.unboundedPreceding, -1)


def running_totals(
    counts: DataFrame,
    by: Sequence[str],
    bucket: str,
    value: str,
    measures: Sequence[str],
) -> DataFrame:
    """Add ``<m>_before`` (total over smaller values of the group) and ``next_value``.

    ``counts`` has one row per (by, bucket, value). The bucket totals are a table of
    groups x buckets rows; they come back through a join on (by, bucket), the keys the
    window has already partitioned the big side by, so that side is not shuffled for it.
    Both sides start from the same shuffle of ``counts``, which Spark runs once.
    """
    by = list(by)
    smaller = smaller_in_bucket(by, bucket, value)
    following = Window.partitionBy(*by, bucket).orderBy(value)
    within = counts.withColumns(
        {f"{m}_before": F.coalesce(F.sum(m).over(smaller), F.lit(0)) for m in measures}
        | {"next_value": F.lead(value).over(following)}
    )

    left = earlier_buckets(by, bucket)
    offsets = (
        counts.groupBy(*by, bucket)
        .agg(*[F.sum(m).alias(m) for m in measures], F.min(value).alias("first_value"))
        .select(
            *by,
            bucket,
            *[F.coalesce(F.sum(m).over(left), F.lit(0)).alias(f"{m}_offset") for m in measures],
            F.lead("first_value").over(Window.partitionBy(*by).orderBy(bucket)).alias("following_first"),
        )
    )
    joined = within.join(offsets, [*by, bucket])
    return joined.withColumns(
        {f"{m}_before": F.col(f"{m}_before") + F.col(f"{m}_offset") for m in measures}
        | {"next_value": F.coalesce("next_value", "following_first")}
    ).drop(*[f"{m}_offset" for m in measures], "following_first")
