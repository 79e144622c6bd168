"""Distances between two distributions with a proven error, without shuffling the values.

The exact distances shuffle a row per distinct value. Here quantile sketches, merged among the tasks, cut the value axis;
what is shuffled are sums per task, column and interval. The sums are exact, so that at the ends of an interval both
distribution functions are known; inside of it they only rise, which bounds the distances from both sides. A poor cut
makes the stated error wider and never wrong.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskspark.functions.columns import finite
from riskspark.operators.marks import quantile_marks
from riskspark.operators.prefix import add_buckets, earlier_buckets
from riskspark.session import cut_lineage

#: Intervals per side. About this share of a side's rows, and the sketch's rank error, is what an interval holds.
INTERVALS = 500


def side_cuts(stacked: DataFrame, columns: Sequence[str], tag: str, intervals: int) -> dict[str, list[float]]:
    """Approximate quantiles of both sides, in one pass, so that no interval is long for the smaller side.

    At most ``2 * (intervals - 1)`` numbers per column reach the driver.
    """
    shares = [i / intervals for i in range(1, intervals)]
    values: dict[str, Column] = {}
    for i, c in enumerate(columns):
        values[f"r{i}"] = F.when(F.col(tag), finite(stacked, c))
        values[f"c{i}"] = F.when(~F.col(tag), finite(stacked, c))
    found, _, _ = quantile_marks(stacked, values, shares)
    return {c: sorted({*found[f"r{i}"], *found[f"c{i}"]}) for i, c in enumerate(columns)}


def interval_sums(stacked: DataFrame, columns: Sequence[str], tag: str, cuts: dict[str, list[float]]) -> DataFrame:
    """``at, bucket, ref, cur, low, high, ref_up, cur_up``: a row per column and interval that holds values.

    A cut is an interval of its own, so that a frequent value has no width. ``ref_up`` and ``cur_up`` add up how far the
    values lie above the cut below them.
    """
    bucketed = add_buckets(stacked.select(*columns, tag).fillna(float("-inf"), list(columns)), cuts)
    entries = []
    for i, c in enumerate(columns):
        base = F.lit(0.0)
        if cuts[c]:
            edges = F.expr(f"array({', '.join(f'{x!r}D' for x in cuts[c])})")
            base = F.element_at(edges, F.greatest(F.col(f"{c}__bucket"), F.lit(1)))
        entries.append(F.struct(
            F.lit(i).alias("at"), F.col(f"{c}__bucket").alias("place"), base.alias("base"), F.col(c).alias("value")))
    rows = bucketed.select(F.col(tag).alias("__side"), F.inline(F.array(*entries))).filter(F.col("value") > float("-inf"))
    up = F.col("value") - F.col("base")
    return (
        rows.withColumn("bucket", F.col("place") * 2 + (F.col("value") > F.col("base")).cast("int"))
        .groupBy("at", "bucket")
        .agg(
            F.count_if("__side").alias("ref"), F.count_if(~F.col("__side")).alias("cur"),
            F.min("value").alias("low"), F.max("value").alias("high"), F.first("base").alias("base"),
            F.coalesce(F.sum(F.when(F.col("__side"), up)), F.lit(0.0)).alias("ref_up"),
            F.coalesce(F.sum(F.when(~F.col("__side"), up)), F.lit(0.0)).alias("cur_up"),
        )
    )


def bounded_distances(
    stacked: DataFrame, columns: Sequence[str], tag: str, sizes: DataFrame, intervals: int = INTERVALS
) -> DataFrame:
    """Per column ``ks`` and ``wasserstein`` with ``ks_error`` and ``wasserstein_error``.

    The exact distance is never further from the given one than its error (but for rounding of doubles). ``sizes`` has
    ``at, feature, n_ref, n_cur, std_ref`` per column; the area is divided by ``std_ref`` as in the exact distance. A column
    without values on one side has no distance; without values on both, no row.

    Where one distribution function lies above the other over a whole interval, the area between them follows exactly
    from the sums. Only intervals in which they may cross are uncertain.
    """
    sums = cut_lineage(interval_sums(stacked, columns, tag, side_cuts(stacked, columns, tag, intervals)), "intervals")
    left = earlier_buckets(["at"], "bucket")
    n_ref, n_cur = (F.nullif(F.col(c), F.lit(0)).cast("double") for c in ("n_ref", "n_cur"))
    span = F.col("high") - F.col("low")

    def above(side: str) -> Column:
        """The area under a side's distribution function that the interval's own values add."""
        exact = F.col(side) * (F.col("high") - F.col("base")) - F.col(f"{side}_up")
        return F.greatest(exact, F.lit(0.0))

    steps = (
        sums.withColumns({f"{s}_before": F.coalesce(F.sum(s).over(left), F.lit(0)) for s in ("ref", "cur")}
                         | {"next_low": F.lead("low").over(Window.partitionBy("at").orderBy("bucket"))})
        .join(F.broadcast(sizes), "at")
        .select(
            "feature", "n_ref", "n_cur", "std_ref", "low", "high", "next_low", span.alias("span"),
            (F.col("ref_before") / n_ref).alias("r0"), ((F.col("ref_before") + F.col("ref")) / n_ref).alias("r1"),
            (F.col("cur_before") / n_cur).alias("c0"), ((F.col("cur_before") + F.col("cur")) / n_cur).alias("c1"),
            (above("ref") / n_ref).alias("r_in"), (above("cur") / n_cur).alias("c_in"),
        )
    )
    start, end = F.col("r0") - F.col("c0"), F.col("r1") - F.col("c1")
    most = F.when(F.col("span") > 0, F.greatest(F.col("r1") - F.col("c0"), F.col("c1") - F.col("r0"))).otherwise(F.abs(end))
    least_area = F.abs(start * F.col("span") + F.col("r_in") - F.col("c_in"))
    one_above = (F.col("r0") >= F.col("c1")) | (F.col("c0") >= F.col("r1"))
    apart = F.least(F.col("span") * most, F.abs(start) * F.col("span") + F.col("r_in") + F.col("c_in"))
    most_area = F.when(one_above, least_area).otherwise(F.greatest(least_area, apart))
    between = F.coalesce(F.abs(end) * (F.col("next_low") - F.col("high")), F.lit(0.0))
    # Fixed value: the smallest deviation the distance is divided by.
    unit = F.greatest(F.col("std_ref"), F.lit(0.001))
    found = steps.groupBy("feature", "n_ref", "n_cur", "std_ref").agg(
        F.max(F.abs(end)).alias("ks_low"), F.max(most).alias("ks_high"),
        F.sum(least_area + between).alias("area_low"), F.sum(most_area + between).alias("area_high"),
    )
    return found.select(
        "feature", "n_ref", "n_cur",
        ((F.col("ks_low") + F.col("ks_high")) / 2).alias("ks"),
        ((F.col("ks_high") - F.col("ks_low")) / 2).alias("ks_error"),
        ((F.col("area_low") + F.col("area_high")) / 2 / unit).alias("wasserstein"),
        ((F.col("area_high") - F.col("area_low")) / 2 / unit).alias("wasserstein_error"),
    )
