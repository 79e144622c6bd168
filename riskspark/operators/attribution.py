"""Score attributions as an array per row, and the reports built on them.

A row's factors are an ``array<struct<feature,value,contribution>>``. Sorting and cutting that
array gives the top factors without shuffling rows x features.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FACTOR = "array<struct<feature:string,value:double,contribution:double>>"


def linear_attribution(
    df: DataFrame,
    weights: Mapping[str, float],
    means: Mapping[str, float],
    intercept: float,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Closed form for a linear model in log-odds: ``w * (x - mean)`` per feature.

    ``base_value`` is the log-odds at the means; base plus contributions is the row's log-odds.
    """
    factors = F.array(*[
        F.struct(
            F.lit(f).alias("feature"),
            F.col(f).cast("double").alias("value"),
            (F.lit(float(w)) * (F.col(f).cast("double") - F.lit(float(means[f])))).alias("contribution"),
        )
        for f, w in weights.items()
    ])
    base = intercept + sum(w * means[f] for f, w in weights.items())
    return df.select(*keep, F.lit(float(base)).alias("base_value"), factors.alias("factors"))


def feature_means(df: DataFrame, features: Sequence[str]) -> dict[str, float]:
    row = df.agg(*[F.avg(f).alias(f) for f in features]).first()
    return {f: row[f] for f in features}


def long_factors(attributed: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per (row, feature)."""
    return attributed.select(*keep, F.inline("factors"))


def by_size(factors: str | Column = "factors", n: int | None = None) -> Column:
    """Factors, or ``n`` of them, with the largest absolute contribution first; equal ones by name."""
    f = F.col(factors) if isinstance(factors, str) else factors
    keyed = F.transform(
        f,
        lambda x: F.struct(
            (-F.abs(x["contribution"])).alias("k"),
            x["feature"].alias("feature"),
            x["value"].alias("value"),
            x["contribution"].alias("contribution"),
        ),
    )
    found = F.sort_array(keyed)
    return F.transform(
        found if n is None else F.slice(found, 1, n),
        lambda x: F.struct(
            x["feature"].alias("feature"),
            x["value"].alias("value"),
            x["contribution"].alias("contribution"),
        ),
    )


def top_factors(attributed: DataFrame, n: int = 5, column: str = "top_factors") -> DataFrame:
    return attributed.withColumn(column, by_size(n=n))


def global_importance(attributed: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean absolute contribution per feature: one aggregate row, then one row per feature."""
    sizes = F.map_from_entries(
        F.transform("factors", lambda x: F.struct(x["feature"], F.abs(x["contribution"])))
    )
    wide = attributed.select(sizes.alias("m")).agg(*[F.avg(F.col("m")[f]).alias(f) for f in features])
    return wide.unpivot([], list(features), "feature", "importance")


def top_features(attributed: DataFrame, features: Sequence[str], n: int = 10) -> DataFrame:
    return (
        global_importance(attributed, features).orderBy(F.desc("importance"), "feature").limit(n)
    )


def with_names(values: DataFrame, names: DataFrame, on: str = "feature") -> DataFrame:
    """Pair feature rows with further feature rows (importance, value) by name."""
    return values.join(names, on)


def explanation(prediction: Column, probability: Column, factors: Column) -> Column:
    """The readable explanation: outcome, probability, one line per factor."""
    lines = F.transform(
        factors,
        lambda x: F.format_string(
            "- %s (value: %.2f) %s default risk by %.4f\n",
            x["feature"],
            x["value"],
            F.when(x["contribution"] > 0, "increases").otherwise("decreases"),
            F.abs(x["contribution"]),
        ),
    )
    head = F.format_string(
        "Prediction: %s\nProbability of Default: %.2f%%\n\nTop factors influencing this prediction:\n",
        F.when(prediction == 1, "Default").otherwise("No Default"),
        probability * 100,
    )
    return F.concat(head, F.array_join(lines, ""))
