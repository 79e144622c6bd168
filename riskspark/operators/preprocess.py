"""From a loan table to model features: prepare, engineer, fit, transform."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark import config
from riskspark.functions.columns import (
    binary_label,
    category,
    employment_years,
    finite,
    first_number,
    loan_to_income,
    numeric_columns,
    percent_to_number,
    standardised,
    string_columns,
)
from riskspark.operators.quality import drop_high_missing, drop_leakage
from riskspark.operators.quantiles import exact_medians
from riskspark.operators.ranking import category_dictionary, group_sizes
from riskspark.session import cut_lineage

UNSEEN = -1


def prepare(
    df: DataFrame,
    status: str = config.TARGET,
    positives: Sequence[str] = config.DEFAULT_STATUSES,
    keywords: Sequence[str] = config.LEAKAGE_KEYWORDS,
    missing_limit: float = config.MISSING_LIMIT,
) -> DataFrame:
    """Encode the label, then drop leaking columns and columns that are mostly missing.

    The columns to drop are chosen from names first, so the profile does not read them.
    """
    if status in df.columns:
        df = df.withColumn(status, binary_label(df, status, positives))
    return drop_high_missing(drop_leakage(df, keywords), missing_limit)


def engineer_features(df: DataFrame, lenient: bool = False) -> DataFrame:
    """Add the derived columns whose inputs exist. One projection."""
    made = {}
    has = set(df.columns)
    if {"loan_amnt", "annual_inc"} <= has:
        made["loan_to_income"] = loan_to_income(F.col("loan_amnt"), F.col("annual_inc"))
    for rate in ("int_rate", "revol_util"):
        if rate in has:
            made[rate] = percent_to_number(df, rate, lenient)
    if "term" in has:
        made["term_months"] = first_number(F.col("term"))
    if "emp_length" in has:
        made["emp_length_years"] = employment_years(F.col("emp_length"))
    return df.withColumns(made) if made else df


def add_clean_rate(df: DataFrame, name: str = "int_rate") -> DataFrame:
    """The exploratory variant: a text rate gets a numeric twin, a numeric one does not."""
    if name not in string_columns(df):
        return df
    return df.withColumn(f"{name}_clean", percent_to_number(df, name))


@dataclass(frozen=True)
class NumericStats:
    median: float | None
    mean: float | None
    std: float | None


@dataclass(frozen=True)
class Preprocessor:
    """Fitted state. ``dictionary`` is a table; everything else has one entry per column."""

    columns: tuple[str, ...]
    numeric: dict[str, NumericStats]
    categorical: tuple[str, ...]
    dictionary: DataFrame | None
    dictionary_sizes: dict[str, int]

    @property
    def model_features(self) -> list[str]:
        """The columns that hold numbers after ``transform``, in order."""
        return [c for c in self.columns if c in self.numeric or c in self.categorical]


def fit(df: DataFrame, label: str | None = None, exclude: Sequence[str] = ()) -> Preprocessor:
    """Learn medians, means, deviations and category codes from ``df``.

    Infinite numbers count as missing. Columns that are neither numeric nor text pass through ``transform`` unchanged.
    ``exclude`` keeps ids and timestamps out of the features.
    """
    skip = {label, *exclude}
    features = [c for c in df.columns if c not in skip]
    numeric = [c for c in numeric_columns(df) if c not in skip]
    categorical = [c for c in string_columns(df) if c not in skip]

    stats = _numeric_stats(df, numeric)
    dictionary, sizes = None, {}
    if categorical:
        ranked, sizes = category_dictionary(df, categorical)
        dictionary = cut_lineage(ranked, "dictionary")
    return Preprocessor(tuple(features), stats, tuple(categorical), dictionary, sizes)


def _numeric_stats(df: DataFrame, columns: Sequence[str]) -> dict[str, NumericStats]:
    """Median, and mean and deviation after missing values are replaced by it.

    The moments of the filled column follow from those of the present values, the number of
    missing ones and the median, so the table is not read again for them.
    """
    if not columns:
        return {}
    rows = df.select(*[finite(df, c).alias(c) for c in columns])
    row = rows.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count(c).alias(f"{c}__n") for c in columns],
        *[F.avg(c).alias(f"{c}__mean") for c in columns],
        *[F.stddev_pop(c).alias(f"{c}__std") for c in columns],
    ).first()
    medians = exact_medians(df, columns, {c: row[f"{c}__n"] for c in columns})
    stats = {}
    for c in columns:
        median, n, total = medians[c], row[f"{c}__n"], row["__rows"]
        if median is None:
            stats[c] = NumericStats(None, None, None)
            continue
        gap = total - n
        mean = (row[f"{c}__mean"] * n + median * gap) / total
        spread = n * (row[f"{c}__std"] ** 2 + (row[f"{c}__mean"] - mean) ** 2) + gap * (median - mean) ** 2
        stats[c] = NumericStats(median, mean, math.sqrt(spread / total))
    return stats


def _number(value: float | None):
    return F.lit(value).cast("double")


def _encode(df: DataFrame, name: str, state: Preprocessor, sort_merge: bool) -> DataFrame:
    """Replace a text column by its code, -1 if the value is not in the dictionary.

    The engine broadcasts a dictionary whose bytes are below its limit. A bigger one is joined by a shuffle, in
    which the engine splits the rows of a frequent value.
    """
    key, code = f"__{name}_key", f"__{name}_code"
    entries = state.dictionary.filter(F.col("column") == name).select(
        F.col("value").alias(key), F.col("code").cast("double").alias(code)
    )
    keyed = df.withColumn(key, category(name))
    joined = keyed.join(entries.hint("merge") if sort_merge else entries, key, "left")
    return joined.withColumn(name, F.coalesce(F.col(code), F.lit(float(UNSEEN)))).drop(key, code)


def transform(
    df: DataFrame,
    state: Preprocessor,
    keep: Sequence[str] = (),
    sort_merge: bool = False,
) -> DataFrame:
    """Apply fitted state: fill, encode, standardise, and put the columns in fitted order.

    ``keep`` names columns (id, label) to carry along. Nothing is shuffled unless a dictionary has more
    bytes than the engine broadcasts; ``sort_merge`` asks for the shuffle at any size.
    """
    numbers = {}
    for name, s in state.numeric.items():
        value = F.coalesce(finite(df, name), _number(s.median))
        numbers[name] = standardised(value, s.mean or 0.0, s.std or 0.0)
    out = df.select(*keep, *[c for c in state.columns if c not in keep])
    out = out.withColumns(numbers) if numbers else out
    for name in state.categorical:
        out = _encode(out, name, state, sort_merge)
    return out.select(*keep, *[c for c in state.columns if c not in keep])


def save(state: Preprocessor, spark: SparkSession, path: str) -> None:
    """Write the state as three small tables."""
    kinds = [
        (i, c, "numeric" if c in state.numeric else "categorical" if c in state.categorical else "other")
        for i, c in enumerate(state.columns)
    ]
    spark.createDataFrame(kinds, "position int, name string, kind string").write.mode(
        "overwrite"
    ).parquet(f"{path}/columns")
    stats = [(c, s.median, s.mean, s.std) for c, s in state.numeric.items()]
    spark.createDataFrame(
        stats, "column string, median double, mean double, std double"
    ).write.mode("overwrite").parquet(f"{path}/numeric_stats")
    dictionary = state.dictionary
    if dictionary is None:
        dictionary = spark.createDataFrame([], "column string, value string, code long")
    dictionary.write.mode("overwrite").partitionBy("column").parquet(f"{path}/dictionary")


def load(spark: SparkSession, path: str) -> Preprocessor:
    kinds = spark.read.parquet(f"{path}/columns").orderBy("position").collect()
    stats = spark.read.parquet(f"{path}/numeric_stats").collect()
    by_name = {r["column"]: NumericStats(r["median"], r["mean"], r["std"]) for r in stats}
    names = tuple(r["name"] for r in kinds)
    categorical = tuple(r["name"] for r in kinds if r["kind"] == "categorical")
    state = Preprocessor(names, {c: by_name[c] for c in names if c in by_name}, categorical, None, {})
    if not categorical:
        return state
    schema = "value string, code long, column string"
    dictionary = spark.read.schema(schema).parquet(f"{path}/dictionary").select("column", "value", "code")
    return replace(state, dictionary=dictionary, dictionary_sizes=group_sizes(dictionary, "column"))


def numeric_stats_table(state: Preprocessor, spark: SparkSession) -> DataFrame:
    rows = [(c, s.median, s.mean, s.std) for c, s in state.numeric.items()]
    return spark.createDataFrame(rows, "column string, median double, mean double, std double")
