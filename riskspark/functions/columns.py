"""Column expressions. All are built-in Spark functions, so they stay in generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark import config

# Employment length in years.
EMPLOYMENT_YEARS = {
    "< 1 year": 0.0, "1 year": 1.0, "2 years": 2.0, "3 years": 3.0,
    "4 years": 4.0, "5 years": 5.0, "6 years": 6.0, "7 years": 7.0,
    "8 years": 8.0, "9 years": 9.0, "10+ years": 10.0,
}


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def available(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    return [name for name in wanted if name in df.columns]


def null_double() -> Column:
    return F.lit(None).cast("double")


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL: both count as missing."""
    return F.nanvl(F.col(name), null_double()) if is_float(df.schema[name].dataType) else F.col(name)


def finite(df: DataFrame, name: str) -> Column:
    """The column as double, with NaN and the infinities turned into NULL."""
    value = F.col(name).cast("double")
    if not is_float(df.schema[name].dataType):
        return value
    # NaN is above infinity in Spark's order, so one comparison covers both.
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def is_missing(df: DataFrame, name: str) -> Column:
    return present(df, name).isNull()


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def loan_to_income(amount: Column, income: Column) -> Column:
    return F.try_divide(amount.cast("double"), income.cast("double") + F.lit(1.0))


def percent_to_number(df: DataFrame, name: str, lenient: bool = False) -> Column:
    """``"10.5%"`` to 10.5. A column that is already numeric passes unchanged."""
    if not isinstance(df.schema[name].dataType, T.StringType):
        return F.col(name)
    text = F.regexp_replace(F.col(name), "%+$", "")
    return text.try_cast("double") if lenient else text.cast("double")


def first_number(text: Column) -> Column:
    """The first run of digits as a number, NULL if there is none."""
    return F.nullif(F.regexp_extract(text, "([0-9]+)", 1), F.lit("")).cast("double")


def employment_years(text: Column) -> Column:
    years = null_double()
    for label, value in reversed(EMPLOYMENT_YEARS.items()):
        years = F.when(text == label, F.lit(value)).otherwise(years)
    return years


def binary_label(df: DataFrame, name: str, positives: Sequence[str] = config.DEFAULT_STATUSES) -> Column:
    """1 for a status in ``positives``, else 0; numeric labels are encoded already."""
    if isinstance(df.schema[name].dataType, T.NumericType):
        return F.coalesce(F.col(name).cast("int"), F.lit(0))
    return F.when(F.col(name).isin(*positives), 1).otherwise(0)


def above(score: Column, threshold: float | Column = config.DECISION_THRESHOLD) -> Column:
    """Class 1 where the score reaches the threshold; a missing score is class 0."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.coalesce(((~F.isnan(score)) & (score >= limit)).cast("int"), F.lit(0))


def risk_level(score: Column) -> Column:
    """NULL and NaN are neither low nor medium, so they come out as High."""
    return (
        F.when(score < config.LOW_RISK_BELOW, "Low")
        .when(score < config.MEDIUM_RISK_BELOW, "Medium")
        .otherwise("High")
    )


def outcome(prediction: Column) -> Column:
    return F.when(prediction == 1, "Default").otherwise("No Default")


def category(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("missing"))


def standardised(value: Column, mean: float, std: float) -> Column:
    return (value - F.lit(float(mean))) / F.lit(float(std) if std else 1.0)
