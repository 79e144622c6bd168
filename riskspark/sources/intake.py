"""Typed intake of application records and the domain limits on their values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.functions.columns import EMPLOYMENT_YEARS, present
from riskspark.sources.schemas import ABSENT_DEFAULTS, APPLICATION_FIELDS, REQUIRED_FIELDS

# The limits of the entry form.
RANGES = {
    "loan_amnt": (1000, 50000),
    "int_rate": (5.0, 30.0),
    "installment": (50.0, 2000.0),
    "annual_inc": (20000, 500000),
    "dti": (0.0, 50.0),
    "fico_range_high": (600, 850),
    "revol_bal": (0, 100000),
    "revol_util": (0.0, 100.0),
    "delinq_2yrs": (0, 10),
}
CHOICES = {
    "term": ("36 months", "60 months"),
    "grade": ("A", "B", "C", "D", "E", "F", "G"),
    "emp_length": tuple(EMPLOYMENT_YEARS),
}


def _typed(df: DataFrame, name: str, dtype: T.DataType) -> Column:
    if name not in df.columns:
        return F.lit(ABSENT_DEFAULTS.get(name)).cast(dtype)
    return F.col(name).try_cast(dtype)


def check_applications(df: DataFrame) -> DataFrame:
    """Cast every record to the declared fields and say why a record is refused.

    ``reasons`` lists ``missing:<field>`` for a required field without a value and
    ``type:<field>`` for a value that does not fit its type; it is empty for a valid record.
    ``refused`` lists ``<field>=<value>`` as it came in, for each value that does not fit.
    Columns outside the declaration (ids, timestamps) are passed along.
    """
    declared = {name for name, _, _ in APPLICATION_FIELDS}
    others = [F.col(c) for c in df.columns if c not in declared]
    problems, refused = [], []
    for name, dtype, required in APPLICATION_FIELDS:
        if name not in df.columns:
            if required:
                problems.append(F.lit(f"missing:{name}"))
            continue
        given = F.col(name)
        if required:
            problems.append(F.when(given.isNull(), F.lit(f"missing:{name}")))
        if not isinstance(df.schema[name].dataType, type(dtype)):
            unfit = given.isNotNull() & given.try_cast(dtype).isNull()
            problems.append(F.when(unfit, F.lit(f"type:{name}")))
            text = given if dict(df.dtypes)[name] == "string" else F.to_json(F.struct(given))
            refused.append(F.when(unfit, F.concat(F.lit(f"{name}="), text.cast("string"))))
    if "_corrupt_record" in df.columns:
        problems.append(F.when(F.col("_corrupt_record").isNotNull(), F.lit("record")))
    reasons = F.array_compact(F.array(*problems)) if problems else F.array().cast("array<string>")
    typed = [_typed(df, name, dtype).alias(name) for name, dtype, _ in APPLICATION_FIELDS]
    values = F.array_compact(F.array(*refused)) if refused else F.array().cast("array<string>")
    return df.select(*others, *typed, reasons.alias("reasons"), values.alias("refused"))


def valid_applications(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("reasons") == 0).drop("reasons", "refused")


def rejected_applications(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("reasons") > 0)


def rejection_counts(checked: DataFrame) -> DataFrame:
    return (
        checked.select(F.explode("reasons").alias("reason"))
        .groupBy("reason")
        .agg(F.count("*").alias("records"))
    )


def limit_violations(df: DataFrame) -> DataFrame:
    """Add ``violations``: the names of the limits a record breaks. Missing values break none."""
    broken = []
    for name, (low, high) in RANGES.items():
        if name in df.columns:
            broken.append(F.when(~present(df, name).between(low, high), F.lit(name)))
    for name, allowed in CHOICES.items():
        if name in df.columns:
            broken.append(F.when(~F.trim(F.col(name)).isin(*allowed), F.lit(name)))
    return df.withColumn("violations", F.array_compact(F.array(*broken)))


def violation_counts(df: DataFrame) -> DataFrame:
    return (
        limit_violations(df)
        .select(F.explode("violations").alias("rule"))
        .groupBy("rule")
        .agg(F.count("*").alias("records"))
    )
