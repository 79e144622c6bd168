"""Declared schemas of the tables the engine reads."""

from __future__ import annotations

from pyspark.sql import types as T

# The application record: (name, type, required).
APPLICATION_FIELDS = (
    ("loan_amnt", T.DoubleType(), True),
    ("term", T.StringType(), True),
    ("int_rate", T.DoubleType(), True),
    ("installment", T.DoubleType(), False),
    ("grade", T.StringType(), False),
    ("emp_length", T.StringType(), False),
    ("annual_inc", T.DoubleType(), True),
    ("dti", T.DoubleType(), True),
    ("delinq_2yrs", T.IntegerType(), False),
    ("fico_range_high", T.IntegerType(), False),
    ("revol_bal", T.DoubleType(), False),
    ("revol_util", T.DoubleType(), False),
)
APPLICATION_COLUMNS = tuple(name for name, _, _ in APPLICATION_FIELDS)
REQUIRED_FIELDS = tuple(name for name, _, required in APPLICATION_FIELDS if required)
ABSENT_DEFAULTS = {"delinq_2yrs": 0}

APPLICATION_SCHEMA = T.StructType([T.StructField(n, t) for n, t, _ in APPLICATION_FIELDS])

# A loan as it comes in a file: rates may carry a percent sign, so they are read as text.
LOAN_SCHEMA = T.StructType(
    [T.StructField("loan_id", T.LongType())]
    + [
        T.StructField(n, T.StringType() if n in ("int_rate", "revol_util") else t)
        for n, t, _ in APPLICATION_FIELDS
    ]
    + [T.StructField("loan_status", T.StringType())]
)

PERFORMANCE_LOG_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("num_predictions", T.LongType()),
    T.StructField("mean_probability", T.DoubleType()),
    T.StructField("prediction_rate", T.DoubleType()),
    T.StructField("avg_confidence", T.DoubleType()),
])

# Texts a CSV may use for "no value".
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
