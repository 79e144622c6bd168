"""Queries on reading, checking and profiling loan tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskspark import config
from riskspark.functions.columns import binary_label
from riskspark.operators import eda, quality
from riskspark.operators.preprocess import add_clean_rate, engineer_features, prepare
from riskspark.session import new_path
from riskspark.sources import intake, readers
from riskspark.sources.schemas import APPLICATION_SCHEMA, LOAN_SCHEMA
from riskspark.sources.sinks import save_reference
from workload.registry import longs, query, rounded
from workload.views import view

FILE_COLUMNS = [f.name for f in LOAN_SCHEMA]
FILE_SQL = f"SELECT {', '.join(FILE_COLUMNS)} FROM loans"


def _as_csv(spark, folder, **options):
    path = new_path(spark, "loans-csv")
    out = view(spark, folder, "loans").select(*FILE_COLUMNS).write
    out.csv(path, header=True, nullValue="n/a", ignoreLeadingWhiteSpace=False, **options)
    return path


@query("read_loan_csv", FILE_SQL, ("loans",))
def read_loan_csv(spark, folder):
    loans = readers.read_loans_csv(spark, _as_csv(spark, folder))
    return longs(loans, "delinq_2yrs", "fico_range_high")


@query("read_loan_csv_gz", FILE_SQL, ("loans",))
def read_loan_csv_gz(spark, folder):
    path = _as_csv(spark, folder, compression="gzip")
    return longs(readers.read_loans_csv(spark, path, partitions=8), "delinq_2yrs", "fico_range_high")


@query("read_first_loans", FILE_SQL + " ORDER BY loan_id LIMIT 100", ("loans",))
def read_first_loans(spark, folder):
    loans = readers.read_loans_csv(spark, _as_csv(spark, folder))
    return longs(readers.read_first_rows(loans, 100, "loan_id"), "delinq_2yrs", "fico_range_high")


@query("read_json_records", """
SELECT loan_amnt, term, CAST(replace(int_rate, '%', '') AS DOUBLE) AS int_rate, installment, grade, emp_length,
 annual_inc, dti, delinq_2yrs, fico_range_high, revol_bal, CAST(replace(revol_util, '%', '') AS DOUBLE) AS revol_util
FROM loans""", ("loans",))
def read_json_records(spark, folder):
    path = new_path(spark, "records")
    records = engineer_features(view(spark, folder, "loans")).select(*[f.name for f in APPLICATION_SCHEMA])
    records.write.json(path)
    read = readers.read_records(spark, path, APPLICATION_SCHEMA).drop("_corrupt_record")
    return longs(read, "delinq_2yrs", "fico_range_high")


@query("reference_table", "SELECT loan_id, loan_amnt, grade FROM reference_loans", ("reference_loans",))
def reference_table(spark, folder):
    kept = save_reference(view(spark, folder, "reference_loans"), new_path(spark, "reference"))
    return kept.select("loan_id", "loan_amnt", "grade")


@query("reference_from_csv", "SELECT loan_amnt, term, dti FROM reference_loans", ("reference_loans",))
def reference_from_csv(spark, folder):
    rows = view(spark, folder, "reference_loans").select("loan_amnt", "term", "dti")
    path = new_path(spark, "reference-csv")
    rows.write.csv(path, header=True, ignoreLeadingWhiteSpace=False)
    return readers.read_reference(spark, path, rows)


REASONS = """
WITH t AS (SELECT *, TRY_CAST(int_rate AS DOUBLE) AS rate FROM applications)
"""


@query("valid_applications", REASONS + """
SELECT loan_id, loan_amnt, term, rate AS int_rate, installment, grade, emp_length, annual_inc, dti,
  CAST(0 AS BIGINT) AS delinq_2yrs, fico_range_high, revol_bal, revol_util
FROM t WHERE rate IS NOT NULL AND annual_inc IS NOT NULL AND dti IS NOT NULL""", ("applications",))
def valid_applications(spark, folder):
    checked = intake.check_applications(view(spark, folder, "applications"))
    return longs(intake.valid_applications(checked), "delinq_2yrs", "fico_range_high")


@query("rejected_applications", REASONS + """
SELECT loan_id, concat_ws(',', CASE WHEN int_rate IS NOT NULL AND rate IS NULL THEN 'type:int_rate' END,
  CASE WHEN annual_inc IS NULL THEN 'missing:annual_inc' END, CASE WHEN dti IS NULL THEN 'missing:dti' END) AS reasons,
  CASE WHEN int_rate IS NOT NULL AND rate IS NULL THEN 'int_rate=' || int_rate ELSE '' END AS refused
FROM t WHERE rate IS NULL OR annual_inc IS NULL OR dti IS NULL""", ("applications",))
def rejected_applications(spark, folder):
    checked = intake.check_applications(view(spark, folder, "applications"))
    rejected = intake.rejected_applications(checked)
    joined = {c: F.array_join(c, ",") for c in ("reasons", "refused")}
    return rejected.select("loan_id", *[text.alias(c) for c, text in joined.items()])


@query("rejection_counts", REASONS + """
SELECT reason, count(*) AS records FROM (
  SELECT 'type:int_rate' AS reason FROM t WHERE int_rate IS NOT NULL AND rate IS NULL
  UNION ALL SELECT 'missing:annual_inc' FROM t WHERE annual_inc IS NULL
  UNION ALL SELECT 'missing:dti' FROM t WHERE dti IS NULL) u GROUP BY reason""", ("applications",))
def rejection_counts(spark, folder):
    return intake.rejection_counts(intake.check_applications(view(spark, folder, "applications")))


def _limits_sql() -> str:
    parts = [
        f"SELECT '{c}' AS rule FROM e WHERE {c} NOT BETWEEN {low} AND {high}"
        for c, (low, high) in intake.RANGES.items()
    ]
    for c, allowed in intake.CHOICES.items():
        texts = ", ".join(f"'{a}'" for a in allowed)
        parts.append(f"SELECT '{c}' AS rule FROM e WHERE trim({c}) NOT IN ({texts})")
    return f"""
WITH e AS (SELECT loan_amnt, term, CAST(replace(int_rate, '%', '') AS DOUBLE) AS int_rate, installment, grade,
  emp_length, annual_inc, dti, delinq_2yrs, fico_range_high, revol_bal,
  CAST(replace(revol_util, '%', '') AS DOUBLE) AS revol_util FROM loans)
SELECT rule, count(*) AS records FROM ({' UNION ALL '.join(parts)}) u GROUP BY rule"""


@query("limit_violations", _limits_sql(), ("loans",))
def limit_violations(spark, folder):
    return intake.violation_counts(engineer_features(view(spark, folder, "loans")))


LOAN_COLUMNS = (
    "loan_id", "issue_ts", "loan_amnt", "term", "int_rate", "installment", "grade", "emp_length",
    "annual_inc", "dti", "delinq_2yrs", "fico_range_high", "revol_bal", "revol_util", "note",
    "half_note", "total_pymnt", "recoveries", "loan_status",
)
SAFE_COLUMNS = [c for c in LOAN_COLUMNS if c not in ("total_pymnt", "recoveries")]


@query("drop_leakage", f"SELECT {', '.join(SAFE_COLUMNS)} FROM loans", ("loans",))
def drop_leakage(spark, folder):
    return quality.drop_leakage(view(spark, folder, "loans"))


@query("drop_high_missing", f"SELECT {', '.join(c for c in LOAN_COLUMNS if c != 'note')} FROM loans", ("loans",))
def drop_high_missing(spark, folder):
    return quality.drop_high_missing(view(spark, folder, "loans"))


PREPARED = [c for c in SAFE_COLUMNS if c not in ("note", "loan_status")]


@query("prepare_loans", f"""SELECT {', '.join(PREPARED)},
  CAST(CASE WHEN loan_status IN ('Charged Off', 'Default') THEN 1 ELSE 0 END AS BIGINT) AS loan_status FROM loans""", ("loans",))
def prepare_loans(spark, folder):
    return longs(prepare(view(spark, folder, "loans")), "loan_status")


@query("binary_labels", """
SELECT loan_id, CAST(CASE WHEN loan_status IN ('Charged Off', 'Default') THEN 1 ELSE 0 END AS BIGINT) AS label,
 CAST(CASE WHEN loan_status IN ('Charged Off', 'Default', 'Late (31-120 days)') THEN 1 ELSE 0 END AS BIGINT) AS eda_label
FROM loans""", ("loans",))
def binary_labels(spark, folder):
    loans = view(spark, folder, "loans")
    return loans.select(
        "loan_id",
        binary_label(loans, "loan_status").cast("long").alias("label"),
        binary_label(loans, "loan_status", config.EDA_DEFAULT_STATUSES).cast("long").alias("eda_label"),
    )


MISSING = "WITH p AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_count, "
    f"round_even((count(*) - count({c})) * CAST(100 AS DOUBLE) / count(*), 2) AS missing_percent FROM loans"
    for c in LOAN_COLUMNS
) + ") "


@query("missing_profile", MISSING + "SELECT * FROM p", ("loans",))
def missing_profile(spark, folder):
    return quality.missing_profile(view(spark, folder, "loans"))


@query("most_missing_columns", MISSING + "SELECT * FROM p ORDER BY missing_percent DESC, \"column\" LIMIT 5", ("loans",))
def most_missing_columns(spark, folder):
    return quality.most_missing(view(spark, folder, "loans"), 5)


@query("high_missing_columns", MISSING + "SELECT * FROM p WHERE missing_percent > 50", ("loans",))
def high_missing_columns(spark, folder):
    return quality.high_missing_profile(view(spark, folder, "loans"))


@query("table_shape", f"SELECT count(*) AS \"rows\", CAST({len(LOAN_COLUMNS)} AS BIGINT) AS \"columns\" FROM loans", ("loans",))
def table_shape(spark, folder):
    return quality.table_shape(view(spark, folder, "loans"))


@query("status_counts", "SELECT loan_status, count(*) AS \"count\" FROM loans GROUP BY loan_status", ("loans",))
def status_counts(spark, folder):
    return eda.value_counts(view(spark, folder, "loans"), "loan_status")


@query("distinct_values", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_values FROM loans"
    for c in ("loan_status", "grade", "term", "half_note", "annual_inc")
), ("loans",))
def distinct_values(spark, folder):
    return eda.distinct_values(
        view(spark, folder, "loans"), ["loan_status", "grade", "term", "half_note", "annual_inc"]
    )


EDA_LABEL = "CASE WHEN loan_status IN ('Charged Off', 'Default', 'Late (31-120 days)') THEN 1 ELSE 0 END"


def _with_default(spark, folder):
    loans = view(spark, folder, "loans")
    return loans.withColumn("default", binary_label(loans, "loan_status", config.EDA_DEFAULT_STATUSES))


@query("class_balance", f"""
SELECT round(r, 6) AS default_rate, round((1 - r) / nullif(r, 0), 6) AS imbalance_ratio
FROM (SELECT avg({EDA_LABEL}) AS r FROM loans) x""", ("loans",))
def class_balance(spark, folder):
    return rounded(eda.class_balance(_with_default(spark, folder)))


ENGINEERED = """e AS (SELECT loan_id, issue_ts, loan_amnt, term, CAST(regexp_replace(int_rate, '%+$', '') AS DOUBLE) AS int_rate,
 installment, grade, emp_length, annual_inc, dti, delinq_2yrs, fico_range_high, revol_bal,
 CAST(regexp_replace(revol_util, '%+$', '') AS DOUBLE) AS revol_util, half_note,
 loan_amnt / (annual_inc + 1) AS loan_to_income,
 CAST(nullif(regexp_extract(term, '([0-9]+)', 1), '') AS DOUBLE) AS term_months,
 CASE WHEN emp_length = '< 1 year' THEN CAST(0 AS DOUBLE) WHEN emp_length = '10+ years' THEN 10
   WHEN emp_length = '1 year' THEN 1 WHEN emp_length LIKE '% years' THEN CAST(split_part(emp_length, ' ', 1) AS DOUBLE) END AS emp_length_years,
 loan_status FROM loans)"""


def _histogram_sql() -> str:
    parts = []
    for c in config.HISTOGRAM_FEATURES:
        parts.append(f"""
SELECT '{c}' AS feature, bin, lo + bin * ((hi - lo) / 50) AS s, (hi - lo) / 50 AS w, count(*) AS "count" FROM (
  SELECT least(CAST(floor(({c} - lo) / (hi - lo) * 50) AS INT), 49) AS bin, lo, hi FROM e,
    (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM e) b WHERE {c} IS NOT NULL) x GROUP BY bin, lo, hi""")
    return f"""WITH {ENGINEERED} SELECT feature, CAST(bin AS BIGINT) AS bin, round(s, 4) AS bin_start,
 round(s + w, 4) AS bin_end, "count" FROM ({' UNION ALL '.join(parts)}) u"""


@query("feature_histograms", _histogram_sql(), ("loans",))
def feature_histograms(spark, folder):
    loans = engineer_features(view(spark, folder, "loans"))
    return longs(rounded(eda.histogram(loans, config.HISTOGRAM_FEATURES), 4), "bin")


NUMERIC = (
    "loan_id", "loan_amnt", "installment", "annual_inc", "dti", "delinq_2yrs", "fico_range_high",
    "revol_bal", "total_pymnt", "recoveries", '"default"',
)
CORRELATIONS = f"WITH d AS (SELECT *, {EDA_LABEL} AS \"default\" FROM loans), c AS (" + " UNION ALL ".join(
    "SELECT '{}' AS feature, round(corr({}, \"default\"), 6) AS correlation FROM d".format(c.strip('"'), c)
    for c in NUMERIC
) + ") "


@query("target_correlation", CORRELATIONS + "SELECT * FROM c", ("loans",))
def target_correlation(spark, folder):
    return rounded(eda.correlation_with(_with_default(spark, folder), "default"))


@query("strongest_correlations", CORRELATIONS + "SELECT * FROM c ORDER BY correlation DESC, feature LIMIT 4", ("loans",))
def strongest_correlations(spark, folder):
    return rounded(eda.strongest(rounded(eda.correlation_with(_with_default(spark, folder), "default")), 4))


@query("weakest_correlations", CORRELATIONS + "SELECT * FROM c ORDER BY correlation, feature DESC LIMIT 4", ("loans",))
def weakest_correlations(spark, folder):
    return rounded(eda.weakest(rounded(eda.correlation_with(_with_default(spark, folder), "default")), 4))


WIDE = tuple(f"x{i}" for i in range(1, 31))
WIDE_COLUMNS = ", ".join(f"l_quantity * {i} + l_partkey % {i + 7} + l_discount * l_linenumber AS {c}" for i, c in enumerate(WIDE, 1))


@query("wide_target_correlation", f"WITH w AS (SELECT l_extendedprice, {WIDE_COLUMNS} FROM lineitem) " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(corr({c}, l_extendedprice), 6) AS correlation FROM w" for c in (*WIDE, "l_extendedprice")
))
def wide_target_correlation(spark, folder):
    """More numeric columns than a chart shows: every one has its row."""
    rows = spark.sql(f"SELECT l_extendedprice, {WIDE_COLUMNS} FROM {{lineitem}}", lineitem=view(spark, folder, "lineitem"))
    return rounded(eda.correlation_with(rows, "l_extendedprice"))


MATRIX = ["loan_amnt", "int_rate", "annual_inc", "dti", "revol_bal", '"default"']


@query("correlation_matrix", f"WITH {ENGINEERED}, d AS (SELECT *, {EDA_LABEL} AS \"default\" FROM e) " + " UNION ALL ".join(
    "SELECT '{}' AS feature_a, '{}' AS feature_b, round(corr({}, {}), 6) AS correlation FROM d".format(
        a.strip('"'), b.strip('"'), a, b)
    for a in MATRIX for b in MATRIX
), ("loans",))
def correlation_matrix(spark, folder):
    loans = engineer_features(_with_default(spark, folder))
    return rounded(eda.correlation_matrix(loans, config.CORRELATION_FEATURES))


@query("eda_summary", MISSING + f"""
SELECT count(*) AS "rows", CAST({len(LOAN_COLUMNS)} AS BIGINT) AS "columns", round(avg({EDA_LABEL}), 6) AS default_rate,
 CAST(2 AS BIGINT) AS leakage_columns, (SELECT count(*) FROM p WHERE missing_percent > 50) AS high_missing_columns
FROM loans""", ("loans",))
def eda_summary(spark, folder):
    return rounded(eda.eda_summary(view(spark, folder, "loans")))


@query("clean_rate", """
SELECT loan_id, int_rate, CAST(regexp_replace(int_rate, '%+$', '') AS DOUBLE) AS int_rate_clean FROM loans""", ("loans",))
def clean_rate(spark, folder):
    return add_clean_rate(view(spark, folder, "loans").select("loan_id", "int_rate"))


@query("engineer_features", f"""WITH {ENGINEERED}
SELECT loan_id, round(loan_to_income, 6) AS loan_to_income, int_rate, revol_util, term_months, emp_length_years FROM e""", ("loans",))
def engineered_features(spark, folder):
    made = engineer_features(view(spark, folder, "loans"))
    columns = ("loan_id", "loan_to_income", "int_rate", "revol_util", "term_months", "emp_length_years")
    return rounded(made.select(*columns), 6, "loan_to_income")
