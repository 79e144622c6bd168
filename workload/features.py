"""Queries on feature fitting, encoding and splitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskspark.operators import preprocess, split
from riskspark.operators.preprocess import engineer_features, fit, prepare, transform
from riskspark.operators.quantiles import exact_medians
from riskspark.operators.ranking import category_dictionary
from riskspark.session import new_path
from workload.registry import longs, query, rounded
from workload.tables import ENGINEERED
from workload.thresholds import SPLIT
from workload.views import view

NUMERIC = (
    "loan_amnt", "int_rate", "installment", "annual_inc", "dti", "delinq_2yrs", "fico_range_high",
    "revol_bal", "revol_util", "loan_to_income", "term_months", "emp_length_years",
)
TEXT = ("term", "grade", "emp_length", "half_note")
ORDER = (
    "loan_amnt", "term", "int_rate", "installment", "grade", "emp_length", "annual_inc", "dti",
    "delinq_2yrs", "fico_range_high", "revol_bal", "revol_util", "half_note", "loan_to_income",
    "term_months", "emp_length_years",
)

FILLED = (
    f"{ENGINEERED}, med AS (SELECT "
    + ", ".join(f"quantile_cont({c}, 0.5) AS {c}_med" for c in NUMERIC)
    + " FROM e), f AS (SELECT loan_id, loan_status, "
    + ", ".join(f"coalesce({c}, {c}_med) AS {c}" for c in NUMERIC)
    + ", "
    + ", ".join(f"coalesce({c}, 'missing') AS {c}" for c in TEXT)
    + " FROM e, med), st AS (SELECT "
    + ", ".join(f"avg({c}) AS {c}_mean, stddev_pop({c}) AS {c}_std" for c in NUMERIC)
    + " FROM f)"
)
DICTIONARY = "dict AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", v AS \"value\", row_number() OVER (ORDER BY v) - 1 AS code "
    f"FROM (SELECT DISTINCT {c} AS v FROM f) x" for c in TEXT
) + ")"


def _engineered(spark, folder):
    return engineer_features(prepare(view(spark, folder, "loans")))


def _fitted(rows):
    return fit(rows, "loan_status", ["loan_id", "issue_ts"])


@query("numeric_stats", f"WITH {FILLED} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round({c}_med, 4) AS median, round({c}_mean, 4) AS mean, round({c}_std, 4) AS std FROM med, st"
    for c in NUMERIC
), ("loans",))
def numeric_stats(spark, folder):
    state = _fitted(_engineered(spark, folder))
    return rounded(preprocess.numeric_stats_table(state, spark), 4)


@query("category_dictionary", f"WITH {FILLED}, {DICTIONARY} SELECT * FROM dict", ("loans",))
def dictionary(spark, folder):
    return category_dictionary(_engineered(spark, folder), TEXT)[0]


TRANSFORMED = (
    f"WITH {FILLED}, {DICTIONARY} SELECT loan_id, "
    + ", ".join(f"round(({c} - {c}_mean) / CASE WHEN {c}_std = 0 THEN 1 ELSE {c}_std END, 6) AS {c}" for c in NUMERIC)
    + ", "
    + ", ".join(f"CAST(d_{c}.code AS DOUBLE) AS {c}" for c in TEXT)
    + " FROM f CROSS JOIN st "
    + " ".join(f"JOIN dict d_{c} ON d_{c}.\"column\" = '{c}' AND d_{c}.\"value\" = f.{c}" for c in TEXT)
)


@query("transform_loans", TRANSFORMED, ("loans",))
def transform_loans(spark, folder):
    rows = _engineered(spark, folder)
    return rounded(transform(rows, _fitted(rows), ["loan_id"]), 6, *NUMERIC)


@query("preprocessor_roundtrip", TRANSFORMED, ("loans",))
def preprocessor_roundtrip(spark, folder):
    rows = _engineered(spark, folder)
    path = new_path(spark, "preprocessor")
    preprocess.save(_fitted(rows), spark, path)
    return rounded(transform(rows, preprocess.load(spark, path), ["loan_id"]), 6, *NUMERIC)


@query("transform_loans_shuffled", TRANSFORMED, ("loans",))
def transform_loans_shuffled(spark, folder):
    """The same with dictionaries treated as too big to broadcast."""
    rows = _engineered(spark, folder)
    state = _fitted(rows)
    return rounded(transform(rows, state, ["loan_id"], sort_merge=True), 6, *NUMERIC)


LARGE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey")


@query("medians_of_large_table", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(quantile_cont({c}, 0.5) AS DOUBLE) AS median FROM lineitem" for c in LARGE
))
def medians_of_large_table(spark, folder):
    """The path for tables above the direct size, on any size: brackets, then few values."""
    found = exact_medians(view(spark, folder, "lineitem"), LARGE, direct_rows=0, keep_inside=500)
    return spark.createDataFrame(list(found.items()), "column string, median double")


@query("dictionary_of_large_column", """
SELECT 'c_name' AS "column", c_name AS "value", row_number() OVER (ORDER BY c_name) - 1 AS code FROM (SELECT DISTINCT c_name FROM customer) x
UNION ALL SELECT 'c_mktsegment', s, row_number() OVER (ORDER BY s) - 1 FROM (SELECT DISTINCT c_mktsegment AS s FROM customer) y""")
def dictionary_of_large_column(spark, folder):
    """The path for columns with too many values for one window."""
    return category_dictionary(view(spark, folder, "customer"), ["c_name", "c_mktsegment"], group_limit=10)[0]


@query("encode_unseen_categories", f"""
WITH a AS (SELECT loan_id, coalesce(grade, 'missing') AS grade FROM loans),
d AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT grade AS v FROM reference_loans
  WHERE grade IN ('A', 'B')) x)
SELECT loan_id, CAST(coalesce(code, -1) AS DOUBLE) AS grade FROM a LEFT JOIN d ON a.grade = d.v""", ("loans", "reference_loans"))
def encode_unseen_categories(spark, folder):
    known = view(spark, folder, "reference_loans").filter(F.col("grade").isin("A", "B")).select("loan_id", "grade")
    state = fit(known, exclude=["loan_id"])
    return transform(view(spark, folder, "loans").select("loan_id", "grade"), state, ["loan_id"])


@query("stratified_split", f"WITH {SPLIT} SELECT loan_id, y_true, split FROM parted", ("scored",))
def stratified_split(spark, folder):
    scored = view(spark, folder, "scored").select("loan_id", "y_true")
    return split.stratified_split(scored, "loan_id", "y_true")


@query("split_summary", f"WITH {SPLIT} SELECT split, y_true, count(*) AS \"rows\" FROM parted GROUP BY split, y_true", ("scored",))
def split_summary(spark, folder):
    scored = view(spark, folder, "scored").select("loan_id", "y_true")
    return split.split_summary(split.stratified_split(scored, "loan_id", "y_true"), "y_true")


@query("stratified_folds", """
WITH r AS (SELECT loan_id, y_true, row_number() OVER (PARTITION BY y_true ORDER BY md5(concat(cast(loan_id AS string), '43'))) AS rn,
  count(*) OVER (PARTITION BY y_true) AS n FROM scored)
SELECT loan_id, y_true, CAST(CASE WHEN rn <= (n + 2) // 3 THEN 0
  WHEN rn <= (n + 2) // 3 + (n - (n + 2) // 3 + 1) // 2 THEN 1 ELSE 2 END AS BIGINT) AS fold FROM r""", ("scored",))
def stratified_folds(spark, folder):
    scored = view(spark, folder, "scored").select("loan_id", "y_true")
    return longs(split.stratified_folds(scored, "loan_id", "y_true"), "fold")


@query("positive_weight", """
SELECT round(count(*) FILTER (WHERE y_true = 0) / count(*) FILTER (WHERE y_true = 1), 6) AS scale_pos_weight FROM scored""", ("scored",))
def positive_weight(spark, folder):
    return rounded(split.positive_weight(view(spark, folder, "scored"), "y_true"))


@query("balanced_weights", """
SELECT y_true, count(*) AS "rows", round((SELECT count(*) FROM scored) / (2 * count(*)), 6) AS weight
FROM scored GROUP BY y_true""", ("scored",))
def balanced_weights(spark, folder):
    return rounded(split.balanced_weights(view(spark, folder, "scored"), "y_true"))


@query("document_label_weights", """
SELECT toxic, count(*) AS "rows", round((SELECT count(*) FROM labels l JOIN documents d ON l.doc_id = d.doc_id) / (2 * count(*)), 6) AS weight
FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY toxic""")
def document_label_weights(spark, folder):
    labelled = view(spark, folder, "labels").join(view(spark, folder, "documents").select("doc_id"), "doc_id")
    return rounded(split.balanced_weights(labelled, "toxic"))
