"""Input views over the given tables, as SQL text that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskspark.session import spread

LOANS = """
SELECT
  o_orderkey                                   AS loan_id,
  o_orderdate                                  AS issue_ts,
  o_totalprice / 12.5                          AS loan_amnt,
  CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN ' 60 months'
       WHEN o_orderkey % 97 = 0 THEN 'open' ELSE ' 36 months' END AS term,
  concat(cast(5 + o_orderkey % 21 AS string), '.5%') AS int_rate,
  (50 + o_orderkey % 1451) * CAST(1 AS double) AS installment,
  CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN NULL ELSE substr(c_mktsegment, 1, 1) END AS grade,
  CASE o_orderkey % 13 WHEN 0 THEN '< 1 year' WHEN 1 THEN '1 year' WHEN 10 THEN '10+ years'
       WHEN 11 THEN NULL WHEN 12 THEN 'self-employed'
       ELSE concat(cast(o_orderkey % 13 AS string), ' years') END AS emp_length,
  CASE WHEN c_acctbal < 0 THEN NULL ELSE 20000 + c_acctbal * 13 END AS annual_inc,
  (o_orderkey % 401) / CAST(10 AS double)      AS dti,
  o_custkey % 5                                AS delinq_2yrs,
  600 + o_custkey % 250                        AS fico_range_high,
  CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE (o_orderkey * 37 % 50000) * CAST(1 AS double) END AS revol_bal,
  concat(cast(o_custkey % 101 AS string), '%') AS revol_util,
  CASE WHEN o_orderkey % 10 = 0 THEN o_orderpriority END AS note,
  CASE WHEN o_orderkey % 2 = 0 THEN c_name END AS half_note,
  o_totalprice * 0.25                          AS total_pymnt,
  CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 100 ELSE 0 END AS recoveries,
  CASE WHEN o_orderstatus = 'O' THEN 'Current'
       WHEN o_orderstatus = 'P' THEN 'Fully Paid'
       WHEN o_orderkey % 3 = 0 THEN 'Default'
       WHEN o_orderkey % 3 = 1 THEN 'Charged Off'
       ELSE 'Late (31-120 days)' END           AS loan_status
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
"""

# Positives score 0.300 to 1.000, negatives 0.000 to 0.700.
SCORED = """
SELECT loan_id, issue_ts, y_true, p1, 1 - p1 AS p0 FROM (
  SELECT loan_id, issue_ts, y_true,
         (loan_id * 7919 % 701 + y_true * 300) / CAST(1000 AS double) AS p1
  FROM (SELECT loan_id, issue_ts,
               CASE WHEN loan_status IN ('Charged Off','Default') THEN 1 ELSE 0 END AS y_true
        FROM {loans}) a) b
"""

# Two model versions scored on the same loans; the second one is scaled up.
VERSIONS = """
SELECT loan_id, y_true, '1.0.0' AS version, '2024-01-10T09:00:00' AS registered_at, p1 FROM {scored}
UNION ALL
SELECT loan_id, y_true, '1.1.0' AS version, '2024-03-05T09:00:00' AS registered_at,
       least(CAST(1 AS double), p1 * CAST(1.1 AS double)) AS p1 FROM {scored}
"""

# Application records as they arrive: rates are text, some do not parse, some fields are empty.
APPLICATIONS = """
SELECT loan_id, loan_amnt, trim(term) AS term,
       CASE WHEN loan_id % 31 = 0 THEN 'n/a' ELSE regexp_replace(int_rate, '%+$', '') END AS int_rate,
       installment, grade, emp_length, annual_inc,
       CASE WHEN loan_id % 43 = 0 THEN NULL ELSE dti END AS dti,
       fico_range_high, revol_bal,
       CAST(regexp_replace(revol_util, '%+$', '') AS double) AS revol_util
FROM {loans}
"""

PREDICTIONS = """
SELECT event_id, ts, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS prediction,
       least(CAST(1 AS double), value / CAST(500 AS double)) AS p1,
       1 - least(CAST(1 AS double), value / CAST(500 AS double)) AS p0
FROM {events}
"""

REFERENCE = "SELECT * FROM {loans} WHERE issue_ts < TIMESTAMP '1998-07-01 00:00:00'"

CURRENT = """
SELECT loan_id, loan_amnt * 2 AS loan_amnt, term, int_rate, installment, grade, emp_length, annual_inc, dti,
       delinq_2yrs, fico_range_high, revol_bal, revol_util, note, half_note, total_pymnt, recoveries, loan_status
FROM {loans} WHERE issue_ts >= TIMESTAMP '1998-07-01 00:00:00'
"""

VIEWS = {
    "loans": (LOANS, ("orders", "customer")),
    "scored": (SCORED, ("loans",)),
    "versions": (VERSIONS, ("scored",)),
    "applications": (APPLICATIONS, ("loans",)),
    "predictions": (PREDICTIONS, ("events",)),
    "reference_loans": (REFERENCE, ("loans",)),
    "current_loans": (CURRENT, ("loans",)),
}


def view(spark: SparkSession, folder: str, name: str, heavy: bool = False) -> DataFrame:
    """A view by name, or a given table. Nothing is registered in the session.

    The test files have one row group each, so a table arrives in one task; ``heavy`` work
    gets it spread over the cores.
    """
    if name not in VIEWS:
        table = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
        return spread(table) if heavy else table
    text, sources = VIEWS[name]
    # Timestamps of the files carry no zone; the literals in the views must not either.
    text = text.replace("TIMESTAMP '", "TIMESTAMP_NTZ '")
    return spark.sql(text, **{s: view(spark, folder, s, heavy) for s in sources})


def with_views(body: str, *names: str) -> str:
    """The SQL for DuckDB: ``body`` after the views it uses and those they use."""
    ordered: list[str] = []

    def need(name: str) -> None:
        if name in VIEWS and name not in ordered:
            for source in VIEWS[name][1]:
                need(source)
            ordered.append(name)

    for name in names:
        need(name)
    ctes = [f"{n} AS ({VIEWS[n][0].format(**{s: s for s in VIEWS[n][1]})})" for n in ordered]
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join(ctes)}, {body[5:]}"
    return f"WITH {', '.join(ctes)} {body}"
