"""Queries on decision thresholds and classification metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskspark.functions.columns import above
from riskspark.operators import metrics, thresholds
from riskspark.operators.models import decide
from riskspark.operators.split import stratified_split
from workload.registry import longs, query, rounded
from workload.views import view

GRID = ", ".join(f"(CAST({t!r} AS DOUBLE))" for t in thresholds.threshold_grid())
FEW = "(CAST(0.3 AS DOUBLE)), (CAST(0.5 AS DOUBLE)), (CAST(0.7 AS DOUBLE))"


def _sweep_sql(values: str, last: str) -> str:
    return f"""
WITH grid(threshold) AS (VALUES {values}),
cm AS (SELECT threshold,
  count(*) FILTER (WHERE y_true = 1 AND p1 >= threshold) AS tp,
  count(*) FILTER (WHERE y_true = 0 AND p1 >= threshold) AS fp,
  count(*) FILTER (WHERE y_true = 0 AND p1 < threshold) AS tn,
  count(*) FILTER (WHERE y_true = 1 AND p1 < threshold) AS fn
  FROM scored CROSS JOIN grid GROUP BY threshold),
pr AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision_, coalesce(tp / nullif(tp + fn, 0), 0) AS recall_ FROM cm),
m AS (SELECT threshold, precision_ AS precision, recall_ AS recall,
  coalesce(2 * (precision_ * recall_) / nullif(precision_ + recall_, 0), 0) AS f1,
  fp * 1 + fn * 5 AS cost,
  recall_ + coalesce(tn / nullif(tn + fp, 0), 0) - 1 AS youden,
  tp, fp, tn, fn FROM pr)
{last}"""


ALL_COLUMNS = """SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
 CAST(cost AS BIGINT) AS cost, round(youden, 6) AS youden, tp, fp, tn, fn FROM m"""


def _clean(df):
    return longs(rounded(df, 6, "precision", "recall", "f1", "youden"), "cost", "tp", "fp", "tn", "fn")


def _sweep(spark, folder):
    return thresholds.threshold_sweep(view(spark, folder, "scored"), "y_true", "p1")


@query("threshold_sweep", _sweep_sql(GRID, ALL_COLUMNS), ("scored",))
def threshold_sweep(spark, folder):
    return _clean(_sweep(spark, folder))


@query("best_threshold_cost", _sweep_sql(GRID, ALL_COLUMNS + " ORDER BY m.cost, threshold LIMIT 1"), ("scored",))
def best_threshold_cost(spark, folder):
    return _clean(thresholds.best_threshold(_sweep(spark, folder), "cost"))


@query("best_threshold_f1", _sweep_sql(GRID, ALL_COLUMNS + " ORDER BY m.f1 DESC, threshold LIMIT 1"), ("scored",))
def best_threshold_f1(spark, folder):
    return _clean(thresholds.best_threshold(_sweep(spark, folder), "f1"))


@query("best_threshold_youden", _sweep_sql(GRID, ALL_COLUMNS + " ORDER BY m.youden DESC, threshold LIMIT 1"), ("scored",))
def best_threshold_youden(spark, folder):
    return _clean(thresholds.best_threshold(_sweep(spark, folder), "youden"))


FLAT = """SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
 CAST(cost AS BIGINT) AS total_cost, tn, fp, fn, tp FROM m"""


def _flat(df):
    flat = df.select("threshold", "precision", "recall", "f1", "total_cost", "confusion_matrix.*")
    return longs(rounded(flat, 6, "precision", "recall", "f1"), "total_cost", "tn", "fp", "fn", "tp")


@query("compare_thresholds", _sweep_sql(FEW, FLAT), ("scored",))
def compare_thresholds(spark, folder):
    return _flat(thresholds.compare_thresholds(view(spark, folder, "scored"), "y_true", "p1"))


@query(
    "compare_thresholds_compact",
    _sweep_sql(FEW, """SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall,
      round(f1, 6) AS f1, CAST(cost AS BIGINT) AS total_cost FROM m"""),
    ("scored",),
)
def compare_thresholds_compact(spark, folder):
    few = thresholds.compare_thresholds(view(spark, folder, "scored"), "y_true", "p1")
    return longs(rounded(thresholds.compact(few), 6, "precision", "recall", "f1"), "total_cost")


@query("evaluate_at_threshold", _sweep_sql("(CAST(0.42 AS DOUBLE))", FLAT), ("scored",))
def evaluate_at_threshold(spark, folder):
    return _flat(thresholds.evaluate_at_threshold(view(spark, folder, "scored"), "y_true", "p1", 0.42))


@query("evaluate_at_best_threshold", _sweep_sql(GRID, FLAT + " ORDER BY m.cost, threshold LIMIT 1"), ("scored",))
def evaluate_at_best_threshold(spark, folder):
    best = thresholds.optimal_threshold(_sweep(spark, folder))
    return _flat(thresholds.evaluate_at_threshold(view(spark, folder, "scored"), "y_true", "p1", best))


@query(
    "confusion_matrix",
    """SELECT count(*) FILTER (WHERE y_true = 0 AND p1 < 0.5) AS tn, count(*) FILTER (WHERE y_true = 0 AND p1 >= 0.5) AS fp,
       count(*) FILTER (WHERE y_true = 1 AND p1 < 0.5) AS fn, count(*) FILTER (WHERE y_true = 1 AND p1 >= 0.5) AS tp FROM scored""",
    ("scored",),
)
def confusion_matrix(spark, folder):
    return metrics.confusion(view(spark, folder, "scored"), "y_true", above(F.col("p1")))


SPLIT = """ranked AS (SELECT *, row_number() OVER (PARTITION BY y_true ORDER BY md5(concat(cast(loan_id AS string), '42'))) AS rn,
   count(*) OVER (PARTITION BY y_true) AS n FROM scored),
 parted AS (SELECT *, CASE WHEN rn <= ceil(n * 0.2) THEN 'test'
   WHEN rn <= ceil(n * 0.2) + ceil((n - ceil(n * 0.2)) * 0.125) THEN 'validation' ELSE 'train' END AS split FROM ranked)"""


@query("f1_by_split", f"""WITH {SPLIT},
cm AS (SELECT split, sum(CASE WHEN y_true = 1 AND p1 >= 0.5 THEN 1 ELSE 0 END) AS tp,
  sum(CASE WHEN y_true = 0 AND p1 >= 0.5 THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN y_true = 1 AND p1 < 0.5 THEN 1 ELSE 0 END) AS fn FROM parted GROUP BY split)
SELECT split, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM cm""", ("scored",))
def f1_by_split(spark, folder):
    parted = stratified_split(view(spark, folder, "scored"), "loan_id", "y_true")
    return rounded(metrics.f1_by(parted, "y_true", "p1", ["split"]))


AUC = """SELECT {by} CAST(sum(pos * (below + 0.5 * neg)) AS DOUBLE) / (sum(pos) * CAST(sum(neg) AS DOUBLE)) AS roc_auc
 FROM (SELECT {by} p1, pos, neg, coalesce(sum(neg) OVER ({part} ORDER BY p1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
   FROM (SELECT {by} p1, count(*) FILTER (WHERE y_true = 1) AS pos, count(*) FILTER (WHERE y_true = 0) AS neg FROM {source} GROUP BY {by} p1) c) d"""


def _auc_sql(source: str, by: str = "") -> str:
    text = AUC.format(by=f"{by}, " if by else "", part=f"PARTITION BY {by}" if by else "", source=source)
    return text + (f" GROUP BY {by}" if by else "")


@query("roc_auc", f"SELECT round(roc_auc, 6) AS roc_auc FROM ({_auc_sql('scored')}) a", ("scored",))
def roc_auc(spark, folder):
    return rounded(metrics.roc_auc(view(spark, folder, "scored"), "y_true", "p1"))


@query(
    "roc_auc_by_split",
    f"WITH {SPLIT} SELECT split, round(roc_auc, 6) AS roc_auc FROM ({_auc_sql('parted', 'split')}) a",
    ("scored",),
)
def roc_auc_by_split(spark, folder):
    parted = stratified_split(view(spark, folder, "scored"), "loan_id", "y_true")
    return rounded(metrics.roc_auc(parted, "y_true", "p1", ["split"]))


@query("classification_report", """
WITH p AS (SELECT y_true AS y, CASE WHEN p1 >= 0.5 THEN 1 ELSE 0 END AS yhat FROM scored),
c AS (SELECT class, (SELECT count(*) FROM p WHERE y = class) AS support,
  (SELECT count(*) FROM p WHERE yhat = class) AS predicted,
  (SELECT count(*) FROM p WHERE y = class AND yhat = class) AS hits FROM (VALUES (0), (1)) v(class)),
m AS (SELECT class, support, hits, coalesce(hits / nullif(predicted, 0), 0) AS pr, coalesce(hits / nullif(support, 0), 0) AS re FROM c),
f AS (SELECT *, coalesce(2 * pr * re / nullif(pr + re, 0), 0) AS f1 FROM m)
SELECT CAST(class AS string) AS class, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1, support FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(hits) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', round(avg(pr), 6), round(avg(re), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(pr * support) / sum(support), 6), round(sum(re * support) / sum(support), 6),
  round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f""", ("scored",))
def classification_report(spark, folder):
    scored = view(spark, folder, "scored").withColumn("prediction", above(F.col("p1")))
    return rounded(metrics.classification_report(scored, "y_true", "prediction"))


@query("loan_decisions", """
SELECT loan_id, p1, CAST(CASE WHEN p1 >= 0.5 THEN 1 ELSE 0 END AS BIGINT) AS prediction,
  CASE WHEN p1 >= 0.5 THEN 'Default' ELSE 'No Default' END AS prediction_label,
  CASE WHEN p1 < 0.3 THEN 'Low' WHEN p1 < 0.6 THEN 'Medium' ELSE 'High' END AS risk_level FROM scored""", ("scored",))
def loan_decisions(spark, folder):
    decided = decide(view(spark, folder, "scored").select("loan_id", "p1"), 0.5)
    return longs(decided, "prediction")


@query("late_labels", """
SELECT s.loan_id, s.p1, l.loan_status FROM scored s JOIN loans l ON s.loan_id = l.loan_id""", ("scored", "loans"))
def late_labels(spark, folder):
    labels = view(spark, folder, "loans").select("loan_id", "loan_status")
    return metrics.join_labels(view(spark, folder, "scored").select("loan_id", "p1"), labels)


@query("hot_customer_join", """
WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_custkey END AS c_custkey FROM orders)
SELECT o_orderkey, t.c_custkey, c_mktsegment FROM t LEFT JOIN customer c ON t.c_custkey = c.c_custkey""")
def hot_customer_join(spark, folder):
    """A join in which a third of the rows share one key."""
    key = F.when(F.col("o_orderkey") % 3 == 0, F.lit(1).cast("long")).otherwise(F.col("o_custkey"))
    orders = view(spark, folder, "orders").select("o_orderkey", key.alias("c_custkey"))
    customers = view(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    return metrics.join_labels(orders, customers, "c_custkey", "left")
