"""Queries on drift, the performance log, metric history and the streaming jobs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskspark.operators import drift, history, perflog
from riskspark.operators.metrics import evaluate, model_comparison
from riskspark.plans.monitoring import check_drift, log_scored
from riskspark.session import cut_lineage, new_path
from riskspark.sources.sinks import append_aligned, append_batch, read_log
from riskspark.streaming import jobs
from workload.registry import query, rounded
from workload.views import view

NUMERIC = (
    "loan_id", "loan_amnt", "installment", "annual_inc", "dti", "fico_range_high", "revol_bal", "total_pymnt", "recoveries",
)
TEXT = (
    "term", "int_rate", "grade", "emp_length", "delinq_2yrs", "revol_util", "note", "half_note", "loan_status",
)
COLUMNS = NUMERIC + TEXT
DRIFT_VIEWS = ("reference_loans", "current_loans")


def _sides(spark, folder):
    return view(spark, folder, "reference_loans"), view(spark, folder, "current_loans")


def _numeric_cte() -> str:
    parts = []
    for c in NUMERIC:
        parts.append(f"""SELECT '{c}' AS feature, max(gap) AS ks, coalesce(sum(gap * (nxt - v)), 0) / greatest(max(sd), 0.001) AS wasserstein,
 max(nr) AS n_ref, max(nc) AS n_cur FROM (
 SELECT v, lead(v) OVER (ORDER BY v) AS nxt, nr, nc, sd,
  abs(sum(r) OVER (ORDER BY v) / nr - sum(c) OVER (ORDER BY v) / nc) AS gap FROM (
  SELECT v, sum(r) AS r, sum(c) AS c FROM (
   SELECT CAST({c} AS DOUBLE) AS v, 1 AS r, 0 AS c FROM reference_loans WHERE {c} IS NOT NULL
   UNION ALL SELECT CAST({c} AS DOUBLE), 0, 1 FROM current_loans WHERE {c} IS NOT NULL) u GROUP BY v) g,
  (SELECT CAST(count({c}) AS DOUBLE) AS nr, stddev_pop({c}) AS sd FROM reference_loans) a,
  (SELECT CAST(count({c}) AS DOUBLE) AS nc FROM current_loans) b) w""")
    return "num AS (" + " UNION ALL ".join(parts) + ")"


def _frequency_cte(columns=TEXT) -> str:
    parts = [f"""SELECT '{c}' AS feature, "value", sum(r) AS ref, sum(c) AS cur FROM (
  SELECT CAST({c} AS string) AS "value", 1 AS r, 0 AS c FROM reference_loans WHERE {c} IS NOT NULL
  UNION ALL SELECT CAST({c} AS string), 0, 1 FROM current_loans WHERE {c} IS NOT NULL) u GROUP BY "value" """
             for c in columns]
    return "freq AS (" + " UNION ALL ".join(parts) + ")"


CATEGORY = """tot AS (SELECT feature, CAST(sum(ref) AS DOUBLE) AS nr, CAST(sum(cur) AS DOUBLE) AS nc FROM freq GROUP BY feature),
cat AS (SELECT f.feature, max(nr) AS n_ref, max(nc) AS n_cur, count(*) - 1 AS degrees,
  sum(CASE WHEN ref = 0 THEN CAST('inf' AS DOUBLE) ELSE (cur - ref * nc / nr) * (cur - ref * nc / nr) / (ref * nc / nr) END) AS chi2,
  sqrt(sum(CASE WHEN ref > 0 THEN ref / nr * ln(ref / nr / ((ref / nr + cur / nc) / 2)) ELSE 0 END
     + CASE WHEN cur > 0 THEN cur / nc * ln(cur / nc / ((ref / nr + cur / nc) / 2)) ELSE 0 END) / 2) AS jensen_shannon,
  max(abs(ref / nr - cur / nc) / sqrt((ref + cur) / (nr + nc) * (1 - (ref + cur) / (nr + nc)) * (1 / nr + 1 / nc))) AS z
  FROM freq f JOIN tot t ON f.feature = t.feature GROUP BY f.feature)"""

BOTH = f"WITH {_numeric_cte()}, {_frequency_cte()}, {CATEGORY}"
REPORT = f"""{BOTH}, rep AS (
 SELECT feature, 'numeric' AS kind, 'wasserstein' AS test, round(wasserstein, 6) AS statistic, wasserstein >= 0.1 AS drifted FROM num
 UNION ALL SELECT feature, CASE WHEN feature = 'delinq_2yrs' THEN 'numeric' ELSE 'categorical' END, 'jensen_shannon',
  round(jensen_shannon, 6), jensen_shannon >= 0.1 FROM cat)"""

@query("drift_report", f"{REPORT} SELECT * FROM rep", DRIFT_VIEWS)
def drift_report(spark, folder):
    report = drift.drift_report(*_sides(spark, folder), COLUMNS, method="distance")
    return rounded(report.drop("p_value"))


@query("drift_report_bounded", f"{REPORT} SELECT feature, kind, drifted FROM rep", DRIFT_VIEWS)
def drift_report_bounded(spark, folder):
    """The verdicts of ``drift_report`` without a shuffle of the values of numeric columns."""
    report = drift.drift_report(*_sides(spark, folder), COLUMNS, method="bounded")
    return report.select("feature", "kind", "drifted")


@query("distance_bounds", f"""WITH {_numeric_cte()}
SELECT feature, round(ks, 6) AS ks, round(wasserstein, 6) AS wasserstein, CAST(n_ref AS BIGINT) AS n_ref, CAST(n_cur AS BIGINT) AS n_cur,
 true AS ks_holds, true AS wasserstein_holds, true AS narrow FROM num""", DRIFT_VIEWS)
def distance_bounds(spark, folder):
    """The exact distances, whether the estimates lie within their errors of them, and whether those errors are narrow."""
    stacked = cut_lineage(drift.stack(*_sides(spark, folder), NUMERIC), "stacked")
    profiles = drift.profile(stacked, NUMERIC)
    exact = drift.numeric_distances(stacked, profiles)
    found = drift.distance_bounds(stacked, profiles).drop("n_ref", "n_cur")
    both = exact.join(found.withColumnsRenamed({"ks": "ks_near", "wasserstein": "wasserstein_near"}), "feature")
    holds = {
        f"{c}_holds": F.abs(F.col(c) - F.col(f"{c}_near")) <= F.col(f"{c}_error") + drift.ROUNDING
        for c in ("ks", "wasserstein")
    }
    narrow = (F.col("ks_error") <= 0.02) & (F.col("wasserstein_error") <= 0.02)
    kept = both.select("feature", "ks", "wasserstein", "n_ref", "n_cur", *(e.alias(c) for c, e in holds.items()), narrow.alias("narrow"))
    return rounded(kept)


@query("drift_summary", f"""{REPORT}
SELECT count(*) FILTER (WHERE drifted) / count(*) >= 0.5 AS drift_detected,
 coalesce(string_agg(CASE WHEN drifted THEN feature END, ',' ORDER BY feature), '') AS drifted_features,
 round(count(*) FILTER (WHERE drifted) / count(*), 6) AS drift_share, count(*) AS total_features FROM rep""", DRIFT_VIEWS)
def drift_summary(spark, folder):
    report = drift.drift_report(*_sides(spark, folder), COLUMNS, method="distance")
    summary = drift.drift_summary(report)
    return rounded(summary.withColumn("drifted_features", F.array_join("drifted_features", ",")))


TESTS = f"""{REPORT}
SELECT 'drift:' || feature AS name, CASE WHEN drifted THEN 'FAIL' ELSE 'SUCCESS' END AS status FROM rep
UNION ALL SELECT 'share_of_drifted_columns', CASE WHEN count(*) FILTER (WHERE drifted) / count(*) < 0.5 THEN 'SUCCESS' ELSE 'FAIL' END FROM rep"""


@query("drift_tests", TESTS, DRIFT_VIEWS)
def drift_tests(spark, folder):
    report = drift.drift_report(*_sides(spark, folder), COLUMNS, method="distance")
    return drift.drift_tests(report)


@query("drift_results_file", TESTS, DRIFT_VIEWS)
def drift_results_file(spark, folder):
    path = new_path(spark, "drift-results")
    check_drift(*_sides(spark, folder), COLUMNS, results_path=path, method="distance")
    return spark.read.schema("name string, status string").json(path)


@query("drift_hypothesis_tests", f"""{BOTH}
SELECT feature, 'ks' AS test, round(ks, 6) AS statistic FROM num
UNION ALL SELECT feature, CASE WHEN degrees <= 1 THEN 'z' ELSE 'chi_square' END, round(CASE WHEN degrees <= 1 THEN z ELSE chi2 END, 6) FROM cat""", DRIFT_VIEWS)
def drift_hypothesis_tests(spark, folder):
    report = drift.drift_report(*_sides(spark, folder), COLUMNS, method="test")
    return rounded(report.select("feature", "test", "statistic"))


@query("ks_p_values", f"""WITH {_numeric_cte()},
x AS (SELECT feature, n_ref * n_cur / (n_ref + n_cur) * ks * ks AS x FROM num),
s AS (SELECT feature, x, sum(CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * j * j * x)) AS t FROM x, (SELECT unnest(range(1, 101)) AS j) q GROUP BY feature, x)
SELECT feature, round(CASE WHEN x < 0.04 THEN 1 ELSE greatest(0, least(1, 2 * t)) END, 6) AS p_value FROM s""", DRIFT_VIEWS)
def ks_p_values(spark, folder):
    report = drift.drift_report(*_sides(spark, folder), NUMERIC, method="test")
    return rounded(report.select("feature", "p_value"))


@query("chi_square_p_values", f"""{BOTH},
terms AS (SELECT feature, degrees, chi2 / 2 AS h, unnest(range(0, CAST(degrees // 2 AS BIGINT))) AS i FROM cat
 WHERE degrees > 1 AND degrees % 2 = 0 AND chi2 < 1000)
SELECT feature, round(sum(exp(i * ln(h) - lgamma(i + 1) - h)), 6) AS p_value FROM terms GROUP BY feature""", DRIFT_VIEWS)
def chi_square_p_values(spark, folder):
    """Columns with an even number of degrees of freedom, whose p-value is a finite sum."""
    sides = _sides(spark, folder)
    report = drift.drift_report(*sides, TEXT, method="test").filter("test = 'chi_square' AND statistic < 1000")
    stacked = drift.stack(*sides, TEXT)
    degrees = drift.category_frequencies(stacked, TEXT).groupBy("feature").agg((F.count("*") - 1).alias("degrees"))
    return rounded(report.join(degrees.filter("degrees % 2 = 0"), "feature").select("feature", "p_value"))


@query("category_frequencies", f"WITH {_frequency_cte()} SELECT feature, \"value\", CAST(ref AS BIGINT) AS ref, CAST(cur AS BIGINT) AS cur FROM freq", DRIFT_VIEWS)
def category_frequencies(spark, folder):
    stacked = drift.stack(*_sides(spark, folder), TEXT)
    return drift.category_frequencies(stacked.withColumn("delinq_2yrs", F.col("delinq_2yrs").cast("long")), TEXT)


PREDICTED = "CASE WHEN p1 >= 0.5 THEN 1 ELSE 0 END"


@query("prediction_drift", f"""
WITH r AS (SELECT {PREDICTED} AS p FROM scored WHERE issue_ts < TIMESTAMP '1998-07-01 00:00:00'),
c AS (SELECT {PREDICTED} AS p FROM scored WHERE issue_ts >= TIMESTAMP '1998-07-01 00:00:00'),
s AS (SELECT CAST((SELECT count(*) FROM r) AS DOUBLE) AS nr, CAST((SELECT count(*) FROM c) AS DOUBLE) AS nc,
  CAST((SELECT sum(p) FROM r) AS DOUBLE) AS hr, CAST((SELECT sum(p) FROM c) AS DOUBLE) AS hc)
SELECT 'prediction' AS feature, 'z' AS test,
 round(abs(hr / nr - hc / nc) / sqrt((hr + hc) / (nr + nc) * (1 - (hr + hc) / (nr + nc)) * (1 / nr + 1 / nc)), 6) AS statistic FROM s""", ("scored",))
def prediction_drift(spark, folder):
    scored = view(spark, folder, "scored").withColumn("prediction", (F.col("p1") >= 0.5).cast("int"))
    cut = F.lit("1998-07-01").cast("timestamp_ntz")
    report = drift.prediction_drift(
        scored.filter(F.col("issue_ts") < cut), scored.filter(F.col("issue_ts") >= cut),
        method="test",
    )
    return rounded(report.select("feature", "test", "statistic"))


DAILY = """SELECT date_trunc('day', ts) AS "timestamp", count(*) AS num_predictions, avg(p1) AS mean_probability,
 avg(prediction) AS prediction_rate, avg(greatest(p0, p1)) AS avg_confidence FROM predictions GROUP BY 1"""
ROUNDED_LOG = """strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS "timestamp", num_predictions, round(mean_probability + 1e-12, 6) AS mean_probability,
 round(prediction_rate + 1e-12, 6) AS prediction_rate, round(avg_confidence + 1e-12, 6) AS avg_confidence"""


def _daily(spark, folder):
    rows = view(spark, folder, "predictions").withColumn("ts", F.col("ts").cast("timestamp"))
    return perflog.batch_log(rows, F.date_trunc("day", "ts"))


def _nudged(log):
    """Round to six places. The values have few decimals, so averages of few rows often lie exactly
    between two roundings; the same nudge here and in the SQL sends them all the same way."""
    means = ("mean_probability", "prediction_rate", "avg_confidence")
    return rounded(log.withColumns({c: F.col(c) + F.lit(1e-12) for c in means}))


def _texts(log):
    return _nudged(log.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")))


@query("batch_log", f"SELECT {ROUNDED_LOG} FROM ({DAILY}) d", ("predictions",))
def batch_log(spark, folder):
    return _texts(_daily(spark, folder))


@query("performance_log_append", f"""
WITH d AS ({DAILY}) SELECT {ROUNDED_LOG}, note FROM (SELECT *, 'first' AS note FROM d UNION ALL SELECT *, 'second' AS note FROM d) u""", ("predictions",))
def performance_log_append(spark, folder):
    path = new_path(spark, "log")
    daily = _daily(spark, folder)
    for note in ("first", "second", "first"):  # the first batch is sent twice, as by a retry
        append_batch(daily.withColumn("note", F.lit(note)), path, f"batch-{note}")
    return _texts(read_log(spark, path).drop("log_day", "batch"))


@query("aligned_append", f"""
WITH d AS ({DAILY}) SELECT {ROUNDED_LOG}, note FROM (SELECT *, NULL AS note FROM d UNION ALL SELECT *, 'second' AS note FROM d) u""", ("predictions",))
def aligned_append(spark, folder):
    daily = _daily(spark, folder)
    return _texts(append_aligned(daily, daily.withColumn("note", F.lit("second"))))


@query("logged_batches", f"SELECT {ROUNDED_LOG} FROM ({DAILY.replace('GROUP BY 1', 'GROUP BY ALL')}) d", ("predictions",))
def logged_batches(spark, folder):
    path = new_path(spark, "log")
    scored = view(spark, folder, "predictions").withColumn("day", F.date_trunc("day", F.col("ts").cast("timestamp")))
    log_scored(scored, "day", path, "all")
    return _texts(read_log(spark, path).drop("log_day", "batch"))


RECENT = f"""WITH d AS ({DAILY}), m AS (SELECT * FROM d WHERE "timestamp" >= (SELECT max("timestamp") FROM d) - INTERVAL 7 DAY)"""


def _as_of(log):
    return log.agg(F.max("timestamp")).first()[0]


@query("recent_log", f"{RECENT} SELECT {ROUNDED_LOG} FROM m", ("predictions",))
def recent_log(spark, folder):
    log = _daily(spark, folder)
    return _texts(perflog.recent(log, _as_of(log), 7))


@query("recent_stored_log", f"""{RECENT} SELECT {ROUNDED_LOG}, strftime("timestamp", '%Y-%m-%d') AS log_day FROM m""", ("predictions",))
def recent_stored_log(spark, folder):
    """Recent rows of a log that lies by day: folders of earlier days are not opened."""
    path, log = new_path(spark, "log"), _daily(spark, folder)
    append_batch(log, path, "all")
    recent = perflog.recent(read_log(spark, path), _as_of(log), 7).drop("batch")
    return _texts(recent).withColumn("log_day", F.date_format("log_day", "yyyy-MM-dd"))


@query("performance_stats", f"""{RECENT}
SELECT CAST(sum(num_predictions) AS BIGINT) AS total_predictions, round(avg(prediction_rate), 6) AS avg_prediction_rate,
 round(avg(avg_confidence), 6) AS avg_confidence, CAST(7 AS BIGINT) AS days_monitored FROM m HAVING count(*) > 0""", ("predictions",))
def performance_stats(spark, folder):
    log = _daily(spark, folder)
    return rounded(perflog.performance_stats(log, _as_of(log), 7))


@query("performance_stats_weighted", f"""{RECENT}
SELECT CAST(sum(num_predictions) AS BIGINT) AS total_predictions,
 round(sum(prediction_rate * num_predictions) / sum(num_predictions), 6) AS avg_prediction_rate,
 round(sum(avg_confidence * num_predictions) / sum(num_predictions), 6) AS avg_confidence, CAST(7 AS BIGINT) AS days_monitored FROM m HAVING count(*) > 0""", ("predictions",))
def performance_stats_weighted(spark, folder):
    log = _daily(spark, folder)
    return rounded(perflog.performance_stats(log, _as_of(log), 7, weighted=True))


@query("parse_log_timestamps", """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS logged_at FROM events""")
def parse_log_timestamps(spark, folder):
    texts = view(spark, folder, "events").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp")
    )
    parsed = perflog.parse_timestamps(texts)
    return parsed.select("event_id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("logged_at"))


def _metric_ctes(source: str) -> str:
    return f"""f AS (SELECT version, registered_at, 2.0 * sum(CASE WHEN y_true = 1 AND p1 >= 0.5 THEN 1 ELSE 0 END)
  / (2 * sum(CASE WHEN y_true = 1 AND p1 >= 0.5 THEN 1 ELSE 0 END) + sum(CASE WHEN y_true = 0 AND p1 >= 0.5 THEN 1 ELSE 0 END)
   + sum(CASE WHEN y_true = 1 AND p1 < 0.5 THEN 1 ELSE 0 END)) AS f1 FROM {source} GROUP BY version, registered_at),
g AS (SELECT version, p1, count(*) FILTER (WHERE y_true = 1) AS pos, count(*) FILTER (WHERE y_true = 0) AS neg FROM {source} GROUP BY version, p1),
a AS (SELECT version, sum(pos * (coalesce(below, 0) + 0.5 * neg)) / (sum(pos) * CAST(sum(neg) AS DOUBLE)) AS roc_auc FROM (
  SELECT *, sum(neg) OVER (PARTITION BY version ORDER BY p1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM g) h GROUP BY version)"""


@query("metric_history", f"WITH {_metric_ctes('versions')} SELECT f.version, registered_at, round(f1, 6) AS metric_f1, round(roc_auc, 6) AS metric_roc_auc, row_number() OVER (ORDER BY registered_at DESC, f.version) AS place FROM f JOIN a ON f.version = a.version", ("versions",))
def metric_history(spark, folder):
    """``place`` is the row's place in the result as it comes."""
    rows = history.metric_history(history.metric_rows(view(spark, folder, "versions")))
    seen = rows.withColumn("seen", F.monotonically_increasing_id())
    return rounded(seen.withColumn("place", F.row_number().over(Window.orderBy("seen")).cast("long")).drop("seen"))


@query("metric_history_from_counts", f"WITH {_metric_ctes('versions')} SELECT f.version, registered_at, round(f1, 6) AS metric_f1, round(roc_auc, 6) AS metric_roc_auc FROM f JOIN a ON f.version = a.version", ("versions",))
def metric_history_from_counts(spark, folder):
    """The history from stored counts of scores, to which the predictions are added in two batches, one of them twice."""
    versions, path = view(spark, folder, "versions"), new_path(spark, "counts")
    for part in (0, 1, 0):
        history.add_score_counts(versions.where(F.col("loan_id") % 2 == part), path, f"part-{part}")
    rows = history.metrics_of_counts(history.read_score_counts(spark, path))
    return rounded(history.metric_history(rows))


@query("evaluate_groups", f"""WITH g0 AS (SELECT CASE WHEN loan_id % 5 = 0 THEN 'a' WHEN loan_id % 5 = 1 THEN 'b' END AS version, 1 AS registered_at, y_true,
 CASE WHEN loan_id % 5 <> 1 THEN p1 END AS p1 FROM scored), {_metric_ctes('g0')}
SELECT f.version AS part, round(CASE WHEN f.version = 'b' THEN CAST(0 AS DOUBLE) ELSE f1 END, 6) AS f1, round(CASE WHEN f.version IS DISTINCT FROM 'b' THEN roc_auc END, 6) AS roc_auc
FROM f JOIN a ON f.version IS NOT DISTINCT FROM a.version""", ("scored",))
def evaluate_groups(spark, folder):
    """Groups without scores and without a name keep their row."""
    fifth = F.col("loan_id") % 5
    rows = view(spark, folder, "scored").select(
        F.when(fifth == 0, "a").when(fifth == 1, "b").alias("part"), "y_true", F.when(fifth != 1, F.col("p1")).alias("p1"))
    return rounded(evaluate(rows, "y_true", "p1", ["part"]).withColumn("f1", F.coalesce("f1", F.lit(0.0))))


@query("compare_versions", f"""WITH {_metric_ctes('versions')}, m AS (
 SELECT version, 'f1' AS metric, f1 AS v FROM f UNION ALL SELECT version, 'roc_auc', roc_auc FROM a WHERE version <> '1.0.0')
SELECT coalesce(x.metric, y.metric) AS metric, round(x.v, 6) AS version1, round(y.v, 6) AS version2,
 round(coalesce(y.v, 0) - coalesce(x.v, 0), 6) AS improvement
FROM (SELECT * FROM m WHERE version = '1.0.0') x FULL OUTER JOIN (SELECT * FROM m WHERE version = '1.1.0') y ON x.metric = y.metric""", ("versions",))
def compare_versions(spark, folder):
    rows = history.metric_rows(view(spark, folder, "versions"))
    partial = rows.filter("NOT (version = '1.0.0' AND metric = 'roc_auc')")
    return rounded(history.compare_versions(partial, "1.0.0", "1.1.0"))


@query("model_comparison", f"WITH {_metric_ctes('versions')} SELECT f.version AS model, round(f1, 6) AS test_f1, round(roc_auc, 6) AS test_roc_auc FROM f JOIN a ON f.version = a.version", ("versions",))
def compare_models(spark, folder):
    rows = evaluate(view(spark, folder, "versions"), "y_true", "p1", ["version"])
    return rounded(model_comparison(rows.withColumnRenamed("version", "model")))


def _incoming(spark, folder):
    """The events file as a stream; a file source watches a folder."""
    schema = view(spark, folder, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)


def _event_stream(spark, folder):
    events = _incoming(spark, folder)
    p1 = F.least(F.lit(1.0), F.col("value") / F.lit(500.0))
    return events.select(
        "event_id", "ts", (F.col("event_type") == "error").cast("int").alias("prediction"),
        p1.alias("p1"), (1 - p1).alias("p0"),
    )


WINDOW_COLUMNS = """strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, num_predictions, round(mean_probability + 1e-12, 6) AS mean_probability,
 round(prediction_rate + 1e-12, 6) AS prediction_rate, round(avg_confidence + 1e-12, 6) AS avg_confidence"""


def _window_texts(log):
    return _nudged(log.drop("window_end").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")))


def _run(query):
    query.awaitTermination()
    if query.exception():
        raise query.exception()


# In append mode a window is written once the watermark has passed its end.
@query("stream_daily_log", f"""WITH d AS ({DAILY}) SELECT {WINDOW_COLUMNS} FROM (SELECT *, "timestamp" AS s FROM d) x
WHERE s + INTERVAL 1 DAY <= (SELECT max(ts) FROM predictions) - INTERVAL 1 HOUR""", ("predictions",))
def stream_daily_log(spark, folder):
    log = jobs.windowed_log(_event_stream(spark, folder), "ts")
    path = new_path(spark, "stream-log")
    _run(jobs.stream_log(log, path, new_path(spark, "stream-log-state")))
    return _window_texts(spark.read.schema(log.schema).parquet(path))


@query("sliding_log", f"""
WITH w AS (SELECT date_trunc('hour', ts) - h * INTERVAL 1 HOUR AS s, p.* FROM predictions p, (SELECT unnest(range(0, 24)) AS h) q)
SELECT {WINDOW_COLUMNS} FROM (SELECT s, count(*) AS num_predictions, avg(p1) AS mean_probability, avg(prediction) AS prediction_rate,
 avg(greatest(p0, p1)) AS avg_confidence FROM w GROUP BY s) x""", ("predictions",))
def sliding_log(spark, folder):
    return _window_texts(jobs.windowed_log(view(spark, folder, "predictions"), "ts", "1 day", "1 hour"))


@query("stream_drift", """
WITH v AS (SELECT v, sum(r) AS r, sum(c) AS c FROM (SELECT value * 2 AS v, 1 AS r, 0 AS c FROM events UNION ALL SELECT value, 0, 1 FROM events) u GROUP BY v),
w AS (SELECT sum(gap * (nxt - v)) / (SELECT stddev_pop(value * 2) FROM events) AS d FROM (
 SELECT v, lead(v) OVER (ORDER BY v) AS nxt, abs(sum(r) OVER (ORDER BY v) - sum(c) OVER (ORDER BY v)) / (SELECT count(*) FROM events) AS gap FROM v) x),
t AS (SELECT sqrt(sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2) AS d FROM (
 SELECT event_type, count(*) / (SELECT count(*) FROM events) AS p, count(*) / (SELECT count(*) FROM events) AS q FROM events GROUP BY event_type) y),
r AS (SELECT 'value' AS feature, d >= 0.1 AS drifted FROM w UNION ALL SELECT 'event_type', d >= 0.1 FROM t)
SELECT count(*) FILTER (WHERE drifted) / count(*) >= 0.5 AS drift_detected,
 coalesce(string_agg(CASE WHEN drifted THEN feature END, ',' ORDER BY feature), '') AS drifted_features,
 count(*) FILTER (WHERE drifted) / count(*) AS drift_share, count(*) AS total_features FROM r""")
def stream_drift(spark, folder):
    """The whole stream as one micro-batch."""
    out = new_path(spark, "stream-drift")
    reference = view(spark, folder, "events").withColumn("value", F.col("value") * 2)
    _run(jobs.stream_drift(
        _incoming(spark, folder), reference, ["value", "event_type"], out, new_path(spark, "stream-drift-state"),
        method="distance",
    ))
    results = spark.read.parquet(out).drop("batch_id")
    return results.withColumn("drifted_features", F.array_join("drifted_features", ","))


def _batch_drift(k: int) -> str:
    """Drift of the events whose id leaves ``k`` modulo 2, as SQL."""
    return f"""SELECT {k} AS batch_id, count(*) FILTER (WHERE drifted) / count(*) AS drift_share, count(*) AS total_features,
 round(max(d) FILTER (WHERE feature = 'value'), 6) > 0 AS moved FROM (
 SELECT 'value' AS feature, d, d >= 0.1 AS drifted FROM (SELECT sum(gap * (nxt - v)) / (SELECT stddev_pop(value * 2) FROM events) AS d FROM (
  SELECT v, lead(v) OVER (ORDER BY v) AS nxt, abs(sum(r) OVER (ORDER BY v) / (SELECT count(*) FROM events)
    - sum(c) OVER (ORDER BY v) / (SELECT count(*) FROM events WHERE event_id % 2 = {k})) AS gap FROM (
   SELECT v, sum(r) AS r, sum(c) AS c FROM (SELECT value * 2 AS v, 1 AS r, 0 AS c FROM events
    UNION ALL SELECT value, 0, 1 FROM events WHERE event_id % 2 = {k}) u GROUP BY v) g) x) w
 UNION ALL SELECT 'event_type', d, d >= 0.1 FROM (SELECT sqrt(sum(
   CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2) AS d FROM (
  SELECT event_type, count(*) / (SELECT count(*) FROM events) AS p, count(*) FILTER (WHERE event_id % 2 = {k})
    / (SELECT count(*) FROM events WHERE event_id % 2 = {k}) AS q FROM events GROUP BY event_type) y) t) r"""


@query("stream_drift_batches", f"SELECT batch_id, drift_share, total_features FROM ({_batch_drift(0)} UNION ALL {_batch_drift(1)}) b")
def stream_drift_batches(spark, folder):
    """Two files, two micro-batches, two summaries."""
    events, source = view(spark, folder, "events"), new_path(spark, "events")
    for k in (0, 1):
        events.filter(F.col("event_id") % 2 == k).coalesce(1).write.mode("append").parquet(source)
    out = new_path(spark, "stream-drift")
    incoming = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    _run(jobs.stream_drift(
        incoming, events.withColumn("value", F.col("value") * 2), ["value", "event_type"], out,
        new_path(spark, "stream-drift-state"), method="distance",
    ))
    return spark.read.parquet(out).select(F.col("batch_id").cast("int").alias("batch_id"), "drift_share", "total_features")
