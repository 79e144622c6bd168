"""Drift, logs and the streaming jobs."""

import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from riskspark.functions.pvalues import _upper_gamma
from riskspark.operators import drift, history, perflog
from riskspark.session import new_path
from riskspark.sources.sinks import append_batch, read_log
from riskspark.streaming import jobs


def _table(spark, n, mean=0.0, dev=1.0):
    """A normal column at evenly spaced quantiles, and two that are the same in every table."""
    normal = NormalDist(mean, dev)
    rows = [(normal.inv_cdf((i + 0.5) / n), i * 37 % n / n, i % 10) for i in range(n)]
    return spark.createDataFrame(rows, "feature1 double, feature2 double, feature3 int")


@pytest.fixture(scope="module")
def tables(spark):
    return _table(spark, 400), _table(spark, 300), _table(spark, 300, 5, 2)


@pytest.mark.parametrize("small_reference", [1000, 0])
def test_shift_is_found_in_the_shifted_column_only(tables, small_reference):
    reference, same, shifted = tables
    limits = {"small_reference": small_reference, "method": "by_size"}
    found = {r["feature"]: r for r in drift.drift_report(reference, shifted, **limits).collect()}
    assert found["feature1"]["drifted"]
    assert not found["feature2"]["drifted"] and not found["feature3"]["drifted"]
    summary = drift.drift_summary(drift.drift_report(reference, shifted, **limits)).first()
    assert summary["drifted_features"] == ["feature1"] and summary["total_features"] == 3
    assert summary["drift_share"] == pytest.approx(1 / 3) and not summary["drift_detected"]
    assert drift.drift_summary(drift.drift_report(reference, same, **limits)).first()["drift_share"] == 0


def test_identical_tables_do_not_drift(tables):
    for small in (0, 1000):
        report = drift.drift_report(tables[0], tables[0], small_reference=small, method="by_size").collect()
        assert [r["statistic"] for r in report] == [0, 0, 0]
        assert not any(r["drifted"] for r in report)


def _ks(a, b):
    return max(abs(sum(v <= x for v in a) / len(a) - sum(v <= x for v in b) / len(b)) for x in a + b)


@pytest.mark.parametrize("buckets", [2, 16])
def test_numeric_distances_equal_loops(tables, buckets):
    reference, _, shifted = tables
    a = [r[0] for r in reference.select("feature1").collect()]
    b = [r[0] for r in shifted.select("feature1").collect()]
    ks = drift.drift_report(reference, shifted, ["feature1"], buckets=buckets, method="test").first()
    assert ks["statistic"] == pytest.approx(_ks(a, b)) and ks["test"] == "ks" and ks["p_value"] < 1e-6
    points = sorted(a + b)
    area = sum(
        abs(sum(v <= x for v in a) / len(a) - sum(v <= x for v in b) / len(b)) * (y - x)
        for x, y in zip(points, points[1:])
    )
    mean = sum(a) / len(a)
    dev = math.sqrt(sum((v - mean) ** 2 for v in a) / len(a))
    w = drift.drift_report(reference, shifted, ["feature1"], small_reference=0, buckets=buckets, method="by_size").first()
    assert w["test"] == "wasserstein" and w["statistic"] == pytest.approx(area / dev)


def test_category_tests(spark):
    ref = spark.createDataFrame([("a", "x")] * 60 + [("b", "y")] * 30 + [("c", "y")] * 10, "k string, two string")
    cur = spark.createDataFrame([("a", "x")] * 20 + [("b", "y")] * 20 + [("c", "x")] * 10, "k string, two string")
    rows = {r["feature"]: r for r in drift.drift_report(ref, cur, method="test").collect()}
    expected = (20 - 30) ** 2 / 30 + (20 - 15) ** 2 / 15 + (10 - 5) ** 2 / 5
    assert rows["k"]["test"] == "chi_square" and rows["k"]["statistic"] == pytest.approx(expected)
    assert rows["k"]["p_value"] == pytest.approx(math.exp(-expected / 2))
    p, q, pooled = 60 / 100, 30 / 50, 90 / 150
    z = abs(p - q) / math.sqrt(pooled * (1 - pooled) * (1 / 100 + 1 / 50))
    assert rows["two"]["test"] == "z" and rows["two"]["statistic"] == pytest.approx(z)
    far = drift.drift_report(ref, cur, ["k"], small_reference=0, method="by_size").first()
    m = [(60 / 100 + 20 / 50) / 2, (30 / 100 + 20 / 50) / 2, (10 / 100 + 10 / 50) / 2]
    ps, qs = [0.6, 0.3, 0.1], [0.4, 0.4, 0.2]
    js = math.sqrt(sum(a * math.log(a / c) + b * math.log(b / c) for a, b, c in zip(ps, qs, m)) / 2)
    assert far["statistic"] == pytest.approx(js)


def test_new_category_is_drift_and_single_category_is_not(spark):
    ref = spark.createDataFrame([("a", "s")] * 50 + [("b", "s")] * 50, "k string, one string")
    cur = spark.createDataFrame([("a", "s")] * 20 + [("n", "s")] * 20 + [("b", "s")] * 9, "k string, one string")
    rows = {r["feature"]: r for r in drift.drift_report(ref, cur, method="test").collect()}
    assert rows["k"]["drifted"] and rows["k"]["p_value"] == 0
    assert not rows["one"]["drifted"] and rows["one"]["p_value"] == 1


def test_few_numbers_are_compared_as_categories(spark):
    ref = spark.range(100).select((F.col("id") % 3).alias("n"))
    cur = spark.range(100).select((F.col("id") % 4).alias("n"))
    row = drift.drift_report(ref, cur, method="test").first()
    assert row["kind"] == "numeric" and row["test"] == "chi_square"


def test_missing_reference_and_empty_sides(spark, tables):
    with pytest.raises(ValueError, match="Drift needs a reference"):
        drift.drift_report(None, tables[0])
    holes = tables[1].withColumn("feature1", F.lit(None).cast("double"))
    for small in (0, 1000):
        row = drift.drift_report(tables[0], holes, ["feature1"], small_reference=small, method="by_size").first()
        assert row["statistic"] is None and not row["drifted"]
    none = drift.drift_summary(drift.drift_report(tables[0].select(F.lit(1).alias("q")), tables[1])).first()
    assert none["total_features"] == 0 and none["drift_share"] == 0 and not none["drift_detected"]


def test_test_suite_rows(tables):
    report = drift.drift_report(tables[0], tables[2])
    status = {r["name"]: r["status"] for r in drift.drift_tests(report).collect()}
    assert status == {"drift:feature1": "FAIL", "drift:feature2": "SUCCESS", "drift:feature3": "SUCCESS",
                      "share_of_drifted_columns": "SUCCESS"}
    strict = {r["name"]: r["status"] for r in drift.drift_tests(report, 0.1).collect()}
    assert strict["share_of_drifted_columns"] == "FAIL"


def test_upper_gamma_against_closed_forms():
    for x in (0.01, 0.5, 1, 3, 10, 40):
        assert _upper_gamma(1, x) == pytest.approx(math.exp(-x), rel=1e-10)
        assert _upper_gamma(0.5, x) == pytest.approx(math.erfc(math.sqrt(x)), rel=1e-9)
        assert _upper_gamma(3, x) == pytest.approx(math.exp(-x) * (1 + x + x * x / 2), rel=1e-9)


def test_log_rows_and_stats(spark):
    rows = [("2024-01-01", 1, 0.2, 0.8), ("2024-01-01", 0, 0.9, 0.1), ("2024-02-01", 1, 0.4, 0.6)]
    df = spark.createDataFrame(rows, "day string, prediction int, p0 double, p1 double").withColumn(
        "day", F.to_timestamp("day")
    )
    log = perflog.batch_log(df, "day")
    first = log.filter("timestamp = '2024-01-01'").first()
    assert first["num_predictions"] == 2 and first["prediction_rate"] == 0.5
    assert first["mean_probability"] == pytest.approx(0.45) and first["avg_confidence"] == pytest.approx(0.85)
    single = perflog.batch_log(df, "day", p0=None).filter("timestamp = '2024-01-01'").first()
    assert single["avg_confidence"] == single["mean_probability"]
    both = perflog.performance_stats(log, "2024-02-01 00:00:00", 31).first()
    assert both["total_predictions"] == 3 and both["avg_prediction_rate"] == 0.75
    weighted = perflog.performance_stats(log, "2024-02-01 00:00:00", 31, weighted=True).first()
    assert weighted["avg_prediction_rate"] == pytest.approx(2 / 3)
    assert perflog.performance_stats(log, "2024-02-01 00:00:00", 30).first()["total_predictions"] == 1
    assert perflog.performance_stats(log, "2025-02-01 00:00:00", 5).count() == 0


def _events(spark, folder):
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    p1 = F.least(F.lit(1.0), F.col("value") / 500)
    return raw.select("ts", (F.col("event_type") == "error").cast("int").alias("prediction"), p1.alias("p1"), (1 - p1).alias("p0"))


def test_closed_windows_of_the_stream_equal_the_batch(spark, folder):
    stream = jobs.windowed_log(_events(spark, folder), "ts")
    path = new_path(spark, "log")
    query = jobs.stream_log(stream, path, new_path(spark, "state"))
    query.awaitTermination()
    closed = {r["window_start"]: r for r in spark.read.parquet(path).collect()}
    batch_rows = spark.read.parquet(f"{folder}/events.parquet").select(
        "ts", (F.col("event_type") == "error").cast("int").alias("prediction"),
        F.least(F.lit(1.0), F.col("value") / 500).alias("p1"),
    ).withColumn("p0", 1 - F.col("p1"))
    batch = {r["window_start"]: r for r in jobs.windowed_log(batch_rows, "ts").collect()}
    assert len(batch) - 1 <= len(closed) <= len(batch)
    for start, row in closed.items():
        assert row["num_predictions"] == batch[start]["num_predictions"]
        assert row["avg_confidence"] == pytest.approx(batch[start]["avg_confidence"])


def test_late_rows_are_dropped(spark):
    source = new_path(spark, "late")
    schema = "ts timestamp, prediction int, p0 double, p1 double"
    state, out = new_path(spark, "state"), new_path(spark, "log")

    def arrive(*times):
        rows = spark.createDataFrame([(t, 1, 0.5, 0.5) for t in times], "ts string, prediction int, p0 double, p1 double")
        rows.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        jobs.stream_log(jobs.windowed_log(stream, "ts"), out, state).awaitTermination()

    arrive("2024-01-01 10:00:00", "2024-01-03 10:00:00")
    arrive("2024-01-01 11:00:00", "2024-01-05 10:00:00")
    rows = {str(r["window_start"])[:10]: r["num_predictions"] for r in spark.read.parquet(out).collect()}
    assert rows == {"2024-01-01": 1, "2024-01-03": 1}


def test_drift_per_batch(spark, tables):
    reference, _, shifted = tables
    source = new_path(spark, "current")
    shifted.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(shifted.schema).parquet(source)
    out, state = new_path(spark, "drift"), new_path(spark, "state")
    columns = ["feature1", "feature2", "feature3"]
    jobs.stream_drift(stream, reference, columns, out, state).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 1 and rows[0]["drifted_features"] == ["feature1"]


def _sliding(batch, slide):
    return sorted(
        (r["window_start"], r["num_predictions"], round(r["mean_probability"], 9))
        for r in jobs.windowed_log(batch, "ts", "3 hours", slide).collect()
    )


def test_sliding_windows_count_every_row_of_a_window(spark):
    rows = [(f"2024-01-01 {h:02d}:{m:02d}:00", h % 2, 0.4, 0.6 + m / 1000) for h in range(6) for m in (0, 30, 59)]
    batch = spark.createDataFrame(rows, "ts string, prediction int, p0 double, p1 double").withColumn(
        "ts", F.to_timestamp("ts")
    )
    stepwise = _sliding(batch, "1 hour")
    # Two hours do not divide three, so these windows are aggregated directly.
    direct = _sliding(batch, "2 hours")
    sizes = {str(start): n for start, n, _ in stepwise}
    assert sizes["2024-01-01 00:00:00"] == 9 and sizes["2023-12-31 22:00:00"] == 3
    assert len(stepwise) == 8
    both = {w for w in stepwise if w[0] in {d[0] for d in direct}}
    assert both and both <= set(direct)


def test_sliding_stream_writes_closed_windows(spark, folder):
    stream = jobs.windowed_log(_events(spark, folder), "ts", "1 day", "6 hours")
    path = new_path(spark, "log")
    jobs.stream_log(stream, path, new_path(spark, "state")).awaitTermination()
    closed = {r["window_start"]: r["num_predictions"] for r in spark.read.parquet(path).collect()}
    batch = spark.read.parquet(f"{folder}/events.parquet").select(
        "ts", F.lit(1).alias("prediction"), F.lit(0.5).alias("p1"), F.lit(0.5).alias("p0"))
    whole = {r["window_start"]: r["num_predictions"] for r in jobs.windowed_log(batch, "ts", "1 day", "6 hours").collect()}
    assert len(whole) - 5 <= len(closed) <= len(whole)
    assert all(whole[k] == n for k, n in closed.items())


def test_a_repeated_append_leaves_the_rows_once(spark):
    path = new_path(spark, "log")
    log = spark.sql("SELECT timestamp'2024-01-01' + make_dt_interval(id) AS timestamp, id AS num_predictions FROM range(40)")
    append_batch(log, path, "a")
    append_batch(log.where("num_predictions < 5"), path, "b")
    append_batch(log, path, "a")
    stored = read_log(spark, path)
    assert stored.count() == 45 and stored.where("batch = 'a'").count() == 40
    assert sorted(r["n"] for r in stored.groupBy("log_day").agg(F.count("*").alias("n")).collect()) == [1] * 35 + [2] * 5
    with pytest.raises(ValueError):
        append_batch(log, path, "a/b")


def test_recent_rows_come_from_recent_days_only(spark, capsys):
    path = new_path(spark, "log")
    log = spark.sql("SELECT timestamp'2024-01-01 12:00:00' + make_dt_interval(id) AS timestamp, id AS n FROM range(40)")
    append_batch(log, path, "a")
    recent = perflog.recent(read_log(spark, path), "2024-02-09 12:00:00", 3)
    assert sorted(r["n"] for r in recent.collect()) == [36, 37, 38, 39]
    recent.explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters" in plan and "log_day" in plan.split("PartitionFilters")[1].split("]")[0]
    assert len(recent.inputFiles()) <= 40 and len({r["log_day"] for r in recent.select("log_day").collect()}) == 4


def test_history_from_counts_equals_the_whole_computation(spark):
    rows = spark.sql(
        "SELECT id, if(id % 3 = 0, 'a', 'b') AS version, '2024' AS registered_at, int(id % 7 < 3) AS y_true, "
        "if(id % 11 = 0, NULL, round((id * 37 % 101) / 100.0D, 2)) AS p1 FROM range(5000)")
    path = new_path(spark, "counts")
    for part in (0, 1, 2, 1):
        history.add_score_counts(rows.where(F.col("id") % 3 == part), path, f"p{part}")
    history.add_score_counts(rows.where("false"), path, "none")
    counted = history.metrics_of_counts(history.read_score_counts(spark, path))
    whole = {(r["version"], r["metric"]): r["value"] for r in history.metric_rows(rows).collect()}
    found = {(r["version"], r["metric"]): r["value"] for r in counted.collect()}
    assert found.keys() == whole.keys() and all(found[k] == pytest.approx(whole[k]) for k in whole)


@pytest.mark.parametrize("method", ["distance", "test", "by_size"])
def test_a_prepared_reference_gives_the_same_report(spark, tables, method):
    reference, same, shifted = tables
    words = F.when(F.col("feature3") > 6, "high").when(F.col("feature3") > 1, "low")
    both = [t.withColumns({"word": words, "flag": F.col("feature3") > 4, "few": F.col("feature3") % 3}) for t in (reference, shifted)]
    both[1] = both[1].withColumn("few", F.when(F.col("feature3") < 9, F.col("few"))).withColumn(
        "feature2", F.when(F.col("feature3") > 0, F.col("feature2")).otherwise(float("nan")))
    prepared = drift.prepare_reference(both[0])
    for current in (both[1], both[0], both[1].limit(0)):
        whole = {r["feature"]: r for r in drift.drift_report(both[0], current, method=method).collect()}
        found = {r["feature"]: r for r in drift.drift_report_against(prepared, current, method=method).collect()}
        assert found.keys() == whole.keys() and len(found) == 6
        for c, r in found.items():
            for name in ("kind", "test", "drifted"):
                assert r[name] == whole[c][name], (c, name)
            for name in ("statistic", "p_value"):
                assert r[name] == pytest.approx(whole[c][name]), (c, name)
    with pytest.raises(ValueError):
        drift.drift_report_against(prepared, both[1].withColumn("feature1", F.lit("x")))


def test_batches_do_not_read_the_reference_again(spark, tables):
    import shutil

    reference, same, shifted = tables
    path, source, out = new_path(spark, "reference"), new_path(spark, "current"), new_path(spark, "drift")
    reference.write.parquet(path)
    prepared = drift.prepare_reference(spark.read.parquet(path))
    shutil.rmtree(path.removeprefix("file:"))
    rows = drift.drift_report_against(prepared, shifted).collect()
    assert {r["feature"] for r in rows if r["drifted"]} == {"feature1"}
    for part in (same, shifted):
        part.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(shifted.schema).option("maxFilesPerTrigger", 1).parquet(source)
    jobs.stream_drift(stream, reference, reference.columns, out, new_path(spark, "state")).awaitTermination()
    found = sorted(tuple(r["drifted_features"]) for r in spark.read.parquet(out).collect())
    assert found == [(), ("feature1",)]
