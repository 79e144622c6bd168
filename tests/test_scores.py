"""Thresholds, confusion counts and reports on hand-made scores."""

import pytest
from pyspark.sql import functions as F

from riskspark.functions.columns import above, binary_label, risk_level
from riskspark.operators import metrics, thresholds
from riskspark.operators.drift import drift_report
from riskspark.operators.history import compare_versions, metric_history
from riskspark.operators.models import decide


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(i % 2, (i * 37 % 101) / 100) for i in range(500)]
    rows += [(1, None), (0, float("nan")), (1, 0.3), (0, 0.3)]
    return spark.createDataFrame(rows, "y int, p double")


def _counts(rows, t):
    passed = [(y, p is not None and p == p and p >= t) for y, p in rows]
    return {
        "tn": sum(y == 0 and not k for y, k in passed), "fp": sum(y == 0 and k for y, k in passed),
        "fn": sum(y == 1 and not k for y, k in passed), "tp": sum(y == 1 and k for y, k in passed),
    }


def test_grid_is_the_float_range():
    grid = thresholds.threshold_grid()
    assert len(grid) == 80
    assert grid[0] == 0.1 and grid[20] == 0.29999999999999993
    assert grid == sorted(set(grid))


def test_sweep_equals_counting_every_threshold(scored):
    rows = [tuple(r) for r in scored.collect()]
    swept = thresholds.threshold_sweep(scored, "y", "p").collect()
    assert sorted(r["threshold"] for r in swept) == thresholds.threshold_grid()
    for r in swept:
        expected = _counts(rows, r["threshold"])
        assert {k: r[k] for k in expected} == expected
        assert r["tn"] + r["fp"] + r["fn"] + r["tp"] == len(rows)
        assert r["cost"] == expected["fp"] + 5 * expected["fn"] >= 0


def test_edge_score_passes_the_grid_value_below_it(spark):
    df = spark.createDataFrame([(1, 0.3), (0, 0.1)], "y int, p double")
    swept = {r["threshold"]: r["tp"] for r in thresholds.threshold_sweep(df, "y", "p").collect()}
    grid = thresholds.threshold_grid()
    assert swept[grid[20]] == 1 and swept[grid[21]] == 0


def test_ties_go_to_the_lowest_threshold(spark):
    df = spark.createDataFrame([(1, 0.95), (0, 0.05)], "y int, p double")
    swept = thresholds.threshold_sweep(df, "y", "p")
    for metric in ("cost", "f1", "youden"):
        assert thresholds.optimal_threshold(swept, metric) == 0.1
    with pytest.raises(ValueError, match="by cost, f1 or youden"):
        thresholds.best_threshold(swept, "accuracy")


def test_one_class_gives_zeros(spark):
    df = spark.createDataFrame([(0, 0.2), (0, 0.9)], "y int, p double")
    row = thresholds.compare_thresholds(df, "y", "p", (0.5,)).first()
    assert row["confusion_matrix"].asDict() == {"tn": 1, "fp": 1, "fn": 0, "tp": 0}
    assert (row["precision"], row["recall"], row["f1"], row["total_cost"]) == (0, 0, 0, 1)


def test_costs_scale_the_total(scored):
    cheap = thresholds.evaluate_at_threshold(scored, "y", "p", 0.5, 1, 1).first()
    dear = thresholds.evaluate_at_threshold(scored, "y", "p", 0.5, 1, 10).first()
    fn = cheap["confusion_matrix"]["fn"]
    assert dear["total_cost"] - cheap["total_cost"] == 9 * fn
    with pytest.raises(ValueError):
        thresholds.evaluate_at_threshold(scored, "y", "p", None)


def test_sweep_per_group(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.1), ("b", 1, 0.2)], "g string, y int, p double")
    swept = thresholds.threshold_sweep(df, "y", "p", by=["g"])
    assert swept.groupBy("g").count().filter("count = 80").count() == 2
    best = {r["g"]: r["threshold"] for r in thresholds.best_threshold(swept, "f1", ["g"]).collect()}
    assert best["b"] == 0.1


def test_sweep_does_not_pair_rows_with_thresholds(scored):
    plan = thresholds.threshold_sweep(scored, "y", "p")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    generate = plan.index("Generate")
    assert "HashAggregate" in plan[generate:], "thresholds are spread after the rows are counted"


def test_report_of_a_perfect_and_an_absent_class(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "y int, p int")
    rows = {r["class"]: r for r in metrics.classification_report(df, "y", "p").collect()}
    assert rows["0"]["recall"] == 1 and rows["1"]["precision"] == 0 and rows["1"]["support"] == 1
    assert rows["accuracy"]["f1"] == pytest.approx(2 / 3)
    assert rows["macro avg"]["recall"] == pytest.approx(0.5)
    assert rows["weighted avg"]["recall"] == pytest.approx(2 / 3)


def test_missing_score_is_high_risk_and_class_zero(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (0.29,), (0.3,), (0.6,)], "p1 double")
    rows = df.select("p1", risk_level(F.col("p1")).alias("r"), above(F.col("p1"), 0.3).alias("c")).collect()
    assert [r["r"] for r in rows] == ["High", "High", "Low", "Medium", "High"]
    assert [r["c"] for r in rows] == [0, 0, 0, 1, 1]
    assert decide(df, 0.3).filter("prediction_label = 'Default'").count() == 2


def test_label_is_encoded_once(spark):
    text = spark.createDataFrame([("Default",), ("Current",), (None,)], "s string")
    once = text.select(binary_label(text, "s").alias("s"))
    twice = once.select(binary_label(once, "s").alias("s"))
    assert [r["s"] for r in twice.collect()] == [1, 0, 0]


def test_versions_and_missing_metrics(spark):
    rows = spark.createDataFrame(
        [("1", "2024-01-01", "f1", 0.8), ("2", "2024-02-01", "f1", 0.85), ("2", "2024-02-01", "roc_auc", 0.9)],
        "version string, registered_at string, metric string, value double",
    )
    wide = metric_history(rows).collect()
    assert [r["version"] for r in wide] == ["2", "1"] and wide[1]["metric_roc_auc"] is None
    pairs = {r["metric"]: r for r in compare_versions(rows, "1", "2").collect()}
    assert pairs["f1"]["improvement"] == pytest.approx(0.05)
    assert pairs["roc_auc"]["version1"] is None and pairs["roc_auc"]["improvement"] == 0.9
    with pytest.raises(ValueError, match="No metrics are known of version 3"):
        compare_versions(rows, "1", "3")
    assert metric_history(rows.limit(0)).count() == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], "y int, p double, g string")
    assert metrics.roc_auc(none, "y", "p").first()[0] is None
    assert metrics.roc_auc(none, "y", "p", ["g"]).count() == 0
    assert thresholds.threshold_sweep(none, "y", "p").count() == 0
    assert metrics.confusion(none, "y", above(F.col("p"))).first().asDict() == {"tn": 0, "fp": 0, "fn": 0, "tp": 0}
    assert drift_report(none, none).filter("drifted or statistic is not null").count() == 0
