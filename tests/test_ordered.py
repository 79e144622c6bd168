"""Medians, running totals, dictionaries and splits against brute force."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from riskspark.operators import marks, split
from riskspark.operators.metrics import join_labels, roc_auc
from riskspark.operators.prefix import add_buckets, cut_points, running_totals
from riskspark.operators.quantiles import exact_medians
from riskspark.operators.ranking import rank_within


def _column(spark, values, name="x"):
    return spark.createDataFrame([(v,) for v in values], f"{name} double").repartition(5)


def _shapes():
    rng = random.Random(7)
    return {
        "even": [1.0, 2.0, 4.0, 9.0],
        "odd": [3.0, -1.0, 7.0],
        "one": [5.0],
        "normal": [rng.gauss(0, 1) for _ in range(5001)],
        "wide": [10 ** rng.uniform(-5, 9) for _ in range(4000)],
        "hot": [2.0] * 2000 + [rng.uniform(0, 10) for _ in range(4000)],
        "hot_middle": [1.0] * 3000 + [2.0] * 3000,
        "two_spikes": [0.0] * 3000 + [1.0] * 3000 + [rng.uniform(0.1, 0.9) for _ in range(101)],
        "two_spikes_even": [0.0] * 3000 + [1.0] * 3000,
        "spike_and_inner": [0.0] * 3000 + [0.5] + [1.0] * 2999,
        "spikes_off_middle": [0.0] * 3000 + [1.0] * 6000 + [rng.uniform(0.1, 0.9) for _ in range(50)],
        "gap": [float(i) for i in range(1000)] + [float(10**6 + i) for i in range(1000)],
    }


@pytest.mark.parametrize("shape", list(_shapes()))
@pytest.mark.parametrize("keep_inside", [10, 100_000])
def test_median_beyond_the_direct_size(spark, shape, keep_inside):
    values = _shapes()[shape]
    found = exact_medians(_column(spark, values), ["x"], direct_rows=0, keep_inside=keep_inside)
    assert found["x"] == pytest.approx(statistics.median(values), rel=1e-12)


def test_median_ignores_missing_and_needs_a_value(spark):
    df = spark.createDataFrame(
        [(1.0, None), (float("nan"), None), (None, None), (4.0, None)], "a double, b double"
    )
    for direct in (0, 100):
        assert exact_medians(df, ["a", "b"], direct_rows=direct) == {"a": 2.5, "b": None}


def test_marks_are_close_to_the_ranks(spark):
    df = spark.range(100_000).select(F.col("id").cast("double").alias("x")).repartition(16)
    found, rows, counted = marks.quantile_marks(
        df, {"x": F.col("x"), "none": F.lit(None).cast("double")}, [0.1, 0.5, 0.9], {"small": F.col("x") < 10}
    )
    for share, value in zip([0.1, 0.5, 0.9], found["x"]):
        assert abs(value / 100_000 - share) < marks.RANK_ERROR
    assert found["none"] == []
    assert counted == {"small": 10} and rows == {"x": 100_000, "none": 0}


@pytest.mark.parametrize("buckets", [2, 7, 64])
def test_running_totals_equal_a_plain_loop(spark, buckets):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice([0.5, rng.uniform(-3, 3)])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, x double")
    counts = (
        add_buckets(df, cut_points(df, ["x"], buckets))
        .groupBy("g", "x__bucket", "x")
        .agg(F.count("*").alias("n"))
    )
    got = running_totals(counts, ["g"], "x__bucket", "x", ["n"]).collect()
    for g in "ab":
        values = sorted(x for h, x in rows if h == g)
        mine = {r["x"]: r for r in got if r["g"] == g}
        assert set(mine) == set(values)
        distinct = sorted(mine)
        for x, following in zip(distinct, distinct[1:] + [None]):
            assert mine[x]["n_before"] == sum(v < x for v in values)
            assert mine[x]["next_value"] == following


def test_auc_with_ties_equals_pair_counting(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 1), round(rng.random(), 2)) for _ in range(800)]
    rows += [(1, float("nan")), (0, None)]
    pos = [s for y, s in rows[:800] if y == 1]
    neg = [s for y, s in rows[:800] if y == 0]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    df = spark.createDataFrame(rows, "y int, s double")
    for buckets in (2, 5, 50):
        assert roc_auc(df, "y", "s", buckets=buckets).first()[0] == pytest.approx(wins / len(pos) / len(neg))


def test_auc_of_one_class_is_missing(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.9)], "y int, s double")
    assert roc_auc(df, "y", "s").first()[0] is None


@pytest.mark.parametrize("limit", [1, 1000])
def test_rank_is_the_same_with_and_without_ranges(spark, limit):
    rows = [("c", f"v{i % 300:03d}") for i in range(300)] + [("d", "b"), ("d", "a")]
    df = spark.createDataFrame(rows, "column string, value string").repartition(4)
    ranked = rank_within(df, "column", "value", "code", 300, group_limit=limit).collect()
    assert {r["code"] for r in ranked if r["column"] == "c"} == set(range(300))
    assert all(int(r["value"][1:]) == r["code"] for r in ranked if r["column"] == "c")
    assert {(r["value"], r["code"]) for r in ranked if r["column"] == "d"} == {("a", 0), ("b", 1)}


@pytest.mark.parametrize("digits", [1, 4])
def test_split_has_exact_sizes_per_stratum(spark, monkeypatch, digits):
    monkeypatch.setattr(split, "PREFIX_DIGITS", digits)
    df = spark.range(1003).select("id", (F.col("id") % 7 == 0).cast("int").alias("y"))
    parts = split.stratified_split(df, "id", "y")
    sizes = {(r["y"], r["split"]): r["rows"] for r in split.split_summary(parts, "y").collect()}
    assert sizes == {
        (0, "test"): 172, (0, "validation"): 86, (0, "train"): 601,
        (1, "test"): 29, (1, "validation"): 15, (1, "train"): 100,
    }
    assert parts.count() == 1003


def test_split_takes_any_number_of_strata(spark):
    df = spark.range(3000).select("id", F.nullif(F.col("id") % 151, F.lit(150)).alias("y"))
    parts = split.stratified_split(df, "id", "y")
    sizes = {(r["y"], r["split"]): r["rows"] for r in split.split_summary(parts, "y").collect()}
    for y in range(150):
        rows = len(range(y, 3000, 151))
        assert sizes[y, "test"] == -(-rows // 5)
        assert sum(sizes.get((y, s), 0) for s in ("test", "validation", "train")) == rows
    assert sizes[None, None] == len(range(150, 3000, 151))


def test_split_keeps_copies_of_a_key_together(spark):
    df = spark.range(900).select(
        F.when(F.col("id") < 300, 1).otherwise(F.col("id")).alias("id"), F.lit(1).alias("y")
    )
    parts = split.stratified_split(df, "id", "y")
    assert parts.filter("id = 1").select("split").distinct().count() == 1
    assert parts.filter("split is null").count() == 0


def test_folds_are_even_within_a_label(spark):
    df = spark.range(500).select("id", (F.col("id") % 5 == 0).cast("int").alias("y"))
    sizes = split.stratified_folds(df, "id", "y").groupBy("y", "fold").count().collect()
    for y in (0, 1):
        counts = [r["count"] for r in sizes if r["y"] == y]
        assert len(counts) == 3 and max(counts) - min(counts) <= 1


def test_join_with_a_hot_key_is_whole(spark):
    big = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id")).alias("k"), "id"
    )
    small = spark.range(0, 3000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    small = small.union(spark.createDataFrame([(7, 70)], "k long, v long"))
    for how in ("inner", "left"):
        expected = sorted(map(str, big.join(small, "k", how).select("k", "id", "v").collect()))
        joined = join_labels(big, small, "k", how)
        assert sorted(map(str, joined.select("k", "id", "v").collect())) == expected


def test_value_counts_are_shuffled_once(spark):
    df = spark.range(1000).select((F.col("id") % 50).cast("double").alias("x"), F.lit("g").alias("g"))
    counts = add_buckets(df, cut_points(df, ["x"], 4)).groupBy("g", "x__bucket", "x").agg(F.count("*").alias("n"))
    totals = running_totals(counts, ["g"], "x__bucket", "x", ["n"])
    totals.collect()
    plan = totals._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan
