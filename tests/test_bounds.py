"""Distances with a proven error against the exact ones, and medians of many columns in the same passes."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from riskspark.operators import drift
from riskspark.operators.bounds import interval_sums, side_cuts
from riskspark.operators.quantiles import exact_medians

SCHEMA = "normal double, hot double, whole int, same double, shifted double, empty_now double, big double"


def _side(spark, rows, seed, shift):
    draw = random.Random(seed)
    def row(i):
        hot = 7.25 if draw.random() < 0.4 else draw.uniform(0, 20)
        return (draw.gauss(0, 1), hot, draw.randrange(40) - 20, i / rows, draw.gauss(shift, 1),
                None if shift else draw.random(), draw.gauss(1e15, 1e6) if draw.random() < 0.9 else None)
    return spark.createDataFrame([row(i) for i in range(rows)], SCHEMA).repartition(7)


@pytest.fixture(scope="module")
def sides(spark):
    """Sides of unequal size, so that a side's share of an interval differs from the other's."""
    return _side(spark, 4000, 1, 0.0), _side(spark, 700, 2, 0.8)


def _profiles(stacked):
    return drift.profile(stacked, [c for c in stacked.columns if c != "__reference"])


@pytest.mark.parametrize("intervals", [2, 8, 500])
def test_exact_distances_lie_within_the_error(sides, intervals):
    stacked = drift.stack(*sides, sides[0].columns)
    profiles = _profiles(stacked)
    exact = {r["feature"]: r for r in drift.numeric_distances(stacked, profiles).collect()}
    found = {r["feature"]: r for r in drift.distance_bounds(stacked, profiles, intervals).collect()}
    assert found.keys() == exact.keys()
    for name, row in found.items():
        assert (row["n_ref"], row["n_cur"]) == (exact[name]["n_ref"], exact[name]["n_cur"])
        for kind in ("ks", "wasserstein"):
            if name == "empty_now":
                assert row[kind] is None and row[f"{kind}_error"] is None and exact[name][kind] is None
                continue
            assert row[f"{kind}_error"] >= 0
            assert abs(row[kind] - exact[name][kind]) <= row[f"{kind}_error"] + 1e-9, (name, kind)


def test_the_error_shrinks_with_the_intervals_and_a_hot_value_has_none(sides):
    stacked = drift.stack(*sides, sides[0].columns)
    profiles = _profiles(stacked)
    errors = []
    for intervals in (4, 32, 500):
        rows = {r["feature"]: r for r in drift.distance_bounds(stacked, profiles, intervals).collect()}
        errors.append({c: rows[c]["ks_error"] for c in ("normal", "hot", "same", "shifted")})
    for c in errors[0]:
        assert errors[0][c] >= errors[1][c] >= errors[2][c] and errors[2][c] <= 0.02
    # A column shifted as a whole: the area follows from the sums almost everywhere.
    assert rows["shifted"]["wasserstein_error"] < 0.002


def test_what_is_shuffled_is_a_row_per_interval(sides):
    stacked = drift.stack(*sides, ["normal", "hot"])
    cuts = side_cuts(stacked, ["normal", "hot"], "__reference", 10)
    assert all(len(found) <= 18 for found in cuts.values())
    sums = interval_sums(stacked, ["normal", "hot"], "__reference", cuts)
    assert sums.count() <= 2 * (2 * 18 + 1)
    assert sums.agg(F.sum("ref"), F.sum("cur")).first() == (8000, 1400)
    point = sums.where("at = 1 AND low <= 7.25 AND high >= 7.25").first()
    assert point["low"] == point["high"] == 7.25


def test_verdicts_are_those_of_the_exact_distances(sides):
    reference, current = sides
    for limit in (0.05, 0.1, 0.5):
        exact = {r["feature"]: r for r in drift.drift_report(reference, current, distance=limit).collect()}
        found = {r["feature"]: r for r in drift.drift_report(reference, current, distance=limit, method="bounded").collect()}
        assert {c: r["drifted"] for c, r in found.items()} == {c: r["drifted"] for c, r in exact.items()}
        assert found["shifted"]["test"] == "wasserstein_bounded"


def test_a_column_whose_error_reaches_over_the_limit_is_measured_exactly(sides):
    stacked = drift.stack(*sides, ["normal", "shifted"])
    profiles = _profiles(stacked)
    exact = {r["feature"]: r["wasserstein"] for r in drift.numeric_distances(stacked, profiles).collect()}
    limit = exact["normal"]
    found = {r["feature"]: r for r in drift.settled_distances(stacked, profiles, limit, intervals=4).collect()}
    assert found["normal"]["exact"] and found["normal"]["wasserstein"] == pytest.approx(exact["normal"], abs=1e-12)
    assert not found["shifted"]["exact"]


def test_empty_tables_and_unknown_methods(sides, spark):
    reference, current = sides
    none = reference.limit(0)
    for a, b in ((none, current), (reference, none), (none, none)):
        report = drift.drift_report(a, b, method="bounded")
        assert report.filter("drifted OR statistic IS NOT NULL").count() == 0
    with pytest.raises(ValueError, match="bounded"):
        drift.drift_report(reference, current, method="guess")
    with pytest.raises(ValueError, match="two tables"):
        drift.drift_report_against(drift.prepare_reference(reference, ["normal"]), current, method="bounded")


def _jobs(spark, name, work):
    spark.sparkContext.setJobGroup(name, name)
    try:
        result = work()
    finally:
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return result, jobs


def test_passes_of_medians_do_not_grow_with_the_columns(spark):
    draw = random.Random(5)
    shapes = {
        "normal": [draw.gauss(0, 1) for _ in range(3000)],
        "spikes": [0.0] * 1400 + [1.0] * 1400 + [draw.uniform(0.1, 0.9) for _ in range(200)],
        "hot": [2.0] * 1600 + [draw.uniform(0, 10) for _ in range(1400)],
        "off": [0.0] * 900 + [1.0] * 2000 + [draw.uniform(0.1, 0.9) for _ in range(100)],
    }
    few = spark.createDataFrame(list(zip(*shapes.values())), ", ".join(f"{c} double" for c in shapes)).repartition(5)
    many = few.select("*", *(F.col(c).alias(f"{c}{i}") for i in range(9) for c in shapes))
    found, jobs = _jobs(spark, "few", lambda: exact_medians(few, few.columns, direct_rows=0, keep_inside=10))
    wide, wide_jobs = _jobs(spark, "many", lambda: exact_medians(many, many.columns, direct_rows=0, keep_inside=10))
    assert found == pytest.approx({c: statistics.median(v) for c, v in shapes.items()}, rel=1e-12)
    assert wide == {c: found[c.rstrip("0123456789")] for c in many.columns}
    assert jobs > 0 and wide_jobs <= jobs + 6  # the sketches' draws differ; a pass is two jobs or three
