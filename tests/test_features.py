"""Cleaning, fitting and applying features."""

import pytest
from pyspark.sql import functions as F

from riskspark.functions.columns import employment_years, first_number, percent_to_number
from riskspark.operators import quality
from riskspark.operators.eda import correlation_with, histogram
from riskspark.operators.preprocess import engineer_features, fit, load, prepare, save, transform
from riskspark.operators.split import add_balanced_weight, positive_weight
from riskspark.session import new_path
from riskspark.sources import intake, readers
from riskspark.sources.schemas import APPLICATION_SCHEMA, LOAN_SCHEMA
from riskspark.sources.sinks import append_aligned, append_log, read_log


def test_leakage_names_keep_their_order():
    names = ["Total_Pymnt_inv", "loan_amnt", "recoveries", "annual_inc", "hardship_flag"]
    assert quality.leakage_columns(names) == ["Total_Pymnt_inv", "recoveries"]
    from riskspark.config import EDA_LEAKAGE_KEYWORDS

    assert quality.leakage_columns(names, EDA_LEAKAGE_KEYWORDS)[-1] == "hardship_flag"


def test_missing_share_rule_is_strict_and_counts_nan(spark):
    df = spark.createDataFrame(
        [(1.0, 1.0, "x"), (float("nan"), None, "x"), (None, float("nan"), "x"), (2.0, None, "x")],
        "half double, most double, full string",
    )
    assert quality.high_missing_columns(df) == ["most"]
    profile = {r["column"]: (r["missing_count"], r["missing_percent"]) for r in quality.missing_profile(df).collect()}
    assert profile == {"half": (2, 50.0), "most": (3, 75.0), "full": (0, 0.0)}


def test_prepare_drops_leaks_and_encodes_the_label(spark):
    df = spark.createDataFrame(
        [(1, 2, None, "Charged Off"), (2, 3, None, "Current")],
        "loan_amnt int, total_pymnt int, note string, loan_status string",
    )
    out = prepare(df)
    assert out.columns == ["loan_amnt", "loan_status"]
    assert [r["loan_status"] for r in out.collect()] == [1, 0]


def test_text_rates_are_parsed_and_numbers_pass(spark):
    df = spark.createDataFrame([("10.5%", 7.0), ("3%%", 8.0), (None, None)], "a string, b double")
    row = df.select(percent_to_number(df, "a").alias("a"), percent_to_number(df, "b").alias("b")).collect()
    assert [tuple(r) for r in row] == [(10.5, 7.0), (3.0, 8.0), (None, None)]
    bad = spark.createDataFrame([("x",)], "a string")
    assert bad.select(percent_to_number(bad, "a", lenient=True)).first()[0] is None
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        bad.select(percent_to_number(bad, "a")).collect()


def test_terms_and_employment(spark):
    df = spark.createDataFrame(
        [(" 36 months", "10+ years"), ("open", "< 1 year"), (None, "self-employed")], "t string, e string"
    )
    out = df.select(first_number(F.col("t")), employment_years(F.col("e"))).collect()
    assert [tuple(r) for r in out] == [(36.0, 10.0), (None, 0.0), (None, None)]


def test_engineering_tolerates_absent_columns(spark):
    df = spark.createDataFrame([(100.0, 9.0, 5.5)], "loan_amnt double, annual_inc double, int_rate double")
    assert engineer_features(df).first().asDict() == {
        "loan_amnt": 100.0, "annual_inc": 9.0, "int_rate": 5.5, "loan_to_income": 10.0,
    }
    alone = spark.createDataFrame([(1,)], "x int")
    assert engineer_features(alone).columns == ["x"]


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1, 1.0, 5.0, "b", 0), (2, 2.0, 5.0, "a", 1), (3, None, 5.0, None, 0), (4, 9.0, 5.0, "b", 1)]
    return spark.createDataFrame(rows, "id long, x double, same double, c string, y int")


def test_fit_transform(people):
    state = fit(people, "y", ["id"])
    assert state.columns == ("x", "same", "c")
    assert state.numeric["x"].median == 2.0
    rows = {r["id"]: r for r in transform(people, state, ["id", "y"]).collect()}
    mean, std = 3.5, (((1 - 3.5) ** 2 + 2 * (2 - 3.5) ** 2 + (9 - 3.5) ** 2) / 4) ** 0.5
    assert rows[3]["x"] == pytest.approx((2 - mean) / std)
    assert {r["same"] for r in rows.values()} == {0.0}
    assert [rows[i]["c"] for i in (1, 2, 3, 4)] == [1, 0, 2, 1]
    assert not any(v is None for r in rows.values() for v in r)


@pytest.mark.parametrize("sort_merge", [False, True])
def test_unseen_categories_and_both_joins(people, spark, sort_merge):
    state = fit(people.filter("c is not null"), "y", ["id"])
    new = spark.createDataFrame([(7, 1.0, 5.0, "zz"), (8, None, 1.0, None), (9, 2.0, 2.0, "b")],
                                "id long, x double, same double, c string")
    rows = {r["id"]: r for r in transform(new, state, ["id"], sort_merge).collect()}
    assert len(rows) == 3
    assert [rows[i]["c"] for i in (7, 8, 9)] == [-1, -1, 1]
    assert rows[8]["x"] == pytest.approx((state.numeric["x"].median - state.numeric["x"].mean) / state.numeric["x"].std)


def test_state_survives_saving(people, spark):
    state = fit(people, "y", ["id"])
    path = new_path(spark, "state")
    save(state, spark, path)
    again = load(spark, path)
    assert (again.columns, again.numeric, again.categorical, again.dictionary_sizes) == (
        state.columns, state.numeric, state.categorical, state.dictionary_sizes)
    before = sorted(map(tuple, transform(people, state, ["id"]).collect()))
    assert sorted(map(tuple, transform(people, again, ["id"]).collect())) == before


def test_weights(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "y int")
    assert positive_weight(df, "y").first()[0] == 3.0
    total = add_balanced_weight(df, "y").groupBy("y").agg(F.sum("weight").alias("w")).collect()
    assert {r["w"] for r in total} == {2.0}


def test_histogram_leaves_out_missing_and_widens_a_constant(spark):
    df = spark.createDataFrame([(5.0, 0.0), (5.0, 10.0), (None, float("nan"))], "k double, v double")
    rows = [(r["feature"], r["bin"], r["count"]) for r in histogram(df, ["k", "v"], 10).collect()]
    assert sorted(rows) == [("k", 5, 2), ("v", 0, 1), ("v", 9, 1)]


def test_correlation_of_a_constant_is_missing(spark):
    df = spark.createDataFrame([(1.0, 1.0, 0), (1.0, 2.0, 1), (1.0, None, 1)], "k double, v double, y int")
    rows = {r["feature"]: r["correlation"] for r in correlation_with(df, "y").collect()}
    assert rows["k"] is None and rows["v"] == pytest.approx(1.0) and rows["y"] == pytest.approx(1.0)


def test_csv_missing_tokens_and_header_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "loan_status,loan_id,int_rate,extra,dti\nDefault,1,10.5%,q,NA\nCurrent,2,n/a,,3.5\n"
    )
    df = readers.read_loans_csv(spark, str(tmp_path), LOAN_SCHEMA)
    assert df.columns == ["loan_status", "loan_id", "int_rate", "dti"]
    assert sorted(map(tuple, df.collect())) == [("Current", 2, None, 3.5), ("Default", 1, "10.5%", None)]
    assert "extra" in readers.read_loans_csv(spark, str(tmp_path), LOAN_SCHEMA, keep_others=True).columns


def test_intake_separates_bad_records(spark, tmp_path):
    (tmp_path / "r.json").write_text(
        '{"loan_amnt": 1000, "term": "36 months", "int_rate": 9.5, "annual_inc": 50000, "dti": 1}\n'
        '{"loan_amnt": "invalid"}\n'
        '{"loan_amnt": 1, "term": "x"}\n'
    )
    records = readers.read_records(spark, str(tmp_path), APPLICATION_SCHEMA).cache()
    checked = intake.check_applications(records)
    assert intake.valid_applications(checked).count() == 1
    counts = {r["reason"]: r["records"] for r in intake.rejection_counts(checked).collect()}
    assert counts["record"] == 1 and counts["missing:dti"] == 2


def test_absent_field_gets_its_default(spark):
    df = spark.createDataFrame([(1.0, "36 months", "9.5", 1.0, 2.0)], "loan_amnt double, term string, int_rate string, annual_inc double, dti double")
    row = intake.valid_applications(intake.check_applications(df)).first()
    assert row["delinq_2yrs"] == 0 and row["int_rate"] == 9.5 and row["grade"] is None


def test_limits(spark):
    df = spark.createDataFrame([(500.0, "36 months", "H"), (2000.0, "48 months", None), (float("nan"), None, "A")],
                               "loan_amnt double, term string, grade string")
    rows = intake.limit_violations(df).collect()
    assert [r["violations"] for r in rows] == [["loan_amnt", "grade"], ["term"], []]


def test_log_appends_and_aligns(spark):
    path = new_path(spark, "log")
    rows = spark.createDataFrame([(1, 2.0)], "a int, b double")
    append_log(rows, path)
    append_log(rows, path)
    assert read_log(spark, path).count() == 2
    wider = append_aligned(rows, spark.createDataFrame([(3,)], "a int"))
    assert [tuple(r) for r in wider.collect()] == [(1, 2.0), (3, None)]


def test_intermediate_tables_go_with_their_owner(spark, tmp_path):
    import glob

    from riskspark.session import cut_lineage, intermediates, shared_folder

    folder = shared_folder(spark).removeprefix("file:").rstrip("/")
    before = set(glob.glob(f"{folder}/riskspark/*"))
    with intermediates(spark):
        cut_lineage(spark.range(10), "owned").write.parquet(str(tmp_path / "result"))
    assert set(glob.glob(f"{folder}/riskspark/*")) == before
    assert spark.read.parquet(str(tmp_path / "result")).count() == 10


def test_correlations_of_columns_with_any_name(spark):
    from riskspark.operators.eda import correlation_matrix

    df = spark.createDataFrame([(float(i), float(-i), 1.0) for i in range(9)], "`a|b` double, c double, `d.e` double")
    found = {(r["feature_a"], r["feature_b"]): r["correlation"] for r in correlation_matrix(df.withColumnRenamed("d.e", "d"), ["a|b", "c", "d"]).collect()}
    assert len(found) == 9 and found["a|b", "c"] == pytest.approx(-1) == found["c", "a|b"]
    assert found["a|b", "a|b"] == 1 and found["d", "d"] is None and found["c", "d"] is None
