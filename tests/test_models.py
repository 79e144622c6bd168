"""Training, scoring and attribution."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from riskspark.operators import attribution, models, treeshap
from riskspark.operators.metrics import roc_auc
from riskspark.plans.scoring import explain, score
from riskspark.plans.training import build_features, train
from riskspark.session import new_path
from riskspark.sources.readers import read_loans_csv

SETTINGS = {"n_estimators": 4, "max_depth": 3, "learning_rate": 0.2}


@pytest.fixture(scope="module")
def loans(spark):
    df = spark.range(1200).select(
        F.col("id").alias("loan_id"),
        (1000 + F.col("id") * 7919 % 39000).cast("double").alias("loan_amnt"),
        F.when(F.col("id") % 3 == 0, " 60 months").otherwise(" 36 months").alias("term"),
        F.concat((5 + F.col("id") % 21).cast("string"), F.lit(".5%")).alias("int_rate"),
        F.when(F.col("id") % 11 > 0, (20000 + F.col("id") * 104729 % 90000).cast("double")).alias("annual_inc"),
        F.when(F.col("id") % 5 > 0, F.substring(F.lit("ABCDE"), (F.col("id") % 5).cast("int"), F.lit(1))).alias("grade"),
    )
    risky = (F.col("loan_amnt") / F.coalesce("annual_inc", F.lit(50000.0)) > 0.4) | (F.col("loan_id") % 21 > 17)
    return df.withColumn("loan_status", F.when(risky, "Default").otherwise("Current")).withColumn(
        "recoveries", F.lit(0)
    )


@pytest.fixture(scope="module")
def features(loans):
    return build_features(loans)


@pytest.fixture(scope="module")
def boosted(features):
    return train(features, "boosted", SETTINGS)


@pytest.fixture(scope="module")
def baseline(features):
    return train(features, "baseline")


def test_features_are_complete_numbers(features):
    assert "recoveries" not in features.names and "loan_status" not in features.names
    assert {"loan_to_income", "term_months"} <= set(features.names)
    holes = features.table.agg(*[F.count_if(F.col(c).isNull() | F.isnan(c)).alias(c) for c in features.names])
    assert set(holes.first()) == {0}


def test_fit_scope_all_differs_from_train(loans, features):
    whole = build_features(loans, fit_scope="all")
    assert whole.state.numeric["loan_amnt"].mean != features.state.numeric["loan_amnt"].mean


@pytest.mark.parametrize("kind", ["boosted", "baseline"])
def test_models_beat_a_constant(kind, request):
    rows = {r["split"]: r for r in request.getfixturevalue(kind).metrics().collect()}
    assert set(rows) == {"train", "validation", "test"}
    assert rows["test"]["roc_auc"] > 0.7 and rows["test"]["f1"] > 0.5


def test_auc_equals_the_library_evaluator(boosted):
    scored = boosted.scored()
    ours = roc_auc(scored, boosted.features.label, "p1").first()[0]
    theirs = BinaryClassificationEvaluator(
        rawPredictionCol="p1", labelCol=boosted.features.label, numBins=0
    ).evaluate(scored)
    assert ours == pytest.approx(theirs, abs=1e-9)


def test_saved_models_score_the_same(boosted, baseline, spark):
    f = boosted.features
    for trained, load in ((boosted, models.load_boosted), (baseline, models.load_baseline)):
        path = new_path(spark, "model")
        models.save_model(trained.model, path)
        before = sorted(tuple(r) for r in trained.scored().select("loan_id", "p1").collect())
        again = models.predict(f.table, load(path), f.names, ["loan_id"])
        assert sorted(tuple(r) for r in again.select("loan_id", "p1").collect()) == before


def test_scoring_keeps_every_row(loans, boosted):
    raw = loans.drop("loan_status", "recoveries", "grade")
    scored = score(raw, boosted.features.state, boosted.model, ["loan_id"])
    assert scored.columns == ["loan_id", "prediction", "p0", "p1", "prediction_label", "risk_level"]
    assert scored.count() == loans.count()
    assert scored.filter("abs(p0 + p1 - 1) > 1e-9 or p1 is null").count() == 0


def test_tuning_covers_the_grid_and_keeps_defaults(features):
    grid = {"n_estimators": (2,), "max_depth": (2, 3)}
    tuned = models.tune_boosted(features.part("train"), features.names, features.label, "loan_id", grid)
    assert tuned.count() == 2
    best = models.best_settings(tuned)
    assert best["subsample"] == 0.8 and best["n_estimators"] == 2


def test_importance_names_every_feature(boosted, spark):
    importance = models.feature_importance(spark, boosted.model, boosted.features.names)
    assert importance.count() == len(boosted.features.names)
    top = models.top_importance(importance, 3).collect()
    assert len(top) == 3 and top[0]["importance"] >= top[1]["importance"]


def test_linear_attribution_adds_up(baseline):
    f = baseline.features
    weights = dict(zip(f.names, map(float, baseline.model.coefficients.toArray())))
    means = attribution.feature_means(f.part("train"), f.names)
    scored = models.predict(f.table, baseline.model, f.names, ["loan_id", *f.names])
    parts = attribution.linear_attribution(scored, weights, means, float(baseline.model.intercept), ["p1"])
    for r in parts.limit(50).collect():
        total = r["base_value"] + sum(x["contribution"] for x in r["factors"])
        assert total == pytest.approx(math.log(r["p1"] / (1 - r["p1"])), abs=1e-6)


def _expected(nodes, at, x, known):
    """Prediction of a tree when only the features in ``known`` are given; others by cover."""
    node = nodes[at]
    if node["left"] < 0:
        return node["value"]
    left, right = nodes[node["left"]], nodes[node["right"]]
    if node["feature"] in known:
        return _expected(nodes, node["left"] if x[node["feature"]] <= node["threshold"] else node["right"], x, known)
    both = (left["cover"], node["left"]), (right["cover"], node["right"])
    return sum(c / node["cover"] * _expected(nodes, child, x, known) for c, child in both)


def _brute_force(trees, weights, x):
    n = len(x)
    phi = np.zeros(n)

    def value(known):
        return sum(2 * w * _expected(t, 0, x, known) for t, w in zip(trees, weights))

    for j in range(n):
        others = [k for k in range(n) if k != j]
        for size in range(n):
            factor = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
            for known in itertools.combinations(others, size):
                phi[j] += factor * (value({*known, j}) - value(set(known)))
    return phi, value(set())


def test_tree_attribution_equals_brute_force(boosted, spark):
    f = boosted.features
    trees = treeshap.read_trees(spark, boosted.model)
    weights = boosted.model.treeWeights
    attributed = treeshap.tree_attribution(f.table, boosted.model, f.names, ["loan_id", *f.names])
    for r in attributed.orderBy("loan_id").limit(8).collect():
        x = [r[c] for c in f.names]
        phi, base = _brute_force(trees, weights, x)
        assert r["base_value"] == pytest.approx(base)
        assert [z["feature"] for z in r["factors"]] == f.names
        assert [z["contribution"] for z in r["factors"]] == pytest.approx(list(phi), abs=1e-9)


def test_tree_attribution_adds_up(boosted):
    f = boosted.features
    scored = models.predict(f.table, boosted.model, f.names, ["loan_id", *f.names])
    parts = treeshap.tree_attribution(scored, boosted.model, f.names, ["p1"])
    total = F.aggregate("factors", F.col("base_value"), lambda acc, z: acc + z["contribution"])
    gap = parts.select(F.max(F.abs(total - F.ln(F.col("p1") / (1 - F.col("p1")))))).first()[0]
    assert gap < 1e-9
    assert parts.count() == f.table.count()


def test_explanations(loans, boosted, baseline):
    for trained in (boosted, baseline):
        out = explain(
            loans, trained.features.state, trained.model, "loan_id", background=trained.features.part("train")
        )
        row = out.filter("loan_id = 7").first()
        sizes = [abs(z["contribution"]) for z in row["top_factors"]]
        assert len(sizes) == 5 and sizes == sorted(sizes, reverse=True)
        lines = row["explanation"].split("\n")
        assert lines[0] == f"Prediction: {row['prediction_label']}"
        assert lines[1].startswith("Probability of Default: ") and lines[1].endswith("%")
        assert sum("default risk by" in line for line in lines) == 5
    with pytest.raises(ValueError):
        explain(loans, baseline.features.state, baseline.model, "loan_id")


def test_training_from_csv(loans, spark):
    path = new_path(spark, "csv")
    loans.write.csv(path, header=True, nullValue="NA", ignoreLeadingWhiteSpace=False)
    read = read_loans_csv(spark, path, keep_others=True)
    assert "recoveries" in read.columns and read.count() == loans.count()
    trained = train(build_features(read), "baseline")
    assert "recoveries" not in trained.features.names
    assert trained.metrics().filter("split = 'test'").first()["roc_auc"] > 0.7
