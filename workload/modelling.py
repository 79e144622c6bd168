"""Queries that train, score and explain. Models are checked by rows and by the tests."""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark import config
from riskspark.functions.columns import above
from riskspark.operators import attribution, models
from riskspark.operators.boosting import Settings, fit_together
from riskspark.operators.split import add_balanced_weight
from riskspark.operators.treeshap import tree_attribution
from riskspark.plans.scoring import explain, score
from riskspark.plans.training import Trained, build_features, train
from riskspark.session import cut_lineage, new_path
from riskspark.streaming import jobs
from workload.registry import query, rounded
from workload.views import view

EXCLUDE = ("issue_ts",)
_TRAINED: dict[tuple[str, str], Trained] = {}


def _features(spark, folder):
    return build_features(view(spark, folder, "loans", heavy=True), exclude=EXCLUDE)


def _boosted(spark, folder) -> Trained:
    """The boosted model of the library's full size; a session trains it once per folder."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _TRAINED:
        _TRAINED[key] = train(_features(spark, folder), "boosted")
    return _TRAINED[key]


def _baseline(spark, folder) -> Trained:
    key = (spark.sparkContext.applicationId, f"baseline {folder}")
    if key not in _TRAINED:
        _TRAINED[key] = train(_features(spark, folder), "baseline")
    return _TRAINED[key]


@query("train_baseline")
def train_baseline(spark, folder):
    return rounded(train(_features(spark, folder), "baseline").metrics(), 4)


@query("train_boosted")
def train_boosted(spark, folder):
    return rounded(_boosted(spark, folder).metrics(), 4)


_TUNED: dict[tuple[str, str], DataFrame] = {}


@query("tune_boosted")
def tune_boosted(spark, folder):
    """The search over the default grid: two depths, two rates, three folds, 100 and 200 rounds; once per session and folder."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _TUNED:
        f = _features(spark, folder)
        _TUNED[key] = cut_lineage(models.tune_boosted(f.part("train"), f.names, f.label, f.key), "tuned")
    return _TUNED[key]


GRID = " UNION ALL ".join(
    f"SELECT {n} AS n_estimators, {d} AS max_depth, {r} AS learning_rate" for n, d, r in product(
        *(config.TUNING_GRID[k] for k in ("n_estimators", "max_depth", "learning_rate"))))


@query("tuning_facts", f"""SELECT n_estimators::BIGINT AS n_estimators, max_depth::BIGINT AS max_depth, learning_rate::DOUBLE AS learning_rate,
 0.8::DOUBLE AS subsample, 0.8::DOUBLE AS colsample, true AS has_f1 FROM ({GRID}) g""")
def tuning_facts(spark, folder):
    """Every combination of the default grid has a row, with an F1 from 0 to 1."""
    return tune_boosted(spark, folder).select(
        "n_estimators", "max_depth", "learning_rate", "subsample", "colsample",
        F.coalesce(F.col("f1").between(0, 1), F.lit(False)).alias("has_f1"))


@query("boosted_validation_curve", f"""SELECT {config.BOOSTED["n_estimators"]}::BIGINT AS rounds, 0::DOUBLE AS f1_gap, 0::DOUBLE AS auc_gap, true AS improves""")
def boosted_validation_curve(spark, folder):
    """Rounds of the curve, how far its last row is from the model's own metrics, and whether it rises from the first."""
    trained = _boosted(spark, folder)
    curve = cut_lineage(trained.validation_curve(), "curve")
    own = trained.metrics().where("split = 'validation'").select(F.col("f1").alias("own_f1"), F.col("roc_auc").alias("own_auc"))
    ends = curve.agg(
        F.count("*").alias("rounds"), F.max_by("f1", "round").alias("f1"), F.max_by("roc_auc", "round").alias("roc_auc"),
        F.min_by("roc_auc", "round").alias("first"), F.max("roc_auc").alias("best"))
    # One row on either side.
    return ends.join(own, F.lit(True)).select(
        "rounds", F.round(F.abs(F.col("f1") - F.col("own_f1")), 9).alias("f1_gap"),
        F.round(F.abs(F.col("roc_auc") - F.col("own_auc")), 9).alias("auc_gap"), (F.col("best") > F.col("first")).alias("improves"))


# Given cut points, so that SQL can try every split of a first tree.
STUMP_CUTS = {
    "loan_amnt": [4000.0, 8000.0, 12000.0, 20000.0], "dti": [5.0, 10.0, 20.0, 30.0], "installment": [300.0, 700.0, 1100.0],
    "fico_range_high": [650.0, 700.0, 750.0, 800.0],
}
STUMP = Settings(1, 1, 0.3, 1.0, 1.0, 0.1, 1.0)
_TRIED = " UNION ALL ".join(
    f"SELECT {i} AS place, '{c}' AS feature, CAST({cut!r} AS DOUBLE) AS threshold, g, h, {c} IS NULL OR {c} <= {cut!r} AS goes_left FROM base"
    for i, (c, cuts) in enumerate(STUMP_CUTS.items()) for cut in cuts)


@query("boosted_first_split", f"""
WITH base AS (SELECT *, 0.5 - CASE WHEN dti > 15 AND fico_range_high < 760 THEN 1 ELSE 0 END AS g, 0.25 AS h FROM loans),
tried AS ({_TRIED}),
sums AS (
  SELECT place, feature, threshold, sum(g)::DOUBLE AS g, sum(h)::DOUBLE AS h, (sum(g) FILTER (WHERE goes_left))::DOUBLE AS gl,
         (sum(h) FILTER (WHERE goes_left))::DOUBLE AS hl
  FROM tried GROUP BY place, feature, threshold
),
parts AS (SELECT place, feature, threshold, unnest([g, gl, g - gl]) AS g, unnest([h, hl, h - hl]) AS h, unnest([0, 1, 2]) AS side FROM sums),
leaves AS (
  SELECT *, sign(g) * greatest(abs(g) - {STUMP.reg_alpha}, 0) AS soft, h + {STUMP.reg_lambda} AS room FROM parts
),
gains AS (
  SELECT place, feature, threshold, sum(CASE WHEN side = 0 THEN -1 ELSE 1 END * soft * soft / room) / 2 AS gain,
         sum(CASE WHEN side = 1 THEN -soft / room END) * {STUMP.learning_rate} AS left_value,
         sum(CASE WHEN side = 2 THEN -soft / room END) * {STUMP.learning_rate} AS right_value
  FROM leaves GROUP BY place, feature, threshold
)
SELECT feature, threshold, round(gain, 6) AS gain, round(left_value, 6) AS left_value, round(right_value, 6) AS right_value
FROM gains ORDER BY gains.gain DESC, place, threshold LIMIT 1""", ("loans",))
def boosted_first_split(spark, folder):
    """The first split of a boosted model of one level, its gain, and the weights of its leaves under both penalties.

    The class is one that the columns tell something of: a split on the loans' own outcome would not pay for its penalty.
    """
    loans = view(spark, folder, "loans", heavy=True)
    tight = (F.col("dti") > 15) & (F.col("fico_range_high") < 760)
    rows = loans.select("loan_id", *STUMP_CUTS, tight.cast("int").alias("y"))
    cuts = [np.array(c) for c in STUMP_CUTS.values()]
    (model,), _ = fit_together(rows, list(STUMP_CUTS), "y", [STUMP], "loan_id", cuts=cuts)
    tree = model.trees[0]
    at = int(tree.feature[0])
    found = [(model.features[at], float(tree.threshold[0]), *(round(float(x), 6) for x in (tree.gain[0], tree.value[1], tree.value[2])))]
    return spark.createDataFrame(found, "feature string, threshold double, gain double, left_value double, right_value double")


@query("baseline_optimum", "SELECT CAST(0 AS DOUBLE) AS largest_slope, true AS balanced FROM (SELECT 1) x")
def baseline_optimum(spark, folder):
    """At the fitted baseline, the slope of the penalised, class-weighted loss is 0 in every coefficient and the intercept."""
    trained = _baseline(spark, folder)
    f, model = trained.features, trained.model
    rows = add_balanced_weight(f.part("train"), f.label)
    margin = sum((F.lit(float(w)) * F.col(c) for c, w in zip(f.names, model.coefficients)), F.lit(float(model.intercept)))
    error = F.col("weight") * (1 / (1 + F.exp(-margin)) - F.col(f.label))
    sums = rows.select(*f.names, "weight", error.alias("__e")).agg(
        F.avg("__e").alias("__intercept"), F.avg("weight").alias("__weight"), F.count("*").alias("__n"),
        *(F.avg(F.col("__e") * F.col(c)).alias(c) for c in f.names)).first()
    slopes = [sums["__intercept"], *(sums[c] + float(w) / sums["__n"] for c, w in zip(f.names, model.coefficients))]
    return spark.createDataFrame(
        [(abs(round(max(map(abs, slopes)), 4)), abs(sums["__weight"] - 1) < 1e-9)], "largest_slope double, balanced boolean")


@query("explain_one_loan", "SELECT min(loan_id) AS loan_id, 5::BIGINT AS factors, true AS as_in_the_batch FROM loans", ("loans",))
def explain_one_loan(spark, folder):
    """The explanation of a single loan, by itself and as one of all loans."""
    trained = _baseline(spark, folder)
    f, loans = trained.features, view(spark, folder, "loans")
    one = loans.where(F.col("loan_id") == loans.agg(F.min("loan_id")).first()[0])
    background = f.part("train")
    # Stored: a few rows, which the engine broadcasts instead of dealing out the explanations of all loans.
    alone = cut_lineage(explain(one, f.state, trained.model, "loan_id", background=background), "alone")
    batch = explain(loans, f.state, trained.model, "loan_id", background=background).select(
        "loan_id", F.col("explanation").alias("other"), F.round("p1", 12).alias("p"))
    return alone.join(batch, "loan_id").select(
        "loan_id", F.size("top_factors").cast("long").alias("factors"),
        ((F.col("explanation") == F.col("other")) & (F.round("p1", 12) == F.col("p"))).alias("as_in_the_batch"))


@query("boosted_importance")
def boosted_importance(spark, folder):
    trained = _boosted(spark, folder)
    return models.top_importance(
        models.feature_importance(spark, trained.model, trained.features.names)
    )


@query("model_roundtrip", "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS changed FROM loans", ("loans",))
def model_roundtrip(spark, folder):
    """Rows whose score changes when the model is saved and loaded: none."""
    trained = _boosted(spark, folder)
    path = new_path(spark, "model")
    models.save_model(trained.model, path)
    f = trained.features
    again = models.predict(f.table, models.load_boosted(path), f.names, [f.key])
    pairs = trained.scored().select(f.key, F.col("p1").alias("before")).join(again, f.key)
    return pairs.agg(F.count("*").alias("rows"), F.count_if(F.col("before") != F.col("p1")).alias("changed"))


@query("score_loans")
def score_loans(spark, folder):
    trained = _boosted(spark, folder)
    return score(view(spark, folder, "loans"), trained.features.state, trained.model, ["loan_id"])


FACTS = """SELECT loan_id, true AS sums_to_one, true AS class_follows, true AS label_follows, true AS risk_follows FROM {}"""


def _facts(scored):
    """What must hold of every score, whatever the model."""
    p1, positive = F.col("p1"), F.col("p1") >= 0.5
    risk = F.when(p1 < 0.3, "Low").when(p1 < 0.6, "Medium").otherwise("High")
    return scored.select(
        "loan_id", ((F.abs(F.col("p0") + p1 - 1) < 1e-9) & p1.between(0, 1)).alias("sums_to_one"),
        (F.col("prediction") == positive.cast("int")).alias("class_follows"),
        (F.col("prediction_label") == F.when(positive, "Default").otherwise("No Default")).alias("label_follows"),
        (F.col("risk_level") == risk).alias("risk_follows"),
    )


@query("score_facts", FACTS.format("loans"), ("loans",))
def score_facts(spark, folder):
    return _facts(score_loans(spark, folder))


@query("stream_score_facts", "SELECT count(*) AS loans, count(*) AS equal_to_batch FROM loans", ("loans",))
def stream_score_facts(spark, folder):
    """Every loan is scored once by the stream, with the score that the batch gives it."""
    batch = score_loans(spark, folder).select("loan_id", F.col("p1").alias("batch"))
    both = stream_scores(spark, folder).join(batch, "loan_id")
    return both.agg(F.count("*").alias("loans"), F.count_if(F.col("p1") == F.col("batch")).alias("equal_to_batch"))


@query("explanation_facts", "SELECT loan_id, 5 AS factors, true AS ordered, true AS told FROM loans", ("loans",))
def explanation_facts(spark, folder):
    """Five factors per loan, the strongest first, each one in the text."""
    told = explain_loans_boosted(spark, folder)
    weight = F.transform("top_factors", lambda f: F.abs(f["contribution"]))
    named = F.forall("top_factors", lambda f: F.col("explanation").contains(f["feature"]))
    return told.select("loan_id", F.size("top_factors").alias("factors"),
                       (weight == F.reverse(F.array_sort(weight))).alias("ordered"), named.alias("told"))


@query("importance_facts", "SELECT true AS sums_to_one, true AS falling, true AS known")
def importance_facts(spark, folder):
    """Shares of the features that splits use: not negative, at most 1 in all, the largest first."""
    trained = _boosted(spark, folder)
    every = models.feature_importance(spark, trained.model, trained.features.names)
    rows = [r["importance"] for r in boosted_importance(spark, folder).collect()]
    sums = every.agg(F.abs(F.sum("importance") - 1) < 1e-6).first()[0]
    known = {r["feature"] for r in every.collect()} == set(trained.features.names)
    return spark.createDataFrame(
        [(sums, rows == sorted(rows, reverse=True), known)], "sums_to_one boolean, falling boolean, known boolean")


@query("explain_loans_linear")
def explain_loans_linear(spark, folder):
    trained = _baseline(spark, folder)
    f = trained.features
    return explain(view(spark, folder, "loans"), f.state, trained.model, "loan_id", background=f.part("train"))


@query("explain_loans_boosted")
def explain_loans_boosted(spark, folder):
    trained = _boosted(spark, folder)
    return explain(
        view(spark, folder, "loans", heavy=True), trained.features.state, trained.model, "loan_id"
    )


@query("tree_attribution", "SELECT count(*) AS rows, CAST(0 AS DOUBLE) AS largest_gap FROM loans", ("loans",))
def tree_attribution_check(spark, folder):
    """Rows, and the largest gap between a row's log-odds and base plus contributions."""
    trained = _boosted(spark, folder)
    f = trained.features
    scored = models.predict(f.table, trained.model, f.names, [f.key, *f.names])
    parts = tree_attribution(scored, trained.model, f.names, [f.key, "p1"])
    total = F.aggregate("factors", F.lit(0.0), lambda acc, x: acc + x["contribution"])
    gap = F.abs(F.ln(F.col("p1") / (1 - F.col("p1"))) - F.col("base_value") - total)
    return parts.agg(F.count("*").alias("rows"), F.round(F.max(gap), 9).alias("largest_gap"))


@query("stream_scores")
def stream_scores(spark, folder):
    trained = _boosted(spark, folder)
    source = new_path(spark, "applications")
    view(spark, folder, "loans").write.parquet(source)
    incoming = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    out = new_path(spark, "scores")
    run = jobs.stream_scores(
        incoming, trained.features.state, trained.model, ["loan_id"], out, new_path(spark, "scores-state")
    )
    run.awaitTermination()
    return spark.read.parquet(out)


# Given coefficients, so that the attribution of every loan can be checked in SQL.
WEIGHTS = {"loan_amnt": 0.00002, "dti": 0.031, "fico_range_high": -0.004, "installment": 0.0003}
INTERCEPT = -0.75
FACTORS = "WITH mu AS (SELECT " + ", ".join(f"avg({c}) AS {c}_mu" for c in WEIGHTS) + " FROM loans), long AS (" + " UNION ALL ".join(
    f"SELECT loan_id, '{c}' AS feature, CAST({c} AS DOUBLE) AS \"value\", CAST({w!r} AS DOUBLE) * ({c} - {c}_mu) AS contribution FROM loans, mu"
    for c, w in WEIGHTS.items()
) + "), ranked AS (SELECT *, row_number() OVER (PARTITION BY loan_id ORDER BY abs(contribution) DESC, feature) AS rn FROM long)"


def _attributed(spark, folder):
    loans = view(spark, folder, "loans").select("loan_id", *WEIGHTS)
    means = attribution.feature_means(loans, list(WEIGHTS))
    return attribution.linear_attribution(loans, WEIGHTS, means, INTERCEPT, ["loan_id"])


@query("linear_attribution", FACTORS + " SELECT loan_id, feature, round(\"value\", 4) AS \"value\", round(contribution, 6) AS contribution FROM long", ("loans",))
def linear_attribution(spark, folder):
    long = attribution.long_factors(_attributed(spark, folder), ["loan_id"])
    return rounded(rounded(long, 6, "contribution"), 4, "value")


@query("top_factors", FACTORS + " SELECT loan_id, CAST(rn AS BIGINT) AS place, feature, round(contribution, 6) AS contribution FROM ranked WHERE rn <= 2", ("loans",))
def top_factors(spark, folder):
    best = attribution.top_factors(_attributed(spark, folder), 2)
    placed = best.select("loan_id", F.posexplode("top_factors").alias("place", "f"))
    return rounded(placed.select(
        "loan_id", (F.col("place") + 1).cast("long").alias("place"), "f.feature", "f.contribution"
    ))


IMPORTANCE = FACTORS + ", imp AS (SELECT feature, avg(abs(contribution)) AS importance FROM long GROUP BY feature)"


@query("global_importance", IMPORTANCE + " SELECT feature, round(importance, 6) AS importance FROM imp", ("loans",))
def global_importance(spark, folder):
    return rounded(attribution.global_importance(_attributed(spark, folder), list(WEIGHTS)))


@query("top_features", IMPORTANCE + " SELECT feature, round(importance, 6) AS importance FROM imp ORDER BY imp.importance DESC, feature LIMIT 3", ("loans",))
def top_features(spark, folder):
    return rounded(attribution.top_features(_attributed(spark, folder), list(WEIGHTS), 3))


@query("importance_with_means", IMPORTANCE + """, mean AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {c}_mu AS mean FROM mu" for c in WEIGHTS
) + """) SELECT imp.feature, round(importance, 6) AS importance, round(mean, 4) AS mean FROM imp JOIN mean ON imp.feature = mean.feature""", ("loans",))
def importance_with_means(spark, folder):
    importance = attribution.global_importance(_attributed(spark, folder), list(WEIGHTS))
    loans = view(spark, folder, "loans")
    means = loans.agg(*[F.avg(c).alias(c) for c in WEIGHTS]).unpivot([], list(WEIGHTS), "feature", "mean")
    paired = attribution.with_names(importance, means)
    return rounded(rounded(paired, 6, "importance"), 4, "mean")


@query("explanation_texts", FACTORS + """, lines AS (SELECT loan_id, string_agg(printf('- %s (value: %.2f) %s default risk by %.4f', feature, "value",
  CASE WHEN contribution > 0 THEN 'increases' ELSE 'decreases' END, abs(contribution)) || chr(10), '' ORDER BY rn) AS body FROM ranked WHERE rn <= 5 GROUP BY loan_id)
SELECT s.loan_id, 'Prediction: ' || CASE WHEN p1 >= 0.5 THEN 'Default' ELSE 'No Default' END || chr(10) || 'Probability of Default: '
 || printf('%.2f%%', p1 * 100) || chr(10) || chr(10) || 'Top factors influencing this prediction:' || chr(10) || body AS explanation
FROM scored s JOIN lines l ON s.loan_id = l.loan_id""", ("loans", "scored"))
def explanation_texts(spark, folder):
    best = attribution.top_factors(_attributed(spark, folder), 5)
    scored = view(spark, folder, "scored").select("loan_id", "p1").join(best, "loan_id")
    text = attribution.explanation(above(F.col("p1")), F.col("p1"), F.col("top_factors"))
    return scored.select("loan_id", text.alias("explanation"))
