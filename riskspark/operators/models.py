"""The two classifiers, their tuning, and scoring with a fitted one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark import config
from riskspark.functions.columns import above, outcome, risk_level
from riskspark.operators.boosting import BoostedTrees, Settings, fit_together
from riskspark.operators.curve import curve
from riskspark.operators.split import add_balanced_weight, positive_weight, stratified_folds

def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df)


def train_baseline(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    max_iter: int = config.BASELINE_MAX_ITER,
) -> LogisticRegressionModel:
    """L2 logistic regression with balanced class weights.

    The weights add up to the number of rows n, so a penalty of 1/n is the unit penalty on the
    summed loss.
    """
    weighted = add_balanced_weight(train, label)
    n = train.filter(F.col(label).isNotNull()).count()
    return LogisticRegression(
        featuresCol="features",
        labelCol=label,
        weightCol="weight",
        maxIter=max_iter,
        regParam=1.0 / max(n, 1),
        standardization=False,
    ).fit(assemble(weighted, features).select("features", F.col(label).cast("double").alias(label), "weight"))


def train_boosted(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    settings: Mapping[str, object] | None = None,
    seed: int = config.SEED,
    key: str | None = None,
) -> BoostedTrees:
    """Gradient-boosted trees; positives weigh as many negatives as there are per positive.

    ``settings`` override the defaults one by one. Rows are drawn by a hash of ``key``, or of all features.
    """
    factor = float(positive_weight(train, label).first()[0] or 1.0)
    own = Settings(**{**config.BOOSTED, **(settings or {})})
    (model,), _ = fit_together(train, features, label, [own], key, factor, seed=seed)
    return model


def tune_boosted(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    key: str,
    grid: Mapping[str, Sequence[object]] = config.TUNING_GRID,
    folds: int = 3,
    seed: int = config.SEED,
) -> DataFrame:
    """Cross-validated F1 of every combination of the grid, over stratified folds.

    One row per combination: its settings as columns and ``f1``, the mean over the folds. All folds and combinations are
    fitted in the same passes, and a number of rounds is scored on the way to the largest one.
    """
    names = list(grid)
    combos = [dict(zip(names, values)) for values in product(*grid.values())]
    rounds = sorted({c.get("n_estimators", config.BOOSTED["n_estimators"]) for c in combos})
    shapes = list(dict.fromkeys(tuple((k, v) for k, v in c.items() if k != "n_estimators") for c in combos))
    runs = [
        Settings(**{**config.BOOSTED, **dict(shape), "n_estimators": rounds[-1]}, without_fold=fold)
        for shape in shapes for fold in range(folds)]
    factor = float(positive_weight(train, label).first()[0] or 1.0)
    rows = stratified_folds(train, key, label, folds)
    _, f1 = fit_together(rows, features, label, runs, key, factor, "fold", seed=seed, f1_after=rounds)
    found = []
    for combo in combos:
        at = shapes.index(tuple((k, v) for k, v in combo.items() if k != "n_estimators")) * folds
        own = f1[combo.get("n_estimators", rounds[-1])][at : at + folds]
        found.append({**combo, "f1": sum(own) / folds})
    return train.sparkSession.createDataFrame(found).select(*names, "f1")


def validation_curve(
    df: DataFrame, model: BoostedTrees, label: str, keep: Sequence[str] = (), rounds: Sequence[int] | None = None
) -> DataFrame:
    """F1 and ROC-AUC after each round (from 1), or after the given ones, per group of ``keep``.

    Rows are read once, see ``curve``. Without trees there is no round and no row.
    """
    rounds = list(rounds or range(1, len(model.trees) + 1))
    if not rounds:
        return df.limit(0).select(*keep, F.lit(0).alias("round"), F.lit(0.0).alias("f1"), F.lit(0.0).alias("roc_auc"))
    return curve(df, model, label, keep, rounds)


def best_settings(tuned: DataFrame) -> dict[str, object]:
    """The combination with the highest F1, over the defaults for what the grid leaves out."""
    order = [c for c in tuned.columns if c != "f1"]
    best = tuned.orderBy(F.desc("f1"), *order).first().asDict()
    best.pop("f1")
    return {**config.BOOSTED, **best}


def predict(df: DataFrame, model: Model | BoostedTrees, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """``keep`` columns with ``prediction``, ``p0`` and ``p1``. Rows in, rows out."""
    if isinstance(model, BoostedTrees):
        rows = df.select(*keep, model.log_odds().alias("__margin"))
        p1 = 1 / (1 + F.exp(-F.col("__margin")))
        return rows.select(*keep, (F.col("__margin") >= 0).cast("int").alias("prediction"), (1 - p1).alias("p0"), p1.alias("p1"))
    scored = model.transform(assemble(df, features))
    p = vector_to_array("probability")
    return scored.select(
        *keep, F.col("prediction").cast("int").alias("prediction"), p[0].alias("p0"), p[1].alias("p1")
    )


def decide(scored: DataFrame, threshold: float | None = None) -> DataFrame:
    """Add the outcome text and the risk level; a threshold replaces the model's own class."""
    if threshold is not None:
        scored = scored.withColumn("prediction", above(F.col("p1"), threshold))
    return scored.withColumns(
        {"prediction_label": outcome(F.col("prediction")), "risk_level": risk_level(F.col("p1"))}
    )


def feature_importance(spark: SparkSession, model: BoostedTrees, features: Sequence[str]) -> DataFrame:
    """Mean gain of the splits on each feature, as a share of all."""
    return spark.createDataFrame([(f, model.importance[f]) for f in features], "feature string, importance double")


def top_importance(importance: DataFrame, n: int = 15) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(n)


def save_model(model: Model | BoostedTrees, path: str) -> None:
    if isinstance(model, BoostedTrees):
        model.save(SparkSession.active(), path)
    else:
        model.write().overwrite().save(path)


def load_boosted(path: str) -> BoostedTrees:
    return BoostedTrees.load(SparkSession.active(), path)


def load_baseline(path: str) -> LogisticRegressionModel:
    return LogisticRegressionModel.load(path)
