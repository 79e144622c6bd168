"""The scoring job. The same function serves batch tables and streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.operators.attribution import (
    explanation,
    feature_means,
    linear_attribution,
    top_factors,
)
from riskspark.operators.boosting import BoostedTrees
from riskspark.operators.models import decide, predict
from riskspark.operators.preprocess import Preprocessor, engineer_features, transform
from riskspark.operators.treeshap import tree_attribution


def score(
    applications: DataFrame,
    state: Preprocessor,
    model: Model | BoostedTrees,
    keep: Sequence[str],
    threshold: float | None = None,
    lenient: bool = False,
) -> DataFrame:
    """``keep, prediction, p0, p1, prediction_label, risk_level``.

    Features are engineered here as in training. An input column the model was fitted on but
    the table lacks is treated as missing.
    """
    rows = transform(_complete(applications, state, lenient), state, keep)
    return decide(predict(rows, model, state.model_features, keep), threshold)


def _complete(applications: DataFrame, state: Preprocessor, lenient: bool) -> DataFrame:
    engineered = engineer_features(applications, lenient)
    absent = {
        c: F.lit(None).cast("double" if c in state.numeric else "string")
        for c in state.columns
        if c not in engineered.columns
    }
    return engineered.withColumns(absent) if absent else engineered


def explain(
    applications: DataFrame,
    state: Preprocessor,
    model: Model | BoostedTrees,
    key: str,
    n: int = 5,
    background: DataFrame | None = None,
    partitions: int | None = None,
    lenient: bool = False,
) -> DataFrame:
    """The score with its ``top_factors`` and a readable ``explanation``.

    The linear model needs ``background`` (transformed rows) for the feature means.
    """
    features = state.model_features
    rows = transform(_complete(applications, state, lenient), state, [key])
    scored = decide(predict(rows, model, features, [key, *features]))
    if isinstance(model, (GBTClassificationModel, BoostedTrees)):
        attributed = tree_attribution(scored, model, features, _outputs(key), partitions)
    else:
        if background is None:
            raise ValueError("A linear model is explained against a background table.")
        weights = dict(zip(features, map(float, model.coefficients.toArray())))
        attributed = linear_attribution(
            scored, weights, feature_means(background, features), float(model.intercept), _outputs(key)
        )
    return (
        top_factors(attributed, n)
        .withColumn("explanation", explanation(F.col("prediction"), F.col("p1"), F.col("top_factors")))
        .select(*_outputs(key), "explanation", "top_factors")
    )


def _outputs(key: str) -> list[str]:
    return [key, "prediction", "prediction_label", "p0", "p1", "risk_level"]
