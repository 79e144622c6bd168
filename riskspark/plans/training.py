"""The training job: loan table in, fitted state, model and metrics out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark import config
from riskspark.operators import models
from riskspark.operators.boosting import BoostedTrees
from riskspark.operators.metrics import evaluate
from riskspark.operators.preprocess import Preprocessor, engineer_features, fit, prepare, transform
from riskspark.operators.split import stratified_split
from riskspark.session import cut_lineage


@dataclass(frozen=True)
class Features:
    """Engineered, encoded and scaled rows with their split; written out once."""

    table: DataFrame
    state: Preprocessor
    key: str
    label: str

    @property
    def names(self) -> list[str]:
        return self.state.model_features

    def part(self, split: str) -> DataFrame:
        return self.table.filter(F.col("split") == split)


@dataclass(frozen=True)
class Trained:
    model: Model | BoostedTrees
    features: Features

    def scored(self) -> DataFrame:
        f = self.features
        return models.predict(f.table, self.model, f.names, [f.key, "split", f.label])

    def metrics(self) -> DataFrame:
        """F1 and ROC-AUC on train, validation and test."""
        return evaluate(cut_lineage(self.scored()), self.features.label, "p1", ["split"])

    def validation_curve(self, rounds: Sequence[int] | None = None) -> DataFrame:
        """F1 and ROC-AUC of the boosted model on the validation part after each round."""
        f = self.features
        return models.validation_curve(f.part("validation"), self.model, f.label, rounds=rounds)


def build_features(
    loans: DataFrame,
    key: str = "loan_id",
    label: str = config.TARGET,
    exclude: Sequence[str] = (),
    fit_scope: str = "train",
    seed: int = config.SEED,
) -> Features:
    """Prepare, engineer, split, and fit the preprocessor on the train part.

    ``fit_scope="all"`` fits on every row instead, which lets the test rows leak into it.
    """
    # Fitting reads the table several times, a few columns at a time: from a columnar copy.
    prepared = cut_lineage(engineer_features(prepare(loans, label)), "prepared")
    # Stored with their split: every pass would look for its boundaries again, over all rows.
    rows = cut_lineage(stratified_split(prepared, key, label, seed=seed), "rows", "split")
    base = rows.filter(F.col("split") == "train") if fit_scope == "train" else rows
    state = fit(base, label, [key, "split", *exclude])
    table = transform(rows, state, keep=[key, "split", label])
    return Features(cut_lineage(table, "features", "split"), state, key, label)


def train(
    features: Features,
    kind: str = "boosted",
    settings: Mapping[str, object] | None = None,
    tune: bool = False,
    grid: Mapping[str, Sequence[object]] = config.TUNING_GRID,
) -> Trained:
    """Fit the baseline or the boosted model on the train part; validation is only scored, see ``validation_curve``."""
    part = features.part("train")
    if kind == "baseline":
        return Trained(models.train_baseline(part, features.names, features.label), features)
    if tune:
        tuned = models.tune_boosted(part, features.names, features.label, features.key, grid)
        settings = {**models.best_settings(tuned), **(settings or {})}
    model = models.train_boosted(part, features.names, features.label, settings, key=features.key)
    return Trained(model, features)
