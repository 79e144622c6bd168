"""Classification metrics as grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark import config
from riskspark.functions.columns import above, finite, ratio
from riskspark.operators.prefix import add_buckets, cut_points, earlier_buckets, smaller_in_bucket


def confusion_counts(label: str, prediction: Column) -> list[Column]:
    """tn, fp, fn, tp as four conditional counts: one-class input gives zeros, not an error."""
    y = F.col(label)
    return [
        F.count_if((y == 0) & (prediction == 0)).alias("tn"),
        F.count_if((y == 0) & (prediction == 1)).alias("fp"),
        F.count_if((y == 1) & (prediction == 0)).alias("fn"),
        F.count_if((y == 1) & (prediction == 1)).alias("tp"),
    ]


def rates(counts: DataFrame) -> DataFrame:
    """Add precision, recall, f1 and youden to a table with tn, fp, fn, tp."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    f1 = ratio(2 * (F.col("precision") * F.col("recall")), F.col("precision") + F.col("recall"))
    return (
        counts.withColumn("precision", ratio(tp, tp + fp))
        .withColumn("recall", ratio(tp, tp + fn))
        .withColumn("f1", f1)
        .withColumn("youden", F.col("recall") + ratio(tn, tn + fp) - 1)
    )


def confusion(
    df: DataFrame, label: str, prediction: str | Column, by: Sequence[str] = ()
) -> DataFrame:
    predicted = F.col(prediction) if isinstance(prediction, str) else prediction
    return df.groupBy(*by).agg(*confusion_counts(label, predicted))


def f1_by(
    df: DataFrame,
    label: str,
    score: str,
    by: Sequence[str] = (),
    threshold: float = config.DECISION_THRESHOLD,
) -> DataFrame:
    return rates(confusion(df, label, above(F.col(score), threshold), by)).select(*by, "f1")


def roc_auc(
    df: DataFrame, label: str, score: str, by: Sequence[str] = (), buckets: int | None = None
) -> DataFrame:
    """Exact area under the ROC curve per group; equal scores count one half.

    Rows are combined to one per distinct score first, and the negatives below each score come
    from a running total that is spread over buckets of the score. NULL for a one-class group.
    """
    by = list(by)
    rows = df.select(*by, F.col(label).alias("y"), finite(df, score).alias("s")).filter(
        F.col("s").isNotNull()
    )
    cuts = cut_points(rows, ["s"], buckets)
    counts = (
        add_buckets(rows, cuts)
        .groupBy(*by, "s__bucket", "s")
        .agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    )
    return _area(counts, by)


def auc_of_counts(counts: DataFrame, by: Sequence[str], score: str, buckets: int | None = None) -> DataFrame:
    """ROC-AUC per group from ``pos`` and ``neg`` of each distinct score."""
    rows = counts.select(*by, F.col(score).alias("s"), "pos", "neg")
    return _area(add_buckets(rows, cut_points(rows, ["s"], buckets)), list(by))


def _area(counts: DataFrame, by: list[str]) -> DataFrame:
    """From a row per group and distinct score ``s`` with its bucket: wins over pairs, added up bucket by bucket."""
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    inside = F.coalesce(F.sum("neg").over(smaller_in_bucket(by, "s__bucket", "s")), F.lit(0))
    # A positive beats the negatives below it in its bucket and all in the buckets before, so
    # one row per bucket is enough to add the buckets up.
    per_bucket = (
        counts.withColumn("below", inside.cast("double"))
        .groupBy(*by, "s__bucket")
        .agg(
            F.sum(pos * (F.col("below") + 0.5 * neg)).alias("wins"),
            F.sum(pos).alias("p"),
            F.sum(neg).alias("n"),
        )
    )
    return area_of_buckets(per_bucket, by)


def area_of_buckets(per_bucket: DataFrame, by: Sequence[str]) -> DataFrame:
    """ROC-AUC per group from each bucket's positives ``p``, negatives ``n`` and ``wins`` of the ones over the others."""
    before = F.coalesce(F.sum("n").over(earlier_buckets(by, "s__bucket")), F.lit(0.0))
    return (
        per_bucket.withColumn("before", before)
        .groupBy(*by)
        .agg(
            F.try_divide(
                F.sum(F.col("wins") + F.col("p") * F.col("before")), F.sum("p") * F.sum("n")
            ).alias("roc_auc")
        )
    )


def evaluate(
    df: DataFrame,
    label: str,
    score: str,
    by: Sequence[str],
    threshold: float = config.DECISION_THRESHOLD,
) -> DataFrame:
    """F1 and ROC-AUC per group, for instance per split.

    A group without scores has no ROC-AUC; a group whose keys are null is a group like any other.
    """
    by = list(by)
    return with_area(f1_by(df, label, score, by, threshold), roc_auc(df, label, score, by), by)


def with_area(f1: DataFrame, area: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by, f1, roc_auc``: every group of the second side is one of the first."""
    area = area.withColumnsRenamed({c: f"__{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return f1.join(area, same, "left").select(*by, "f1", "roc_auc")


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted averages.

    The table is reduced to (label, prediction) counts in one shuffle; everything after that
    works on one row per class.
    """
    cells = (
        df.filter(F.col(label).isNotNull() & F.col(prediction).isNotNull())
        .groupBy(F.col(label).cast("long").alias("y"), F.col(prediction).cast("long").alias("p"))
        .agg(F.count("*").alias("n"))
    )
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(
            F.col("y").alias("class"),
            F.col("n").alias("support"),
            zero.alias("predicted"),
            F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(zero).alias("hits"),
        ),
        F.struct(F.col("p").alias("class"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("hits")),
    )
    classes = (
        cells.select(F.inline(sides))
        .groupBy("class")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
        .withColumn("precision", ratio(F.col("hits"), F.col("predicted")))
        .withColumn("recall", ratio(F.col("hits"), F.col("support")))
        .withColumn(
            "f1",
            ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
        )
    )
    measures = ("precision", "recall", "f1")
    total = F.sum("support")
    summary = classes.agg(
        total.alias("support"),
        ratio(F.sum("hits"), total).alias("accuracy"),
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *[ratio(F.sum(F.col(m) * F.col("support")), total).alias(f"weighted_{m}") for m in measures],
    )

    def line(name: str, columns: Sequence[Column]) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            *[c.alias(m) for c, m in zip(columns, measures)],
            F.col("support").alias("support"),
        )

    empty = F.lit(None).cast("double")
    lines = F.array(
        line("accuracy", [empty, empty, F.col("accuracy")]),
        line("macro avg", [F.col(f"macro_{m}") for m in measures]),
        line("weighted avg", [F.col(f"weighted_{m}") for m in measures]),
    )
    per_class = classes.select(F.col("class").cast("string").alias("class"), *measures, "support")
    return per_class.unionByName(summary.select(F.inline(lines)))


def join_labels(
    predictions: DataFrame, labels: DataFrame, key: str = "loan_id", how: str = "inner"
) -> DataFrame:
    """Bring labels that arrive later, one per key, to their predictions.

    A plain join: the engine picks the strategy by size and splits keys that hold many rows.
    """
    return predictions.join(labels, key, how)


def model_comparison(metric_rows: DataFrame) -> DataFrame:
    """``model, test_f1, test_roc_auc`` from rows (model, f1, roc_auc); a missing metric is 0."""
    return metric_rows.groupBy("model").agg(
        F.coalesce(F.max("f1"), F.lit(0.0)).alias("test_f1"),
        F.coalesce(F.max("roc_auc"), F.lit(0.0)).alias("test_roc_auc"),
    )
