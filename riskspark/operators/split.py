"""Exact stratified splits without sorting a stratum in one task.

Rows are ordered by the md5 of id and seed, which is even and repeatable. The first rows of
each stratum go to the test set, the next to validation, the rest to train. Instead of ranking
whole strata, the job counts rows per hash prefix, finds the prefix in which each boundary
lies, and ranks the rows of that prefix only. Assigning a row is then a comparison with its
stratum's boundaries, which are joined to it. There may be any number of strata.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark import config
from riskspark.session import cut_lineage

PREFIX_DIGITS = 4


def order_hash(key: str, seed: int = config.SEED) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))


def boundaries(
    df: DataFrame, key: str, stratum: str, parts: Sequence[float], seed: int = config.SEED
) -> DataFrame:
    """One row per stratum: ``stratum`` and ``edges``, the last hash of each part.

    ``parts`` are shares from the front: each takes the ceiling of its share of the rows the
    parts before it have left. Rows are counted per stratum and hash prefix; only rows of the
    prefixes that hold a boundary are ranked. A part without rows has an empty edge.
    """
    hashed = df.filter(F.col(stratum).isNotNull()).select(
        F.col(stratum).alias("stratum"), order_hash(key, seed).alias("h")
    ).withColumn("prefix", F.substring("h", 1, PREFIX_DIGITS))
    counts = hashed.groupBy("stratum", "prefix").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("stratum").orderBy("prefix"))
    counts = counts.withColumn("upto", upto)

    left, taken, goals = F.col("total"), F.lit(0).cast("long"), []
    for part, share in enumerate(parts):
        size = _ceiling(left * share)
        left, taken = left - size, taken + size
        goals.append(F.struct(F.lit(part).alias("part"), taken.alias("goal")))
    totals = counts.groupBy("stratum").agg(F.sum("n").alias("total"))
    goals = totals.select("stratum", F.inline(F.array(*goals)))

    held = goals.join(counts, "stratum").filter("goal <= upto AND goal > upto - n")
    held = held.select("stratum", "part", "prefix", (F.col("goal") - F.col("upto") + F.col("n")).alias("place"))
    # Copies of a key are one row before the shuffle.
    inside = hashed.groupBy("stratum", "prefix", "h").agg(F.count("*").alias("n")).join(held, ["stratum", "prefix"])
    upto = F.sum("n").over(Window.partitionBy("stratum", "part", "place").orderBy("h"))
    edges = inside.withColumn("upto", upto).filter("upto >= place").groupBy("stratum", "part").agg(F.min("h").alias("edge"))
    edges = goals.join(edges, ["stratum", "part"], "left").groupBy("stratum").agg(
        F.sort_array(F.collect_list(F.struct("part", F.coalesce("edge", F.lit("")).alias("edge")))).alias("edges")
    )
    return edges.select("stratum", F.col("edges.edge").alias("edges"))


def _ceiling(x: Column) -> Column:
    """Ceiling that forgives the last digits of a float product (0.2 * 15 is 3.0000000000000004)."""
    return F.ceil(x - F.greatest(F.lit(1.0), F.abs(x)) * 1e-9)


def assign(
    df: DataFrame,
    key: str,
    stratum: str,
    cuts: DataFrame,
    names: Sequence[object],
    column: str,
    seed: int = config.SEED,
) -> DataFrame:
    """Add ``column``: the part whose boundary a row's hash does not pass; null for a null stratum."""
    part = F.lit(names[-1])
    for i, name in reversed(list(enumerate(names[:-1]))):
        part = F.when(order_hash(key, seed) <= F.col("__edges")[i], F.lit(name)).otherwise(part)
    # Stored, so that the engine knows their size before it plans the join: few are broadcast, and the rows not dealt by stratum.
    cuts = cut_lineage(cuts.select(F.col("stratum").alias("__stratum"), F.col("edges").alias("__edges")), "edges")
    joined = df.join(cuts, F.col(stratum) == F.col("__stratum"), "left")
    return joined.withColumn(column, F.when(F.col("__edges").isNotNull(), part)).drop("__stratum", "__edges")


def stratified_split(
    df: DataFrame,
    key: str,
    label: str,
    test_share: float = config.TEST_SHARE,
    validation_share: float = config.VALIDATION_SHARE,
    seed: int = config.SEED,
) -> DataFrame:
    """Add ``split`` (train, validation, test). ``key`` must identify a row."""
    parts = (test_share, validation_share / (1 - test_share))
    cuts = boundaries(df, key, label, parts, seed)
    return assign(df, key, label, cuts, ("test", "validation", "train"), "split", seed)


def stratified_folds(
    df: DataFrame, key: str, label: str, folds: int = 3, seed: int = config.SEED
) -> DataFrame:
    """Add ``fold`` (0..folds-1), each with the same mix of labels up to one row."""
    parts = [1 / (folds - i) for i in range(folds - 1)]
    # Another seed than the split's: a fold must not be a slice of the split's hash order.
    cuts = boundaries(df, key, label, parts, seed + 1)
    return assign(df, key, label, cuts, list(range(folds)), "fold", seed + 1)


def split_summary(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy("split", label).agg(F.count("*").alias("rows"))


def positive_weight(df: DataFrame, label: str) -> DataFrame:
    """Negatives per positive."""
    return df.agg(
        F.try_divide(
            F.count_if(F.col(label) == 0).cast("double"), F.count_if(F.col(label) == 1).cast("double")
        ).alias("scale_pos_weight")
    )


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Per class: n / (classes x rows of the class)."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("rows"))
    totals = counts.agg(F.sum("rows").alias("n"), F.count("*").alias("k"))
    return counts.select(
        label,
        "rows",
        (
            totals.select("n").scalar().cast("double")
            / (totals.select("k").scalar() * F.col("rows")).cast("double")
        ).alias("weight"),
    )


def add_balanced_weight(df: DataFrame, label: str) -> DataFrame:
    """Add ``weight`` from the class counts, which are stored: the engine broadcasts them if they are few."""
    weights = cut_lineage(balanced_weights(df, label).select(F.col(label).alias("__label"), "weight"), "weights")
    return df.join(weights, F.col(label) == F.col("__label"), "left").drop("__label")
