"""F1 and ROC-AUC of a boosted model after each of its rounds, over rows that are read once.

A task adds up its rows' scores round by round and passes on, per round, class and bucket, the distinct scores in their
order with how many rows have each: lists of numbers, instead of a row per row and round. A bucket's lists meet in one
task, which counts the pairs that positives win; the buckets are added up as for any ROC-AUC.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from riskspark import config
from riskspark.operators.boosting import BoostedTrees
from riskspark.operators.metrics import area_of_buckets, rates, with_area
from riskspark.session import cut_lineage

# Rows whose scores make one list, rows of a bucket (about), and rows that the buckets' limits are taken from (about).
LISTED_ROWS, BUCKET_ROWS, LIMIT_ROWS = 1 << 16, 1 << 19, 1 << 12


def _probability(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-margin))


def _limits(df: DataFrame, model: BoostedTrees, rounds: Sequence[int]) -> dict[int, np.ndarray]:
    """Where a round's buckets begin. They only decide which scores meet in a task, and have no effect on results."""
    total = df.count()
    buckets = -(-total // BUCKET_ROWS)
    if buckets < 2:
        return {}
    some = df.select(*(F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(model.features)))
    columns = some.sample(min(1.0, LIMIT_ROWS / total), seed=config.SEED).toPandas()
    limits, margin = {}, np.zeros(len(columns))
    for r, values in enumerate(model.leaf_values([columns[c].to_numpy(float) for c in columns]), 1):
        margin += values
        if r in rounds and len(margin):
            limits[r] = np.unique(np.quantile(_probability(margin), np.arange(1, buckets) / buckets))
    return limits


def _groups(columns: list[pa.ChunkedArray], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each group of equal values, and the group of each row."""
    group, first = np.zeros(rows, np.int64), np.zeros(1, np.int64)
    for c in columns:
        found = pc.dictionary_encode(c.combine_chunks(), null_encoding="encode")
        found = found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found
        group = group * len(found.dictionary) + found.indices.to_numpy(zero_copy_only=False)
        _, first, group = np.unique(group, return_index=True, return_inverse=True)
    return first, group


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        if held and n + batch.num_rows > LISTED_ROWS:
            yield pa.Table.from_batches(held)
            held, n = [], 0
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def curve(df: DataFrame, model: BoostedTrees, label: str, keep: Sequence[str], rounds: Sequence[int]) -> DataFrame:
    """``keep, round, f1, roc_auc`` for each of the rounds and each group of ``keep``."""
    spark, keep, rounds = SparkSession.active(), list(keep), sorted(set(rounds))
    own = [StructField(f.name, f.dataType) for f in df.select(*keep).schema]
    rows = df.select(*keep, F.col(label).cast("double").alias("__y"), *(
        F.col(f).cast("double").alias(f"__x{i}") for i, f in enumerate(model.features)))
    shared = spark.sparkContext.broadcast((model, _limits(df, model, rounds)))
    named, wide, threshold = [f.name for f in own], len(keep), config.DECISION_THRESHOLD

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, limits = shared.value
        nothing = np.zeros(0)
        for part in _gathered(batches):
            first, group = _groups(part.columns[:wide], part.num_rows)
            y = part.column(wide).to_numpy()
            places = [(g, c, np.flatnonzero((group == g) & (y == c))) for g in range(len(first)) for c in (0, 1)]
            x = [c.to_numpy().astype(float) for c in part.columns[wide + 1:]]

            def listed(r: int, scores: np.ndarray | None) -> pa.RecordBatch:
                out = []
                for g, c, at in places:
                    found, count = np.unique(nothing if scores is None else scores.take(at), return_counts=True)
                    edges = [0, *np.searchsorted(found, limits.get(r, nothing)).tolist(), len(found)]
                    for bucket, (low, high) in enumerate(zip(edges, edges[1:])):
                        # The first bucket always has a row, so that no group is lost.
                        if high > low or not bucket:
                            v, n = found[low:high], count[low:high]
                            out.append((int(first[g]), bucket, c, int(n[v >= threshold].sum()), v.tobytes(), n.astype(np.uint32).tobytes()))
                at, bucket, c, said, v, n = map(list, zip(*out))
                return pa.RecordBatch.from_arrays(
                    [*(k.combine_chunks().take(pa.array(at)) for k in part.columns[:wide]), pa.array([r] * len(out), pa.int32()),
                     pa.array(bucket, pa.int32()), pa.array(c, pa.int32()), pa.array(said, pa.int64()), pa.array(v, pa.binary()),
                     pa.array(n, pa.binary())],
                    names=[*named, "round", "s__bucket", "y", "said", "scores", "counts"])

            margin, wanted = np.zeros(part.num_rows), set(rounds)
            for r, values in enumerate(model.leaf_values(x), 1):
                margin += values
                if r in wanted:
                    wanted.remove(r)
                    yield listed(r, _probability(margin))
            for r in sorted(wanted):  # rounds that the model does not have
                yield listed(r, None)

    def met(table: pa.Table) -> pa.Table:
        y = table.column("y").to_numpy()
        said = table.column("said").to_numpy()

        def joined(name: str, c: int, kind) -> np.ndarray:
            return np.concatenate([np.zeros(0, kind), *(np.frombuffer(b, kind) for b, k in zip(table.column(name).to_pylist(), y) if k == c)])

        (no, n), (yes, p) = ((joined("scores", c, float), joined("counts", c, np.uint32).astype(np.int64)) for c in (0, 1))
        order = np.argsort(no, kind="stable")
        no, below = no.take(order), np.concatenate([[0], np.cumsum(n.take(order))])
        # Twice the negatives below a score, those of the same score counting once.
        twice = below.take(np.searchsorted(no, yes, "left")) + below.take(np.searchsorted(no, yes, "right"))
        numbers = dict(wins=float((p * (twice / 2)).sum()), p=float(p.sum()), n=float(n.sum()),
                       tp=int(said[y == 1].sum()), fp=int(said[y == 0].sum()))
        head = table.slice(0, 1).select([*named, "round", "s__bucket"])
        for name, value in numbers.items():
            head = head.append_column(name, pa.array([value]))
        return head

    place = [StructField("round", IntegerType()), StructField("s__bucket", IntegerType())]
    sent = [StructField("y", IntegerType()), StructField("said", LongType()), StructField("scores", BinaryType()), StructField("counts", BinaryType())]
    sums = [*(StructField(c, DoubleType()) for c in ("wins", "p", "n")), *(StructField(c, LongType()) for c in ("tp", "fp"))]
    by = [*named, "round"]
    found = rows.mapInArrow(lists, StructType([*own, *place, *sent])).groupBy(*by, "s__bucket").applyInArrow(
        met, StructType([*own, *place, *sums]))
    per_bucket = cut_lineage(found, "curve")
    counts = per_bucket.groupBy(*by).agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), (F.sum("p") - F.sum("tp")).alias("fn"), (F.sum("n") - F.sum("fp")).alias("tn"))
    return with_area(rates(counts).select(*by, "f1"), area_of_buckets(per_bucket, by), by)
