"""Helpers the operators of this package share: batches, word shingles, distributed ranks and offsets."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.session import cut_lineage

#: A word: what stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that one window partition holds when ranks or offsets are made bucket by bucket.
BUCKET_ROWS = 8192
#: Buckets whose sums one window adds up.
FAN = 4096
#: Bytes of text that a task works on at once.
SLICE_BYTES = 2 << 20

Learned = TypeVar("Learned")
_HELD: dict[Hashable, object] = {}


def held(key: Hashable, build: Callable[[], Learned]) -> Learned:
    """What ``build`` makes for ``key``: made once per Python worker, and kept until another key is asked for.

    Spark uses a worker again for other operators, and one that kept what each of them learned would add it all up.
    """
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = build()
    return _HELD[key]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``most`` bytes in each; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        piece = np.cumsum(sizes.astype(np.int64)) // most
        edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for start, end in zip(edges, edges[1:]):
            yield batch.slice(start, end - start)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word in lower case (A-Z only), and the row it stands in; null texts have none."""
    lowered = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    rows, words = pc.list_parent_indices(lowered), pc.list_flatten(lowered)
    filled = pc.not_equal(words, "")
    rows, words = pc.filter(rows, filled), pc.filter(words, filled)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    coded = pc.dictionary_encode(words)
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter(map(digest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return hashes[coded.indices.to_numpy(zero_copy_only=False)], rows.to_numpy(zero_copy_only=False).astype(np.int64)


def mix(z: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that each bit depends on all."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingles_of(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of ``width``-word shingles per text.

    A text with fewer words is one shingle as a whole; one without words has none.
    """
    words, rows = words_of(texts)
    count = len(texts)
    starts = np.searchsorted(rows, np.arange(count + 1))
    if len(words) >= width:
        chained = np.zeros(len(words) - width + 1, np.uint64)
        for j in range(width):
            chained = mix(chained * np.uint64(0x9E3779B97F4A7C15) + words[j : len(words) - width + 1 + j])
    else:
        chained = np.zeros(0, np.uint64)
    out = []
    for i in range(count):
        start, end = starts[i], starts[i + 1]
        if end - start >= width:
            out.append(np.unique(chained[start : end - width + 1]))
        elif end > start:
            whole = np.array([end - start], np.uint64)
            for j in range(start, end):
                whole = mix(whole * np.uint64(0x9E3779B97F4A7C15) + words[j : j + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def uniform(*key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that is a function of ``key`` alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 11) / F.lit(float(1 << 53))


def bucket_count(rows: int) -> int:
    return max(1, -(-rows // BUCKET_ROWS))


def running_offsets(
    df: DataFrame, group: list[str], bucket: str, order: list[str], size: Column, name: str, kind: str = "long"
) -> DataFrame:
    """Add ``name``, of type ``kind``: the sum of ``size`` over the rows of the same group that stand before the row.

    Rows of a group are ordered by ``bucket`` (from 0) and then ``order``. Sums per bucket are added up
    first, and those of FAN buckets before them, so that a window holds a bucket's rows, FAN buckets or one
    row per FAN buckets.
    """
    sized = df.withColumn("__size", size)
    totals = sized.groupBy(*group, bucket).agg(F.sum("__size").alias("__sum"))
    totals = totals.withColumn("__high", F.floor(F.col(bucket) / FAN))
    highs = totals.groupBy(*group, "__high").agg(F.sum("__sum").alias("__sum"))
    highs = _summed_before(highs, group, "__high", "__lower")
    totals = _summed_before(totals, [*group, "__high"], bucket, "__before").drop("__sum")
    totals = _joined(totals, highs.drop("__sum"), [*group, "__high"])
    totals = totals.withColumn("__before", F.col("__before") + F.col("__lower")).drop("__high", "__lower")
    placed = _joined(sized, totals, [*group, bucket])
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum("__size").over(inside), F.lit(0))
    return placed.withColumn(name, (F.col("__before") + own).cast(kind)).drop("__size", "__before")


def _summed_before(sums: DataFrame, group: list[str], order: str, name: str) -> DataFrame:
    window = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn(name, F.coalesce(F.sum("__sum").over(window), F.lit(0)))


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Join on keys that may be null."""
    right = right.withColumnsRenamed({c: f"__r_{c}" for c in keys})
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
    return left.join(right, same).drop(*(f"__r_{c}" for c in keys))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add ``name``: the row's place from 0 in ``order``, without one task that sees all rows.

    Rows are dealt by range and stored with the number of their range, as ranges differ from run to
    run; a window numbers them inside a range, after the counts of the ranges before.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut_lineage(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    counts = {r["__part"]: r["n"] for r in dealt.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    first, total = [], 0
    for part in range(parts):
        first.append(total)
        total += counts.get(part, 0)
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order)).cast("long") - 1
    offset = F.element_at(F.array(*(F.lit(n).cast("long") for n in first)), F.col("__part") + 1)
    return dealt.withColumn(name, place + offset).drop("__part")


def extended(df: DataFrame, *fields: T.StructField) -> T.StructType:
    """The columns of ``df`` but those named like a field (in any case), then the fields."""
    names = {f.name.lower() for f in fields}
    return T.StructType([*(f for f in df.schema.fields if f.name.lower() not in names), *fields])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
