"""Proportional stratified interleaving: shards of equal row counts that each match the mixture of sources.

Rows are shuffled by a seeded hash and ranked within their source. All rows are then sorted by their rank as a
fraction of the source's size, and the sorted rows are cut into shards of equal length. A shard so takes
the same fraction of every source. Only DataFrame functions are used. Ranks are made bucket by bucket:
hashes are uniform, so that no bucket is larger than the others, however large a source is. Places are made
range by range of fraction and source, as many sources of few rows have the same fractions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import bucket_count, numbered, running_offsets
from riskspark.session import cut_lineage

#: Shards that rows are dealt into, and the seed of the shuffle.
SHARDS, SEED = 8, 3


def shuffle_key(key: Column, seed: int) -> Column:
    """The seeded shuffle: rows are ordered by this text of hexadecimal digits."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))


def interleaved_shards(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    shards: int = SHARDS, seed: int = SEED,
) -> DataFrame:
    """Deal all rows into shards by proportional stratified interleaving.

    Returns one row per row of ``docs``: doc_id, source, size (UTF-8 bytes of the text, none for null, plus
    1), text_crc32 (of the UTF-8 bytes; 0 for null), shard (from 0) and slot (from 0, without gaps). Row
    counts of shards are at most one apart, and a shard's share of a source is at most a few rows off.
    A null source is a source of its own, the last one. Ranks tie in no case that shows: rows alike in key,
    text and size may trade places. With fewer rows than shards, some shards are empty.
    """
    rows = docs.select(
        F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).alias("text_crc32"),
        shuffle_key(F.col(key), seed).alias("draw"),
    )
    rows = cut_lineage(rows, "rows")
    total = rows.count()
    buckets = bucket_count(total)
    uniform = F.conv(F.substring("draw", 1, 8), 16, 10).cast("long") / (1 << 32)
    rows = rows.withColumn("bucket", F.floor(uniform * buckets))
    inside = ["draw", "doc_id", "text_crc32", "size"]
    ranked = running_offsets(rows, ["source"], "bucket", inside, F.lit(1), "rank")
    sizes = rows.groupBy("source").agg(F.count("*").alias("of")).withColumnRenamed("source", "__source")
    ranked = ranked.join(sizes, F.col("source").eqNullSafe(F.col("__source"))).drop("__source", "bucket", "draw")
    ranked = ranked.withColumn("fraction", (F.col("rank") + 0.5) / F.col("of"))
    ranked = cut_lineage(ranked.withColumn("last", F.col("source").isNull()), "ranked")
    placed = numbered(ranked, [F.col("fraction"), F.col("last"), F.col("source")], "place")
    return placed.withColumn("shard", _whole(F.col("place"), shards, total)).select(
        "doc_id", "source", "size", "text_crc32", "shard", (F.col("place") - _first(F.col("shard"), shards, total)).alias("slot"))


def _whole(place: Column, shards: int, total: int) -> Column:
    """The shard of a place: ``place * shards`` over ``total``, in whole numbers."""
    product = place * F.lit(shards).cast("long")
    return ((product - F.pmod(product, F.lit(max(total, 1)))) / max(total, 1)).cast("int")


def _first(shard: Column, shards: int, total: int) -> Column:
    """The first place of a shard: ``shard * total`` over ``shards``, rounded up, in whole numbers."""
    product = shard.cast("long") * F.lit(total).cast("long") + (shards - 1)
    return ((product - F.pmod(product, F.lit(shards))) / shards).cast("long")
