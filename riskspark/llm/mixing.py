"""Mixing sources to target weights.

The words of a source are one stream, packed into blocks of fixed length. Targets give each source a number
of slots. The slots of a source are drawn over the output shards (multinomial counts), and each slot is
mapped to a block by a pseudorandom permutation of the source's block indices: a new one for each pass
over the source. Documents meet the slots by block index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.llm.common import WORD, bucket_count, mix, numbered, running_offsets, uniform
from riskspark.session import cut_lineage

#: Words in a block, output shards, weights of the sources in order, and passes over a source at most.
BLOCK_WORDS, SHARDS, WEIGHTS, MAX_PASSES = 1024, 64, (5, 2, 1), 3
#: Slots that one row is expanded to.
RUN = 4096


@dataclass
class Mixture:
    """``documents``: a row per document; ``sources``: a row per source; ``slots``: a row per block taken."""

    documents: DataFrame
    sources: DataFrame
    slots: DataFrame
    pieces: DataFrame


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where a key's permutation of ``0 .. size-1`` puts ``index``: a Feistel network, walked until inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        high, low = out[todo] >> h, out[todo] & m
        for turn in range(6):
            high, low = low, high ^ (mix(low + k + np.uint64(turn * 0x9E3779B97F4A7C15 % 2**64)) & m)
        out[todo] = (high << h) | low
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


def _targets(sources: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Add ``target``: shares of all sizes by weight, none above ``most`` times its source's size.

    Water is filled up: the level is what is left over per weight of the sources below their limit; sources
    that it reaches are set to their limit, until none is reached. Each round reads one row of sums.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    sources = sources.withColumns({"weight": weight, "limit": F.col("source_size") * most})
    whole = sources.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, F.lit(False)
    while True:
        row = sources.select(
            F.sum(F.when(full, F.col("limit"))), F.sum(F.when(~full, F.col("weight"))), F.sum(full.cast("long")),
        ).first()
        if not row[1]:
            break
        level = (whole - (row[0] or 0)) / row[1]
        full = F.col("limit") <= F.lit(level) * F.col("weight")
        if (sources.agg(F.sum(full.cast("long"))).first()[0] or 0) == (row[2] or 0):
            break
    filled = F.when(full, F.col("limit").cast("double")).otherwise(F.lit(level) * F.col("weight"))
    return sources.withColumn("target", filled.cast("double"))


def _runs(sources: DataFrame, seed: int, shards: int) -> DataFrame:
    """Draw each source's slots over the shards; a row is a run of a shard's slots of a source."""
    names = ["number", "shard", "first", "count"]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, slots in zip(batch.column("number").to_pylist(), batch.column("slots").to_pylist()):
                counts = np.random.default_rng([seed, number]).multinomial(slots, np.full(shards, 1 / shards))
                counts = counts.astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(shards, number)), pa.array(np.arange(shards, dtype=np.int32)),
                    pa.array(np.cumsum(counts) - counts), pa.array(counts)], names=names)

    drawn = sources.select("number", "slots").mapInArrow(draw, "number long, shard int, first long, count long")
    runs = F.explode(F.sequence(F.lit(0).cast("long"), ((F.col("count") - 1) / RUN).cast("long")))
    return drawn.where("count > 0").withColumn("run", runs)


def _moved(slots: DataFrame) -> DataFrame:
    """Add ``moved``: the full block that the permutation ``key`` puts at ``turn``; -1 past the full blocks."""
    schema = T.StructType([*slots.schema.fields, T.StructField("moved", T.LongType())])

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turn, full, key = (batch.column(c).to_numpy() for c in ("turn", "full", "key"))
            inside = np.flatnonzero(turn < full)
            moved = np.full(len(turn), -1, np.int64)
            moved[inside] = permuted(turn[inside], full[inside], key[inside].astype(np.uint64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(moved)], names=schema.names)

    return slots.mapInArrow(move, schema)


def mix_sources(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[int, ...] = WEIGHTS, block_words: int = BLOCK_WORDS, shards: int = SHARDS,
    max_passes: int = MAX_PASSES, seed: int = 6,
) -> Mixture:
    """Mix whole documents of all sources; the mix takes as many words as there are.

    A source's size is the sum of its documents' words (a null text has none). Sources in order of code
    points, null last and a source like any other, weigh ``weights`` in turn. Targets stop at
    ``max_passes`` times the source's size, and what is over is shared among the others by weight. A
    source's target is taken to the word, rounded to a whole number: whole passes take each of its words,
    the last pass blocks in permuted order until the target is reached. No word is taken more than
    ``max_passes`` times. The same rows and parameters give the same mix. Documents without words are in
    no block and are taken 0 times. Repeated rows are documents of their own.

    ``documents``: doc_id, fingerprint (of the text), source, size, start (its place in the source's
    stream). ``sources``: source, number, source_size, weight, target, taken, slots. ``slots``: shard,
    number, slot, pass, block, words. ``pieces``: per document and block: number, block, lo and hi (words of
    the block), and at (place of the first in the document).
    """
    narrow = cut_lineage(docs.select(
        F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(text).alias("fingerprint"),
    ), "sizes")
    buckets = bucket_count(narrow.count())
    placed = narrow.withColumn("draw", uniform(F.col("doc_id"), F.col("fingerprint"), seed=seed))
    placed = placed.withColumn("bucket", F.floor(F.col("draw") * buckets))
    placed = running_offsets(
        placed, ["source"], "bucket", ["draw", "doc_id", "fingerprint", "size"], F.col("size"), "start")
    placed = cut_lineage(placed.drop("bucket", "draw"), "stream")

    sources = placed.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = numbered(sources, [F.col("source").asc_nulls_last()], "number")
    sources = _targets(cut_lineage(sources, "sources"), weights, max_passes)
    blocks = F.ceil(F.col("source_size") / block_words)
    over = F.col("taken") % F.col("source_size")
    slots = F.floor(F.col("taken") / F.col("source_size")) * F.col("blocks") + F.ceil(over / block_words)
    sources = sources.withColumn("taken", F.round("target").cast("long")).withColumn("blocks", blocks)
    sources = sources.withColumn("slots", F.when(F.col("source_size") > 0, slots).otherwise(0).cast("long"))
    sources = cut_lineage(sources, "targets")

    slot = F.explode(F.sequence("from", F.least(F.col("from") + RUN, F.col("first") + F.col("count")) - 1))
    dealt = _runs(sources, seed, shards).withColumn("from", F.col("first") + F.col("run") * RUN)
    dealt = dealt.repartition("number", "shard", "run").select("number", "shard", slot.alias("slot"))
    dealt = dealt.join(sources.select("number", "source_size", "taken", "blocks"), "number")
    dealt = dealt.withColumn("pass", F.floor(F.col("slot") / F.col("blocks")))
    turn = F.col("slot") - F.col("pass") * F.col("blocks")
    # The block that may be short is the last of every pass, so what stands before a slot is known.
    full = F.floor(F.col("source_size") / block_words)
    before = F.col("pass") * F.col("source_size") + F.col("turn") * block_words
    length = F.least(F.lit(block_words), F.col("source_size") - F.col("turn") * block_words)
    key = F.xxhash64(F.lit(seed), "number", "pass")
    dealt = _moved(dealt.withColumns({"turn": turn, "full": full, "key": key}))
    moved = dealt.select(
        "shard", "number", "slot", "pass",
        F.when(F.col("moved") >= 0, F.col("moved")).otherwise(F.col("full")).alias("block"),
        F.least(length, F.col("taken") - before).alias("words"),
    )
    slots = cut_lineage(moved, "slots")

    numbers = sources.select("number", F.col("source").alias("__source"))
    known = placed.join(numbers, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    pieces = known.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    edge = F.col("block") * block_words
    pieces = pieces.withColumns({
        "lo": F.greatest(F.col("start") - edge, F.lit(0)),
        "hi": F.least(F.col("start") + F.col("size") - edge, F.lit(block_words)),
        "at": F.greatest(edge - F.col("start"), F.lit(0)),
    })
    return Mixture(placed, sources, slots, pieces)


def _taken(mixture: Mixture) -> DataFrame:
    """Pieces with each slot that takes some of them: ``words`` are those taken, from the piece's first on."""
    met = mixture.pieces.join(mixture.slots.select("number", "block", "pass", "words"), ["number", "block"])
    return met.withColumn("words", F.least("words", "hi") - F.col("lo")).where("words > 0")


def taken_per_document(mixture: Mixture) -> DataFrame:
    """One row per document: doc_id, size, source_size and target of its source, and words taken."""
    row = ["number", "start", "doc_id", "size"]
    none = mixture.pieces.select(*row, F.lit(0).cast("long").alias("words"))
    taken = none.unionByName(_taken(mixture).select(*row, "words")).groupBy(*row).agg(F.sum("words").alias("taken"))
    totals = mixture.sources.select("number", "source", "source_size", "target")
    with_words = taken.join(totals, "number").select("doc_id", "size", "source_size", "target", "taken")
    without = mixture.documents.where("size = 0").join(
        totals.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")))
    return with_words.unionByName(
        without.select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken")))


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", **how: object) -> DataFrame:
    """The mix as documents: a row per document and pass that takes words of it, columns as they are.

    A pass that takes a whole document keeps its text; another one has the words taken, joined by single
    spaces. Rows that agree in key and text are one document here.
    """
    fingerprint = F.xxhash64(text)
    docs = docs.withColumn("__fingerprint", fingerprint).dropDuplicates([key, "__fingerprint"])
    mixture = mix_sources(docs, key, text, **how)
    ranges = _taken(mixture).groupBy("doc_id", "fingerprint", "size", "pass").agg(
        F.sum("words").alias("all"), F.sort_array(F.collect_list(F.struct("at", "words"))).alias("ranges"))
    ranges = ranges.select(
        F.col("doc_id").alias("__doc"), F.col("fingerprint").alias("__print"),
        (F.col("all") == F.col("size")).alias("__whole"), F.col("ranges").alias("__ranges"))
    joined = docs.join(ranges, F.col(key).eqNullSafe(F.col("__doc")) & (F.col("__fingerprint") == F.col("__print")))
    words = F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))
    part = F.array_join(F.flatten(F.transform(
        "__ranges", lambda r: F.slice(words, (r["at"] + 1).cast("int"), r["words"].cast("int")))), " ")
    return joined.withColumn(text, F.when(F.col("__whole"), F.col(text)).otherwise(part)).drop(
        "__doc", "__print", "__whole", "__ranges", "__fingerprint")
