"""The trie of conversations that begin alike, by blocks of turns first.

Conversations are cut into blocks of a fixed number of turns. A digest of all blocks up to one is the sum of
digests of its turns at their places, so that it follows from sums of blocks, however long a conversation is.
Conversations with equal digests up to a block are one group from there on, and only groups are looked at further:
where a group has one next block alone, the turns in it are a chain of nodes as they stand. Where next blocks diverge,
the turns of each are compared one by one, once per block and not once per conversation.

Sums over subtrees are made inside of blocks: a node knows its ancestors there, up to the node that its block begins at.
Between such nodes, if conversations are longer than a block, they are made by doubling: what stands below at a distance
under 1, 2, 4, ... blocks, each round from the one before, in as many rounds as the number of blocks has binary digits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.common import BUCKET_ROWS, numbered, running_offsets
from riskspark.session import cut_lineage

#: Turns of a block.
BLOCK_TURNS = 8
#: A digest of one turn at its place has 88 bits; sums of up to 10^11 of them fit.
_DIGEST, _SUM = "decimal(27,0)", "decimal(38,0)"


@dataclass(frozen=True)
class Trie:
    """``nodes``: a row per node. ``ends``: a row per conversation, with the node of all its turns."""

    nodes: DataFrame
    ends: DataFrame


def ordered_turns(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    window_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Turns without their texts: conv_id, place (from 0), mark (a digest of role and text), n_chars.

    Turns are in order of ``turn``, null first, equal ones in order of their mark. Null roles and texts count as empty.
    Rows without a conversation are left out; repeated rows are turns of their own. Places are made
    in a window per conversation or, if one has over ``window_rows`` turns, by ranges of all turns.
    """
    said, who = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role).cast("string"), F.lit(""))
    rows = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"),
        F.md5(F.concat(F.octet_length(who), F.lit(":"), who, said)).alias("mark"),
        F.char_length(said).cast("long").alias("n_chars"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("mark")]
    if (rows.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0) <= window_rows:
        place = F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)).cast("long") - 1
        return rows.select("conv_id", place.alias("place"), "mark", "n_chars")
    placed = numbered(rows, [F.col("conv_id"), *order], "at")
    first = placed.groupBy(F.col("conv_id").alias("__conv")).agg(F.min("at").alias("__first"))
    return placed.join(first, F.col("conv_id") == F.col("__conv")).select(
        "conv_id", (F.col("at") - F.col("__first")).alias("place"), "mark", "n_chars")


def with_heads(turns: DataFrame, base: Column, taken: Column) -> tuple[DataFrame, DataFrame]:
    """Replace the first turns of each conversation by those of another one.

    ``base`` and ``taken`` are made of ``conv_id``: conversation c begins with the first ``taken`` turns of ``base`` (all
    if it has fewer, none if there is no such conversation), and goes on with its own turns after its first ``taken``.
    Returns the turns and the conversations, as some may have no turn left.
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    heads = sizes.select("conv_id", base.alias("base"), taken.cast("long").alias("taken"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    heads = heads.join(bases, "base", "left").withColumn("head", F.least("taken", F.coalesce("n_base", F.lit(0))))
    heads = cut_lineage(heads.select("conv_id", "base", "taken", "head"), "heads")
    most = heads.agg(F.max("taken")).first()[0] or 0
    own = turns.join(heads, "conv_id").where(F.col("place") >= F.col("taken"))
    own = own.withColumn("place", F.col("place") - F.col("taken") + F.col("head"))
    begun = turns.where(F.col("place") < most).withColumnRenamed("conv_id", "base")
    begun = begun.join(heads, "base").where(F.col("place") < F.col("head"))
    columns = ["conv_id", "place", "mark", "n_chars"]
    return own.select(*columns).unionByName(begun.select(*columns)), heads.select("conv_id")


def _digest(place: Column, mark: Column) -> Column:
    """A number of 88 bits for a turn at a place."""
    digits = F.md5(F.concat_ws(":", place, mark))
    high, low = (F.conv(F.substring(digits, at, 11), 16, 10).cast("decimal(14,0)") for at in (1, 12))
    return (high * F.lit(1 << 44).cast("decimal(14,0)") + low).cast(_DIGEST)


def _blocks(turns: DataFrame, size: int) -> DataFrame:
    """A row per conversation and block: its turns in order, and its own digest."""
    rows = turns.select(
        "conv_id", F.floor(F.col("place") / size).cast("long").alias("block"),
        F.struct("place", _digest(F.col("place"), F.col("mark")).alias("digest"), "n_chars").alias("turn"))
    return rows.groupBy("conv_id", "block").agg(
        F.array_sort(F.collect_list("turn")).alias("turns"), F.sum("turn.digest").cast(_SUM).alias("digest"))


def _begun(blocks: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add ``before``, the digest of all blocks before: by conversation, or by buckets if one has more blocks than a bucket."""
    if (blocks.agg(F.max("block")).first()[0] or 0) < bucket_rows:
        earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        return blocks.withColumn("before", F.coalesce(F.sum("digest").over(earlier), F.lit(0)).cast(_SUM))
    blocks = blocks.withColumn("bucket", F.floor(F.col("block") / bucket_rows))
    return running_offsets(blocks, ["conv_id"], "bucket", ["block"], F.col("digest"), "before", _SUM).drop("bucket")


def _turn_nodes(groups: DataFrame) -> DataFrame:
    """A node per turn of each group of blocks, with its ancestors in the block; ``inner`` if a turn of the block follows."""

    def longer(path: Column, turn: Column) -> Column:
        return F.concat(path, F.array((F.element_at(path, -1) + turn["digest"]).cast(_SUM)))

    def node(turn: Column, i: Column) -> Column:
        return F.struct(
            (turn["place"] + 1).alias("depth"), F.element_at("path", i + 2).alias("node"), F.element_at("path", i + 1).alias("up"),
            F.slice("path", 1, i + 1).alias("above"), (i + 1 < F.size("turns")).alias("inner"), turn["n_chars"].alias("n_chars"))

    groups = groups.withColumn("path", F.aggregate("turns", F.array("before"), longer))
    nodes = groups.select("conv_id", "n_convs", F.explode(F.transform("turns", node)).alias("n"))
    return nodes.select("n.*", "conv_id", "n_convs")


def _divided(blocks: DataFrame) -> DataFrame:
    """All nodes but the root, from blocks."""
    groups = blocks.groupBy("block", "before", "digest", F.size("turns").alias("size")).agg(
        F.first("turns").alias("turns"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    groups = cut_lineage(groups, "blocks")
    columns = ["before", "turns", "conv_id", "n_convs"]
    # First blocks all follow the root: they are compared by turns in any case, so that no task looks them all up.
    first, later = groups.where("block = 0"), groups.where("block > 0")
    followed = later.groupBy("block", "before").agg(
        F.count("*").alias("siblings"), *(F.first(c).alias(f"one_{c}") for c in columns[1:]))
    alone = followed.where("siblings = 1").select("before", *(F.col(f"one_{c}").alias(c) for c in columns[1:]))
    forks = followed.where("siblings > 1").select("block", "before")
    diverging = later.join(forks, ["block", "before"], "left_semi")
    split = _turn_nodes(first.select(*columns).unionByName(diverging.select(*columns)))
    split = split.groupBy("depth", "node", "up", "above").agg(
        F.bool_or("inner").alias("inner"), F.first("n_chars").alias("n_chars"), F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"))
    return _turn_nodes(alone).unionByName(split)


def _subtree_sums(nodes: DataFrame, deepest: int) -> DataFrame:
    """Per node with nodes below it: leaves and saved of these, by doubling the distance that is added up.

    ``nodes`` has node, up, depth, leaves and saved, without the root; ``up`` is 0 for nodes of depth 1.
    """
    live, pulled, step = nodes, [], 1
    while step <= deepest:
        sums = live.groupBy(F.col("up").alias("of")).agg(F.sum("leaves").alias("leaves_below"), F.sum("saved").alias("saved_below"))
        pulled.append(sums)
        deeper = live.where(F.col("depth") >= 2 * step).join(sums, F.col("node") == F.col("of"), "left").select(
            "node", "up", "depth", (F.col("leaves") + F.coalesce("leaves_below", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("saved_below", F.lit(0))).alias("saved"))
        # What is twice the step deep hangs on the root then; only the others need to look their node up.
        jump = live.select(F.col("node").alias("via"), F.col("up").alias("to"))
        far = deeper.where(F.col("depth") > 2 * step).join(jump, F.col("up") == F.col("via"))
        far = far.withColumn("up", F.col("to")).drop("via", "to")
        near = deeper.where(F.col("depth") == 2 * step).withColumn("up", F.lit(0).cast(_SUM))
        step *= 2
        if step <= deepest:
            live = cut_lineage(far.unionByName(near), "below")
    every = reduce(DataFrame.unionByName, pulled)
    return every.groupBy("of").agg(F.sum("leaves_below").alias("leaves_below"), F.sum("saved_below").alias("saved_below"))


def _with_blocks_below(rows: DataFrame, deepest: int, size: int) -> DataFrame:
    """``rows`` of ``_sums``, where those that end a block stand for all that is below them, too."""
    columns, ends_block = ["node", "depth", "above", "leaves", "saved"], F.col("depth") % size == 0
    # What is inside of the block that begins at a node; a row, if only of zeros, wherever the node is not a leaf.
    inside = rows.groupBy(F.col("above")[0].alias("of")).agg(
        *(F.sum(F.when(ends_block, 0).otherwise(F.col(c))).alias(f"{c}_inside") for c in ("leaves", "saved")))
    ends = rows.where(ends_block).join(inside, F.col("node") == F.col("of"), "left")
    ends = ends.withColumns({
        "leaves": F.coalesce("leaves_inside", F.lit(1)), "saved": F.col("saved") + F.coalesce("saved_inside", F.lit(0))})
    ends = cut_lineage(ends.select(*columns), "block ends")
    if deepest >= 2 * size:
        blocks = ends.select("node", F.col("above")[0].alias("up"), (F.col("depth") / size).cast("long").alias("depth"), "leaves", "saved")
        ends = ends.join(_subtree_sums(blocks, deepest // size), F.col("node") == F.col("of"), "left").withColumns(
            {c: F.col(c) + F.coalesce(f"{c}_below", F.lit(0)) for c in ("leaves", "saved")})
    return rows.where(~ends_block).select(*columns).unionByName(ends.select(*columns))


def _sums(nodes: DataFrame, deepest: int, size: int) -> DataFrame:
    """Per node with nodes below it: its children, and leaves and saved of all below it."""
    rows = nodes.where("depth >= 1").select(
        "node", "depth", "above", (~F.col("inner")).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved"))
    if deepest > size:
        rows = _with_blocks_below(rows, deepest, size)
    above = F.transform("above", lambda of, i: F.struct(of.alias("of"), (i + 1 == F.size("above")).alias("parent")))
    return rows.select(F.explode(above).alias("a"), "leaves", "saved").groupBy(F.col("a.of").alias("of")).agg(
        F.count_if("a.parent").alias("n_children"), F.sum("leaves").alias("leaves_below"), F.sum("saved").alias("saved_below"))


def prefix_trie(turns: DataFrame, convs: DataFrame, block_turns: int = BLOCK_TURNS) -> Trie:
    """The trie of conversations: a node per distinct sequence of first turns, from the root without turns.

    ``turns`` has conv_id, place (from 0, without gaps), mark and n_chars; ``convs`` the distinct conv_id, with those
    that have no turn. Two turns are the same if their marks are. ``nodes`` has node and up (the parent's), numbers that
    are the same in every run; conv_id (the smallest member's), depth, parent_conv_id, n_convs (members: conversations
    that begin so), n_chars (of the last turn), n_children, n_leaves (childless nodes in the subtree, a childless
    node itself) and saved_tokens (the subtree's sum of n_chars for each member but one). A node's last turn
    is that at place ``depth - 1`` of conv_id. Without conversations there are no nodes.
    """
    blocks = cut_lineage(_blocks(turns, block_turns), "turns")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        F.lit(0).cast("long").alias("depth"), F.lit(0).cast(_SUM).alias("node"), F.lit(None).cast(_SUM).alias("up"),
        F.array().cast(f"array<{_SUM}>").alias("above"), F.lit(False).alias("inner"), F.lit(0).cast("long").alias("n_chars"),
        "conv_id", "n_convs")
    nodes = cut_lineage(_divided(_begun(blocks)).unionByName(root), "nodes")
    # The root's own number is known: its children, often the most of all, look nothing up.
    least, deepest = nodes.agg(F.min("conv_id"), F.max("depth")).first()
    parents = nodes.select(F.col("node").alias("__node"), F.col("conv_id").alias("parent_conv_id"))
    low = nodes.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(least)).cast("long"))
    high = nodes.where("depth > 1").join(parents, F.col("up") == F.col("__node")).drop("__node")
    below = _sums(nodes, deepest or 0, block_turns)
    told = low.unionByName(high).join(below, F.col("node") == F.col("of"), "left").select(
        "depth", "node", "up", "n_chars", "conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.coalesce("leaves_below", F.lit(1)).alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("n_chars") + F.coalesce("saved_below", F.lit(0))).alias("saved_tokens"), "parent_conv_id")
    every = blocks.select("conv_id", "digest").unionByName(convs.select("conv_id", F.lit(0).cast(_SUM).alias("digest")))
    ends = every.groupBy("conv_id").agg(F.sum("digest").cast(_SUM).alias("node"))
    return Trie(told, ends)


def _starts(nodes: pa.Array) -> list[int]:
    """Where a new node begins in a batch of ordered rows, and the end."""
    new = pc.not_equal(nodes.slice(1), nodes.slice(0, len(nodes) - 1)).to_numpy(zero_copy_only=False)
    return [0, *(np.flatnonzero(new) + 1).tolist(), len(nodes)]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        edges = _starts(batch.column("node"))
        ids = batch.column("conv_id").cast(pa.string())
        lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), ids)
        first = pa.array(edges[:-1])
        yield pa.RecordBatch.from_arrays(
            [batch.column("node").take(first), batch.column("conv_id").take(first), pc.binary_join(lists, ",")],
            names=["node", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, state = None, None
    for batch in batches:
        done, digests = [], []
        for at, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
            if at == node:
                state.update(b",")
            else:
                if state is not None:
                    done.append(node)
                    digests.append(state.hexdigest())
                node, state = at, hashlib.sha256()
            state.update(ids.encode())
        yield pa.RecordBatch.from_arrays(
            [pa.array(done, batch.column("node").type), pa.array(digests, pa.string())], names=["node", "ends_sha256"])
        kind = batch.column("node").type
    if state is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([node], kind), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])


def end_digests(ends: DataFrame, joined_rows: int = BUCKET_ROWS) -> DataFrame:
    """Per node with conversations that end there: the SHA-256 of their ids in rising order, joined by commas.

    Up to ``joined_rows`` ids of a node are sorted and joined in one row. Those of nodes with more are sorted by ranges of node
    and id and joined into pieces there, so that a node where most conversations end is many pieces; one task then reads
    a node's pieces in order, one after the other, as the digest asks for.
    """
    ends = cut_lineage(ends, "ends")
    sizes = ends.groupBy(F.col("node").alias("of")).agg(F.count("*").alias("n"))
    if (sizes.agg(F.max("n")).first()[0] or 0) <= joined_rows:
        return _joined_digests(ends)
    sizes = cut_lineage(sizes, "ends of nodes")
    same = F.col("node") == F.col("of")
    few = ends.join(sizes.where(F.col("n") <= joined_rows), same, "left_semi")
    many = ends.join(sizes.where(F.col("n") > joined_rows), same, "left_semi")
    return _joined_digests(few).unionByName(_pieced_digests(cut_lineage(many, "many ends")))


def _joined_digests(ends: DataFrame) -> DataFrame:
    ids = F.concat_ws(",", F.sort_array(F.collect_list("conv_id")).cast("array<string>"))
    return ends.groupBy("node").agg(F.sha2(ids, 256).alias("ends_sha256"))


def _pieced_digests(ends: DataFrame) -> DataFrame:
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ends.repartitionByRange(parts, "node", "conv_id").sortWithinPartitions("node", "conv_id")
    pieces = dealt.select("node", "conv_id").mapInArrow(_pieces, f"node {_SUM}, first long, ids string")
    gathered = pieces.repartition(parts, "node").sortWithinPartitions("node", "first")
    return gathered.mapInArrow(_hashed, f"node {_SUM}, ends_sha256 string")
