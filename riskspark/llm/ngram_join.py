"""N-gram Jaccard self-join of documents by grouped prefixes.

Sets of word shingles link when their Jaccard similarity is at least ``percent`` / 100. Shingles are put in
one order for all sets, seldom ones first. Two linked sets then share a shingle among the first few of
each, their prefixes. Sets with the same prefix and size are one group; groups meet in the list of a
shingle that both prefixes hold, are filtered by size and by the place of the shingle, and are expanded to
their members. Members pass a bound from parity bitmaps before the texts themselves are compared.

Exact copies of a set are one node. In a first round each list gives only a spanning forest of the pairs
that pass, the closest ones first; in a second one all pairs that pass and are not connected yet. So no
list gives all of its pairs, and no pair that could connect two components is left out. A list is worked on
in blocks of BLOCK members against BLOCK members, so that a frequent shingle is neither one task nor one array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.llm.common import mix, shingles_of, slices
from riskspark.llm.graph import components
from riskspark.session import cut_lineage

#: Counters of shingle frequency, and those that travel in one row. Several shingles share a counter; it only
#: orders shingles and changes no result.
COUNTERS, SEGMENT = 1 << 20, 1 << 10
#: Members of a list that are held against each other at once.
BLOCK = 1024
#: Lists up to this length are compared many at a time.
SMALL = 64
#: Bits of a set's parity bitmap.
BITS = 1024

_SEGMENTS = T.StructType([T.StructField("segment", T.IntegerType()), T.StructField("counts", T.BinaryType())])
_SETS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("size", T.LongType()),
    T.StructField("set_id", T.LongType()),
    T.StructField("prefix_id", T.LongType()),
    T.StructField("prefix", T.ArrayType(T.LongType())),
])
_MEMBERS = T.StructType([
    T.StructField("set_id", T.LongType()),
    T.StructField("bitmap", T.BinaryType()),
    T.StructField("text", T.StringType()),
])
_PAIRS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _signature(shingles: np.ndarray, extra: int = 0) -> int:
    """A signed 64-bit hash of a sequence of shingles and a number."""
    places = np.arange(1, len(shingles) + 1, dtype=np.uint64)
    total = np.bitwise_xor.reduce(mix(shingles + places * np.uint64(0x9E3779B97F4A7C15))) if len(shingles) else 0
    return int(mix(np.array([total], np.uint64) + np.uint64(len(shingles) + (extra << 32)))[0].astype(np.int64))


def _counters(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(40)).astype(np.int64) % COUNTERS


def _weights(docs: DataFrame, width: int) -> np.ndarray:
    """A coarse logarithm of the occurrences per counter over all documents: a table of fixed size."""

    def packed(totals: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for segment, counts in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([segment], pa.int32()), pa.array([counts.tobytes()], pa.binary())], names=_SEGMENTS.names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in slices(batches, "text"):
            total += np.bincount(_counters(np.concatenate(shingles_of(batch.column("text"), width))), minlength=COUNTERS)
        yield from packed(dict(enumerate(total.reshape(-1, SEGMENT))))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, counts in zip(batch.column("segment").to_pylist(), batch.column("counts").to_pylist()):
                totals[segment] = totals.get(segment, 0) + np.frombuffer(counts, np.int64)
        yield from packed(totals)

    counted = docs.select("text").mapInArrow(count, _SEGMENTS).repartition("segment").mapInArrow(add, _SEGMENTS)
    out = np.zeros((COUNTERS // SEGMENT, SEGMENT), np.int64)
    for row in counted.collect():  # COUNTERS numbers, whatever the input
        out[row["segment"]] = np.frombuffer(row["counts"], np.int64)
    return np.minimum(8 * np.log2(out.ravel() + 1), 255).astype(np.uint8)


def _sets(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Per document: size and identity of its set, and its prefix in the order common to all sets."""
    weights = docs.sparkSession.sparkContext.broadcast(_weights(docs, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingles_of(batch.column("text"), width)
            prefixes = []
            for shingles in sets:
                first = len(shingles) - -(-percent * len(shingles) // 100) + 1 if len(shingles) else 0
                order = np.argsort(weights.value[_counters(shingles)], kind="stable")[:first]  # then by hash
                prefixes.append(shingles[order])
            ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            flat = np.concatenate(prefixes).astype(np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([_signature(s) for s in sets], pa.int64()),
                pa.array([_signature(p, len(s)) for p, s in zip(prefixes, sets)], pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
            ], names=_SETS.names)

    return docs.mapInArrow(run, _SETS)


def _bitmap(shingles: np.ndarray) -> bytes:
    """Parity of the shingles per bit: two sets differ in at least as many members as bitmaps in bits."""
    counts = np.bincount((shingles >> np.uint64(20)).astype(np.int64) % BITS, minlength=BITS)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def _members(met: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """A text and a bitmap for each set in ``met``, from the document that stands for it."""
    told = docs.withColumn("print", F.xxhash64("text")).join(met.select("doc_id", "set_id"), "doc_id")
    told = told.dropDuplicates(["doc_id", "set_id", "print"]).select("set_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingles_of(batch.column("text"), width)
            own = np.array([_signature(s) for s in sets]) == batch.column("set_id").to_numpy()
            yield pa.RecordBatch.from_arrays([
                batch.column("set_id"), pa.array([_bitmap(s) for s in sets], pa.binary()), batch.column("text"),
            ], names=_MEMBERS.names).filter(pa.array(own))

    return told.mapInArrow(run, _MEMBERS)


def _postings(groups: DataFrame) -> DataFrame:
    """Each group in the lists of its prefix. Lists of one group are left out, but one per group of several sets."""
    place = F.col("at") * 2 + F.when(F.col("several"), 1).otherwise(0)
    every = groups.select(F.posexplode("prefix").alias("at", "shingle"), "prefix_id", "several")
    every = every.select("shingle", "prefix_id", place.alias("packed"))
    # Counts are added up before the shuffle, and the join may split a frequent shingle: none has one task to itself.
    shared = every.groupBy("shingle").agg(F.count("*").alias("total")).where("total > 1")
    met = every.join(shared, "shingle", "left").where("total IS NOT NULL OR packed = 1")
    return met.select("shingle", "prefix_id", F.expr("packed div 2").cast("int").alias("place"))


def _lists(postings: DataFrame, met: DataFrame) -> DataFrame:
    """Members of each shingle's list, with the block of the list they are compared in.

    A list of up to BLOCK members is one block. A longer one is dealt into parts; a member goes to the block
    of its own part with every part.
    """
    entries = cut_lineage(postings.join(met.select("prefix_id", "size", "set_id"), "prefix_id"), "entries")
    long = entries.groupBy("shingle").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")).where("parts > 1")
    entries = entries.join(long, "shingle", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    entries = entries.withColumn("own", F.pmod(F.xxhash64("set_id"), "parts").cast("int"))
    entries = entries.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return entries.select(
        "shingle", F.least("own", "other").alias("row"), F.greatest("own", "other").alias("column"), "own",
        "prefix_id", "size", "place", "set_id",
    )


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Sorted rows as arrays, cut between blocks; ``start`` is the place of each block, and the end."""
    held = None
    for batch in _and_then(batches, None):
        if batch is not None:
            held = batch if held is None else pa.concat_batches([held, batch])
        if held is None or not held.num_rows:
            continue
        rows = {c: held.column(c).to_numpy(zero_copy_only=False) for c in held.schema.names if c != "bitmap"}
        if "bitmap" in held.schema.names:
            packed = held.column("bitmap").cast(pa.binary(BITS // 8))
            words = np.frombuffer(packed.buffers()[1], np.uint64).reshape(-1, BITS // 64)
            rows["bitmap"] = words[packed.offset : packed.offset + len(packed)]
        change = np.zeros(held.num_rows - 1, bool)
        for c in ("shingle", "row", "column"):
            change |= rows[c][1:] != rows[c][:-1]
        start = np.concatenate([[0], np.flatnonzero(change) + 1, [held.num_rows]])
        if batch is not None:
            start = start[:-1]  # the last block may go on
        if len(start) > 1:
            yield {c: values[: start[-1]] for c, values in rows.items()} | {"start": start}
        held = held.slice(int(start[-1]))


def _and_then(batches: Iterator, last: object) -> Iterator:
    yield from batches
    yield last


def _close(rows: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """Of pairs of places, those that may be linked: by size and place of their groups, then by bitmaps.

    The third array tells how much of what two linked sets may differ in the bitmaps already differ.
    """
    a, b = rows["size"][x], rows["size"][y]
    need = -(-percent * (a + b) // (100 + percent))  # members that linked sets of these sizes share
    i, j = rows["place"][x].astype(np.int64), rows["place"][y].astype(np.int64)
    most = np.minimum(i, j) + 1 + np.minimum(a - 1 - i, b - 1 - j)
    meet = np.flatnonzero((100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (most >= need))
    x, y, spare = x[meet], y[meet], (a + b - 2 * need)[meet]
    if "bitmap" not in rows:
        return x, y, spare
    apart = np.bitwise_count(rows["bitmap"][x] ^ rows["bitmap"][y]).sum(axis=1, dtype=np.int64)
    chosen = apart <= spare
    return x[chosen], y[chosen], ((apart + 1) / (spare + 1))[chosen]


def _joint(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(arrays) for arrays in zip(*parts))


def _passing(rows: dict[str, np.ndarray], percent: int, short: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs of places that may be linked: those of all small lists, then those of each longer block."""
    start = rows["start"]
    sizes = np.diff(start)
    left = np.repeat(np.where(sizes <= SMALL, start[1:], start[:-1]), sizes) - np.arange(start[-1])  # rows to the block's end
    within = rows["row"] == rows["column"]
    parts = []
    for step in range(1, min(SMALL, int(sizes.max()))):
        x = np.flatnonzero((left > step) & (within | (rows["own"] != np.roll(rows["own"], -step))))
        if len(x):
            parts.append(_close(rows, x, x + step, percent))
    if parts:
        yield _joint(parts)
    if short:
        return
    for first, end in zip(start[:-1][sizes > SMALL].tolist(), start[1:][sizes > SMALL].tolist()):
        places, parts = np.arange(first, end), []
        own, row = rows["own"][first:end], rows["row"][first]
        for x in places[own == row].tolist():
            others = places[places > x] if row == rows["column"][first] else places[own != row]
            parts.append(_close(rows, np.full(len(others), x), others, percent))
        if parts:
            yield _joint(parts)


def _sorted_blocks(lists: DataFrame) -> DataFrame:
    block = ("shingle", "row", "column")
    return lists.repartition(*block).sortWithinPartitions(*block)


def _open_lists(lists: DataFrame, percent: int) -> DataFrame:
    """Of the entries of short lists, those with another one that size and place allow a link with."""
    names = lists.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_blocks(batches):
            sizes = np.diff(rows["start"])
            kept = np.repeat(sizes > SMALL, sizes)
            for x, y, _ in _passing(rows, percent, short=True):
                kept[x] = kept[y] = True
            if kept.any():
                yield pa.RecordBatch.from_arrays([pa.array(rows[c][kept]) for c in names], names=names)

    return _sorted_blocks(lists).mapInArrow(run, lists.schema)


def _forest(xs: np.ndarray, ys: np.ndarray, apart: np.ndarray, size: int) -> np.ndarray:
    """A spanning forest of pairs of places, the closest pairs first."""
    order = np.argsort(apart, kind="stable")
    root, forest = list(range(size)), []
    for x, y in zip(xs[order].tolist(), ys[order].tolist()):
        p, q = x, y
        while root[p] != p:
            root[p] = p = root[root[p]]
        while root[q] != q:
            root[q] = q = root[root[q]]
        if p != q:
            root[q] = p
            forest.append((x, y))
    return np.array(forest, np.int64).reshape(-1, 2)


def _candidates(lists: DataFrame, members: DataFrame, percent: int, labelled: bool) -> DataFrame:
    """Pairs to verify: a spanning forest of each block, or with labels each pair of two components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_blocks(batches):
            found = []
            for xs, ys, apart in _passing(rows, percent):
                if labelled:
                    two = rows["component"][xs] != rows["component"][ys]
                    found.append(np.stack([xs[two], ys[two]], axis=1))
                else:
                    found.append(_forest(xs, ys, apart, int(rows["start"][-1])))
            if found:
                pairs = np.unique(np.sort(rows["set_id"][np.concatenate(found)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=_PAIRS.names)

    marked = lists.join(members.select("set_id", "bitmap"), "set_id")
    return _sorted_blocks(marked).mapInArrow(run, _PAIRS).distinct()


def _verified(pairs: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """Of the pairs, those whose sets are similar enough, by the texts themselves."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    texts = members.select("set_id", "text").join(wanted, "set_id", "left_semi")
    both = (
        pairs.join(texts.select(F.col("set_id").alias("b"), F.col("text").alias("second")), "b")
        .join(texts.select(F.col("set_id").alias("a"), F.col("text").alias("first")), "a")
        .select("a", "b", "first", "second")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "second"):
            names = batch.column("a").to_pylist()
            new = [i for i, a in enumerate(names) if not i or a != names[i - 1]]
            firsts = shingles_of(batch.column("first").take(pa.array(new, pa.int32())), width)
            known = dict(zip((names[i] for i in new), firsts))
            linked = []
            for a, second in zip(names, shingles_of(batch.column("second"), width)):
                shared = len(np.intersect1d(known[a], second, assume_unique=True))
                linked.append(100 * shared >= percent * (len(known[a]) + len(second) - shared))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b")], names=_PAIRS.names).filter(pa.array(linked, pa.bool_()))

    return both.mapInArrow(run, _PAIRS)


def similar_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """Group documents that links of similar shingle sets connect.

    Returns one row per row of ``docs``: ``doc_id``, ``n_shingles`` (size of its set) and
    ``component_id`` (smallest key reachable, its own included). Words are lower-cased in A-Z and stand
    between ASCII white space. A text with fewer words than ``width`` is one shingle as a whole. A null
    text or one without words has an empty set, which links with nothing. Rows without a key link with
    nothing either and have no component. Repeated keys are one document with several texts.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sets = cut_lineage(_sets(docs, width, percent), "sets")
    filled = sets.where("size > 0 AND doc_id IS NOT NULL")
    nodes = filled.groupBy("set_id", "size", "prefix_id").agg(F.min("doc_id").alias("doc_id"))
    groups = filled.groupBy("prefix_id").agg(
        F.any_value("prefix").alias("prefix"), (F.min("set_id") != F.max("set_id")).alias("several"))
    postings = cut_lineage(_postings(groups), "postings")
    met = cut_lineage(nodes.join(postings.select("prefix_id").distinct(), "prefix_id", "left_semi"), "met")
    lists = cut_lineage(_open_lists(_lists(postings, met), percent), "lists")
    met = met.join(lists.select("set_id").distinct(), "set_id", "left_semi")
    members = cut_lineage(_members(met, docs, width), "members")

    tried = cut_lineage(_candidates(lists, members, percent, False), "tried")
    links = cut_lineage(_verified(tried, members, width, percent), "links")
    repeated = filled.groupBy("doc_id").agg(F.min("set_id").alias("a"), F.max("set_id").alias("b")).where("a != b")
    repeated = filled.select("doc_id", F.col("set_id").alias("b")).join(repeated.select("doc_id", "a"), "doc_id")
    edges = links.unionByName(repeated.select("a", "b")).select(F.col("a").alias("u"), F.col("b").alias("v"))
    found = components(edges)
    component = F.coalesce("component", "set_id").alias("component")
    block = ["shingle", "row", "column"]
    joined = lists.join(found.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", component)
    joined = cut_lineage(joined, "labelled")
    open_blocks = joined.groupBy(*block).agg(F.min("component").alias("low"), F.max("component").alias("high"))
    joined = joined.join(open_blocks.where("low != high").select(*block), block, "left_semi")
    rest = _candidates(joined, members, percent, True).join(tried, ["a", "b"], "left_anti")
    more = cut_lineage(_verified(rest, members, width, percent), "links")
    edges = found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(
        more.select(F.col("a").alias("u"), F.col("b").alias("v")))
    found = components(edges)

    labels = nodes.join(found.withColumnRenamed("node", "set_id"), "set_id", "left").select(
        "set_id", "doc_id", component)
    least = labels.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_set = labels.join(least, "component").select("set_id", "component_id")
    kept = filled.select("doc_id", F.col("size").alias("n_shingles"), "set_id").join(by_set, "set_id").drop("set_id")
    empty = sets.where("size = 0 OR doc_id IS NULL").select("doc_id", F.col("size").alias("n_shingles"))
    own = filled.groupBy("doc_id").agg(F.min("set_id").alias("set_id")).join(by_set, "set_id").select(
        F.col("doc_id").alias("id"), "component_id")
    empty = empty.join(own, F.col("doc_id") == F.col("id"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return kept.select("doc_id", "n_shingles", "component_id").unionByName(empty)


def one_per_group(docs: DataFrame, key: str = "doc_id", text: str = "text", **how: int) -> DataFrame:
    """Keep the document with the smallest key of each group; columns stay as they are.

    Of rows that repeat a key one stays. Rows without a key stay.
    """
    gone = similar_groups(docs, key, text, **how).where("component_id != doc_id").select(F.col("doc_id").alias(key))
    kept = docs.where(F.col(key).isNotNull()).join(gone.distinct(), key, "left_anti").select(docs.columns)
    return kept.dropDuplicates([key]).unionByName(docs.where(F.col(key).isNull()))
