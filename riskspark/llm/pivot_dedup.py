"""Near-duplicate vectors by a pivot-permutation index.

A sample of the vectors, less those near one already taken, are the pivots. A vector is described by its nearest pivots in order of distance, and
stands in the inverted list of each. Vectors that share a list meet there, and those that share enough
pivots are verified by their cosine. A pair that meets in several lists is worked on in that of its
smallest common pivot only.

A list is worked on in blocks of BLOCK against BLOCK rows. A block gives a count of links per vector and
a forest that connects the linked ones, never the links themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.llm.graph import components
from riskspark.llm.vectors import by_width, drawn, matrix, usable
from riskspark.session import cut_lineage

#: Pivots per square root of the number of vectors, and their bounds (the upper one bounds the sample).
PIVOTS, FEWEST_PIVOTS, MOST_PIVOTS = 4, 64, 4096
#: Cosine from which a sampled vector is too near a pivot to be one: a group of near copies, whatever its size, has
#: few pivots, as the nearest of many almost equal ones would be told by each vector's noise.
NEAR = 0.8
#: Nearest pivots that describe a vector, and pivots that a pair shares to be verified.
NEAREST, SHARED = 8, 2
#: Rows that are held against each other at once.
BLOCK = 1024

_LINKS = T.StructType([
    T.StructField("u", T.LongType()), T.StructField("v", T.LongType()), T.StructField("links", T.LongType()),
])


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def _apart(points: np.ndarray) -> np.ndarray:
    """The points, in their order, whose cosine to every one taken before is below NEAR."""
    points = _unit(points)
    taken, covered = [], np.zeros(len(points), bool)
    for i in range(len(points)):
        if not covered[i]:
            taken.append(i)
            covered |= points @ points[i] >= NEAR
    return points[taken]


def _described(nodes: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Add ``pivots``: the nearest ones, nearest first; a length of vector that the sample lacks has one list."""
    shared = nodes.sparkSession.sparkContext.broadcast(pivots)  # MOST_PIVOTS vectors at most
    names = nodes.columns
    schema = T.StructType([*nodes.schema.fields, T.StructField("pivots", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, nearest = batch.column("vector"), [[0]] * batch.num_rows
            for width, rows in by_width(vectors):
                points = shared.value.get(width)
                if points is None:
                    continue
                near = _unit(matrix(vectors.take(pa.array(rows)), width)) @ points.T
                order = np.argsort(-near, axis=1, kind="stable")[:, :NEAREST]
                for row, chosen in zip(rows.tolist(), order.tolist()):
                    nearest[row] = chosen
            columns = [*(batch.column(c) for c in names), pa.array(nearest, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "pivots"])

    return nodes.mapInArrow(run, schema)


def _linked(block: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Links within a block: counts per vector (``u``, ``links``) and a forest (``u``, ``v``)."""
    pivot, row, column = (int(block[c].iat[0]) for c in ("pivot", "row", "column"))
    own = block["own"].to_numpy()
    left, right = np.flatnonzero(own == row), np.flatnonzero(own == column)
    flat = np.concatenate(block["pivots"].to_list())
    names, places = np.unique(flat, return_inverse=True)
    holds = np.zeros((len(block), len(names)), np.float32)
    holds[np.repeat(np.arange(len(block)), block["pivots"].str.len()), places.ravel()] = 1
    need = np.minimum(SHARED, holds.sum(axis=1).min())
    before = np.searchsorted(names, pivot)
    first = holds[left][:, :before] @ holds[right][:, :before].T == 0
    meet = first & (holds[left] @ holds[right].T >= need)
    if row == column:
        meet &= np.arange(len(left))[:, None] < np.arange(len(right))[None, :]
    a, b = np.nonzero(meet)
    vectors = np.stack(block["vector"].to_list()).astype(np.float64)
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    a, b = left[a], right[b]
    close = np.zeros(len(a), bool)
    for start in range(0, len(a), 1 << 16):
        x, y = a[start : start + (1 << 16)], b[start : start + (1 << 16)]
        close[start : start + (1 << 16)] = np.einsum("ij,ij->i", vectors[x], vectors[y]) / (norms[x] * norms[y]) >= cosine
    a, b = a[close], b[close]
    ids, copies = block["node"].to_numpy(), block["copies"].to_numpy()
    links = np.bincount(a, copies[b], minlength=len(block)) + np.bincount(b, copies[a], minlength=len(block))
    root, forest = list(range(len(block))), []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = x, y
        while root[p] != p:
            root[p] = p = root[root[p]]
        while root[q] != q:
            root[q] = q = root[root[q]]
        if p != q:
            root[q] = p
            forest.append((ids[x], ids[y], 0))
    counted = np.flatnonzero(links)
    counts = pd.DataFrame({"u": ids[counted], "v": ids[counted], "links": links[counted].astype(np.int64)})
    return pd.concat([counts, pd.DataFrame(forest, columns=["u", "v", "links"], dtype="int64")])


def near_duplicates(
    table: DataFrame, cosine: float = 0.9, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """Links between vectors of cosine ``cosine`` or more, found by the index.

    Returns one row per row of ``table``: vec_id, n_links (other rows linked directly), component_id (smallest
    key that links reach, its own included) and kept (whether it is that key). No pair below ``cosine`` is
    linked; a pair above it is missed only if the two share fewer than SHARED of their nearest pivots. Equal
    vectors always link. Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, nor do rows without a key, whose component is null. Vectors of different lengths do not link.
    """
    rows = table.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    zero = F.forall("vector", lambda x: x == 0)
    good = F.col("vec_id").isNotNull() & usable(F.col("vector")) & ~F.coalesce(zero, F.lit(True))
    doubles = F.transform("vector", lambda x: x.cast("double") + F.lit(0.0))  # -0.0 and 0.0 are equal
    marked = rows.select("vec_id", F.when(good, doubles).alias("vector"))
    used = marked.where("vector IS NOT NULL")
    # Equal vectors are one node, named by a hash of the vector.
    nodes = used.groupBy("vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    nodes = cut_lineage(nodes.withColumn("node", F.xxhash64("vector")), "nodes")
    most = min(MOST_PIVOTS, max(FEWEST_PIVOTS, int(PIVOTS * nodes.count() ** 0.5)))
    chosen: dict[int, list] = {}
    for row in drawn(nodes, F.col("node"), most).select("vector").collect():
        chosen.setdefault(len(row["vector"]), []).append(row["vector"])
    described = _described(nodes, {w: _apart(np.array(v, float)) for w, v in chosen.items()})
    described = cut_lineage(described, "described")
    listed = described.withColumns({"width": F.size("vector"), "pivot": F.explode("pivots")})
    # One row per pivot: MOST_PIVOTS at most, and one per length of vector that the sample lacks.
    lists = listed.groupBy("width", "pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    listed = listed.join(lists, ["width", "pivot"]).withColumn("own", F.pmod("node", "parts").cast("int"))
    listed = listed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = listed.select(
        "width", "pivot", F.least("own", "other").alias("row"), F.greatest("own", "other").alias("column"),
        "own", "node", "copies", "vector", "pivots")
    found = blocks.groupBy("width", "pivot", "row", "column").applyInPandas(lambda b: _linked(b, cosine), _LINKS)
    found = cut_lineage(found, "links")
    links = found.where("links > 0").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    edges = found.where("u != v").select("u", "v")
    twins = used.select("vec_id", F.xxhash64("vector").alias("node"))
    repeated = twins.groupBy("vec_id").agg(F.min("node").alias("u"), F.max("node").alias("v")).where("u != v")
    edges = edges.unionByName(
        twins.join(repeated, "vec_id").select("u", F.col("node").alias("v")))  # a key with several vectors is one
    groups = components(edges)
    labels = nodes.select("node", "copies", "least").join(groups, "node", "left").join(links, "node", "left")
    labels = labels.withColumn("component", F.coalesce("component", "node"))
    lowest = labels.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = labels.join(lowest, "component").select(
        "node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = marked.withColumn("node", F.when(F.col("vector").isNotNull(), F.xxhash64("vector"))).drop("vector")
    out = out.join(labels, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
