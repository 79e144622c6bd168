"""Exact top-k search by inner product in M-trees.

A vector of norm n is lifted by one component, sqrt(m^2 - n^2), m being the largest norm; queries get 0 there.
Then the largest inner products are the nearest neighbours in a metric space, where triangle inequalities
hold. A sample of vectors are the routing objects of the tree's top; each vector belongs to the nearest
one, and the rows of a routing object are stored in pages. A page is an M-tree of its own: nodes of few
entries with covering radii and distances to their parents. A query visits the nodes of a page best first;
what the stored distances rule out is never computed.

A query first searches the pages of its nearest routing object. The k-th score found there bounds the
search in all other pages, of which it visits only those that covering radii do not rule out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.llm.vectors import by_width, drawn, matrix, usable
from riskspark.session import cut_lineage

#: Routing objects at the top (the bound of the sample), and the vectors that ask for one more of them.
ROUTES, PER_ROUTE = 256, 2048
#: Vectors of a page, entries of a leaf and of a node.
PAGE, LEAF, FANOUT = 4096, 512, 16
#: Queries that search a page together.
QUERIES = 4096
#: Rounding errors of distances are far smaller; squared distances of different scores differ by 2 at least.
SLACK = 1e-6

_FOUND = T.StructType([
    T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType()),
])


@dataclass
class Node:
    """Entries below one routing object. A leaf's entries are vectors; other nodes' are children."""

    points: np.ndarray
    to_parent: np.ndarray
    places: np.ndarray | None = None
    radii: np.ndarray | None = None
    children: list[Node] = field(default_factory=list)


def _distances(points: np.ndarray, point: np.ndarray) -> np.ndarray:
    apart = points - point
    return np.sqrt(np.einsum("ij,ij->i", apart, apart))


def build(points: np.ndarray, places: np.ndarray, parent: np.ndarray) -> Node:
    """The M-tree of lifted vectors below the routing object ``parent``, loaded in bulk."""
    if len(points) <= LEAF:
        return Node(points, _distances(points, parent), places)
    # Routing objects far from each other: each one is the point farthest from those before.
    chosen, near = [0], _distances(points, points[0])
    group = np.zeros(len(points), np.int64)
    while len(chosen) < FANOUT and near.max() > 0:
        chosen.append(int(near.argmax()))
        far = _distances(points, points[chosen[-1]])
        group[far < near] = len(chosen) - 1
        near = np.minimum(near, far)
    if len(chosen) == 1:
        return Node(points, _distances(points, parent), places)  # all alike: one leaf of any length
    parts = [np.flatnonzero(group == g) for g in range(len(chosen))]
    node = Node(points[chosen], _distances(points[chosen], parent), radii=np.array([near[p].max() for p in parts]))
    node.children = [build(points[p], places[p], points[c]) for p, c in zip(parts, chosen)]
    return node


@dataclass
class Page:
    """An M-tree with the whole-number vectors and the ids of its entries; each entry has some ids, ascending."""

    root: Node
    vectors: np.ndarray
    ids: list[np.ndarray]
    norm: float

    def search(self, query: np.ndarray, own: int, k: int, least: int | None) -> list[tuple[int, int]]:
        """The best ``k`` (score, id), best first, of those with a score of ``least`` or more.

        Of equal scores the smaller ids are best; ``own`` is left out.
        """
        point = np.append(query, 0).astype(float)
        whole = float(query @ query) + self.norm
        best: list[tuple[int, int]] = []  # heap of (score, -id): the worst is first
        floor = -np.inf if least is None else float(least)
        reach = np.sqrt(max(whole - 2 * floor, 0)) + SLACK if least is not None else np.inf
        turn = 0
        queue: list[tuple[float, int, Node, float]] = [(0.0, 0, self.root, -1.0)]
        while queue:
            bound, _, node, to_parent = heapq.heappop(queue)
            if bound > reach:
                break
            gap = np.abs(node.to_parent - to_parent) if to_parent >= 0 else np.zeros(len(node.points))
            if node.places is None:
                open_at = np.flatnonzero(gap - node.radii <= reach)
                far = _distances(node.points[open_at], point)
                lowest = np.maximum(far - node.radii[open_at], 0)
                for i in np.flatnonzero(lowest <= reach).tolist():
                    turn += 1
                    heapq.heappush(queue, (float(lowest[i]), turn, node.children[open_at[i]], float(far[i])))
                continue
            near = gap <= reach
            places = node.places if near.all() else node.places[near]
            scores = self.vectors[places] @ query
            if len(scores) > k + 1:
                # One entry may be the query's own; what is below the next k is not among the best.
                floor = max(floor, float(np.partition(scores, -k - 1)[-k - 1]))
            for i in np.flatnonzero(scores >= floor).tolist():
                score = int(scores[i])
                for other in self.ids[places[i]].tolist():
                    if other == own:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (score, -other))
                    elif (score, -other) > best[0]:
                        heapq.heapreplace(best, (score, -other))
                    else:
                        break  # further ids of an entry are larger
            if len(best) == k and best[0][0] >= floor:
                floor = float(best[0][0])
                reach = np.sqrt(max(whole - 2 * floor, 0)) + SLACK
        return [(score, -other) for score, other in sorted(best, reverse=True)]


def _lifted(vectors: np.ndarray, norm: float) -> np.ndarray:
    """Vectors with the component that gives all the same norm."""
    squares = np.einsum("ij,ij->i", vectors, vectors).astype(float)
    return np.column_stack([vectors.astype(float), np.sqrt(np.maximum(norm - squares, 0))])


@dataclass
class Routes:
    """Routing objects of the top by length of vector; a length that the sample lacks has the zero vector."""

    norm: float
    points: dict[int, np.ndarray]

    def of(self, width: int) -> np.ndarray:
        return self.points.get(width, np.zeros((1, width + 1)))


def _routed(entries: DataFrame, routes: Routes) -> DataFrame:
    """Add ``route`` (place of the nearest routing object) and ``far`` (the distance to it)."""
    shared = entries.sparkSession.sparkContext.broadcast(routes)  # ROUTES vectors at most
    names = entries.columns
    schema = T.StructType([*entries.schema.fields, T.StructField("route", T.IntegerType()), T.StructField("far", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            route, far = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for width, rows in by_width(vectors):
                tops = shared.value.of(width)
                points = _lifted(matrix(vectors.take(pa.array(rows)), width, np.int64), shared.value.norm)
                squares = (points**2).sum(axis=1)[:, None] + (tops**2).sum(axis=1) - 2 * points @ tops.T
                route[rows] = squares.argmin(axis=1)
                far[rows] = np.sqrt(((points - tops[route[rows]]) ** 2).sum(axis=1))
            columns = [*(batch.column(c) for c in names), pa.array(route), pa.array(far)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "route", "far"])

    return entries.mapInArrow(run, schema)


def _visits(queries: DataFrame, routes: Routes, tops: pd.DataFrame, first: bool, k: int) -> DataFrame:
    """The routing objects that a query visits: the nearest one, or all others that may hold a better score."""
    context = queries.sparkSession.sparkContext
    shared = context.broadcast((routes, {w: t.set_index("route") for w, t in tops.groupby("width")}))
    schema = "query_id long, vector array<long>, least long, width int, route int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = shared.value
        for batch in batches:
            vectors, rows_out, routes_out, widths = batch.column("vector"), [], [], []
            least = batch.column("least").to_numpy(zero_copy_only=False).astype(float)
            for width, rows in by_width(vectors):
                if width not in held:
                    continue
                table = held[width]
                points = known.of(width)[table.index]
                integers = matrix(vectors.take(pa.array(rows)), width, np.int64)
                lifted = np.column_stack([integers.astype(float), np.zeros(len(rows))])
                far = np.sqrt(np.maximum(
                    (lifted**2).sum(axis=1)[:, None] + (points**2).sum(axis=1) - 2 * lifted @ points.T, 0))
                lowest = np.maximum(far - table["radius"].to_numpy(), 0)
                nearest = far.argmin(axis=1)
                if first:
                    chosen = np.zeros(far.shape, bool)
                else:
                    whole = (integers**2).sum(axis=1) + known.norm
                    reach = np.sqrt(np.maximum(whole - 2 * np.nan_to_num(least[rows]), 0)) + 1e-3
                    reach = np.where(np.isnan(least[rows]), np.inf, reach)
                    chosen = lowest <= reach[:, None]
                chosen[np.arange(len(rows)), nearest] = first
                at, which = np.nonzero(chosen)
                rows_out.append(rows[at])
                routes_out.append(table.index.to_numpy()[which])
                widths.append(np.full(len(at), width))
            if not rows_out:
                continue
            taken = batch.take(pa.array(np.concatenate(rows_out)))
            yield pa.RecordBatch.from_arrays([
                taken.column("query_id"), taken.column("vector"), taken.column("least"),
                pa.array(np.concatenate(widths), pa.int32()), pa.array(np.concatenate(routes_out), pa.int32()),
            ], names=["query_id", "vector", "least", "width", "route"])

    return queries.select("query_id", "vector", "least").mapInArrow(run, schema)


def _searched(visits: DataFrame, entries: DataFrame, tops: DataFrame, norm: float, k: int) -> DataFrame:
    """The best k of each visited page, per query."""
    visits = cut_lineage(visits, "visits")
    blocks = visits.groupBy("width", "route").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks"))
    blocks = blocks.join(tops.select("width", "route", "pages"), ["width", "route"])
    # One row per routing object: ROUTES rows, and one per length of vector that the sample lacks.
    visits = visits.join(blocks, ["width", "route"]).withColumns({
        "block": F.pmod(F.xxhash64("query_id"), "blocks").cast("int"),
        "page": F.explode(F.sequence(F.lit(0), F.col("pages") - 1)),
    }).drop("blocks", "pages")
    entries = entries.join(blocks, ["width", "route"]).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks", "pages")

    def run(asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, int]] = []
        if len(asking) and len(held):
            # Doubles are exact as long as all inner products are whole numbers below 2^53.
            kind = np.float64 if norm < 2**52 else np.int64
            vectors = np.stack(held["vector"].to_list()).astype(kind)
            points = _lifted(vectors, norm)
            root = build(points, np.arange(len(points)), points[0])
            page = Page(root, vectors, [np.asarray(x) for x in held["ids"]], norm)
            for name, vector, least in zip(asking["query_id"], asking["vector"], asking["least"]):
                least = None if pd.isna(least) else int(least)
                query = np.asarray(vector, kind)
                found += [(name, other, score) for score, other in page.search(query, name, k, least)]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"], dtype="int64")

    keys = ["width", "route", "page", "block"]
    return visits.groupBy(*keys).cogroup(entries.groupBy(*keys)).applyInPandas(run, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(
    table: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """The ``k`` rows of ``table`` with the highest integer inner product, for each row of ``queries``.

    Components are floor(``scale`` * x). Returns query_id, rank (from 1), vec_id and score; a query with
    fewer candidates gets all of them. Equal scores rank by vec_id. A row is no candidate for a query of
    the same key. Rows without a key, and vectors that are null, empty or hold null or non-finite
    components, take no part. Rows alike in key and vector are one. Vectors of another length than the
    query's are no candidates. Nor do vectors take part whose whole numbers have a length of 2^31 or more (for a scale of
    256, of about 8 million): only below that is every score sure to be a 64-bit number.
    """

    def clean(rows: DataFrame) -> DataFrame:
        length = F.aggregate(vector, F.lit(0.0), lambda sum_, x: sum_ + F.pow(F.abs(x.cast("double")) * scale + 1, F.lit(2)))
        chosen = rows.where(F.col(key).isNotNull() & usable(F.col(vector))).where(length < float(1 << 62))
        whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
        return chosen.select(F.col(key).cast("long").alias("vec_id"), whole.alias("vector"))

    # Equal vectors are one entry. No query needs more than its k + 1 smallest ids.
    rows = clean(table).distinct()
    first = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)
    entries = few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = cut_lineage(entries.withColumn("width", F.size("vector")), "entries")
    square = F.aggregate("vector", F.lit(0).cast("long"), lambda total, x: total + x * x)
    total, norm = entries.agg(F.count("*"), F.max(square)).first()
    norm = float(norm or 0)
    most = min(ROUTES, -(-total // PER_ROUTE) or 1)
    sample = drawn(entries, F.xxhash64("vector"), most).select("vector").collect()
    points: dict[int, list] = {}
    for row in sample:
        points.setdefault(len(row["vector"]), []).append(row["vector"])
    routes = Routes(norm, {w: _lifted(np.array(v, np.int64).reshape(len(v), w), norm) for w, v in points.items()})
    entries = _routed(entries, routes)
    entries = cut_lineage(entries, "routed")
    tops = entries.groupBy("width", "route").agg(
        F.max("far").alias("radius"), F.ceil(F.count("*") / PAGE).cast("int").alias("pages"))
    tops = cut_lineage(tops, "tops")
    paged = entries.join(tops.select("width", "route", "pages"), ["width", "route"]).withColumn(
        "page", F.pmod(F.xxhash64("vector"), "pages").cast("int")).select("width", "route", "page", "vector", "ids")

    asking = clean(queries).distinct().withColumnRenamed("vec_id", "query_id")
    asking = cut_lineage(asking.withColumn("least", F.lit(None).cast("long")), "queries")
    held = tops.select("width", "route", "radius").toPandas()
    near = cut_lineage(_best(_searched(_visits(asking, routes, held, True, k), paged, tops, norm, k), k), "near")
    least = near.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    asking = asking.drop("least").join(least, "query_id", "left")
    rest = _searched(_visits(asking, routes, held, False, k), paged, tops, norm, k)
    both = near.select("query_id", "vec_id", "score").unionByName(rest)
    return _best(both, k).select("query_id", "rank", "vec_id", "score")
