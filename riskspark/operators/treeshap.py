"""Attribution for boosted trees: path-dependent Shapley values of the log-odds.

A leaf contributes to a row's score only through the features on its path, and what it contributes follows from the
sides that a row would take at the splits of that path. So does the sum over the leaves below a node, from the sides at
the splits above and below the node: it is tabulated by these sides, one bit each, up to MOST_SPLITS of them. The leaves' own
terms are computed once per task from the broadcast trees; those of a subtree are sums of its leaves' tables and are
made tree by tree for a batch of rows, which then only looks up one row of terms per subtree and adds them. A leaf below
more splits is described by the features of its path instead (does the row satisfy the path's condition?). The method is
that of Lundberg et al. (2018), for independent features along a path weighted by training cover.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.operators.boosting import BoostedTrees, together
from riskspark.session import new_path

CHUNK = 512
# Splits whose sides number a row of a table at most, and trees that are deeper are taken leaf by leaf.
MOST_SPLITS = 11
# Rows whose sides are found, and rows whose terms are looked up at once.
SIDED, LOOKED_UP = 1 << 14, 1 << 11
# Up to this many features on a path, the terms of all bit patterns are tabulated (one byte).
TABLE_FEATURES = 8


@dataclass(frozen=True)
class LeafGroup:
    """L leaves whose paths use the same number m of distinct features, one entry per (leaf, feature).

    Bounds are positions among the sorted thresholds of the feature: a row satisfies the
    condition if low < (thresholds below its value) <= high.
    """

    features: np.ndarray  # (L * m,)
    low: np.ndarray       # (L * m, 1)
    high: np.ndarray      # (L * m, 1)
    shares: np.ndarray    # (L, m) cover kept by the splits on the feature
    values: np.ndarray    # (L,) leaf value in log-odds
    used: np.ndarray      # (u,) the distinct features
    table: np.ndarray | None  # (L * 2^m, u) Shapley terms by leaf and bit pattern, unless m is large
    place: np.ndarray     # (features, L * m) 1 where a term belongs to a feature


@dataclass(frozen=True)
class Subtrees:
    """A tree by node number: its splits, and the terms of its leaves by the sides taken on their paths.

    A row goes right if the number of thresholds below its value is above ``place``. Sides are read from the root on,
    a bit each, 1 for right; of the nodes below a split its own comes first, then those of its left, then of its right side.
    """

    feature: list[int]
    place: list[int]
    left: list[int]
    right: list[int]
    depth: list[int]
    below: list[int]      # splits from the node on
    used: np.ndarray      # the distinct features
    leaves: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # terms by pattern, pattern by sides, places among used

    def cut(self, most: int) -> list[int]:
        """The highest nodes with up to ``most`` splits above and below."""
        found, pending = [], [0]
        while pending:
            at = pending.pop()
            if self.depth[at] + self.below[at] <= most:
                found.append(at)
            else:
                pending += self.right[at], self.left[at]
        return found

    def terms(self, at: int) -> np.ndarray:
        """Terms of the leaves from a node on, (sides above, sides below, features used)."""
        if self.feature[at] < 0:
            terms, pattern, places = self.leaves[at]
            out = np.zeros((len(pattern), 1, len(self.used)))
            out[:, 0, places] = terms.take(pattern, axis=0)
            return out
        both = self.terms(self.left[at])[:, :, None] + self.terms(self.right[at])[:, None]
        return both.reshape(1 << self.depth[at], -1, len(self.used))

    def _right(self, at: int, above: np.ndarray) -> np.ndarray:
        return np.greater(above[self.feature[at]], self.place[at]).astype(np.uint16)

    def _sides(self, at: int, above: np.ndarray) -> np.ndarray:
        """The sides of rows at the splits from a node on."""
        code = self._right(at, above)
        for child in (self.left[at], self.right[at]):
            if self.below[child]:
                code <<= np.uint16(self.below[child])
                code |= self._sides(child, above)
        return code

    def sides(self, nodes: list[int], above: np.ndarray) -> list[np.ndarray]:
        """Per node the sides of rows at the splits above and below it, by (features, rows) counts of thresholds."""
        found, wanted = {}, set(nodes)
        pending = [(0, np.zeros(above.shape[1], np.uint16))]
        while pending:
            at, code = pending.pop()
            if at not in wanted:
                code = code << np.uint16(1) | self._right(at, above)
                pending += (self.left[at], code), (self.right[at], code)
            elif self.below[at]:
                found[at] = code << np.uint16(self.below[at]) | self._sides(at, above)
            else:
                found[at] = code
        return [found[at] for at in nodes]

    def add(self, out: np.ndarray, above: np.ndarray, most: int) -> None:
        """Add the tree's terms to (features, rows)."""
        nodes = self.cut(max(most, max(self.depth)))
        tables = [self.terms(at).reshape(-1, len(self.used)) for at in nodes]
        looked_up = np.empty((LOOKED_UP, len(self.used)))
        for start in range(0, above.shape[1], SIDED):
            sides = self.sides(nodes, np.ascontiguousarray(above[:, start:start + SIDED]))
            for first in range(0, len(sides[0]), LOOKED_UP):
                n = min(LOOKED_UP, len(sides[0]) - first)
                total = np.zeros((n, len(self.used)))
                for table, code in zip(tables, sides):
                    total += table.take(code[first:first + n].astype(np.intp), axis=0, out=looked_up[:n], mode="clip")
                for j, f in enumerate(self.used):
                    out[f, start + first:start + first + n] += total[:, j]


@dataclass(frozen=True)
class TreeTables:
    thresholds: list[np.ndarray]
    trees: list[Subtrees]
    groups: list[LeafGroup]


def read_trees(spark: SparkSession, model: GBTClassificationModel | BoostedTrees) -> list[list[dict]]:
    """The node tables of the model, a library's as it is saved. Their size is bounded by trees x 2^(depth+1)."""
    if isinstance(model, BoostedTrees):
        return model.node_tables()
    path = new_path(spark, "trees")
    model.write().overwrite().save(path)
    node = F.col("nodeData")
    rows = spark.read.parquet(f"{path}/data").select(
        "treeID",
        node["id"].alias("id"),
        node["prediction"].alias("value"),
        node["impurityStats"][0].alias("cover"),
        node["leftChild"].alias("left"),
        node["rightChild"].alias("right"),
        node["split"]["featureIndex"].alias("feature"),
        F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
        node["split"]["numCategories"].alias("categories"),
    )
    trees: list[list[dict]] = [[] for _ in model.treeWeights]
    for r in rows.orderBy("treeID", "id").collect():
        if r["left"] >= 0 and r["categories"] >= 0:
            raise ValueError("Splits on declared categories are not supported; features are numbers.")
        trees[r["treeID"]].append(r.asDict())
    return trees


def _leaves(nodes: list[dict]) -> Iterator[tuple[float, dict[int, tuple[float, float, float]]]]:
    """Per leaf: its value and, per feature on the path, (low, high, share of cover kept)."""
    pending = [(0, {})]
    while pending:
        at, path = pending.pop()
        node = nodes[at]
        if node["left"] < 0:
            yield node["value"], path
            continue
        f, t = node["feature"], node["threshold"]
        low, high, share = path.get(f, (-math.inf, math.inf, 1.0))
        for child, bounds in ((node["left"], (low, min(high, t))), (node["right"], (max(low, t), high))):
            kept = nodes[child]["cover"] / node["cover"] if node["cover"] else 0.0
            pending.append((child, {**path, f: (*bounds, share * kept)}))


def _terms(shares: np.ndarray, bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Shapley terms of leaves: shares and bits end in the m features of the path."""
    m = shares.shape[-1]
    weights = np.array([math.factorial(s) * math.factorial(m - 1 - s) for s in range(m)]) / math.factorial(m)
    shape = np.broadcast_shapes(shares.shape, bits.shape)
    out = np.empty(shape)
    for j in range(m):
        # Coefficients, by subset size, of the product over the other features of (share + bit * t).
        poly = np.zeros(shape)
        poly[..., 0] = 1.0
        for k in range(m):
            if k != j:
                grown = poly * shares[..., k, None]
                grown[..., 1:] += poly[..., :-1] * bits[..., k, None]
                poly = grown
        out[..., j] = (poly @ weights) * (bits[..., j] - shares[..., j])
    return out * values[..., None]


def _subtrees(nodes: list[dict], weight: float, thresholds: list[np.ndarray]) -> Subtrees:
    """``nodes`` as tables by sides, for a tree of at most MOST_SPLITS levels."""
    size = len(nodes)
    feature = [n["feature"] if n["left"] >= 0 else -1 for n in nodes]
    place = [int(np.searchsorted(thresholds[n["feature"]], n["threshold"])) if n["left"] >= 0 else 0 for n in nodes]
    used = np.array(sorted({f for f in feature if f >= 0}), np.intp)
    depth, below, order, by_size = [0] * size, [0] * size, [], {}
    # A path's features in their order with the cover kept, and which of their conditions hold by the sides above.
    pending = [(0, {}, np.zeros(1, np.int32))]
    while pending:
        at, path, held = pending.pop()
        order.append(at)
        node = nodes[at]
        if feature[at] < 0:
            if path:
                by_size.setdefault(len(path), []).append((at, path, held))
            continue
        f = feature[at]
        bit = 1 << (list(path).index(f) if f in path else len(path))
        for child, side in ((node["left"], 0), (node["right"], 1)):
            kept = nodes[child]["cover"] / node["cover"] if node["cover"] else 0.0
            both = np.repeat(held if f in path else held | bit, 2)
            both[1 - side::2] &= ~bit
            depth[child] = depth[at] + 1
            pending.append((child, {**path, f: path.get(f, 1.0) * kept}, both))
    for at in reversed(order):
        if feature[at] >= 0:
            below[at] = 1 + below[nodes[at]["left"]] + below[nodes[at]["right"]]
    leaves = {}
    for m, some in by_size.items():
        shares = np.array([list(path.values()) for _, path, _ in some])
        # Twice the margin is the log-odds.
        values = 2 * weight * np.array([nodes[at]["value"] for at, _, _ in some])
        patterns = ((np.arange(2**m)[:, None] >> np.arange(m)) & 1).astype(float)
        for (at, path, held), terms in zip(some, _terms(shares[:, None, :], patterns[None], values[:, None])):
            leaves[at] = terms, held, np.searchsorted(used, list(path))
    return Subtrees(feature, place, [n["left"] for n in nodes], [n["right"] for n in nodes], depth, below, used, leaves)


def _depth(nodes: list[dict]) -> int:
    deep, level = 0, [0]
    while level := [c for at in level if nodes[at]["left"] >= 0 for c in (nodes[at]["left"], nodes[at]["right"])]:
        deep += 1
    return deep


def tree_tables(trees: Sequence[list[dict]], weights: Sequence[float], features: int) -> TreeTables:
    found: list[set] = [set() for _ in range(features)]
    for nodes in trees:
        for node in nodes:
            if node["left"] >= 0:
                found[node["feature"]].add(node["threshold"])
    thresholds = [np.array(sorted(t), dtype=float) for t in found]

    def position(feature: int, bound: float) -> int:
        if math.isinf(bound):
            return -1 if bound < 0 else len(thresholds[feature])
        return int(np.searchsorted(thresholds[feature], bound))

    by_sides, groups = [], []
    for nodes, weight in zip(trees, weights):
        deep = _depth(nodes)
        if deep <= MOST_SPLITS:
            if deep:
                by_sides.append(_subtrees(nodes, weight, thresholds))
            continue
        by_size: dict[int, list] = {}
        for value, path in _leaves(nodes):
            if path:
                by_size.setdefault(len(path), []).append((value, sorted(path.items())))
        for m, leaves in by_size.items():
            entries = [(f, *bounds) for _, path in leaves for f, bounds in path]
            index = np.array([f for f, *_ in entries])
            shares = np.array([share for *_, share in entries]).reshape(-1, m)
            # Twice the margin is the log-odds.
            values = 2 * weight * np.array([v for v, _ in leaves])
            table, used = None, np.unique(index)
            if m <= TABLE_FEATURES:
                patterns = ((np.arange(2**m)[:, None] >> np.arange(m)) & 1).astype(float)
                terms = _terms(shares[:, None, :], patterns[None], values[:, None])
                table = np.zeros((len(leaves), 2**m, len(used)))
                at = np.searchsorted(used, index).reshape(-1, 1, m)
                np.put_along_axis(table, np.broadcast_to(at, terms.shape), terms, axis=2)
                table = table.reshape(-1, len(used))
            place = np.zeros((features, index.size))
            place[index, np.arange(index.size)] = 1.0
            groups.append(LeafGroup(
                index,
                np.array([[position(f, low)] for f, low, _, _ in entries], dtype=np.int32),
                np.array([[position(f, high)] for f, _, high, _ in entries], dtype=np.int32),
                shares, values, used, table, place,
            ))
    return TreeTables(thresholds, by_sides, groups)


def base_value(trees: Sequence[list[dict]], weights: Sequence[float]) -> float:
    """Expected log-odds under the training cover."""
    return sum(
        2 * w * value * math.prod(share for _, _, share in path.values())
        for nodes, w in zip(trees, weights)
        for value, path in _leaves(nodes)
    )


def shapley(x: np.ndarray, tables: TreeTables) -> np.ndarray:
    """Contributions (rows, features) for rows x of feature values."""
    phi = np.zeros((x.shape[1], len(x)))
    # How many thresholds of its feature a value is above; splits compare with these counts.
    kind = np.int8 if max(map(len, tables.thresholds), default=0) < 127 else np.int32
    above = np.array(
        [np.searchsorted(t, x[:, f]) for f, t in enumerate(tables.thresholds)], dtype=kind
    )
    # Tables of more splits are made for more rows.
    most = min(MOST_SPLITS, len(x).bit_length() - 4)
    for tree in tables.trees:
        tree.add(phi, above, most)
    bounds = [(g.low.astype(kind), g.high.astype(kind)) for g in tables.groups]
    for start in range(0, len(x) if tables.groups else 0, CHUNK):
        part = np.ascontiguousarray(above[:, start:start + CHUNK])
        out = phi[:, start:start + CHUNK]
        rows = part.shape[1]
        for g, (low, high) in zip(tables.groups, bounds):
            leaves, m = g.shares.shape
            picked = part[g.features]
            inside = ((picked > low) & (picked <= high)).reshape(leaves, m, rows)
            if g.table is None:
                bits = inside.transpose(2, 0, 1).astype(float)
                terms = _terms(g.shares, bits, g.values).transpose(1, 2, 0)
                out += g.place @ terms.reshape(leaves * m, rows)
            else:
                code = inside[:, 0].astype(np.uint8)
                for j in range(1, m):
                    code |= inside[:, j].view(np.uint8) << np.uint8(j)
                at = (np.arange(leaves) << m)[:, None] + code
                out[g.used] += g.table.take(at, axis=0).sum(axis=0).T
    return phi.T


def tree_attribution(
    df: DataFrame,
    model: GBTClassificationModel | BoostedTrees,
    features: Sequence[str],
    keep: Sequence[str] = (),
    partitions: int | None = None,
) -> DataFrame:
    """``keep``, ``base_value`` and ``factors``; base plus contributions is the row's log-odds.

    Feature values must be numbers, as they are after ``transform``. The work per row is some hundredths of a
    millisecond for a full-size model, so the rows are dealt evenly over ``partitions`` tasks, by default
    four for each core.
    """
    spark = df.sparkSession
    weights = list(model.treeWeights)
    trees = read_trees(spark, model)
    shared = spark.sparkContext.broadcast((trees, weights, len(features)))

    @F.arrow_udf("array<double>")
    def contributions(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        tables = tree_tables(*shared.value)
        for held in together(batches):
            x = np.concatenate([np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch]) for batch in held])
            if np.isnan(x).any():
                raise ValueError("Attribution needs a number in every feature of every row.")
            phi, start = shapley(x, tables), 0
            for n in (len(batch[0]) for batch in held):
                part = np.ascontiguousarray(phi[start:start + n]).ravel()
                yield pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1]), pa.array(part))
                start += n

    rows = df.select(*dict.fromkeys([*keep, *features]))
    rows = rows.repartition(partitions or 4 * spark.sparkContext.defaultParallelism)
    values = [F.col(f).cast("double") for f in features]
    factors = F.array(*(
        F.struct(F.lit(f).alias("feature"), v.alias("value"), F.get("__phi", F.lit(i)).alias("contribution"))
        for i, (f, v) in enumerate(zip(features, values))))
    return rows.withColumn("__phi", contributions(*values)).select(
        *keep, F.lit(float(base_value(trees, weights))).alias("base_value"), factors.alias("factors")
    )
