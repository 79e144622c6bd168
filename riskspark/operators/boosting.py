"""Gradient-boosted trees of second order, with leaf penalties, and rows and columns sampled per tree.

Features are cut into bins once and rows are packed into blocks, which stay on the executors. A level of a tree is one
pass: each task adds up gradients and curvatures by node, feature and bin, the sums are merged among the executors, and
the driver, which gets numbers per node, feature and bin but never a row, picks the splits. Several models are
grown in the same passes, over other rows or with other settings: a search over a grid makes as many passes as one fit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.session import cut_lineage, shared_folder

#: Bins per feature at most, rows of a block, and rows that cut points are taken from at most (about).
BINS, BLOCK_ROWS, CUT_ROWS = 64, 1 << 15, 1 << 18
#: Rows that a task should have at least, and rows that are dealt to tasks together.
TASK_ROWS, DEALT_ROWS = 8192, 1 << 12
#: Rows that go through the trees of a finished model together.
SCORED_ROWS = 1 << 16
#: How blocks and scores stay on the executors between passes: as they are, not compressed anew for every round.
STORED = StorageLevel.MEMORY_AND_DISK_DESER
#: Rounds after which the scores so far are written to the shared folder.
STORED_EVERY = 20
#: A child must have this much curvature, and a split this much gain.
LEAST_CURVATURE, LEAST_GAIN = 1.0, 1e-6
#: Splits on a path whose sides are a number of one byte.
CODED_DEPTH = 8
#: Stands for a curvature of 0.
TINY = 1e-12
#: Partial sums that meet on the driver or in one merging task at most.
MERGED_AT_ONCE = 64

NODE_SCHEMA = (
    "tree int, id int, feature int, threshold double, left int, right int, value double, cover double, gain double")


@dataclass(frozen=True)
class Tree:
    """Nodes by number, the root being 0. ``feature`` and children are -1 for leaves; ``value`` is in log-odds.

    A row goes left if its value is not above the threshold; a missing value goes left. ``bin`` is the place of
    the threshold among the cut points of the training.
    """

    feature: np.ndarray
    threshold: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray

    @cached_property
    def depth(self) -> int:
        """Splits on the longest path."""
        deep, level = 0, np.zeros(1, np.intp)
        while len(level := level[self.feature[level] >= 0]):
            deep, level = deep + 1, np.concatenate([self.left[level], self.right[level]])
        return deep

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of feature values."""
        rows, width = x.shape
        return self._leaves(np.ascontiguousarray(x).ravel(), np.arange(rows) * width, 1, self.threshold)

    def leaves_of_bins(self, bins: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The leaf of some rows, given by place, of bin numbers (features, rows)."""
        if self.depth > CODED_DEPTH:
            return self._leaves(bins.ravel(), rows, bins.shape[1], np.maximum(self.bin, 0).astype(bins.dtype))
        code, leaves = self._coded(bins)
        return leaves.take(code.take(rows))

    def of_leaves(self, values: np.ndarray, bins: np.ndarray) -> np.ndarray:
        """What each row's leaf has among ``values``, one per node, by its bin numbers (features, rows)."""
        if self.depth > CODED_DEPTH:
            return values.take(self.leaves_of_bins(bins, np.arange(bins.shape[1])))
        code, leaves = self._coded(bins)
        return values.take(leaves).take(code)

    def _coded(self, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's sides on its path as a number, and the leaf of each number."""
        # Each split is one comparison of its feature's bins with those rows that came to it.
        code, level = np.zeros(bins.shape[1], np.uint8), {0: 0}
        right, here, above = (np.empty(len(code), bool) for _ in range(3))
        for _ in range(self.depth):
            right[:], following = False, {}
            for c, node in level.items():
                if self.feature[node] < 0:
                    following[2 * c] = node
                    continue
                following[2 * c], following[2 * c + 1] = int(self.left[node]), int(self.right[node])
                np.greater(bins[self.feature[node]], bins.dtype.type(self.bin[node]), out=above)
                if len(level) > 1:
                    above &= np.equal(code, c, out=here)
                right |= above
            code <<= 1
            code |= right.view(np.uint8)
            level = following
        leaves = np.zeros(1 << self.depth, np.intp)
        leaves[list(level)] = list(level.values())
        return code, leaves

    def _leaves(self, values: np.ndarray, starts: np.ndarray, step: int, limits: np.ndarray) -> np.ndarray:
        """The leaf of each row, whose feature f stands ``f * step`` after its start."""
        inner, own = self.feature >= 0, np.arange(len(self.feature))
        # Nodes are numbered by twos: a node and its right side share their entry's place but for one.
        place = np.repeat(np.where(inner, self.feature, 0).astype(np.intp) * step, 2)
        limit = np.repeat(limits, 2)
        child = 2 * np.where(inner[:, None], np.column_stack([self.left, self.right]), own[:, None]).astype(np.intp).ravel()
        at = np.zeros(len(starts), np.intp)
        for _ in range(self.depth):
            right = values.take(place.take(at) + starts) > limit.take(at)
            at = child.take(at + right)
        return at >> 1


@dataclass(frozen=True)
class BoostedTrees:
    """A fitted model: the log-odds of a row is the sum of its leaves' values."""

    features: tuple[str, ...]
    trees: tuple[Tree, ...]

    @property
    def treeWeights(self) -> list[float]:
        """As attribution takes them, which doubles margins."""
        return [0.5] * len(self.trees)

    def node_tables(self) -> list[list[dict]]:
        return [[dict(id=i, value=float(t.value[i]), cover=float(t.cover[i]), left=int(t.left[i]), right=int(t.right[i]),
                      feature=int(t.feature[i]), threshold=float(t.threshold[i])) for i in range(len(t.feature))]
                for t in self.trees]

    @cached_property
    def importance(self) -> dict[str, float]:
        """Mean gain of the splits on each feature, as shares of 1; 0 for features without a split."""
        total, count = np.zeros(len(self.features)), np.zeros(len(self.features))
        for t in self.trees:
            used = t.feature >= 0
            np.add.at(total, t.feature[used], t.gain[used])
            np.add.at(count, t.feature[used], 1)
        mean = total / np.maximum(count, 1)
        return dict(zip(self.features, (mean / (mean.sum() or 1.0)).tolist()))

    def first(self, rounds: int) -> BoostedTrees:
        """The model as it was after some rounds."""
        return BoostedTrees(self.features, self.trees[:rounds])

    @cached_property
    def _ranked(self) -> tuple[list[np.ndarray], list[Tree]]:
        """The distinct thresholds of each feature, and the trees with places among them for bins."""
        found: list[set] = [set() for _ in self.features]
        for t in self.trees:
            for f, x in zip(t.feature.tolist(), t.threshold.tolist()):
                if f >= 0:
                    found[f].add(x)
        thresholds = [np.array(sorted(x), float) for x in found]
        places = [{x: i for i, x in enumerate(own.tolist())} for own in thresholds]
        return thresholds, [
            replace(t, bin=np.array([places[f][x] if f >= 0 else -1 for f, x in zip(t.feature.tolist(), t.threshold.tolist())], int))
            for t in self.trees]

    def leaf_values(self, columns: Sequence[np.ndarray]) -> Iterator[np.ndarray]:
        """The value of each row's leaf, tree after tree, from the values of its features."""
        thresholds, trees = self._ranked
        # A value is above as many thresholds as are below it; a missing one is above none.
        kind = np.uint8 if max(map(len, thresholds), default=0) < 256 else np.int32
        above = np.empty((len(columns), len(columns[0]) if len(columns) else 0), kind)
        for row, own, x in zip(above, thresholds, columns):
            row[:] = np.where(np.isnan(x), 0, np.searchsorted(own, x))
        for tree in trees:
            yield tree.of_leaves(tree.value, above)

    def log_odds(self) -> Column:
        """The log-odds of a row, from its feature columns."""
        shared = SparkSession.active().sparkContext.broadcast(self)  # trees x 2^depth nodes

        @F.pandas_udf("double")
        def margin(columns: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            model = shared.value
            for held in together(columns):
                out = np.zeros(sum(len(batch[0]) for batch in held))
                for values in model.leaf_values([np.concatenate([c.to_numpy(float) for c in own]) for own in zip(*held)]):
                    out += values
                start = 0
                for n in (len(batch[0]) for batch in held):
                    yield pd.Series(out[start : start + n])
                    start += n

        return margin(*(F.col(f).cast("double") for f in self.features))

    def staged(self) -> Column:
        """The log-odds of a row after each round, an array: running sums of its leaves' values."""
        shared = SparkSession.active().sparkContext.broadcast(self)

        @F.pandas_udf("array<double>")
        def margins(columns: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            model = shared.value
            for batch in columns:
                out = np.zeros((len(batch[0]), len(model.trees)))
                for i, values in enumerate(model.leaf_values([c.to_numpy(float) for c in batch])):
                    out[:, i] = values
                yield pd.Series(list(np.cumsum(out, axis=1)))

        return margins(*(F.col(f).cast("double") for f in self.features))

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the nodes, and the names of the features in their order."""
        rows = [
            (i, n, int(t.feature[n]), float(t.threshold[n]), int(t.left[n]), int(t.right[n]), float(t.value[n]),
             float(t.cover[n]), float(t.gain[n])) for i, t in enumerate(self.trees) for n in range(len(t.feature))]
        spark.createDataFrame(rows, NODE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        names = [(i, f) for i, f in enumerate(self.features)]
        spark.createDataFrame(names, "position int, feature string").coalesce(1).write.mode("overwrite").parquet(f"{path}/features")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedTrees:
        names = spark.read.parquet(f"{path}/features").orderBy("position").collect()
        nodes = spark.read.parquet(f"{path}/nodes").toPandas().sort_values(["tree", "id"])
        trees = [
            Tree(*(t[c].to_numpy() for c in ("feature", "threshold")), np.full(len(t), -1), *(
                t[c].to_numpy() for c in ("left", "right", "value", "cover", "gain"))) for _, t in nodes.groupby("tree")]
        return cls(tuple(r["feature"] for r in names), tuple(trees))


@dataclass(frozen=True)
class Settings:
    """``without_fold``: rows of this fold are scored, not learned from."""

    n_estimators: int = 200
    max_depth: int = 7
    learning_rate: float = 0.05
    subsample: float = 0.8
    colsample: float = 0.8
    reg_alpha: float = 0.1
    reg_lambda: float = 1.0
    without_fold: int | None = None


@dataclass
class _Growing:
    """A tree while its levels are made: what the tasks need to find a row's open node, and the sums of open nodes."""

    columns: np.ndarray
    feature: list[int] = field(default_factory=lambda: [-1])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    bin: list[int] = field(default_factory=lambda: [-1])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    cover: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    open: list[int] = field(default_factory=lambda: [0])

    def tree(self) -> Tree:
        whole = (self.feature, self.bin, self.left, self.right)
        feature, bins, left, right = (np.array(x, np.int32) for x in whole)
        return Tree(feature, np.array(self.threshold), bins, left, right, np.array(self.value), np.array(self.cover), np.array(self.gain))


def together(batches: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Batches of columns, as many at once as have up to SCORED_ROWS rows: a tree costs some time however few they are."""
    held, n = [], 0
    for batch in batches:
        if held and n + len(batch[0]) > SCORED_ROWS:
            yield held
            held, n = [], 0
        held.append(batch)
        n += len(batch[0])
    if held:
        yield held


def cut_points(df: DataFrame, features: Sequence[str], draw: Column, bins: int = BINS) -> list[np.ndarray]:
    """Distinct approximate quantiles of each feature, at most ``bins - 1``; missing values are left out.

    They are those of about CUT_ROWS rows, drawn by the hash ``draw``, or of all if there are fewer: the same rows give
    the same cut points, and no task merges more than that.
    """
    total = df.count()
    if total > CUT_ROWS:
        df = df.where(F.pmod(draw, F.lit(1 << 30)) < F.lit(int((1 << 30) * CUT_ROWS / total)))
    shares = ", ".join(f"{i / bins!r}D" for i in range(1, bins))
    values = df.select(*(F.nanvl(F.col(f).cast("double"), F.lit(None)).alias(f"x{i}") for i, f in enumerate(features)))
    found = values.agg(*(F.expr(f"percentile_approx(x{i}, array({shares}), {100 * bins})") for i in range(len(features)))).first()
    return [np.unique(np.array(q or [], float)) for q in found]


@dataclass(frozen=True)
class Block:
    """Rows of one task: bins (features, rows), label, a draw that follows from the key, and fold."""

    bins: np.ndarray
    label: np.ndarray
    draw: np.ndarray
    fold: np.ndarray


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of a task, BLOCK_ROWS at a time."""
    held, n = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(start, BLOCK_ROWS)
            if n + part.num_rows > BLOCK_ROWS:
                yield pa.Table.from_batches(held)
                held, n = [], 0
            held.append(part)
            n += part.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _packed(df: DataFrame, features: Sequence[str], cuts: list[np.ndarray]) -> DataFrame:
    """Blocks of rows as bytes, stored in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _gathered(batches):
            bins = np.empty((len(cuts), part.num_rows), np.uint8)
            for i, c in enumerate(cuts):
                x = part.column(i).to_numpy().astype(float)
                bins[i] = np.where(np.isnan(x), 0, np.searchsorted(c, x, side="left"))
            rest = [part.column(len(cuts) + i).to_numpy() for i in range(3)]
            kinds = (np.uint8, np.uint64, np.int32)
            data = [bins.tobytes(), *(r.astype(k).tobytes() for r, k in zip(rest, kinds))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part.num_rows], pa.int64()), *(pa.array([d], pa.binary()) for d in data)],
                names=["n", "bins", "label", "draw", "fold"])

    return cut_lineage(
        df.mapInArrow(run, "n long, bins binary, label binary, draw binary, fold binary"), "blocks")


def _blocks(packed: DataFrame, total: int, width: int) -> RDD:
    """The blocks of all rows, in as many tasks as the passes have. Many rows are dealt evenly: a pass waits for the task with most."""

    def unpack(r) -> Block:
        rest = (np.frombuffer(r[c], k) for c, k in (("label", np.uint8), ("draw", np.uint64), ("fold", np.int32)))
        return Block(np.frombuffer(r["bins"], np.uint8).reshape(width, -1), *rest)

    tasks, cores = packed.rdd.getNumPartitions(), packed.sparkSession.sparkContext.defaultParallelism
    if total <= cores * BLOCK_ROWS:
        return packed.coalesce(max(1, min(tasks, -(-total // TASK_ROWS)))).rdd.map(unpack)

    def cut(block: Block) -> Iterator[Block]:
        # Of equal size: a short last part of every block could always come to the same task.
        edges = np.linspace(0, len(block.label), -(-len(block.label) // DEALT_ROWS) + 1).astype(int).tolist()
        for rows in map(slice, edges, edges[1:]):
            yield Block(np.ascontiguousarray(block.bins[:, rows]), block.label[rows], block.draw[rows], block.fold[rows])

    def joined(parts: Iterator[Block]) -> Iterator[Block]:
        held, n = [], 0
        for part in parts:
            if n + len(part.label) > BLOCK_ROWS:
                yield _joined(held)
                held, n = [], 0
            held.append(part)
            n += len(part.label)
        if held:
            yield _joined(held)

    # A task that is sent its rows can take about a gigabyte of them.
    tasks = cores * -(-total // (cores << 22))
    parts = packed.rdd.map(unpack).flatMap(cut).zipWithIndex().map(lambda pair: (pair[1], pair[0]))
    return parts.partitionBy(tasks, lambda i: i % tasks).values().mapPartitions(joined)


def _joined(parts: list[Block]) -> Block:
    return Block(*(np.concatenate([getattr(p, c) for p in parts], axis=-1) for c in ("bins", "label", "draw", "fold")))


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _drawn(block: Block, share: float, round_: int, seed: int) -> np.ndarray:
    """Rows drawn for a round, by a hash of the row's key: the same rows whatever block they are in."""
    if share >= 1:
        return np.ones(len(block.label), bool)
    salt = _mix(np.array([(seed << 20) + round_ + 1], np.uint64))
    return (_mix(block.draw ^ salt) >> np.uint64(11)) < np.uint64(int(share * (1 << 53)))


@dataclass(frozen=True)
class _Level:
    """What the tasks need for a level of a model's tree."""

    model: int
    settings: Settings
    tree: Tree
    open: list[int]
    columns: np.ndarray

    def zeros(self, bins: int) -> np.ndarray:
        """Sums by column, open node and bin: gradient and curvature are one number of two parts, added up together."""
        return np.zeros((len(self.columns), len(self.open) * bins), complex)

    def _bins_used(self, cuts: list[np.ndarray], bins: int) -> np.ndarray:
        return np.concatenate([i * bins + np.arange(len(cuts[c]) + 1) for i, c in enumerate(self.columns)])

    def used(self, sums: np.ndarray, cuts: list[np.ndarray], bins: int) -> np.ndarray:
        """The sums by node and the bins that its columns have: the others are 0 and stay behind."""
        by_node = sums.reshape(len(self.columns), len(self.open), bins).transpose(1, 0, 2).reshape(len(self.open), -1)
        return by_node[:, self._bins_used(cuts, bins)]

    def whole(self, used: np.ndarray, cuts: list[np.ndarray], bins: int) -> np.ndarray:
        """(gradient or curvature, nodes, columns, bins) of the sums used."""
        out = np.zeros((2, len(self.open), len(self.columns) * bins))
        out[:, :, self._bins_used(cuts, bins)] = used.real, used.imag
        return out.reshape(2, len(self.open), len(self.columns), bins)


def _add_sums(
    totals: list[np.ndarray], block: Block, margins: np.ndarray, levels: list[_Level], round_: int, seed: int, bins: int,
    positive: float,
) -> None:
    """Add gradients and curvatures per model, (columns, open nodes x bins)."""
    drawn = {share: _drawn(block, share, round_, seed) for share in {level.settings.subsample for level in levels}}
    learned: dict[tuple[float, int | None], tuple] = {}
    for total, level in zip(totals, levels):
        share, fold = level.settings.subsample, level.settings.without_fold
        if (share, fold) not in learned:  # models of one fold learn from the same rows
            rows = np.flatnonzero(drawn[share] if fold is None else drawn[share] & (block.fold != fold))
            label = block.label.take(rows)
            learned[share, fold] = rows, block.bins.take(rows, axis=1), label, np.where(label == 1, positive, 1.0)
        rows, own, label, weight = learned[share, fold]
        # Rows of nodes that are not open any more count at a place of their own, unless they are many.
        end = len(level.open)
        places = np.full(len(level.tree.feature), end, np.intp)
        places[level.open] = np.arange(end)
        first = level.tree.of_leaves(places * bins, own)
        inside = first < end * bins
        if 4 * np.count_nonzero(inside) < 3 * len(rows):
            inside = np.flatnonzero(inside)
            rows, label, weight, first = (a.take(inside) for a in (rows, label, weight, first))
            own = own.take(inside, axis=1)
        p = 1 / (1 + np.exp(-margins[level.model].take(rows)))
        both, index = np.empty(len(rows), complex), np.empty(len(rows), np.intp)
        both.real, both.imag = weight * (p - label), weight * p * (1 - p)
        part = np.zeros((len(level.columns), (end + 1) * bins), complex)
        for sums, column in zip(part, level.columns):
            np.add.at(sums, np.add(first, own[column], out=index), both)
        total += part[:, : end * bins]


def _added(left: list, right: list) -> list:
    return [a + b for a, b in zip(left, right)]


def _total(rdd: RDD, zeros, add, sent=lambda total: total) -> list:
    """Sums of a list of arrays over all blocks; partial sums are merged among the executors if they are many.

    A task starts from ``zeros()``, to which ``add`` adds a block's in place; ``sent`` is what it passes on.
    """

    def per_task(blocks):
        total = None
        for block, margins in blocks:
            total = zeros() if total is None else total
            add(total, block, margins)
        return [] if total is None else [sent(total)]

    parts = rdd.mapPartitions(per_task)
    n = rdd.getNumPartitions()
    if n <= MERGED_AT_ONCE:
        return parts.reduce(_added)
    return parts.treeReduce(_added, depth=max(2, math.ceil(math.log(n) / math.log(MERGED_AT_ONCE // 4))))


def soft(g, alpha: float):
    """The gradient sum after the absolute penalty."""
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def leaf_value(g, h, s: Settings):
    """The weight of a leaf with these sums that makes the penalised loss smallest, before the learning rate."""
    return -soft(g, s.reg_alpha) / np.maximum(h + s.reg_lambda, TINY)


def _score(g, h, s: Settings):
    return soft(g, s.reg_alpha) ** 2 / np.maximum(h + s.reg_lambda, TINY)


def _split(tree: _Growing, sums: np.ndarray, s: Settings, cuts: list[np.ndarray], last: bool) -> None:
    """Split the open nodes where that gains, give values to all, and open the children."""
    g, h = sums
    below_g, below_h = np.cumsum(g, axis=2), np.cumsum(h, axis=2)
    all_g, all_h = below_g[:, :1, -1:], below_h[:, :1, -1:]
    gain = _score(below_g, below_h, s) + _score(all_g - below_g, all_h - below_h, s) - _score(all_g, all_h, s)
    gain = np.where((below_h >= LEAST_CURVATURE) & (all_h - below_h >= LEAST_CURVATURE), gain / 2, -np.inf)
    for i, column in enumerate(tree.columns):
        gain[:, i, len(cuts[column]):] = -np.inf  # beyond the last cut point nothing is to the right
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(axis=1)
    opened = []
    for place, at in enumerate(tree.open):
        if tree.cover[at] == 0.0:  # the root: children get theirs when they are made
            tree.cover[at] = float(all_h[place, 0, 0])
            tree.value[at] = s.learning_rate * float(leaf_value(all_g[place, 0, 0], all_h[place, 0, 0], s))
        if not flat[place, best[place]] > LEAST_GAIN:
            continue
        i, b = divmod(int(best[place]), gain.shape[2])
        column = int(tree.columns[i])
        gl, hl = float(below_g[place, i, b]), float(below_h[place, i, b])
        sides = ((gl, hl), (float(all_g[place, 0, 0]) - gl, float(all_h[place, 0, 0]) - hl))
        tree.feature[at], tree.bin[at], tree.threshold[at] = column, b, float(cuts[column][b])
        tree.gain[at] = float(flat[place, best[place]])
        tree.left[at], tree.right[at] = len(tree.feature), len(tree.feature) + 1
        for side_g, side_h in sides:
            opened.append(len(tree.feature))
            for values, value in (
                (tree.feature, -1), (tree.threshold, 0.0), (tree.bin, -1), (tree.left, -1), (tree.right, -1),
                (tree.value, s.learning_rate * float(leaf_value(side_g, side_h, s))), (tree.cover, side_h), (tree.gain, 0.0),
            ):
                values.append(value)
    tree.open = [] if last else opened


def _add_counts(total: list[np.ndarray], block: Block, margins: np.ndarray, models: Sequence[Settings]) -> None:
    """Add true positives, false positives and false negatives of each model on the fold that it has not seen."""
    for i, s in enumerate(models):
        own = block.fold == s.without_fold
        yes, said = block.label[own] == 1, margins[i, own] >= 0
        total[0][i] += (yes & said).sum(), (~yes & said).sum(), (yes & ~said).sum()


def fit_together(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    models: Sequence[Settings],
    key: str | None = None,
    weight: float = 1.0,
    fold: str | None = None,
    cuts: list[np.ndarray] | None = None,
    seed: int = 42,
    f1_after: Sequence[int] = (),
) -> tuple[list[BoostedTrees], dict[int, list[float]]]:
    """Fit several models in the same passes over the rows.

    Positives weigh ``weight``. Rows are drawn by a hash of ``key`` (all features if there is none), columns by the seed.
    Rows without a label are left out; missing values go left at every split. ``f1_after`` names rounds after which
    each model's F1 on its ``without_fold`` is counted. A table without rows gives models without trees.
    """
    spark = train.sparkSession
    drawn = F.xxhash64(key) if key else F.xxhash64(*features)
    if cuts is None:
        cuts = cut_points(train.where(F.col(label).isNotNull()), features, drawn)
    bins = max([len(c) for c in cuts], default=0) + 1
    rows = train.where(F.col(label).isNotNull()).select(
        *(F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))).alias(f"x{i}") for i, f in enumerate(features)),
        F.col(label).cast("int").alias("y"), drawn.alias("draw"), (F.col(fold).cast("int") if fold else F.lit(-1)).alias("fold"))
    packed = _packed(rows, features, cuts)
    total = packed.agg(F.sum("n")).first()[0] or 0
    if not total:
        return [BoostedTrees(tuple(features), ()) for _ in models], {n: [0.0] * len(models) for n in f1_after}
    width, count = len(features), len(models)

    state = _blocks(packed, total, width).map(lambda block: (block, np.zeros((count, len(block.label))))).persist(STORED)
    shared_folder(spark)  # where checkpoints go
    chosen = np.random.default_rng(seed)
    grown: list[list[Tree]] = [[] for _ in models]
    f1: dict[int, list[float]] = {}
    older: list[RDD] = []
    for round_ in range(max(s.n_estimators for s in models)):
        order = chosen.permutation(width)
        growing = [
            (i, s, _Growing(np.sort(order[: max(1, int(s.colsample * width))])))
            for i, s in enumerate(models) if round_ < s.n_estimators]
        for level in range(max(s.max_depth for _, s, _ in growing)):
            active = [(i, s, t) for i, s, t in growing if t.open and level < s.max_depth]
            if not active:
                break
            # Called at once: what the tasks are sent is the trees as they are now.
            levels = [_Level(i, s, t.tree(), t.open, t.columns) for i, s, t in active]
            sums = _total(
                state, lambda: [own.zeros(bins) for own in levels],
                lambda total, block, margins: _add_sums(
                    total, block, margins, levels, round_, seed, bins, float(weight)),
                lambda total: [own.used(sums, cuts, bins) for own, sums in zip(levels, total)])
            while older:
                older.pop().unpersist()
            for (_, s, tree), own, used in zip(active, levels, sums):
                _split(tree, own.whole(used, cuts, bins), s, cuts, level + 1 == s.max_depth)
        done = [(i, t.tree()) for i, _, t in growing]
        for i, tree in done:
            grown[i].append(tree)
        # Scores are added up in the first pass of the next round.
        older.append(state)
        state = _advanced(state, done)
        if (round_ + 1) % STORED_EVERY == 0:
            state.checkpoint()
        if round_ + 1 in f1_after:
            tp, fp, fn = _total(
                state, lambda: [np.zeros((count, 3))],
                lambda total, block, margins: _add_counts(total, block, margins, models))[0].T
            f1[round_ + 1] = (2 * tp / np.maximum(2 * tp + fp + fn, 1)).tolist()
    for rdd in (*older, state):
        rdd.unpersist()
    return [BoostedTrees(tuple(features), tuple(t)) for t in grown], f1


def _advanced(state: RDD, done: list[tuple[int, Tree]]) -> RDD:
    """Scores after a round."""

    def add(pair):
        block, margins = pair
        margins = margins.copy()
        for i, tree in done:
            margins[i] += tree.of_leaves(tree.value, block.bins)
        return block, margins

    return state.map(add).persist(STORED)
