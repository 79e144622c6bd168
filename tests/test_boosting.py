"""Boosted trees against the same sums made row by row, and models that are grown together against single ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.operators import boosting, models
from riskspark.operators.boosting import Settings, fit_together
from riskspark.operators.metrics import evaluate
from riskspark.operators.split import stratified_folds
from riskspark.session import new_path

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(7)
    x = draw.normal(size=(3000, 4)).round(2)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + draw.normal(size=3000) > 0.4).astype(int)
    data = [(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "id long, a double, b double, c double, d double, y int").repartition(4).cache()


def arrays(rows):
    data = rows.toPandas().sort_values("id")
    return data[FEATURES].to_numpy(), data["y"].to_numpy()


def leaf_sums(tree, x, y, margin, weight):
    p = 1 / (1 + np.exp(-margin))
    w = np.where(y == 1, weight, 1.0)
    at = tree.leaves_of(x)
    g, h = np.bincount(at, w * (p - y), len(tree.feature)), np.bincount(at, w * p * (1 - p), len(tree.feature))
    return at, g, h


def test_leaves_have_the_closed_form_weights(rows):
    s = Settings(3, 4, 0.3, 1.0, 0.5, 0.7, 2.0)
    (model,), _ = fit_together(rows, FEATURES, "y", [s], "id", 1.7)
    x, y = arrays(rows)
    margin = np.zeros(len(y))
    for tree in model.trees:
        at, g, h = leaf_sums(tree, x, y, margin, 1.7)
        leaves = np.flatnonzero(tree.feature < 0)
        assert len(leaves) > 4
        soft = np.sign(g) * np.maximum(np.abs(g) - 0.7, 0)
        assert np.allclose(tree.value[leaves], (-0.3 * soft / (h + 2.0))[leaves], atol=1e-9)
        assert np.allclose(tree.cover[leaves], h[leaves])
        assert len(set(tree.feature[tree.feature >= 0])) <= 2  # half of the columns
        margin += tree.value[at]


def test_first_split_is_the_best_of_all(rows):
    cuts = [np.linspace(-2, 2, 9) for _ in FEATURES]
    s = Settings(1, 1, 1.0, 1.0, 1.0, 0.1, 1.0)
    (model,), _ = fit_together(rows, FEATURES, "y", [s], "id", cuts=cuts)
    x, y = arrays(rows)
    g = 0.5 - y

    def score(part):
        return max(abs(g[part].sum()) - 0.1, 0) ** 2 / (part.sum() / 4 + 1)

    gains = {(f, c): (score(x[:, f] <= c) + score(x[:, f] > c) - score(y >= 0)) / 2 for f in range(4) for c in cuts[f]}
    (f, c), gain = max(gains.items(), key=lambda item: item[1])
    tree = model.trees[0]
    assert (tree.feature[0], tree.threshold[0]) == (f, c) and tree.gain[0] == pytest.approx(gain)


def test_penalties_shrink_leaves(rows):
    runs = [Settings(1, 3, 1.0, 1.0, 1.0, a, b) for a, b in ((0, 0), (0, 200), (1e6, 1))]
    free, held, none = fit_together(rows, FEATURES, "y", runs, "id")[0]
    assert np.abs(held.trees[0].value).max() < np.abs(free.trees[0].value).max()
    assert not none.trees[0].value.any() and len(none.trees[0].feature) == 1


def test_models_grown_together_are_those_grown_alone(rows):
    folded = stratified_folds(rows, "id", "y", 3)
    runs = [Settings(4, d, r, 0.8, 0.8, without_fold=k) for d, r, k in ((2, 0.3, 0), (3, 0.1, 2), (3, 0.1, 0))]
    together, f1 = fit_together(folded, FEATURES, "y", runs, "id", 2.0, "fold", f1_after=(2, 4))
    for i, s in enumerate(runs):
        (alone,), _ = fit_together(folded, FEATURES, "y", [s], "id", 2.0, "fold")
        for one, other in zip(together[i].trees, alone.trees):
            assert np.array_equal(one.feature, other.feature) and np.allclose(one.value, other.value)
        unseen = folded.where(F.col("fold") == s.without_fold)
        for rounds in (2, 4):
            scored = models.predict(unseen, alone.first(rounds), FEATURES, ["y"])
            n = scored.agg(*(F.count_if(c).alias(k) for k, c in (
                ("tp", (F.col("y") == 1) & (F.col("prediction") == 1)), ("wrong", F.col("y") != F.col("prediction"))))).first()
            assert f1[rounds][i] == pytest.approx(2 * n["tp"] / (2 * n["tp"] + n["wrong"]))


def test_rows_do_not_depend_on_partitions(rows):
    s = [Settings(3, 3)]
    one, other = (fit_together(rows.repartition(n), FEATURES, "y", s, "id", cuts=[np.linspace(-2, 2, 20)] * 4)[0][0] for n in (1, 7))
    for a, b in zip(one.trees, other.trees):
        assert np.array_equal(a.feature, b.feature) and np.allclose(a.value, b.value)


def test_partial_sums_are_merged_in_steps(rows, monkeypatch):
    s = [Settings(2, 2, 0.3, 1.0, 1.0)]
    cuts = [np.linspace(-2, 2, 20)] * 4
    plain = fit_together(rows, FEATURES, "y", s, "id", cuts=cuts)[0][0]
    monkeypatch.setattr(boosting, "MERGED_AT_ONCE", 8)
    monkeypatch.setattr(boosting, "TASK_ROWS", 1)
    merged = fit_together(rows.repartition(9), FEATURES, "y", s, "id", cuts=cuts)[0][0]
    assert all(np.allclose(a.value, b.value) for a, b in zip(plain.trees, merged.trees))


def test_scores_are_stored_on_the_way(rows, monkeypatch):
    monkeypatch.setattr(boosting, "STORED_EVERY", 2)
    (model,), _ = fit_together(rows, FEATURES, "y", [Settings(5, 2)], "id")
    monkeypatch.setattr(boosting, "STORED_EVERY", 100)
    (other,), _ = fit_together(rows, FEATURES, "y", [Settings(5, 2)], "id")
    assert all(np.array_equal(a.value, b.value) for a, b in zip(model.trees, other.trees))


def test_validation_curve_ends_with_the_model(rows):
    (model,), _ = fit_together(rows, FEATURES, "y", [Settings(6, 3, 0.3)], "id")
    curve = {r["round"]: r for r in models.validation_curve(rows, model, "y").collect()}
    assert sorted(curve) == [1, 2, 3, 4, 5, 6]
    for rounds in (1, 3, 6):
        scored = models.predict(rows, model.first(rounds), FEATURES, ["y"]).withColumn("all", F.lit(1))
        own = evaluate(scored, "y", "p1", ["all"]).first()
        assert curve[rounds]["f1"] == pytest.approx(own["f1"]) and curve[rounds]["roc_auc"] == pytest.approx(own["roc_auc"])
    assert [r["round"] for r in models.validation_curve(rows, model, "y", rounds=[2]).collect()] == [2]


def test_odd_rows(spark, rows):
    empty = rows.limit(0)
    (model,), f1 = fit_together(empty, FEATURES, "y", [Settings(2, 2)], "id", f1_after=(2,))
    assert model.trees == () and f1 == {2: [0.0]}
    assert models.predict(rows, model, FEATURES, ["id"]).where("p1 <> 0.5").count() == 0
    assert models.validation_curve(rows, model, "y").count() == 0
    holes = rows.withColumns({"a": F.when(F.col("id") % 3 > 0, F.col("a")), "d": F.lit(None).cast("double"),
                              "y": F.when(F.col("id") % 7 > 0, F.col("y"))})
    (model,), _ = fit_together(holes, FEATURES, "y", [Settings(3, 3, 0.3)], "id")
    assert "d" not in {FEATURES[f] for t in model.trees for f in t.feature if f >= 0}
    assert models.predict(holes, model, FEATURES, ["id"]).where("p1 is null").count() == 0
    (one,), _ = fit_together(rows.where("y = 1"), FEATURES, "y", [Settings(2, 2)], "id")
    assert models.predict(rows, one, FEATURES, ["id"]).where("p1 <= 0.5").count() == 0


def test_saved_model(spark, rows):
    (model,), _ = fit_together(rows, FEATURES, "y", [Settings(3, 3, 0.3)], "id")
    path = new_path(spark, "boosted")
    models.save_model(model, path)
    again = models.load_boosted(path)
    assert again.features == model.features and again.importance == pytest.approx(model.importance)
    assert sum(model.importance.values()) == pytest.approx(1)
    a, b = (sorted(map(tuple, models.predict(rows, m, FEATURES, ["id"]).collect())) for m in (model, again))
    assert a == b


def test_blocks_are_gathered_from_small_batches():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"x": list(range(i, i + 10))}) for i in range(0, 50, 10)]
    tables = list(boosting._gathered(iter(batches)))
    assert [t.num_rows for t in tables] == [50]
    assert tables[0].column(0).to_pylist() == list(range(50))


def test_rows_are_not_dealt_by_label_to_get_split_and_weight(spark):
    from riskspark.operators.split import add_balanced_weight, stratified_split

    df = spark.range(200).selectExpr("id", "cast(id % 3 = 0 as int) AS y")
    rows = add_balanced_weight(stratified_split(df, "id", "y"), "y")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan
    assert rows.count() == 200


def test_rows_of_one_task_are_attributed_in_many(spark):
    from riskspark.operators.treeshap import tree_attribution

    df = spark.range(400).selectExpr("cast(id % 40 AS double) AS a", "cast(id % 7 AS double) AS b", "cast(id % 40 > 20 AS int) AS y")
    (model,), _ = boosting.fit_together(df, ["a", "b"], "y", [boosting.Settings(3, 3)])
    told = tree_attribution(df.coalesce(1), model, ["a", "b"], ["a"])
    assert told.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert told.count() == 400


def test_leaves_by_comparisons_are_those_of_the_walk():
    draw = np.random.default_rng(4)
    bins = draw.integers(0, 8, (3, 4000)).astype(np.uint8)
    places = np.flatnonzero(draw.random(4000) < 0.5)
    # A chain that goes on to the right, of a depth below and above what a byte tells.
    for depth in (1, 3, 8, 9):
        feature, right = np.full(2 * depth + 1, -1), np.full(2 * depth + 1, -1)
        feature[0 : 2 * depth : 2], right[0 : 2 * depth : 2] = np.arange(depth) % 3, np.arange(2, 2 * depth + 1, 2)
        left = np.where(feature < 0, -1, np.arange(1, 2 * depth + 2))
        at = np.where(feature < 0, -1, np.arange(2 * depth + 1) // 6)
        rest = np.zeros((3, 2 * depth + 1))
        tree = boosting.Tree(feature, at.astype(float), at, left, right, *rest)
        assert tree.depth == depth
        assert np.array_equal(tree.leaves_of_bins(bins, places), tree.leaves_of(bins.T[places]))


def test_blocks_are_dealt_evenly_to_the_cores(spark):
    n = spark.sparkContext.defaultParallelism * boosting.BLOCK_ROWS + 30_000
    rows = spark.range(0, n, 1, 3).selectExpr("cast(id % 5 AS double) AS x0", "cast(id % 2 AS int) AS y", "id AS draw", "-1 AS fold")
    blocks = boosting._blocks(boosting._packed(rows, ["x0"], [np.arange(4.0)]), n, 1)
    found = blocks.map(lambda b: (len(b.label), int(b.bins.sum()), int(b.draw.astype(np.int64).sum()))).glom().collect()
    sizes = [sum(size for size, _, _ in task) for task in found]
    assert len(sizes) == spark.sparkContext.defaultParallelism
    assert sum(sizes) == n and max(sizes) - min(sizes) <= boosting.DEALT_ROWS * 2
    assert sum(d for task in found for _, _, d in task) == n * (n - 1) // 2
    assert sum(b for task in found for _, b, _ in task) == sum(min(i % 5, 4) for i in range(n))


def test_sums_are_those_of_each_row_in_turn():
    draw = np.random.default_rng(3)
    n, bins, cuts = 5000, 16, [np.arange(15.0), np.arange(2.0), np.arange(7.0)]
    block = boosting.Block(
        np.array([draw.integers(0, len(c) + 1, n) for c in cuts], np.uint8), draw.integers(0, 2, n).astype(np.uint8),
        draw.integers(0, 1 << 62, n).astype(np.uint64), draw.integers(0, 3, n).astype(np.int32))
    # Splits at 4 of the first feature and 1 of the third; one, two or all three of the leaves are open.
    none = np.zeros(5)
    tree = boosting.Tree(*(np.array(x) for x in ([0, -1, 2, -1, -1], none, [4, -1, 1, -1, -1], [1, -1, 3, -1, -1], [2, -1, 4, -1, -1], none, none, none)))
    margins = draw.normal(size=(3, n))
    levels = [
        boosting._Level(0, Settings(), tree, [4], np.array([0, 2])), boosting._Level(1, Settings(without_fold=1), tree, [1, 3], np.array([0, 2])),
        boosting._Level(2, Settings(subsample=1.0, without_fold=1), tree, [1, 3, 4], np.array([0, 1]))]
    totals = [level.zeros(bins) for level in levels]
    for _ in range(2):
        boosting._add_sums(totals, block, margins, levels, 5, 42, bins, 1.7)
    for level, total in zip(levels, totals):
        s, leaf = level.settings, tree.leaves_of_bins(block.bins, np.arange(n))
        learned = boosting._drawn(block, s.subsample, 5, 42) & ((block.fold != s.without_fold) if s.without_fold is not None else True)
        expected = np.zeros((2, len(level.open), len(level.columns), bins))
        for place, node in enumerate(level.open):
            rows = np.flatnonzero(learned & (leaf == node))
            p, w = 1 / (1 + np.exp(-margins[level.model, rows])), np.where(block.label[rows] == 1, 1.7, 1.0)
            for i, c in enumerate(level.columns):
                g, h = (np.bincount(block.bins[c, rows], v, bins) for v in (w * (p - block.label[rows]), w * p * (1 - p)))
                expected[:, place, i] = g + g, h + h
        sent = level.used(total, cuts, bins)
        assert sent.size == len(level.open) * sum(len(cuts[c]) + 1 for c in level.columns)
        assert np.array_equal(level.whole(sent, cuts, bins), expected)  # to the last digit, as ties are broken by it


def grown_at_random(draw, features, most):
    """Nodes of a tree of up to ``most`` levels, some branches ending early, with a chain to the lowest level."""
    nodes = []

    def grow(level, cover, chain):
        at = len(nodes)
        nodes.append(dict(id=at, value=float(draw.normal()), cover=cover, left=-1, right=-1, feature=-1, threshold=0.0))
        if level < most and (chain or draw.random() < 0.6):
            share = float(draw.uniform(0.2, 0.8))
            nodes[at].update(feature=int(draw.integers(features)), threshold=float(draw.integers(0, 6)))
            nodes[at]["left"] = grow(level + 1, cover * share, chain)
            nodes[at]["right"] = grow(level + 1, cover * (1 - share), False)
        return at

    grow(0, 100.0, True)
    return nodes


def test_terms_by_subtree_are_those_by_leaf(monkeypatch):
    from riskspark.operators import treeshap

    draw = np.random.default_rng(11)
    trees = [grown_at_random(draw, 5, most) for most in (0, 1, 3, 6, 7, 10, 13)]
    weights = draw.uniform(0.5, 1.5, len(trees)).tolist()
    x = draw.integers(-1, 8, (700, 5)) / 1.0
    tables = treeshap.tree_tables(trees, weights, 5)
    assert len(tables.trees) == 5  # the tree without a split has no terms, the deepest one goes leaf by leaf
    for tree in tables.trees:
        for most in (max(tree.depth), treeshap.MOST_SPLITS):
            nodes = tree.cut(most)
            assert len(nodes) <= len(tree.leaves) and all(t.shape[0] * t.shape[1] <= 1 << most for t in map(tree.terms, nodes))
    wide = tables.trees[3]
    assert len(wide.cut(treeshap.MOST_SPLITS)) < len(wide.leaves) / 2
    monkeypatch.setattr(treeshap, "SIDED", 256)
    monkeypatch.setattr(treeshap, "LOOKED_UP", 100)
    found = [treeshap.shapley(part, tables) for part in (x, x[:1], x[:100])]
    monkeypatch.setattr(treeshap, "MOST_SPLITS", 0)
    by_leaf = treeshap.tree_tables(trees, weights, 5)
    assert not by_leaf.trees
    for part in found:
        assert np.allclose(part, treeshap.shapley(x[: len(part)], by_leaf), atol=1e-12)


def test_scores_of_batches_together_are_those_of_the_walk(monkeypatch):
    draw = np.random.default_rng(2)
    trees = [grown_at_random(draw, 3, most) for most in (0, 2, 7, 9)]
    made = [boosting.Tree(*(np.array([n[c] for n in nodes]) for c in ("feature", "threshold")), np.full(len(nodes), -1), *(
        np.array([n[c] for n in nodes]) for c in ("left", "right", "value", "cover", "cover"))) for nodes in trees]
    model = boosting.BoostedTrees(("a", "b", "c"), tuple(made))
    x = draw.integers(-1, 8, (900, 3)) / 1.0
    x[::7, 1], x[3, 0], x[4, 2] = np.nan, np.inf, -np.inf
    for tree, values in zip(made, model.leaf_values(list(x.T))):
        assert np.array_equal(values, tree.value[tree.leaves_of(x)])
    monkeypatch.setattr(boosting, "SCORED_ROWS", 5)
    batches = [(list(range(n)),) for n in (2, 3, 1, 9, 0, 4)]
    assert [[len(b[0]) for b in held] for held in boosting.together(iter(batches))] == [[2, 3], [1], [9], [0, 4]]


def test_attribution_refuses_missing_values(spark):
    from riskspark.operators.treeshap import tree_attribution

    df = spark.range(400).selectExpr("cast(id % 40 AS double) AS a", "cast(id % 7 AS int) AS b", "cast(id % 40 > 20 AS int) AS y")
    (model,), _ = boosting.fit_together(df, ["a", "b"], "y", [boosting.Settings(3, 3)])
    told = tree_attribution(df, model, ["a", "b"], ["a", "y"])
    assert told.columns == ["a", "y", "base_value", "factors"]
    assert told.select("factors").schema.simpleString() == "struct<factors:array<struct<feature:string,value:double,contribution:double>>>"
    for gone in ("CASE WHEN a > 3 THEN a END AS a", "CASE WHEN a > 3 THEN a ELSE double('NaN') END AS a"):
        with pytest.raises(Exception):
            tree_attribution(df.selectExpr(gone, "b", "y"), model, ["a", "b"], ["y"]).collect()


def test_curve_of_groups_is_that_of_rows_per_round(rows, monkeypatch):
    from riskspark.operators import curve

    (model,), _ = fit_together(rows, FEATURES, "y", [Settings(5, 3, 0.3)], "id")
    # Groups with a null, one of a single class and one without labels; many rows of equal scores.
    odd = rows.withColumns({
        "part": F.when(F.col("id") % 5 > 0, (F.col("id") % 5).cast("string")), "a": F.when(F.col("id") % 4 > 0, F.col("a"))})
    odd = odd.withColumn("y", F.when(F.col("part") == "1", F.lit(1)).when(F.col("part") != "2", F.col("y")).when(F.col("part").isNull(), F.col("y")))
    odd = odd.withColumn("half", F.col("id") % 2 == 0)
    keep = ["part", "half"]
    staged = odd.select(*keep, "y", F.posexplode(model.staged()).alias("place", "margin"))
    long = staged.select(*keep, "y", (F.col("place") + 1).alias("round"), (1 / (1 + F.exp(-F.col("margin")))).alias("p1"))
    expected = {tuple(r)[:3]: tuple(r)[3:] for r in evaluate(long, "y", "p1", [*keep, "round"]).collect()}
    for size in (1 << 19, 200):
        monkeypatch.setattr(curve, "BUCKET_ROWS", size)
        assert (size > 3000) == (not curve._limits(odd, model, [1, 5]))
        found = {tuple(r)[:3]: tuple(r)[3:] for r in models.validation_curve(odd, model, "y", keep).collect()}
        assert found.keys() == expected.keys() and len(found) == 50
        for k, (f1, auc) in found.items():
            assert f1 == pytest.approx(expected[k][0])
            assert auc == (None if expected[k][1] is None else pytest.approx(expected[k][1]))
    beyond = models.validation_curve(odd, model, "y", rounds=[5, 9]).orderBy("round").collect()
    assert [r["round"] for r in beyond] == [5, 9] and (beyond[1]["f1"], beyond[1]["roc_auc"]) == (0.0, None)


def test_curve_sends_lists_not_a_row_per_row_and_round(rows, monkeypatch):
    from riskspark.operators import curve

    (model,), _ = fit_together(rows, FEATURES, "y", [Settings(4, 2, 0.3)], "id")
    stored = []
    monkeypatch.setattr(curve, "cut_lineage", lambda df, name: stored.append(df.cache()) or stored[-1])
    curve.curve(rows, model, "y", [], [1, 2, 3, 4]).collect()
    assert [df.count() for df in stored] == [4]  # a row per round and bucket
    assert "Generate" not in stored[0]._jdf.queryExecution().executedPlan().toString()
