"""Split search by histograms, trees as arrays and vector leaves against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.ml import ensembles, histograms, preprocess, trees


def plain(x, y, depth, kind, least=1):
    """A tree over all midpoints, first feature and smallest value first: (feature, value, left, right) or the outputs' means."""

    def sums(rows):
        return np.concatenate(([len(rows)], y[rows].sum(0), [(y[rows] ** 2).sum()])) if kind == "sse" else np.bincount(y[rows, 0].astype(int), minlength=int(y.max()) + 1).astype(float)

    def grow(rows, left):
        whole = sums(rows)
        best = None
        for f in range(x.shape[1]) if left else ():
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v = x[order, f]
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            added = histograms.contributions(kind, y[order], len(whole))
            a = np.cumsum(added, axis=0)[cut]
            q = histograms.quality(kind, a, whole - a)
            ok = (cut + 1 >= least) & (len(v) - cut - 1 >= least) & (histograms.unsplit(kind, whole) - q > 1e-12)
            for i in np.flatnonzero(ok):
                best = min(best or (np.inf,), (round(float(q[i]), 10), f, (v[cut[i]] + v[cut[i] + 1]) / 2))
        if best is None or best[0] == np.inf:
            return y[rows].mean(0).tolist() if kind == "sse" else int(whole.argmax())
        _, f, value = best
        go = x[rows, f] <= value
        return (f, value, grow(rows[go], left - 1), grow(rows[~go], left - 1))

    return grow(np.arange(len(x)), depth)


def shape(tree, i=0):
    node = tree.nodes[str(i)]
    if not node.get("children"):
        return node["out"] if not tree.classes else tree.classes[node["out"].index(max(node["out"]))]
    return (tree.features.index(node["feature"]), node["value"], *(shape(tree, j) for j in node["children"]))


def same(a, b):
    if isinstance(a, tuple):
        return isinstance(b, tuple) and a[:2] == b[:2] and same(a[2], b[2]) and same(a[3], b[3])
    return np.allclose(np.atleast_1d(a), np.atleast_1d(b))


def table(spark, x, y):
    rows = [(i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, ["k"] + [f"x{i}" for i in range(x.shape[1])] + [f"y{i}" for i in range(y.shape[1])]).repartition(5)


@pytest.mark.parametrize("seed, bins, least", [(0, 256, 1), (1, 2, 1), (2, 4, 1), (3, 4, 20), (4, 7, 5)])
def test_same_splits_as_all_midpoints(spark, monkeypatch, seed, bins, least):
    """However few the bins, splits inside them are found."""
    monkeypatch.setattr(histograms.grow_all, "__defaults__", (1, False, 10, bins))
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=400), rng.integers(0, 9, 400), rng.exponential(size=400)]).round(3)
    y = (np.sin(3 * x[:, :1]) + (x[:, 1:2] > 4) + rng.normal(size=(400, 1)) * 0.2).round(2)
    df = table(spark, x, y)
    names = ["x0", "x1", "x2"]
    assert same(plain(x, y, 3, "sse", least), shape(trees.grow(df, names, "y0", "regress", max_depth=3, min_samples_leaf=least)))
    label = (y > np.median(y)).astype(float) + (y > 1.5)
    by_class = trees.grow(table(spark, x, label), names, "y0", continuous=True, max_depth=3, min_samples_leaf=least)
    assert same(plain(x, label, 3, "gini", least), shape(by_class))


def test_a_million_distinct_values(spark):
    """The best of 999,999 splits, of which few bins are read twice."""
    n = 1_000_000
    df = spark.range(n, numPartitions=8).select(F.col("id").alias("k"), ((F.col("id") * 7919) % n).cast("double").alias("x0"))
    df = df.withColumn("y0", F.when(F.col("x0") <= 654_321, 1.0).otherwise(2.0) + F.pmod(F.col("k"), F.lit(5)) / 10)
    made = trees.grow(df, ["x0"], "y0", "regress", max_depth=1)
    assert made.nodes["0"]["value"] == 654_321.5
    assert made.nodes["1"]["out"] == pytest.approx(1.2, abs=1e-4) and made.nodes["2"]["out"] == pytest.approx(2.2, abs=1e-4)
    read = []
    held, _, _ = trees._ordered(df, ["x0"], "y0", "regress", None)
    inside = histograms._Search.inside

    def counted(self, slots):
        read.append(int((slots >= 0).sum()))
        return inside(self, slots)

    histograms._Search.inside = counted
    try:
        histograms.grow_all(held, "sse", 1, 1, 3, max_depth=1)
    finally:
        histograms._Search.inside = inside
    assert read and read[0] <= 8  # of 256 bins


def test_vector_leaves(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4)).round(2)
    y = np.column_stack([x[:, 0] > 0, x[:, 0] + x[:, 1], x[:, 2] * 2]) + rng.normal(size=(300, 3)).round(3) * 0.1
    df, outputs = table(spark, x, y), ["y0", "y1", "y2"]
    names = [f"x{i}" for i in range(4)]
    model = trees.grow(df, names, outputs, "regress", max_depth=3)
    want = plain(x, y, 3, "sse")
    assert same(want, shape(model))
    for r in model.transform(df).collect():
        at = want
        while isinstance(at, tuple):
            at = at[2] if r[f"x{at[0]}"] <= at[1] else at[3]
        assert r.prediction == pytest.approx(at)
    assert preprocess.Fitted.from_json(model.to_json()) == model
    forest = trees.grow_forest(df, names, outputs, "k", 4, "regress", max_depth=3)
    total = np.mean([[r.prediction for r in t.transform(df).orderBy("k").collect()] for t in forest.trees], axis=0)
    assert np.allclose([r.prediction for r in forest.transform(df).orderBy("k").collect()], total)


def test_windows_to_many_outputs(spark):
    """72 inputs to 48 outputs in one tree."""
    rng = np.random.default_rng(6)
    rows = [(i, np.sin(np.arange(120) / 9 + rng.random() * 6).round(4).tolist()) for i in range(60)]
    df = spark.createDataFrame([(i, v[:72], v[72:]) for i, v in rows], "k int, x array<double>, y array<double>")
    model = ensembles.multi_output_trees(df, "x", "y", 72, 48, max_depth=4)
    got = {r.k: r.prediction for r in ensembles.forecast_windows(model, df.select("k", "x"), "x").collect()}
    error = np.mean([(np.array(got[i]) - v[72:]) ** 2 for i, v in rows])
    assert all(len(v) == 48 for v in got.values()) and error < 0.2 * np.var([v[72:] for _, v in rows])


def test_forests_grow_together(spark):
    """A forest's trees are those grown one by one over their own draws; its plan doesn't grow with them."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 2)).round(2)
    df = table(spark, x, (x[:, :1] + x[:, 1:] > 0).astype(float))
    forest = trees.grow_forest(df, ["x0", "x1"], "y0", "k", 3, continuous=True, max_depth=3, seed=11)
    for i, tree in enumerate(forest.trees):
        drawn = df.withColumn("w", trees.bootstrap_weight(F.col("k"), 11 + i)).filter("w > 0")
        assert same(shape(trees.grow(drawn, ["x0", "x1"], "y0", continuous=True, max_depth=3, weight="w")), shape(tree))
    many = trees.grow_forest(df, ["x0", "x1"], "y0", "k", 100, continuous=True, max_depth=10)
    assert many.transform(df).filter("y0 = prediction").count() > 190
    size = lambda m: len(m.transform(df)._jdf.queryExecution().optimizedPlan().toString())
    assert size(many) == size(forest)


def test_plans_of_boosting_stay_small(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(150, 2)).round(2)
    df = table(spark, x, np.sin(x[:, :1] * 2) + x[:, 1:])
    few, many = (ensembles.gradient_boosting(df, ["x0", "x1"], "y0", n, 0.3, 3) for n in (2, 12))
    error = lambda m: m.transform(df).agg(F.avg(F.pow(F.col("y0") - F.col("prediction"), 2))).first()[0]
    assert error(many) < error(few) / 4
    size = lambda m: len(m.transform(df)._jdf.queryExecution().optimizedPlan().toString())
    assert size(many) == size(few)
    # the same as margins worked out from the trees one after another
    margin = many.start + sum(w * np.array([r.prediction for r in t.transform(df).orderBy("k").collect()]) for t, w in zip(many.trees, many.weights))
    assert np.allclose([r.prediction for r in many.transform(df).orderBy("k").collect()], margin)


def test_large_trees_by_equality(spark):
    """Beyond an expression's size, classes and unseen values come from arrays all the same."""
    rng = random.Random(3)
    rows = [(i, f"p{rng.randint(0, 60)}", rng.randint(0, 9)) for i in range(1500)]
    df = spark.createDataFrame([(*r, (hash_of(r[1]) + r[2]) % 3) for r in rows], "k int, p string, q int, y int")
    new = spark.createDataFrame([("other", 3), (None, 1), ("p1", None)], "p string, q int")
    for model in (trees.grow(df, ["p", "q"], "y", max_depth=30), trees.grow_id3(df, ["p", "q"], "y")):
        assert len(model.nodes) > trees.SMALL
        by_plan = {r.k: r.e for r in df.withColumn("e", model.expression(lambda n: F.lit(-1 if n["out"] is None else model.classes[n["out"].index(max(n["out"]))]))).collect()}
        assert by_plan == {r.k: r.prediction for r in model.transform(df).collect()}
        held = model.transform(new).collect()
        assert len(held) == 3 and all(r.prediction in (-1, 0, 1, 2) for r in held)
        assert all(sum(r.probabilities) in (0, pytest.approx(1)) for r in model.probabilities(new).collect())


def hash_of(text):
    return sum(map(ord, text))
