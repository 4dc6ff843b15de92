import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.ml import bayes, clusters, linear, metrics, neighbors, preprocess, selection, trees


def one(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_scalers(spark):
    df = one(spark, [(1.0, 2.0), (3.0, 2.0), (5.0, 2.0)], "x double, c double")
    s = preprocess.standard_scaler(df, ["x", "c"])
    out = s.transform(df).collect()
    assert [round(r.x, 6) for r in out] == [-1.224745, 0, 1.224745] and out[0].c is None
    m = preprocess.min_max_scaler(df, ["x"])
    assert [r.x for r in m.transform(df).collect()] == [0, 0.5, 1]
    assert [r.x for r in m.inverse_transform(m.transform(df)).collect()] == [1, 3, 5]
    with pytest.raises(ValueError):
        preprocess.standard_scaler(df.filter("false"), ["x"])


def test_polynomials(spark):
    df = one(spark, [(2.0, 3.0)], "a double, b double")
    out = preprocess.polynomial_features(df, ["a", "b"])
    assert out.columns == ["1", "X0", "X1", "X0^2", "X0 X1", "X1^2"] and tuple(out.first()) == (1, 2, 3, 4, 6, 9)
    assert tuple(preprocess.polynomial_features(df, ["a", "b"], interaction_only=True).first()) == (1, 2, 3, 6)
    with pytest.raises(ValueError):
        preprocess.polynomial_features(df, ["a"], degree=1)


def test_encoders(spark):
    df = one(spark, [(i, v) for i, v in enumerate("baca")], "i int, v string")
    e = preprocess.encoder(df, ["v"])
    assert [r.v for r in e.transform(df).orderBy("i").collect()] == [1, 0, 2, 0]
    assert [r.v for r in e.inverse_transform(e.transform(df)).orderBy("i").collect()] == list("baca")
    with pytest.raises(Exception, match="unknown value"):
        e.transform(one(spark, [("d",)], "v string")).collect()
    with pytest.raises(Exception, match="no such code"):
        e.inverse_transform(one(spark, [(9,)], "v int")).collect()
    assert e.inverse_transform(one(spark, [(None,), (0,)], "v int")).collect()[0].v is None
    numbers = preprocess.encoder(one(spark, [(5,), (3,)], "v int"), ["v"])
    assert [r.v for r in numbers.inverse_transform(one(spark, [(0,), (1,)], "v int")).collect()] == [3, 5]
    with pytest.raises(Exception, match="no such code"):
        numbers.inverse_transform(one(spark, [(2,)], "v int")).collect()
    hot = e.one_hot(one(spark, [("a",), ("z",)], "v string"))
    assert [tuple(r) for r in hot.collect()] == [(1, 0, 0), (0, 0, 0)]
    assert [r.v for r in e.from_one_hot(hot).collect()] == ["a", "a"]


def test_metrics(spark):
    r = one(spark, [(1.0, 1.0), (2.0, 2.0), (3.0, 3.0), (4.0, 6.0)], "y double, p double").agg(metrics.mean_absolute_error("y", "p"), metrics.mean_squared_error("y", "p"), metrics.r2_score("y", "p")).first()
    assert [round(x, 9) for x in r] == [0.5, 1, 0.2]
    df = one(spark, [(1, 1), (1, 0), (0, 0), (0, 1), (1, 1)], "y int, p int")
    assert tuple(metrics.precision_recall_f1(df, "y", "p").first()) == pytest.approx((2 / 3,) * 3)
    assert df.agg(metrics.accuracy("y", "p")).first()[0] == 0.6
    assert {tuple(r) for r in metrics.confusion_matrix(df, "y", "p").collect()} == {(0, 0, 1), (0, 1, 1), (1, 0, 1), (1, 1, 2)}
    assert tuple(metrics.precision_recall_f1(df.filter("false"), "y", "p").first()) == (0, 0, 0)
    assert metrics.adjusted_rand(one(spark, [(0, 0), (0, 0), (1, 1), (1, 2)], "a int, b int"), "a", "b").first().ari == pytest.approx(0.571429, abs=1e-6)
    assert metrics.adjusted_rand(one(spark, [(0, 0)], "a int, b int"), "a", "b").first().ari == 1


def test_silhouette(spark, monkeypatch):
    df = one(spark, [(0, 0.0, 0.0, 0), (1, 0.0, 1.0, 0), (2, 5.0, 0.0, 1), (3, 5.0, 1.0, 1)], "k int, x double, y double, c int")
    assert metrics.silhouette(df, "k", ["x", "y"], "c").agg(F.avg("silhouette")).first()[0] == pytest.approx(0.801961, abs=1e-6)
    alone = df.withColumn("c", F.when(F.col("k") == 3, 9).otherwise(F.col("c")))
    assert {r.k: r.silhouette for r in metrics.silhouette(alone, "k", ["x", "y"], "c").collect()}[3] == 0
    monkeypatch.setattr(metrics, "BLOCK", 2)
    assert metrics.silhouette(df, "k", ["x", "y"], "c").agg(F.avg("silhouette")).first()[0] == pytest.approx(0.801961, abs=1e-6)


def test_silhouettes_of_copies_and_odd_rows(spark, monkeypatch):
    """Against a plain version: copies, missing coordinates and labels, a cluster of one; in one block and in several."""
    rng = np.random.default_rng(5)
    x = np.concatenate([np.repeat(rng.random((30, 2)), 3, axis=0), rng.random((40, 2))])
    c = [rng.integers(0, k, len(x)) for k in (2, 4)]
    c[1][-1] = 9
    d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))

    def plain(labels):
        out = []
        for i, own in enumerate(labels):
            mean = {g: d[i, labels == g].sum() / ((labels == g).sum() - (g == own) or 1) for g in set(labels.tolist())}
            b = min(v for g, v in mean.items() if g != own)
            out.append(0.0 if (labels == own).sum() == 1 else (b - mean[own]) / max(b, mean[own]))
        return out

    rows = [(i, *map(float, p), int(a), int(b)) for i, (p, a, b) in enumerate(zip(x, *c))]
    df = one(spark, rows + [(1000, 0.5, 0.5, None, None)], "k int, x double, y double, c0 int, c1 int")
    odd = df.unionAll(one(spark, [(1001, None, 0.5, 77, 77)], "k int, x double, y double, c0 int, c1 int"))
    for block in (20_000, 17):
        monkeypatch.setattr(metrics, "BLOCK", block)
        for i in range(2):
            got = {r.k: r.silhouette for r in metrics.silhouette(odd, "k", ["x", "y"], f"c{i}").collect()}
            assert got.pop(1000) is None and got.pop(1001) == 0
            assert got == pytest.approx(dict(enumerate(plain(c[i]))))
        assert metrics.mean_silhouettes(df, ["x", "y"], ["c0", "c1"]) == pytest.approx([np.mean(plain(v)) for v in c])


def test_silhouettes_meet_distinct_points_once(spark, monkeypatch):
    """Sixty copies of each point and three labellings cost the distances of the distinct points, once."""
    met = []
    made = metrics._distance_sums
    monkeypatch.setattr(metrics, "_distance_sums", lambda block, *a: met.append(block.num_rows) or made(block, *a))
    df = spark.range(6000).selectExpr("id AS k", "DOUBLE(id % 100) AS x", "DOUBLE(id % 100 % 13) AS y")
    best, scores = clusters.best_k(df, "k", ["x", "y"], [2, 3, 4], max_iter=3)
    assert met == [100] and set(scores) == {2, 3, 4} and scores[best] == max(scores.values())


def line(spark, n=4):
    return one(spark, [(i, float(i), 2.0 * i + 1) for i in range(1, n + 1)], "k int, x double, y double")


def test_linear_and_ridge(spark):
    df = line(spark)
    assert linear.linear_regression(df, ["x"], "y").theta == pytest.approx([6, 2.236068], abs=1e-6)
    assert linear.ridge(df, ["x"], "y", 1.0).theta == pytest.approx([4.8, 1.788854], abs=1e-6)
    for g in ("math", "debug"):
        assert linear.linear_regression(df, ["x"], "y", solver="gd", gradient=g).theta == pytest.approx([6, 2.236068], abs=0.02)
    assert linear.linear_regression(df, ["x"], "y", solver="sgd", n_iters=400).theta == pytest.approx([6, 2.236068], abs=0.1)
    # the objectives differ: all of theta is penalised in one, the intercept is free in the other
    assert linear.ridge(df, ["x"], "y", 1.0, solver="gd", tol=1e-9).theta == pytest.approx([3, 1.118034], abs=1e-4)
    assert linear.ridge(df, ["x"], "y", 1.0, solver="gd", gradient="debug", tol=1e-9).theta == pytest.approx([6, 1.118034], abs=1e-3)
    with pytest.raises(ValueError):
        linear.ridge(df, ["x"], "y", solver="other")
    same = df.withColumn("z", F.col("x"))
    assert linear.linear_regression(same, ["x", "z"], "y").score(same, "y") == pytest.approx(1, abs=1e-3)


def test_stochastic_descent_uses_all_rows(spark, monkeypatch):
    monkeypatch.setattr(linear, "SGD_ROWS", 300)
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (1200, 2))
    y = 3 + x @ [2.0, -1.0] + rng.normal(0, 0.1, 1200)
    df = spark.createDataFrame([(float(a), float(b), float(v)) for (a, b), v in zip(x, y)], "a double, b double, y double")
    got = linear.linear_regression(df, ["a", "b"], "y", solver="sgd", n_iters=60)
    exact = linear.linear_regression(df, ["a", "b"], "y")
    assert got.theta == pytest.approx(exact.theta, abs=0.1)
    assert linear.linear_regression(df, ["a", "b"], "y", solver="sgd", n_iters=60).theta == got.theta


def test_predictions_take_the_training_scale(spark):
    df = line(spark, 6)
    m = linear.linear_regression(df, ["x"], "y")
    assert [r.prediction for r in m.transform(df.filter("k > 4")).orderBy("k").collect()] == pytest.approx([11, 13])
    assert [r.prediction for r in m.transform(df.filter("k > 4"), scale_on_predict="batch").orderBy("k").collect()] != pytest.approx([11, 13])


def test_lasso_and_logistic(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 2))
    y = 3 * x[:, 0] + 1
    df = one(spark, [(float(a), float(b), float(c), int(a > 0.2)) for (a, b), c in zip(x, y)], "a double, b double, y double, c int")
    m = linear.lasso(df, ["a", "b"], "y", alpha=0.5, n_iters=500)
    assert abs(m.theta[2]) < 0.2 < m.theta[1]
    with pytest.raises(NotImplementedError):
        linear.lasso(df, ["a"], "y", solver="sgd")
    g = linear.logistic_regression(df, ["a", "b"], "c", n_iters=30)
    assert g.score(df, "c") > 0.9


def test_gaussian_nb(spark):
    df = one(spark, [(float(x), int(x > 5)) for x in (1, 2, 3, 7, 8, 9)], "x double, y int")
    q = one(spark, [(1, 4.0)], "k int, x double")
    out = {r["class"]: r.probability for r in bayes.gaussian_nb(df, ["x"], "y").transform(q, "k").collect()}
    assert out[0] == pytest.approx(0.999876605, abs=1e-8) and out[1] == pytest.approx(0.000123395, abs=1e-8)


def test_categorical_nb(spark):
    df = one(spark, [("s", 0), ("s", 0), ("r", 0), ("r", 1), ("r", 1)], "a string, y int")
    m = bayes.categorical_nb(df, ["a"], "y")
    assert {(r["class"], r.value): round(r.p, 6) for r in m.table.collect()} == {(0, "s"): 0.6, (0, "r"): 0.4, (1, "s"): 0.25, (1, "r"): 0.75}
    assert m.priors == {0: 0.6, 1: 0.4} and m.unseen == 0.2
    out = m.transform(one(spark, [(1, "s"), (2, "new")], "k int, a string"), "k").collect()
    assert {r.k: r.prediction for r in out} == {1: 0, 2: 0} and sum(r.probability for r in out) == pytest.approx(2)


@pytest.fixture(scope="module")
def exact_descent():
    """Descent along forward differences of MSE + alpha |weights| or alpha |weights|^2, with 80 digits."""
    from decimal import Decimal, localcontext

    def fit(z, y, alpha, squared, n_iters):
        with localcontext() as held:
            held.prec = 80
            z, y = [[Decimal(1), *map(Decimal, r)] for r in z.tolist()], [Decimal(v) for v in y.tolist()]
            step, alpha, n = Decimal("0.0001"), Decimal(alpha), len(y)

            def cost(t):
                return sum((sum(a * b for a, b in zip(r, t)) - v) ** 2 for r, v in zip(z, y)) / n + alpha * sum(w * w if squared else abs(w) for w in t[1:])

            t = [Decimal(1)] * len(z[0])
            for _ in range(n_iters):
                base = cost(t)
                g = [(cost([w + step * (i == k) for i, w in enumerate(t)]) - base) / step for k in range(len(t))]
                if sum(x * x for x in g).sqrt() <= Decimal("0.001"):
                    break
                t = [w - x / 10 for w, x in zip(t, g)]
            return [float(w) for w in t]

    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 2))
    y = 1e6 + 3e5 * rng.normal(size=40) + 100 * x[:, 0] - 40 * x[:, 1]
    return fit, x, (x - x.mean(axis=0)) / x.std(axis=0), y


def test_lasso_descent_of_large_labels(spark, exact_descent):
    """Where losses are 1e12 their differences are no rounding noise."""
    fit, x, z, y = exact_descent
    df = one(spark, [(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, y double")
    m = linear.lasso(df, ["a", "b"], "y", alpha=3.0)
    assert m.theta == pytest.approx(fit(z, y, 3.0, False, 1000), rel=0, abs=1e-5)


def test_numeric_descent_of_large_labels(spark, exact_descent):
    fit, x, z, y = exact_descent
    df = one(spark, [(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, y double")
    m = linear.linear_regression(df, ["a", "b"], "y", solver="gd", gradient="debug")
    assert m.theta == pytest.approx(fit(z, y, 0.0, False, 1000), rel=0, abs=1e-5)
    m = linear.ridge(df, ["a", "b"], "y", 0.5, solver="gd", gradient="debug")
    assert m.theta == pytest.approx(fit(z, y, 0.5, True, 1000), rel=0, abs=1e-5)


def test_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(2)
    p, label = rng.random((80, 3)), rng.integers(0, 3, 80)
    df = one(spark, [(i, *map(float, x), int(c)) for i, (x, c) in enumerate(zip(p, label))], "k long, a double, b double, c double, y int")
    train, test = df.filter("k >= 20"), df.filter("k < 20")
    for power, block in ((2, 20_000), (1, 7)):
        monkeypatch.setattr(neighbors, "BLOCK", block)
        got = {(r.k, r["rank"]): r.neighbour for r in neighbors.neighbours(test, train, "k", ["a", "b", "c"], 4, power).collect()}
        for i in range(20):
            d = (np.abs(p[20:] - p[i]) ** power).sum(axis=1)
            assert [got[i, j] for j in range(1, 5)] == (np.argsort(d, kind="stable")[:4] + 20).tolist()
    exact = {r.k: r.prediction for r in neighbors.knn_classify(df, df, "k", ["a", "b", "c"], "y", 5, "distance").collect()}
    assert exact == dict(enumerate(label.tolist()))
    near = {r.k: r.prediction for r in neighbors.knn_regress(df, df, "k", ["a", "b", "c"], "y", 5, "distance").collect()}
    assert near == pytest.approx(dict(enumerate(map(float, label))))
    with pytest.raises(ValueError):
        neighbors.knn_classify(test, train.limit(2), "k", ["a"], "y", 5)


def test_neighbours_meet_in_tiles(spark, monkeypatch):
    """Ties, many copies, near copies far from the origin, gaps and text keys, in small tiles, against a plain version; no join of rows."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.integers(0, 4, (300, 3)).astype(float), np.full((80, 3), 1.0), 1e6 + rng.random((60, 3)) * 1e-4])
    keys = [f"{i:04d}" for i in rng.permutation(len(x))]
    rows = [(a, v.tolist(), int(a) % 7) for a, v in zip(keys, x)] + [("9998", [0.0, None, 0.0], 1), ("9999", None, 1)]
    df = one(spark, rows, "k string, v array<double>, y int")
    monkeypatch.setattr(neighbors, "TILE", (16, 50))
    monkeypatch.setattr(neighbors, "BATCH", 130)
    for p in (2, 3):
        plan = neighbors.neighbours(df, df, "k", ["v"], 4, p, ["y"])
        assert "NestedLoop" not in plan._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in plan._jdf.queryExecution().executedPlan().toString()
        got = {(r.k, r["rank"]): r for r in plan.collect()}
        assert len(got) == 4 * len(rows)
        for a, v in zip(keys, x):
            d = np.zeros(len(x))
            for i in range(3):
                d = d + np.abs(x[:, i] - v[i]) ** p
            d = np.sqrt(d) if p == 2 else d ** (1 / p)
            want = sorted(zip(d, keys))[:4]
            assert [(got[a, j].neighbour, got[a, j].y) for j in range(1, 5)] == [(b, int(b) % 7) for _, b in want]
            assert [got[a, j].distance for j in range(1, 5)] == pytest.approx([e for e, _ in want], rel=1e-12)
        assert [got["9999", j].neighbour for j in range(1, 5)] == sorted(keys)[:4] and got["9998", 1].distance is None


def test_regression_over_neighbours_in_blocks(spark, monkeypatch):
    """Weighted means from several blocks of queries, copies among the train rows; no join of rows in any block."""
    rng = np.random.default_rng(9)
    x, y = np.repeat(rng.random((40, 5)), 4, axis=0), rng.integers(0, 10, 160)
    q = rng.random((50, 5))
    train = one(spark, [(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))], "k long, v array<double>, y int")
    test = one(spark, [(1000 + i, v.tolist()) for i, v in enumerate(q)], "k long, v array<double>")
    plans = []
    kept = neighbors.stored
    monkeypatch.setattr(neighbors, "stored", lambda df, *a: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, *a))
    monkeypatch.setattr(neighbors, "BLOCK", 20)
    got = {r.k: r.prediction for r in neighbors.knn_regress(test, train, "k", ["v"], "y", 6, "distance").collect()}
    for i, v in enumerate(q):
        d = np.sqrt(((x - v) ** 2).sum(axis=1))
        near = np.argsort(d, kind="stable")[:6]
        assert got[1000 + i] == pytest.approx((y[near] / d[near]).sum() / (1 / d[near]).sum())
    assert len(got) == 50 and len(plans) > 2 and not any("Join" in p or "Cartesian" in p for p in plans)


@pytest.mark.parametrize(("spread", "centre", "kinds"), [(1.0, 0.0, {"float32"}), (1e-4, 1e6, {"float32", "float64"}), (0.0, 1.0, {"float32", "float64"}), (1e18, 0.0, {"float64"})])
def test_regression_chooses_neighbours_in_single_precision_where_that_is_safe(monkeypatch, spread, centre, kinds):
    """What stands far from the origin, or as near as its rounding, is chosen in double precision; results are those of a plain version."""
    import pyarrow as pa

    rng = np.random.default_rng(11)
    b, q = centre + spread * rng.normal(size=(400, 16)), centre + spread * rng.normal(size=(60, 16))
    b[7], b[390] = np.nan, q[5]
    if not spread:
        b[:200] += rng.normal(size=(200, 16))
    if kinds == {"float32"}:
        b[390] += 0.1
    made, product = [], neighbors._product
    monkeypatch.setattr(neighbors, "TILE", (16, 50))
    monkeypatch.setattr(neighbors, "_product", lambda x, y: made.extend([x.dtype.name] * min(len(x), 1)) or product(x, y))
    found = neighbors._Nearest(q, np.ones(len(q), bool), 5, 2)
    keys = rng.permutation(len(b))
    for at in (slice(0, 130), slice(130, 300), slice(300, 400)):
        rows = [None if np.isnan(v).any() else v.tolist() for v in b[at]]
        found.meet(pa.table({"_t": keys[at], "_b": pa.array(rows, pa.list_(pa.float64())), "_0": keys[at] % 9}))
    for i, v in enumerate(q):
        d = np.zeros(len(b))
        for x in (b - v).T:
            d = d + x * x
        d = np.sqrt(np.where(np.isnan(d), np.inf, d))
        want = np.lexsort((keys, d))[:5]
        assert found.held["_t"].to_numpy()[found.at[i]].tolist() == keys[want].tolist()
        assert found.distance[i].tolist() == d[want].tolist()
    assert set(made) == kinds


def test_split_qualities(spark):
    df = one(spark, [("a", 1), ("a", 1), ("b", 0), ("c", 0)], "x string, y int")
    t = trees.grow(df, ["x"], "y", max_depth=1)
    assert t.nodes["0"]["value"] == "a" and t.nodes["1"]["out"] == [0, 1] and t.nodes["2"]["out"] == [1, 0]
    held = df.withColumns({"node": F.lit(0), "n": F.lit(1.0), "s0": (F.col("y") == 0).cast("double"), "s1": (F.col("y") == 1).cast("double")})
    assert {r.value: round(r.quality, 6) for r in trees.split_table(held, ["x"], ["s0", "s1"], "gini", False).collect()} == {"a": 0, "b": 0.333333, "c": 0.333333}
    reg = one(spark, [(1.0, 1.0), (2.0, 1.0), (3.0, 5.0), (4.0, 5.0)], "x double, y double")
    assert trees.grow(reg, ["x"], "y", "regress", max_depth=1).nodes["0"]["value"] == 2.5
    assert [r.prediction for r in trees.grow(reg.withColumn("y", F.col("y") + 0.5), ["x"], "y", "regress", max_depth=1).transform(reg, legacy_int=True).orderBy("x").collect()] == [1, 1, 5, 5]


def plain_tree(rows, depth):
    """Best-first-by-order regression tree on (features, y), as nested tuples or a mean."""
    y = [r[-1] for r in rows]
    mean = sum(y) / len(y)
    sse = lambda v: sum((a - sum(v) / len(v)) ** 2 for a in v)
    best = None
    if depth and len(rows) > 1:
        for f in range(len(rows[0]) - 1):
            xs = sorted({r[f] for r in rows})
            for a, b in zip(xs, xs[1:]):
                m = (a + b) / 2
                left, right = [r for r in rows if r[f] <= m], [r for r in rows if r[f] > m]
                q = (len(left) * sse([r[-1] for r in left]) + len(right) * sse([r[-1] for r in right])) / len(rows)
                if sse(y) - q > 1e-9 and (best is None or q < best[0] - 1e-9):
                    best = (q, f, m, left, right)
    return mean if best is None else (best[1], best[2], plain_tree(best[3], depth - 1), plain_tree(best[4], depth - 1))


def follow(tree, x):
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def test_regression_tree_as_a_plain_one(spark):
    rng = random.Random(6)
    rows = [(float(rng.randint(0, 9)), float(rng.randint(0, 9)), rng.random() * 10) for _ in range(60)]
    df = one(spark, [(i, *r) for i, r in enumerate(rows)], "k int, a double, b double, y double")
    got = [r.prediction for r in trees.grow(df, ["a", "b"], "y", "regress", max_depth=3).transform(df).orderBy("k").collect()]
    want = plain_tree(rows, 3)
    assert got == pytest.approx([follow(want, r) for r in rows])


def test_classification_trees(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice("abc"), rng.choice("xyz"), rng.random()) for i in range(90)]
    df = one(spark, [(*r, "hit" if r[1] == "a" and r[2] != "x" else "miss") for r in rows], "k int, p string, q string, z double, y string")
    for t in (trees.grow(df, ["p", "q"], "y"), trees.grow_id3(df, ["p", "q"], "y"), trees.grow(df, ["p", "q"], "y", leaf="majority")):
        assert t.transform(df).filter("y <> prediction").count() == 0
    id3 = trees.grow_id3(df, ["p", "q"], "y")
    assert id3.transform(one(spark, [("new", "x")], "p string, q string"), unseen="none").first().prediction == "none"
    assert preprocess.Fitted.from_json(id3.to_json()) == id3
    p = trees.grow(df, ["p"], "y", max_depth=1).probabilities(df).first().probabilities
    assert sum(p) == pytest.approx(1)
    assert len(trees.grow(df, ["p", "q"], "y", min_samples_leaf=80).nodes) == 1


def test_forests(spark):
    rng = random.Random(9)
    df = one(spark, [(i, x := rng.random(), rng.random(), int(x > 0.5), x * 3) for i in range(150)], "k int, a double, b double, c int, y double")
    f = trees.grow_forest(df, ["a", "b"], "c", "k", 5, continuous=True, max_depth=3)
    assert f.transform(df).filter("c = prediction").count() > 140
    g = trees.grow_forest(df, ["a", "b"], "y", "k", 5, "regress", max_depth=4)
    assert g.transform(df).agg(metrics.r2_score("y", "prediction")).first()[0] > 0.9
    w = spark.range(4000).select(trees.bootstrap_weight(F.col("id"), 1).alias("w")).agg(F.avg("w"), F.var_pop("w")).first()
    assert w[0] == pytest.approx(1, abs=0.06) and w[1] == pytest.approx(1, abs=0.12)


def test_kmeans(spark):
    from tabulon.sources.files import blobs

    df = blobs(spark, 200, [[0.0, 0.0], [20.0, 0.0], [0.0, 20.0]], 1.0, 5)
    m = clusters.kmeans(df, ["x0", "x1"], 3, init=[[1.0, 1.0], [15.0, 1.0], [1.0, 15.0]])
    assert metrics.adjusted_rand(m.transform(df), "label", "cluster").first().ari == 1
    assert clusters.best_k(df, "id", ["x0", "x1"], [2, 3], seed=4)[0] in (2, 3)
    empty = clusters.kmeans(df, ["x0"], 2, max_iter=3, init=[[5.0], [1e9]])
    assert empty.centers[1] == [1e9]


def test_pca(spark):
    df = one(spark, [(2.0, 0.0), (0.0, 1.0), (-2.0, 0.0), (0.0, -1.0)], "a double, b double")
    p = clusters.pca(df, ["a", "b"])
    assert p.explained_variance == pytest.approx([8, 2]) and p.explained_variance_ratio == pytest.approx([0.8, 0.2])
    assert len(clusters.pca(df, ["a", "b"], 0.8).components) == 1 and len(clusters.pca(df, ["a", "b"], 0.9).components) == 2
    back = p.inverse_transform(p.transform(df)).collect()
    assert sorted(map(tuple, back)) == [pytest.approx(x) for x in sorted([(2, 0), (0, 1), (-2, 0), (0, -1)])]
    with pytest.raises(ValueError):
        clusters.pca(df, ["a"], 3)


def test_splits_and_folds(spark):
    df = spark.range(101)
    train, test = selection.train_test_split(df, "id")
    ids = lambda d: {r.id for r in d.collect()}
    assert len(ids(train)) == 80 and ids(train) | ids(test) == set(range(101)) and not ids(train) & ids(test)
    assert selection.train_test_split(df, "id", test_size=0.5)[0].count() == 50
    with pytest.raises(ValueError):
        selection.train_test_split(df, "id", 0.5, 0.6)
    folds = {r.id: r.fold for r in selection.with_fold(spark.range(11), ["id"], 5).collect()}
    assert [folds[i] for i in range(11)] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4, None]


def test_grid(spark):
    df = line(spark, 20)
    s = selection.GridSearchCV(lambda d, alpha: linear.ridge(d, ["x"], "y", alpha), [{"alpha": [100.0, 0.0]}, {"alpha": [0.0]}], lambda m, d: m.score(d, "y"), 4).fit(df, ["k"])
    assert s.best_param == {"alpha": 0.0} and s.best_score == pytest.approx(1) and len(s.scores) == 3 and s.score(df) == pytest.approx(1)
    assert math.isfinite(s.scores[0][1])


def test_any_model_scores_rows(spark):
    from tabulon.ml.ensembles import scored_by

    df = one(spark, [(1, 2.0, 3.0), (2, 0.0, 1.0)], "k int, a double, b double")
    assert {tuple(r) for r in scored_by(df, lambda x: x.sum(axis=1), ["a", "b"], ["k"]).collect()} == {(1, 5.0), (2, 1.0)}


def test_boosted_and_perceptron(spark):
    from tabulon.ml import ensembles

    rng = random.Random(2)
    df = one(spark, [(x := rng.random(), rng.random(), float(x > 0.5), x * 2) for _ in range(200)], "a double, b double, c double, y double")
    assert ensembles.boosted_regressor(df, ["a", "b"], "y", 5, 3)(df).agg(metrics.r2_score("y", "prediction")).first()[0] > 0.9
    assert ensembles.direction_classifier(df, ["a", "b"], "c", (4,), 60)(df).filter("c = prediction").count() > 150
