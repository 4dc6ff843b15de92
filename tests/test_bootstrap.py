"""Bootstrap intervals against weights drawn row by row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.operators import bootstrap
from tabulon.ml.trees import bootstrap_weight


@pytest.fixture(scope="module")
def held(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [None, "a", "b"][i % 3] if i % 50 else "lone", float(rng.integers(0, 9)) if i % 11 else None, float(rng.normal(3, 2))) for i in range(400)]
    return spark.createDataFrame(rows, "k int, g string, x double, y double").repartition(4)


def drawn(held, draws, seed):
    cols = [bootstrap_weight(F.col("k"), seed + i).alias(f"w{i}") for i in range(draws)]
    return held.select("*", *cols).toPandas().astype({"x": float})


def test_means(spark, held, monkeypatch):
    want = drawn(held, 12, 5)
    for most in (bootstrap.MOST_NUMBERS, 1):
        monkeypatch.setattr(bootstrap, "MOST_NUMBERS", most)
        got = {r.g: (r.low, r.high) for r in bootstrap.mean_intervals(held, "k", ["g"], "y", 12, 0.8, 5).collect()}
        assert set(got) == {None, "a", "b", "lone"}
        for g, rows in want.groupby(want.g.fillna("-")):
            means = [np.average(rows.y, weights=rows[f"w{i}"]) for i in range(12) if rows[f"w{i}"].sum()]
            assert got[None if g == "-" else g] == pytest.approx(tuple(np.quantile(means, [0.1, 0.9])))


def test_lines(spark, held):
    want = drawn(held, 8, 0).dropna(subset=["x"])
    got = {r.x: (r.low, r.high) for r in bootstrap.line_intervals(held, "k", [], "x", "y", [0, 4.5], 8, 0.5).collect()}
    for x in (0.0, 4.5):
        values = [np.polyval(np.polyfit(want.x, want.y, 1, w=np.sqrt(want[f"w{i}"])), x) for i in range(8)]
        assert got[x] == pytest.approx(tuple(np.quantile(values, [0.25, 0.75])))


def test_no_rows(spark, held):
    assert bootstrap.mean_intervals(held.filter("k < 0"), "k", ["g"], "y", 5).count() == 0
