"""Scans of series by ranges against plain loops over each unit."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tabulon.operators import scan
from tabulon.operators import timeseries as ts


@pytest.fixture(params=[3, 1 << 16])
def size(request, monkeypatch):
    monkeypatch.setattr(scan, "RANGE", request.param)


def units(seed=1):
    """Units of many lengths (one of them null), with gaps longer than a range, at the ends and throughout."""
    rng = random.Random(seed)
    out = {}
    for unit, n in zip([*range(8), None], [1, 2, 3, 7, 20, 21, 30, 12, 11]):
        share = rng.choice([0.1, 0.3, 0.9])
        out[unit] = [(rng.randint(0, 99) / 4 if rng.random() < share else None, float(i)) for i in range(n)]
    out[2] = [(None, 0.0)] * 3
    return out


def table(spark, held):
    rows = [(u, i, a, b) for u, vs in held.items() for i, (a, b) in enumerate(vs)]
    random.Random(2).shuffle(rows)
    return spark.createDataFrame(rows, "u int, t long, a double, b double").repartition(3)


def test_interpolated_and_filled(spark, size):
    held = units()
    got = {(r.u, r.t): (r.a, r.b) for r in ts.interpolated(table(spark, held), "u", "t", ["a", "b"]).collect()}
    full = {(r.u, r.t): r.a for r in ts.filled(table(spark, held), "u", "t", ["a"]).collect()}
    assert len(got) == len(full) == sum(map(len, held.values()))
    for u, vs in held.items():
        known = [(i, v) for i, (v, _) in enumerate(vs) if v is not None]
        for i, (v, b) in enumerate(vs):
            last = next((k for k in reversed(known) if k[0] <= i), None)
            after = next((k for k in known if k[0] >= i), None)
            want = v if v is not None else None if last is None else last[1] if after is None else last[1] + (after[1] - last[1]) * (i - last[0]) / (after[0] - last[0])
            assert got[u, i] == (pytest.approx(want), b)
            assert full[u, i] == (last or after or (0, None))[1]


@pytest.mark.parametrize("inputs, outputs, stride, offset, drop_last, complete", [(4, 0, 1, 0, False, False), (2, 3, 2, 1, True, False), (3, 1, 1, 0, True, True), (10, 2, 3, 2, False, False)])
def test_windows(spark, size, inputs, outputs, stride, offset, drop_last, complete):
    held, total = units(3), inputs + outputs
    got = {(r.u, r.start): tuple(map(tuple, r[2:])) for r in ts.sliding_windows(table(spark, held), "u", "t", ["a"], inputs, outputs, "b", stride, offset, drop_last, complete).collect()}
    want = {}
    for u, vs in held.items():
        for i in range(offset, len(vs) - total - int(drop_last) + 1, stride):
            x, y = tuple(v for v, _ in vs[i : i + inputs]), tuple(b for _, b in vs[i + inputs : i + total])
            if not (complete and None in x):
                want[u, i] = (x, y) if outputs else (x,)
    assert got == want


@pytest.mark.parametrize("steps", [1, 2, 5])
def test_moving_mean(spark, size, steps):
    held = units(4)
    got = {(r.u, r.t): r.smooth for r in ts.moving_mean(table(spark, held), "u", "t", "b", steps).collect()}
    assert got == {(u, i): pytest.approx(sum(b for _, b in vs[i : i + steps]) / steps) for u, vs in held.items() for i in range(len(vs) - steps + 1)}


def test_steps_by_span(spark):
    rng = random.Random(5)
    rows = [(u, rng.randint(-50, 50) / 4, k) for k, u in enumerate([0] * 60 + [1] * 3 + [None] * 9)]
    df = spark.createDataFrame(rows, "u int, at double, k int").repartition(4)
    whole = {r.k: r.t for r in ts.with_step(df, "u", ["at", "k"]).collect()}
    for span in (0.5, 3, 1000):
        assert {r.k: r.t for r in ts.with_step(df, "u", ["at", "k"], span=span).collect()} == whole


def test_a_long_unit_is_spread(spark):
    """A unit of 400,000 rows is filled by many tasks, with one gap over several ranges."""
    n = 400_000
    df = spark.range(n, numPartitions=4).select(F.lit(1).alias("u"), F.col("id").alias("t"), F.when((F.col("id") % 3 == 0) & ~F.col("id").between(100_000, 300_000), F.col("id").cast("double")).alias("a"))
    out = ts.interpolated(df, "u", "t", ["a"])
    assert out.filter(F.abs(F.col("a") - F.least(F.col("t"), F.lit(n - 1 - (n - 1) % 3))) > 1e-6).count() == 0
    sizes = [r.n for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert math.ceil(n / scan.RANGE) > 4 and max(sizes) < n
