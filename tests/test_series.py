import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.operators import timeseries as ts
from tabulon.streaming import tumbling_means


def frame(spark, *series):
    return spark.createDataFrame([(u, i, None if v is None else float(v)) for u, s in enumerate(series) for i, v in enumerate(s)], "u int, t long, v double").repartition(3)


def column(df, c="v", by=("u", "t")):
    return [r[c] for r in df.orderBy(*by).collect()]


def test_gaps(spark):
    df = frame(spark, [None, 1, None, 3, None], [None, None])
    assert column(ts.interpolated(df, "u", "t", ["v"])) == [None, 1, 2, 3, 3, None, None]
    assert column(ts.filled(df, "u", "t", ["v"])) == [1, 1, 1, 3, 3, None, None]


def test_interpolation_as_pandas_does(spark):
    rng = np.random.default_rng(0)
    s = [[None if rng.random() < 0.5 else float(rng.normal()) for _ in range(60)] for _ in range(5)]
    df = frame(spark, *s)
    want = df.toPandas().sort_values(["u", "t"]).groupby("u").v.transform(lambda x: x.interpolate()).tolist()
    for a, b in zip(column(ts.interpolated(df, "u", "t", ["v"])), want):
        assert (a is None and math.isnan(b)) or abs(a - b) < 1e-12


def test_blocks_and_means(spark):
    df = frame(spark, range(1, 13))
    assert column(ts.block_means(df, "u", "t", ["v"]), by=("u", "block")) == [3.5, 9.5]
    assert column(ts.moving_mean(frame(spark, [1, 3, 5]), "u", "t", "v", 2), "smooth") == [2, 4]
    gap = frame(spark, [1, None, 3, 4, 5, 6])
    assert column(ts.block_means(gap, "u", "t", ["v"], strict=True), by=("block",)) == [None]
    assert column(ts.block_means(gap, "u", "t", ["v"], strict=False), by=("block",)) == [3.8]


def test_windows(spark):
    df = frame(spark, range(10))
    starts = lambda **k: column(ts.sliding_windows(df, "u", "t", ["v"], **k), "start", ("start",))
    assert starts(inputs=4, stride=2, offset=1) == [1, 3, 5]
    assert starts(inputs=4, drop_last=True) == [0, 1, 2, 3, 4, 5]
    w = ts.sliding_windows(df, "u", "t", ["v"], 3, 2, "v").orderBy("start").collect()
    assert (w[0].x, w[0].y, w[-1].start) == ([0, 1, 2], [3, 4], 5)
    gap = frame(spark, [1, None, 3, 4, 5])
    kept = ts.sliding_windows(gap, "u", "t", ["v", "t"], 2, complete=True).orderBy("start").collect()
    assert [r.start for r in kept] == [2, 3] and kept[0].x == [[3, 2], [4, 3]]
    assert len(ts.sliding_windows(gap, "u", "t", ["v"], 2).collect()) == 4


def test_held_and_decoder_seed(spark):
    df = frame(spark, [1, 2])
    assert column(ts.held(df, "u", "t", ["v"], 3)) == [1, 1, 1, 2, 2, 2]
    r = ts.decoder_seed(frame(spark, [1, 2, 3, None]), "u", "t", "v", 2).first()
    assert (r.seed, r.last_value) == ([3, None, 3, None], 3)


@pytest.mark.parametrize("most", [10_000, 10])
def test_nearest(spark, most):
    rng = np.random.default_rng(4)
    p = rng.random((150, 2)) ** 3
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)], "k long, a double, b double")
    got = {}
    for r in ts.nearest(df, "k", ["a", "b"], 4, most).collect():
        got.setdefault(r.k, {})[r["rank"]] = r.neighbour
    for i in range(150):
        d = np.hypot(*(p - p[i]).T)
        d[i] = -1
        assert [got[i][j] for j in range(4)] == list(np.argsort(d, kind="stable")[:4])


def test_scores(spark):
    df = spark.createDataFrame([(1, 0, 1.0, 2.0), (1, 0, None, 9.0), (1, 0, 4.0, 1.0), (2, 0, 1.0, 1.0)], "turb int, time int, y_true double, y_pred double")
    assert ts.farm_score(df).first().score == pytest.approx((2 + math.sqrt(5)) / 2)
    with pytest.raises(ValueError):
        ts.validated_errors(df, "y_true", "y_pred")
    with pytest.raises(ValueError):
        ts.validated_errors(df.filter("false"), "y_true", "y_pred")
    assert ts.validated_errors(df.dropna(), "y_true", "y_pred").first().mae == pytest.approx(4 / 3)


def test_guards(spark):
    df = frame(spark, [0, 0, 0], [1, 1, 1], [1, 5, 9])
    checks = ts.unit_checks(df, "u", "v")
    assert [(r.is_zero, r.is_flat) for r in checks.orderBy("u").collect()] == [(True, True), (False, True), (False, False)]
    with pytest.raises(ValueError):
        ts.check_farm(checks)
    ts.check_farm(checks.filter("u = 2"))
    zero = ts.unit_scores(df.withColumn("y", F.lit(1.0)), "u", "t", "y", "v", F.lit(False), 2).orderBy("u").collect()
    assert zero[0].mae == -1 and zero[2].mae == pytest.approx(6 / 1000)


def test_unit_scores_look_at_all_unmasked_rows(spark):
    rows = [(1, t, 0.0, 2.0, False) for t in range(4)]  # truth all zero
    rows += [(2, t, 5.0 * (t < 2), 1.0 * (t < 2), False) for t in range(4)]  # zeros in the last rows only
    rows += [(3, t, 1.0, 1.0 * (t == 0), t == 0) for t in range(4)]  # predictions zero but for a masked one
    rows += [(4, t, 1.0, 2.0, True) for t in range(4)] + [(5, t, 4.0, 1.0, None) for t in range(4)]
    df = spark.createDataFrame(rows, "u int, t int, y double, p double, m boolean")
    got = {r.u: (r.mae, r.rmse) for r in ts.unit_scores(df, "u", "t", "y", "p", F.col("m"), 2).collect()}
    assert got == {1: (-1, -1), 2: (0, 0), 3: (-1, -1), 4: (-1, -1), 5: (0.003, 0.003)}
    totals = ts.farm_totals(ts.unit_scores(df, "u", "t", "y", "p", F.col("m"), 2)).first()
    assert (totals.n_units, totals.mae) == (2, 0.003)


def test_sensor_rules_empty_the_angles(spark):
    df = spark.createDataFrame([(1.0, 200.0, 0.0, 95.0, 1.0, 2.0, 9.0), (1.0, 20.0, -800.0, 5.0, 1.0, 99.0, 9.0)], "Patv double, Wdir double, Ndir double, Pab1 double, Pab2 double, Pab3 double, Wspd double")
    a, b = ts.cleaned(df, ts.power_rules() + ts.sensor_rules()).orderBy("Pab1").collect()
    assert [a.Patv, a.Wdir, a.Ndir, a.Pab1, b.Ndir, b.Pab3, b.Wdir] == [None, None, 0, None, None, None, 20]


def test_trend(spark):
    fine, trend = frame(spark, range(12)), spark.createDataFrame([(0, 0, 10.0), (0, 1, 20.0)], "u int, t long, v double")
    fused = column(ts.trend_fused(fine, trend, "u", "t", "v", first=3))
    assert fused[:4] == [5, 5.5, 6, 3] and fused[11] == 11
    level = column(ts.trend_fused(fine, trend, "u", "t", "v", calibrate=True))
    assert np.mean(level[:6]) == 10 and np.mean(level[6:]) == 20


def test_streaming_as_batch(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01 00:10:00", 1.0, "a"), ("2024-01-01 00:50:00", 3.0, "a"), ("2024-01-01 01:10:00", 5.0, "b")], "ts string, v double, k string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = tumbling_means(df, "ts", "v", ["k"], "1 hour")
    stream = tumbling_means(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts", "v", ["k"], "1 hour", "1 hour")
    q = stream.writeStream.format("memory").queryName("out").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("out").collect())) == sorted(map(tuple, batch.collect()))
