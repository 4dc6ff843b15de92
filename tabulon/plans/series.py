"""Series operators on the events table: a user is a unit, its events in time order are the steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions.scalars import rounded
from tabulon.operators import relational as rel
from tabulon.operators import timeseries as ts
from tabulon.plans.registry import Tables, query, r6
from tabulon.sources import files
from tabulon.streaming import tumbling_means

c = F.col
#: user_id, t, value, and v: the value where it is at most 60
S = "s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value, CASE WHEN value > 60 THEN NULL ELSE value END AS v FROM events)"
#: the same with a prediction: the value 3 steps before, 10 where there is none, and 0 for every tenth user
P = "p AS (SELECT *, CASE WHEN user_id % 10 = 0 THEN 0 ELSE coalesce(lag(value, 3) OVER (PARTITION BY user_id ORDER BY t), 10) END AS pred FROM s)"


def series(t: Tables) -> DataFrame:
    steps = ts.with_step(t.events, "user_id", ["ts", "event_id"])
    return rel.null_where(steps.select("user_id", "t", "value", c("value").alias("v")), [("v", c("v") > 60)])


def predicted(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    before = F.lag("value", 3).over(Window.partitionBy("user_id").orderBy("t"))
    return series(t).withColumn("pred", F.when(c("user_id") % 10 == 0, F.lit(0.0)).otherwise(F.coalesce(before, F.lit(10.0))))


@query(f"WITH {S} SELECT user_id, t, CASE WHEN value > lag(value) OVER (PARTITION BY user_id ORDER BY t) THEN 1 WHEN value <= lag(value) OVER (PARTITION BY user_id ORDER BY t) THEN 0 END AS up FROM s")
def direction_label_lag(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    return series(t).select("user_id", "t", (c("value") > F.lag("value").over(Window.partitionBy("user_id").orderBy("t"))).cast("int").alias("up"))


@query("""SELECT event_id, CASE WHEN value < 0.5 OR (value < 3 AND user_id % 4 = 0) OR user_id > 140 OR value > 200 THEN NULL ELSE value END AS value FROM events""")
def quality_rules(t: Tables) -> DataFrame:
    rules = [("value", c("value") < 0.5), ("value", (c("value") < 3) & (c("user_id") % 4 == 0)), ("value", c("user_id") > 140), ("value", c("value") > 200)]
    return ts.cleaned(t.events.select("event_id", "user_id", "value"), rules).select("event_id", "value")


@query("""WITH x AS (SELECT event_id, value - 5 AS patv, value / 3 AS wspd, user_id AS p1, user_id % 100 AS p2, 0 AS p3, user_id * 3 - 200 AS wdir, user_id * 6 - 100 AS ndir FROM events)
SELECT event_id, CASE WHEN patv < 0 OR (patv = 0 AND wspd > 2.5) OR greatest(p1, p2, p3) > 89 OR wdir < -180 OR wdir > 180 OR ndir < -720 OR ndir > 720 THEN NULL ELSE patv END AS patv FROM x""")
def power_rules(t: Tables) -> DataFrame:
    u = c("user_id")
    x = t.events.select("event_id", (c("value") - 5).alias("Patv"), (c("value") / 3).alias("Wspd"), u.alias("Pab1"), (u % 100).alias("Pab2"), F.lit(0).cast("long").alias("Pab3"), (u * 3 - 200).alias("Wdir"), (u * 6 - 100).alias("Ndir"))
    return ts.cleaned(x, ts.power_rules()).select("event_id", c("Patv").alias("patv"))


@query(f"""WITH {S}, a AS (SELECT *, CASE WHEN v IS NOT NULL THEN t END AS pv FROM s),
b AS (SELECT *, last_value(v IGNORE NULLS) OVER w1 AS lv, last_value(pv IGNORE NULLS) OVER w1 AS lp, first_value(v IGNORE NULLS) OVER w2 AS nv, first_value(pv IGNORE NULLS) OVER w2 AS np FROM a
WINDOW w1 AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), w2 AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, t, {r6('CASE WHEN v IS NOT NULL THEN v WHEN lv IS NULL THEN NULL WHEN nv IS NULL THEN lv ELSE lv + (nv - lv) * (t - lp) / (np - lp) END')} AS v FROM b""")
def interpolate_linear(t: Tables) -> DataFrame:
    return ts.interpolated(series(t), "user_id", "t", ["v"]).select("user_id", "t", rounded(c("v")).alias("v"))


@query(f"""WITH {S} SELECT user_id, t, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM s""")
def ffill_bfill(t: Tables) -> DataFrame:
    return ts.filled(series(t), "user_id", "t", ["v"]).select("user_id", "t", "v")


@query(f"WITH {S} SELECT user_id, t // 6 AS block, {r6('CASE WHEN count(v) = count(*) THEN avg(v) END')} AS v, {r6('avg(value)')} AS value, count(*) AS n_rows FROM s GROUP BY ALL")
def block_mean_6(t: Tables) -> DataFrame:
    out = ts.block_means(series(t), "user_id", "t", ["v", "value"], 6)
    return out.select("user_id", "block", rounded(c("v")).alias("v"), rounded(c("value")).alias("value"), "n_rows")


@query(f"SELECT user_id, CAST(ts AS DATE) AS day, CAST(hour(ts) AS INTEGER) AS hour, {r6('avg(value)')} AS mean FROM events GROUP BY ALL")
def calendar_hour_mean(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", F.to_date("ts").alias("day"), F.hour("ts").alias("hour")).agg(rounded(F.avg("value")).alias("mean"))


@query(f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(value) AS n, {r6('avg(value)')} AS mean FROM events GROUP BY ALL")
def tumbling_hour_mean(t: Tables) -> DataFrame:
    return tumbling_means(t.events, "ts", "value", ["event_type"], "1 hour").withColumn("mean", rounded(c("mean")))


@query(f"""WITH {S}, w AS (SELECT user_id, t AS start, list(value) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING) AS x, lead(value, 30) OVER (PARTITION BY user_id ORDER BY t) AS y, count(*) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM s)
SELECT user_id, start, array_to_string(x, '|') AS x, y FROM w WHERE n >= 31""")
def sliding_window_arrays(t: Tables) -> DataFrame:
    w = ts.sliding_windows(series(t), "user_id", "t", ["value"], 30, 1, "value")
    return w.select("user_id", "start", F.array_join(F.transform("x", lambda x: x.cast("string")), "|").alias("x"), F.get("y", F.lit(0)).alias("y"))


@query(f"""WITH {S}, w AS (SELECT user_id, t AS start, list(v) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS x, count(v) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS k, count(*) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM s)
SELECT user_id, start, {r6('list_sum(x)')} AS total FROM w WHERE n >= 5 AND k = 4 AND start >= 1 AND (start - 1) % 2 = 0""")
def strided_windows(t: Tables) -> DataFrame:
    w = ts.sliding_windows(series(t), "user_id", "t", ["v"], 4, stride=2, offset=1, drop_last=True, complete=True)
    return w.select("user_id", "start", rounded(F.aggregate("x", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query(f"""WITH {S} SELECT user_id, t, {r6('smooth')} AS smooth FROM (SELECT user_id, t, avg(value) OVER w AS smooth, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)) WHERE n = 2""")
def moving_average(t: Tables) -> DataFrame:
    return ts.moving_mean(series(t), "user_id", "t", "value", 2).select("user_id", "t", rounded(c("smooth")).alias("smooth"))


@query(f"WITH {S} SELECT user_id, t * 6 + i AS t, value FROM s, range(0, 6) g(i)")
def hold_upsample(t: Tables) -> DataFrame:
    return ts.held(series(t), "user_id", "t", ["value"], 6)


@query(f"WITH {S} SELECT user_id, t, value FROM s WHERE v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t DESC) <= 7")
def last_n_after_filter(t: Tables) -> DataFrame:
    return rel.last_rows(series(t).filter("v IS NOT NULL"), ["user_id"], "t", 7).select("user_id", "t", "value")


@query(f"""WITH {S}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC) AS r FROM s)
SELECT user_id, array_to_string(list(value ORDER BY t) FILTER (r <= 5), '|') || '|' || array_to_string(list(value ORDER BY t) FILTER (r <= 5), '|') AS seed, max_by(value, t) AS last_value FROM r GROUP BY 1""")
def decoder_seed(t: Tables) -> DataFrame:
    out = ts.decoder_seed(series(t), "user_id", "t", "value", 5, 2)
    return out.select("user_id", F.array_join(F.transform("seed", lambda x: x.cast("string")), "|").alias("seed"), "last_value")


@query(f"WITH {S} SELECT user_id, t, coalesce(v, 0) AS v, v AS raw_v FROM s")
def unit_series(t: Tables) -> DataFrame:
    e = rel.null_where(t.events.withColumn("v", c("value")), [("v", c("v") > 60)])
    return files.unit_series(e, "user_id", ["ts", "event_id"], ["v"], span=7 * 86_400)


_X = "x AS (SELECT s_suppkey, (s_acctbal - min(s_acctbal) OVER ()) / (max(s_acctbal) OVER () - min(s_acctbal) OVER ()) AS a, (s_nationkey - min(s_nationkey) OVER ())::DOUBLE / (max(s_nationkey) OVER () - min(s_nationkey) OVER ()) AS b FROM supplier)"
_N = "n AS (SELECT x.s_suppkey, y.s_suppkey AS neighbour, sqrt((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b)) AS d, row_number() OVER (PARTITION BY x.s_suppkey ORDER BY CASE WHEN x.s_suppkey = y.s_suppkey THEN 0 ELSE 1 END, sqrt((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b)), y.s_suppkey) - 1 AS rank FROM x, x y)"


def points(t: Tables) -> DataFrame:
    from tabulon.ml.preprocess import min_max_scaler

    p = t.supplier.select("s_suppkey", c("s_acctbal").alias("a"), c("s_nationkey").cast("double").alias("b"))
    return min_max_scaler(p, ["a", "b"]).transform(p)


@query(f"WITH {_X}, {_N} SELECT s_suppkey, CAST(rank AS INTEGER) AS rank, neighbour, {r6('d')} AS distance FROM n WHERE rank < 4")
def knn_self_topk(t: Tables) -> DataFrame:
    return ts.nearest(points(t), "s_suppkey", ["a", "b"], 4).withColumn("distance", rounded(c("distance")))


@query(f"""WITH {_X}, {_N}, e AS (SELECT user_id % 50 AS unit, CAST(hour(ts) AS INTEGER) AS h, sum(value) AS v FROM events GROUP BY ALL)
SELECT e.unit, e.h, {r6('any_value(e.v)')} AS v, {r6('max(n.d) FILTER (n.rank = 1 AND o.v IS NOT NULL)')} AS distance_1, {r6('max(o.v) FILTER (n.rank = 1)')} AS v_1, {r6('max(n.d) FILTER (n.rank = 2 AND o.v IS NOT NULL)')} AS distance_2, {r6('max(o.v) FILTER (n.rank = 2)')} AS v_2
FROM e LEFT JOIN n ON n.s_suppkey = e.unit AND n.rank IN (1, 2) LEFT JOIN e o ON o.unit = n.neighbour AND o.h = e.h GROUP BY e.unit, e.h""")
def neighbour_features(t: Tables) -> DataFrame:
    panel = t.events.groupBy((c("user_id") % 50).alias("unit"), F.hour("ts").alias("h")).agg(F.sum("value").alias("v"))
    near = ts.nearest(points(t), "s_suppkey", ["a", "b"], 3).withColumnRenamed("s_suppkey", "unit")
    out = ts.neighbour_features(panel, "unit", "h", ["v"], near)
    return out.select("unit", "h", *(rounded(c(x)).alias(x) for x in ("v", "distance_1", "v_1", "distance_2", "v_2")))


@query(f"""WITH {S}, {P}, e AS (SELECT user_id, t // 10 AS time, avg(abs(v - pred)) AS mae, sqrt(avg((v - pred) * (v - pred))) AS rmse FROM p GROUP BY ALL)
SELECT time, {r6('sum((mae + rmse) / 2)')} AS score FROM e GROUP BY 1""")
def farm_score(t: Tables) -> DataFrame:
    p = predicted(t).withColumn("time", F.floor(c("t") / 10))
    return ts.farm_score(p, "user_id", "time", "v", "pred").select("time", rounded(c("score")).alias("score"))


_SCORES = """k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC) AS r FROM p WHERE NOT coalesce(value > 60, false)),
has AS (SELECT user_id, bool_or(pred <> 0) AND bool_or(value <> 0) AS ok FROM k GROUP BY 1),
late AS (SELECT user_id, avg(abs(value - pred)) / 1000 AS mae, sqrt(avg((value - pred) * (value - pred))) / 1000 AS rmse FROM k WHERE r <= 20 GROUP BY 1),
u AS (SELECT a.user_id, CASE WHEN ok THEN mae ELSE -1 END AS mae, CASE WHEN ok THEN rmse ELSE -1 END AS rmse FROM (SELECT DISTINCT user_id FROM p) a LEFT JOIN has USING (user_id) LEFT JOIN late USING (user_id))"""


@query(f"WITH {S}, {P}, {_SCORES} SELECT user_id, {r6('mae')} AS mae, {r6('rmse')} AS rmse FROM u")
def masked_unit_scores(t: Tables) -> DataFrame:
    out = ts.unit_scores(predicted(t), "user_id", "t", "value", "pred", c("value") > 60, 20)
    return out.select("user_id", rounded(c("mae")).alias("mae"), rounded(c("rmse")).alias("rmse"))


@query(f"""WITH {S}, {P} SELECT user_id, NOT bool_or(pred <> 0) AS is_zero, (min(pred) = max(pred) OR stddev_pop(pred) <= 0.1 OR count(DISTINCT pred) / count(pred) < 0.1) AS is_flat FROM p GROUP BY 1""")
def zero_identical_guards(t: Tables) -> DataFrame:
    return ts.unit_checks(predicted(t), "user_id", "pred")


@query(f"WITH {S}, {P}, {_SCORES} SELECT {r6('sum(mae)')} AS mae, {r6('sum(rmse)')} AS rmse, count(*) AS n_units FROM u WHERE mae <> -1")
def farm_totals(t: Tables) -> DataFrame:
    out = ts.farm_totals(ts.unit_scores(predicted(t), "user_id", "t", "value", "pred", c("value") > 60, 20))
    return out.select(rounded(c("mae")).alias("mae"), rounded(c("rmse")).alias("rmse"), "n_units")


@query(f"""WITH {S}, {P} SELECT {r6('avg(abs(value - pred))')} AS mae, {r6('avg((value - pred) * (value - pred))')} AS mse, {r6('sqrt(avg((value - pred) * (value - pred)))')} AS rmse FROM p""")
def scored_errors(t: Tables) -> DataFrame:
    return ts.validated_errors(predicted(t), "value", "pred").select(*(rounded(c(x)).alias(x) for x in ("mae", "mse", "rmse")))


@query(f"""WITH {S}, {P}, e AS (SELECT user_id AS run, avg(abs(value - pred)) AS mae, sqrt(avg((value - pred) * (value - pred))) AS rmse FROM p GROUP BY 1)
SELECT count(*) AS n_runs, {r6('avg(mae)')} AS mae, {r6('avg(rmse)')} AS rmse, {r6('(avg(mae) + avg(rmse)) / 2')} AS score, {r6('avg(1 - rmse / 1000.0)')} AS accuracy, greatest(stddev_pop(mae), stddev_pop(rmse), stddev_pop(1 - rmse / 1000.0)) >= 0.001 AS has_noise FROM e""")
def run_summary(t: Tables) -> DataFrame:
    e = c("value") - c("pred")
    runs = predicted(t).groupBy("user_id").agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse")).withColumn("last_day_rmse", c("rmse"))
    out = ts.run_summary(runs, 1000.0)
    return out.select("n_runs", *(rounded(c(x)).alias(x) for x in ("mae", "rmse", "score", "accuracy")), "has_noise")


@query(f"""WITH {S}, {P} SELECT {r6("(avg(abs(coalesce(v - pred, 0))) + sqrt(avg(coalesce(v - pred, 0) * coalesce(v - pred, 0)))) / 2 + 0.0001 * 3.5")} AS loss FROM p""")
def training_loss(t: Tables) -> DataFrame:
    return predicted(t).agg(rounded(ts.training_loss("v", "pred", [1.0, -2.5])).alias("loss"))


@query(f"""WITH {S}, m AS (SELECT user_id, t // 6 AS b, avg(value) AS trend FROM s GROUP BY ALL)
SELECT s.user_id, s.t, {r6('CASE WHEN s.t < 36 THEN (value + trend) / 2 ELSE value END')} AS value FROM s JOIN m ON s.user_id = m.user_id AND s.t // 6 = m.b""")
def trend_fusion(t: Tables) -> DataFrame:
    s = series(t).select("user_id", "t", "value")
    trend = ts.block_means(s, "user_id", "t", ["value"], 6).select("user_id", c("block").alias("t"), "value")
    return ts.trend_fused(s, trend, "user_id", "t", "value").select("user_id", "t", rounded(c("value")).alias("value"))


@query(f"""WITH {S}, {P} SELECT user_id, t, {r6('(pred + value * 0.5 + 3) / 3')} AS y_pred FROM p""")
def ensemble_mean(t: Tables) -> DataFrame:
    p = predicted(t)
    models = p.select("user_id", "t", c("pred").alias("y_pred")).unionByName(p.select("user_id", "t", (c("value") * 0.5).alias("y_pred"))).unionByName(p.select("user_id", "t", F.lit(3.0).alias("y_pred")))
    return ts.ensemble(models, ["user_id", "t"]).withColumn("y_pred", rounded(c("y_pred")))
