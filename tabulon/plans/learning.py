"""Preprocessing, metrics and models on the shared tables. Queries without SQL are checked in tests/ against plain versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions.scalars import rounded
from tabulon.ml import bayes, clusters, ensembles, linear, metrics, neighbors, preprocess, selection, trees
from tabulon.plans import unrolled
from tabulon.plans.registry import Tables, query, r6

c = F.col


def part(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", c("p_size").cast("double").alias("size"), c("p_retailprice").alias("price"), "p_type", "p_brand", F.element_at(F.split("p_name", " "), 1).alias("word"))


PART = "part0 AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price, p_type, p_brand, string_split(p_name, ' ')[1] AS word FROM part)"


@query(f"SELECT l_orderkey, l_linenumber, {r6('(l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER ()')} AS l_quantity, {r6('(l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER ()')} AS l_extendedprice FROM lineitem")
def standard_scale(t: Tables) -> DataFrame:
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    out = preprocess.standard_scaler(df, ["l_quantity", "l_extendedprice"]).transform(df)
    return out.withColumns({x: rounded(c(x)) for x in ("l_quantity", "l_extendedprice")})


@query(f"SELECT c_custkey, {r6('(c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ())')} AS c_acctbal FROM customer")
def minmax_scale(t: Tables) -> DataFrame:
    df = t.customer.select("c_custkey", "c_acctbal")
    return preprocess.min_max_scaler(df, ["c_acctbal"]).transform(df).withColumn("c_acctbal", rounded(c("c_acctbal")))


@query(f"SELECT c_custkey, {r6('c_acctbal')} AS c_acctbal FROM customer")
def minmax_inverse(t: Tables) -> DataFrame:
    df = t.customer.select("c_custkey", "c_acctbal")
    s = preprocess.min_max_scaler(df, ["c_acctbal"])
    return s.inverse_transform(s.transform(df)).withColumn("c_acctbal", rounded(c("c_acctbal")))


@query(f"""WITH {PART} SELECT p_partkey, 1.0::DOUBLE AS "1", size AS X0, price AS X1, {r6('size * size')} AS "X0^2", {r6('size * price')} AS "X0 X1", {r6('price * price')} AS "X1^2" FROM part0""")
def polynomial_features(t: Tables) -> DataFrame:
    out = preprocess.polynomial_features(part(t), ["size", "price"], keep=["p_partkey"])
    return out.select("p_partkey", "1", "X0", "X1", *(rounded(c(f"`{x}`")).alias(x) for x in ("X0^2", "X0 X1", "X1^2")))


@query("SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS c_mktsegment FROM customer")
def label_encode(t: Tables) -> DataFrame:
    df = t.customer.select("c_custkey", "c_mktsegment")
    return preprocess.encoder(df, ["c_mktsegment"]).transform(df)


@query("SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS INTEGER) AS o_orderstatus, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS o_orderpriority FROM orders")
def ordinal_encode(t: Tables) -> DataFrame:
    df = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return preprocess.encoder(df, ["o_orderstatus", "o_orderpriority"]).transform(df)


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS \"o_orderstatus_F\", CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS \"o_orderstatus_O\", CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS \"o_orderstatus_P\" FROM orders")
def onehot_encode(t: Tables) -> DataFrame:
    return preprocess.encoder(t.orders, ["o_orderstatus"]).one_hot(t.orders, ["o_orderkey"])


@query("SELECT p_brand AS value, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM (SELECT DISTINCT p_brand FROM part)")
def code_table(t: Tables) -> DataFrame:
    return preprocess.code_table(t.part, "p_brand")


@query(f"""WITH x AS (SELECT l_extendedprice / 1000 AS y, l_quantity * 1.5 AS p FROM lineitem)
SELECT {r6('avg(abs(y - p))')} AS mae, {r6('avg((y - p) * (y - p))')} AS mse, {r6('1 - avg((y - p) * (y - p)) / var_pop(y)')} AS r2 FROM x""")
def regression_metrics(t: Tables) -> DataFrame:
    x = t.lineitem.select((c("l_extendedprice") / 1000).alias("y"), (c("l_quantity") * 1.5).alias("p"))
    return x.agg(rounded(metrics.mean_absolute_error("y", "p")).alias("mae"), rounded(metrics.mean_squared_error("y", "p")).alias("mse"), rounded(metrics.r2_score("y", "p")).alias("r2"))


@query(f"""WITH k AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) tp, count(*) FILTER (quality <> 1 AND toxic = 1) fp, count(*) FILTER (quality = 1 AND toxic <> 1) fn, avg(CASE WHEN quality = toxic THEN 1 ELSE 0 END) acc FROM labels)
SELECT {r6('coalesce(tp / nullif(tp + fp, 0), 0)')} AS precision, {r6('coalesce(tp / nullif(tp + fn, 0), 0)')} AS recall, {r6('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)')} AS f1, {r6('acc')} AS accuracy FROM k""")
def classification_metrics(t: Tables) -> DataFrame:
    one = metrics.precision_recall_f1(t.labels, "quality", "toxic").crossJoin(t.labels.agg(metrics.accuracy("quality", "toxic").alias("accuracy")))
    return one.select(*(rounded(c(x)).alias(x) for x in ("precision", "recall", "f1", "accuracy")))


@query("""WITH l AS (SELECT DISTINCT quality AS v FROM labels) SELECT a.v AS truth, b.v AS predicted, count(labels.doc_id) AS n FROM l a CROSS JOIN l b LEFT JOIN labels ON quality = a.v AND toxic = b.v GROUP BY ALL""")
def confusion_matrix(t: Tables) -> DataFrame:
    return metrics.confusion_matrix(t.labels, "quality", "toxic")


@query(f"""WITH n AS (SELECT label AS a, vec_id % 7 AS b, count(*)::DOUBLE AS n FROM embeddings GROUP BY ALL), s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM n) ab, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) m FROM n GROUP BY a)) ra, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) m FROM n GROUP BY b)) rb, (SELECT sum(n) FROM n) t)
SELECT {r6('(ab - ra * rb / (t * (t - 1) / 2)) / ((ra + rb) / 2 - ra * rb / (t * (t - 1) / 2))')} AS ari FROM s""")
def adjusted_rand(t: Tables) -> DataFrame:
    return metrics.adjusted_rand(t.embeddings.select("label", (c("vec_id") % 7).alias("b")), "label", "b").select(rounded(c("ari")).alias("ari"))


_SUP = "p AS (SELECT s_suppkey AS k, s_acctbal / 1000 AS a, s_nationkey::DOUBLE AS b, CAST(s_nationkey % 3 AS INTEGER) AS g FROM supplier)"


def suppliers(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", (c("s_acctbal") / 1000).alias("a"), c("s_nationkey").cast("double").alias("b"), (c("s_nationkey") % 3).alias("g"))


@query(f"""WITH {_SUP}, d AS (SELECT x.k, x.g, y.g AS h, sum(sqrt((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b))) AS s, count(*) AS n FROM p x, p y GROUP BY ALL),
e AS (SELECT k, max(CASE WHEN g = h THEN s / nullif(n - 1, 0) END) AS a, max(CASE WHEN g = h THEN n END) AS n, min(CASE WHEN g <> h THEN s / n END) AS b FROM d GROUP BY 1)
SELECT k AS s_suppkey, {r6('CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END')} AS silhouette FROM e""")
def silhouette(t: Tables) -> DataFrame:
    return metrics.silhouette(suppliers(t), "s_suppkey", ["a", "b"], "g").withColumn("silhouette", rounded(c("silhouette")))


@query("SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY md5('0:' || o_orderkey), o_orderkey) <= floor(count(*) OVER () * 0.75) THEN 'train' ELSE 'test' END AS side FROM orders")
def split_exact(t: Tables) -> DataFrame:
    train, test = selection.train_test_split(t.orders.select("o_orderkey"), "o_orderkey", 0.75)
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))


_FOLDS = f"""WITH {PART}, n AS (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS r, count(*) OVER () // 5 AS k FROM part0),
f AS (SELECT size AS x, price + size * (p_partkey % 11) AS y, CASE WHEN r // k < 5 THEN r // k END AS fold FROM n), g AS (SELECT unnest(range(0, 5)) AS i),
m AS (SELECT i, avg(x) mx, stddev_pop(x) sx FROM f, g WHERE fold IS DISTINCT FROM i GROUP BY 1)"""


def _fold_rows(t: Tables) -> DataFrame:
    return part(t).select("p_partkey", "size", (c("price") + c("size") * (c("p_partkey") % 11)).alias("y"))


@query(f"""{_FOLDS}, s AS (SELECT i, count(*) n, sum(y) sy, sum((x - mx) / sx * y) szy, any_value(mx) mx, any_value(sx) sx FROM f JOIN m ON fold IS DISTINCT FROM i GROUP BY 1)
SELECT CAST(i AS INTEGER) AS fold, {r6('1 - avg((y - sy / n - (x - mx) / sx * szy / n) * (y - sy / n - (x - mx) / sx * szy / n)) / var_pop(y)')} AS r2 FROM f JOIN s ON fold = i GROUP BY i""")
def cv_folds_r2(t: Tables) -> DataFrame:
    df = _fold_rows(t)
    scores = selection.cross_val_score(lambda d: linear.linear_regression(d, ["size"], "y"), lambda m, d: m.score(d, "y"), df, ["p_partkey"], 5)
    return df.sparkSession.createDataFrame(list(enumerate(scores)), "fold int, r2 double").withColumn("r2", rounded(c("r2")))


@query(f"""{_FOLDS}, al AS (SELECT unnest([1.0, 100.0, 10000.0])::DOUBLE AS alpha), s AS (SELECT alpha, i, sum(y) / (count(*) + alpha) b0, sum((x - mx) / sx * y) / (count(*) + alpha) b1, any_value(mx) mx, any_value(sx) sx FROM al, f JOIN m ON fold IS DISTINCT FROM i GROUP BY alpha, i),
q AS (SELECT alpha, i, 1 - avg((y - b0 - (x - mx) / sx * b1) * (y - b0 - (x - mx) / sx * b1)) / var_pop(y) AS r2 FROM f JOIN s ON fold = i GROUP BY alpha, i)
SELECT alpha, {r6('avg(r2)')} AS score, avg(r2) = max(avg(r2)) OVER () AS best FROM q GROUP BY alpha""")
def grid_search_best(t: Tables) -> DataFrame:
    df = _fold_rows(t)
    search = selection.GridSearchCV(lambda d, alpha: linear.ridge(d, ["size"], "y", alpha), {"alpha": [1.0, 100.0, 10000.0]}, lambda m, d: m.score(d, "y")).fit(df, ["p_partkey"])
    rows = [(p["alpha"], s, p == search.best_param) for p, s in search.scores]
    return df.sparkSession.createDataFrame(rows, "alpha double, score double, best boolean").withColumn("score", rounded(c("score")))


@query(f"WITH {PART}, m AS (SELECT regr_slope(price, size) s, regr_intercept(price, size) i FROM part0) SELECT p_partkey, {r6('i + s * size')} AS prediction FROM part0, m")
def ols_one_feature(t: Tables) -> DataFrame:
    df = part(t)
    return linear.linear_regression(df, ["size"], "price").transform(df).select("p_partkey", rounded(c("prediction")).alias("prediction"))


@query(f"""WITH x AS (SELECT l_quantity q, l_discount d, l_extendedprice / 1000 y FROM lineitem), k AS (SELECT covar_pop(q, q) a, covar_pop(q, d) b, covar_pop(d, d) e, covar_pop(q, y) u, covar_pop(d, y) v, avg(q) mq, avg(d) md, avg(y) my FROM x),
w AS (SELECT *, (u * e - v * b) / (a * e - b * b) AS b1, (v * a - u * b) / (a * e - b * b) AS b2 FROM k)
SELECT {r6('my - b1 * mq - b2 * md')} AS intercept, {r6('b1')} AS b_quantity, {r6('b2')} AS b_discount FROM w""")
def ols_two_feature(t: Tables) -> DataFrame:
    df = t.lineitem.select(c("l_quantity").alias("q"), c("l_discount").alias("d"), (c("l_extendedprice") / 1000).alias("y"))
    m = linear.linear_regression(df, ["q", "d"], "y", normalize=False)
    return df.sparkSession.createDataFrame([tuple(m.theta)], "intercept double, b_quantity double, b_discount double").select(*(rounded(c(x)).alias(x) for x in ("intercept", "b_quantity", "b_discount")))


@query(f"""WITH {PART}, m AS (SELECT avg(size) mx, stddev_pop(size) sx FROM part0), s AS (SELECT sum(price) / (count(*) + 2.5) b0, sum((size - mx) / sx * price) / (count(*) + 2.5) b1 FROM part0, m)
SELECT p_partkey, {r6('b0 + b1 * (size - mx) / sx')} AS prediction FROM part0, m, s""")
def ridge_one_feature(t: Tables) -> DataFrame:
    df = part(t)
    return linear.ridge(df, ["size"], "price", alpha=2.5).transform(df).select("p_partkey", rounded(c("prediction")).alias("prediction"))


_MOMENTS = f"""{PART}, zs AS (SELECT (size - avg(size) OVER ()) / stddev_pop(size) OVER () AS z1, (price - avg(price) OVER ()) / stddev_pop(price) OVER () AS z2, p_partkey::DOUBLE AS y FROM part0),
s AS (SELECT count(*)::DOUBLE AS n, sum(y * y) AS yy, sum(y) AS zy0, sum(z1 * y) AS zy1, sum(z2 * y) AS zy2, count(*)::DOUBLE AS zz00, sum(z1) AS zz01, sum(z2) AS zz02, sum(z1 * z1) AS zz11, sum(z1 * z2) AS zz12, sum(z2 * z2) AS zz22 FROM zs)"""
_WEIGHTS = ", ".join(f"floor({t} * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE AS {n}" for t, n in (("t0", "intercept"), ("t1", "b_size"), ("t2", "b_price")))


def _weights(df: DataFrame, theta: list[float]) -> DataFrame:
    """To three places: numeric gradients are no finer."""
    out = df.sparkSession.createDataFrame([tuple(theta)], "intercept double, b_size double, b_price double")
    return out.select(*(rounded(c(x), 3).alias(x) for x in out.columns))


@query(f"WITH RECURSIVE {_MOMENTS}, {unrolled.descent('s', 2, 'lasso', alpha=1.0)} SELECT {_WEIGHTS} FROM d ORDER BY i DESC LIMIT 1")
def lasso_gd(t: Tables) -> DataFrame:
    return _weights(t.part, linear.lasso(part(t), ["size", "price"], "p_partkey", alpha=1.0).theta)


@query(f"WITH RECURSIVE {_MOMENTS}, {unrolled.descent('s', 2, 'plain')} SELECT {_WEIGHTS} FROM d ORDER BY i DESC LIMIT 1")
def linear_gd(t: Tables) -> DataFrame:
    return _weights(t.part, linear.linear_regression(part(t), ["size", "price"], "p_partkey", solver="gd").theta)


@query(f"WITH RECURSIVE {_MOMENTS}, {unrolled.descent('s', 2, 'lasso')} SELECT {_WEIGHTS} FROM d ORDER BY i DESC LIMIT 1")
def linear_gd_numeric(t: Tables) -> DataFrame:
    """Descent along numeric gradients."""
    return _weights(t.part, linear.linear_regression(part(t), ["size", "price"], "p_partkey", solver="gd", gradient="debug").theta)


def _steps(n: int) -> str:
    """n descent steps of the one-feature logistic regression, each a table of one row."""
    out = ["t0 AS (SELECT 1.0::DOUBLE AS a, 1.0::DOUBLE AS b)"]
    for i in range(n):
        out.append(f"t{i + 1} AS (SELECT any_value(a) - 0.001 * sum(1 / (1 + exp(-(a + b * z))) - y) AS a, any_value(b) - 0.001 * sum((1 / (1 + exp(-(a + b * z))) - y) * z) AS b FROM x, t{i})")
    return ", ".join(out)


@query(f"""WITH j AS (SELECT doc_id, n_chars, quality::DOUBLE AS y FROM labels JOIN documents USING (doc_id)), x AS (SELECT doc_id, y, (n_chars - avg(n_chars) OVER ()) / stddev_pop(n_chars) OVER () AS z FROM j), {_steps(4)}
SELECT doc_id, {r6('1 / (1 + exp(-(a + b * z)))')} AS p FROM x, t4""")
def logistic_gd(t: Tables) -> DataFrame:
    df = t.labels.join(t.documents.select("doc_id", c("n_chars").cast("double").alias("n_chars")), "doc_id")
    m = linear.logistic_regression(df, ["n_chars"], "quality", n_iters=4, alpha=0.001)
    return m.transform(df, "p").select("doc_id", rounded(c("p")).alias("p"))


@query(f"""WITH {PART}, k AS (SELECT p_type, count(*) / (SELECT count(*) FROM part0) AS prior, avg(size) ms, stddev_pop(size) ss, avg(price) mp, stddev_pop(price) sp FROM part0 GROUP BY 1),
s AS (SELECT p_partkey, k.p_type AS class, ln(prior) - 0.5 * ((size - ms) / ss) ** 2 - ln(ss) - 0.5 * ((price - mp) / sp) ** 2 - ln(sp) AS score FROM part0, k),
e AS (SELECT p_partkey, class, exp(score - max(score) OVER (PARTITION BY p_partkey)) AS e FROM s)
SELECT p_partkey, class, {r6('e / sum(e) OVER (PARTITION BY p_partkey)')} AS probability FROM e""")
def gaussian_nb_predict(t: Tables) -> DataFrame:
    df = part(t)
    return bayes.gaussian_nb(df, ["size", "price"], "p_type").transform(df, "p_partkey").select("p_partkey", "class", rounded(c("probability")).alias("probability"))


@query(f"""WITH {PART}, l AS (SELECT p_partkey, p_type, 'p_brand' AS f, p_brand AS v FROM part0 UNION ALL SELECT p_partkey, p_type, 'word', word FROM part0), n AS (SELECT p_type, count(*) n FROM part0 GROUP BY 1), k AS (SELECT f, count(DISTINCT v) k FROM l GROUP BY 1), cc AS (SELECT p_type, f, v, count(*) m FROM l GROUP BY ALL),
s AS (SELECT l.p_partkey, n.p_type AS class, sum(ln((1 + coalesce(m, 0)) / (n + k))) + ln(any_value(n) / (SELECT count(*) FROM part0)) AS score FROM l CROSS JOIN n JOIN k USING (f) LEFT JOIN cc ON cc.p_type = n.p_type AND cc.f = l.f AND cc.v = l.v GROUP BY l.p_partkey, n.p_type),
e AS (SELECT p_partkey, class, exp(score - max(score) OVER (PARTITION BY p_partkey)) AS e FROM s)
SELECT p_partkey, class, {r6('e / sum(e) OVER (PARTITION BY p_partkey)')} AS probability FROM e""")
def categorical_nb_predict(t: Tables) -> DataFrame:
    df = part(t)
    return bayes.categorical_nb(df, ["p_brand", "word"], "p_type").transform(df, "p_partkey").select("p_partkey", "class", rounded(c("probability")).alias("probability"))


_KNN = """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), d AS (SELECT q.vec_id, t.label, list_distance(q.e, t.e) AS d FROM v q, v t WHERE q.vec_id % 5 = 0 AND t.vec_id % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.e, t.e), t.vec_id) <= 5)"""


# rows are held out by their id; both parts are whole
@query(f"{_KNN} SELECT vec_id, label AS prediction, {r6('n / 5.0')} AS probability FROM (SELECT vec_id, label, count(*) AS n FROM d GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, label) = 1")
def knn_classify(t: Tables) -> DataFrame:
    e = t.embeddings
    out = neighbors.knn_classify(e.filter("vec_id % 5 = 0"), e.filter("vec_id % 5 <> 0"), "vec_id", ["embedding"], "label", 5)
    return out.withColumn("probability", rounded(c("probability")))


@query(f"{_KNN} SELECT vec_id, {r6('sum(label / d) / sum(1 / d)')} AS prediction FROM d GROUP BY 1")
def knn_regress(t: Tables) -> DataFrame:
    e = t.embeddings
    out = neighbors.knn_regress(e.filter("vec_id % 5 = 0"), e.filter("vec_id % 5 <> 0"), "vec_id", ["embedding"], "label", 5, "distance")
    return out.withColumn("prediction", rounded(c("prediction")))


def _class_sums(t: Tables) -> tuple[DataFrame, list[str]]:
    kinds = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
    df = part(t).withColumns({"node": F.lit(0), "n": F.lit(1.0)} | {f"s{i}": (c("p_type") == k).cast("double") for i, k in enumerate(kinds)})
    return df, [f"s{i}" for i in range(len(kinds))]


@query(f"""WITH {PART}, l AS (SELECT 0 AS f, p_brand AS value, p_type FROM part0 UNION ALL SELECT 1, word, p_type FROM part0), a AS (SELECT f, value, p_type, count(*)::DOUBLE AS a FROM l GROUP BY ALL), n AS (SELECT f, value, sum(a) AS n, sum(a * a) AS aa FROM a GROUP BY ALL), tot AS (SELECT p_type, count(*)::DOUBLE AS t FROM part0 GROUP BY 1), tt AS (SELECT sum(t) AS t, sum(t * t) AS sq FROM tot),
x AS (SELECT a.f, a.value, sum(2 * a.a * tot.t) AS cross2 FROM a JOIN tot USING (p_type) GROUP BY ALL)
SELECT CAST(n.f AS INTEGER) AS f, n.value, n AS n_left, tt.t - n AS n_right, {r6('((n - aa / n) + ((tt.t - n) - (sq - cross2 + aa) / nullif(tt.t - n, 0))) / tt.t')} AS quality FROM n JOIN x ON x.f = n.f AND x.value = n.value, tt""")
def tree_stump_gini(t: Tables) -> DataFrame:
    df, sums = _class_sums(t)
    return trees.split_table(df, ["p_brand", "word"], sums, "gini", continuous=False).select("f", "value", "n_left", "n_right", rounded(c("quality")).alias("quality"))


@query(f"""WITH {PART}, b AS (SELECT size AS v, count(*)::DOUBLE AS n, sum(price - (SELECT avg(price) FROM part0)) AS s, sum((price - (SELECT avg(price) FROM part0)) ** 2) AS q FROM part0 GROUP BY 1),
w AS (SELECT (v + lead(v) OVER (ORDER BY v)) / 2 AS value, sum(n) OVER (ORDER BY v) AS n, sum(s) OVER (ORDER BY v) AS s, sum(q) OVER (ORDER BY v) AS q, sum(n) OVER () AS tn, sum(s) OVER () AS ts, sum(q) OVER () AS tq FROM b)
SELECT CAST(0 AS INTEGER) AS f, value, n AS n_left, tn - n AS n_right, {r6('(n * (q - s * s / n) + (tn - n) * (tq - q - (ts - s) * (ts - s) / (tn - n))) / tn')} AS quality FROM w WHERE value IS NOT NULL""")
def tree_stump_sse(t: Tables) -> DataFrame:
    df = part(t)
    mean = df.agg(F.avg("price")).first()[0]
    y = c("price") - F.lit(mean)
    held = df.withColumns({"node": F.lit(0), "n": F.lit(1.0), "s0": y, "s1": y * y})
    return trees.split_table(held, ["size"], ["s0", "s1"], "sse", continuous=True).select("f", "value", "n_left", "n_right", rounded(c("quality")).alias("quality"))


@query(f"""WITH {PART}, l AS (SELECT 0 AS f, p_brand AS value, p_type FROM part0 UNION ALL SELECT 1, word, p_type FROM part0), a AS (SELECT f, value, p_type, count(*)::DOUBLE AS a FROM l GROUP BY ALL), n AS (SELECT *, sum(a) OVER (PARTITION BY f, value) AS n, sum(a) OVER (PARTITION BY f) AS t FROM a), h AS (SELECT sum(-a / t * ln(a / t)) AS h FROM (SELECT a, sum(a) OVER () AS t FROM (SELECT p_type, count(*)::DOUBLE AS a FROM part0 GROUP BY 1)))
SELECT CAST(f AS INTEGER) AS f, {r6('any_value(h) - sum(-a * ln(a / n)) / any_value(t)')} AS gain FROM n, h GROUP BY f""")
def id3_root_gain(t: Tables) -> DataFrame:
    df, sums = _class_sums(t)
    return trees.gain_table(df, ["p_brand", "word"], sums).select("f", rounded(c("gain")).alias("gain"))


def _forest_rows(t: Tables) -> DataFrame:
    return part(t).withColumn("big", (c("size") * 7 + F.length("word") * 9 > 200).cast("int")).withColumn("y", c("size") * 2 + F.length("word"))


_ROWS = f"""{PART}, x AS (SELECT *, CASE WHEN size * 7 + length(word) * 9 > 200 THEN 1 ELSE 0 END AS big, size * 2 + length(word) AS target FROM part0)"""


def _tree_sql(label: str, features: list[str], depth: int, kind: str, continuous: bool, out: str = "prediction") -> str:
    made = unrolled.tree("rows0", "p_partkey", features, depth, kind, continuous)
    return f"WITH {_ROWS}, rows0 AS (SELECT *, {label} AS y, 1.0::DOUBLE AS w FROM x), {made} SELECT p_partkey, {label} AS {'big' if kind == 'gini' else 'y'}, {out} AS prediction FROM p JOIN x USING (p_partkey)"


def _forest_sql(label: str, features: list[str], n_trees: int, depth: int, kind: str) -> str:
    """Each tree over its own draw, side by side."""
    trees_ = []
    for i in range(n_trees):
        made = unrolled.tree("rows0", "p_partkey", features, depth, kind, True)
        trees_.append(f"t{i} AS MATERIALIZED (WITH rows0 AS (SELECT *, {label} AS y, {unrolled.drawn('p_partkey', i)} AS w FROM x), {made} SELECT p_partkey, prediction FROM p)")
    every = " UNION ALL ".join(f"SELECT * FROM t{i}" for i in range(n_trees))
    out = r6("avg(prediction)") if kind == "sse" else "CASE WHEN 2 * sum(prediction) > count(*) THEN 1 ELSE 0 END"
    return f"WITH {_ROWS}, {', '.join(trees_)} SELECT p_partkey, any_value({label}) AS {'big' if kind == 'gini' else 'y'}, {out} AS prediction FROM ({every}) JOIN x USING (p_partkey) GROUP BY p_partkey"


@query(_tree_sql("big", ["size", "word"], 3, "gini", False))
def tree_classify(t: Tables) -> DataFrame:
    df = _forest_rows(t)
    return trees.grow(df, ["size", "word"], "big", max_depth=3).transform(df).select("p_partkey", "big", "prediction")


@query(_tree_sql("big", ["size", "word"], 3, "gini", False))
def tree_majority(t: Tables) -> DataFrame:
    """Leaves that keep only their likeliest class."""
    df = _forest_rows(t)
    return trees.grow(df, ["size", "word"], "big", max_depth=3, leaf="majority").transform(df).select("p_partkey", "big", "prediction")


@query(_tree_sql("target", ["size", "price"], 3, "sse", True, r6("prediction")))
def tree_regress(t: Tables) -> DataFrame:
    df = _forest_rows(t)
    return trees.grow(df, ["size", "price"], "y", "regress", max_depth=3).transform(df).select("p_partkey", "y", rounded(c("prediction")).alias("prediction"))


@query(_tree_sql("target", ["size", "price"], 2, "sse", True, "floor(prediction)"))
def tree_regress_integers(t: Tables) -> DataFrame:
    """Leaves cut to integers."""
    df = _forest_rows(t)
    return trees.grow(df, ["size", "price"], "y", "regress", max_depth=2).transform(df, legacy_int=True).select("p_partkey", "y", c("prediction").cast("double").alias("prediction"))


@query(f"WITH {_ROWS}, rows0 AS (SELECT *, big AS y FROM x), {unrolled.id3('rows0', 'p_partkey', ['p_type', 'word'], 2)} SELECT p_partkey, big, prediction FROM p JOIN x USING (p_partkey)")
def tree_id3(t: Tables) -> DataFrame:
    df = _forest_rows(t)
    return trees.grow_id3(df, ["p_type", "word"], "big", max_depth=2).transform(df).select("p_partkey", "big", "prediction")


@query(_tree_sql("big", ["size", "price"], 3, "gini", True))
def tree_continuous(t: Tables) -> DataFrame:
    df = _forest_rows(t)
    return trees.grow(df, ["size", "price"], "big", continuous=True, max_depth=3).transform(df).select("p_partkey", "big", "prediction")


@query(_forest_sql("big", ["size", "price"], 5, 2, "gini"))
def forest_classify(t: Tables) -> DataFrame:
    df = _forest_rows(t)
    return trees.grow_forest(df, ["size", "price"], "big", "p_partkey", 5, continuous=True, max_depth=2).transform(df).select("p_partkey", "big", "prediction")


@query(_forest_sql("target", ["size", "price"], 5, 2, "sse"))
def forest_regress(t: Tables) -> DataFrame:
    df = _forest_rows(t)
    return trees.grow_forest(df, ["size", "price"], "y", "p_partkey", 5, "regress", max_depth=2).transform(df).select("p_partkey", "y", rounded(c("prediction")).alias("prediction"))


def _assign(i: int) -> str:
    return f"a{i} AS (SELECT p.*, arg_min(m.j, sqrt((p.a - m.a) ** 2 + (p.b - m.b) ** 2)) AS j FROM p, m{i} m GROUP BY ALL)"


@query(f"""WITH {_SUP}, m0 AS (SELECT CAST(k AS INTEGER) AS j, a, b FROM p WHERE k < 3), {_assign(0)}, m1 AS (SELECT j, avg(a) a, avg(b) b FROM a0 GROUP BY 1), {_assign(1)}, m2 AS (SELECT j, avg(a) a, avg(b) b FROM a1 GROUP BY 1), {_assign(2)}
SELECT k AS s_suppkey, j AS cluster FROM a2""")
def kmeans_two_rounds(t: Tables) -> DataFrame:
    df = suppliers(t)
    init = [[r.a, r.b] for r in df.filter("s_suppkey < 3").orderBy("s_suppkey").collect()]
    return clusters.kmeans(df, ["a", "b"], 3, max_iter=2, init=init).transform(df).select("s_suppkey", "cluster")


def _boosted_sql(rounds: int, rate: float, depth: int) -> str:
    """Trees over what those before them leave."""
    made = ["b0 AS MATERIALIZED (SELECT p_partkey, size, price, target, avg(target) OVER () AS f FROM x)"]
    for i in range(rounds):
        grown = unrolled.tree("rows0", "p_partkey", ["size", "price"], depth, "sse", True)
        made.append(f"t{i} AS MATERIALIZED (WITH rows0 AS (SELECT *, target - f AS y, 1.0::DOUBLE AS w FROM b{i}), {grown} SELECT p_partkey, prediction FROM p)")
        made.append(f"b{i + 1} AS MATERIALIZED (SELECT b.* EXCLUDE (f), f + {rate}::DOUBLE * prediction AS f FROM b{i} b JOIN t{i} USING (p_partkey))")
    return f"WITH {_ROWS}, {', '.join(made)} SELECT p_partkey, {r6('f')} AS prediction FROM b{rounds}"


def _adaboost_sql(rounds: int) -> str:
    made = ["b0 AS MATERIALIZED (SELECT p_partkey, size, price, big, 1.0::DOUBLE AS w, 0.0::DOUBLE AS votes FROM x)"]
    for i in range(rounds):
        grown = unrolled.tree("rows0", "p_partkey", ["size", "price"], 1, "gini", True)
        made.append(f"t{i} AS MATERIALIZED (WITH rows0 AS (SELECT *, big AS y FROM b{i}), {grown} SELECT p_partkey, prediction FROM p)")
        made.append(f"e{i} AS MATERIALIZED (SELECT sum(CASE WHEN prediction <> big THEN w ELSE 0 END) / sum(w) AS e FROM b{i} JOIN t{i} USING (p_partkey))")
        made.append(f"b{i + 1} AS MATERIALIZED (SELECT b.* EXCLUDE (w, votes), w * CASE WHEN prediction <> big THEN (1 - e) / e ELSE 1 END / (2 * (1 - e)) AS w, votes + ln((1 - e) / e) * (2 * prediction - 1) AS votes FROM b{i} b JOIN t{i} USING (p_partkey), e{i})")
    return f"WITH {_ROWS}, {', '.join(made)} SELECT p_partkey, big, CASE WHEN votes > 0 THEN 1 ELSE 0 END AS prediction FROM b{rounds}"


@query(_boosted_sql(4, 0.5, 2))
def gradient_boosting(t: Tables) -> DataFrame:
    df = _forest_rows(t)
    return ensembles.gradient_boosting(df, ["size", "price"], "y", 4, 0.5, 2).transform(df).select("p_partkey", rounded(c("prediction")).alias("prediction"))


@query(_adaboost_sql(4))
def adaboost_stumps(t: Tables) -> DataFrame:
    df = _forest_rows(t)
    return ensembles.adaboost(df, ["size", "price"], "big", 4).transform(df).select("p_partkey", "big", "prediction")


@query(f"SELECT l_orderkey, l_linenumber, {r6('(l_extendedprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_pop(o_totalprice) FROM orders)')} AS price FROM lineitem")
def scaler_on_another_table(t: Tables) -> DataFrame:
    """Fitted on one table, carried as JSON, used on another."""
    s = preprocess.standard_scaler(t.orders.select(c("o_totalprice").alias("price")), ["price"])
    rows = t.lineitem.select("l_orderkey", "l_linenumber", c("l_extendedprice").alias("price"))
    return preprocess.Fitted.from_json(s.to_json()).transform(rows).withColumn("price", rounded(c("price")))


def _starts(k: int, seed: int) -> list[list[float]]:
    """Where k-means starts in the bounding box of two features."""
    import numpy as np

    return np.random.default_rng(seed).random((k, 2)).tolist()


def _silhouette_of(name: str) -> str:
    near = f"d{name} AS (SELECT x.k, x.j AS g, y.j AS h, sum(sqrt((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b))) AS s, count(*) AS n FROM {name}c x, {name}c y GROUP BY ALL)"
    return f"{near}, e{name} AS (SELECT k, max(CASE WHEN g = h THEN s / nullif(n - 1, 0) END) AS a, max(CASE WHEN g = h THEN n END) AS n, min(CASE WHEN g <> h THEN s / n END) AS b FROM d{name} GROUP BY 1)"


@query(f"WITH {_SUP}, {unrolled.kmeans('p', 'k', _starts(4, 3), 20)} SELECT k AS s_suppkey, CAST(j AS INTEGER) AS cluster FROM mc")
def kmeans_full(t: Tables) -> DataFrame:
    df = suppliers(t)
    return clusters.kmeans(df, ["a", "b"], 4, max_iter=20, seed=3).transform(df).select("s_suppkey", "cluster")


_BEST = ", ".join(f"{unrolled.kmeans('p', 'k', _starts(k, 1), 25, f'm{k}_')}, {_silhouette_of(f'm{k}_')}" for k in (2, 3, 4))
_EACH = " UNION ALL ".join(f"SELECT {k} AS k, avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM em{k}_" for k in (2, 3, 4))


@query(f"WITH {_SUP}, {_BEST}, s AS ({_EACH}) SELECT CAST(k AS INTEGER) AS k, {r6('silhouette')} AS silhouette, silhouette = max(silhouette) OVER () AS best FROM s")
def kmeans_best_k(t: Tables) -> DataFrame:
    df = suppliers(t)
    best, scores = clusters.best_k(df, "s_suppkey", ["a", "b"], [2, 3, 4], seed=1, max_iter=25)
    return df.sparkSession.createDataFrame([(k, s, k == best) for k, s in scores.items()], "k int, silhouette double, best boolean").withColumn("silhouette", rounded(c("silhouette")))


@query(f"""WITH x AS (SELECT l_quantity q, l_discount * 100 d FROM lineitem), s AS (SELECT covar_pop(q, q) * count(*) a, covar_pop(q, d) * count(*) b, covar_pop(d, d) * count(*) e FROM x),
v AS (SELECT *, (a + e) / 2 + sqrt(((a - e) / 2) ** 2 + b * b) AS v1, (a + e) / 2 - sqrt(((a - e) / 2) ** 2 + b * b) AS v2 FROM s)
SELECT CAST(0 AS INTEGER) AS component, {r6('v1 / 1000000')} AS variance, {r6('v1 / (v1 + v2)')} AS ratio FROM v UNION ALL SELECT CAST(1 AS INTEGER), {r6('v2 / 1000000')}, {r6('v2 / (v1 + v2)')} FROM v""")
def pca_two_dims(t: Tables) -> DataFrame:
    df = t.lineitem.select(c("l_quantity").alias("q"), (c("l_discount") * 100).alias("d"))
    p = clusters.pca(df, ["q", "d"])
    rows = [(i, v / 1e6, r) for i, (v, r) in enumerate(zip(p.explained_variance, p.explained_variance_ratio))]
    return df.sparkSession.createDataFrame(rows, "component int, variance double, ratio double").select("component", rounded(c("variance")).alias("variance"), rounded(c("ratio")).alias("ratio"))


@query()
def boosted_price(t: Tables) -> DataFrame:
    df = part(t)
    return ensembles.boosted_regressor(df, ["size", "p_partkey"], "price", rounds=5)(df).select("p_partkey", "price", "prediction")


@query()
def perceptron_direction(t: Tables) -> DataFrame:
    from tabulon.operators.timeseries import sliding_windows
    from tabulon.plans.series import series

    w = sliding_windows(series(t), "user_id", "t", ["value"], 5, 1, "value")
    flat = w.select("user_id", "start", *(F.get("x", F.lit(i)).alias(f"x{i}") for i in range(5)), (F.get("y", F.lit(0)) > F.get("x", F.lit(4))).cast("double").alias("up"))
    return ensembles.direction_classifier(flat, [f"x{i}" for i in range(5)], "up", (8,), 20)(flat).select("user_id", "start", "up", "prediction")


_AHEAD = ", ".join(f"lead(value, {i}) OVER o AS {f'x{i}' if i < 6 else f'y{i - 6}'}" for i in range(9))
_WINDOWS = f"""steps AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value FROM events),
windows AS MATERIALIZED (SELECT user_id, t AS start, user_id || ':' || t AS id, 1.0::DOUBLE AS w, * EXCLUDE (user_id, t, value) FROM (SELECT user_id, t, value, {_AHEAD} FROM steps WINDOW o AS (PARTITION BY user_id ORDER BY t)) WHERE y2 IS NOT NULL)"""


@query(f"""WITH {_WINDOWS}, {unrolled.tree("windows", "id", [f"x{i}" for i in range(6)], 2, "sse", True, ["y0", "y1", "y2"])}
SELECT user_id, start, CAST(h AS INTEGER) AS horizon, {r6("prediction[h + 1]")} AS prediction FROM p JOIN windows USING (id), range(3) r(h)""")
def horizon_forecast(t: Tables) -> DataFrame:
    """All steps ahead from one tree, whose leaves are vectors."""
    from tabulon.operators.timeseries import sliding_windows
    from tabulon.plans.series import series

    windows = sliding_windows(series(t), "user_id", "t", ["value"], 6, 3, "value")
    model = ensembles.multi_output_trees(windows, "x", "y", 6, 3, max_depth=2)
    ahead = ensembles.forecast_windows(model, windows.select("user_id", "start", "x"), "x")
    return ahead.select("user_id", "start", F.posexplode("prediction").alias("horizon", "prediction")).withColumn("prediction", rounded(c("prediction")))
