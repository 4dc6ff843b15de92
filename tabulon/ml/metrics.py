"""Scores as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.scalars import nan_to_null
from tabulon.storage import new_path, stored


def mean_absolute_error(y: str, p: str) -> Column:
    return F.avg(F.abs(F.col(y) - F.col(p)))


def mean_squared_error(y: str, p: str) -> Column:
    return F.avg((F.col(y) - F.col(p)) * (F.col(y) - F.col(p)))


def r2_score(y: str, p: str) -> Column:
    return 1 - F.try_divide(mean_squared_error(y, p), F.var_pop(y))


def accuracy(y: str, p: str) -> Column:
    return F.avg((F.col(y) == F.col(p)).cast("int"))


def precision_recall_f1(df: DataFrame, y: str, p: str, positive=1) -> DataFrame:
    """Of one class; 0 where there is nothing to divide by."""
    t, q = F.col(y) == positive, F.col(p) == positive
    s = df.agg(F.count_if(t & q).alias("tp"), F.count_if(~t & q).alias("fp"), F.count_if(t & ~q).alias("fn"))
    safe = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return s.select(safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"))


def confusion_matrix(df: DataFrame, y: str, p: str) -> DataFrame:
    """Long form (truth, predicted, n) over the labels of the truth; other predictions don't count."""
    labels = df.select(F.col(y).alias("truth")).distinct()
    cells = labels.crossJoin(labels.withColumnRenamed("truth", "predicted"))  # classes by classes
    counts = df.groupBy(F.col(y).alias("truth"), F.col(p).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return cells.join(counts, ["truth", "predicted"], "left").select("truth", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row, `ari`; 1 where there is only one way to be right."""
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    two = lambda n: F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0.0))
    n = F.col("n")
    rows = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(two(n).alias("_a"))
    cols = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(two(n).alias("_b"))
    both = cells.agg(two(n).alias("_ab"), F.coalesce(F.sum("n"), F.lit(0)).alias("_n"))
    one = both.crossJoin(rows).crossJoin(cols)  # three single rows
    expected = F.coalesce(F.try_divide(F.col("_a") * F.col("_b"), F.col("_n") * (F.col("_n") - 1) / 2), F.lit(0.0))
    top = (F.col("_a") + F.col("_b")) / 2
    return one.select(F.coalesce(F.try_divide(F.col("_ab") - expected, top - expected), F.lit(1.0)).alias("ari"))


#: Points that are sent to every task at once, and distances that a task holds at once.
BLOCK, TILE = 20_000, 2_000_000


def _points(df: DataFrame, cols: Sequence[str], clusters: Sequence[str]) -> DataFrame:
    """The rows as `_a0`, ... (NaN as NULL) and labels `_c0`, ..., after the columns named with an underscore."""
    return df.select(*(c for c in df.columns if c.startswith("_k")), *(nan_to_null(F.col(c).cast("double")).alias(f"_a{i}") for i, c in enumerate(cols)), *(F.col(c).cast("string").alias(f"_c{i}") for i, c in enumerate(clusters)))


def _distance_sums(block, n_cols: int, n_labels: int):
    """A function for mapInArrow: each point's sums of distances to the block's rows, by labelling and label."""
    import numpy as np

    r = np.column_stack([block[f"_a{i}"].to_numpy() for i in range(n_cols)]).astype(float)
    coded = []
    for x in (block[f"_c{i}"].to_pylist() for i in range(n_labels)):
        levels = sorted({v for v in x if v is not None})
        at = {v: j for j, v in enumerate(levels)} | {None: -1}
        coded.append((levels, np.array([at[v] for v in x], dtype=np.int64)))
    # rows with the same labels throughout are neighbours, so that a distance is added up once for all labellings
    order = np.lexsort([c for _, c in coded[::-1]])
    r, w, codes = r[order], block["_w"].to_numpy()[order].astype(float), [c[order] for _, c in coded]
    starts = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in codes], axis=0)]) if len(r) else np.zeros(0, int)
    whole = ~np.isnan(r).any(axis=1)
    r, near = np.where(whole[:, None], r, 0.0), np.where(whole, w, 0.0)
    n, n_whole = (np.add.reduceat(x, starts) for x in (w, near)) if len(r) else (w, near)
    folds = []
    for (levels, _), c in zip(coded, codes):
        c = c[starts]
        by = np.argsort(c, kind="stable")
        by = by[c[by] >= 0]
        if len(by):
            first = np.flatnonzero(np.r_[True, c[by][1:] != c[by][:-1]])
            folds.append((np.array(levels, dtype=object), by, first, np.add.reduceat(n[by], first), np.add.reduceat(n_whole[by], first)))
        else:
            folds.append(None)

    def run(batches):
        import pyarrow as pa

        step = max(1, TILE // max(1, len(r)))
        for batch in batches:
            left = np.column_stack([batch[f"_a{i}"].to_numpy(zero_copy_only=False) for i in range(n_cols)]).astype(float)
            ids, own = batch["_p"].to_numpy(), [np.array(batch[f"_c{i}"].to_pylist(), dtype=object) for i in range(n_labels)]
            for a in range(0, len(left) if len(r) else 0, step):
                x, d = left[a : a + step], 0.0
                for i in range(n_cols):
                    e = x[:, i, None] - r[:, i]
                    e *= e
                    d = d + e
                d = np.sqrt(d, out=d)
                d *= near
                s = np.add.reduceat(d, starts, axis=1)
                for i, fold in enumerate(folds):
                    if fold is None:
                        continue
                    levels, by, first, m, m_whole = fold
                    t = np.add.reduceat(s[:, by], first, axis=1)
                    t[:, m_whole == 0] = np.nan
                    rows, k = len(x), len(levels)
                    mine = (own[i][a : a + step, None] == levels).ravel().astype(bool)
                    out = [pa.array(np.repeat(ids[a : a + step], k)), pa.array(np.full(rows * k, i, np.int32)), pa.array(np.tile(levels, rows), pa.string()), pa.array(mine), pa.array(t.ravel(), from_pandas=True), pa.array(np.tile(m, rows).astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(out, ["_p", "_i", "_g", "_own", "s", "n"])

    return run


def _silhouettes(df: DataFrame, cols: Sequence[str], clusters: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The distinct points of `_points` (number `_p`, copies `_w`), and _p, _i, silhouette under each labelling."""
    names = [f"_a{i}" for i in range(len(cols))] + [f"_c{i}" for i in range(len(clusters))]
    distinct = df.groupBy(*names).agg(F.count(F.lit(1)).alias("_w"))
    points = stored(distinct.withColumn("_p", F.monotonically_increasing_id()), "points")
    spark = df.sparkSession
    parts, tasks, paths = points.count() // BLOCK + 1, 4 * spark.sparkContext.defaultParallelism, []
    for i in range(parts):
        block = points.filter(F.pmod("_p", F.lit(parts)) == i).toArrow()
        sums = points.repartition(tasks).mapInArrow(_distance_sums(block, len(cols), len(clusters)), "_p long, _i int, _g string, _own boolean, s double, n long")
        if parts > 1:
            paths.append(new_path(spark, "silhouette"))
            stored(sums, "silhouette", paths[-1])
    if paths:
        sums = spark.read.schema(sums.schema).parquet(*paths)
        sums = sums.groupBy("_p", "_i", "_g", "_own").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    own = F.max(F.when(F.col("_own"), F.struct(F.try_divide(F.col("s"), F.col("n") - 1).alias("m"), F.col("n").alias("n"))))
    out = sums.groupBy("_p", "_i").agg(own.alias("own"), F.min(F.when(~F.col("_own"), F.col("s") / F.col("n"))).alias("b"))
    m = F.col("own.m")
    return points, out.select("_p", "_i", F.when(F.col("own.n") == 1, F.lit(0.0)).otherwise(F.try_divide(F.col("b") - m, F.greatest("b", m))).alias("silhouette"))


def silhouette(df: DataFrame, key: str, cols: list[str], cluster: str) -> DataFrame:
    """key, silhouette: exact, by Euclidean distance; 0 for a cluster of one, NULL where there is only one cluster.

    Every distinct point meets every other, so the work grows with their square; copies count by their number. Points go
    out in blocks of about BLOCK, and each task adds up a block's distances by point and cluster before anything is moved.
    Blocks run one after another and each writes its sums to the shared folder, so no plan grows with their number.
    """
    rows = _points(df.withColumn("_k", F.col(key)), cols, [cluster])
    points, scores = _silhouettes(rows, cols, [cluster])
    names = [c for c in rows.columns if c != "_k"]
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in names]
    scored = points.join(scores, "_p", "left")
    met = rows.alias("l").join(scored.alias("r"), same, "left")
    return met.select(F.col("l._k").alias(key), F.col("r.silhouette").alias("silhouette"))


def mean_silhouettes(df: DataFrame, cols: Sequence[str], clusters: Sequence[str]) -> list[float | None]:
    """The rows' mean silhouette under each labelling; a distance is worked out once for all of them."""
    points, scores = _silhouettes(_points(df, cols, clusters), cols, clusters)
    known = scores.filter("silhouette IS NOT NULL").join(points.select("_p", "_w"), "_p")
    means = {r[0]: r[1] for r in known.groupBy("_i").agg(F.sum(F.col("silhouette") * F.col("_w")) / F.sum("_w")).collect()}
    return [means.get(i) for i in range(len(clusters))]
