"""Nearest-neighbour classification and regression by brute force in blocks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.storage import new_path, stored

#: Rows of the side that is sent to every task at once; train rows that a task takes at once; sides of a tile of distances.
BLOCK, BATCH, TILE = 20_000, 8_192, (1_024, 2_048)
#: Stands for a distance to or from a vector with a gap.
FAR = 1e300
#: Products are taken in single precision where their rounding is at most this part of the k-th squared distance.
FINE = 0.01


def _vectors(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of an Arrow array column as doubles, zeros for one with a gap, and which have none. Width 0: that of the first row."""
    known = column.is_valid().to_numpy(zero_copy_only=False)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)[known].astype(np.int64)
    width = width or (int(lengths[0]) if len(lengths) else 0)
    if (lengths != width).any():
        raise ValueError("vectors differ in length")
    out = np.full((len(column), width), np.nan)
    out[known] = column.flatten().cast("double").to_numpy(zero_copy_only=False).reshape(len(lengths), width)
    whole = known & ~np.isnan(out).any(axis=1)
    out[~whole] = 0.0
    return out + 0.0, whole


def _sum_of_powers(a, b, p: float):
    """Of the differences of a and b, given by dimension, in order: the same for a tile as for single pairs."""
    total = 0.0
    for x, y in zip(a, b):
        e = np.abs(x - y)
        total = total + (e * e if p == 2 else e**p)
    return total


def _rank(order: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Place of each row within its group, both in the given order, which has groups together."""
    g = group[order]
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    return np.arange(len(g)) - np.repeat(first, np.diff(np.r_[first, len(g)]))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a @ b


class _Nearest:
    """The k nearest of all train rows met so far, for each query of a block; ties go to the smallest train key."""

    def __init__(self, queries: np.ndarray, whole: np.ndarray, k: int, p: float):
        self.q, self.whole, self.k, self.p = queries, whole, k, p
        self.norm = (queries * queries).sum(axis=1)
        self.turned = np.ascontiguousarray(queries.T)
        self.distance = np.full((len(queries), k), np.inf)
        self.at = np.full((len(queries), k), -1, dtype=np.int64)  # rows of `held`; -1: none yet
        self.held = None

    def meet(self, table) -> None:
        """Takes train rows: columns _t, _b and others."""
        import pyarrow as pa
        import pyarrow.compute as pc

        b, whole = _vectors(table["_b"].combine_chunks(), self.q.shape[1])
        if not self.q.shape[1]:
            b, whole = np.zeros((len(b), 0)), np.zeros(len(b), bool)
        table = table.drop_columns(["_b"])
        # of equal vectors only the k smallest keys can be among the nearest
        mark = np.ascontiguousarray(np.c_[b, whole])
        _, same = np.unique(mark.view(np.dtype((np.void, mark.shape[1] * 8))).ravel(), return_inverse=True)
        by_key = np.empty(len(b), np.int64)
        by_key[pc.sort_indices(table, sort_keys=[("_t", "ascending")], null_placement="at_start").to_numpy()] = np.arange(len(b))
        order = np.lexsort((by_key, same))
        kept = np.sort(order[_rank(order, same) < self.k])
        b, whole, table = b[kept], whole[kept], table.take(pa.array(kept))
        first = 0 if self.held is None else self.held.num_rows
        rows = table if self.held is None else pa.concat_tables([self.held, table]).combine_chunks()
        by_key = np.empty(rows.num_rows + 1, np.int64)
        by_key[pc.sort_indices(rows, sort_keys=[("_t", "ascending")], null_placement="at_start").to_numpy()] = np.arange(rows.num_rows)
        by_key[-1] = rows.num_rows
        self._tiles(b, whole, first, by_key)
        used = np.unique(self.at)
        used = used[used >= 0]
        self.at = np.where(self.at < 0, -1, np.searchsorted(used, self.at))
        self.held = rows.take(pa.array(used))

    def _tiles(self, b, whole, first, by_key) -> None:
        p, turned = self.p, np.ascontiguousarray(b.T)
        norm = (b * b).sum(axis=1)
        # products of matrices only choose whom to measure; their rounding is allowed for
        size = 16 * (b.shape[1] + 8) * (self.norm + norm.max(initial=0)) if p == 2 else np.zeros(len(self.q))
        slack, slack32 = size * 2.0**-53, size * 2.0**-24 + 1e-30
        left, right = np.c_[-2 * self.q, np.ones(len(self.q))], np.c_[b, np.where(whole, norm, FAR)].T
        single = p == 2 and self.norm.max(initial=0) + norm.max(initial=0) < 1e30
        if single:
            left32, right32 = left.astype(np.float32), np.c_[b, np.where(whole, norm, 3e38)].T.astype(np.float32)
        for y in range(0, len(self.q), TILE[0]):
            mine = np.arange(y, min(y + TILE[0], len(self.q)))
            for x in range(0, len(b), TILE[1]):
                cols, rest, pairs = slice(x, min(x + TILE[1], len(b))), mine, []
                if single:
                    rows = mine[self.whole[mine] & (slack32[mine] <= FINE * self.distance[mine, -1] ** 2)]
                    score = _product(left32[rows], right32[:, cols])
                    limit = self._limits(score, rows, slack32)
                    fine = slack32[rows] <= FINE * (limit + self.norm[rows])
                    score, limit = (score, limit) if fine.all() else (score[fine], limit[fine])
                    pairs.append((rows[fine], score, np.nextafter(limit.astype(np.float32), np.float32(np.inf))))
                    rest = np.setdiff1d(mine, rows[fine], assume_unique=True)
                if len(rest):
                    if p == 2:
                        score = _product(left[rest], right[:, cols])
                    else:
                        score = _sum_of_powers(self.turned[:, rest, None], turned[:, None, cols], p) + np.zeros((len(rest), cols.stop - x))
                        score[:, ~whole[cols]] = FAR
                    score[~self.whole[rest]] = FAR
                    pairs.append((rest, score, self._limits(score, rest, slack)))
                for rows, score, limit in pairs:
                    i, j = np.divmod(np.flatnonzero(score <= limit[:, None]), cols.stop - x)
                    if len(i):
                        self._take(rows[i], j + x, turned, whole, first, by_key)

    def _limits(self, score, rows, slack):
        """The largest score of each of the rows that may belong to one of its k nearest."""
        limit = self.distance[rows, -1] ** self.p * (1 + 1e-9) + slack[rows] - (self.norm[rows] if self.p == 2 else 0.0)
        loose = np.isinf(limit)
        if loose.any() and score.shape[1] >= self.k:
            kth = np.partition(score[loose], self.k - 1, axis=1)[:, self.k - 1].astype(np.float64)
            limit[loose] = kth + np.abs(kth) * 1e-9 + 2 * slack[rows][loose]
        return limit

    def _take(self, i, j, turned, whole, first, by_key) -> None:
        k, p = self.k, self.p
        d = _sum_of_powers((t[i] for t in self.turned), (t[j] for t in turned), p) + np.zeros(len(i))
        d = np.sqrt(d) if p == 2 else d ** (1 / p)
        d[~(self.whole[i] & whole[j])] = np.inf
        met = np.unique(i)
        q, d, at = np.r_[i, np.repeat(met, k)], np.r_[d, self.distance[met].ravel()], np.r_[j + first, self.at[met].ravel()]
        order = np.lexsort((by_key[at], d, q))
        best = order[_rank(order, q) < k]
        self.distance[met], self.at[met] = d[best].reshape(-1, k), at[best].reshape(-1, k)


def _search(sent, k: int, p: float):
    """A function for mapInArrow over train rows: of each query its k nearest among a task's rows."""

    def run(batches):
        import pyarrow as pa

        keys, queries, whole = sent.value
        found, waiting, n = _Nearest(queries, whole, k, p), [], 0
        for batch in batches:
            waiting.append(batch)
            n += batch.num_rows
            if n >= BATCH:
                found.meet(pa.Table.from_batches(waiting))
                waiting, n = [], 0
        if n:
            found.meet(pa.Table.from_batches(waiting))
        for a in range(0, len(queries) if found.held is not None else 0, 2_000):
            at = found.at[a : a + 2_000]
            q, r = np.nonzero(at >= 0)
            d = found.distance[a : a + 2_000][q, r]
            near = found.held.take(pa.array(at[q, r]))
            made = [keys.take(pa.array(q + a)), pa.array(d, mask=np.isinf(d)), *near.columns]
            yield from pa.Table.from_arrays(made, ["_q", "distance", *near.column_names]).to_batches()

    return run


def neighbours(queries: DataFrame, train: DataFrame, key: str, features: Sequence[str], k: int = 5, p: float = 2, carry: Sequence[str] = (), train_key: str | None = None) -> DataFrame:
    """key, rank, train_key, distance and the carried train columns of each query's k nearest rows, ties by the train key.

    Queries are taken in blocks of at most about BLOCK rows, each sent to the tasks that hold the train rows;
    every task keeps only the k best of each query before anything is moved. Blocks run one after another and
    each writes its rows to the shared folder, so no plan grows with their number. A vector with a gap is beyond all others.
    """
    t = train_key or key
    vector = F.array(*(F.col(c).cast("double") for c in features)) if len(features) > 1 else F.col(features[0]) if dict(train.dtypes)[features[0]].startswith("array") else F.array(F.col(features[0]).cast("double"))
    right = train.select(F.col(t).alias("_t"), vector.alias("_b"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(carry)))
    left = queries.select(F.col(key).alias("_q"), vector.alias("_a"))
    spark = train.sparkSession
    parts = left.count() // BLOCK + 1
    if parts > 1:
        left = stored(left.withColumn("_block", F.pmod(F.xxhash64("_q"), F.lit(parts))).sortWithinPartitions("_block"), "queries")
    right = right.repartition(spark.sparkContext.defaultParallelism)
    kinds = T.StructType([left.schema["_q"], T.StructField("distance", T.DoubleType()), *(f for f in right.schema if f.name != "_b")])
    order = Window.partitionBy("_q").orderBy(F.col("distance").asc_nulls_last(), "_t")
    paths = []
    for i in range(parts):
        block = (left if parts == 1 else left.filter(F.col("_block") == i)).select("_q", "_a").toArrow()
        sent = spark.sparkContext.broadcast((block["_q"].combine_chunks(), *_vectors(block["_a"].combine_chunks(), 0)))
        met = right.mapInArrow(_search(sent, k, p), kinds)
        best = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        if parts > 1:
            paths.append(new_path(spark, "neighbours"))
            stored(best, "neighbours", paths[-1])
            sent.unpersist()
    out = spark.read.schema(best.schema).parquet(*paths) if paths else best
    return out.select(F.col("_q").alias(key), "rank", F.col("_t").alias("neighbour"), "distance", *(F.col(f"_{i}").alias(c) for i, c in enumerate(carry)))


def _weighted(near: DataFrame, key: str, weights: str) -> DataFrame:
    if weights not in ("uniform", "distance"):
        raise ValueError("weights are uniform or distance")
    if weights == "uniform":
        return near.withColumn("_w", F.lit(1.0))
    exact = F.max((F.col("distance") == 0).cast("int")).over(Window.partitionBy(key))
    return near.withColumn("_w", F.when(exact == 1, (F.col("distance") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), F.col("distance"))))


def _enough(train: DataFrame, k: int) -> None:
    if train.limit(k).count() < k:
        raise ValueError(f"fewer than {k} rows to learn from")


def knn_classify(queries: DataFrame, train: DataFrame, key: str, features: Sequence[str], label: str, k: int = 5, weights: str = "uniform", p: float = 2, train_key: str | None = None) -> DataFrame:
    """key, prediction, probability; of equal votes the smallest class. A distance of 0 takes all the weight."""
    _enough(train, k)
    near = _weighted(neighbours(queries, train, key, features, k, p, [label], train_key), key, weights)
    votes = near.groupBy(key, label).agg(F.sum("_w").alias("v"))
    w = Window.partitionBy(key)
    ranked = votes.withColumn("probability", F.col("v") / F.sum("v").over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.col("v").desc(), label)))
    return ranked.filter("_r = 1").select(key, F.col(label).alias("prediction"), "probability")


def knn_regress(queries: DataFrame, train: DataFrame, key: str, features: Sequence[str], label: str, k: int = 5, weights: str = "uniform", p: float = 2, train_key: str | None = None) -> DataFrame:
    _enough(train, k)
    near = _weighted(neighbours(queries, train, key, features, k, p, [label], train_key), key, weights)
    return near.groupBy(key).agg((F.sum(F.col("_w") * F.col(label)) / F.sum("_w")).alias("prediction"))
