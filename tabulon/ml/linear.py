"""Linear models from one pass: the sums of products of standardised features, solved on the driver.

All solvers but the logistic one need only the Gram matrix, whose size is that of the features squared.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions.scalars import dot, sigmoid
from tabulon.ml import metrics
from tabulon.ml.preprocess import Fitted, Scaled, standard_scaler


@dataclass(frozen=True)
class Gram:
    """Over z = (1, features): n, z'z, z'y, y'y."""

    n: int
    zz: np.ndarray
    zy: np.ndarray
    yy: float

    def rises(self, theta: np.ndarray, step: float) -> np.ndarray:
        """What the mean squared error gains for each weight that is more by step, multiplied out: subtracting two errors
        leaves only rounding where they are large against their difference."""
        return step * (2 * (self.zz @ theta - self.zy) + step * np.diag(self.zz)) / self.n


def gram(df: DataFrame, features: Sequence[str], label: str | None = None) -> Gram:
    z = [F.lit(1.0), *(F.col(c).cast("double") for c in features)]
    y = F.col(label).cast("double") if label else F.lit(0.0)
    whole = df.dropna(subset=[*features, *([label] if label else [])])
    upper = [(i, j) for i in range(len(z)) for j in range(i, len(z))]
    row = whole.agg(F.count(F.lit(1)), F.sum(y * y), *(F.sum(x * y) for x in z), *(F.sum(z[i] * z[j]) for i, j in upper)).first()
    if not row[0]:
        raise ValueError("no complete rows to fit")
    zz = np.zeros((len(z), len(z)))
    for (i, j), v in zip(upper, row[2 + len(z) :]):
        zz[i, j] = zz[j, i] = v
    return Gram(row[0], zz, np.array(row[2 : 2 + len(z)]), float(row[1]))


def descend(gradient: Callable, start: np.ndarray, rate: float, n_iters: int, tol: float) -> np.ndarray:
    theta = start
    for _ in range(n_iters):
        g = gradient(theta)
        if np.linalg.norm(g) <= tol:
            break
        theta = theta - rate * g
    return theta


def forward_difference(g: Gram, penalty: Callable[[np.ndarray, float], np.ndarray], step: float = 1e-4) -> Callable:
    """Numeric gradient of the mean squared error and a penalty on all weights but the intercept; penalty(weights, step) is its gain."""

    def gradient(theta):
        more = penalty(theta, step)
        more[0] = 0.0
        return (g.rises(theta, step) + more) / step

    return gradient


@dataclass(frozen=True)
class LinearModel(Fitted):
    features: list[str]
    shift: list[float]
    scale: list[float]
    theta: list[float]
    link: str = "identity"

    def transform(self, df: DataFrame, name: str = "prediction", scale_on_predict: str = "train") -> DataFrame:
        """scale_on_predict="batch" standardises with the mean and deviation of the rows at hand."""
        if self.scale and scale_on_predict == "batch":
            scaler = standard_scaler(df, self.features)
        else:
            scaler = Scaled(self.features, self.shift or [0.0] * len(self.features), self.scale or [1.0] * len(self.features))
        # a constant feature has scale 0 and says nothing
        z = dot([], [], self.theta[0])
        for c, a, b, w in zip(self.features, scaler.shift, scaler.scale, self.theta[1:]):
            z = z + (F.col(c) - F.lit(a)) * F.lit(w / b if b else 0.0)
        return df.withColumn(name, sigmoid(z) if self.link == "sigmoid" else z)

    def score(self, df: DataFrame, label: str, scoring: str = "r2") -> float:
        out = self.transform(df, "_p")
        if self.link == "sigmoid":
            return out.select(metrics.accuracy(label, "_c")).first()[0] if "_c" in out.columns else out.withColumn("_c", (F.col("_p") > 0.5).cast("int")).agg(metrics.accuracy(label, "_c")).first()[0]
        made = {"r2": metrics.r2_score, "mean_squared_error": metrics.mean_squared_error}[scoring]
        return out.agg(made(label, "_p")).first()[0]


def _standardised(df: DataFrame, features: Sequence[str], label: str, normalize: bool):
    if not normalize:
        return df, [], []
    s = standard_scaler(df.dropna(subset=[*features, label]), features)
    safe = [b or 1.0 for b in s.scale]
    return Scaled(list(features), s.shift, safe).transform(df), s.shift, s.scale


#: Rows that one model of the stochastic solver learns from, and its rounds before models are averaged.
SGD_ROWS, SGD_ROUNDS = 50_000, 20


def _sgd(df, features, label, alpha: float, n_iters: int, tol: float, seed: int) -> np.ndarray:
    """Steps of 1 / (i n + j + 100) over all rows, in a new order each round.

    Rows are dealt at random to parts of about SGD_ROWS. Each part takes SGD_ROUNDS rounds from the common weights, then
    the weights are averaged by the parts' rows, until no part moves by more than `tol` in a round.
    """
    rows = df.dropna(subset=[*features, label]).select(*(F.col(c).cast("double") for c in features), F.col(label).cast("double").alias("_y"))
    n = rows.count()
    if not n:
        raise ValueError("no complete rows to fit")
    rows = rows.repartition(n // SGD_ROWS + 1, F.xxhash64(*rows.columns, F.monotonically_increasing_id())).persist()
    theta = np.zeros(len(features) + 1)
    try:
        for first in range(0, n_iters, SGD_ROUNDS):
            start, rounds = theta.tolist(), range(first, min(first + SGD_ROUNDS, n_iters))

            def learn(batches, start=start, rounds=rounds):
                import pyarrow as pa
                from pyspark import TaskContext

                held = [np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) for b in batches if b.num_rows]
                if not held:
                    return
                held = np.concatenate(held)
                held = held[np.lexsort(held.T)]
                z, y, t, moved = np.c_[np.ones(len(held)), held[:, :-1]], held[:, -1], np.array(start), 0.0
                for i in rounds:
                    before = t.copy()
                    rng = np.random.default_rng((seed, i, TaskContext.get().partitionId()))
                    for j, r in enumerate(rng.permutation(len(y))):
                        g = 2 * (z[r] @ t - y[r]) * z[r] + 2 * alpha * np.r_[0, t[1:]]
                        t = t - g / (i * len(y) + j + 100)
                    moved = float(np.linalg.norm(t - before))
                    if moved <= tol:
                        break
                yield pa.RecordBatch.from_arrays([pa.array([len(y)]), pa.array([moved]), pa.array([t.tolist()], pa.list_(pa.float64()))], ["n", "moved", "theta"])

            parts = rows.mapInArrow(learn, "n long, moved double, theta array<double>").collect()
            theta = np.average([p.theta for p in parts], axis=0, weights=[p.n for p in parts])
            if max(p.moved for p in parts) <= tol:
                break
    finally:
        rows.unpersist()
    return theta


def linear_regression(df: DataFrame, features: Sequence[str], label: str, normalize: bool = True, solver: str = "lsqr", gradient: str = "math", n_iters: int = 1000, learning_rate: float = 0.1, tol: float = 1e-3, seed: int = 0) -> LinearModel:
    """Solver lsqr (normal equations, descent where they are singular), gd or sgd; gradient math or debug (numeric)."""
    return ridge(df, features, label, 0.0, normalize, solver, gradient, n_iters, learning_rate, tol, seed)


def ridge(df: DataFrame, features: Sequence[str], label: str, alpha: float = 1.0, normalize: bool = True, solver: str = "lsqr", gradient: str = "math", n_iters: int = 1000, learning_rate: float = 0.1, tol: float = 1e-3, seed: int = 0) -> LinearModel:
    """lsqr adds alpha to the whole diagonal, the intercept's too; gd math takes mean gradient + alpha theta, all of it;
    gd debug minimises MSE + alpha |theta without intercept|^2; sgd the same."""
    if solver not in ("lsqr", "gd", "sgd") or gradient not in ("math", "debug"):
        raise ValueError("solver is lsqr, gd or sgd; gradient is math or debug")
    z, shift, scale = _standardised(df, features, label, normalize)
    if solver == "sgd":
        theta = _sgd(z, features, label, alpha, n_iters, tol, seed)
        return LinearModel(list(features), shift, scale, theta.tolist())
    g = gram(z, features, label)
    p = len(g.zy)
    theta = None
    if solver == "lsqr":
        whole = g.zz + alpha * np.eye(p)
        if np.linalg.matrix_rank(whole) == p:
            theta = np.linalg.solve(whole, g.zy)
    if theta is None:
        plain = lambda t: (g.zz @ t - g.zy) / g.n + alpha * t
        numeric = forward_difference(g, lambda t, step: alpha * step * (2 * t + step))
        theta = descend(plain if gradient == "math" else numeric, np.ones(p), learning_rate, n_iters, tol)
    return LinearModel(list(features), shift, scale, theta.tolist())


def lasso(df: DataFrame, features: Sequence[str], label: str, alpha: float = 1.0, normalize: bool = True, solver: str = "gd", n_iters: int = 1000, learning_rate: float = 0.1, tol: float = 1e-3) -> LinearModel:
    """MSE + alpha |theta without intercept|, by descent along numeric gradients."""
    if solver != "gd":
        raise NotImplementedError("the lasso is fitted by gd")
    z, shift, scale = _standardised(df, features, label, normalize)
    g = gram(z, features, label)
    theta = descend(forward_difference(g, lambda t, step: alpha * (np.abs(t + step) - np.abs(t))), np.ones(len(g.zy)), learning_rate, n_iters, tol)
    return LinearModel(list(features), shift, scale, theta.tolist())


def logistic_regression(df: DataFrame, features: Sequence[str], label: str, normalize: bool = True, n_iters: int = 1000, alpha: float = 0.01, tol: float = 0.0) -> LinearModel:
    """Descent along the summed gradient from all ones, one aggregate a step over cached rows; tol stops it early."""
    z, shift, scale = _standardised(df, features, label, normalize)
    z = z.dropna(subset=[*features, label]).select(*(F.col(c).cast("double") for c in features), F.col(label).cast("double").alias(label)).persist()
    theta = np.ones(len(features) + 1)
    try:
        for _ in range(n_iters):
            error = sigmoid(dot(features, theta[1:], theta[0])) - F.col(label)
            g = np.array(z.agg(F.sum(error), *(F.sum(error * F.col(c)) for c in features)).first(), dtype=float)
            if np.isnan(g).any() or np.linalg.norm(g) <= tol:
                break
            theta = theta - alpha * g
    finally:
        z.unpersist()
    return LinearModel(list(features), shift, scale, theta.tolist(), "sigmoid")
