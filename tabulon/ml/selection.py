"""Splits, cross-validation and grid search."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions.scalars import seeded_hash
from tabulon.operators.relational import with_position


def train_test_split(df: DataFrame, key: str, train_size: float | None = None, test_size: float | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Exactly int(n x train_size) rows to learn from, in the order of a hash of the key."""
    if train_size is None and test_size is None:
        train_size = 0.8
    train_size = 1 - test_size if train_size is None else train_size
    if not 0 < train_size < 1 or (test_size is not None and abs(train_size + test_size - 1) > 1e-9):
        raise ValueError("the sizes are shares that add up to 1")
    hashed = with_position(df.withColumn("_h", seeded_hash(F.col(key), seed)), ["_h", key], "_p")
    k = int(df.count() * train_size)
    return hashed.filter(F.col("_p") < k).drop("_h", "_p"), hashed.filter(F.col("_p") >= k).drop("_h", "_p")


def with_fold(df: DataFrame, order: Sequence[str], cv: int = 5, name: str = "fold") -> DataFrame:
    """Folds of n // cv rows in the order; the rows left over have fold NULL, and are never tested on."""
    numbered = with_position(df, order, "_p")
    k = df.count() // cv
    if cv < 2 or k < 1:
        raise ValueError("at least two folds of at least one row")
    fold = F.floor(F.col("_p") / k).cast("int")
    return numbered.withColumn(name, F.when(fold < cv, fold)).drop("_p")


def cross_val_score(fit: Callable[[DataFrame], object], score: Callable[[object, DataFrame], float], df: DataFrame, order: Sequence[str], cv: int = 5) -> list[float]:
    """Score of each fold by a model of all other rows."""
    folded = with_fold(df, order, cv, "_fold").persist()
    try:
        out = []
        for i in range(cv):
            test = F.col("_fold").eqNullSafe(F.lit(i))
            out.append(score(fit(folded.filter(~test).drop("_fold")), folded.filter(test).drop("_fold")))
        return out
    finally:
        folded.unpersist()


def parameter_grid(grid: dict | list[dict]) -> list[dict]:
    return [dict(zip(g, values)) for g in ([grid] if isinstance(grid, dict) else grid) for values in product(*g.values())]


class GridSearchCV:
    """fit(df, **parameters) -> model and score(model, df); the first of the best mean scores wins."""

    def __init__(self, fit: Callable, grid: dict | list[dict], score: Callable, cv: int = 5):
        self.make, self.grid, self.scoring, self.cv = fit, grid, score, cv

    def fit(self, df: DataFrame, order: Sequence[str]) -> "GridSearchCV":
        self.scores = []
        for p in parameter_grid(self.grid):
            each = cross_val_score(lambda d, p=p: self.make(d, **p), self.scoring, df, order, self.cv)
            self.scores.append((p, sum(each) / len(each)))
        self.best_param, self.best_score = max(self.scores, key=lambda x: x[1])
        self.best_estimator = self.make(df, **self.best_param)
        return self

    def score(self, df: DataFrame) -> float:
        return self.scoring(self.best_estimator, df)
