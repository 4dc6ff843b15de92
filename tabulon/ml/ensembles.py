"""Boosting over the trees of this package, and learners of pyspark.ml where their results need only be as good, not the same."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.ml.preprocess import Fitted
from tabulon.ml.trees import Tree, grow, grow_forest, mean_of
from tabulon.storage import drop_path, new_path, stored


def _assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(features), outputCol="_v", handleInvalid="skip").transform(df)


def boosted_regressor(df: DataFrame, features: Sequence[str], label: str, rounds: int = 20, max_depth: int = 5):
    """A function that adds `prediction`, from gradient-boosted trees."""
    from pyspark.ml.regression import GBTRegressor

    model = GBTRegressor(featuresCol="_v", labelCol=label, maxIter=rounds, maxDepth=max_depth, seed=0).fit(_assembled(df, features))
    return lambda rows: model.transform(_assembled(rows, features)).drop("_v")


def direction_classifier(df: DataFrame, features: Sequence[str], label: str, hidden: Sequence[int] = (32,), rounds: int = 100):
    """A function that adds `prediction` (0 or 1), from a multilayer perceptron over flattened windows."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    net = MultilayerPerceptronClassifier(featuresCol="_v", labelCol=label, layers=[len(features), *hidden, 2], maxIter=rounds, seed=0)
    model = net.fit(_assembled(df, features))
    return lambda rows: model.transform(_assembled(rows, features)).drop("_v", "rawPrediction", "probability")


def scored_by(df: DataFrame, predict, cols: Sequence[str], keep: Sequence[str] = (), name: str = "prediction") -> DataFrame:
    """A column by any model that can be pickled: predict(array of rows x columns) -> array, over Arrow batches."""
    from pyspark.sql import types as T

    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(name, T.DoubleType())])

    def run(batches):
        for pdf in batches:
            yield pdf[list(keep)].assign(**{name: predict(pdf[list(cols)].to_numpy(dtype=float))})

    return df.select(*dict.fromkeys([*keep, *cols])).mapInPandas(run, schema)


@dataclass(frozen=True)
class Boosted(Fitted):
    """start + the weighted sum of regression trees, or the sign of a weighted vote of trees for two classes."""

    trees: list[Tree]
    weights: list[float]
    start: float = 0.0
    classes: Sequence = field(default_factory=list)

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        if not self.trees:
            return df.withColumn(name, F.lit(self.start))
        if not self.classes:
            return df.withColumn(name, mean_of(self.trees, self.weights, self.start))
        # a tree for or against the second class
        votes = [Tree(t.features, [], {i: n | {"out": 1.0 if n["out"][1] > n["out"][0] else -1.0} for i, n in t.nodes.items()}) for t in self.trees]
        first, second = self.classes
        return df.withColumn(name, F.when(mean_of(votes, self.weights, 0.0) > 0, F.lit(second)).otherwise(F.lit(first)))


def _rounds(spark, rows: DataFrame, name: str):
    """Keeps what a round leaves of its rows as a table, and deletes that of the round before."""
    held: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        path = new_path(spark, name)
        out = stored(df, name, path)
        if held:
            drop_path(spark, held.pop())
        held.append(path)
        return out

    def done() -> None:
        if held:
            drop_path(spark, held.pop())

    return keep(rows), keep, done


def gradient_boosting(df: DataFrame, features: Sequence[str], label: str, rounds: int = 20, rate: float = 0.1, max_depth: int = 3) -> Boosted:
    """Each tree learns what those before it leave of the label; that is kept from round to round, so no plan grows with their number."""
    held = df.select(*features, F.col(label).cast("double").alias("_rest")).dropna()
    start = held.agg(F.avg("_rest")).first()[0]
    if start is None:
        raise ValueError("nothing to fit")
    left, keep, done = _rounds(df.sparkSession, held.withColumn("_rest", F.col("_rest") - F.lit(start)), "boosting")
    trees = []
    try:
        for i in range(rounds):
            trees.append(grow(left, features, "_rest", "regress", max_depth=max_depth))
            if i + 1 < rounds:
                left = keep(left.withColumn("_rest", F.col("_rest") - rate * mean_of(trees[-1:], [1.0], 0.0)))
    finally:
        done()
    return Boosted(trees, [rate] * len(trees), start)


def adaboost(df: DataFrame, features: Sequence[str], label: str, rounds: int = 20, max_depth: int = 1, continuous: bool = True) -> Boosted:
    """Two classes; a tree's vote is the log odds of its weighted error, and rows that it misses weigh as much more.

    It stops at a tree without errors, which decides alone, and at one no better than chance, which has no vote. Weights
    are kept from round to round.
    """
    rows = df.dropna(subset=[*features, label]).select(*dict.fromkeys([*features, label]))
    classes = tuple(r[0] for r in rows.select(label).distinct().orderBy(label).limit(3).collect())
    if len(classes) != 2:
        raise ValueError("there are two classes")
    held, keep, done = _rounds(df.sparkSession, rows.withColumn("_w", F.lit(1.0)), "adaboost")
    trees, votes = [], []
    try:
        for _ in range(rounds):
            tree = grow(held, features, label, continuous=continuous, max_depth=max_depth, weight="_w")
            placed = tree.transform(held, "_p").withColumn("_wrong", F.col("_p") != F.col(label))
            error = placed.agg(F.sum(F.when(F.col("_wrong"), F.col("_w")).otherwise(0.0)) / F.sum("_w")).first()[0]
            if error <= 0:
                return Boosted([tree], [1.0], classes=list(classes))
            if error >= 0.5:
                break
            vote = math.log((1 - error) / error)
            trees.append(tree)
            votes.append(vote)
            # the weights of the next round have mean 1 again
            total = 1 - error + error * math.exp(vote)
            held = keep(placed.withColumn("_w", F.col("_w") * F.when(F.col("_wrong"), math.exp(vote)).otherwise(1.0) / F.lit(total)).drop("_p", "_wrong"))
    finally:
        done()
    if not trees:
        raise ValueError("no tree is better than chance")
    return Boosted(trees, votes, classes=list(classes))


def multi_output_trees(train: DataFrame, x: str, y: str, inputs: int, outputs: int, key: str | None = None, n_estimators: int = 1, seed: int = 0, **options):
    """One tree, or a forest over draws by `key`, from windows x (array) to y (array): every leaf has all outputs, so a split serves them all."""
    names, targets = [f"x{i}" for i in range(inputs)], [f"y{i}" for i in range(outputs)]
    rows = train.select(*([key] if key else []), *(F.get(x, F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)), *(F.get(y, F.lit(i)).cast("double").alias(n) for i, n in enumerate(targets)))
    if n_estimators == 1:
        return grow(rows, names, targets, "regress", **options)
    if key is None:
        raise ValueError("a forest draws rows by a key")
    return grow_forest(rows, names, targets, key, n_estimators, "regress", seed, **options)


def forecast_windows(model, ahead: DataFrame, x: str, name: str = "prediction") -> DataFrame:
    """The rows of `ahead` with an array of all outputs."""
    features = model.features if isinstance(model, Tree) else model.trees[0].features
    own = ahead.columns
    flat = ahead.withColumns({n: F.get(F.col(x), F.lit(i)).cast("double") for i, n in enumerate(features)})
    return model.transform(flat, name).select(*own, name)
