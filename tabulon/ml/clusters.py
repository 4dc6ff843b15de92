"""k-means and principal components."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.scalars import dot
from tabulon.ml.linear import gram
from tabulon.ml.metrics import mean_silhouettes
from tabulon.ml.preprocess import Fitted


@dataclass(frozen=True)
class KMeans(Fitted):
    features: list[str]
    centers: list[list[float]]
    n_rounds: int = 0

    def nearest(self) -> Column:
        """Number of the nearest centre, of equals the first."""
        d = F.array(*(sum((F.pow(F.col(c) - F.lit(v), F.lit(2.0)) for c, v in zip(self.features, center)), F.lit(0.0)) for center in self.centers))
        return (F.array_position(d, F.array_min(d)) - 1).cast("int")

    def transform(self, df: DataFrame, name: str = "cluster") -> DataFrame:
        return df.withColumn(name, self.nearest())

    def score(self, df: DataFrame, key: str) -> float:
        return mean_silhouettes(self.transform(df, "_cluster"), self.features, ["_cluster"])[0]


def kmeans(df: DataFrame, features: Sequence[str], n_clusters: int, max_iter: int = 300, seed: int = 0, init: Sequence[Sequence[float]] | None = None) -> KMeans:
    """Starts uniform in the bounding box (or at `init`); a round is one aggregate over the rows; stops when centres stay.

    An empty cluster keeps its centre.
    """
    whole = df.dropna(subset=list(features)).select(*(F.col(c).cast("double").alias(c) for c in features))
    if init is None:
        box = whole.agg(*(f(c) for c in features for f in (F.min, F.max))).first()
        if box[0] is None:
            raise ValueError("nothing to fit")
        rng = np.random.default_rng(seed)
        init = rng.uniform(box[0::2], box[1::2], (n_clusters, len(features))).tolist()
    model = KMeans(list(features), [list(map(float, c)) for c in init])
    whole = whole.persist()
    try:
        for i in range(max_iter):
            means = model.transform(whole).groupBy("cluster").agg(*(F.avg(c) for c in features)).collect()
            centers = [list(c) for c in model.centers]
            for r in means:
                centers[r[0]] = list(r[1:])
            same = np.allclose(centers, model.centers, rtol=0, atol=1e-12)
            model = KMeans(model.features, centers, i + 1)
            if same:
                break
    finally:
        whole.unpersist()
    return model


def best_k(df: DataFrame, key: str, features: Sequence[str], ks: Sequence[int], seed: int = 0, max_iter: int = 300) -> tuple[int, dict[int, float]]:
    """The number of clusters with the best mean silhouette, and all of them."""
    labelled = df.select(key, *features)
    for k in ks:
        labelled = kmeans(df, features, k, max_iter, seed).transform(labelled, f"_cluster{k}")
    scores = dict(zip(ks, mean_silhouettes(labelled, features, [f"_cluster{k}" for k in ks])))
    return max(scores, key=lambda k: (scores[k], -k)), scores


@dataclass(frozen=True)
class PCA(Fitted):
    """Eigenvalues are those of the scatter matrix (not divided by the rows), largest first; a component's largest loading is positive."""

    features: list[str]
    mean: list[float]
    components: list[list[float]]
    explained_variance: list[float]
    explained_variance_ratio: list[float]

    def transform(self, df: DataFrame, keep: Sequence[str] = (), prefix: str = "pc") -> DataFrame:
        out = []
        for i, w in enumerate(self.components):
            out.append(dot(self.features, w, -float(np.dot(self.mean, w))).alias(f"{prefix}{i}"))
        return df.select(*keep, *out)

    def inverse_transform(self, df: DataFrame, keep: Sequence[str] = (), prefix: str = "pc") -> DataFrame:
        names = [f"{prefix}{i}" for i in range(len(self.components))]
        return df.select(*keep, *(dot(names, [w[j] for w in self.components], self.mean[j]).alias(c) for j, c in enumerate(self.features)))


def pca(df: DataFrame, features: Sequence[str], n_components: int | float | None = None) -> PCA:
    """A whole number of components, or the fewest that reach a share of the variance, or all."""
    if n_components is not None and not 0 < n_components <= len(features):
        raise ValueError("n_components is a share or at most the number of features")
    whole = df.dropna(subset=list(features))
    mean = whole.agg(*(F.avg(F.col(c).cast("double")) for c in features)).first()
    if mean[0] is None:
        raise ValueError("nothing to fit")
    centred = whole.select(*((F.col(c).cast("double") - F.lit(m)).alias(c) for c, m in zip(features, mean)))
    values, vectors = np.linalg.eigh(gram(centred, features).zz[1:, 1:])
    order = np.argsort(-values, kind="stable")
    values, vectors = np.maximum(values[order], 0), vectors[:, order].T
    vectors = [v * (1 if v[np.argmax(np.abs(v))] > 0 else -1) for v in vectors]
    ratio = values / values.sum() if values.sum() else values
    k = len(features)
    if isinstance(n_components, int):
        k = n_components
    elif n_components is not None:
        k = int(np.searchsorted(np.cumsum(ratio), n_components - 1e-12) + 1)
    return PCA(list(features), list(mean), [v.tolist() for v in vectors[:k]], values[:k].tolist(), ratio[:k].tolist())
