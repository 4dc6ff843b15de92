"""Naive Bayes. Parameters stay tables; scoring joins them broadcast, as classes times features are few."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.scalars import log_normal_density
from tabulon.ml.preprocess import Fitted

MOST_PARAMETERS = 1_000_000


def _probabilities(scores: DataFrame, key: str) -> DataFrame:
    """key, class, probability, prediction from unnormalised log scores (key, class, score)."""
    w = Window.partitionBy(key)
    e = F.exp(F.col("score") - F.max("score").over(w))
    out = scores.withColumn("_e", e).withColumn("probability", F.col("_e") / F.sum("_e").over(w))
    first = F.min(F.struct((-F.col("score")).alias("s"), F.col("class").alias("c"))).over(w)
    return out.select(key, "class", "probability", first["c"].alias("prediction"))


@dataclass(frozen=True)
class GaussianNB(Fitted):
    features: list[str]
    classes: list
    priors: list[float]
    means: list[list[float]]
    sds: list[list[float]]

    def transform(self, df: DataFrame, key: str) -> DataFrame:
        """key, class, probability, prediction (the likeliest class, of equals the smallest)."""
        score = []
        for c, p, mu, sd in zip(self.classes, self.priors, self.means, self.sds):
            s = F.log(F.lit(p))
            for f, m, d in zip(self.features, mu, sd):
                s = s + log_normal_density(F.col(f), F.lit(m), F.lit(d))
            score.append(F.struct(F.lit(c).alias("class"), s.alias("score")))
        return _probabilities(df.select(key, F.explode(F.array(*score)).alias("r")).select(key, "r.*"), key)


def gaussian_nb(df: DataFrame, features: Sequence[str], label: str, priors: Sequence[float] | None = None, smoothing: float = 0.0) -> GaussianNB:
    """Means and population deviations by class; `smoothing` adds that part of the largest variance to all."""
    aggs = [F.count(F.lit(1)).alias("_n")] + [f(F.col(c).cast("double")) for c in features for f in (F.avg, F.stddev_pop)]
    rows = sorted(df.dropna(subset=[*features, label]).groupBy(label).agg(*aggs).collect(), key=lambda r: r[0])
    if not rows:
        raise ValueError("nothing to fit")
    total = sum(r[1] for r in rows)
    extra = smoothing * max(s * s for r in rows for s in r[3::2])
    sds = [[(s * s + extra) ** 0.5 for s in r[3::2]] for r in rows]
    return GaussianNB(list(features), [r[0] for r in rows], list(priors) if priors is not None else [r[1] / total for r in rows], [list(r[2::2]) for r in rows], sds)


@dataclass(frozen=True)
class CategoricalNB(Fitted):
    """table: class, feature, value, p; `priors`: class -> probability."""

    features: list[str]
    priors: dict
    table: DataFrame
    unseen: float

    def transform(self, df: DataFrame, key: str) -> DataFrame:
        small = self.table.count() <= MOST_PARAMETERS  # else both sides are dealt by class, feature and value
        long = _long(df, [key], self.features)
        classes = F.explode(F.array(*(F.struct(F.lit(c).alias("class"), F.lit(p).alias("prior")) for c, p in self.priors.items())))
        each = long.select("*", classes.alias("c")).select(key, "feature", "value", "c.class", "c.prior")
        met = each.join(F.broadcast(self.table) if small else self.table, ["class", "feature", "value"], "left")
        score = met.groupBy(key, "class").agg((F.log(F.max("prior")) + F.sum(F.log(F.coalesce("p", F.lit(self.unseen))))).alias("score"))
        return _probabilities(score, key)


def _long(df: DataFrame, keep: Sequence[str], features: Sequence[str]) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in features))
    return df.select(*keep, F.explode(rows).alias("r")).select(*keep, "r.*")


def categorical_nb(df: DataFrame, features: Sequence[str], label: str, alpha: float = 1.0, fit_prior: bool = True, class_prior: dict | None = None) -> CategoricalNB:
    """(alpha + count) / (class count + alpha x distinct values of the feature); an unseen value has 1 / rows."""
    whole = df.dropna(subset=[*features, label])
    classes = {r[0]: r[1] for r in whole.groupBy(label).count().orderBy(label).collect()}
    total = sum(classes.values())
    if not total:
        raise ValueError("nothing to fit")
    long = _long(whole.withColumnRenamed(label, "class"), ["class"], features)
    counts = long.groupBy("class", "feature", "value").agg(F.count(F.lit(1)).alias("n"))
    values = counts.groupBy("feature").agg(F.count_distinct("value").alias("k"))
    grid = counts.select("feature", "value").distinct().withColumn("class", F.explode(F.array(*(F.lit(c) for c in classes))))
    sizes = F.create_map(*(F.lit(x) for c, n in classes.items() for x in (c, n)))
    p = (F.lit(alpha) + F.coalesce("n", F.lit(0))) / (sizes[F.col("class")] + F.lit(alpha) * F.col("k"))
    table = grid.join(counts, ["class", "feature", "value"], "left").join(F.broadcast(values), "feature").select("class", "feature", "value", p.alias("p"))
    priors = class_prior or ({c: n / total for c, n in classes.items()} if fit_prior else {c: 1 / len(classes) for c in classes})
    return CategoricalNB(list(features), priors, table, 1 / total)


#: The name under which it is known elsewhere, though it is categorical.
multinomial_nb = categorical_nb
