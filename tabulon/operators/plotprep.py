"""The numbers behind plots, as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.operators.relational import quantiles_by, with_global


def histogram(df: DataFrame, c: str, bins: int = 20) -> DataFrame:
    """bin (from 1), n: bins of equal width from the smallest to the largest value, the last one closed; empty ones don't show."""
    held = with_global(df.select(c).dropna(), _lo=F.min(c), _hi=F.max(c))
    place = F.floor((F.col(c) - F.col("_lo")) * bins / F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo"))) + 1
    return held.select(F.least(F.coalesce(place, F.lit(1)), F.lit(bins)).cast("long").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def box_stats(df: DataFrame, group: Sequence[str], c: str) -> DataFrame:
    """Exact quartiles and whiskers: the farthest values within 1.5 quartile distances."""
    q = quantiles_by(df.dropna(subset=[*group, c]), group, c, (0.25, 0.5, 0.75), "_q")
    met = df.crossJoin(F.broadcast(q)) if not group else df.join(q, list(group))
    reach = (F.col("_q")[2] - F.col("_q")[0]) * 1.5
    inside = (F.col(c) >= F.col("_q")[0] - reach) & (F.col(c) <= F.col("_q")[2] + reach)
    first = lambda i: F.first(F.col("_q")[i])
    return met.groupBy(*group).agg(
        first(0).alias("q25"), first(1).alias("q50"), first(2).alias("q75"),
        F.min(F.when(inside, F.col(c))).alias("low"), F.max(F.when(inside, F.col(c))).alias("high"),
        F.count_if(~inside).alias("n_outside"),
    )


def letter_values(df: DataFrame, group: Sequence[str], c: str, depth: int = 4) -> DataFrame:
    """Quantiles 1/2, 1/4, 3/4, 1/8, 7/8, ... of each group."""
    shares = sorted({0.5} | {x for d in range(2, depth + 1) for x in (0.5**d, 1 - 0.5**d)})
    rows = quantiles_by(df, group, c, shares, "_q")
    return rows.select(*group, F.posexplode("_q").alias("_i", "value")).select(*group, F.get(F.array(*map(F.lit, shares)), F.col("_i")).alias("share"), "value")


def mean_ci(df: DataFrame, group: Sequence[str], c: str, z: float = 1.96) -> DataFrame:
    s = df.dropna(subset=[*group, c]).groupBy(*group).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"))
    half = F.lit(z) * F.col("sd") / F.sqrt("n")
    return s.select(*group, "n", "mean", "sd", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def kde_grid(df: DataFrame, c: str, low: float, high: float, points: int, width: float) -> DataFrame:
    """x, density: Gaussian kernel density at grid points; each value is spread over the grid where it stands, and sums are partial."""
    step = (high - low) / (points - 1)
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.lit(low) + i * F.lit(step)))
    u = (F.col("x") - F.col(c)) / F.lit(width)
    density = F.avg(F.exp(-0.5 * u * u)) / F.lit(width * 2.5066282746310002)
    return df.select(F.col(c).cast("double").alias(c)).dropna().select(c, grid.alias("x")).groupBy("x").agg(density.alias("density"))


def cluster_order(distance: Sequence[Sequence[float]]) -> list[int]:
    """The order of a clustered heat map: groups with the smallest mean distance join, the one with the earlier member first.

    The matrix is that of a table's columns, never of its rows; of equal distances the earliest pair joins.
    """
    groups = [[i] for i in range(len(distance))]
    mean = lambda a, b: round(sum(distance[i][j] for i in a for j in b) / (len(a) * len(b)), 12)
    while len(groups) > 1:
        _, i, j = min((mean(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        groups[i] += groups.pop(j)
    return groups[0] if groups else []


def clustered_correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """a, b, corr, and the places of both columns in the order that puts alike columns beside each other; one aggregate."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    row = df.agg(*(F.corr(a, b) for a, b in pairs)).first() if pairs else ()
    held = {p: v for (a, b), v in zip(pairs, row) for p in ((a, b), (b, a))} | {(c, c): 1.0 for c in cols}
    order = cluster_order([[1 - (held[a, b] or 0.0) for b in cols] for a in cols])
    place = {cols[k]: i for i, k in enumerate(order)}
    return df.sparkSession.createDataFrame([(a, b, held[a, b], place[a], place[b]) for a in cols for b in cols], "a string, b string, corr double, place_a int, place_b int")


def regression_line(df: DataFrame, group: Sequence[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*group).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def residuals(df: DataFrame, x: str, y: str, name: str = "residual") -> DataFrame:
    held = df.crossJoin(F.broadcast(regression_line(df, [], x, y)))
    return held.withColumn(name, F.col(y) - F.col("slope") * F.col(x) - F.col("intercept")).drop("slope", "intercept")


def links(df: DataFrame, source: str, target: str) -> DataFrame:
    """source, target, value: counts of pairs, for a flow chart."""
    return df.dropna(subset=[source, target]).groupBy(F.col(source).alias("source"), F.col(target).alias("target")).agg(F.count(F.lit(1)).alias("value"))


def nodes(df: DataFrame, source: str, target: str) -> DataFrame:
    return df.select(F.col(source).alias("name")).union(df.select(F.col(target))).dropna().distinct()
