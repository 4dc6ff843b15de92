"""Bootstrap intervals in one pass: every row has a Poisson weight for each draw, from a hash of its key, and all
draws' sums are added up at once inside the tasks. Only sums by group and draw are shuffled, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.ml.trees import bootstrap_weight

#: Numbers that a task adds up before it passes them on.
MOST_NUMBERS = 1 << 22


def weighted_sums(df: DataFrame, key: str, group: Sequence[str], values: Sequence[Column], draws: int, seed: int = 0) -> DataFrame:
    """The group, draw, and s0, s1, ...: sums of the values weighted by each draw; rows with a missing value are left out."""
    m = len(values)
    weights = F.transform(F.sequence(F.lit(seed), F.lit(seed + draws - 1)), lambda i: bootstrap_weight(F.col(key), i).cast("double"))
    rows = df.select(*group, F.array(*(v.cast("double") for v in values)).alias("_v"), weights.alias("_w")).filter(~F.exists("_v", lambda v: v.isNull()))
    schema = T.StructType([rows.schema[g] for g in group] + [T.StructField("_sums", T.ArrayType(T.DoubleType()))])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from tabulon.ml.histograms import matrix

        held: dict[tuple, object] = {}
        kinds = None

        def done():
            columns = [pa.array([k[i] for k in held], kinds[i]) for i in range(len(group))]
            return pa.RecordBatch.from_arrays([*columns, pa.array([s.ravel().tolist() for s in held.values()], pa.list_(pa.float64()))], [*group, "_sums"])

        for batch in batches:
            kinds = [batch.schema.field(i).type for i in range(len(group))]
            v, w = matrix(batch.column(len(group)), m), matrix(batch.column(len(group) + 1), draws)
            names = list(zip(*(batch.column(i).to_pylist() for i in range(len(group))))) if group else [()] * len(v)
            of: dict[tuple, int] = {}
            codes = np.array([of.setdefault(n, len(of)) for n in names], np.int64)
            order = np.argsort(codes, kind="stable")
            for name, mine in zip(of, np.split(order, np.cumsum(np.bincount(codes, minlength=len(of)))[:-1])):
                held[name] = held.get(name, 0.0) + w[mine].T @ v[mine]
            if len(held) * draws * m > MOST_NUMBERS:
                yield done()
                held.clear()
        if held:
            yield done()

    parts = rows.mapInArrow(run, schema).select(*group, F.posexplode("_sums").alias("_i", "_s")).groupBy(*group, "_i").agg(F.sum("_s").alias("_s"))
    which = F.col("_i") % m
    return parts.groupBy(*group, F.floor(F.col("_i") / m).cast("int").alias("draw")).agg(*(F.max(F.when(which == j, F.col("_s"))).alias(f"s{j}") for j in range(m)))


def _interval(rows: DataFrame, by: Sequence[str], c: Column, level: float) -> DataFrame:
    tail = (1 - level) / 2
    return rows.groupBy(*by).agg(F.percentile(c, F.lit(tail)).alias("low"), F.percentile(c, F.lit(1 - tail)).alias("high"))


def mean_intervals(df: DataFrame, key: str, group: Sequence[str], c: str, draws: int = 200, level: float = 0.95, seed: int = 0) -> DataFrame:
    """The group, low and high: percentiles of the draws' means; a draw without rows of a group has none."""
    sums = weighted_sums(df, key, group, [F.lit(1), F.col(c)], draws, seed)
    return _interval(sums, group, F.try_divide("s1", "s0"), level)


def line_intervals(df: DataFrame, key: str, group: Sequence[str], x: str, y: str, at: Sequence[float], draws: int = 200, level: float = 0.95, seed: int = 0) -> DataFrame:
    """The group, x, low and high: percentiles of the draws' regression lines at some x; a draw with one x only has none."""
    a, b = F.col(x), F.col(y)
    sums = weighted_sums(df, key, group, [F.lit(1) + a * 0 + b * 0, a + b * 0, b + a * 0, a * a + b * 0, a * b], draws, seed)
    slope = F.try_divide(F.col("s0") * F.col("s4") - F.col("s1") * F.col("s2"), F.col("s0") * F.col("s3") - F.col("s1") * F.col("s1"))
    lines = sums.select(*group, F.col("s0"), F.col("s1"), F.col("s2"), slope.alias("_slope"), F.explode(F.array(*(F.lit(float(v)) for v in at))).alias("x"))
    return _interval(lines, [*group, "x"], F.col("_slope") * F.col("x") + F.try_divide(F.col("s2") - F.col("_slope") * F.col("s1"), F.col("s0")), level)
