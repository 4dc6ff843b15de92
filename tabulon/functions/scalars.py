"""Column functions with one policy for missing values: NaN comes in as NULL, a zero divisor gives NULL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nan_to_null(c: Column | str) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))


def nan_to_num(c: Column | str, value: float = 0.0) -> Column:
    """NaN and NULL as a number."""
    return F.coalesce(F.nanvl(c, F.lit(value)), F.lit(value))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def rounded(c: Column, places: int = 6) -> Column:
    """floor(x * 10^places + 0.5) / 10^places: the same in every engine, without negative zero."""
    scale = float(10**places)
    return F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def strict_avg(c: Column | str, n: int | None = None) -> Column:
    """Mean that is NULL as soon as one value of the group is (of `n` values, if told)."""
    c = F.col(c) if isinstance(c, str) else c
    whole = F.count(c) == (F.count(F.lit(1)) if n is None else F.lit(n))
    return F.when(whole, F.avg(c))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def dot(cols: Sequence[str], weights: Sequence[float], intercept: float = 0.0) -> Column:
    total = F.lit(float(intercept))
    for name, w in zip(cols, weights, strict=True):
        total = total + F.col(name) * F.lit(float(w))
    return total


def norm_difference(a: Column, b: Column, p: float = 2) -> Column:
    """L_p norm of the difference of two arrays."""
    parts = F.zip_with(a, b, lambda x, y: F.pow(F.abs(x.cast("double") - y.cast("double")), F.lit(float(p))))
    return F.pow(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x), F.lit(1.0 / p))


def norm_of(differences: Sequence[Column], p: float = 2) -> Column:
    total = F.lit(0.0)
    for d in differences:
        total = total + F.pow(F.abs(d), F.lit(float(p)))
    return F.pow(total, F.lit(1.0 / p))


def log_normal_density(x: Column, mean: Column, sd: Column) -> Column:
    z = (x - mean) / sd
    return -0.5 * z * z - F.log(sd) - F.lit(0.9189385332046727)


def pairs_of(n: Column) -> Column:
    """n choose 2."""
    return n * (n - 1) / 2


def seeded_hash(key: Column, seed: int) -> Column:
    """MD5 of the seed and the key, as hexadecimal digits: the same in every run and engine."""
    return F.md5(F.concat_ws(":", F.lit(seed), key))


def any_missing(*cols: str) -> Column:
    out = F.lit(False)
    for c in cols:
        out = out | F.col(c).isNull()
    return out


def has_all(df: DataFrame, cols: Sequence[str]) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
