"""Scalers, encoders and polynomial features. Fitting is one aggregate; a fitted object holds plain numbers and transforms by expressions."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, fields
from itertools import combinations, combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct values an encoder may learn of one column; its codes are literals of the plan.
MOST_CATEGORIES = 10_000


#: Of what Fitted.to_json writes.
VERSION = 1


def _plain(v):
    """A fitted object's value as JSON has it; dictionaries with other keys than texts become pairs."""
    if isinstance(v, Fitted):
        return v.parts()
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()} if all(isinstance(k, str) for k in v) else {"pairs": [[k, _plain(x)] for k, x in v.items()]}
    return [_plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def _revived(v):
    if isinstance(v, list):
        return [_revived(x) for x in v]
    if not isinstance(v, dict):
        return v
    if set(v) == {"pairs"}:
        return {k: _revived(x) for k, x in v["pairs"]}
    held = {k: _revived(x) for k, x in v.items()}
    return Fitted.kinds()[held.pop("kind")](**held) if "kind" in held else held


class Fitted:
    @staticmethod
    def kinds() -> dict[str, type]:
        return {c.__name__: c for c in Fitted.__subclasses__()}

    def tables(self) -> dict[str, DataFrame]:
        """What is a table of its own, beside the numbers."""
        return {f.name: getattr(self, f.name) for f in fields(self) if isinstance(getattr(self, f.name), DataFrame)}

    def parts(self) -> dict:
        return {"kind": type(self).__name__} | {f.name: _plain(getattr(self, f.name)) for f in fields(self) if f.name not in self.tables()}

    def to_json(self) -> str:
        return json.dumps({"version": VERSION} | self.parts())

    @staticmethod
    def from_json(text: str, **tables: DataFrame) -> "Fitted":
        held = json.loads(text)
        if held.pop("version", VERSION) > VERSION:
            raise ValueError("written by a later version")
        held = {k: v if k == "kind" else _revived(v) for k, v in held.items()}
        return Fitted.kinds()[held.pop("kind")](**held, **tables)


@dataclass(frozen=True)
class Scaled(Fitted):
    """(x - shift) / scale; a zero scale gives NULL."""

    cols: list[str]
    shift: list[float]
    scale: list[float]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.try_divide(F.col(c) - F.lit(a), F.lit(b)) for c, a, b in zip(self.cols, self.shift, self.scale)})

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) * F.lit(b) + F.lit(a) for c, a, b in zip(self.cols, self.shift, self.scale)})


def _stats(df: DataFrame, cols: Sequence[str], a, b):
    row = df.agg(*(f(F.col(c).cast("double")) for c in cols for f in (a, b))).first()
    if row[0] is None:
        raise ValueError("nothing to fit")
    return list(row[0::2]), list(row[1::2])


def standard_scaler(df: DataFrame, cols: Sequence[str]) -> Scaled:
    """Mean and population standard deviation."""
    return Scaled(list(cols), *_stats(df, cols, F.avg, F.stddev_pop))


def min_max_scaler(df: DataFrame, cols: Sequence[str]) -> Scaled:
    low, high = _stats(df, cols, F.min, F.max)
    return Scaled(list(cols), low, [h - x for h, x in zip(high, low)])


def polynomial_terms(cols: Sequence[str], degree: int = 2, interaction_only: bool = False, include_bias: bool = True) -> list[tuple[int, ...]]:
    if degree < 2:
        raise ValueError("the degree is 2 or more")
    pick = combinations if interaction_only else combinations_with_replacement
    n = range(len(cols))
    return [()] * include_bias + [(i,) for i in n] + [t for d in range(2, degree + 1) for t in pick(n, d)]


def polynomial_names(terms: Sequence[tuple[int, ...]]) -> list[str]:
    """1, X0, X1, X0^2, X0 X1, ..."""
    part = lambda t, i: f"X{i}" if t.count(i) == 1 else f"X{i}^{t.count(i)}"
    return [" ".join(part(t, i) for i in dict.fromkeys(t)) or "1" for t in terms]


def polynomial_features(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (), **options) -> DataFrame:
    terms = polynomial_terms(cols, **options)

    def product(t):
        out = F.lit(1.0)
        for i in t:
            out = out * F.col(cols[i])
        return out

    return df.select(*keep, *(product(t).alias(n) for t, n in zip(terms, polynomial_names(terms))))


@dataclass(frozen=True)
class Encoded(Fitted):
    """Sorted distinct values of each column; a value's code is its place."""

    cols: list[str]
    values: list[list]

    def _codes(self, c: str, values: list):
        if not values:
            return F.lit(None).cast("int")
        known = F.create_map(*(F.lit(x) for i, v in enumerate(values) for x in (v, i)))
        return F.try_element_at(known, F.col(c))

    def transform(self, df: DataFrame, suffix: str = "", strict: bool = True) -> DataFrame:
        """Codes; with strict an unknown value is an error when the rows are computed."""
        out = {}
        for c, values in zip(self.cols, self.values):
            code = self._codes(c, values)
            if strict:
                code = F.coalesce(code, F.raise_error(F.concat(F.lit(f"unknown value in {c}: "), F.coalesce(F.col(c).cast("string"), F.lit("NULL")))).cast("int"))
            out[f"{c}{suffix}"] = code
        return df.withColumns(out)

    def inverse_transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        """Values of codes; a code that no value has is an error when the rows are computed, a NULL stays NULL."""
        out = {}
        for c, values in zip(self.cols, self.values):
            code = F.col(f"{c}{suffix}").cast("int")
            value = F.get(F.array(*(F.lit(v) for v in values)), code)
            wrong = F.assert_true(code.isNull() | ((code >= 0) & (code < len(values))), f"no such code in {c}")
            out[c] = F.when(wrong.isNull(), value)
        return df.withColumns(out)

    def one_hot(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """A 0/1 column for each value, named column_value; an unknown value is all zeros."""
        return df.select(*keep, *(F.when(F.col(c) == F.lit(v), 1).otherwise(0).alias(f"{c}_{v}") for c, values in zip(self.cols, self.values) for v in values))

    def from_one_hot(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """The value of the largest indicator; all zeros give the first value."""
        def of(c, values):
            flags = F.array(*(F.col(f"{c}_{v}") for v in values))
            return F.get(F.array(*(F.lit(v) for v in values)), (F.array_position(flags, F.array_max(flags)) - 1).cast("int"))

        return df.select(*keep, *(of(c, values).alias(c) for c, values in zip(self.cols, self.values)))


def encoder(df: DataFrame, cols: Sequence[str]) -> Encoded:
    """All columns' values in one pass."""
    held = df.agg(*(F.sort_array(F.collect_set(c)).alias(c) for c in cols)).first()
    for c in cols:
        if len(held[c]) > MOST_CATEGORIES:
            raise ValueError(f"{c} has over {MOST_CATEGORIES} values; join with `code_table` instead")
    return Encoded(list(cols), [held[c] for c in cols])


def code_table(df: DataFrame, c: str) -> DataFrame:
    """value, code: the codes of a column of any number of values, for a join."""
    from tabulon.operators.relational import with_position

    return with_position(df.select(F.col(c).alias("value")).dropna().distinct(), ["value"], "code")
