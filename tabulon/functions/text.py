"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip_marks(c: Column | str, marks: str = r"[\[\] ']") -> Column:
    return F.regexp_replace(c, marks, "")


def element(c: Column | str, separator: str, index: int) -> Column:
    """Part `index` of a split, from 0, or from the end if negative; NULL where there is none."""
    parts = F.split(c, separator)
    return F.try_element_at(parts, F.lit(index + 1 if index >= 0 else index))


def third_of_range(c: Column | str) -> Column:
    """Of a text's first two numbers lo and hi: lo + (hi - lo) / 3, rounded; NULL where there are fewer."""
    numbers = F.regexp_extract_all(c, F.lit("([0-9]+)"), 1)
    lo, hi = (F.try_element_at(numbers, F.lit(i)).cast("double") for i in (1, 2))
    return F.round(lo + (hi - lo) / 3).cast("int")


def zero_filled(c: Column | str, width: int) -> Column:
    """Left-padded with zeros; a longer text stays whole."""
    s = F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    return F.lpad(s, F.greatest(F.length(s), F.lit(width)), F.lit("0"))


def tokens(df: DataFrame, c: str, pattern: str = r"[^\p{L}\p{N}]+", out: str = "token") -> DataFrame:
    """One row for each token of a text; other columns are dropped."""
    return df.select(F.explode(F.split(F.lower(c), pattern)).alias(out)).filter(F.col(out) != "")


def joined(c: str, order: str, separator: str = ",") -> Column:
    """Aggregate: a group's texts in the order of another column."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, c))), lambda x: x[c]), separator)
