"""Scans of long series in ranges: a unit's rows are cut by their position, each range is scanned alone, and what
a range needs from those before or after it is carried over from one summary row a range.

A unit of any length is so spread over tasks; only the summaries of a unit, one for each RANGE rows, meet in one.
A null unit is a unit like any other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

#: Positions of one range.
RANGE = 1 << 16
#: Name of the column that has a row's unit and range.
AT = "_range"


def in_ranges(df: DataFrame, unit: str, number: Column) -> DataFrame:
    return df.withColumn(AT, F.struct(F.col(unit).alias("unit"), number.alias("number")))


def by_position(df: DataFrame, unit: str, step: str, size: int | None = None) -> DataFrame:
    return in_ranges(df, unit, F.floor(F.col(step) / F.lit(size or RANGE)))


def inside(*order: str | Column) -> WindowSpec:
    """Rows of one range in order."""
    return Window.partitionBy(AT).orderBy(*order)


def earlier() -> WindowSpec:
    """Summaries of a unit's ranges before one, the nearest last."""
    return Window.partitionBy(f"{AT}.unit").orderBy(f"{AT}.number").rowsBetween(Window.unboundedPreceding, -1)


def later() -> WindowSpec:
    """Summaries of a unit's ranges after one, the nearest last: a frame up to the end would be added up anew for each row."""
    return Window.partitionBy(f"{AT}.unit").orderBy(F.col(f"{AT}.number").desc()).rowsBetween(Window.unboundedPreceding, -1)


def carried(ranged: DataFrame, summaries: Mapping[str, Column], carries: Mapping[str, Column]) -> DataFrame:
    """The rows with `carries`, windows (earlier, later) over the `summaries` of their unit's ranges."""
    by_range = ranged.groupBy(AT).agg(*(v.alias(k) for k, v in summaries.items()))
    return ranged.join(by_range.select(AT, *(v.alias(k) for k, v in carries.items())), AT)


def numbered(df: DataFrame, unit: str, order: Sequence[str], number: Column, name: str) -> DataFrame:
    """Position of each row in its unit by `order`; `number` is a range that never falls along the order."""
    ranged = in_ranges(df, unit, number)
    counted = carried(ranged, {"_n": F.count(F.lit(1))}, {"_before": F.coalesce(F.sum("_n").over(earlier()), F.lit(0))})
    return counted.withColumn(name, (F.col("_before") + F.row_number().over(inside(*order)) - 1).cast("long")).drop("_before", AT)


def nearest_known(df: DataFrame, unit: str, step: str, cols: Sequence[str], size: int | None = None) -> DataFrame:
    """Beside the i-th column, _last{i} and _next{i}: position p and value v of the last known value up to a row and the first from it on."""
    ranged = by_position(df, unit, step, size)
    known = {c: F.when(F.col(c).isNotNull(), F.col(step)) for c in cols}
    summaries, carries = {}, {}
    for i, c in enumerate(cols):
        for end, pick, p in (("last", F.max_by, F.max), ("next", F.min_by, F.min)):
            summaries |= {f"_p{end}{i}": p(known[c]), f"_v{end}{i}": pick(F.col(c), known[c])}
        at = {end: F.when(F.col(f"_p{end}{i}").isNotNull(), F.struct(F.col(f"_p{end}{i}").alias("p"), F.col(f"_v{end}{i}").alias("v"))) for end in ("last", "next")}
        carries |= {f"_from_last{i}": F.last(at["last"], ignorenulls=True).over(earlier()), f"_from_next{i}": F.last(at["next"], ignorenulls=True).over(later())}
    rows = carried(ranged, summaries, carries)
    back, ahead = (inside(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.col(step), F.col(step).desc()))
    own = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(step).alias("p"), F.col(c).alias("v"))) for c in cols}
    found = {f"_last{i}": F.coalesce(F.last(own[c], ignorenulls=True).over(back), F.col(f"_from_last{i}")) for i, c in enumerate(cols)}
    found |= {f"_next{i}": F.coalesce(F.last(own[c], ignorenulls=True).over(ahead), F.col(f"_from_next{i}")) for i, c in enumerate(cols)}
    return rows.withColumns(found).drop(AT, *carries)


def with_rows_ahead(df: DataFrame, unit: str, step: str, ahead: int, size: int | None = None) -> DataFrame:
    """Ranges of positions 0, 1, ... without gaps, each with the next `ahead` rows of the unit too; _own tells a range's own rows."""
    size = max(size or RANGE, ahead + 1)
    number = F.floor(F.col(step) / F.lit(size))
    shared = (F.pmod(F.col(step), F.lit(size)) < ahead) & (number > 0)
    rows = df.withColumn("_number", F.explode(F.when(shared, F.array(number, number - 1)).otherwise(F.array(number))))
    return in_ranges(rows.withColumn("_own", F.col("_number") == number), unit, F.col("_number")).drop("_number")
