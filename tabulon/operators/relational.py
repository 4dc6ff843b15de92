"""Filtering, deriving, grouping, ranking and reshaping. Every ordering is made total by the caller's keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.scalars import seeded_hash
from tabulon.storage import stored


def ordering(keys: Sequence[str]) -> list[Column]:
    """'-name' is descending."""
    return [F.col(k[1:]).desc() if k.startswith("-") else F.col(k).asc() for k in keys]


def top_k(df: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    return df.orderBy(*ordering(keys)).limit(k)


def top_k_per_group(df: DataFrame, groups: Sequence[str], keys: Sequence[str], k: int, rank: str | None = None) -> DataFrame:
    """The rank filter sits on row_number alone, so Spark prunes each partition to k rows before it shuffles."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*groups).orderBy(*ordering(keys)))).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key, the first in the order."""
    return top_k_per_group(df, keys, order, 1)


def with_position(df: DataFrame, keys: Sequence[str], name: str = "position") -> DataFrame:
    """Rows numbered from 0 in the order: sorted by ranges, each range's rows counted, the counts added up.

    The sorted rows are written to the shared folder first, as ranges are drawn anew each time they are computed.
    Only one number for each range reaches the driver; ties of the order may stand either way.
    """
    sorted_rows = df.orderBy(*ordering(keys)).withColumn("_at", F.monotonically_increasing_id())
    ordered = stored(sorted_rows, "positions")
    part = F.shiftright("_at", 33)
    before, starts = 0, []
    for p, n in sorted((r[0], r[1]) for r in ordered.groupBy(part.alias("p")).count().collect()):
        starts += [F.lit(p), F.lit(before)]
        before += n
    if not starts:
        return df.withColumn(name, F.lit(0).cast("long"))
    start = F.try_element_at(F.create_map(*starts), part)
    return ordered.withColumn(name, (F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + start).cast("long")).drop("_at")


def positions(df: DataFrame, keys: Sequence[str], start: int | None = None, stop: int | None = None) -> DataFrame:
    """Rows [start:stop] of the order, negative numbers from the end."""
    numbered = with_position(df, keys)
    n = df.count() if any(x is not None and x < 0 for x in (start, stop)) else 0
    lo = 0 if start is None else start if start >= 0 else max(0, n + start)
    out = numbered.filter(F.col("position") >= lo)
    if stop is not None:
        out = out.filter(F.col("position") < (stop if stop >= 0 else n + stop))
    return out.drop("position")


def last_rows(df: DataFrame, groups: Sequence[str], order: str, n: int) -> DataFrame:
    return top_k_per_group(df, groups, [f"-{order}"], n)


def permuted(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Rows in the order of a hash of the seed and the key."""
    return df.orderBy(seeded_hash(F.col(key), seed), key)


def permuted_position(df: DataFrame, key: str, seed: int = 0, name: str = "position") -> DataFrame:
    """Each row's place in that order, from 0."""
    return with_position(df.withColumn("_h", seeded_hash(F.col(key), seed)), ["_h", key], name).drop("_h")


def value_counts(df: DataFrame, cols: Sequence[str], name: str = "n") -> DataFrame:
    """Rows without a NULL in `cols`, counted by them."""
    return df.dropna(subset=list(cols)).groupBy(*cols).agg(F.count(F.lit(1)).alias(name))


def with_share(counts: DataFrame, n: str = "n", name: str = "share") -> DataFrame:
    """Each count's part of the total; the total is one row, joined as such."""
    return counts.crossJoin(F.broadcast(counts.agg(F.sum(n).alias("_total")))).withColumn(name, F.try_divide(n, "_total")).drop("_total")


def grouped(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Aggregates by keys; rows without a key don't count."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(*(c.alias(n) for n, c in aggs.items()))


def share_where(condition: Column) -> Column:
    """Aggregate: share of rows that fulfil a condition."""
    return F.avg(condition.cast("int"))


def differs(a: Column, b: Column) -> Column:
    """a != b where a NULL differs from every value."""
    return ~a.eqNullSafe(b)


def replaced(df: DataFrame, values: Mapping, cols: Sequence[str]) -> DataFrame:
    return df.replace(dict(values), subset=list(cols))


def member_class(c: Column, classes: Mapping[str, Sequence], other: str) -> Column:
    out = None
    for name, values in classes.items():
        test = c.isin(list(values))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(other)


def substring_class(c: Column, classes: Sequence[tuple[str, Sequence[str]]], other: str) -> Column:
    """The first class of which a substring occurs."""
    out = None
    for name, parts in classes:
        test = reduce(lambda x, y: x | y, (c.contains(p) for p in parts))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(other)


def null_where(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """Each rule in turn empties its column where its condition is true; later rules see what earlier ones left."""
    for name, bad in rules:
        df = df.withColumn(name, F.when(~F.coalesce(bad, F.lit(False)), F.col(name)))
    return df


def with_global(df: DataFrame, **aggs: Column) -> DataFrame:
    """Columns that hold aggregates over the whole table: one row, broadcast."""
    return df.crossJoin(F.broadcast(df.agg(*(c.alias(n) for n, c in aggs.items()))))


def count_at_least_mean(df: DataFrame, cols: Sequence[str], name: str) -> DataFrame:
    """How many of the columns are at least their own mean."""
    held = with_global(df, **{f"_mean_{c}": F.avg(c) for c in cols})
    total = reduce(lambda a, b: a + b, (F.when(F.col(c) >= F.col(f"_mean_{c}"), 1).otherwise(0) for c in cols))
    return held.withColumn(name, total).drop(*(f"_mean_{c}" for c in cols))


#: Rows up to which one aggregate finds exact quantiles; and rows that may be looked at one by one.
DIRECT_ROWS, BRACKET_ROWS = 1_000_000, 50_000


def exact_quantiles(df: DataFrame, c: str, shares: Sequence[float]) -> list[float | None]:
    """Quantiles of a column with linear interpolation, NULLs left out; all NULL where there are no values.

    Spark's exact percentile holds the distinct values in one task. Beyond DIRECT_ROWS the range around each rank is
    narrowed instead: a sketch proposes cuts, one aggregate counts what lies below each, and so on until the values
    between two cuts are few.
    """
    x = df.select(F.col(c).cast("double").alias("x")).dropna()
    n = x.count()
    if not n:
        return [None] * len(shares)
    if n <= DIRECT_ROWS:
        return list(x.agg(F.percentile("x", F.array(*(F.lit(float(s)) for s in shares)))).first()[0])

    def at(rank: int) -> float:
        inside, below = x, 0
        while True:
            m = inside.count()
            if m <= BRACKET_ROWS:
                break
            cuts = sorted(set(inside.agg(F.percentile_approx("x", [i / 64 for i in range(65)], 10_000)).first()[0]))
            counts = inside.agg(*(F.count_if(F.col("x") < v).alias(f"c{i}") for i, v in enumerate(cuts)), *(F.count_if(F.col("x") == v).alias(f"e{i}") for i, v in enumerate(cuts))).first()
            k = max((i for i in range(len(cuts)) if below + counts[f"c{i}"] <= rank), default=None)
            if k is not None and rank < below + counts[f"c{k}"] + counts[f"e{k}"]:
                return cuts[k]
            low = None if k is None else cuts[k]
            high = cuts[0 if k is None else k + 1] if (0 if k is None else k + 1) < len(cuts) else None
            below += 0 if k is None else counts[f"c{k}"] + counts[f"e{k}"]
            inside = inside.filter(F.lit(True) if low is None else F.col("x") > low).filter(F.lit(True) if high is None else F.col("x") < high)
        return sorted(r.x for r in inside.collect())[rank - below]

    out, found = [], {}
    for s in shares:
        place = s * (n - 1)
        i = int(place)
        for r in {i, min(i + 1, n - 1)} - set(found):
            found[r] = at(r)
        out.append(found[i] + (found[min(i + 1, n - 1)] - found[i]) * (place - i))
    return out


#: Cuts that the rows of each group are dealt out by.
GROUP_CUTS = 255


def quantiles_by(df: DataFrame, group: Sequence[str], c: str, shares: Sequence[float], name: str = "quantiles") -> DataFrame:
    """The group's columns and an array of its exact quantiles, NULL values left out; NULL is a group of its own.

    Where a group has more than DIRECT_ROWS rows, no task holds a group: a sketch proposes cuts, rows are counted between
    cuts, and only the values between the cuts around each rank are put in order, each distinct one once.
    """
    x = df.select(*group, F.col(c).cast("double").alias("_x")).dropna(subset=["_x"])
    if not group:
        return df.sparkSession.createDataFrame([(exact_quantiles(df, c, shares),)], f"`{name}` array<double>")
    most = x.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= DIRECT_ROWS:
        return x.groupBy(*group).agg(F.percentile("_x", F.array(*(F.lit(float(s)) for s in shares))).alias(name))
    key = [f"_g{i}" for i in range(len(group))]
    x = x.select(*(F.col(g).alias(k) for g, k in zip(group, key)), "_x")

    def met(a: DataFrame, b: DataFrame, more: Sequence[str] = (), how: str = "inner") -> DataFrame:
        other = b.select(*(F.col(k).alias(f"_r{k}") for k in (*key, *more)), *(F.col(n) for n in b.columns if n not in (*key, *more)))
        on = reduce(lambda p, q: p & q, (F.col(k).eqNullSafe(F.col(f"_r{k}")) for k in (*key, *more)))
        out = a.join(other, on, how)
        return out.drop(*(f"_r{k}" for k in (*key, *more)))

    cuts = stored(x.groupBy(*key).agg(F.percentile_approx("_x", [i / (GROUP_CUTS + 1) for i in range(1, GROUP_CUTS + 1)], 10_000).alias("_cuts"), F.count(F.lit(1)).alias("_n")), "cuts")
    placed = stored(met(x, cuts).select(*key, "_x", F.size(F.filter("_cuts", lambda v: v < F.col("_x"))).alias("_b")), "placed")
    counts = placed.groupBy(*key, "_b").agg(F.count(F.lit(1)).alias("_k"))
    below = F.sum("_k").over(Window.partitionBy(*key).orderBy("_b")) - F.col("_k")
    low = [F.floor(F.lit(float(s)) * (F.col("_n") - 1)) for s in shares]
    ranks = cuts.select(*key, F.explode(F.array_distinct(F.flatten(F.array(*(F.array(r, F.least(r + 1, F.col("_n") - 1)) for r in low))))).alias("_rank"))
    wanted = stored(met(counts.withColumn("_below", below), ranks).filter("_below <= _rank AND _rank < _below + _k").select(*key, "_b", "_below", "_rank"), "wanted")
    values = met(placed, wanted.select(*key, "_b").distinct(), ["_b"], "left_semi").groupBy(*key, "_b", "_x").agg(F.count(F.lit(1)).alias("_k"))
    upto = F.sum("_k").over(Window.partitionBy(*key, "_b").orderBy("_x"))
    found = met(values.withColumn("_upto", upto), wanted, ["_b"]).filter("_rank < _below + _upto AND _rank >= _below + _upto - _k")
    by_rank = found.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_x"))).alias("_at"))
    one = lambda s, r: F.try_element_at("_at", r) + (F.try_element_at("_at", F.least(r + 1, F.col("_n") - 1)) - F.try_element_at("_at", r)) * (F.lit(float(s)) * (F.col("_n") - 1) - r)
    return met(by_rank, cuts).select(*(F.col(k).alias(g) for g, k in zip(group, key)), F.array(*(one(s, r) for s, r in zip(shares, low))).alias(name))


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """column, count, mean, std (sample), min, exact quartiles, max; two passes for all columns, more beyond DIRECT_ROWS."""
    plain = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    one = df.agg(*(f(c).cast("long" if n == "count" else "double").alias(f"{c}__{n}") for c in cols for n, f in plain.items())).first()
    shares = (0.25, 0.5, 0.75)
    if max(one[f"{c}__count"] for c in cols) <= DIRECT_ROWS:
        q = df.agg(*(F.percentile(c, F.array(*map(F.lit, shares))).alias(c) for c in cols)).first()
        quartiles = {c: q[c] or [None] * 3 for c in cols}
    else:
        quartiles = {c: exact_quantiles(df, c, shares) for c in cols}
    rows = [(c, one[f"{c}__count"], one[f"{c}__mean"], one[f"{c}__std"], one[f"{c}__min"], *quartiles[c], one[f"{c}__max"]) for c in cols]
    return df.sparkSession.createDataFrame(rows, "column string, count long, mean double, std double, min double, q25 double, q50 double, q75 double, max double")


def iqr_fence(df: DataFrame, c: str, factor: float = 1.5) -> DataFrame:
    """`c` emptied where it lies beyond its quartiles by `factor` times their distance."""
    q1, q3 = exact_quantiles(df, c, (0.25, 0.75))
    if q1 is None:
        return df
    reach = (q3 - q1) * factor
    return null_where(df, [(c, (F.col(c) < F.lit(q1 - reach)) | (F.col(c) > F.lit(q3 + reach)))])


def mode_by(df: DataFrame, keys: Sequence[str], c: str, name: str = "mode") -> DataFrame:
    """Most frequent value of each group, of equals the smallest."""
    counts = value_counts(df, [*keys, c], "_n")
    return top_k_per_group(counts, keys, ["-_n", c], 1).select(*keys, F.col(c).alias(name))


def pivoted(df: DataFrame, index: str, column: str, values: Sequence, value: Column, prefix: str = "") -> DataFrame:
    """Wide form by one aggregate; the columns are told, so no job is spent on finding them."""
    wide = df.groupBy(index).pivot(column, list(values)).agg(value)
    return wide.select(index, *(F.col(f"`{v}`").alias(f"{prefix}{v}") for v in values))


def pivoted_once(df: DataFrame, index: str, column: str, values: Sequence, value: str) -> DataFrame:
    """Wide form of a table with one row for each cell; more are an error."""
    if df.groupBy(index, column).count().filter("count > 1").limit(1).count():
        raise ValueError(f"several rows for one {index} and {column}")
    return pivoted(df, index, column, values, F.first(value))


def columns_of(df: DataFrame, starts: Sequence[str]) -> list[str]:
    """Columns by the start of their names, in the order asked for and, within that, of the table."""
    return list(dict.fromkeys(c for s in starts for c in df.columns if c.startswith(s)))


def unpivoted(df: DataFrame, keys: Sequence[str], cols: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    """Long form: one row for each key and column, values as doubles."""
    rows = F.array(*(F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in cols))
    return df.select(*keys, F.explode(rows).alias("_r")).select(*keys, f"_r.{name}", f"_r.{value}")


def transposed(df: DataFrame, key: str, keys: Sequence, cols: Sequence[str], name: str = "name") -> DataFrame:
    """A row for each of `cols` and a column for each of the told `keys`, which name the rows of df; one value a cell."""
    return pivoted(unpivoted(df.select(key, *cols), [key], cols, name), name, key, keys, F.first("value", ignorenulls=True))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    return value_counts(df, [a, b])


def pair_stats(df: DataFrame, cols: Sequence[str], stat: str = "corr") -> DataFrame:
    """Long form (x, y, value) of a correlation or covariance matrix, all pairs in one pass; stat: corr or covar_samp."""
    f = {"corr": F.corr, "covar_samp": F.covar_samp}[stat]
    pairs = [(x, y) for i, x in enumerate(cols) for y in cols[i:]]
    wide = df.agg(*(f(x, y).alias(f"{x}__{y}") for x, y in pairs))
    both = [(x, y, f"{x}__{y}") for x, y in pairs] + [(y, x, f"{x}__{y}") for x, y in pairs if x != y]
    rows = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(c).alias("value")) for x, y, c in both))
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def aligned_difference(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """a - b by key; a key that only one of them has gives NULL."""
    right = b.select(*keys, *(F.col(c).alias(f"_other_{c}") for c in cols))
    return a.join(right, list(keys), "full").select(*keys, *((F.col(c) - F.col(f"_other_{c}")).alias(c) for c in cols))


def side_by_side(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, list(keys), "full"), frames)


def assert_known(df: DataFrame, c: str, known: DataFrame, known_col: str) -> None:
    """Raises if `c` has a value that `known` lacks."""
    lost = df.select(F.col(c).alias("v")).distinct().join(known.select(F.col(known_col).alias("v")), "v", "left_anti").limit(5).collect()
    if lost:
        raise ValueError(f"unknown values in {c}: {[r.v for r in lost]}")


def gini(counts: DataFrame, groups: Sequence[str], n: str = "n") -> DataFrame:
    """Gini impurity and natural-log entropy of each group of class counts."""
    total = counts.groupBy(*groups).agg(F.sum(n).alias("total"), F.sum(F.col(n) * F.col(n)).alias("_sq"), F.sum(F.col(n) * F.log(n)).alias("_nl"))
    return total.select(*groups, "total", (1 - F.col("_sq") / (F.col("total") * F.col("total"))).alias("gini"), (F.log("total") - F.col("_nl") / F.col("total")).alias("entropy"))


def square_error(c: str) -> Column:
    """Aggregate: sum of squared distances to the mean, from the stable variance."""
    return F.var_pop(c) * F.count(c)


def weighted_mean(value: str, weight: str) -> Column:
    return F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight))
