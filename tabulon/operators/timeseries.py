"""Series of units (turbines, users, symbols): cleaning, filling, windows, neighbours and scores.

A series has a unit column and an order column. Positions (`step`) count a unit's rows from 0, as with_step
gives them. Scans go by ranges of positions (tabulon.operators.scan), so a long unit is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.scalars import strict_avg
from tabulon.operators import scan
from tabulon.operators.relational import null_where
from tabulon.storage import stored


def with_step(df: DataFrame, unit: str, order: Sequence[str], name: str = "t", span: float | None = None) -> DataFrame:
    """Position of each row in its unit's series, from 0.

    With `span`, a length of the first order column (numbers; seconds for times) that holds some tens of thousands of a unit's
    rows, a long unit is ranked in ranges of that length; without it a unit is sorted in one task.
    """
    if span is None:
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(unit).orderBy(*order)) - 1).cast("long"))
    first = F.col(order[0]).cast("timestamp") if dict(df.dtypes)[order[0]].startswith(("timestamp", "date")) else F.col(order[0])
    return scan.numbered(df, unit, order, F.floor(first.cast("double") / F.lit(float(span))), name)


def power_rules(target: str = "Patv", wind: str = "Wspd", pitch: Sequence[str] = ("Pab1", "Pab2", "Pab3"), wind_dir: str = "Wdir", nacelle_dir: str = "Ndir", negative: bool = True) -> list[tuple[str, Column]]:
    """Quality rules that empty the target; `negative` adds the one against negative power."""
    c = F.col
    rules = [(target, c(target) < 0)] if negative else []
    rules.append((target, (c(target) == 0) & (c(wind) > 2.5)))
    rules.append((target, F.greatest(*pitch) > 89))
    rules.append((target, (c(wind_dir) < -180) | (c(wind_dir) > 180)))
    rules.append((target, (c(nacelle_dir) < -720) | (c(nacelle_dir) > 720)))
    return rules


def sensor_rules(pitch: Sequence[str] = ("Pab1", "Pab2", "Pab3"), wind_dir: str = "Wdir", nacelle_dir: str = "Ndir") -> list[tuple[str, Column]]:
    """Quality rules that empty the angles themselves; they come after those that empty the target by them."""
    c = F.col
    rules = [(wind_dir, (c(wind_dir) < -180) | (c(wind_dir) > 180)), (nacelle_dir, (c(nacelle_dir) < -720) | (c(nacelle_dir) > 720))]
    return rules + [(p, c(p) > 89) for p in pitch]


def cleaned(df: DataFrame, rules: Sequence[tuple[str, Column]], label: str | None = None, raw: str = "label_raw") -> DataFrame:
    """Rules applied in order; `label` is copied to `raw` after them, before anything is filled in."""
    out = null_where(df, rules)
    return out.withColumn(raw, F.col(label)) if label else out


def interpolated(df: DataFrame, unit: str, step: str, cols: Sequence[str]) -> DataFrame:
    """Linear in the row position; leading gaps stay, trailing gaps take the last value."""

    def value(i: int, c: str) -> Column:
        lv, lp, nv, np = F.col(f"_last{i}.v"), F.col(f"_last{i}.p"), F.col(f"_next{i}.v"), F.col(f"_next{i}.p")
        return F.when(F.col(c).isNotNull(), F.col(c)).when(lv.isNull(), None).when(nv.isNull(), lv).otherwise(lv + (nv - lv) * (F.col(step) - lp) / (np - lp))

    found = scan.nearest_known(df, unit, step, cols)
    return found.withColumns({c: value(i, c) for i, c in enumerate(cols)}).select(*df.columns)


def filled(df: DataFrame, unit: str, step: str, cols: Sequence[str]) -> DataFrame:
    """Forward, then backward."""
    found = scan.nearest_known(df, unit, step, cols)
    return found.withColumns({c: F.coalesce(f"_last{i}.v", f"_next{i}.v") for i, c in enumerate(cols)}).select(*df.columns)


def block_means(df: DataFrame, unit: str, step: str, cols: Sequence[str], size: int = 6, strict: bool = True) -> DataFrame:
    """Means over blocks of `size` rows; strict ones are NULL where a value is missing."""
    mean = (lambda c: strict_avg(c)) if strict else (lambda c: F.avg(c))
    return df.groupBy(unit, F.floor(F.col(step) / size).alias("block")).agg(*(mean(c).alias(c) for c in cols), F.count(F.lit(1)).alias("n_rows"))


def moving_mean(df: DataFrame, unit: str, step: str, c: str, steps: int = 2, name: str = "smooth") -> DataFrame:
    """Mean of a row and the next steps - 1; rows without a full window go."""
    w = scan.inside(step).rowsBetween(0, steps - 1)
    rows = scan.with_rows_ahead(df, unit, step, steps - 1)
    return rows.withColumn(name, F.avg(c).over(w)).withColumn("_n", F.count(F.lit(1)).over(w)).filter(F.col("_own") & (F.col("_n") == steps)).drop("_n", "_own", scan.AT)


def sliding_windows(df: DataFrame, unit: str, step: str, cols: Sequence[str], inputs: int, outputs: int = 0, target: str | None = None, stride: int = 1, offset: int = 0, drop_last: bool = False, complete: bool = False) -> DataFrame:
    """unit, start and x: the next `inputs` rows' columns, with y: `outputs` values of the target after them.

    stride and offset pick starts with (start - offset) % stride = 0, for one of several models; drop_last leaves
    the last start out; complete leaves out windows with a missing value.
    """
    total = inputs + outputs
    order = scan.inside(step)
    seen = order.rowsBetween(0, inputs - 1)
    # a NULL inside a struct is collected, a bare one would be skipped
    out = scan.with_rows_ahead(df, unit, step, total).withColumn("_x", F.collect_list(F.struct(*cols)).over(seen)).withColumn("_n", F.count(F.lit(1)).over(order.rowsBetween(0, total - 1 + int(drop_last))))
    if outputs:
        out = out.withColumn("_y", F.collect_list(F.struct(F.col(target).alias("v"))).over(order.rowsBetween(inputs, total - 1)))
    out = out.filter(F.col("_own") & (F.col("_n") == total + int(drop_last)) & (F.pmod(F.col(step) - offset, F.lit(stride)) == 0) & (F.col(step) >= offset))
    if complete:
        gap = lambda rows, c: F.exists(rows, lambda r: r[c].isNull())
        for b in [gap("_x", c) for c in cols] + ([gap("_y", "v")] if outputs else []):
            out = out.filter(~b)
    x = F.transform("_x", (lambda r: r[cols[0]]) if len(cols) == 1 else (lambda r: F.array(*[r[c].cast("double") for c in cols])))
    return out.select(unit, F.col(step).alias("start"), x.alias("x"), *([F.transform("_y", lambda r: r["v"]).alias("y")] if outputs else []))


def decoder_seed(df: DataFrame, unit: str, step: str, c: str, last: int = 144, times: int = 2) -> DataFrame:
    """unit, seed: the last `last` values of a series, `times` over, and the last observed value."""
    order = Window.partitionBy(unit).orderBy(F.col(step).desc())
    tail = df.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= last)
    rows = tail.groupBy(unit).agg(F.transform(F.array_sort(F.collect_list(F.struct(step, c))), lambda r: r[c]).alias("tail"), F.max_by(c, F.when(F.col(c).isNotNull(), F.col(step))).alias("last_value"))
    return rows.select(unit, F.concat(*(["tail"] * times)).alias("seed"), "last_value")


def held(df: DataFrame, unit: str, step: str, cols: Sequence[str], times: int = 6) -> DataFrame:
    """Each row repeated `times` over, as steps of finer time."""
    out = df.select(unit, F.col(step).alias("_t"), *cols, F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("_i"))
    return out.select(unit, (F.col("_t") * times + F.col("_i")).cast("long").alias(step), *cols)


def nearest(points: DataFrame, key: str, coords: Sequence[str], k: int, most_points: int = 20_000) -> DataFrame:
    """key, rank, neighbour, distance: the k nearest points, itself first (rank 0).

    One side is broadcast, up to `most_points` points; beyond that both sides are dealt to grid cells of a
    side that holds about k points, and every cell is compared with its neighbours, wider where too few are found.
    """
    n = points.count()
    left = points.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_a{i}") for i, c in enumerate(coords)))
    right = points.select(F.col(key).alias("neighbour"), *(F.col(c).alias(f"_b{i}") for i, c in enumerate(coords)))
    distance = F.sqrt(sum((F.pow(F.col(f"_a{i}") - F.col(f"_b{i}"), F.lit(2.0)) for i in range(len(coords))), F.lit(0.0)))
    order = Window.partitionBy("_k").orderBy((F.col("neighbour") != F.col("_k")).cast("int"), "distance", "neighbour")
    take = lambda pairs: pairs.withColumn("distance", distance).withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < k)
    final = lambda df: df.select(F.col("_k").alias(key), "rank", "neighbour", "distance")
    if n <= most_points:
        return final(take(left.crossJoin(F.broadcast(right))))
    box = points.agg(*(F.min(c).alias(f"lo{i}") for i, c in enumerate(coords)), *(F.max(c).alias(f"hi{i}") for i, c in enumerate(coords))).first()
    cells = max(1, int((n / max(1, k)) ** (1 / len(coords))))
    side = [max(1e-12, (box[f"hi{i}"] - box[f"lo{i}"]) / cells) for i in range(len(coords))]
    done, rest, reach = None, left, 1
    while True:
        cell = lambda s, w: [F.floor((F.col(f"{s}{i}") - box[f"lo{i}"]) / (side[i] * w)).cast("long").alias(f"_c{i}") for i in range(len(coords))]
        around = rest.select("*", *cell("_a", reach))
        for i in range(len(coords)):
            around = around.withColumn(f"_c{i}", F.explode(F.array(*(F.col(f"_c{i}") + d for d in (-1, 0, 1)))))
        # each round reads the last one's tables, not its plan
        near = stored(take(around.join(right.select("*", *cell("_b", reach)), [f"_c{i}" for i in range(len(coords))])), "near")
        if reach >= cells:
            return final(near if done is None else done.unionByName(near))
        # a k-th neighbour within one cell's side can't be beaten from outside the cells compared
        sure = near.groupBy("_k").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far")).filter((F.col("n") == k) & (F.col("far") <= min(side) * reach)).select("_k")
        part = near.join(sure, "_k", "left_semi")
        done = part if done is None else done.unionByName(part)
        rest, reach = stored(rest.join(sure, "_k", "left_anti"), "rest"), reach * 4


def neighbour_features(panel: DataFrame, unit: str, step: str, cols: Sequence[str], neighbours: DataFrame) -> DataFrame:
    """The panel with distance_i and each column of the i-th neighbour at the same step, i from 1."""
    ranks = sorted(r[0] for r in neighbours.select("rank").distinct().collect() if r[0] > 0)  # as many as neighbours asked for
    other = panel.select(F.col(unit).alias("neighbour"), step, *(F.col(c).alias(f"_{c}") for c in cols))
    met = neighbours.filter("rank > 0").join(other, "neighbour")
    picked = [F.max(F.when(F.col("rank") == i, F.col(s))).alias(f"{n}_{i}") for i in ranks for n, s in [("distance", "distance"), *((c, f"_{c}") for c in cols)]]
    return panel.join(met.groupBy(unit, step).agg(*picked), [unit, step], "left")


def farm_score(df: DataFrame, unit: str = "turb", time: str = "time", truth: str = "y_true", prediction: str = "y_pred") -> DataFrame:
    """time, score: (MAE + RMSE) / 2 of each unit and time over its horizon, missing truth left out, summed over units."""
    error = F.col(truth) - F.col(prediction)
    each = df.groupBy(unit, time).agg(F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"))
    return each.groupBy(time).agg(F.sum((F.col("mae") + F.col("rmse")) / 2).alias("score"))


def training_loss(truth: str, prediction: str, weights: Sequence[float] = (), alpha: float = 1e-4) -> Column:
    """Aggregate: (MAE + RMSE) / 2 with missing truth as no error, plus alpha times the weights' sizes."""
    error = F.coalesce(F.col(truth) - F.col(prediction), F.lit(0.0))
    return (F.avg(F.abs(error)) + F.sqrt(F.avg(error * error))) / 2 + F.lit(alpha * sum(map(abs, weights)))


def unit_scores(df: DataFrame, unit: str, step: str, truth: str, prediction: str, mask: Column, last: int, scale: float = 1000.0) -> DataFrame:
    """unit, mae, rmse over the last `last` unmasked rows, divided by `scale`.

    -1 unless predictions and truth both have a value other than zero among all of the unit's unmasked rows.
    """
    ok = ~F.coalesce(mask, F.lit(False))
    order = Window.partitionBy(unit, "_ok").orderBy(F.col(step).desc())
    ranked = df.withColumn("_ok", ok).withColumn("_r", F.row_number().over(order))
    error = F.when(F.col("_ok") & (F.col("_r") <= last), F.col(truth) - F.col(prediction))
    some = lambda c: F.coalesce(F.bool_or(F.col("_ok") & (F.col(c) != 0)), F.lit(False))
    out = ranked.groupBy(unit).agg(F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), (some(truth) & some(prediction)).alias("_any"))
    return out.select(unit, *(F.when(F.col("_any"), F.col(c) / scale).otherwise(-1.0).alias(c) for c in ("mae", "rmse")))


def unit_checks(df: DataFrame, unit: str, prediction: str, min_std: float = 0.1, min_distinct: float = 0.1) -> DataFrame:
    """unit, is_zero, is_flat: predictions all zero; or of one value, hardly spread, or hardly distinct."""
    p = F.col(prediction)
    stats = df.groupBy(unit).agg(F.bool_or(p != 0).alias("_any"), F.min(p).alias("_lo"), F.max(p).alias("_hi"), F.stddev_pop(p).alias("_sd"), (F.count_distinct(p) / F.count(p)).alias("_d"))
    return stats.select(unit, (~F.col("_any")).alias("is_zero"), ((F.col("_lo") == F.col("_hi")) | (F.col("_sd") <= min_std) | (F.col("_d") < min_distinct)).alias("is_flat"))


def check_farm(checks: DataFrame, zero_share: float = 0.5, flat_share: float = 0.1) -> None:
    """Raises where the share of units with zero or flat predictions is over the limit."""
    r = checks.agg(F.avg(F.col("is_zero").cast("int")).alias("zero"), F.avg(F.col("is_flat").cast("int")).alias("flat")).first()
    for name, share, limit in (("zero", r.zero, zero_share), ("identical", r.flat, flat_share)):
        if share is not None and share > limit:
            raise ValueError(f"{share:.0%} of the units have {name} predictions; {limit:.0%} may")


def farm_totals(scores: DataFrame) -> DataFrame:
    """Sums of unit scores over units with a valid one."""
    ok = scores.filter((F.col("mae") != -1) & F.col("mae").isNotNull() & ~F.isnan("mae"))
    return ok.agg(F.sum("mae").alias("mae"), F.sum("rmse").alias("rmse"), F.count(F.lit(1)).alias("n_units"))


def validated_errors(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """mae, mse, rmse of complete pairs; no rows or missing values are an error."""
    bad = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(truth).isNull() | F.col(prediction).isNull() | F.isnan(prediction)).alias("bad")).first()
    if not bad.n or bad.bad:
        raise ValueError("no rows to score" if not bad.n else f"{bad.bad} of {bad.n} rows have no value")
    error = F.col(truth) - F.col(prediction)
    return df.agg(F.avg(F.abs(error)).alias("mae"), F.avg(error * error).alias("mse"), F.sqrt(F.avg(error * error)).alias("rmse"))


def run_summary(runs: DataFrame, capacity: float, min_noise: float = 0.001) -> DataFrame:
    """Over runs (mae, rmse, last_day_rmse): means, score (MAE + RMSE) / 2, accuracy 1 - RMSE / capacity, and whether runs differ enough."""
    accuracy = 1 - F.col("last_day_rmse") / capacity
    out = runs.agg(F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"), F.avg(accuracy).alias("accuracy"), F.stddev_pop("mae").alias("_a"), F.stddev_pop("rmse").alias("_b"), F.stddev_pop(accuracy).alias("_c"), F.count(F.lit(1)).alias("n_runs"))
    return out.select("n_runs", "mae", "rmse", ((F.col("mae") + F.col("rmse")) / 2).alias("score"), "accuracy", (F.greatest("_a", "_b", "_c") >= min_noise).alias("has_noise"))


def ensemble(predictions: DataFrame, keys: Sequence[str], prediction: str = "y_pred") -> DataFrame:
    """Mean prediction over models."""
    return predictions.groupBy(*keys).agg(F.avg(prediction).alias(prediction))


def trend_fused(fine: DataFrame, trend: DataFrame, unit: str, step: str, value: str, first: int = 36, block: int = 6, calibrate: bool = False) -> DataFrame:
    """A fine forecast joined with a coarse trend (one value for `block` steps).

    Either the first steps are averaged with the trend, or every block is shifted so that its mean is the trend's.
    """
    other = held(trend.withColumnRenamed(value, "_trend"), unit, step, ["_trend"], block)
    met = fine.join(other, [unit, step], "left")
    if calibrate:
        w = Window.partitionBy(unit, F.floor(F.col(step) / block))
        new = F.col(value) + F.coalesce(F.col("_trend") - F.avg(value).over(w), F.lit(0.0))
    else:
        new = F.when((F.col(step) < first) & F.col("_trend").isNotNull(), (F.col(value) + F.col("_trend")) / 2).otherwise(F.col(value))
    return met.withColumn(value, new).drop("_trend")
