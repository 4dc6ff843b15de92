"""Tables behind plots, on the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions.scalars import rounded
from tabulon.operators import bootstrap, plotprep
from tabulon.operators import relational as rel
from tabulon.plans import unrolled
from tabulon.plans.registry import Tables, query, r6

c = F.col


@query("""WITH m AS (SELECT min(l_extendedprice) lo, max(l_extendedprice) hi FROM lineitem)
SELECT CAST(least(floor((l_extendedprice - lo) * 20 / (hi - lo)) + 1, 20) AS BIGINT) AS bin, count(*) AS n FROM lineitem, m GROUP BY 1""")
def histogram_20(t: Tables) -> DataFrame:
    return plotprep.histogram(t.lineitem, "l_extendedprice", 20)


@query(f"""WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) a, quantile_cont(l_extendedprice, 0.5) b, quantile_cont(l_extendedprice, 0.75) d FROM lineitem GROUP BY 1)
SELECT l_returnflag, {r6('any_value(a)')} AS q25, {r6('any_value(b)')} AS q50, {r6('any_value(d)')} AS q75,
min(l_extendedprice) FILTER (l_extendedprice BETWEEN a - (d - a) * 1.5 AND d + (d - a) * 1.5) AS low, max(l_extendedprice) FILTER (l_extendedprice BETWEEN a - (d - a) * 1.5 AND d + (d - a) * 1.5) AS high,
count(*) FILTER (l_extendedprice NOT BETWEEN a - (d - a) * 1.5 AND d + (d - a) * 1.5) AS n_outside FROM lineitem JOIN q USING (l_returnflag) GROUP BY 1""")
def box_stats(t: Tables) -> DataFrame:
    out = plotprep.box_stats(t.lineitem.select("l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice")
    return out.select("l_returnflag", *(rounded(c(x)).alias(x) for x in ("q25", "q50", "q75")), "low", "high", "n_outside")


@query("\nUNION ALL ".join(f"SELECT p_type, CAST({s} AS DOUBLE) AS share, {r6(f'quantile_cont(p_retailprice, {s})')} AS value FROM part GROUP BY 1" for s in (0.125, 0.25, 0.5, 0.75, 0.875)))
def letter_values(t: Tables) -> DataFrame:
    return plotprep.letter_values(t.part, ["p_type"], "p_retailprice", 3).withColumn("value", rounded(c("value")))


@query(f"""SELECT p_brand, p_type, count(p_retailprice) AS n, {r6('avg(p_retailprice)')} AS mean, {r6('stddev_samp(p_retailprice)')} AS sd,
{r6('avg(p_retailprice) - 1.96 * stddev_samp(p_retailprice) / sqrt(count(p_retailprice))')} AS low, {r6('avg(p_retailprice) + 1.96 * stddev_samp(p_retailprice) / sqrt(count(p_retailprice))')} AS high FROM part GROUP BY ALL""")
def mean_ci(t: Tables) -> DataFrame:
    out = plotprep.mean_ci(t.part, ["p_brand", "p_type"], "p_retailprice")
    return out.select("p_brand", "p_type", "n", *(rounded(c(x)).alias(x) for x in ("mean", "sd", "low", "high")))


@query(f"""SELECT x, {r6('avg(exp(-0.5::DOUBLE * ((x - c_acctbal) / 500.0::DOUBLE) * ((x - c_acctbal) / 500.0::DOUBLE))) / (500.0::DOUBLE * 2.5066282746310002::DOUBLE) * 1000.0::DOUBLE')} AS density
FROM customer, (SELECT -1000.0::DOUBLE + i * 275.0::DOUBLE AS x FROM range(0, 41) g(i)) GROUP BY 1""")
def kde_grid(t: Tables) -> DataFrame:
    return plotprep.kde_grid(t.customer, "c_acctbal", -1000.0, 10000.0, 41, 500.0).select("x", rounded(c("density") * 1000).alias("density"))


_COLS = ("l_quantity", "l_discount", "l_tax")
_PAIRS = [(x, y) for x in _COLS for y in _COLS]


@query("\nUNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, {r6(f'corr({x}, {y})')} AS corr, {r6(f'covar_samp({x}, {y})')} AS cov FROM lineitem" for x, y in _PAIRS))
def corr_matrix(t: Tables) -> DataFrame:
    df = t.lineitem.select(*_COLS)
    a, b = rel.pair_stats(df, _COLS, "corr").withColumnRenamed("value", "corr"), rel.pair_stats(df, _COLS, "covar_samp").withColumnRenamed("value", "cov")
    return a.join(b, ["x", "y"]).select("x", "y", rounded(c("corr")).alias("corr"), rounded(c("cov")).alias("cov"))


@query(f"""WITH m AS (SELECT regr_slope(p_retailprice, p_size) s, regr_intercept(p_retailprice, p_size) i FROM part)
SELECT p_partkey, {r6('p_retailprice - s * p_size - i')} AS residual FROM part, m""")
def regression_line_residuals(t: Tables) -> DataFrame:
    return plotprep.residuals(t.part, "p_size", "p_retailprice").select("p_partkey", rounded(c("residual")).alias("residual"))


@query(f"SELECT p_type, {r6('regr_slope(p_retailprice, p_size)')} AS slope, {r6('regr_intercept(p_retailprice, p_size)')} AS intercept FROM part GROUP BY 1")
def regression_lines_by_facet(t: Tables) -> DataFrame:
    return plotprep.regression_line(t.part, ["p_type"], "p_size", "p_retailprice").select("p_type", rounded(c("slope")).alias("slope"), rounded(c("intercept")).alias("intercept"))


_DRAWS = f"""d AS MATERIALIZED (SELECT p_type, p_size::DOUBLE AS x, p_retailprice AS y, i, {unrolled.drawn("p_partkey", "' || i || '")} AS w FROM part, range(40) r(i))"""


@query(f"""WITH {_DRAWS}, m AS (SELECT p_type, i, sum(w * y) / nullif(sum(w), 0) AS m FROM d GROUP BY ALL)
SELECT p_type, {r6("quantile_cont(m, 0.025)")} AS low, {r6("quantile_cont(m, 0.975)")} AS high FROM m GROUP BY 1""")
def bootstrap_means(t: Tables) -> DataFrame:
    out = bootstrap.mean_intervals(t.part, "p_partkey", ["p_type"], "p_retailprice", 40)
    return out.select("p_type", *(rounded(c(x)).alias(x) for x in ("low", "high")))


@query(f"""WITH {_DRAWS}, s AS (SELECT p_type, i, sum(w) AS n, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy FROM d GROUP BY ALL),
b AS (SELECT *, (n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0) AS slope FROM s), v AS (SELECT p_type, x, slope * x + (sy - slope * sx) / n AS v FROM b, (VALUES (1.0::DOUBLE), (25.0::DOUBLE), (50.0::DOUBLE)) g(x))
SELECT p_type, x, {r6("quantile_cont(v, 0.025)")} AS low, {r6("quantile_cont(v, 0.975)")} AS high FROM v GROUP BY ALL""")
def bootstrap_lines(t: Tables) -> DataFrame:
    out = bootstrap.line_intervals(t.part, "p_partkey", ["p_type"], "p_size", "p_retailprice", [1, 25, 50], 40)
    return out.select("p_type", "x", *(rounded(c(v)).alias(v) for v in ("low", "high")))
