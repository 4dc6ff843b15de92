import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.functions import scalars, text
from tabulon.operators import plotprep
from tabulon.operators import relational as rel
from tabulon.sources import files


def values(df):
    return [tuple(r) for r in df.collect()]


def test_positions_with_nulls_and_negative_ends(spark):
    df = spark.createDataFrame([(i,) for i in range(10)] + [(None,)], "x int").repartition(4)
    assert sorted(values(rel.positions(df, ["x"], 2, -3))) == [(x,) for x in range(1, 7)]
    assert values(rel.positions(df.filter("false"), ["x"], 0, 3)) == []
    assert sorted(values(rel.with_position(df, ["-x"], "p").filter("x >= 8"))) == [(8, 1), (9, 0)]


def test_null_rules_are_in_order(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 9)], "k int, v int")
    out = rel.null_where(df, [("v", F.col("v") > 8), ("k", F.col("v").isNull())])
    assert sorted(values(out), key=str) == [(1, 5), (None, None), (None, None)]


def test_differs(spark):
    df = spark.createDataFrame([(1, 1), (1, None), (None, None), (1, 2)], "a int, b int")
    assert len(values(df.filter(rel.differs(F.col("a"), F.col("b"))))) == 2


def test_pivot_of_repeated_cells(spark):
    df = spark.createDataFrame([(1, "a", 2), (1, "a", 3)], "i int, c string, v int")
    with pytest.raises(ValueError):
        rel.pivoted_once(df, "i", "c", ["a"], "v")
    assert values(rel.pivoted_once(df.filter("v = 2"), "i", "c", ["a", "b"], "v")) == [(1, 2, None)]


def test_unknown_members(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "v string"), spark.createDataFrame([("x",)], "v string")
    rel.assert_known(b, "v", a, "v")
    with pytest.raises(ValueError):
        rel.assert_known(a, "v", b, "v")


def test_text(spark):
    df = spark.createDataFrame([("15-30K·14", "a·b", "['x', 'y']"), ("none", "a", "")], "s string, p string, l string")
    out = values(df.select(text.third_of_range("s"), text.element("p", "·", 1), text.strip_marks("l"), text.zero_filled(F.lit("12"), 3), text.zero_filled(F.lit("12345"), 3)))
    assert out == [(20, "b", "x,y", "012", "12345"), (None, None, "", "012", "12345")]


def test_missing_values(spark):
    df = spark.createDataFrame([(float("nan"), 0.0), (1.0, 2.0)], "a double, b double")
    assert values(df.select(scalars.nan_to_null("a"), scalars.nan_to_num("a"), scalars.ratio(F.col("a"), F.col("b")).isNull())) == [(None, 0.0, True), (1.0, 1.0, False)]
    assert values(spark.createDataFrame([(1.0,), (None,)], "a double").agg(scalars.strict_avg("a"))) == [(None,)]
    with pytest.raises(ValueError):
        scalars.has_all(df, ["c"])


def test_constant_histogram(spark):
    assert values(plotprep.histogram(spark.createDataFrame([(2.0,), (2.0,), (None,)], "x double"), "x", 5)) == [(1, 2)]


def test_csv(spark, tmp_path):
    import zipfile

    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbfTurbID,x,y\n1,0,2.5\n2,1,3\n")
    df = files.read_csv(spark, str(tmp_path / "a.csv"), "TurbID int, x double, y double")
    assert values(df) == [(1, 0.0, 2.5), (2, 1.0, 3.0)]
    files.write_csv(df, str(tmp_path / "out"))
    assert sorted(values(files.read_csv(spark, str(tmp_path / "out"), df.schema))) == values(df)
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.write(tmp_path / "a.csv", "b.csv")
        z.writestr("a.csv", "TurbID,x,y\n9,9,9\n")
    assert len(values(files.read_zipped_csv(spark, str(tmp_path / "z.zip"), df.schema, 1, str(tmp_path / "out")))) == 2
    with pytest.raises(ValueError):
        files.read_zipped_csv(spark, str(tmp_path / "z.zip"), df.schema, 2, str(tmp_path / "out"))
    with pytest.raises(ValueError, match="share"):
        files.read_zipped_csv(spark, str(tmp_path / "z.zip"), df.schema, 1)


def test_paged_json(spark, tmp_path):
    (tmp_path / "1.json").write_text('{"result": [{"name": "a", "n": 1}, {"name": "b"}], "page": 1}')
    (tmp_path / "2.json").write_text('{"result": [{"name": "c", "n": 3}]}')
    assert sorted(values(files.read_paged_json(spark, str(tmp_path), "name string, n int")), key=str) == [("a", 1), ("b", None), ("c", 3)]


def test_html(spark):
    page = "<html lang=de><body><p class='x job'>A &amp; <b>B</b></p><a href='/u'>l</a><br><p>c"
    assert files.parse_fields(page, {"job": "p.job", "link": "a@href", "lang": "html@lang", "none": "h1"}) == {"job": "A & B", "link": "/u", "lang": "de", "none": None}
    df = spark.createDataFrame([(1, page), (2, None)], "i int, html string")
    assert values(files.html_fields(df, "html", {"job": "p.job"}, ["job"], ["i"])) == [(1, "A & B")]


def test_html_references():
    page = """<title> a&amp;&amp;amp;&amp &quot;b&lt;</title><a href="/u?a&amp;b">l</a><script>x &amp; y &lt;</script>"""
    wants = {"title": "title", "link": "a@href", "script": "script"}
    assert files.parse_fields(page, wants) == {"title": 'a&&amp;& "b<', "link": "/u?a&b", "script": "x &amp; y &lt;"}
    assert files.parse_fields(page, wants, ["lt", "amp"]) == {"title": "a&&amp;&amp &quot;b<", "link": "/u?a&amp;b", "script": "x &amp; y &lt;"}
    assert files.parse_fields(page, wants, []) == {"title": "a&amp;&amp;amp;&amp &quot;b&lt;", "link": "/u?a&amp;b", "script": "x &amp; y &lt;"}


def test_html_fields_query_on_odd_pages(spark, tmp_path):
    """As its SQL has it: references cut short or unknown to it stay, absent attributes are empty."""
    import duckdb

    from tabulon import catalog

    pages = ["<html lang=\"en\"><title>a&amp;&amp</title><a href=\"/x&amp;y\">x</a></html>", "<title> token = &quot;7 &lt;b&gt; &amp;lt; &#65;</title>", "<html lang=\"de\"><p>none</p>", None]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(catalog.ORACLE_SQL["html_fields"]).fetchall()
    got = catalog.QUERIES["html_fields"](spark, str(tmp_path)).select("page_id", "title", "lang", "link").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 2


def test_generated_and_saved(spark, tmp_path):
    from tabulon.ml.preprocess import standard_scaler

    df = files.blobs(spark, 90, [[0.0, 0.0], [50.0, 50.0]], 1.0, 3)
    assert {r.label for r in df.filter("x0 > 25").collect()} == {1}
    s = standard_scaler(df, ["x0", "x1"])
    files.save_fitted(s, str(tmp_path / "s.json"))
    assert files.load_fitted(str(tmp_path / "s.json")) == s
    assert len(values(files.rows(spark, [(1, "a")], "a int, b string"))) == 1


def test_long_form_and_columns(spark):
    df = spark.createDataFrame([(1, 2, 0.5)], "k int, x_a int, x_b double")
    assert rel.columns_of(df, ["x_", "k"]) == ["x_a", "x_b", "k"]
    assert sorted(values(rel.unpivoted(df, ["k"], ["x_a", "x_b"]))) == [(1, "x_a", 2.0), (1, "x_b", 0.5)]


def test_ordered_concatenation_and_counts(spark):
    df = spark.createDataFrame([("g", 2, "b"), ("g", 1, "a"), (None, 1, "z")], "g string, o int, v string")
    assert ("g", "a|b") in values(df.groupBy("g").agg(text.joined("v", "o", "|")))
    assert values(rel.value_counts(df, ["g"])) == [("g", 2)]
    assert values(rel.with_share(rel.value_counts(df, ["v"])).filter("v = 'a'").select("share")) == [(pytest.approx(1 / 3),)]


def test_first_and_last_rows(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (2, 5, "x")], "g int, t int, v string")
    assert sorted(values(rel.keep_first(df, ["g"], ["t"]).select("g", "v"))) == [(1, "a"), (2, "x")]
    assert sorted(values(rel.last_rows(df, ["g"], "t", 1).select("g", "v"))) == [(1, "c"), (2, "x")]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "g string, x double")
    assert values(rel.describe(df, ["x"])) == [("x", 0, None, None, None, None, None, None, None)]
    assert values(plotprep.histogram(df, "x", 4)) == [] and values(plotprep.box_stats(df, ["g"], "x")) == []
    assert values(rel.mode_by(df, ["g"], "x")) == []


@pytest.mark.parametrize("distinct", [3, 100_000])
def test_quantiles_by_narrowing(spark, monkeypatch, distinct):
    import numpy as np

    rng = np.random.default_rng(distinct)
    x = np.round(rng.normal(size=3000) * distinct)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").repartition(3)
    shares = (0.013, 0.9, 1.0)
    direct = rel.exact_quantiles(df, "x", shares)
    monkeypatch.setattr(rel, "DIRECT_ROWS", 10)
    monkeypatch.setattr(rel, "BRACKET_ROWS", 60)
    assert rel.exact_quantiles(df, "x", shares) == pytest.approx(np.quantile(x, shares)) and direct == pytest.approx(np.quantile(x, shares))


def test_quantiles_of_groups_by_cuts(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(None if g == 3 else g, float(x)) for g in range(4) for x in (rng.integers(0, 9, 500) if g == 1 else rng.normal(0, 1, 1 if g == 2 else 3000))] + [(5, None)]
    df = spark.createDataFrame(rows, "g int, x double").repartition(3)
    shares = [0, 0.013, 0.25, 0.5, 0.999, 1]
    want = {g: np.quantile([x for k, x in rows if k == g], shares) for g in (0, 1, 2, None)}
    for most in (1_000_000, 100):
        monkeypatch.setattr(rel, "DIRECT_ROWS", most)
        got = {r.g: r.q for r in rel.quantiles_by(df, ["g"], "x", shares, "q").collect()}
        assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g]) for g in want)
    assert rel.quantiles_by(df, [], "x", [0.5], "q").first().q == pytest.approx([np.median([x for _, x in rows if x is not None])])


def test_dearest_of_equal_prices(spark):
    """Keys beyond a million, which a sum of price and key would misorder."""
    from tabulon.plans.relational import extreme_rows

    class Tables:
        part = spark.createDataFrame([("b", 3_000_001, 10.0), ("b", 12, 10.5), ("b", 9_999_999, 10.0), ("c", 1, None)], "p_brand string, p_partkey long, p_retailprice double")

    got = {r.p_brand: (r.dearest, r.cheapest) for r in extreme_rows(Tables).collect()}
    assert got["b"] == (12, 3_000_001)


def test_order_of_a_clustered_heat_map(spark):
    assert plotprep.cluster_order([]) == [] and plotprep.cluster_order([[0]]) == [0]
    d = [[0, 9, 1, 9, 4], [9, 0, 9, 2, 9], [1, 9, 0, 9, 4], [9, 2, 9, 0, 9], [4, 9, 4, 9, 0]]
    assert plotprep.cluster_order(d) == [0, 2, 4, 1, 3]
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (300, 2))
    df = spark.createDataFrame([(float(a), float(b), float(a * 2 + 0.01 * b), float(-b)) for a, b in x], "p double, q double, r double, s double")
    rows = plotprep.clustered_correlations(df, ["p", "q", "r", "s"]).collect()
    places = {r.a: r.place_a for r in rows}
    assert abs(places["p"] - places["r"]) == 1 and len(rows) == 16 and {r.corr for r in rows if r.a == r.b} == {1.0}


def test_linear_points(spark):
    from tabulon.ml.linear import linear_regression

    df = files.linear_points(spark, 500, [2.0, -1.0], 0.5, seed=3)
    assert linear_regression(df, ["x0", "x1"], "y", normalize=False).theta == pytest.approx([0.5, 2, -1])
