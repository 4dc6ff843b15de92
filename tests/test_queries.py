"""Every query against its SQL, and the driver's three functions."""

import pytest

from tabulon import catalog

AT = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    from oracle import connection

    return connection(AT)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_sql(spark, con, name):
    from oracle import difference

    assert not difference(spark, con, AT, catalog.QUERIES[name], catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, AT).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 25
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_text_operators():
    """The other queries import where the subpackage and the pipeline are gone."""
    import subprocess
    import sys
    from pathlib import Path

    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name in ('corpus_pipeline', 'tabulon.llm'): raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert not [q for q in e.queries() if q.startswith('op') and q[2].isdigit()] and 'topk_global' in e.queries() and 'pipeline' not in e.queries()\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, check=True)


def test_top_n_is_pruned_before_the_shuffle(spark):
    plan = catalog.QUERIES["topk_per_group"](spark, AT)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalog.QUERIES["filter_conjunction"](spark, AT)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus)" in plan and "o_orderdate" not in plan
