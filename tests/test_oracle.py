"""Every registered query against its DuckDB oracle at sf0.001 (and the entry point)."""
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as E  # noqa: E402
from oracle import compare, duck  # noqa: E402

SF = "/root/testdata/sf0.001"
NAMES = sorted(E.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "mean" in df.columns


def test_every_query_has_docs_and_oracle_keys_exist():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert all(fn.__doc__ for fn in qs.values())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    """Each query is built once: its physical plan must hold no cross join,
    and its rows must equal the oracle's."""
    from test_plans import plan_text
    df = E.queries()[name](spark, SF)
    text = plan_text(df)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    res = compare(spark, name, lambda _s, _d: df, E.oracle_sql().get(name), SF, con)
    assert res["ok"] in (True, None), res
