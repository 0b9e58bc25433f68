"""Plan-shape guards over the registered queries (physical plans via explain)."""
import contextlib
import io

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as E  # noqa: E402
from tablelens.operators import profile as P  # noqa: E402
from tablelens.operators import chartdata  # noqa: E402
from tablelens.session import scratch_path, scratch_scope  # noqa: E402
from tablelens.sources.tables import table  # noqa: E402

SF = "/root/testdata/sf0.001"


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def test_every_query_is_checked_for_cross_joins():
    """The per-query oracle test (test_oracle.py) also asserts the plan has no
    CartesianProduct / BroadcastNestedLoopJoin; make sure it covers every query."""
    import test_oracle
    assert test_oracle.NAMES == sorted(E.queries())


def test_top_k_limits_before_the_shuffle(spark):
    text = plan_text(P.top_values(table(spark, SF, "orders"), None, 3, method="shuffle"))
    assert text.count("WindowGroupLimit") >= 2  # partial (map side) and final


def test_profile_reads_only_needed_columns(spark):
    df = table(spark, SF, "orders").select("o_totalprice", "o_orderpriority")
    text = plan_text(P.top_values(df, ["o_orderpriority"], 3, method="shuffle"))
    assert "ReadSchema: struct<o_orderpriority:string>" in text


def test_filters_reach_the_scan_of_a_spread_table(spark):
    df = table(spark, "/root/testdata/sf0.1", "lineitem")
    text = plan_text(df.where("l_tax > 0.05").select("l_orderkey"))
    assert "PushedFilters: [IsNotNull(l_tax), GreaterThan(l_tax,0.05)]" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_tax:double" in text
    assert "LessThan(l_extendedprice" in plan_text(chartdata.outlier_rows(df, "l_extendedprice"))


def test_categorical_profiles_count_values_once(spark):
    df = table(spark, SF, "orders")
    out = P.categorical_profile(df)
    out.collect()
    assert "ReusedExchange" in plan_text(out)   # top values and unique counts share one value-count exchange
    text = plan_text(P.univariate_categorical(df))
    schemas = [line for line in text.splitlines() if line.startswith("ReadSchema")]
    assert sorted(schemas) == ["ReadSchema: struct<>", "ReadSchema: struct<o_orderstatus:string,o_orderpriority:string>"]


def test_scratch_scope_removes_only_its_own_tables(spark):
    before = scratch_path(spark, "kept")
    spark.range(3).write.parquet(before)
    with scratch_scope(spark):
        inside = scratch_path(spark, "gone")
        spark.range(3).write.parquet(inside)
    assert not os.path.exists(inside) and spark.read.parquet(before).count() == 3
