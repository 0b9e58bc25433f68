"""The quantile/rank plans agree with each other and with pandas."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablelens.functions.quantiles import average_ranks, quantiles


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    n = 3000
    g = rng.choice(["a", "b", "c"], size=n, p=[0.6, 0.3, 0.1])   # a hot key
    v = np.round(rng.normal(50, 20, size=n), 1)                  # many ties
    v[rng.random(n) < 0.05] = np.nan
    pdf = pd.DataFrame({"g": g, "v": v})
    return pdf, spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))


@pytest.mark.parametrize("method", ["percentile", "distributed"])
def test_quantiles_match_pandas(data, method):
    pdf, df = data
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {r["g"]: r["quantiles"] for r in quantiles(df, ["g"], "v", probs, method=method).collect()}
    for key, grp in pdf.groupby("g"):
        want = grp["v"].dropna().quantile(probs).tolist()
        assert got[key] == pytest.approx(want, rel=1e-12)


@pytest.mark.parametrize("method", ["window", "distributed"])
def test_average_ranks_match_pandas(data, method):
    pdf, df = data
    ranks = average_ranks(df, ["g"], "v", method=method).toPandas()
    for key, grp in pdf.groupby("g"):
        vals = grp["v"].dropna()
        want = dict(zip(vals, vals.rank()))
        got = ranks[ranks.g == key].set_index("v")["rank"]
        for value, r in got.items():
            assert r == pytest.approx(want[value])


def test_spearman_matches_pandas(spark):
    from tablelens.operators.pairs import spearman_test
    rng = np.random.default_rng(3)
    x = rng.integers(0, 20, 500).astype(float)
    y = x + rng.integers(0, 10, 500)
    pdf = pd.DataFrame({"x": x, "y": y})
    df = spark.createDataFrame(pdf)
    want = pdf["x"].rank().corr(pdf["y"].rank())
    for method in ("window", "distributed"):
        assert spearman_test(df, "x", "y", method=method).first()["rho"] == pytest.approx(want, rel=1e-12)


def test_profile_plans_agree(spark):
    """The one-scan profile gives the same answer through both quantile plans."""
    from tablelens.operators.profile import numeric_summary
    from tablelens.sources.tables import dirty_lineitem
    d = dirty_lineitem(spark, "/root/testdata/sf0.001")
    a = {r["column"]: r.asDict() for r in numeric_summary(d, method="percentile").collect()}
    b = {r["column"]: r.asDict() for r in numeric_summary(d, method="distributed").collect()}
    assert a.keys() == b.keys()
    for c in a:
        for k, x in a[c].items():
            assert (x == pytest.approx(b[c][k])) if isinstance(x, float) else x == b[c][k], (c, k)


def test_grouped_box_plans_agree(spark):
    from tablelens.operators.chartdata import grouped_box
    from tablelens.sources.tables import table
    o = table(spark, "/root/testdata/sf0.001", "orders")
    a = sorted(tuple(r) for r in grouped_box(o, "o_orderpriority", "o_totalprice", method="percentile").collect())
    b = sorted(tuple(r) for r in grouped_box(o, "o_orderpriority", "o_totalprice", method="distributed").collect())
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x[0] == y[0] and x[1:] == pytest.approx(y[1:])


@pytest.mark.parametrize("limit", [10, 10**9])
def test_auto_plan_from_counted_table(data, limit):
    """No row hint: the counted table is built once and sized; both outcomes agree with pandas."""
    pdf, df = data
    probs = [0.25, 0.5, 0.75]
    got = {r["g"]: r["quantiles"] for r in quantiles(df, ["g"], "v", probs, method="auto", small_limit=limit).collect()}
    for key, grp in pdf.groupby("g"):
        assert got[key] == pytest.approx(grp["v"].dropna().quantile(probs).tolist(), rel=1e-12)
    ranks = average_ranks(df, ["g"], "v", method="auto", small_limit=limit).toPandas()
    for key, grp in pdf.groupby("g"):
        vals = grp["v"].dropna()
        want = dict(zip(vals, vals.rank()))
        for value, r in ranks[ranks.g == key].set_index("v")["rank"].items():
            assert r == pytest.approx(want[value])


def test_correlation_plans_agree_with_nulls(spark):
    """The one-aggregation plan and the per-task matrix plan give the same pairwise-complete r."""
    from tablelens.operators.pairs import correlation_matrix
    from tablelens.sources.tables import dirty_lineitem
    d = dirty_lineitem(spark, "/root/testdata/sf0.001").selectExpr(
        "l_orderkey", "l_linenumber", "quantity", "try_cast(part_text as double) as part_num")
    a = {(r["col_a"], r["col_b"]): (r["r"], r["n"]) for r in correlation_matrix(d, method="sums").collect()}
    b = {(r["col_a"], r["col_b"]): (r["r"], r["n"]) for r in correlation_matrix(d, method="gram").collect()}
    assert a.keys() == b.keys() and len(a) == 10
    for k in a:
        assert a[k][1] == b[k][1] and a[k][0] == pytest.approx(b[k][0], rel=1e-9, abs=1e-12)


def test_profile_large_path_written_table(spark, monkeypatch):
    """Above the small limit the counted table is written to the shared folder; same answer."""
    import tablelens.operators.profile as prof
    from tablelens.sources.tables import table
    o = table(spark, "/root/testdata/sf0.001", "orders")
    a = sorted(tuple(r) for r in prof.numeric_summary(o).collect())
    monkeypatch.setattr(prof, "SMALL_LIMIT", 10)
    b = sorted(tuple(r) for r in prof.numeric_summary(o).collect())
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x[0] == y[0] and [v for v in x[1:] if not isinstance(v, str)] == pytest.approx(
            [v for v in y[1:] if not isinstance(v, str)])


def test_profile_mixed_plans_per_column(spark, monkeypatch):
    """A limit between the columns' cardinalities mixes both plans in one call; same answer."""
    import tablelens.operators.profile as prof
    from tablelens.sources.tables import table
    o = table(spark, "/root/testdata/sf0.001", "orders")
    uniq = {r["column"]: r["unique_count"] for r in prof.numeric_summary(o).collect()}
    a = sorted(tuple(r) for r in prof.numeric_summary(o).collect())
    limit = sorted(uniq.values())[0]
    assert limit < max(uniq.values())
    monkeypatch.setattr(prof, "SMALL_LIMIT", limit)
    b = sorted(tuple(r) for r in prof.numeric_summary(o).collect())
    for x, y in zip(a, b):
        assert x[0] == y[0] and [v for v in x[1:] if not isinstance(v, str)] == pytest.approx(
            [v for v in y[1:] if not isinstance(v, str)])
