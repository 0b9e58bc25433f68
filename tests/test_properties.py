"""Property-based checks (hypothesis) against direct numpy/pandas formulas."""
import math
import warnings

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tablelens.functions.quantiles import average_ranks, quantiles
from tablelens.functions.special import chi2_sf, f_sf
from tablelens.operators import pairs as B

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
values = st.lists(st.one_of(st.none(), st.integers(-5, 5).map(float), st.floats(-1e3, 1e3, allow_nan=False)),
                  min_size=1, max_size=40)


@SETTINGS
@given(vals=values, probs=st.lists(st.floats(0, 1), min_size=1, max_size=4))
def test_distributed_quantiles_equal_pandas(spark, vals, probs):
    df = spark.createDataFrame([("k", v) for v in vals], "g string, v double")
    s = pd.Series([v for v in vals if v is not None], dtype="float64")
    got = quantiles(df, ["g"], "v", probs, method="distributed").collect()
    if s.empty:
        assert got == []
    else:
        assert got[0]["quantiles"] == pytest.approx(s.quantile(probs).tolist(), rel=1e-9, abs=1e-9)


@SETTINGS
@given(vals=values)
def test_distributed_ranks_equal_pandas(spark, vals):
    df = spark.createDataFrame([("k", v) for v in vals], "g string, v double")
    s = pd.Series([v for v in vals if v is not None], dtype="float64")
    got = {r["v"]: r["rank"] for r in average_ranks(df, ["g"], "v", method="distributed").collect()}
    want = dict(zip(s, s.rank()))
    assert got == pytest.approx(want)


cells = st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from("xyz")), min_size=4, max_size=60)


@SETTINGS
@given(rows=cells)
def test_chi_square_equals_dense_formula(spark, rows):
    df = spark.createDataFrame(rows, "a string, b string")
    got = B.chi_square_test(df, "a", "b").first()
    t = pd.crosstab(pd.Series([r[0] for r in rows]), pd.Series([r[1] for r in rows])).to_numpy().astype(float)
    n = t.sum()
    e = np.outer(t.sum(1), t.sum(0)) / n
    dof = (t.shape[0] - 1) * (t.shape[1] - 1)
    if dof == 1:
        d = np.abs(t - e)
        chi2 = float((((d - np.minimum(0.5, d)) ** 2) / e).sum())
    else:
        chi2 = float(((t - e) ** 2 / e).sum())
    assert got["dof"] == dof
    if dof == 0:
        assert got["chi2"] == 0.0 and got["p_value"] == 1.0
    else:
        assert got["chi2"] == pytest.approx(chi2, rel=1e-9, abs=1e-12)
        assert got["p_value"] == pytest.approx(chi2_sf(chi2, dof), rel=1e-9)


groups = st.lists(st.tuples(st.sampled_from("pqr"), st.floats(-100, 100, allow_nan=False)), min_size=5, max_size=50)


@SETTINGS
@given(rows=groups)
def test_anova_equals_direct_sums(spark, rows):
    df = spark.createDataFrame(rows, "g string, x double")
    got = B.anova_oneway(df, "g", "x").first()
    pdf = pd.DataFrame(rows, columns=["g", "x"])
    k, n = pdf.g.nunique(), len(pdf)
    grand = pdf.x.mean()
    ssb = sum(len(s) * (s.mean() - grand) ** 2 for _, s in pdf.groupby("g").x)
    ssw = sum(((s - s.mean()) ** 2).sum() for _, s in pdf.groupby("g").x)
    if k < 2 or n - k <= 0 or ssw <= 1e-9:
        return
    f = (ssb / (k - 1)) / (ssw / (n - k))
    assert got["f"] == pytest.approx(f, rel=1e-6)
    assert got["p_value"] == pytest.approx(f_sf(f, k - 1, n - k), rel=1e-6, abs=1e-12)
    assert not math.isnan(got["p_value"])


num_rows = st.lists(st.tuples(st.one_of(st.none(), st.floats(-50, 50, allow_nan=False)),
                              st.one_of(st.none(), st.floats(-50, 50, allow_nan=False)),
                              st.one_of(st.none(), st.integers(-3, 3).map(float))), min_size=3, max_size=40)


@SETTINGS
@given(rows=num_rows)
def test_correlation_plans_agree(spark, rows):
    df = spark.createDataFrame(rows, "a double, b double, c double")
    a = {(r["col_a"], r["col_b"]): (r["r"], r["n"]) for r in B.correlation_matrix(df, method="sums").collect()}
    g = {(r["col_a"], r["col_b"]): (r["r"], r["n"]) for r in B.correlation_matrix(df, method="gram").collect()}
    assert a.keys() == g.keys()
    for k in a:
        assert a[k][1] == g[k][1]
        if a[k][0] is None or g[k][0] is None:
            # undefined in one plan only when a side is (numerically) constant
            assert (a[k][0] is None) == (g[k][0] is None) or a[k][1] < 3
        else:
            assert a[k][0] == pytest.approx(g[k][0], rel=1e-7, abs=1e-9)
        pdf = pd.DataFrame(rows, columns=["a", "b", "c"]).astype(float)
        with warnings.catch_warnings():  # degenerate random samples make numpy complain
            warnings.simplefilter("ignore")
            want = pdf[k[0]].corr(pdf[k[1]])
        if a[k][0] is not None and not math.isnan(want):
            assert a[k][0] == pytest.approx(want, rel=1e-7, abs=1e-9)


@SETTINGS
@given(vals=st.lists(st.one_of(st.none(), st.floats(-1e3, 1e3, allow_nan=False)), min_size=2, max_size=60))
def test_histogram_counts_and_edges(spark, vals):
    from tablelens.operators.chartdata import histogram
    present = [v for v in vals if v is not None]
    if len(present) < 2:
        return
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    h = histogram(df, "x").orderBy("bin").collect()
    assert sum(r["count"] for r in h) == len(present)
    assert len(h) == min(50, max(10, int(math.sqrt(len(present)))))
    assert h[0]["lower"] == pytest.approx(min(present)) and h[-1]["upper"] == pytest.approx(max(present))
    assert all(x["upper"] == pytest.approx(y["lower"]) for x, y in zip(h, h[1:]))


dirty_rows = st.lists(st.tuples(st.one_of(st.none(), st.sampled_from("xyz")),
                                st.one_of(st.none(), st.integers(0, 5).map(float), st.just(1000.0))),
                      min_size=4, max_size=30)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=dirty_rows)
def test_cleaning_properties(spark, rows):
    """Fill → dedupe → cap, in that order: text has no nulls left, numbers none
    unless the column was empty, the row count drops by exactly the audited
    duplicates, and every value sits inside the fences. (Capping comes after
    deduplication, so it may create new equal rows; that order is kept.)"""
    from tablelens.operators.clean import clean
    df = spark.createDataFrame(rows, "s string, x double")
    res = clean(df)
    got = res.table.collect()
    assert all(r["s"] is not None for r in got)
    if any(x is not None for _, x in rows):
        assert all(r["x"] is not None for r in got)
    removed = {(r["stage"]): r["n"] for r in res.audit.collect() if r["stage"] == "duplicates"}["duplicates"]
    assert len(got) == len(rows) - removed
    xs = [r["x"] for r in got if r["x"] is not None]
    if xs:
        filled = pd.Series([x for _, x in rows], dtype="float64")
        filled = filled.fillna(filled.median())
        texts = pd.Series([s_ for s_, _ in rows], dtype="object")
        modes = texts.dropna().value_counts()
        fill_s = sorted(modes[modes == modes.max()].index)[0] if len(modes) else "Unknown"
        uniq = pd.DataFrame({"s": texts.fillna(fill_s), "x": filled}).drop_duplicates()
        q1, q3 = uniq["x"].quantile(0.25), uniq["x"].quantile(0.75)
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        assert all(lo - 1e-9 <= v <= hi + 1e-9 for v in xs)
