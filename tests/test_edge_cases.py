"""Hand tables: empty, one row, constant, NaN, ties, pairwise nulls, 2×2, dates, targets, separation."""
import math

import pytest

from tablelens.operators import checks as V
from tablelens.operators import clean as C
from tablelens.operators import kinds as K
from tablelens.operators import pairs as B
from tablelens.operators import profile as P
from tablelens.operators import target as G


def test_empty_table(spark):
    df = spark.createDataFrame([], "a double, s string")
    u = P.univariate_numeric(df, ["a"]).first()
    assert u["count"] == 0 and u["error"] == "No valid numeric data" and u["mean"] is None
    c = P.univariate_categorical(df, ["s"]).first()
    assert c["unique_count"] == 0 and c["error"] == "No valid categorical data"
    issues = {r["check"] for r in V.validate(df).collect()}
    assert {"min_rows", "all_null"} <= issues


def test_one_row(spark):
    df = spark.createDataFrame([(2.0, "x")], "a double, s string")
    d = P.describe_numeric(df).first()
    assert d["count"] == 1 and d["mean"] == 2.0 and d["std"] is None
    assert d["skewness"] is None and d["kurtosis"] is None
    assert d["q25"] == d["median"] == d["q75"] == 2.0


def test_constant_column(spark):
    df = spark.createDataFrame([(5.0, float(i)) for i in range(1, 6)], "a double, b double")
    d = {r["column"]: r for r in P.describe_numeric(df).collect()}
    assert d["a"]["skewness"] == 0.0 and d["a"]["kurtosis"] == 0.0 and d["a"]["std"] == 0.0
    r = B.correlation_matrix(df, diagonal=False).first()
    assert r["r"] is None
    assert B.pearson_test(df, "a", "b").first()["p_value"] is None


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "a double")
    u = P.univariate_numeric(df, ["a"]).first()
    assert u["count"] == 2 and u["missing_count"] == 2 and u["mean"] == 2.0
    assert P.missing_per_column(df).first()["missing"] == 2


def test_mode_ties_take_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,)], "c string")
    assert P.univariate_categorical(df).first()["most_frequent"] == "a"
    fills = {r["column"]: r for r in C.fill_values(df).collect()}
    assert fills["c"]["fill_text"] == "a"
    top = P.top_values(df, k=2).orderBy("rank").collect()
    assert [r["value"] for r in top] == ["a", "b"] and top[0]["pct"] == pytest.approx(33.33)


def test_pairwise_complete_pearson(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, None), (3.0, 5.0), (4.0, 1.0), (None, 9.0)], "a double, b double")
    r = B.pearson_test(df, "a", "b").first()
    assert r["n"] == 3 and r["r"] == pytest.approx(-0.0524142418, abs=1e-9)


def test_two_by_two_yates(spark):
    rows = [("x", "p")] * 10 + [("x", "q")] * 20 + [("y", "p")] * 30 + [("y", "q")] * 25
    df = spark.createDataFrame(rows, "a string, b string")
    r = B.chi_square_test(df, "a", "b").first()
    obs = {("x", "p"): 10, ("x", "q"): 20, ("y", "p"): 30, ("y", "q"): 25}
    n = 85
    ra = {"x": 30, "y": 55}
    cb = {"p": 40, "q": 45}
    chi = 0.0
    for (i, j), o in obs.items():
        e = ra[i] * cb[j] / n
        d = abs(o - e)
        chi += (d - min(0.5, d)) ** 2 / e
    assert r["dof"] == 1 and r["chi2"] == pytest.approx(chi, rel=1e-12)
    assert r["p_value"] == pytest.approx(math.erfc(math.sqrt(chi / 2)), rel=1e-9)


def test_date_conversion_all_or_nothing(spark):
    mixed = spark.createDataFrame([("2024-01-02",), ("01/02/2024",), ("junk",)], "d string")
    iso = spark.createDataFrame([("2024-01-02",), ("2023-12-31",)], "d string")
    assert C.conversions(mixed) == {"d": "Kept as categorical"}
    assert C.conversions(iso) == {"d": "Converted to datetime"}
    out = K.apply_conversions(iso, C.conversions(iso))
    assert out.schema["d"].dataType.typeName().startswith("timestamp")


def test_number_token_rule(spark):
    df = spark.createDataFrame([("1e3",), (" 12 ",), (".5",), ("-3.",), ("1d",), ("NaN",), ("?",), ("inf",)], "s string")
    r = K.coercion_rules(df).first()
    assert r["numeric"] == 4 and r["any_value"] and not r["majority_non_null"] is None


def test_detect_targets(spark):
    rows = [("yes" if i % 2 else "no", float(i * 10), float(i * 1000)) for i in range(20)]
    df = spark.createDataFrame(rows, "target_y string, score double, big double")
    got = {(r["column"], r["confidence"]) for r in G.detect_targets(df).collect()}
    assert ("target_y", "high") in got and ("target_y", "medium") in got and ("score", "low") in got
    assert ("big", "low") not in got


def test_class_separation_two_classes(spark):
    import statistics as st
    a = [1.0, 2.0, 3.0, 4.0]
    b = [3.0, 5.0, 7.0, 9.0]
    df = spark.createDataFrame([("A", x) for x in a] + [("B", x) for x in b], "cls string, x double")
    r = G.class_separation(df, "cls", "x").first()
    d = abs(st.mean(a) - st.mean(b)) / math.sqrt((st.stdev(a) ** 2 + st.stdev(b) ** 2) / 2)
    assert r["cohens_d"] == pytest.approx(d) and r["threshold"] == pytest.approx((2.5 + 6.0) / 2)
    assert r["separation"] == ("strong" if d > 0.8 else "moderate" if d > 0.5 else "weak")


def test_unknown_fill_and_audit(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (1.0, None), (100.0, None)] + [(2.0, None)] * 8,
                               "x double, e string")
    res = C.clean(df)
    audit = {(r["stage"], r["column"]): r for r in res.audit.collect()}
    assert audit[("missing", "e")]["detail"] == "Filled with 'Unknown'"
    assert audit[("missing", "x")]["detail"].startswith("Filled with median: ")
    assert audit[("duplicates", None)]["n"] > 0
    vals = {r["e"] for r in res.table.collect()}
    assert vals == {"Unknown"}


def test_read_table_tokens_and_types(spark, tmp_path):
    from tablelens.sources.io import read_table
    p = tmp_path / "t.csv"
    p.write_text("a,b.c,d,e,f\n1,2.5,x,True,NA\n2,?,y,False,\n3,4,,True,null\n")
    df = read_table(spark, str(p))
    types = dict(df.dtypes)
    assert df.columns == ["a", "b_c", "d", "e", "f"]
    assert types["a"] == "bigint" and types["b_c"] == "string" and types["e"] == "boolean" and types["f"] == "string"
    rows = df.orderBy("a").collect()
    assert rows[1]["b_c"] == "?" and rows[2]["d"] is None and all(r["f"] is None for r in rows)


def test_display_rounding(spark):
    df = spark.createDataFrame([("a", 1.23456), ("a", 2.34567), ("b", 3.0)], "c string, x double")
    r = B.group_statistics(df, "c", "x", decimals=3).where("c = 'a'").first()
    assert r["mean"] == 1.790 and r["count"] == 2
    d = P.describe_numeric(df, decimals=3).first()
    assert d["mean"] == round((1.23456 + 2.34567 + 3.0) / 3, 3)


def test_clean_keeps_rows_that_differ_in_large_ids(spark):
    import datetime

    from tablelens.operators import clean
    rows = [(2 ** 53 + i, i % 7 != 0, datetime.datetime(2024, 1, 1 + i) if i % 3 else None, float(i)) for i in range(1, 13)]
    out = clean.clean(spark.createDataFrame(rows, "id long, ok boolean, ts timestamp, x double"))
    got = out.table.collect()
    assert len(got) == 12 and out.table.schema["ok"].dataType.simpleString() == "boolean"
    assert all(r["ts"] is not None for r in got) and sum(not r["ok"] for r in got) == 1


def test_contingency_takes_any_class_name(spark):
    from tablelens.operators import pairs, target
    rows = [("a", "X"), ("x", "x"), ("`", "a"), ("b", "n"), ("b", "X")] * 3
    df = spark.createDataFrame(rows, "f string, t string")
    assert pairs.contingency(df, "f", "t", zeros=True).count() == 16
    r = target.association_residuals(df, "t", "f").first()
    n, total = pairs.contingency(df, "f", "t", zeros=True).collect(), 15.0
    ra, cb = {}, {}
    for x in n:
        ra[x["f"]] = ra.get(x["f"], 0) + x["n"]
        cb[x["t"]] = cb.get(x["t"], 0) + x["n"]
    res = [(x["n"] - ra[x["f"]] * cb[x["t"]] / total) / total / (ra[x["f"]] * cb[x["t"]] / total ** 2) ** 0.5 for x in n]
    assert abs(r["min_residual"] - min(res)) < 1e-9 and abs(r["max_residual"] - max(res)) < 1e-9 and r["min_count"] == 0


def test_chi_square_with_huge_cells(spark):
    from tablelens.operators import pairs
    cells = spark.createDataFrame([("a", "x", 4 * 10 ** 9), ("a", "y", 4 * 10 ** 9), ("b", "x", 4 * 10 ** 9), ("b", "y", 4 * 10 ** 9 + 10 ** 6),
                                   ("c", "x", 4 * 10 ** 9)], "a string, b string, n long")
    st = pairs.chi_square_stats(cells)
    assert st["dof"] == 2 and st["chi2"] > 0 and st["p_value"] == 0.0


def test_constant_column_has_no_skew(spark):
    from tablelens.operators import profile
    r = profile.univariate_numeric(spark.createDataFrame([(0.1,)] * 10, "x double")).first()
    assert (r["std"], r["skewness"], r["kurtosis"]) == (0.0, 0.0, 0.0)


def test_dates_in_many_forms(spark):
    from tablelens.operators import kinds
    texts = ["2024-01-05T10:11:12.5", "2024-01-05 10:11", "01-02-2024", "2024-01-07", "2024-01-05T10:11:12Z", "Jan 5, 2024", "13/02/2024", "soon"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    masks = [r[0] for r in df.select(kinds.date_mask("t")).collect()]
    assert [m != 0 for m in masks] == [True] * 7 + [False]
    reading = kinds.first_reading(masks[2])           # month first where both readings fit
    got = df.limit(3).select(kinds.to_datetime("t", reading)).collect()[2][0]
    assert (got.month, got.day) == (1, 2)


def test_one_reading_a_column(spark):
    from tablelens.operators import clean, kinds
    both = ["01/02/2024", "03/04/2024 10:30"]
    df = spark.createDataFrame([
        (a, a.replace("/", "-"), "13/02/2024" if i == 1 else a, ["01/02/2024", "03-04-2024"][i % 2], ["2024-01-05", "2024-01-05T10:11:12Z"][i % 2], None if i else "Jan 5, 2024", i)
        for i, a in enumerate(both * 6)], "month string, dashed string, day string, mixed string, iso string, named string, id int")
    assert clean.conversions(df) == {"month": "Converted to datetime", "dashed": "Converted to datetime", "day": "Converted to datetime",
                                     "mixed": "Kept as categorical", "iso": "Converted to datetime", "named": "Converted to datetime"}
    got = kinds.apply_conversions(df, clean.conversions(df)).where("id < 2").orderBy("id").collect()
    assert [(r["month"].month, r["month"].day) for r in got] == [(1, 2), (3, 4)] and got[1]["month"].hour == 10
    assert [(r["day"].month, r["day"].day) for r in got] == [(2, 1), (2, 13)] and got[0]["mixed"] == "01/02/2024"
    # the example of three ways to write a date in one column stays text, and the series takes its commonest reading
    three = spark.createDataFrame([("01/02/2024", 1.0), ("13/02/2024", 2.0), ("03-04-2024", 3.0)], "t string, v double")
    assert clean.conversions(three) == {"t": "Kept as categorical"}
    from tablelens.operators.chartdata import time_series
    assert [(r["t"].month, r["t"].day) for r in time_series(three, "t", "v").collect()] == [(2, 1), (2, 13)]


def test_csv_quotes(spark, tmp_path):
    from tablelens.sources import io
    (tmp_path / "q.csv").write_text('id,text,a.b,a_b\n1,"he said ""hi"", ok",1,2\n2,"two\nlines",3,4\n')
    rows = io.read_table(spark, str(tmp_path / "q.csv"), multi_line=True)
    assert [r["text"] for r in rows.collect()] == ['he said "hi", ok', "two\nlines"] and len(set(rows.columns)) == 4


def test_findings_survive_undefined_statistics(spark):
    import pytest

    from tablelens.operators import findings
    df = spark.createDataFrame([(1.0, None, "a", 5.0), (2.0, None, "b", 5.0), (3.0, None, "b", 5.0)], "x double, void double, c string, k double")
    assert findings.distribution_findings(df, "void").count() > 0
    assert findings.bivariate_findings(df, "x", "k").count() > 0
    assert findings.target_findings(df, "x", "k").count() > 0 and findings.target_findings(df, "x", "c").count() > 0
    assert findings.dataset_findings(df, "void").count() > 0 and findings.executive_summary(df, "void").count() > 0
    with pytest.raises(ValueError):
        findings.dataset_findings(df, "nope")
