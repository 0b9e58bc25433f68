"""The end-to-end flow produces every result table."""
from tablelens.plans.report import analyze
from tablelens.sources.tables import dirty_lineitem

SF = "/root/testdata/sf0.001"


def test_analyze_dirty_with_target(spark):
    res = analyze(dirty_lineitem(spark, SF), target="quantity")
    for name in ["issues", "cleaning_audit", "table", "schema", "info", "missing", "numeric_profile",
                 "categorical_profile", "correlations", "groupby_grid", "target_summary", "feature_impact",
                 "top_impact", "findings", "summary"]:
        assert name in res, name
        res[name].count()
    issues = {r["check"] for r in res["issues"].collect()}
    assert {"all_null", "duplicates"} <= issues
    assert res["table"].count() == res["table"].dropDuplicates().count()


def test_analyze_text_target(spark):
    from tablelens.operators import findings as N
    from tablelens.sources.tables import table
    df = table(spark, SF, "orders")
    res = analyze(df, target="o_orderpriority", clean=False)
    assert res["target_summary"].first()["type"] == "categorical"
    assert res["top_impact"].count() == 3
    lines = [r["finding"] for r in N.target_findings(df, "o_orderpriority", "o_orderstatus").orderBy("seq").collect()]
    assert lines[1] == "Pointer 1: Association Strength Between Variables" and lines[2].startswith("Chi-square statistic: ")
