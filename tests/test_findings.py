"""Sentences of the findings operators on small hand tables."""
from tablelens.operators import findings as N


def test_distribution_findings_numeric(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 2, 3, 3, 3, 4, 4, 5, 100]], "x double")
    lines = [r["finding"] for r in N.distribution_findings(df, "x").orderBy("seq").collect()]
    assert lines[0] == "Distribution Analysis for x:"
    assert lines[1].startswith("Mean: 12.70, Standard Deviation: ")
    assert "right-skewed" in lines[2]
    assert lines[-1] == "1 outliers detected (10.0% of data)"


def test_distribution_findings_text(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 4, "c string")
    lines = [r["finding"] for r in N.distribution_findings(df, "c").orderBy("seq").collect()]
    assert lines[1:] == ["2 unique categories", "Most common: 'a' (60.0% of data)",
                         "High concentration in one category - potential class imbalance"]


def test_one_paragraph(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0)], "c string, x double")
    s = N.one_paragraph(df).first()["finding"]
    assert s == "The dataset has 3 rows and 2 columns. Columns with missing values: x(1). Top values for c: a(2), b(1). "


def test_correlation_findings_none(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, -1.0), (3.0, -1.0), (4.0, 1.0)], "a double, b double")
    lines = [r["finding"] for r in N.correlation_findings(df).orderBy("seq").collect()]
    assert lines[-1] == "No significant correlations found - variables appear independent"
