"""Registered query: the nine-section summary (N6) with its DuckDB oracle."""

from __future__ import annotations

from tablelens.operators import findings as N
from tablelens.plans.catalog_more import _lines
from tablelens.plans.registry import T_, register

_BODY = _lines([
    ("'Executive Summary'", None),
    ("format('Your dataset contains {:,} records across 6 variables.', rows_)", None),
    ("'The analysis focuses on o_totalprice as the target variable, helping identify key patterns and relationships.'", None),
    ("'Data Quality Assessment'", None),
    ("'Excellent Data Quality: Less than 5% missing values'", "mp < 5"),
    ("'Good Data Quality: Some missing values present but manageable'", "mp >= 5 AND mp < 15"),
    ("'Data Quality Concerns: High percentage of missing values detected'", "mp >= 15"),
    ("printf('Missing Values: %.1f%% of all data points', mp)", None),
    ("format('Duplicate Rows: {:,} records', dups)", None),
    ("printf('Memory Usage: %.2f MB', mem)", None),
    ("'Variable Overview'", None),
    ("'Numeric Variables: 3 columns for statistical analysis'", None),
    ("'Categorical Variables: 2 columns for grouping and classification'", None),
    ("'  - Key numeric variables: o_orderkey, o_custkey, o_totalprice'", None),
    ("'  - Key categorical variables: o_orderstatus, o_orderpriority'", None),
    ("'Target Variable Analysis: o_totalprice'", None),
    ("'Type: Numeric'", None),
    ("format('Unique Values: {:,}', tu)", None),
    ("printf('Range: %.2f to %.2f', tmin, tmax)", None),
    ("printf('Average: %.2f (±%.2f)', tm, ts)", None),
    ("'Distribution: ' || CASE WHEN tsk > 0 THEN 'right' ELSE 'left' END || '-skewed (non-normal)'", "abs(tsk) > 1"),
    ("'Distribution: Approximately normal'", "abs(tsk) <= 1"),
    ("'Key Statistical Findings'", None),
    ("'Numeric Variables'", None),
    ("printf('o_orderkey: Average = %.2f, Variability = %.2f', m0, d0)", None),
    ("printf('o_custkey: Average = %.2f, Variability = %.2f', m1, d1)", None),
    ("printf('o_totalprice: Average = %.2f, Variability = %.2f', tm, ts)", None),
    ("'Categorical Variables'", None),
    ("printf('o_orderstatus: %d categories, most common: %s', u0, chr(39) || f0 || chr(39))", None),
    ("printf('o_orderpriority: %d categories, most common: %s', u1, chr(39) || f1 || chr(39))", None),
    ("'Relationship Analysis'", None),
    ("'Strong Relationships Found: ' || strong || ' variable pairs show strong correlation'", "strong > 0"),
    ("'Moderate Relationships: ' || moderate || ' variable pairs show moderate correlation'", "moderate > 0"),
    ("'Independent Variables: No strong correlations found - variables appear independent'", "strong + moderate = 0"),
    ("'Target-Focused Insights for o_totalprice'", None),
    ("'Top Features Affecting Target Variable:'", "(SELECT count(*) FROM top3) > 0"),
])

N6_SQL = """
WITH s AS (
  SELECT count(*) AS rows_,
         (count(*) * 6 - count(o_orderkey) - count(o_custkey) - count(o_orderstatus) - count(o_totalprice)
          - count(o_orderdate) - count(o_orderpriority)) * 100.0 / (count(*) * 6) AS mp,
         (count(*) * 32 + sum(coalesce(strlen(o_orderstatus), 0) + coalesce(strlen(o_orderpriority), 0)))
           / (1024.0 * 1024.0) AS mem,
         (SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM orders
            GROUP BY o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority)) AS dups,
         count(DISTINCT o_totalprice) AS tu, min(o_totalprice) AS tmin, max(o_totalprice) AS tmax,
         avg(o_totalprice) AS tm, stddev_samp(o_totalprice) AS ts, skewness(o_totalprice) AS tsk,
         avg(o_orderkey) AS m0, stddev_samp(o_orderkey) AS d0, avg(o_custkey) AS m1, stddev_samp(o_custkey) AS d1,
         count(DISTINCT o_orderstatus) AS u0,
         (SELECT v FROM (SELECT o_orderstatus AS v, count(*) AS n FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1)
          ORDER BY n DESC, v LIMIT 1) AS f0,
         count(DISTINCT o_orderpriority) AS u1,
         (SELECT v FROM (SELECT o_orderpriority AS v, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1)
          ORDER BY n DESC, v LIMIT 1) AS f1,
         (abs(corr(o_orderkey, o_custkey)) > 0.7)::INT + (abs(corr(o_orderkey, o_totalprice)) > 0.7)::INT
           + (abs(corr(o_custkey, o_totalprice)) > 0.7)::INT AS strong,
         (abs(corr(o_orderkey, o_custkey)) > 0.3 AND abs(corr(o_orderkey, o_custkey)) <= 0.7)::INT
           + (abs(corr(o_orderkey, o_totalprice)) > 0.3 AND abs(corr(o_orderkey, o_totalprice)) <= 0.7)::INT
           + (abs(corr(o_custkey, o_totalprice)) > 0.3 AND abs(corr(o_custkey, o_totalprice)) <= 0.7)::INT AS moderate
  FROM orders),
rel AS (
  SELECT 0 AS position, 'o_orderkey' AS feature, 'Correlation' AS impact_type, abs(corr(o_totalprice, o_orderkey)) AS strength,
         corr(o_totalprice, o_orderkey) AS value, 2 AS groups FROM orders
  UNION ALL SELECT 1, 'o_custkey', 'Correlation', abs(corr(o_totalprice, o_custkey)), corr(o_totalprice, o_custkey), 2 FROM orders
  UNION ALL SELECT 2, 'o_orderstatus', 'Range', max(m) - min(m), max(m) - min(m), count(*) FROM
    (SELECT avg(o_totalprice) AS m FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY o_orderstatus)
  UNION ALL SELECT 5, 'o_orderpriority', 'Range', max(m) - min(m), max(m) - min(m), count(*) FROM
    (SELECT avg(o_totalprice) AS m FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority)),
rk AS (SELECT row_number() OVER (ORDER BY strength DESC, position) AS r, * FROM rel WHERE value IS NOT NULL AND groups > 1),
top3 AS (SELECT * FROM rk WHERE r <= 3),
body AS (
  """ + _BODY + """
  UNION ALL SELECT 40 + r, r || '. ' || feature || ': ' ||
    CASE WHEN impact_type = 'Correlation' THEN printf('Correlation = %.3f', value) ELSE printf('Range effect = %.2f', value) END
    FROM top3
  UNION ALL SELECT 50, 'Recommendations'
  UNION ALL SELECT 51, 'Data Collection: Address missing data issues before modeling' FROM s WHERE mp > 10
  UNION ALL SELECT 52, 'Modeling Focus: Use o_totalprice as target for predictive modeling'
  UNION ALL SELECT 53, 'Key Predictor: ' || feature || ' shows strongest relationship with target' FROM top3 WHERE r = 1
  UNION ALL SELECT 54, 'Multicollinearity: Consider feature selection to address highly correlated variables' FROM s WHERE strong > 0
  UNION ALL SELECT 55, 'Mixed Analysis: Combine numeric and categorical approaches for comprehensive insights'
  UNION ALL SELECT 56, 'Next Steps: Consider advanced modeling techniques based on your specific goals'
  UNION ALL SELECT 57, 'Quick Action Items'
  UNION ALL SELECT 58, '1. Review Data Quality: Check the data quality assessment above'
  UNION ALL SELECT 59, '2. Explore Relationships: Use the correlation analysis to identify key patterns'
  UNION ALL SELECT 60, '3. Focus on Target: Analyze how other variables relate to o_totalprice'
  UNION ALL SELECT 61, '4. Generate Visualizations: Use the advanced visualization tabs for deeper insights'
  UNION ALL SELECT 62, '5. Export Results: Download the summary and statistics for further analysis')
SELECT CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS seq, 'summary' AS topic, finding FROM body
"""



@register("n6_executive_summary_orders", N6_SQL)
def q_n6(spark, sf):
    """The nine-section summary with a numeric target."""
    return N.executive_summary(T_(spark, sf, "orders"), "o_totalprice")
