"""Registered queries: sources, dispatchers, chart aliases and findings."""

from __future__ import annotations

from tablelens.operators import findings as N
from tablelens.operators import pairs as B
from tablelens.operators import profile as P
from tablelens.operators import target as G
from tablelens.plans.catalog_profile import numeric_profile_sql, top_sql
from tablelens.plans.catalog_pairs import anova_sql
from tablelens.plans.registry import T_, dirty, register
from tablelens.plans.sqlgen import DIRTY, R, long
from tablelens.session import scratch_path
from tablelens.sources import io as S


@register("s1_read_table_customer", """
SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, round(c_acctbal, 6) + 0.0 AS c_acctbal, c_mktsegment
FROM customer
""")
def q_s1(spark, sf):
    """Customer written as CSV by Spark, read back with null tokens and value-based types."""
    path = scratch_path(spark, "customer-csv")
    T_(spark, sf, "customer").write.option("header", True).csv(path)
    return S.read_table(spark, path)


@register("s3_preview_orders", """
SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6) + 0.0 AS o_totalprice, o_orderdate, o_orderpriority
FROM orders ORDER BY o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority LIMIT 10
""")
def q_s3(spark, sf):
    """S3: first 10 rows in key order."""
    df = T_(spark, sf, "orders")
    return S.preview(df, 10, df.columns)


@register("s4_sample_values_dirty", """
SELECT quantity FROM (SELECT * FROM """ + DIRTY + """) WHERE quantity IS NOT NULL
ORDER BY l_orderkey, l_linenumber, quantity LIMIT 5
""")
def q_s4(spark, sf):
    """First 5 non-null values of a column."""
    return S.sample_values(dirty(spark, sf), "quantity", 5, ["l_orderkey", "l_linenumber", "quantity"])


@register("s5_write_results_roundtrip", numeric_profile_sql("lineitem", ["l_quantity", "l_discount"], exact=True), exact=True)
def q_s5(spark, sf):
    """A result table written to parquet and read back."""
    res = P.univariate_numeric(T_(spark, sf, "lineitem"), ["l_quantity", "l_discount"])
    path = S.write_results(res, scratch_path(spark, "u1-result"))
    return spark.read.parquet(path)


@register("u4_univariate_numeric_column", numeric_profile_sql("orders", ["o_totalprice"]))
def q_u4_num(spark, sf):
    """U4: dispatch of a numeric column."""
    return P.univariate(T_(spark, sf, "orders"), "o_totalprice")


@register("u4_univariate_text_column", f"""
WITH vc AS (SELECT o_orderpriority AS v, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1),
b AS (SELECT count(o_orderpriority) AS total_count, count(*) AS rows_ FROM orders)
SELECT 'o_orderpriority' AS "column", (SELECT count(*) FROM vc) AS unique_count,
  (SELECT v FROM vc ORDER BY n DESC, v LIMIT 1) AS most_frequent, (SELECT max(n) FROM vc) AS most_frequent_count,
  rows_ - total_count AS missing_count, {R('(rows_ - total_count) * 100.0 / rows_')} AS missing_pct, total_count,
  CAST(NULL AS VARCHAR) AS error FROM b
""")
def q_u4_text(spark, sf):
    """U4: dispatch of a text column."""
    return P.univariate(T_(spark, sf, "orders"), "o_orderpriority")


@register("d9_contingency_heatmap_orders", """
SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders
WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY ALL
""")
def q_d9(spark, sf):
    """Observed cells of a text × text table (long form)."""
    return B.contingency(T_(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


@register("d13_top_category_bar_customer", top_sql("customer", ["c_mktsegment"], 10))
def q_d13(spark, sf):
    """The N largest counts of one text column."""
    return P.top_values(T_(spark, sf, "customer"), ["c_mktsegment"], 10)


@register("g4_target_contingency_customer", """
SELECT CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment, count(*) AS n FROM customer
WHERE c_nationkey IS NOT NULL AND c_mktsegment IS NOT NULL GROUP BY ALL
""")
def q_g4(spark, sf):
    """Feature × target contingency (text target)."""
    return G.target_contingency(T_(spark, sf, "customer"), "c_mktsegment", "c_nationkey")


@register("p10_dataset_stats_top_values", top_sql("orders", ["o_orderstatus", "o_orderpriority"], 3))
def q_p10(spark, sf):
    """P10: the bundle's top-3 table."""
    return P.dataset_stats(T_(spark, sf, "orders"), ["top_values"])["top_values"]


# ------------------------------------------------------------------ findings

def _paragraph_sql() -> str:
    cols = ["l_orderkey", "l_linenumber", "quantity", "returnflag", "part_text", "supp_text", "empty_col"]
    miss = " UNION ALL ".join(f"SELECT {i} AS pos, '{c}' AS c, count(*) - count({c}) AS m FROM {DIRTY}"
                              for i, c in enumerate(cols))
    cats = ["returnflag", "part_text", "supp_text"]
    tops = " UNION ALL ".join(
        f"SELECT {i} AS pos, '{c}' AS c, (SELECT string_agg(v || '(' || n || ')', ', ' ORDER BY n DESC, v) FROM "
        f"(SELECT {c} AS v, count(*) AS n FROM {DIRTY} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 3)) AS t"
        for i, c in enumerate(cats))
    return f"""
WITH m AS ({miss}), t AS ({tops}), r AS (SELECT count(*) AS n FROM {DIRTY})
SELECT 1 AS seq, 'paragraph' AS topic,
  'The dataset has ' || (SELECT n FROM r) || ' rows and {len(cols)} columns. ' ||
  coalesce('Columns with missing values: ' || (SELECT string_agg(c || '(' || m || ')', ', ' ORDER BY pos) FROM m WHERE m > 0) || '. ', '') ||
  (SELECT string_agg('Top values for ' || c || ': ' || t || '. ', '' ORDER BY pos) FROM t) AS finding
"""


@register("n7_one_paragraph_dirty", _paragraph_sql())
def q_n7(spark, sf):
    """One-paragraph summary (rows, columns, missing, top values)."""
    return N.one_paragraph(dirty(spark, sf))


def _corr_findings_sql(tbl: str, cols: list[str]) -> str:
    pairs = " UNION ALL ".join(
        f"SELECT {i} AS i, {j} AS j, '{a} - {b}' AS pair, corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS r FROM {tbl}"
        for i, a in enumerate(cols) for j, b in enumerate(cols) if j > i)
    return f"""
WITH p AS ({pairs}),
s AS (SELECT *, row_number() OVER (ORDER BY i, j) AS k FROM p WHERE abs(r) > 0.7),
m AS (SELECT *, row_number() OVER (ORDER BY i, j) AS k FROM p WHERE abs(r) > 0.3 AND abs(r) <= 0.7),
lines AS (
  SELECT 0 AS g, 0 AS k, 'Correlation Analysis Insights:' AS finding
  UNION ALL SELECT 1, 0, count(*) || ' strong correlations found (|r| > 0.7)' FROM s HAVING count(*) > 0
  UNION ALL SELECT 1, k, '  - ' || pair || ': r = ' || printf('%.3f', r) FROM s WHERE k <= 3
  UNION ALL SELECT 1, 9, 'Strong correlations may indicate multicollinearity' FROM s HAVING count(*) > 0
  UNION ALL SELECT 2, 0, count(*) || ' moderate correlations found (0.3 < |r| < 0.7)' FROM m HAVING count(*) > 0
  UNION ALL SELECT 2, k, '  - ' || pair || ': r = ' || printf('%.3f', r) FROM m WHERE k <= 3
  UNION ALL SELECT 2, 9, 'Moderate correlations suggest interesting relationships to explore' FROM m HAVING count(*) > 0
  UNION ALL SELECT 3, 0, 'No significant correlations found - variables appear independent'
    WHERE (SELECT count(*) FROM s) + (SELECT count(*) FROM m) = 0)
SELECT CAST(row_number() OVER (ORDER BY g, k) AS INTEGER) AS seq, 'correlation' AS topic, finding FROM lines
"""


@register("n2_correlation_findings_lineitem", _corr_findings_sql(
    "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def q_n2(spark, sf):
    """strong/moderate pair counts with the first three pairs of each."""
    return N.correlation_findings(T_(spark, sf, "lineitem"))


def _lines(parts: list[tuple[str, str | None]]) -> str:
    """Numbered finding lines from (sql text, sql condition) pairs."""
    body = " UNION ALL ".join(
        f"SELECT {k} AS k, {txt} AS finding FROM s" + (f" WHERE {cond}" if cond else "")
        for k, (txt, cond) in enumerate(parts))
    return body


N1_NUM_SQL = f"""
WITH v AS (SELECT l_extendedprice AS x FROM lineitem),
q AS (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM v),
s AS (SELECT avg(x) AS mean, stddev_samp(x) AS sd, skewness(x) AS sk, kurtosis(x) AS ku, count(*) AS rows_,
             (SELECT count(*) FROM v, q WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS o FROM v),
l AS ({_lines([
    ("'Distribution Analysis for l_extendedprice:'", None),
    ("printf('Mean: %.2f, Standard Deviation: %.2f', mean, sd)", None),
    ("printf('Distribution is %s-skewed (skewness: %.2f)', CASE WHEN sk > 0 THEN 'right' ELSE 'left' END, sk)", "abs(sk) > 1"),
    ("printf('Distribution is approximately normal (skewness: %.2f)', sk)", "abs(sk) <= 1"),
    ("printf('Distribution has %s tails (kurtosis: %.2f)', CASE WHEN ku > 0 THEN 'heavy-tailed' ELSE 'light-tailed' END, ku)", "abs(ku) > 3"),
    ("printf('%d outliers detected (%.1f%% of data)', o, o * 100.0 / rows_)", "o > 0"),
])})
SELECT CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS seq, 'distribution' AS topic, finding FROM l
"""

N1_TEXT_SQL = f"""
WITH vc AS (SELECT o_orderpriority AS v, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1),
s AS (SELECT (SELECT count(*) FROM vc) AS u, (SELECT v FROM vc ORDER BY n DESC, v LIMIT 1) AS top,
             (SELECT max(n) FROM vc) * 100.0 / (SELECT count(*) FROM orders) AS pct),
l AS ({_lines([
    ("'Distribution Analysis for o_orderpriority:'", None),
    ("u || ' unique categories'", None),
    ("printf('Most common: ''%s'' (%.1f%% of data)', top, pct)", None),
    ("'High concentration in one category - potential class imbalance'", "pct > 50"),
    ("'Well-distributed categories - good for analysis'", "pct < 20"),
])})
SELECT CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS seq, 'distribution' AS topic, finding FROM l
"""


@register("n1_distribution_findings_numeric", N1_NUM_SQL)
def q_n1(spark, sf):
    """A numeric column's distribution in words (sentences; checked in unit tests)."""
    return N.distribution_findings(T_(spark, sf, "lineitem"), "l_extendedprice")


@register("n1_distribution_findings_text", N1_TEXT_SQL)
def q_n1_text(spark, sf):
    """A text column's distribution in words."""
    return N.distribution_findings(T_(spark, sf, "orders"), "o_orderpriority")


@register("n3_bivariate_findings_lineitem", f"""
WITH s AS ({anova_sql("lineitem", "l_returnflag", "l_quantity")}),
l AS ({_lines([
    ("'Bivariate Analysis: l_quantity vs l_returnflag'", None),
    ("printf('ANOVA F-statistic: %.3f', f)", None),
    ("printf('Statistical significance: p = %.3f', p_value)", None),
    ("'Statistically significant difference between groups (p < 0.05)'", "p_value < 0.05"),
    ("'No statistically significant difference between groups (p ≥ 0.05)'", "p_value >= 0.05"),
])})
SELECT CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS seq, 'bivariate' AS topic, finding FROM l
""")
def q_n3(spark, sf):
    """A pair test in words."""
    return N.bivariate_findings(T_(spark, sf, "lineitem"), "l_quantity", "l_returnflag")


N4_SQL = f"""
WITH g AS (SELECT o_orderpriority AS c, count(o_totalprice) AS n, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS std
           FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1),
s AS (SELECT arg_max(c, mean) AS best, max(mean) AS bm, arg_min(c, mean) AS worst, min(mean) AS wm, avg(std) AS ms,
             arg_min(c, abs(std / mean)) AS stable, arg_max(c, abs(std / mean)) AS unstable, min(n) AS mn FROM g),
l AS ({_lines([
    ("'Target Variable Impact Analysis: o_orderpriority → o_totalprice'", None),
    ("'Pointer 1: Statistical Impact on Target Variable'", None),
    ("'o_orderpriority shows significant impact on o_totalprice'", None),
    ("printf('Best performing category: %s (mean: %.2f)', best, bm)", None),
    ("printf('Worst performing category: %s (mean: %.2f)', worst, wm)", None),
    ("printf('Impact range: %.2f units difference', bm - wm)", None),
    ("printf('High impact: Range exceeds average variability (%.2f)', ms)", "bm - wm > ms"),
    ("'Moderate impact: Range within normal variability'", "bm - wm <= ms"),
    ("'Pointer 2: Strategic Implications for Target Variable'", None),
    ("'Most stable category: ' || stable || ' (lowest variability)'", None),
    ("'Least stable category: ' || unstable || ' (highest variability)'", None),
    ("'Warning: Some categories have small sample sizes (min: ' || mn || ')'", "mn < 30"),
    ("'Good sample sizes: All categories have adequate data (min: ' || mn || ')'", "mn >= 30"),
    ("'Action: Focus on improving ' || worst || ' category performance'", "bm - wm > 2 * ms"),
    ("'Opportunity: ' || best || ' category shows best practices to replicate'", "bm - wm > 2 * ms"),
    ("'Observation: o_orderpriority has moderate influence on o_totalprice'", "bm - wm <= 2 * ms"),
    ("'Next step: Investigate other factors for stronger impact'", "bm - wm <= 2 * ms"),
])})
SELECT CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS seq, 'target' AS topic, finding FROM l
"""


@register("n4_target_findings_orders", N4_SQL)
def q_n4(spark, sf):
    """Numeric target by text feature in words."""
    return N.target_findings(T_(spark, sf, "orders"), "o_totalprice", "o_orderpriority")


N5_SQL = f"""
WITH s AS (
  SELECT (count(*) * 6 - count(o_orderkey) - count(o_custkey) - count(o_orderstatus) - count(o_totalprice)
          - count(o_orderdate) - count(o_orderpriority)) * 100.0 / (count(*) * 6) AS mp,
         count(*) AS rows_, count(DISTINCT o_totalprice) AS tu, avg(o_totalprice) AS tm, stddev_samp(o_totalprice) AS ts,
         skewness(o_orderkey) AS s0, skewness(o_custkey) AS s1, skewness(o_totalprice) AS s2,
         count(DISTINCT o_orderstatus) AS u0, count(DISTINCT o_orderpriority) AS u1,
         (abs(corr(o_orderkey, o_custkey)) > 0.7)::INT + (abs(corr(o_orderkey, o_totalprice)) > 0.7)::INT
           + (abs(corr(o_custkey, o_totalprice)) > 0.7)::INT AS strong,
         (abs(corr(o_orderkey, o_custkey)) BETWEEN 0.3 AND 0.7 AND abs(corr(o_orderkey, o_custkey)) > 0.3)::INT
           + (abs(corr(o_orderkey, o_totalprice)) > 0.3 AND abs(corr(o_orderkey, o_totalprice)) <= 0.7)::INT
           + (abs(corr(o_custkey, o_totalprice)) > 0.3 AND abs(corr(o_custkey, o_totalprice)) <= 0.7)::INT AS moderate
  FROM orders),
l AS ({_lines([
    ("printf('Data Quality Alert: %.1f%% of values are missing, indicating potential data collection issues.', mp)", "mp > 10"),
    ("printf('Data Quality: %.1f%% missing values detected, consider imputation strategies.', mp)", "mp > 5 AND mp <= 10"),
    ("printf('Data Quality: Excellent data completeness with only %.1f%% missing values.', mp)", "mp <= 5"),
    ("'Target Variable Analysis: o_totalprice is numeric with ' || tu || ' unique values.'", None),
    ("printf('Target Statistics: Mean = %.2f, Std = %.2f', tm, ts)", None),
    ("'Numeric Analysis: 3 numeric variables available for statistical analysis.'", None),
    ("printf('Distribution Alert: o_orderkey shows %s skewness (%.2f), indicating non-normal distribution.', CASE WHEN s0 > 0 THEN 'right' ELSE 'left' END, s0)", "abs(s0) > 1"),
    ("printf('Distribution Alert: o_custkey shows %s skewness (%.2f), indicating non-normal distribution.', CASE WHEN s1 > 0 THEN 'right' ELSE 'left' END, s1)", "abs(s1) > 1"),
    ("printf('Distribution Alert: o_totalprice shows %s skewness (%.2f), indicating non-normal distribution.', CASE WHEN s2 > 0 THEN 'right' ELSE 'left' END, s2)", "abs(s2) > 1"),
    ("'Categorical Analysis: 2 categorical variables with varying cardinality levels.'", None),
    ("printf('High Cardinality: o_orderstatus has %d unique values (%.1f%% of rows), consider grouping or feature engineering.', u0, u0 * 100.0 / rows_)", "u0 > rows_ * 0.8"),
    ("printf('High Cardinality: o_orderpriority has %d unique values (%.1f%% of rows), consider grouping or feature engineering.', u1, u1 * 100.0 / rows_)", "u1 > rows_ * 0.8"),
    ("'Strong Relationships: ' || strong || ' variable pairs show strong correlation (|r| > 0.7), indicating potential multicollinearity.'", "strong > 0"),
    ("'Moderate Relationships: ' || moderate || ' variable pairs show moderate correlation (0.3 < |r| < 0.7), suggesting interesting patterns to explore.'", "moderate > 0"),
    ("'Target-Focused Analysis: With o_totalprice as the target variable, focus on identifying key drivers and predictive patterns for better outcomes.'", None),
])})
SELECT CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS seq, 'dataset' AS topic,
  row_number() OVER (ORDER BY k) || '. ' || finding AS finding FROM l
"""


@register("n5_dataset_findings_orders", N5_SQL)
def q_n5(spark, sf):
    """Numbered dataset findings with a target."""
    return N.dataset_findings(T_(spark, sf, "orders"), "o_totalprice")


# ------------------------------------------------------------------ streaming

@register("p4_running_profile_stream_events", f"""
WITH long AS ({long("events", ["event_id", "user_id", "value"])})
SELECT "column", count(*) AS rows, count(value) AS "count", count(*) - count(value) AS missing,
  {R('avg(value)')} AS mean, {R('stddev_samp(value)')} AS std, {R('min(value)')} AS "min", {R('max(value)')} AS "max"
FROM long GROUP BY "column"
""")
def q_stream(spark, sf):
    """Streaming: the one-pass numeric profile of events maintained by Structured Streaming (all files, availableNow)."""
    from tablelens.streaming import profile as SP
    src = T_(spark, sf, "events")
    stream = SP.read_stream(spark, sf, src.schema, glob="events.parquet")
    name = "tl_stream_" + scratch_path(spark, "s").rsplit("-", 1)[-1]
    return SP.profile_once(spark, SP.running_numeric_profile(stream), name, scratch_path(spark, "stream-ckpt"))


@register("p8_running_value_counts_stream_events", """
SELECT 'event_type' AS "column", event_type AS value, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 2
""")
def q_stream_vc(spark, sf):
    """Streaming: value counts of a text column maintained by Structured Streaming (all files, availableNow)."""
    from tablelens.streaming import profile as SP
    src = T_(spark, sf, "events")
    stream = SP.read_stream(spark, sf, src.schema, glob="events.parquet")
    name = "tl_stream_" + scratch_path(spark, "s").rsplit("-", 1)[-1]
    return SP.profile_once(spark, SP.running_value_counts(stream, ["event_type"]), name,
                           scratch_path(spark, "stream-ckpt"))
