"""Registered queries: the plans for large inputs forced on the test tables,
every part of the P10 bundle, the scatter grid, cleaning of wide ids, and the
other kinds of N3 and N4 findings (fixed values: their sentences)."""

from __future__ import annotations

from tablelens.operators import chartdata as D
from tablelens.operators import clean as C
from tablelens.operators import findings as N
from tablelens.operators import pairs as B
from tablelens.operators import profile as P
from tablelens.plans.catalog_charts import hist_sql
from tablelens.plans.catalog_more import _lines
from tablelens.plans.catalog_pairs import chi_sql, corr_sql, pearson_sql
from tablelens.plans.catalog_profile import describe_sql, info_sql, missing_sql, numeric_profile_sql
from tablelens.plans.registry import ORACLE, T_, register
from tablelens.plans.sqlgen import R
from tablelens.sources.tables import table

ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
ORDERS_NUM = ["o_orderkey", "o_custkey", "o_totalprice"]
LARGE = "distributed"


@register("u1_univariate_numeric_large_plan_orders", numeric_profile_sql("orders", ORDERS_NUM))
def q_u1(spark, sf):
    """U1 by the range-partitioned quantile plan."""
    return P.univariate_numeric(T_(spark, sf, "orders"), method=LARGE)


@register("p4_describe_numeric_large_plan_supplier", describe_sql("supplier", ["s_suppkey", "s_nationkey", "s_acctbal"]))
def q_p4(spark, sf):
    """P4-P6 by the range-partitioned quantile plan."""
    return P.describe_numeric(T_(spark, sf, "supplier"), method=LARGE)


@register("d2_box_stats_large_plan_part", ORACLE["d2_box_stats_part"])
def q_d2(spark, sf):
    """D2 by the range-partitioned quantile plan."""
    return D.box_stats(T_(spark, sf, "part"), method=LARGE)


@register("d10_grouped_box_large_plan_orders", ORACLE["d10_grouped_box_orders"])
def q_d10(spark, sf):
    """D10 by the range-partitioned quantile plan."""
    return D.grouped_box(T_(spark, sf, "orders"), "o_orderpriority", "o_totalprice", method=LARGE)


@register("d12_outlier_rows_large_plan_events", ORACLE["d12_outlier_rows_events"])
def q_d12(spark, sf):
    """D12 by the range-partitioned quantile plan."""
    return D.outlier_rows(T_(spark, sf, "events"), "value", method=LARGE)


@register("m2_groupby_grid_large_plan_orders", ORACLE["m2_groupby_grid_orders"])
def q_m2(spark, sf):
    """M2 by the range-partitioned quantile plan."""
    return B.groupby_grid(T_(spark, sf, "orders"), method=LARGE)


@register("p10_dataset_stats_info", info_sql("orders", ORDERS, 8 * 4, ["o_orderstatus", "o_orderpriority"]))
def q_p10_info(spark, sf):
    """P10: the bundle's rows, columns, duplicates and size."""
    return P.dataset_stats(T_(spark, sf, "orders"), ["info"])["info"]


@register("p10_dataset_stats_missing", missing_sql("orders", ORDERS, None))
def q_p10_missing(spark, sf):
    """P10: the bundle's missing cells per column."""
    return P.dataset_stats(T_(spark, sf, "orders"), ["missing"])["missing"]


@register("p10_dataset_stats_correlation",
          f"SELECT col_a, col_b, i, j, {R('r')} AS r, n FROM ({corr_sql('orders', ORDERS_NUM)})")
def q_p10_correlation(spark, sf):
    """P10: the bundle's correlation pairs."""
    return P.dataset_stats(T_(spark, sf, "orders"), ["correlation"])["correlation"]


@register("d8_scatter_bins_lineitem", f"""
WITH v AS (SELECT CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem
           WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL),
s AS (SELECT CAST(least(50, greatest(10, floor(sqrt(count(*))))) AS BIGINT) AS k, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM v),
b AS (SELECT least(k, CAST(floor(CAST(k AS DOUBLE) * (x - x0) / (x1 - x0)) AS BIGINT) + 1) AS x_bin,
             least(k, CAST(floor(CAST(k AS DOUBLE) * (y - y0) / (y1 - y0)) AS BIGINT) + 1) AS y_bin, count(*) AS n FROM v, s GROUP BY 1, 2)
SELECT x_bin, y_bin, {R('x0 + (x_bin - 1) * ((x1 - x0) / k)')} AS x_lower, {R('y0 + (y_bin - 1) * ((y1 - y0) / k)')} AS y_lower, n AS "count"
FROM b, s
""")
def q_d8_bins(spark, sf):
    """Every point of the scatter plot, counted on a grid."""
    return D.scatter_bins(T_(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


@register("d8_scatter_margins_lineitem", f"""
SELECT 'x' AS axis, * FROM ({hist_sql("lineitem", "l_quantity")}) UNION ALL SELECT 'y', * FROM ({hist_sql("lineitem", "l_extendedprice")})
""")
def q_d8_margins(spark, sf):
    """The histograms of both axes."""
    return D.scatter_margins(T_(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


# The wide view: ids beyond what a double can tell apart, a boolean, null
# numbers and null timestamps, repeated rows. The same text runs on both sides.
WIDE_SQL = """
SELECT o_orderkey + 9007199254740992 AS wide_id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS price,
  o_custkey % 20 = 0 AS seldom, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate END AS ordered, o_orderstatus
FROM {src}
UNION ALL
SELECT o_orderkey + 9007199254740992, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END,
  o_custkey % 20 = 0, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate END, o_orderstatus
FROM {src} WHERE o_orderkey % 13 = 0
"""


@register("c7_clean_wide_ids_orders", f"""
WITH d AS ({WIDE_SQL.format(src="orders")}),
m AS (SELECT quantile_cont(price, 0.5) AS p, quantile_disc(ordered, 0.5) AS o FROM d),
u AS (SELECT DISTINCT wide_id, coalesce(price, p) AS price, seldom, coalesce(ordered, o) AS ordered, o_orderstatus FROM d, m),
q AS (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b FROM u)
SELECT wide_id, {R('least(greatest(price, a - 1.5 * (b - a)), b + 1.5 * (b - a))')} AS price, seldom, ordered, o_orderstatus FROM u, q
""")
def q_c7_wide(spark, sf):
    """Ids beyond a double keep their type and value, no distinct row is lost, null timestamps are filled, booleans stay."""
    table(spark, sf, "orders", balance=False).createOrReplaceTempView("orders_wide_src")
    return C.clean(spark.sql(WIDE_SQL.format(src="orders_wide_src"))).table


# Every seventh timestamp is null, the others are all different. The same text runs on both sides.
MOMENTS_SQL = "SELECT 'e' || event_id AS event, CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END AS ts, event_type FROM {src}"


@register("c7_clean_timestamps_events", f"""
WITH d AS ({MOMENTS_SQL.format(src="events")}),
m AS (SELECT quantile_disc(ts, 0.5) AS o FROM d)
SELECT DISTINCT event, coalesce(ts, o) AS ts, event_type FROM d, m
""")
def q_c7_moments(spark, sf):
    """Null timestamps take the exact lower median of many distinct ones."""
    table(spark, sf, "events", balance=False).createOrReplaceTempView("events_moments_src")
    return C.clean(spark.sql(MOMENTS_SQL.format(src="events_moments_src"))).table


def findings_sql(source: str, topic: str, lines: list[tuple[str, str | None]]) -> str:
    return (f"WITH s AS ({source}), l AS ({_lines(lines)}) "
            f"SELECT CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS seq, '{topic}' AS topic, finding FROM l")


@register("n3_bivariate_findings_numbers_lineitem", findings_sql(pearson_sql("lineitem", "l_discount", "l_tax"), "bivariate", [
    ("'Bivariate Analysis: l_discount vs l_tax'", None),
    ("printf('Pearson correlation: r = %.3f', r)", None),
    ("'Correlation strength: ' || strength", None),
    ("printf('Statistical significance: p = %.3f', p_value)", None),
    ("'Statistically significant relationship (p < 0.05)'", "p_value < 0.05"),
    ("'No statistically significant relationship (p ≥ 0.05)'", "p_value >= 0.05"),
    ("'Strong linear relationship - good for predictive modeling'", "abs(r) > 0.7"),
    ("'Moderate linear relationship - worth investigating further'", "abs(r) > 0.3 AND abs(r) <= 0.7"),
    ("'Weak linear relationship - may need non-linear analysis'", "abs(r) <= 0.3"),
]))
def q_n3_numbers(spark, sf):
    """Two numeric columns in words."""
    return N.bivariate_findings(T_(spark, sf, "lineitem"), "l_discount", "l_tax")


@register("n3_bivariate_findings_texts_orders", findings_sql(chi_sql("orders", "o_orderstatus", "o_orderpriority"), "bivariate", [
    ("'Bivariate Analysis: o_orderstatus vs o_orderpriority'", None),
    ("printf('Chi-square statistic: %.3f', chi2)", None),
    ("'Association strength: ' || association", None),
    ("printf('Statistical significance: p = %.3f', p_value)", None),
    ("'Statistically significant association (p < 0.05)'", "p_value < 0.05"),
    ("'No statistically significant association (p ≥ 0.05)'", "p_value >= 0.05"),
]))
def q_n3_texts(spark, sf):
    """Two text columns in words."""
    return N.bivariate_findings(T_(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


@register("n4_target_findings_numbers_lineitem", findings_sql(ORACLE["g9_correlation_reading_lineitem"], "target", [
    ("'Target Variable Impact Analysis: l_quantity → l_extendedprice'", None),
    ("'Pointer 1: Linear Relationship Strength'", None),
    ("printf('Correlation coefficient: %.3f', correlation)", None),
    ("'Relationship: ' || strength || ' ' || direction || ' linear relationship'", None),
    ("'High predictive power: Feature strongly predicts target variable'", "predictive_power = 'high'"),
    ("'Moderate predictive power: Feature has some predictive value'", "predictive_power = 'moderate'"),
    ("'Low predictive power: Feature has limited linear relationship'", "predictive_power = 'low'"),
    ("'Pointer 2: Strategic Implications and Next Steps'", None),
    ("'Action: l_quantity is a key driver of l_extendedprice'", "key_driver"),
    ("'Strategy: ' || CASE WHEN correlation > 0 THEN 'Increase' ELSE 'Decrease' END || ' l_quantity to improve l_extendedprice'", "key_driver"),
    ("'Investigation: l_quantity has limited direct impact on l_extendedprice'", "NOT key_driver"),
    ("'Next step: Consider non-linear relationships or interaction effects'", "NOT key_driver"),
    ("printf('Explained variance: %.1f%% of l_extendedprice variance explained by l_quantity', 100 * r_squared)", None),
    ("'High explanatory power: Feature accounts for majority of target variation'", "explanatory_power = 'high'"),
    ("'Moderate explanatory power: Feature explains significant portion of target variation'", "explanatory_power = 'moderate'"),
    ("'Low explanatory power: Feature explains limited target variation'", "explanatory_power = 'low'"),
]))
def q_n4_numbers(spark, sf):
    """Numeric target by numeric feature in words."""
    return N.target_findings(T_(spark, sf, "lineitem"), "l_extendedprice", "l_quantity")


def _classes_head(target: str, feature: str) -> list[tuple[str, str | None]]:
    return [
        (f"'Target Variable Impact Analysis: {feature} → {target}'", None),
        ("'Pointer 1: Feature Distribution Impact on Target Variable'", None),
        (f"'{feature} varies significantly across {target} categories'", None),
        ("printf('Highest feature values: %s (mean: %.2f)', highest_class, highest_mean)", None),
        ("printf('Lowest feature values: %s (mean: %.2f)', lowest_class, lowest_mean)", None),
        ("printf('Feature range: %.2f units difference', feature_range)", None),
        ("'Pointer 2: Predictive Power and Decision Thresholds'", None),
    ]


@register("n4_target_findings_two_classes_lineitem", findings_sql(ORACLE["g7_class_separation_lineitem"], "target", [
    *_classes_head("l_linestatus", "l_extendedprice"),
    ("printf('Separation strength: %.2f (Cohen''s d)', cohens_d)", None),
    ("'Strong separation: Feature is highly predictive'", "separation = 'strong'"),
    ("'Moderate separation: Feature has good predictive power'", "separation = 'moderate'"),
    ("'Weak separation: Feature has limited predictive power'", "separation = 'weak'"),
    ("printf('Suggested threshold: %.2f for classification', threshold)", None),
]))
def q_n4_two(spark, sf):
    """Text target of two classes by numeric feature in words."""
    return N.target_findings(T_(spark, sf, "lineitem"), "l_linestatus", "l_extendedprice")


@register("n4_target_findings_classes_lineitem", findings_sql(ORACLE["g7_class_separation_multiclass"], "target", [
    *_classes_head("l_returnflag", "l_quantity"),
    ("'Multi-class analysis: ' || classes || ' target categories'", None),
    ("printf('Feature discrimination: %.2f range across categories', feature_range)", None),
    ("'High discrimination: Feature strongly differentiates target categories'", "discrimination = 'high'"),
    ("'Moderate discrimination: Feature provides some differentiation'", "discrimination = 'moderate'"),
]))
def q_n4_classes(spark, sf):
    """Text target of several classes by numeric feature in words."""
    return N.target_findings(T_(spark, sf, "lineitem"), "l_returnflag", "l_quantity")


@register("n4_target_findings_texts_orders", findings_sql(ORACLE["g8_association_residuals_orders"], "target", [
    ("'Target Variable Impact Analysis: o_orderpriority → o_orderstatus'", None),
    ("'Pointer 1: Association Strength Between Variables'", None),
    ("printf('Chi-square statistic: %.3f', chi2)", None),
    ("printf('P-value: %.3f', p_value)", None),
    ("'Degrees of freedom: ' || dof", None),
    ("'Very strong association: Highly significant relationship'", "association = 'very strong'"),
    ("'Strong association: Statistically significant relationship'", "association = 'strong'"),
    ("'Weak association: No significant relationship'", "association = 'weak'"),
    ("'Pointer 2: Practical Implications for Target Variable'", None),
    ("printf('Association strength range: %.2f to %.2f (standardized residuals)', min_residual, max_residual)", None),
    ("'Strong patterns: Some feature-target combinations are highly over-represented'", "pattern = 'strong'"),
    ("'Moderate patterns: Some feature-target combinations show notable associations'", "pattern = 'moderate'"),
    ("'Weak patterns: Feature-target combinations are mostly random'", "pattern = 'weak'"),
    ("'Warning: Some cells have small counts (min: ' || min_count || ') - results may be unreliable'", "small_counts"),
    ("'Good sample sizes: All combinations have adequate data'", "NOT small_counts"),
]))
def q_n4_texts(spark, sf):
    """Text target by text feature in words."""
    return N.target_findings(T_(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")
