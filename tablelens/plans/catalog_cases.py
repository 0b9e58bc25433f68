"""Registered queries for cases the plain tables do not show: ids beyond
doubles, text dates of every reading, column names with dots, results kept as
JSON and CSV, summaries with a text target and with none."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.functions.stats import at
from tablelens.operators import chartdata as D
from tablelens.operators import clean as C
from tablelens.operators import findings as N
from tablelens.operators import kinds as K
from tablelens.operators import pairs as B
from tablelens.operators import profile as P
from tablelens.operators import target as G
from tablelens.plans.catalog_gates import WIDE_SQL
from tablelens.plans.catalog_more import N5_SQL, _lines
from tablelens.plans.catalog_profile import LINEITEM_NUM, numeric_profile_sql
from tablelens.plans.catalog_summary import N6_SQL
from tablelens.plans.registry import T_, register
from tablelens.plans.sqlgen import R
from tablelens.session import scratch_path
from tablelens.sources import io as S
from tablelens.sources.tables import table


def _wide(spark, sf):
    table(spark, sf, "orders", balance=False).createOrReplaceTempView("orders_wide_src")
    return spark.sql(WIDE_SQL.format(src="orders_wide_src"))


WIDE = f"({WIDE_SQL.format(src='orders')})"


@register("u1_distinct_wide_ids_orders", f"""
SELECT 'wide_id' AS "column", count(wide_id) AS "count", count(DISTINCT wide_id) AS unique_count, count(*) - count(wide_id) AS missing_count FROM {WIDE}
UNION ALL SELECT 'price', count(price), count(DISTINCT price), count(*) - count(price) FROM {WIDE}
""")
def q_u1_wide(spark, sf):
    """Ids that a double cannot tell apart are counted apart."""
    return P.univariate_numeric(_wide(spark, sf), ["wide_id", "price"]).select("column", "count", "unique_count", "missing_count")


@register("g13_target_summary_wide_ids_orders", f"""
SELECT 'wide_id' AS target, 'numeric' AS type, count(DISTINCT wide_id) AS "unique" FROM {WIDE}
""")
def q_g13_wide(spark, sf):
    """The classes of a target beyond doubles."""
    return G.target_summary(_wide(spark, sf), "wide_id").select("target", "type", "unique")


# one column for each way to write the order's date; the last mixes two ways
DATE_TEXTS = {"slashed": "yyyy/MM/dd", "month_first": "MM/dd/yyyy", "day_first": "dd/MM/yyyy", "dashed": "dd-MM-yyyy", "dotted": "dd.MM.yyyy",
              "named": "MMM d, yyyy", "iso": "yyyy-MM-dd"}


def _date_texts(spark, sf):
    d = T_(spark, sf, "orders")
    return d.select("o_orderkey", *[F.date_format("o_orderdate", f).alias(c) for c, f in DATE_TEXTS.items()],
                    F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "MM/dd/yyyy"))
                    .otherwise(F.date_format("o_orderdate", "dd-MM-yyyy")).alias("mixed"), "o_totalprice")


@register("c5_one_reading_a_date_column_orders", f"""
SELECT o_orderkey, {', '.join(f'CAST(o_orderdate AS DATE) AS {c}' for c in DATE_TEXTS)},
  CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%m/%d/%Y') ELSE strftime(o_orderdate, '%d-%m-%Y') END AS mixed FROM orders
""")
def q_c5_dates(spark, sf):
    """Each date column is read in the one way that reads all its values; a mixed one stays text."""
    d = _date_texts(spark, sf).drop("o_totalprice")
    out = K.apply_conversions(d, *C.conversions(d, with_readings=True))
    return out.select("o_orderkey", *[F.to_date(c).alias(c) for c in DATE_TEXTS], F.col("mixed").cast("string").alias("mixed"))


@register("t5_conversion_words_orders", f"""
SELECT unnest([{', '.join(repr(c) for c in DATE_TEXTS)}, 'mixed']) AS "column",
  unnest([{', '.join("'Converted to datetime'" for _ in DATE_TEXTS)}, 'Kept as categorical']) AS conversion
""")
def q_t5_words(spark, sf):
    """T5: what the cleaning conversion does with every date column."""
    return K.coercion_rules(_date_texts(spark, sf)).select("column", "conversion")


@register("d14_time_series_day_first_orders", f"""
SELECT CAST(o_orderdate AS DATE) AS day_first, {R('o_totalprice')} AS o_totalprice FROM orders WHERE o_totalprice IS NOT NULL AND o_orderdate IS NOT NULL
""")
def q_d14_day_first(spark, sf):
    """A day-first text date keeps one reading over the whole series."""
    out = D.time_series(_date_texts(spark, sf), "day_first", "o_totalprice")
    return out.select(F.to_date("day_first").alias("day_first"), "o_totalprice")


ODD = {"o_orderkey": "order.key", "o_custkey": "cust key", "o_totalprice": "total.price", "o_orderpriority": "o.priority", "o_orderstatus": "status`"}


def _odd(spark, sf):
    return T_(spark, sf, "orders").select(*[F.col(c).alias(n) for c, n in ODD.items()])


def _quoted(n: str) -> str:
    return '"' + n + '"'


ODD_SQL = "(SELECT " + ", ".join(f"{c} AS {_quoted(n)}" for c, n in ODD.items()) + " FROM orders)"
ODD_NUM = ["order.key", "cust key", "total.price"]


@register("u1_odd_names_orders", numeric_profile_sql(ODD_SQL, ODD_NUM, exprs={n: _quoted(n) for n in ODD_NUM}))
def q_u1_odd(spark, sf):
    """Column names with dots, blanks and backticks."""
    return P.univariate_numeric(_odd(spark, sf))


@register("b7_odd_names_orders", f"""
SELECT o_orderpriority AS "o.priority", {R('avg(o_totalprice)')} AS mean, {R('quantile_cont(o_totalprice, 0.5)')} AS median,
  {R('stddev_samp(o_totalprice)')} AS std, count(o_totalprice) AS "count"
FROM orders WHERE o_orderpriority IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY 1
""")
def q_b7_odd(spark, sf):
    """Group statistics of columns with dots in their names."""
    out = B.group_statistics(_odd(spark, sf), "o.priority", "total.price")
    return out.select(at("o.priority"), "mean", "median", "std", "count")


def _kept(spark, sf, fmt):
    res = P.univariate_numeric(T_(spark, sf, "lineitem"))
    path = S.write_results(res, scratch_path(spark, f"u1-{fmt}"), fmt)
    return spark.read.schema(res.schema).option("header", True).format(fmt).load(path)


@register("s5_write_results_json_lineitem", numeric_profile_sql("lineitem", LINEITEM_NUM, exact=True), exact=True)
def q_s5_json(spark, sf):
    """The results of all numeric columns kept as JSON and read back."""
    return _kept(spark, sf, "json")


@register("s5_write_results_csv_lineitem", numeric_profile_sql("lineitem", LINEITEM_NUM, exact=True), exact=True)
def q_s5_csv(spark, sf):
    """The results of all numeric columns kept as CSV and read back."""
    return _kept(spark, sf, "csv")


# ---------------------------------------------------------------- N5, N6 without a target, and with a text one

_MODE = "(SELECT v FROM (SELECT o_orderpriority AS v, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1) ORDER BY n DESC, v LIMIT 1)"
_SHARE = ("(SELECT max(n) FROM (SELECT count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority)) * 100.0 "
          "/ (SELECT count(*) FROM orders)")


def _n5(target_lines: list[str], last: str) -> str:
    """The numeric-target SQL with its two target lines and its last line replaced."""
    head, body = N5_SQL.split("l AS (", 1)
    lines, tail = body.rsplit(")\nSELECT CAST(row_number()", 1)
    parts = lines.split(" UNION ALL ")
    kept = [p for p in parts if "Target Variable Analysis" not in p and "Target Statistics" not in p and "Target-Focused" not in p]
    first, rest = kept[:3], kept[3:]
    own = [f"SELECT 2 + 0.1 * {i + 1} AS k, {t} AS finding FROM s" for i, t in enumerate(target_lines)]
    end = f"SELECT 99 AS k, {last} AS finding FROM s"
    return head + "l AS (" + " UNION ALL ".join([*first, *own, *rest, end]) + ")\nSELECT CAST(row_number()" + tail


@register("n5_dataset_findings_text_target_orders", _n5(
    ["'Target Variable Analysis: o_orderpriority is categorical with ' || u1 || ' unique values.'",
     f"'Target Distribution: Most common value is ''' || {_MODE} || ''''"],
    "'Target-Focused Analysis: With o_orderpriority as the target variable, focus on identifying key drivers and predictive patterns for better outcomes.'"))
def q_n5_text(spark, sf):
    """Dataset findings with a text target."""
    return N.dataset_findings(T_(spark, sf, "orders"), "o_orderpriority")


@register("n5_dataset_findings_no_target_orders", _n5(
    [], "'Business Impact: Dataset contains ' || rows_ || ' records across 6 dimensions, suitable for comprehensive analysis and modeling.'"))
def q_n5_none(spark, sf):
    """Dataset findings without a target."""
    return N.dataset_findings(T_(spark, sf, "orders"))


def _n6(target: str | None) -> str:
    t = target
    lines: list[tuple[str, str | None]] = [
        ("'Executive Summary'", None),
        ("format('Your dataset contains {:,} records across 6 variables.', rows_)", None),
        (f"'The analysis focuses on {t} as the target variable, helping identify key patterns and relationships.'" if t else
         "'This is a comprehensive exploratory analysis to understand data patterns and relationships.'", None),
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
        ("'  - Key categorical variables: o_orderstatus, o_orderpriority'", None)]
    if t:
        lines += [
            (f"'Target Variable Analysis: {t}'", None), ("'Type: Categorical'", None), ("format('Unique Values: {:,}', u1)", None),
            (f"printf('Most Common: %s (%.1f%% of data)', chr(39) || f1 || chr(39), {_SHARE})", None),
            ("'Class Imbalance: One category dominates the data'", f"{_SHARE} > 50"),
            ("'Balanced Distribution: Good variety across categories'", f"{_SHARE} <= 50")]
    lines += [
        ("'Key Statistical Findings'", None), ("'Numeric Variables'", None),
        ("printf('o_orderkey: Average = %.2f, Variability = %.2f', m0, d0)", None),
        ("printf('o_custkey: Average = %.2f, Variability = %.2f', m1, d1)", None),
        ("printf('o_totalprice: Average = %.2f, Variability = %.2f', tm, ts)", None),
        ("'Categorical Variables'", None),
        ("printf('o_orderstatus: %d categories, most common: %s', u0, chr(39) || f0 || chr(39))", None),
        ("printf('o_orderpriority: %d categories, most common: %s', u1, chr(39) || f1 || chr(39))", None),
        ("'Relationship Analysis'", None),
        ("'Strong Relationships Found: ' || strong || ' variable pairs show strong correlation'", "strong > 0"),
        ("'Moderate Relationships: ' || moderate || ' variable pairs show moderate correlation'", "moderate > 0"),
        ("'Independent Variables: No strong correlations found - variables appear independent'", "strong + moderate = 0")]
    if t:
        lines += [(f"'Target-Focused Insights for {t}'", None)]
    lines += [("'Recommendations'", None), ("'Data Collection: Address missing data issues before modeling'", "mp > 10")]
    if t:
        lines += [(f"'Modeling Focus: Use {t} as target for predictive modeling'", None)]
    lines += [
        ("'Multicollinearity: Consider feature selection to address highly correlated variables'", "strong > 0"),
        ("'Mixed Analysis: Combine numeric and categorical approaches for comprehensive insights'", None),
        ("'Next Steps: Consider advanced modeling techniques based on your specific goals'", None),
        ("'Quick Action Items'", None),
        ("'1. Review Data Quality: Check the data quality assessment above'", None),
        ("'2. Explore Relationships: Use the correlation analysis to identify key patterns'", None)]
    if t:
        lines += [(f"'3. Focus on Target: Analyze how other variables relate to {t}'", None)]
    lines += [("'4. Generate Visualizations: Use the advanced visualization tabs for deeper insights'", None),
              ("'5. Export Results: Download the summary and statistics for further analysis'", None)]
    stats = N6_SQL[:N6_SQL.index("rel AS (")].rstrip().rstrip(",")
    return (stats + ", body AS (" + _lines(lines) + ") SELECT CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS seq, "
            "'summary' AS topic, finding FROM body")


@register("n6_executive_summary_text_target_orders", _n6("o_orderpriority"))
def q_n6_text(spark, sf):
    """The summary with a text target."""
    return N.executive_summary(T_(spark, sf, "orders"), "o_orderpriority")


@register("n6_executive_summary_no_target_orders", _n6(None))
def q_n6_none(spark, sf):
    """The summary without a target."""
    return N.executive_summary(T_(spark, sf, "orders"))


@register("d8_scatter_points_lineitem")
def q_d8_points(spark, sf):
    """A fixed-size sample of the points, the same whatever the partitions."""
    return D.scatter_points(T_(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", 1000)
