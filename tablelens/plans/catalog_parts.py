"""Registered queries: the single steps that the composite queries also cover
(V1–V4, C1–C5, T7, U2, P5, P6, B3, B6, S2), each with its own oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.operators import checks as V
from tablelens.operators import clean as C
from tablelens.operators import kinds as K
from tablelens.operators import pairs as B
from tablelens.operators import profile as P
from tablelens.plans.catalog_clean import CLEAN_BASE, D, _clip
from tablelens.plans.catalog_pairs import LI_NUM, STRENGTH, chi_sql, corr_sql
from tablelens.plans.catalog_profile import DUCK_TYPE
from tablelens.plans.registry import T_, dirty, register
from tablelens.plans.sqlgen import R, long, to_number
from tablelens.session import scratch_path
from tablelens.sources import io as S


@register("v1_check_min_rows_region", """
SELECT 'min_rows' AS "check", CAST(NULL AS VARCHAR) AS "column", CAST(count(*) AS DOUBLE) AS value,
  'Too few rows: ' || count(*) || ' rows (less than 10).' AS message FROM region HAVING count(*) < 10
""")
def q_v1(spark, sf):
    """V1: fewer than 10 rows (region has 5)."""
    return V.check_min_rows(T_(spark, sf, "region"))


@register("v2_check_min_cols_region", """
SELECT 'min_cols' AS "check", CAST(NULL AS VARCHAR) AS "column", CAST(1 AS DOUBLE) AS value,
  'Too few columns: 1 columns (need at least 2).' AS message
""")
def q_v2(spark, sf):
    """V2: fewer than 2 columns (a one-column projection of region)."""
    return V.check_min_cols(T_(spark, sf, "region").select("r_name"))


@register("v3_check_all_null_dirty", """
SELECT 'all_null' AS "check", CAST(NULL AS VARCHAR) AS "column", CAST(1 AS DOUBLE) AS value,
  'Columns with all nulls: [''empty_col'']' AS message FROM (SELECT count(empty_col) AS c FROM """ + D + """) WHERE c = 0
""")
def q_v3(spark, sf):
    """V3: columns without any value."""
    return V.check_all_null(dirty(spark, sf))


@register("v4_check_duplicates_dirty", """
SELECT 'duplicates' AS "check", CAST(NULL AS VARCHAR) AS "column", CAST(d AS DOUBLE) AS value,
  'Found ' || d || ' duplicate rows.' AS message
FROM (SELECT sum(n - 1) AS d FROM (SELECT count(*) AS n FROM """ + D + """
      GROUP BY l_orderkey, l_linenumber, quantity, returnflag, part_text, supp_text, empty_col)) WHERE d > 0
""")
def q_v4(spark, sf):
    """V4: repeated whole rows (first occurrence not counted, nulls equal)."""
    return V.check_duplicates(dirty(spark, sf))


@register("c1_fill_mode_dirty", CLEAN_BASE + "SELECT returnflag, part_text, supp_text, empty_col FROM f")
def q_c1(spark, sf):
    """Text nulls ← mode (ties → smallest; no value → 'Unknown')."""
    d = dirty(spark, sf)
    return C.fill_missing(d).select("returnflag", "part_text", "supp_text", "empty_col")


@register("c2_fill_median_dirty", CLEAN_BASE + f"SELECT {R('l_orderkey')} AS l_orderkey, {R('l_linenumber')} AS l_linenumber, "
          f"{R('quantity')} AS quantity FROM f")
def q_c2(spark, sf):
    """Numeric nulls ← median."""
    d = dirty(spark, sf)
    return C.fill_missing(d).select("l_orderkey", "l_linenumber", "quantity")


@register("c3_drop_duplicates_dirty", f"SELECT DISTINCT l_orderkey, l_linenumber, {R('quantity')} AS quantity, returnflag, "
          f"part_text, supp_text, empty_col FROM {D}")
def q_c3(spark, sf):
    """Whole-row dedupe (nulls compare equal), hash-first."""
    return C.drop_duplicates(dirty(spark, sf))


@register("c4_cap_outliers_dirty", f"""
WITH d AS {D},
q AS (SELECT quantile_cont(CAST(l_orderkey AS DOUBLE), 0.25) AS a1, quantile_cont(CAST(l_orderkey AS DOUBLE), 0.75) AS a3,
             quantile_cont(CAST(l_linenumber AS DOUBLE), 0.25) AS b1, quantile_cont(CAST(l_linenumber AS DOUBLE), 0.75) AS b3,
             quantile_cont(quantity, 0.25) AS c1, quantile_cont(quantity, 0.75) AS c3 FROM d),
b AS (SELECT a1 - 1.5 * (a3 - a1) AS alo, a3 + 1.5 * (a3 - a1) AS ahi, b1 - 1.5 * (b3 - b1) AS blo,
             b3 + 1.5 * (b3 - b1) AS bhi, c1 - 1.5 * (c3 - c1) AS clo, c3 + 1.5 * (c3 - c1) AS chi FROM q)
SELECT CAST({_clip('l_orderkey', 'alo', 'ahi')} AS BIGINT) AS l_orderkey,
  CAST({_clip('l_linenumber', 'blo', 'bhi')} AS INTEGER) AS l_linenumber, {R(_clip('quantity', 'clo', 'chi'))} AS quantity,
  returnflag, part_text, supp_text, empty_col FROM d, b
""")
def q_c4(spark, sf):
    """C4: every numeric column clipped to its Tukey fences (nulls stay null)."""
    return C.cap_outliers(dirty(spark, sf))[0]


@register("c5_convert_types_dirty", f"""
SELECT l_orderkey, l_linenumber, {R('quantity')} AS quantity, returnflag, part_text, {R(to_number('supp_text'))} AS supp_text,
  CAST(empty_col AS DOUBLE) AS empty_col FROM {D}
""")
def q_c5(spark, sf):
    """All-or-nothing conversion (numbers, else dates, else kept; an all-null text column converts)."""
    d = dirty(spark, sf)
    return K.apply_conversions(d, *C.conversions(d, with_readings=True))


@register("t7_dtype_summary_lineitem", f"""
SELECT column_name AS "column", {DUCK_TYPE} AS dtype FROM information_schema.columns WHERE table_name = 'lineitem'
""")
def q_t7(spark, sf):
    """Column → dtype name."""
    return K.dtype_summary(T_(spark, sf, "lineitem"))


@register("u2_iqr_outlier_count_lineitem", f"""
WITH long AS ({long("lineitem", LI_NUM)}),
q AS (SELECT "column", quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM long GROUP BY 1)
SELECT l."column", count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outliers
FROM long l JOIN q USING ("column") GROUP BY 1
""")
def q_u2(spark, sf):
    """Strict IQR outlier count per numeric column."""
    li = T_(spark, sf, "lineitem")
    return P.outlier_counts(li.select(*[F.col(c).cast("double").alias(c) for c in LI_NUM]), LI_NUM)


@register("p5_p6_skew_kurtosis_orders", f"""
WITH long AS ({long("orders", ["o_orderkey", "o_custkey", "o_totalprice"])})
SELECT "column", {R('skewness(value)')} AS skewness, {R('kurtosis(value)')} AS kurtosis FROM long GROUP BY 1
""")
def q_p5(spark, sf):
    """Bias-adjusted skewness and excess kurtosis."""
    df = T_(spark, sf, "orders")
    return P.moments(df.select(*[F.col(c).cast("double").alias(c) for c in K.numeric_columns(df)]),
                     K.numeric_columns(df)).select("column", "skewness", "kurtosis")


@register("b3_correlation_strength_lineitem", f"""
SELECT col_a, col_b, {R('r')} AS r, {STRENGTH.format(r='r')} AS strength FROM ({corr_sql('lineitem', LI_NUM, False)})
""")
def q_b3(spark, sf):
    """Strong > 0.7, moderate > 0.3, else weak — for every pair."""
    from tablelens.functions.stats import correlation_strength
    m = B.correlation_matrix(T_(spark, sf, "lineitem"), diagonal=False)
    return m.select("col_a", "col_b", "r", correlation_strength(F.col("r")).alias("strength"))


@register("b6_association_strength_orders", f"""
SELECT column1, column2, p_value, association FROM ({chi_sql("orders", "o_orderstatus", "o_orderpriority")})
UNION ALL SELECT column1, column2, p_value, association FROM ({chi_sql("lineitem", "l_returnflag", "l_linestatus")})
""")
def q_b6(spark, sf):
    """P < 0.001 strong, < 0.05 moderate, else weak — two tables."""
    a = B.chi_square_test(T_(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")
    b = B.chi_square_test(T_(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")
    return a.unionByName(b).select("column1", "column2", "p_value", "association")


@register("s2_read_named_part", """
SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, round(p_retailprice, 6) + 0.0 AS p_retailprice FROM part
""")
def q_s2(spark, sf):
    """A named CSV from a data folder (written by Spark from part)."""
    base = scratch_path(spark, "data")
    T_(spark, sf, "part").write.option("header", True).csv(f"{base}/part.csv")
    return S.read_named(spark, "part.csv", base)
