"""Registered queries: correlations, pair tests, grouped statistics."""

from __future__ import annotations

from tablelens.operators import pairs as B
from tablelens.plans.registry import T_, register
from tablelens.plans.sqlgen import R, p_chi2_expr, p_corr_cte, p_f_expr

LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
          "l_extendedprice", "l_discount", "l_tax"]
PART_NUM = ["p_partkey", "p_size", "p_retailprice"]
STRENGTH = "CASE WHEN abs({r}) > 0.7 THEN 'strong' WHEN abs({r}) > 0.3 THEN 'moderate' ELSE 'weak' END"
ASSOC = "CASE WHEN {p} < 0.001 THEN 'strong' WHEN {p} < 0.05 THEN 'moderate' ELSE 'weak' END"


def corr_sql(tbl: str, cols: list[str], diagonal: bool = True) -> str:
    parts = []
    for i, a in enumerate(cols):
        for j in range(i if diagonal else i + 1, len(cols)):
            b = cols[j]
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {i} AS i, {j} AS j, "
                         f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS r, "
                         f"count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM {tbl}")
    return " UNION ALL ".join(parts)


@register("p7_correlation_matrix_lineitem",
          f"SELECT col_a, col_b, i, j, {R('r')} AS r, n FROM ({corr_sql('lineitem', LI_NUM)})")
def q_p7(spark, sf):
    """Pearson for every numeric pair (pairwise complete), one aggregation."""
    return B.correlation_matrix(T_(spark, sf, "lineitem"))


@register("m1_correlation_pairs_part", f"""
SELECT col_a || ' - ' || col_b AS pair, col_a, col_b, i, j, {R('r')} AS r,
  CASE WHEN abs(r) > 0.7 THEN 'strong' ELSE 'moderate' END AS strength
FROM ({corr_sql('part', PART_NUM, False)}) WHERE abs(r) > 0.3
""")
def q_m1(spark, sf):
    """M1: strong/moderate upper-triangle pairs."""
    return B.correlation_pairs(T_(spark, sf, "part"))


@register("d5_correlation_heatmap_part", f"""
WITH m AS ({corr_sql('part', PART_NUM)})
SELECT col_a, col_b, i, j, {R('r')} AS r, n FROM m
UNION ALL SELECT col_b, col_a, j, i, {R('r')}, n FROM m WHERE i <> j
""")
def q_d5(spark, sf):
    """The full correlation matrix (both triangles, diagonal)."""
    return B.correlation_heatmap(T_(spark, sf, "part"))


@register("d6_correlation_network_lineitem",
          f"SELECT col_a, col_b, {R('r')} AS r FROM ({corr_sql('lineitem', LI_NUM, False)}) WHERE abs(r) > 0.5")
def q_d6(spark, sf):
    """Pairs with |r| > 0.5."""
    return B.correlation_network(T_(spark, sf, "lineitem"))


@register("d7_correlation_strength_bars_lineitem",
          f"SELECT col_a || ' - ' || col_b AS pair, {R('abs(r)')} AS abs_r FROM ({corr_sql('lineitem', LI_NUM, False)})")
def q_d7(spark, sf):
    """|r| of every pair, weakest first."""
    return B.correlation_strength_bars(T_(spark, sf, "lineitem"))


@register("d8_scatter_trend_lineitem", f"""
SELECT CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n,
  {R('regr_slope(l_extendedprice, l_quantity)')} AS slope, {R('regr_intercept(l_extendedprice, l_quantity)')} AS intercept,
  {R('regr_r2(l_extendedprice, l_quantity)')} AS r2, {R('corr(l_extendedprice, l_quantity)')} AS r FROM lineitem
""")
def q_d8(spark, sf):
    """Least-squares trend line of price on quantity."""
    return B.scatter_trend(T_(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


def pearson_sql(tbl: str, a: str, b: str) -> str:
    return f"""
WITH s AS (SELECT corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS r,
                  count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM {tbl}),
{p_corr_cte('pc', 's')}
SELECT '{a}' AS column1, '{b}' AS column2, n, {R('r')} AS r, {R('p_value')} AS p_value,
  {STRENGTH.format(r='r')} AS strength FROM pc
"""


@register("b1_pearson_test_lineitem", pearson_sql("lineitem", "l_discount", "l_tax"))
def q_b1(spark, sf):
    """Pearson r with its two-sided p (independent columns: p is not tiny)."""
    return B.pearson_test(T_(spark, sf, "lineitem"), "l_discount", "l_tax")


@register("b1_pearson_test_orders", pearson_sql("orders", "o_custkey", "o_totalprice"))
def q_b1_orders(spark, sf):
    """B1 on orders."""
    return B.pearson_test(T_(spark, sf, "orders"), "o_custkey", "o_totalprice")


def spearman_sql(tbl: str, a: str, b: str) -> str:
    return f"""
WITH c AS (SELECT CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM {tbl}
           WHERE {a} IS NOT NULL AND {b} IS NOT NULL),
rk AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
              rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM c),
s AS (SELECT count(*) AS n, corr(rx, ry) AS r FROM rk),
{p_corr_cte('pc', 's')}
SELECT '{a}' AS column1, '{b}' AS column2, n, {R('r')} AS rho, {R('p_value')} AS p_value,
  {STRENGTH.format(r='r')} AS strength FROM pc
"""


@register("b2_spearman_test_lineitem", spearman_sql("lineitem", "l_discount", "l_tax"))
def q_b2(spark, sf):
    """B2: Spearman rho from exact average ranks (heavy ties) and its p."""
    return B.spearman_test(T_(spark, sf, "lineitem"), "l_discount", "l_tax")


@register("b2_spearman_test_price", spearman_sql("lineitem", "l_quantity", "l_extendedprice"))
def q_b2_price(spark, sf):
    """B2 on a strongly related pair."""
    return B.spearman_test(T_(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


@register("b2_spearman_distributed_orders", spearman_sql("orders", "o_totalprice", "o_orderkey"))
def q_b2_dist(spark, sf):
    """B2 forced through the range-partitioned rank plan (the 100 TB path)."""
    return B.spearman_test(T_(spark, sf, "orders"), "o_totalprice", "o_orderkey", method="distributed")


@register("b4_contingency_lineitem", """
WITH cells AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem
               WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY ALL)
SELECT a.l_returnflag, b.l_linestatus, coalesce(c.n, 0) AS n
FROM (SELECT DISTINCT l_returnflag FROM cells) a CROSS JOIN (SELECT DISTINCT l_linestatus FROM cells) b
LEFT JOIN cells c USING (l_returnflag, l_linestatus)
""")
def q_b4(spark, sf):
    """Contingency table with zero cells (size-checked dense form)."""
    return B.contingency(T_(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", zeros=True)


def chi_sql(tbl: str, a: str, b: str) -> str:
    return f"""
WITH cells AS (SELECT CAST({a} AS VARCHAR) AS a, CAST({b} AS VARCHAR) AS b, count(*) AS n FROM {tbl}
               WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2),
ra AS (SELECT a, sum(n) AS ra FROM cells GROUP BY a), cb AS (SELECT b, sum(n) AS cb FROM cells GROUP BY b),
tot AS (SELECT sum(n) AS nn, count(DISTINCT a) AS r, count(DISTINCT b) AS c FROM cells),
dense AS (SELECT coalesce(cells.n, 0) AS o, ra.ra * cb.cb / tot.nn AS e, (tot.r - 1) * (tot.c - 1) AS dof
          FROM ra CROSS JOIN cb CROSS JOIN tot LEFT JOIN cells ON cells.a = ra.a AND cells.b = cb.b),
st AS (SELECT any_value(dof) AS dof, sum(CASE WHEN dof = 1 THEN power(abs(o - e) - least(0.5, abs(o - e)), 2) / e
                                         ELSE power(o - e, 2) / e END) AS chi2 FROM dense),
res AS (SELECT CAST(tot.nn AS BIGINT) AS n, CAST(dof AS BIGINT) AS dof, chi2 FROM st, tot)
SELECT '{a}' AS column1, '{b}' AS column2, n, dof, {R('chi2')} AS chi2, {R(p_chi2_expr('chi2', 'dof'))} AS p_value,
  {ASSOC.format(p=p_chi2_expr('chi2', 'dof'))} AS association FROM res
"""


@register("b5_chi_square_lineitem", chi_sql("lineitem", "l_returnflag", "l_linestatus"))
def q_b5(spark, sf):
    """Chi-square test of independence (3×2, dof 2)."""
    return B.chi_square_test(T_(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


@register("b5_chi_square_yates_labels", chi_sql("labels", "quality", "toxic"))
def q_b5_yates(spark, sf):
    """B5 on a 2×2 table: Yates' continuity correction."""
    return B.chi_square_test(T_(spark, sf, "labels"), "quality", "toxic")


@register("b5_chi_square_orders", chi_sql("orders", "o_orderstatus", "o_orderpriority"))
def q_b5_orders(spark, sf):
    """B5 with dof 8."""
    return B.chi_square_test(T_(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


@register("b7_group_statistics_events", f"""
SELECT event_type, {R('avg(value)')} AS mean, {R('quantile_cont(value, 0.5)')} AS median,
  {R('stddev_samp(value)')} AS std, count(*) AS "count"
FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL GROUP BY event_type
""")
def q_b7(spark, sf):
    """Mean, median, std, count per category (complete rows)."""
    return B.group_statistics(T_(spark, sf, "events"), "event_type", "value")


def anova_sql(tbl: str, g: str, x: str) -> str:
    return f"""
WITH v AS (SELECT CAST({g} AS VARCHAR) AS g, CAST({x} AS DOUBLE) AS x FROM {tbl} WHERE {g} IS NOT NULL AND {x} IS NOT NULL),
m AS (SELECT avg(x) AS mm, count(*) AS nn, count(DISTINCT g) AS k FROM v),
gs AS (SELECT g, count(*) AS n, avg(x) AS mg FROM v GROUP BY g),
ss AS (SELECT sum(gs.n * (gs.mg - m.mm) * (gs.mg - m.mm)) AS ssb FROM gs, m),
sw AS (SELECT sum((v.x - gs.mg) * (v.x - gs.mg)) AS ssw FROM v JOIN gs USING (g)),
f AS (SELECT nn, k, k - 1 AS d1, nn - k AS d2, (ssb / (k - 1)) / (ssw / (nn - k)) AS f FROM m, ss, sw)
SELECT '{g}' AS column1, '{x}' AS column2, nn AS n, k AS groups, d1 AS df_between, d2 AS df_within,
  {R('f')} AS f, {R(p_f_expr('f', 'd1', 'd2'))} AS p_value FROM f
"""


@register("b8_anova_events", anova_sql("events", "event_type", "value"))
def q_b8(spark, sf):
    """One-way ANOVA of value across event types."""
    return B.anova_oneway(T_(spark, sf, "events"), "event_type", "value")


@register("b8_anova_lineitem", anova_sql("lineitem", "l_returnflag", "l_quantity"))
def q_b8_li(spark, sf):
    """B8 with three groups."""
    return B.anova_oneway(T_(spark, sf, "lineitem"), "l_returnflag", "l_quantity")


def grid_sql(tbl: str, cats: list[str], nums: list[str]) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS cat_col, CAST({c} AS VARCHAR) AS category, '{x}' AS num_col, CAST({x} AS DOUBLE) AS value FROM {tbl}"
        for c in cats for x in nums)
    return f"""
SELECT cat_col, category, num_col, count(value) AS "count", {R('avg(value)')} AS mean,
  {R('quantile_cont(value, 0.5)')} AS median, {R('stddev_samp(value)')} AS std, {R('min(value)')} AS "min",
  {R('max(value)')} AS "max"
FROM ({parts}) WHERE category IS NOT NULL GROUP BY ALL
"""


@register("m2_groupby_grid_orders", grid_sql("orders", ["o_orderstatus", "o_orderpriority"],
                                             ["o_orderkey", "o_custkey", "o_totalprice"]))
def q_m2(spark, sf):
    """M2: count, mean, median, std, min, max of the first 3 numeric by the first 3 text columns."""
    return B.groupby_grid(T_(spark, sf, "orders"))


@register("b9_bivariate_numeric_lineitem", f"""
WITH p AS ({pearson_sql("lineitem", "l_discount", "l_tax")}),
s AS ({spearman_sql("lineitem", "l_discount", "l_tax")})
SELECT p.column1, p.column2, 'numeric_numeric' AS type, p.n, p.r AS pearson_r, p.p_value AS pearson_p,
  s.rho AS spearman_r, s.p_value AS spearman_p, p.strength AS correlation_strength FROM p, s
""")
def q_b9_num(spark, sf):
    """number–number dispatch (Pearson and Spearman)."""
    return B.bivariate(T_(spark, sf, "lineitem"), "l_discount", "l_tax")


@register("b9_bivariate_categorical_orders", f"""
SELECT column1, column2, 'categorical_categorical' AS type, n, chi2, p_value, dof, association AS association_strength
FROM ({chi_sql("orders", "o_orderstatus", "o_orderpriority")})
""")
def q_b9_cat(spark, sf):
    """text–text dispatch (chi-square)."""
    return B.bivariate(T_(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


@register("b9_bivariate_mixed_lineitem", f"""
SELECT 'l_quantity' AS column1, 'l_returnflag' AS column2, 'numeric_categorical' AS type, n, groups,
  f AS anova_f, p_value AS anova_p FROM ({anova_sql("lineitem", "l_returnflag", "l_quantity")})
""")
def q_b9_mixed(spark, sf):
    """Mixed dispatch (ANOVA)."""
    return B.bivariate(T_(spark, sf, "lineitem"), "l_quantity", "l_returnflag")


@register("p7_correlation_matrix_gram_lineitem",
          f"SELECT col_a, col_b, i, j, {R('r')} AS r, n FROM ({corr_sql('lineitem', LI_NUM)})")
def q_p7_gram(spark, sf):
    """P7 through the wide-table plan: per-task matrix products (numpy over Arrow batches), summed by pair."""
    return B.correlation_matrix(T_(spark, sf, "lineitem"), method="gram")
