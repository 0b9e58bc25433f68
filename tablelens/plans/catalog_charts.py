"""Registered queries: chart data and target analysis."""

from __future__ import annotations

from tablelens.operators import chartdata as D
from tablelens.operators import target as G
from tablelens.plans.registry import T_, register
from tablelens.plans.sqlgen import R, p_chi2_expr


def hist_sql(tbl: str, col: str) -> str:
    return f"""
WITH v AS (SELECT CAST({col} AS DOUBLE) AS v FROM {tbl} WHERE {col} IS NOT NULL AND NOT isnan(CAST({col} AS DOUBLE))),
s AS (SELECT count(v) AS n, min(v) AS mn, max(v) AS mx FROM v),
k AS (SELECT least(50, greatest(10, CAST(floor(sqrt(n)) AS BIGINT))) AS k, mn, mx FROM s),
b AS (SELECT CASE WHEN mx = mn THEN 1 ELSE least(k, CAST(floor(CAST(k AS DOUBLE) * (v - mn) / (mx - mn)) AS BIGINT) + 1) END AS bin
      FROM v, k),
c AS (SELECT bin, count(*) AS cnt FROM b GROUP BY bin)
SELECT g.bin, {R('mn + (g.bin - 1) * ((mx - mn) / k)')} AS lower, {R('mn + g.bin * ((mx - mn) / k)')} AS upper,
  coalesce(c.cnt, 0) AS "count"
FROM k, (SELECT range AS bin FROM range(1, (SELECT k FROM k) + 1)) g LEFT JOIN c ON c.bin = g.bin
"""


@register("d1_histogram_lineitem", hist_sql("lineitem", "l_extendedprice"))
def q_d1(spark, sf):
    """sqrt(n)-rule histogram (10..50 equal-width bins, empty bins kept)."""
    return D.histogram(T_(spark, sf, "lineitem"), "l_extendedprice")


@register("d1_histogram_events", hist_sql("events", "value"))
def q_d1_events(spark, sf):
    """D1 on events.value."""
    return D.histogram(T_(spark, sf, "events"), "value")


def box_sql(tbl: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        parts.append(f"""
SELECT '{c}' AS "column", q1, med, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi,
  (SELECT min(x) FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {tbl}) WHERE x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1)) AS wl,
  (SELECT max(x) FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {tbl}) WHERE x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1)) AS wh,
  (SELECT count(*) FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {tbl}) WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS o,
  mn, mx, n
FROM (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS med,
             quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3, min(CAST({c} AS DOUBLE)) AS mn, max(CAST({c} AS DOUBLE)) AS mx,
             count({c}) AS n FROM {tbl})""")
    body = " UNION ALL ".join(parts)
    return f"""SELECT "column", {R('q1')} AS q1, {R('med')} AS median, {R('q3')} AS q3, {R('lo')} AS lower_fence,
  {R('hi')} AS upper_fence, {R('wl')} AS whisker_low, {R('wh')} AS whisker_high, o AS outliers, {R('mn')} AS "min",
  {R('mx')} AS "max", n FROM ({body})"""


@register("d2_box_stats_part", box_sql("part", ["p_partkey", "p_size", "p_retailprice"]))
def q_d2(spark, sf):
    """Quartiles, fences, whiskers and outlier counts per numeric column."""
    return D.box_stats(T_(spark, sf, "part"))


@register("d10_grouped_box_orders", f"""
WITH v AS (SELECT o_orderpriority AS g, o_totalprice AS x FROM orders WHERE o_orderpriority IS NOT NULL),
q AS (SELECT g, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.75) AS q3 FROM v GROUP BY g),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT f.g AS o_orderpriority, {R('any_value(q1)')} AS q1, {R('any_value(med)')} AS median, {R('any_value(q3)')} AS q3,
  {R('any_value(lo)')} AS lower_fence, {R('any_value(hi)')} AS upper_fence,
  {R('min(x) FILTER (WHERE x >= lo AND x <= hi)')} AS whisker_low, {R('max(x) FILTER (WHERE x >= lo AND x <= hi)')} AS whisker_high,
  count(*) FILTER (WHERE x < lo OR x > hi) AS outliers, {R('min(x)')} AS "min", {R('max(x)')} AS "max", count(x) AS n
FROM v JOIN f USING (g) GROUP BY f.g
""")
def q_d10(spark, sf):
    """Box statistics per category (fences join back under a size check)."""
    return D.grouped_box(T_(spark, sf, "orders"), "o_orderpriority", "o_totalprice")


@register("d3_density_lineitem", f"""
WITH v AS (SELECT l_quantity AS v FROM lineitem WHERE l_quantity IS NOT NULL),
s AS (SELECT count(v) AS n, min(v) AS mn, max(v) AS mx, stddev_samp(v) AS sd FROM v),
p AS (SELECT n, mn, mx, 1.06 * sd * power(n, -0.2) AS h, (mx - mn) / 512 AS w, (mx - mn) / 99 AS step FROM s),
fb AS (SELECT least(512, CAST(floor(512.0 * (v - mn) / (mx - mn)) AS BIGINT) + 1) AS b, count(*) AS wt FROM v, p GROUP BY 1),
c AS (SELECT mn + (b - 0.5) * w AS c, wt FROM fb, p),
g AS (SELECT range AS g FROM range(0, 100))
SELECT CAST(g.g AS INTEGER) AS point, {R('mn + g.g * step')} AS x,
  {R('sum(wt * exp(-0.5 * ((mn + g.g * step - c) / h) * ((mn + g.g * step - c) / h))) * (1.0 / (n * h * sqrt(2 * pi())))')} AS density
FROM g, c, p GROUP BY g.g, mn, step, n, h
""")
def q_d3(spark, sf):
    """D3: binned Gaussian kernel density on 100 points."""
    return D.density(T_(spark, sf, "lineitem"), "l_quantity")


@register("d11_parallel_coordinates_part", """
WITH s AS (SELECT min(p_partkey) AS a0, max(p_partkey) AS a1, min(p_size) AS b0, max(p_size) AS b1,
                  min(p_retailprice) AS c0, max(p_retailprice) AS c1 FROM part)
SELECT round((p_partkey - a0) / CAST(a1 - a0 AS DOUBLE), 6) + 0.0 AS p_partkey,
       round((p_size - b0) / CAST(b1 - b0 AS DOUBLE), 6) + 0.0 AS p_size,
       round((p_retailprice - c0) / (c1 - c0), 6) + 0.0 AS p_retailprice FROM part, s
""")
def q_d11(spark, sf):
    """Min-max scaled numeric columns for every row (no sampling)."""
    return D.parallel_coordinates(T_(spark, sf, "part"))


@register("d12_outlier_rows_events", """
WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
f AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT e.*, round(lo, 6) + 0.0 AS lower_fence, round(hi, 6) + 0.0 AS upper_fence FROM events e, f WHERE value < lo OR value > hi
""".replace("SELECT e.*,", "SELECT event_id, ts, user_id, event_type, round(value, 6) + 0.0 AS value, props,"))
def q_d12(spark, sf):
    """The rows outside the Tukey fences of a column."""
    return D.outlier_rows(T_(spark, sf, "events"), "value")


@register("d14_time_series_orders", """
SELECT o_orderdate, round(o_totalprice, 6) + 0.0 AS o_totalprice FROM orders
WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL
""")
def q_d14(spark, sf):
    """(date, value) sorted by date, incomplete rows dropped."""
    return D.time_series(T_(spark, sf, "orders"), "o_orderdate", "o_totalprice")


# ------------------------------------------------------------------ targets

NAMES = ["target", "label", "y", "class", "category", "outcome", "result", "prediction"]


def detect_sql(tbl: str, cols: list[str], texts: list[str], nums: list[str]) -> str:
    named = [c for c in cols if any(t in c.lower() for t in NAMES)]
    parts = [f"SELECT 0 AS seq, '{c}' AS \"column\", 'Common target variable naming pattern' AS reason, 'high' AS confidence"
             for c in named]
    for c in texts:
        parts.append(f"SELECT 1, '{c}', 'Categorical variable with ' || d || ' unique values (potential classification target)', 'medium' "
                     f"FROM (SELECT count(DISTINCT {c}) AS d FROM {tbl}) WHERE d BETWEEN 2 AND 10")
    for c in nums:
        parts.append(f"SELECT 2, '{c}', printf('Numeric variable with range %.2f to %.2f (potential regression target)', mn, mx), 'low' "
                     f"FROM (SELECT CAST(min({c}) AS DOUBLE) AS mn, CAST(max({c}) AS DOUBLE) AS mx FROM {tbl}) WHERE mn >= 0 AND mx <= 1000")
    return " UNION ALL ".join(parts)


@register("g1_detect_targets_events", detect_sql("events", ["event_id", "ts", "user_id", "event_type", "value", "props"],
                                                 ["event_type", "props"], ["event_id", "user_id", "value"]))
def q_g1(spark, sf):
    """G1: likely target columns by name, small text cardinality, bounded numeric range."""
    return G.detect_targets(T_(spark, sf, "events"))


@register("g1_detect_targets_labels", detect_sql("labels", ["doc_id", "quality", "toxic"], [], ["doc_id", "quality", "toxic"]))
def q_g1_labels(spark, sf):
    """G1 on labels ('quality' matches the name rule through its 'y')."""
    return G.detect_targets(T_(spark, sf, "labels"))


def by_cat_sql(tbl: str, cat: str, x: str) -> str:
    return f"""
SELECT CAST({cat} AS VARCHAR) AS {cat}, count({x}) AS "count", {R(f'avg({x})')} AS mean, {R(f'quantile_cont({x}, 0.5)')} AS median,
  {R(f'stddev_samp({x})')} AS std, {R(f'min({x})')} AS "min", {R(f'max({x})')} AS "max"
FROM {tbl} WHERE {cat} IS NOT NULL GROUP BY 1
"""


@register("g2_target_by_category_orders", by_cat_sql("orders", "o_orderpriority", "o_totalprice"))
def q_g2(spark, sf):
    """Numeric target statistics per category of a text feature."""
    return G.target_by_category(T_(spark, sf, "orders"), "o_totalprice", "o_orderpriority")


@register("g3_feature_by_target_customer", by_cat_sql("customer", "c_mktsegment", "c_acctbal"))
def q_g3(spark, sf):
    """Numeric feature statistics per class of a text target."""
    return G.target_by_category(T_(spark, sf, "customer"), "c_mktsegment", "c_acctbal")


@register("g5_target_correlation_lineitem", f"""
SELECT 'l_extendedprice' AS target, 'l_quantity' AS feature, {R('corr(l_extendedprice, l_quantity)')} AS correlation FROM lineitem
""")
def q_g5(spark, sf):
    """Correlation of a numeric feature with a numeric target."""
    return G.target_correlation(T_(spark, sf, "lineitem"), "l_extendedprice", "l_quantity")


@register("g6_category_impact_orders", f"""
WITH g AS ({by_cat_sql("orders", "o_orderpriority", "o_totalprice").replace(R('avg(o_totalprice)'), 'avg(o_totalprice)').replace(R('stddev_samp(o_totalprice)'), 'stddev_samp(o_totalprice)')}),
cv AS (SELECT *, abs(std / mean) AS cv FROM g)
SELECT 'o_totalprice' AS target, 'o_orderpriority' AS feature,
  arg_max(o_orderpriority, [mean, -0.0]) AS best_category, {R('max(mean)')} AS best_mean,
  arg_min(o_orderpriority, mean) AS worst_category, {R('min(mean)')} AS worst_mean,
  {R('max(mean) - min(mean)')} AS impact_range, {R('avg(std)')} AS mean_std,
  CASE WHEN max(mean) - min(mean) > avg(std) THEN 'high' ELSE 'moderate' END AS impact,
  arg_min(o_orderpriority, cv) AS most_stable, arg_max(o_orderpriority, cv) AS least_stable,
  min("count") AS min_count, max("count") AS max_count, min("count") < 30 AS small_sample,
  max(mean) - min(mean) > 2 * avg(std) AS action
FROM cv
""")
def q_g6(spark, sf):
    """best/worst category, impact range, stability and sample-size flags."""
    return G.category_impact(T_(spark, sf, "orders"), "o_totalprice", "o_orderpriority")


def sep_sql(tbl: str, target: str, feature: str) -> str:
    return f"""
WITH g AS (SELECT CAST({target} AS VARCHAR) AS c, avg({feature}) AS mean, stddev_samp({feature}) AS std
           FROM {tbl} WHERE {target} IS NOT NULL GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY c) AS k FROM g),
a AS (SELECT count(*) AS classes, arg_max(c, mean) AS hc, max(mean) AS hm, arg_min(c, mean) AS lc, min(mean) AS lm,
             avg(std) AS ms FROM g),
t AS (SELECT any_value(mean) FILTER (WHERE k = 1) AS m1, any_value(mean) FILTER (WHERE k = 2) AS m2,
             any_value(std) FILTER (WHERE k = 1) AS s1, any_value(std) FILTER (WHERE k = 2) AS s2 FROM o),
d AS (SELECT abs(m1 - m2) / sqrt((s1 * s1 + s2 * s2) / 2) AS d FROM t)
SELECT '{target}' AS target, '{feature}' AS feature, classes, hc AS highest_class, {R('hm')} AS highest_mean,
  lc AS lowest_class, {R('lm')} AS lowest_mean, {R('hm - lm')} AS feature_range,
  CASE WHEN classes = 2 THEN {R('d')} END AS cohens_d,
  CASE WHEN classes = 2 THEN CASE WHEN d > 0.8 THEN 'strong' WHEN d > 0.5 THEN 'moderate' ELSE 'weak' END END AS separation,
  CASE WHEN classes = 2 THEN {R('(m1 + m2) / 2')} END AS threshold,
  CASE WHEN classes <> 2 THEN CASE WHEN hm - lm > 2 * ms THEN 'high' ELSE 'moderate' END END AS discrimination
FROM a, t, d
"""


@register("g7_class_separation_lineitem", sep_sql("lineitem", "l_linestatus", "l_extendedprice"))
def q_g7(spark, sf):
    """Two classes — Cohen's d, strength and midpoint threshold."""
    return G.class_separation(T_(spark, sf, "lineitem"), "l_linestatus", "l_extendedprice")


@register("g7_class_separation_multiclass", sep_sql("lineitem", "l_returnflag", "l_quantity"))
def q_g7_multi(spark, sf):
    """Three classes — discrimination from the range of class means."""
    return G.class_separation(T_(spark, sf, "lineitem"), "l_returnflag", "l_quantity")


@register("g8_association_residuals_orders", f"""
WITH cells AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*) AS n FROM orders
               WHERE o_orderpriority IS NOT NULL AND o_orderstatus IS NOT NULL GROUP BY 1, 2),
ra AS (SELECT a, sum(n) AS ra FROM cells GROUP BY a), cb AS (SELECT b, sum(n) AS cb FROM cells GROUP BY b),
tot AS (SELECT sum(n) AS nn, count(DISTINCT a) AS r, count(DISTINCT b) AS c FROM cells),
dense AS (SELECT coalesce(cells.n, 0) AS o, ra.ra * cb.cb / tot.nn AS e, tot.nn AS nn, (tot.r - 1) * (tot.c - 1) AS dof
          FROM ra CROSS JOIN cb CROSS JOIN tot LEFT JOIN cells ON cells.a = ra.a AND cells.b = cb.b),
st AS (SELECT any_value(dof) AS dof,
              sum(CASE WHEN dof = 1 THEN power(abs(o - e) - least(0.5, abs(o - e)), 2) / e ELSE power(o - e, 2) / e END) AS chi2,
              min((o / nn - e / nn) / sqrt(e / nn)) AS mnr, max((o / nn - e / nn) / sqrt(e / nn)) AS mxr,
              max((o - e) / sqrt(e)) AS mpr, min(o) AS mc FROM dense)
SELECT 'o_orderstatus' AS target, 'o_orderpriority' AS feature, {R('chi2')} AS chi2, {R(p_chi2_expr('chi2', 'dof'))} AS p_value,
  CAST(dof AS BIGINT) AS dof,
  CASE WHEN {p_chi2_expr('chi2', 'dof')} < 0.001 THEN 'very strong' WHEN {p_chi2_expr('chi2', 'dof')} < 0.05 THEN 'strong' ELSE 'weak' END AS association,
  {R('mnr')} AS min_residual, {R('mxr')} AS max_residual, {R('mpr')} AS max_pearson_residual,
  CASE WHEN abs(mxr) > 2 THEN 'strong' WHEN abs(mxr) > 1 THEN 'moderate' ELSE 'weak' END AS pattern,
  CAST(mc AS BIGINT) AS min_count, mc < 5 AS small_counts
FROM st
""")
def q_g8(spark, sf):
    """Chi-square plus standardised residuals over all cells (zeros included)."""
    return G.association_residuals(T_(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


@register("g9_correlation_reading_lineitem", f"""
WITH r AS (SELECT corr(l_extendedprice, l_quantity) AS r FROM lineitem)
SELECT 'l_extendedprice' AS target, 'l_quantity' AS feature, {R('r')} AS correlation,
  CASE WHEN abs(r) > 0.7 THEN 'very strong' WHEN abs(r) > 0.5 THEN 'strong' WHEN abs(r) > 0.3 THEN 'moderate' ELSE 'weak' END AS strength,
  CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction,
  CASE WHEN abs(r) > 0.7 THEN 'high' WHEN abs(r) > 0.3 THEN 'moderate' ELSE 'low' END AS predictive_power,
  abs(r) > 0.5 AS key_driver, {R('r * r')} AS r_squared,
  CASE WHEN r * r > 0.5 THEN 'high' WHEN r * r > 0.25 THEN 'moderate' ELSE 'low' END AS explanatory_power
FROM r
""")
def q_g9(spark, sf):
    """Reading of a correlation (strength, direction, r², driver)."""
    return G.correlation_reading(T_(spark, sf, "lineitem"), "l_extendedprice", "l_quantity")


LI_FEATS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax",
            "l_returnflag", "l_linestatus", "l_shipdate"]


def impact_sql(tbl: str, target: str, feats: list[str], nums: list[str]) -> str:
    parts = []
    for i, f in enumerate(feats):
        if f in nums:
            parts.append(f"SELECT {i} AS position, '{f}' AS feature, 'Correlation' AS impact_type, corr({target}, {f}) AS value, "
                         f"NULL::DOUBLE AS mean_std FROM {tbl}")
        else:
            parts.append(f"SELECT {i}, '{f}', 'Range', max(m) - min(m), avg(s) FROM "
                         f"(SELECT avg({target}) AS m, stddev_samp({target}) AS s FROM {tbl} WHERE {f} IS NOT NULL GROUP BY {f})")
    return " UNION ALL ".join(parts)


IMPACT = f"""
WITH rel AS ({impact_sql("lineitem", "l_extendedprice", LI_FEATS, LI_FEATS[:7])}),
imp AS (SELECT position, feature, impact_type, value,
  CASE WHEN impact_type = 'Correlation' THEN printf('%.3f', value) ELSE printf('%.2f', value) END AS impact_value,
  CASE WHEN impact_type = 'Correlation' THEN CASE WHEN abs(value) > 0.7 THEN 'High' WHEN abs(value) > 0.3 THEN 'Medium' ELSE 'Low' END
       ELSE CASE WHEN value > mean_std THEN 'High' WHEN value > mean_std / 2 THEN 'Medium' ELSE 'Low' END END AS strength
  FROM rel WHERE value IS NOT NULL)
"""


@register("g10_feature_impact_lineitem", IMPACT + f"SELECT position, feature, impact_type, {R('value')} AS value, impact_value, strength FROM imp")
def q_g10(spark, sf):
    """Impact of the first 10 features on a numeric target (r or range of means)."""
    return G.feature_impact(T_(spark, sf, "lineitem"), "l_extendedprice")


@register("g11_top_impact_lineitem", IMPACT + f"""
SELECT CAST(row_number() OVER (ORDER BY abs_impact DESC, position) AS INTEGER) AS rank, feature, impact_type, impact_value, strength,
  {R('abs_impact')} AS abs_impact
FROM (SELECT *, abs(CASE WHEN impact_type = 'Correlation' THEN round(value, 3) ELSE round(value, 2) END) AS abs_impact FROM imp)
ORDER BY abs_impact DESC, position LIMIT 5
""")
def q_g11(spark, sf):
    """The five strongest impacts as printed."""
    return G.top_impact(G.feature_impact(T_(spark, sf, "lineitem"), "l_extendedprice"))


@register("g12_feature_ranking_orders", f"""
WITH rel AS (
  SELECT 0 AS position, 'o_orderkey' AS feature, 'Correlation' AS impact_type, abs(corr(o_totalprice, o_orderkey)) AS strength,
         corr(o_totalprice, o_orderkey) AS value, 2 AS groups FROM orders
  UNION ALL SELECT 1, 'o_custkey', 'Correlation', abs(corr(o_totalprice, o_custkey)), corr(o_totalprice, o_custkey), 2 FROM orders
  UNION ALL SELECT 2, 'o_orderstatus', 'Range', max(m) - min(m), max(m) - min(m), count(*) FROM
    (SELECT avg(o_totalprice) AS m FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY o_orderstatus)
  UNION ALL SELECT 5, 'o_orderpriority', 'Range', max(m) - min(m), max(m) - min(m), count(*) FROM
    (SELECT avg(o_totalprice) AS m FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority))
SELECT CAST(row_number() OVER (ORDER BY strength DESC, position) AS INTEGER) AS rank, feature, impact_type, {R('strength')} AS strength, {R('value')} AS value
FROM rel WHERE value IS NOT NULL AND groups > 1 ORDER BY strength DESC, position LIMIT 3
""")
def q_g12(spark, sf):
    """Every feature ranked against a numeric target; top 3."""
    return G.feature_ranking(T_(spark, sf, "orders"), "o_totalprice")


@register("g13_target_summary_numeric", f"""
SELECT 'l_extendedprice' AS target, 'numeric' AS type, count(DISTINCT l_extendedprice) AS "unique", {R('min(l_extendedprice)')} AS "min",
  {R('max(l_extendedprice)')} AS "max", {R('avg(l_extendedprice)')} AS mean, {R('stddev_samp(l_extendedprice)')} AS std,
  {R('skewness(l_extendedprice)')} AS skewness, abs(skewness(l_extendedprice)) > 1 AS skewed,
  CASE WHEN abs(skewness(l_extendedprice)) > 1 THEN CASE WHEN skewness(l_extendedprice) > 0 THEN 'right' ELSE 'left' END END AS skew_direction
FROM lineitem
""")
def q_g13_num(spark, sf):
    """Numeric target summary."""
    return G.target_summary(T_(spark, sf, "lineitem"), "l_extendedprice")


@register("g13_target_summary_categorical", f"""
WITH vc AS (SELECT o_orderpriority AS v, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1),
t AS (SELECT count(*) AS u, arg_max(v, [n::DOUBLE]) AS mc, max(n) AS mn FROM vc), r AS (SELECT count(*) AS rows_ FROM orders)
SELECT 'o_orderpriority' AS target, 'categorical' AS type, u AS "unique",
  (SELECT v FROM vc ORDER BY n DESC, v LIMIT 1) AS most_common, {R('mn * 100.0 / rows_')} AS most_common_pct,
  mn * 100.0 / rows_ > 50 AS imbalanced FROM t, r
""")
def q_g13_cat(spark, sf):
    """Text target summary (mode, its share, imbalance)."""
    return G.target_summary(T_(spark, sf, "orders"), "o_orderpriority")
