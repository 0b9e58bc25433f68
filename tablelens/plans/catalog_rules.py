"""Registered queries exercising the value-based rules and the text-target branch."""

from __future__ import annotations

from tablelens.operators import chartdata as D
from tablelens.operators import pairs as B
from tablelens.operators import profile as P
from tablelens.operators import target as G
from tablelens.plans.catalog_pairs import STRENGTH
from tablelens.plans.catalog_profile import numeric_profile_sql
from tablelens.plans.registry import T_, dirty, register
from tablelens.plans.sqlgen import DIRTY, R, p_corr_cte, to_number


def _impact_text_target_sql() -> str:
    feats = [("o_orderkey", 0), ("o_custkey", 1), ("o_totalprice", 3)]
    parts = " UNION ALL ".join(
        f"SELECT {pos} AS position, '{f}' AS feature, max(m) - min(m) AS value, avg(s) AS mean_std FROM "
        f"(SELECT avg({f}) AS m, stddev_samp({f}) AS s FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority)"
        for f, pos in feats)
    return f"""
SELECT CAST(position AS INTEGER) AS position, feature, 'Range' AS impact_type, {R('value')} AS value,
  printf('%.2f', value) AS impact_value,
  CASE WHEN value > mean_std THEN 'High' WHEN value > mean_std / 2 THEN 'Medium' ELSE 'Low' END AS strength
FROM ({parts})
"""


@register("g10_feature_impact_text_target_orders", _impact_text_target_sql())
def q_g10_text(spark, sf):
    """G10 with a text target: numeric features ranked by the range of their class means (text features left out)."""
    return G.feature_impact(T_(spark, sf, "orders"), "o_orderpriority")


PT = to_number("part_text")


@register("d1_histogram_text_numbers_dirty", f"""
WITH v AS (SELECT {PT} AS v FROM {DIRTY} WHERE {PT} IS NOT NULL),
s AS (SELECT count(v) AS n, min(v) AS mn, max(v) AS mx FROM v),
k AS (SELECT least(50, greatest(10, CAST(floor(sqrt(n)) AS BIGINT))) AS k, mn, mx FROM s),
b AS (SELECT CASE WHEN mx = mn THEN 1 ELSE least(k, CAST(floor(CAST(k AS DOUBLE) * (v - mn) / (mx - mn)) AS BIGINT) + 1) END AS bin
      FROM v, k),
c AS (SELECT bin, count(*) AS cnt FROM b GROUP BY bin)
SELECT g.bin, {R('mn + (g.bin - 1) * ((mx - mn) / k)')} AS lower, {R('mn + g.bin * ((mx - mn) / k)')} AS upper,
  coalesce(c.cnt, 0) AS "count"
FROM k, (SELECT range AS bin FROM range(1, (SELECT k FROM k) + 1)) g LEFT JOIN c ON c.bin = g.bin
""")
def q_d1_text(spark, sf):
    """D1 on a text column: numeric when any value converts ('?' values are dropped)."""
    return D.histogram(dirty(spark, sf), "part_text")


@register("u4_univariate_text_numbers_dirty", numeric_profile_sql(DIRTY, ["supp_text"], {"supp_text": to_number("supp_text")}))
def q_u4_text_numbers(spark, sf):
    """U4 on a text column whose values are numbers: analysed as numeric (majority rule)."""
    return P.univariate(dirty(spark, sf), "supp_text")


NOSENT = ("(CASE WHEN part_text NOT IN ('?', 'N/A', 'n/a', 'NA', 'na', '', ' ') THEN part_text END)")


@register("b9_bivariate_sentinel_rule_dirty", f"""
WITH d AS (SELECT {to_number(NOSENT)} AS x, quantity AS y FROM {DIRTY}),
ps AS (SELECT corr(x, y) AS r, count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS n FROM d),
{p_corr_cte('pp', 'ps')},
c AS (SELECT x, y FROM d WHERE x IS NOT NULL AND y IS NOT NULL),
rk AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
              rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM c),
ss AS (SELECT count(*) AS n, corr(rx, ry) AS r FROM rk),
{p_corr_cte('sp', 'ss')}
SELECT 'part_text' AS column1, 'quantity' AS column2, 'numeric_numeric' AS type, pp.n, {R('pp.r')} AS pearson_r,
  {R('pp.p_value')} AS pearson_p, {R('sp.r')} AS spearman_r, {R('sp.p_value')} AS spearman_p,
  {STRENGTH.format(r='pp.r')} AS correlation_strength
FROM pp, sp
""")
def q_b9_sentinel(spark, sf):
    """B9 on a text column with '?' sentinels: numeric by the sentinel-aware majority-of-rows rule."""
    return B.bivariate(dirty(spark, sf), "part_text", "quantity")
