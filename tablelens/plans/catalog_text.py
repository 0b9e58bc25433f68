"""Registered queries on the text-heavy tables (whole texts, no prefixes)."""

from __future__ import annotations

from tablelens.operators import chartdata as D
from tablelens.operators import kinds as K
from tablelens.operators import pairs as B
from tablelens.operators import profile as P
from tablelens.operators import target as G
from tablelens.plans.catalog_charts import hist_sql
from tablelens.plans.catalog_pairs import anova_sql, chi_sql
from tablelens.plans.catalog_profile import numeric_profile_sql, schema_sql, top_sql
from tablelens.plans.registry import T_, register
from tablelens.plans.sqlgen import R, long


@register("p8_top_values_documents", top_sql("documents", ["text", "lang", "source"], 5))
def q_docs_top(spark, sf):
    """P8/P9 over whole document texts: repeated texts surface as top values."""
    return P.top_values(T_(spark, sf, "documents"), None, 5)


@register("u1_univariate_numeric_documents", numeric_profile_sql("documents", ["doc_id", "n_chars"]))
def q_docs_u1(spark, sf):
    """U1 on documents: text columns are tested for numbers and left out."""
    return P.univariate_numeric(T_(spark, sf, "documents"))


@register("t6_schema_overview_conversations", schema_sql("conversations", ["conv_id", "turn", "role", "text"]))
def q_conv_schema(spark, sf):
    """T6 on conversations."""
    return K.schema_overview(T_(spark, sf, "conversations"))


@register("b8_anova_documents", anova_sql("documents", "lang", "n_chars"))
def q_docs_anova(spark, sf):
    """Document length across languages."""
    return B.anova_oneway(T_(spark, sf, "documents"), "lang", "n_chars")


@register("b5_chi_square_documents", chi_sql("documents", "lang", "source"))
def q_docs_chi(spark, sf):
    """Language × source."""
    return B.chi_square_test(T_(spark, sf, "documents"), "lang", "source")


@register("d1_histogram_documents", hist_sql("documents", "n_chars"))
def q_docs_hist(spark, sf):
    """Document lengths."""
    return D.histogram(T_(spark, sf, "documents"), "n_chars")


@register("u3_univariate_categorical_conversations", f"""
WITH long AS ({long("conversations", ["role", "text"], "VARCHAR")}),
vc AS (SELECT "column", value, count(*) AS n FROM long WHERE value IS NOT NULL GROUP BY "column", value),
rk AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS r FROM vc),
b AS (SELECT "column", count(value) AS total_count, count(*) AS rows_ FROM long GROUP BY "column")
SELECT b."column", (SELECT count(*) FROM vc WHERE vc."column" = b."column") AS unique_count,
  rk.value AS most_frequent, rk.n AS most_frequent_count, rows_ - total_count AS missing_count,
  {R("(rows_ - total_count) * 100.0 / rows_")} AS missing_pct, total_count,
  CASE WHEN total_count = 0 THEN 'No valid categorical data' END AS error
FROM b LEFT JOIN rk ON rk."column" = b."column" AND rk.r = 1
""")
def q_conv_u3(spark, sf):
    """U3 over whole conversation turns."""
    return P.univariate_categorical(T_(spark, sf, "conversations"))


@register("g7_class_separation_labels", f"""
WITH j AS (SELECT CAST(l.quality AS VARCHAR) AS c, d.n_chars AS x FROM labels l JOIN documents d USING (doc_id)),
g AS (SELECT c, avg(x) AS mean, stddev_samp(x) AS std FROM j WHERE c IS NOT NULL GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY c) AS k FROM g),
a AS (SELECT count(*) AS classes, arg_max(c, mean) AS hc, max(mean) AS hm, arg_min(c, mean) AS lc, min(mean) AS lm,
             avg(std) AS ms FROM g),
t AS (SELECT any_value(mean) FILTER (WHERE k = 1) AS m1, any_value(mean) FILTER (WHERE k = 2) AS m2,
             any_value(std) FILTER (WHERE k = 1) AS s1, any_value(std) FILTER (WHERE k = 2) AS s2 FROM o),
d AS (SELECT abs(m1 - m2) / sqrt((s1 * s1 + s2 * s2) / 2) AS d FROM t)
SELECT 'quality' AS target, 'n_chars' AS feature, classes, hc AS highest_class, {R('hm')} AS highest_mean,
  lc AS lowest_class, {R('lm')} AS lowest_mean, {R('hm - lm')} AS feature_range,
  CASE WHEN classes = 2 THEN {R('d')} END AS cohens_d,
  CASE WHEN classes = 2 THEN CASE WHEN d > 0.8 THEN 'strong' WHEN d > 0.5 THEN 'moderate' ELSE 'weak' END END AS separation,
  CASE WHEN classes = 2 THEN {R('(m1 + m2) / 2')} END AS threshold,
  CASE WHEN classes <> 2 THEN CASE WHEN hm - lm > 2 * ms THEN 'high' ELSE 'moderate' END END AS discrimination
FROM a, t, d
""")
def q_labels_sep(spark, sf):
    """G7 on labelled documents (labels joined to documents on doc_id): does length separate quality?"""
    from pyspark.sql import functions as F
    lab = T_(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"))
    docs = T_(spark, sf, "documents").select("doc_id", "n_chars")
    return G.class_separation(lab.join(docs, "doc_id"), "quality", "n_chars")
