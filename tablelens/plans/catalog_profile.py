"""Registered queries: kinds, profile and single-column analysis."""

from __future__ import annotations

from tablelens.operators import kinds as K
from tablelens.operators import profile as P
from tablelens.plans.registry import T_, dirty, register
from tablelens.plans.sqlgen import DIRTY, R, long, to_number

LINEITEM_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                "l_extendedprice", "l_discount", "l_tax"]
DUCK_TYPE = ("CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' "
             "WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT' THEN 'float' "
             "WHEN 'BOOLEAN' THEN 'boolean' WHEN 'DATE' THEN 'date' ELSE lower(data_type) END")
KIND = ("CASE WHEN data_type IN ('BIGINT','INTEGER','DOUBLE','FLOAT','SMALLINT','TINYINT','BOOLEAN') "
        "OR data_type LIKE 'DECIMAL%' THEN 'numeric' WHEN data_type = 'VARCHAR' THEN 'categorical' "
        "WHEN data_type IN ('TIMESTAMP','DATE','TIMESTAMP WITH TIME ZONE') THEN 'datetime' ELSE 'other' END")


ROUNDED = R


def numeric_profile_sql(src: str, cols: list[str], exprs: dict[str, str] | None = None, exact: bool = False) -> str:
    R = (lambda x: f"({x})") if exact else ROUNDED  # noqa: N806
    return f"""
WITH long AS ({long(src, cols, exprs=exprs)}),
s AS (
  SELECT "column", count(value) AS cnt, count(*) AS rows_, avg(value) AS mean,
         stddev_samp(value) AS std, min(value) AS mn, max(value) AS mx,
         quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS median,
         quantile_cont(value, 0.75) AS q75,
         CASE WHEN count(value) < 3 THEN NULL WHEN var_pop(value) = 0 THEN 0.0 ELSE skewness(value) END AS skew,
         CASE WHEN count(value) < 4 THEN NULL WHEN var_pop(value) = 0 THEN 0.0 ELSE kurtosis(value) END AS kurt,
         count(DISTINCT value) AS uniq
  FROM long GROUP BY "column"),
o AS (
  SELECT l."column", count(*) FILTER (WHERE l.value < s.q25 - 1.5 * (s.q75 - s.q25)
                                        OR l.value > s.q75 + 1.5 * (s.q75 - s.q25)) AS outliers
  FROM long l JOIN s USING ("column") GROUP BY l."column")
SELECT s."column", s.cnt AS "count", {R('s.mean')} AS mean, {R('s.median')} AS median, {R('s.std')} AS std,
       {R('s.mn')} AS "min", {R('s.mx')} AS "max", {R('s.q25')} AS q25, {R('s.q75')} AS q75,
       {R('s.skew')} AS skewness, {R('s.kurt')} AS kurtosis,
       s.rows_ - s.cnt AS missing_count, {R('(s.rows_ - s.cnt) * 100.0 / s.rows_')} AS missing_pct,
       CASE WHEN s.cnt > 0 THEN o.outliers END AS outliers, s.uniq AS unique_count,
       CASE WHEN s.cnt = 0 THEN 'No valid numeric data' END AS error
FROM s JOIN o USING ("column")
"""


@register("u1_univariate_numeric_lineitem", numeric_profile_sql("lineitem", LINEITEM_NUM, exact=True), exact=True)
def q_u1_lineitem(spark, sf):
    """U1+U2 for every numeric lineitem column: moments, exact quartiles, IQR outliers."""
    return P.univariate_numeric(T_(spark, sf, "lineitem"))


DIRTY_NUM = ["l_orderkey", "l_linenumber", "quantity", "part_text", "supp_text"]


@register("u1_univariate_numeric_dirty", numeric_profile_sql(
    DIRTY, DIRTY_NUM, {"part_text": to_number("part_text"), "supp_text": to_number("supp_text")}))
def q_u1_dirty(spark, sf):
    """U1 with the majority rule: text columns whose non-null values are mostly numbers join the numeric profile."""
    return P.univariate_numeric(dirty(spark, sf))


def describe_sql(src: str, cols: list[str]) -> str:
    return f"""
WITH long AS ({long(src, cols)})
SELECT "column", count(value) AS "count", {R('avg(value)')} AS mean, {R('stddev_samp(value)')} AS std,
  {R('min(value)')} AS "min", {R('quantile_cont(value, 0.25)')} AS q25, {R('quantile_cont(value, 0.5)')} AS median,
  {R('quantile_cont(value, 0.75)')} AS q75, {R('max(value)')} AS "max",
  {R("CASE WHEN count(value) < 3 THEN NULL WHEN var_pop(value) = 0 THEN 0.0 ELSE skewness(value) END")} AS skewness,
  {R("CASE WHEN count(value) < 4 THEN NULL WHEN var_pop(value) = 0 THEN 0.0 ELSE kurtosis(value) END")} AS kurtosis
FROM long GROUP BY "column"
"""


@register("p4_describe_numeric_part", describe_sql("part", ["p_partkey", "p_size", "p_retailprice"]))
def q_p4_part(spark, sf):
    """Describe + adjusted skewness and kurtosis of the numeric part columns."""
    return P.describe_numeric(T_(spark, sf, "part"))


@register("p4_describe_numeric_orders", describe_sql("orders", ["o_orderkey", "o_custkey", "o_totalprice"]))
def q_p4_orders(spark, sf):
    """P4–P6 on orders."""
    return P.describe_numeric(T_(spark, sf, "orders"))


@register("p4_describe_numeric_events", describe_sql("events", ["event_id", "user_id", "value"]))
def q_p4_events(spark, sf):
    """P4–P6 on events."""
    return P.describe_numeric(T_(spark, sf, "events"))


def schema_sql(tbl: str, cols: list[str]) -> str:
    counts = " UNION ALL ".join(
        f"SELECT '{c}' AS cname, count({c}) AS non_null, count(*) AS rows_ FROM {tbl}" for c in cols)
    return f"""
WITH c AS ({counts})
SELECT CAST(ordinal_position - 1 AS INTEGER) AS position, column_name AS "column", {DUCK_TYPE} AS dtype,
       c.non_null, c.rows_ - c.non_null AS null_count
FROM information_schema.columns i JOIN c ON c.cname = i.column_name
WHERE table_name = '{tbl}'
"""


ORDERS_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@register("t6_schema_overview_orders", schema_sql("orders", ORDERS_COLS))
def q_t6(spark, sf):
    """Column, dtype, non-null and null counts in one pass."""
    return K.schema_overview(T_(spark, sf, "orders"))


@register("t1_column_kinds_orders", f"""
SELECT CAST(ordinal_position - 1 AS INTEGER) AS position, column_name AS "column", {DUCK_TYPE} AS dtype,
       {KIND} AS kind FROM information_schema.columns WHERE table_name = 'orders'
""")
def q_t1(spark, sf):
    """Kind and dtype of every column (schema walk)."""
    return K.column_kinds(T_(spark, sf, "orders"))


DIRTY_TEXT = ["returnflag", "part_text", "supp_text", "empty_col"]
DATE_SQL = "coalesce(" + ", ".join(
    f"TRY_STRPTIME({{c}}, '{f}')" for f in ["%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y/%m/%d",
                                            "%m/%d/%Y", "%d-%m-%Y", "%m-%d-%Y", "%Y%m%d"]) + ")"


def coercion_sql() -> str:
    parts = []
    for c in DIRTY_TEXT:
        nosent = f"CASE WHEN {c} NOT IN ('?', 'N/A', 'n/a', 'NA', 'na', '', ' ') THEN {c} END"
        parts.append(f"""SELECT '{c}' AS "column", count(*) AS rows, count({c}) AS non_null,
  count({to_number(c)}) AS numeric, count({to_number(nosent)}) AS numeric_no_sentinel,
  count({DATE_SQL.format(c=c)}) AS datetime FROM {DIRTY}""")
    body = " UNION ALL ".join(parts)
    return f"""
SELECT "column", rows, non_null, numeric, numeric_no_sentinel, datetime,
  numeric > 0.5 * non_null AS majority_non_null,
  CASE WHEN rows > 0 THEN numeric_no_sentinel / rows > 0.5 ELSE false END AS majority_rows,
  numeric > 0 AS any_value,
  CASE WHEN numeric = non_null THEN 'Converted to numeric' WHEN datetime = non_null THEN 'Converted to datetime'
       ELSE 'Kept as categorical' END AS conversion
FROM ({body})
"""


@register("t2_t5_coercion_rules_dirty", coercion_sql())
def q_t2_t5(spark, sf):
    """The four value-based typing rules for every text column, one pass."""
    return K.coercion_rules(dirty(spark, sf))


def info_sql(src: str, cols: list[str], width: int, texts: list[str]) -> str:
    var = " + ".join(f"coalesce(strlen({t}), 0)" for t in texts) or "0"
    return f"""
WITH b AS (SELECT count(*) AS n_rows, sum({var}) AS v FROM {src}),
d AS (SELECT coalesce(sum(n - 1), 0) AS dup FROM (SELECT count(*) AS n FROM {src} GROUP BY {", ".join(cols)}))
SELECT n_rows, {len(cols)} AS n_cols, CAST(n_rows * {width} + coalesce(v, 0) AS BIGINT) AS size_bytes,
  {R(f"(n_rows * {width} + coalesce(v, 0)) / (1024.0 * 1024.0)")} AS memory_mb, CAST(dup AS BIGINT) AS duplicate_rows
FROM b, d
"""


DIRTY_COLS = ["l_orderkey", "l_linenumber", "quantity", "returnflag", "part_text", "supp_text", "empty_col"]


@register("p1_dataset_info_dirty", info_sql(DIRTY, DIRTY_COLS, 8 + 4 + 8, ["returnflag", "part_text", "supp_text", "empty_col"]))
def q_p1_dirty(spark, sf):
    """Rows, columns, size estimate, whole-row duplicates."""
    return P.dataset_info(dirty(spark, sf))


@register("p1_dataset_info_customer", info_sql("customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
                                               8 + 4 + 8, ["c_name", "c_mktsegment"]))
def q_p1_customer(spark, sf):
    """P1 on customer."""
    return P.dataset_info(T_(spark, sf, "customer"))


def missing_sql(src: str, cols: list[str], decimals: int | None) -> str:
    parts = " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS \"column\", count(*) - count({c}) AS missing, count(*) AS rows_ FROM {src}"
        for i, c in enumerate(cols))
    pct = "missing * 100.0 / rows_"
    if decimals is not None:
        pct = f"round({pct}, {decimals})"
    return f"SELECT position, \"column\", missing, {R(pct)} AS missing_pct FROM ({parts})"


@register("p3_missing_table_dirty", missing_sql(DIRTY, DIRTY_COLS, 2))
def q_p3(spark, sf):
    """Missing count and % per column, largest first."""
    return P.missing_table(dirty(spark, sf))


@register("p2_missing_summary_dirty", f"""
WITH m AS ({missing_sql(DIRTY, DIRTY_COLS, None)}), n AS (SELECT count(*) AS n_rows FROM {DIRTY})
SELECT n_rows, {len(DIRTY_COLS)} AS n_cols, n_rows * {len(DIRTY_COLS)} AS cells, CAST(sum(missing) AS BIGINT) AS total_missing,
  {R(f"sum(missing) * 100.0 / (n_rows * {len(DIRTY_COLS)})")} AS missing_pct FROM m, n GROUP BY n_rows
""")
def q_p2(spark, sf):
    """Total missing cells and their share of all cells."""
    return P.missing_summary(dirty(spark, sf))


def top_sql(src: str, cols: list[str], k: int | None, decimals: int | None = 2) -> str:
    pct = "n * 100.0 / rows_"
    if decimals is not None:
        pct = f"round({pct}, {decimals})"
    keep = f"WHERE rank <= {k}" if k is not None else ""
    return f"""
WITH long AS ({long(src, cols, "VARCHAR")}),
vc AS (SELECT "column", value, count(*) AS n FROM long WHERE value IS NOT NULL GROUP BY "column", value),
rk AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value ASC) AS rank FROM vc),
t AS (SELECT count(*) AS rows_ FROM {src})
SELECT "column", CAST(rank AS INTEGER) AS rank, value, n, {R(pct)} AS pct FROM rk, t {keep}
"""


@register("p9_top_values_orders", top_sql("orders", ["o_orderstatus", "o_orderpriority"], 3))
def q_p9(spark, sf):
    """Top 3 values per text column with % of all rows."""
    return P.top_values(T_(spark, sf, "orders"), None, 3)


@register("d4_category_share_part", top_sql("part", ["p_brand", "p_type"], 10))
def q_d4(spark, sf):
    """Top-10 value counts (pie and bar chart data)."""
    return P.top_values(T_(spark, sf, "part"), ["p_brand", "p_type"], 10)


@register("p8_categorical_profile_customer", f"""
WITH t AS ({top_sql("customer", ["c_name", "c_mktsegment"], 5)}),
u AS (SELECT "column", count(DISTINCT value) AS unique_count FROM ({long("customer", ["c_name", "c_mktsegment"], "VARCHAR")}) GROUP BY "column"),
f AS (SELECT "column", value AS most_frequent, n AS most_frequent_count FROM t WHERE rank = 1)
SELECT t."column", u.unique_count, f.most_frequent, f.most_frequent_count, t.rank, t.value, t.n, t.pct
FROM t JOIN u USING ("column") JOIN f USING ("column")
""")
def q_p8(spark, sf):
    """Unique count, most frequent and top 5 with % per text column."""
    return P.categorical_profile(T_(spark, sf, "customer"))


@register("u3_univariate_categorical_orders", f"""
WITH long AS ({long("orders", ["o_orderstatus", "o_orderpriority"], "VARCHAR")}),
vc AS (SELECT "column", value, count(*) AS n FROM long WHERE value IS NOT NULL GROUP BY "column", value),
rk AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS r FROM vc),
b AS (SELECT "column", count(value) AS total_count, count(*) AS rows_ FROM long GROUP BY "column")
SELECT b."column", (SELECT count(*) FROM vc WHERE vc."column" = b."column") AS unique_count,
  rk.value AS most_frequent, rk.n AS most_frequent_count, rows_ - total_count AS missing_count,
  {R("(rows_ - total_count) * 100.0 / rows_")} AS missing_pct, total_count,
  CASE WHEN total_count = 0 THEN 'No valid categorical data' END AS error
FROM b LEFT JOIN rk ON rk."column" = b."column" AND rk.r = 1
""")
def q_u3(spark, sf):
    """Summary of every text column."""
    return P.univariate_categorical(T_(spark, sf, "orders"))


@register("u3_frequency_table_dirty", f"""
SELECT "column", rank, value, n FROM ({top_sql(DIRTY, ["returnflag", "part_text", "supp_text", "empty_col"], 10, None)})
""")
def q_u3_freq(spark, sf):
    """The 10 most frequent non-null values per text column (nulls dropped)."""
    return P.frequency_table(dirty(spark, sf), ["returnflag", "part_text", "supp_text", "empty_col"], 10)
