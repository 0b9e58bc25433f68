"""Registered queries: validation and cleaning on the dirty view (and plain tables)."""

from __future__ import annotations

from tablelens.operators import checks as V
from tablelens.operators import clean as C
from tablelens.plans.registry import T_, dirty, register
from tablelens.plans.sqlgen import DIRTY_SQL, R, to_number

D = f"({DIRTY_SQL})"


def validate_sql(src: str, cols: list[str], texts: list[str]) -> str:
    nn = ", ".join(f"count({c}) AS nn_{c}" for c in cols)
    nd = ", ".join(f"count(DISTINCT {c}) AS nd_{c}" for c in texts)
    empties = " UNION ALL ".join(f"SELECT {i} AS pos, '{c}' AS c FROM s WHERE nn_{c} = 0" for i, c in enumerate(cols))
    card = " UNION ALL ".join(
        f"SELECT 'high_cardinality' AS \"check\", '{c}' AS \"column\", CAST(nd_{c} AS DOUBLE) AS value, "
        f"'Column ''{c}'' has very high cardinality (unique ≈ rows).' AS message FROM s WHERE nd_{c} >= 0.9 * rows_"
        for c in texts)
    return f"""
WITH s AS (SELECT count(*) AS rows_, {nn}{', ' + nd if nd else ''} FROM {src}),
dup AS (SELECT coalesce(sum(n - 1), 0) AS d FROM (SELECT count(*) AS n FROM {src} GROUP BY ALL)),
e AS ({empties})
SELECT 'min_rows' AS "check", CAST(NULL AS VARCHAR) AS "column", CAST(rows_ AS DOUBLE) AS value,
  'Too few rows: ' || rows_ || ' rows (less than 10).' AS message FROM s WHERE rows_ < 10
UNION ALL SELECT 'min_cols', NULL, {len(cols)}.0, 'Too few columns: {len(cols)} columns (need at least 2).' WHERE {len(cols)} < 2
UNION ALL SELECT 'all_null', NULL, CAST(count(*) AS DOUBLE),
  'Columns with all nulls: [' || string_agg('''' || c || '''', ', ' ORDER BY pos) || ']' FROM e HAVING count(*) > 0
UNION ALL SELECT 'duplicates', NULL, CAST(d AS DOUBLE), 'Found ' || d || ' duplicate rows.' FROM dup WHERE d > 0
{('UNION ALL ' + card) if card else ''}
"""


DIRTY_COLS = ["l_orderkey", "l_linenumber", "quantity", "returnflag", "part_text", "supp_text", "empty_col"]
DIRTY_TEXT = ["returnflag", "part_text", "supp_text", "empty_col"]


def _src_dups(src: str, cols: list[str]) -> str:
    return src.replace("GROUP BY ALL", "GROUP BY " + ", ".join(cols))


@register("v6_validate_dirty", validate_sql(D, DIRTY_COLS, DIRTY_TEXT).replace(
    "GROUP BY ALL", "GROUP BY " + ", ".join(DIRTY_COLS)))
def q_v_dirty(spark, sf):
    """V1–V6: all-null column and duplicate rows found as issue rows."""
    return V.validate(dirty(spark, sf))


CUST = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@register("v5_validate_customer", validate_sql("customer", CUST, ["c_name", "c_mktsegment"]).replace(
    "GROUP BY ALL", "GROUP BY " + ", ".join(CUST)))
def q_v_customer(spark, sf):
    """V5: a fully distinct text column is flagged."""
    return V.validate(T_(spark, sf, "customer"))


DOCS = ["doc_id", "text", "lang", "source", "n_chars"]


@register("v5_validate_documents", validate_sql("documents", DOCS, ["text", "lang", "source"]).replace(
    "GROUP BY ALL", "GROUP BY " + ", ".join(DOCS)))
def q_v_docs(spark, sf):
    """V1–V5 over whole document texts (near-distinct text column)."""
    return V.validate(T_(spark, sf, "documents"))


def mode_sql(c: str) -> str:
    return (f"(SELECT v FROM (SELECT {c} AS v, count(*) AS n FROM d WHERE {c} IS NOT NULL GROUP BY 1) "
            f"ORDER BY n DESC, v LIMIT 1)")


CLEAN_BASE = f"""
WITH d AS {D},
fv AS (SELECT quantile_cont(CAST(l_orderkey AS DOUBLE), 0.5) AS m_o, quantile_cont(CAST(l_linenumber AS DOUBLE), 0.5) AS m_l,
              quantile_cont(quantity, 0.5) AS m_q,
              {mode_sql('returnflag')} AS m_rf, {mode_sql('part_text')} AS m_pt, {mode_sql('supp_text')} AS m_st,
              {mode_sql('empty_col')} AS m_ec FROM d),
f AS (SELECT coalesce(CAST(l_orderkey AS DOUBLE), m_o) AS l_orderkey, coalesce(CAST(l_linenumber AS DOUBLE), m_l) AS l_linenumber,
             coalesce(quantity, m_q) AS quantity, coalesce(returnflag, m_rf, 'Unknown') AS returnflag,
             coalesce(part_text, m_pt, 'Unknown') AS part_text, coalesce(supp_text, m_st, 'Unknown') AS supp_text,
             coalesce(empty_col, m_ec, 'Unknown') AS empty_col FROM d, fv),
u AS (SELECT DISTINCT * FROM f),
q AS (SELECT quantile_cont(l_orderkey, 0.25) AS a1, quantile_cont(l_orderkey, 0.75) AS a3,
             quantile_cont(l_linenumber, 0.25) AS b1, quantile_cont(l_linenumber, 0.75) AS b3,
             quantile_cont(quantity, 0.25) AS c1, quantile_cont(quantity, 0.75) AS c3 FROM u),
b AS (SELECT a1 - 1.5 * (a3 - a1) AS alo, a3 + 1.5 * (a3 - a1) AS ahi, b1 - 1.5 * (b3 - b1) AS blo,
             b3 + 1.5 * (b3 - b1) AS bhi, c1 - 1.5 * (c3 - c1) AS clo, c3 + 1.5 * (c3 - c1) AS chi FROM q)
"""


def _clip(c, lo, hi):
    return f"CASE WHEN {c} < {lo} THEN {lo} WHEN {c} > {hi} THEN {hi} ELSE {c} END"


@register("c7_clean_dirty", CLEAN_BASE + f"""
SELECT CAST({_clip('l_orderkey', 'alo', 'ahi')} AS BIGINT) AS l_orderkey, CAST({_clip('l_linenumber', 'blo', 'bhi')} AS INTEGER) AS l_linenumber,
  {R(_clip('quantity', 'clo', 'chi'))} AS quantity, returnflag, part_text, {R(to_number('supp_text'))} AS supp_text, empty_col
FROM u, b
""")
def q_c7(spark, sf):
    """Fill (mode/median/'Unknown') → dedupe → cap → convert; the cleaned table itself (columns without outliers keep their type)."""
    return C.clean(dirty(spark, sf)).table


@register("c6_cleaning_audit_dirty", CLEAN_BASE + f"""
, miss AS (SELECT count(*) - count(l_orderkey) AS mo, count(*) - count(l_linenumber) AS ml, count(*) - count(quantity) AS mq,
                  count(*) - count(returnflag) AS mr, count(*) - count(part_text) AS mp, count(*) - count(supp_text) AS ms,
                  count(*) - count(empty_col) AS me FROM d)
SELECT 'missing' AS stage, 'l_orderkey' AS "column", 'Filled with median: ' || printf('%.2f', m_o) AS detail, mo AS n FROM fv, miss
UNION ALL SELECT 'missing', 'l_linenumber', 'Filled with median: ' || printf('%.2f', m_l), ml FROM fv, miss
UNION ALL SELECT 'missing', 'quantity', 'Filled with median: ' || printf('%.2f', m_q), mq FROM fv, miss
UNION ALL SELECT 'missing', 'returnflag', CASE WHEN m_rf IS NULL THEN 'Filled with ''Unknown''' ELSE 'Filled with mode: ' || m_rf END, mr FROM fv, miss
UNION ALL SELECT 'missing', 'part_text', CASE WHEN m_pt IS NULL THEN 'Filled with ''Unknown''' ELSE 'Filled with mode: ' || m_pt END, mp FROM fv, miss
UNION ALL SELECT 'missing', 'supp_text', CASE WHEN m_st IS NULL THEN 'Filled with ''Unknown''' ELSE 'Filled with mode: ' || m_st END, ms FROM fv, miss
UNION ALL SELECT 'missing', 'empty_col', CASE WHEN m_ec IS NULL THEN 'Filled with ''Unknown''' ELSE 'Filled with mode: ' || m_ec END, me FROM fv, miss
UNION ALL SELECT 'duplicates', NULL, 'Removed duplicate rows', (SELECT count(*) FROM f) - (SELECT count(*) FROM u)
UNION ALL SELECT 'outliers', x, 'Capped ' || k || ' outliers', k FROM (
  SELECT 'l_orderkey' AS x, count(*) FILTER (WHERE l_orderkey < alo OR l_orderkey > ahi) AS k FROM u, b
  UNION ALL SELECT 'l_linenumber', count(*) FILTER (WHERE l_linenumber < blo OR l_linenumber > bhi) FROM u, b
  UNION ALL SELECT 'quantity', count(*) FILTER (WHERE quantity < clo OR quantity > chi) FROM u, b) WHERE k > 0
UNION ALL SELECT 'conversion', 'returnflag', 'Kept as categorical', NULL
UNION ALL SELECT 'conversion', 'part_text', 'Kept as categorical', NULL
UNION ALL SELECT 'conversion', 'supp_text', 'Converted to numeric', NULL
UNION ALL SELECT 'conversion', 'empty_col', 'Kept as categorical', NULL
""")
def q_c6(spark, sf):
    """The cleaning audit — strategy per column, duplicates removed, values capped, conversions."""
    return C.clean(dirty(spark, sf)).audit
