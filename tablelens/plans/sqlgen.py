"""DuckDB SQL fragments for the oracle side.

Tail probabilities here use closed-form finite series (t with any integer
dof, chi-square with any integer dof, F when one dof is even), an independent
route from the continued fractions used on the Spark side.
"""

from __future__ import annotations

from tablelens.sources.tables import DIRTY_SQL

DIRTY = f"({DIRTY_SQL}) AS dirty"
NUMBER_RE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def R(expr: str, k: int = 6) -> str:
    return f"(round(({expr}), {k}) + 0.0)"


def to_number(s: str) -> str:
    return f"(CASE WHEN regexp_full_match({s}, '{NUMBER_RE}') THEN TRY_CAST(trim({s}) AS DOUBLE) END)"


def long(src: str, cols: list[str], cast: str = "DOUBLE", exprs: dict[str, str] | None = None) -> str:
    exprs = exprs or {}
    parts = [f"SELECT '{c}' AS \"column\", CAST({exprs.get(c, c)} AS {cast}) AS value FROM {src}" for c in cols]
    return " UNION ALL ".join(parts)


def p_corr_cte(name: str, src: str, r: str = "r", n: str = "n") -> str:
    """CTE ``name`` with columns of ``src`` plus ``p_value`` for correlation r on n pairs."""
    return f"""
{name}_e AS (
  SELECT s.*, t.j FROM {src} s,
    range(0, CAST(CASE WHEN s.{n} >= 3 AND abs(s.{r}) < 1 THEN
                       CASE WHEN (s.{n} - 2) % 2 = 0 THEN (s.{n} - 2) // 2 ELSE (s.{n} - 3) // 2 END
                  ELSE 0 END AS BIGINT)) t(j)),
{name}_s AS (
  SELECT {n} AS _n, {r} AS _r,
    sum(CASE WHEN ({n} - 2) % 2 = 0
             THEN exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1) + j * ln(1 - {r} * {r}))
             ELSE exp(lgamma(j + 1) + lgamma(0.5) - ln(2) - lgamma(j + 1.5) + (2 * j + 1) * 0.5 * ln(1 - {r} * {r}))
        END) AS acc
  FROM {name}_e GROUP BY {n}, {r}),
{name} AS (
  SELECT s.*, CASE WHEN s.{n} < 3 OR s.{r} IS NULL THEN NULL
                   WHEN abs(s.{r}) >= 1 THEN 0.0
                   WHEN (s.{n} - 2) % 2 = 0 THEN greatest(0.0, 1 - abs(s.{r}) * coalesce(x.acc, 0))
                   ELSE greatest(0.0, 1 - 2 / pi() * (asin(abs(s.{r})) + abs(s.{r}) * coalesce(x.acc, 0))) END AS p_value
  FROM {src} s LEFT JOIN {name}_s x ON x._n = s.{n} AND x._r = s.{r})"""


def p_chi2_expr(x: str, dof: str) -> str:
    """Scalar subquery: upper tail of chi-square(dof) at x, integer dof.

    Even dof: the finite Poisson sum. Odd dof: 1 - P(dof/2, x/2) with the
    all-positive series P(a, z) = sum_k exp((a+k) ln z - z - lnGamma(a+k+1)),
    summed far enough past its peak at k ~ z."""
    even = f"exp(-({x}) / 2) * (SELECT sum(exp(i * ln(({x}) / 2) - lgamma(i + 1))) FROM range(0, CAST({dof} // 2 AS BIGINT)) t(i))"
    z, a = f"(({x}) / 2.0)", f"(({dof}) / 2.0)"
    lower = (f"(SELECT sum(exp(({a} + k) * ln({z}) - {z} - lgamma({a} + k + 1))) "
             f"FROM range(0, CAST(greatest(200, {z} + 20 * sqrt({z}) + 100) AS BIGINT)) t(k))")
    odd = f"greatest(0.0, 1 - {lower})"
    return (f"(CASE WHEN {x} IS NULL THEN NULL WHEN {dof} <= 0 THEN 1.0 WHEN {x} <= 0 THEN 1.0 "
            f"WHEN {dof} % 2 = 0 THEN {even} ELSE {odd} END)")


def p_f_expr(f: str, d1: str, d2: str) -> str:
    """Scalar subquery: upper tail of F(d1, d2) at f when d1 or d2 is even."""
    x = f"(({d2}) / (({d2}) + ({d1}) * ({f})))"
    # I_x(a, b) with integer b = d1/2: x^a * sum_{j<b} Gamma(a+j)/(Gamma(a) j!) (1-x)^j
    a, b = f"(({d2}) / 2.0)", f"(({d1}) / 2.0)"
    ev1 = (f"(SELECT sum(exp({a} * ln({x}) + lgamma({a} + j) - lgamma({a}) - lgamma(j + 1) + j * ln(1 - {x}))) "
           f"FROM range(0, CAST({d1} // 2 AS BIGINT)) t(j))")
    # d2 even: I_x(a, b) = 1 - I_{1-x}(b, a) with integer a
    ev2 = (f"(1 - (SELECT sum(exp({b} * ln(1 - {x}) + lgamma({b} + j) - lgamma({b}) - lgamma(j + 1) + j * ln({x}))) "
           f"FROM range(0, CAST({d2} // 2 AS BIGINT)) t(j)))")
    return (f"(CASE WHEN {f} IS NULL THEN NULL WHEN {f} <= 0 THEN 1.0 WHEN {d1} % 2 = 0 THEN {ev1} "
            f"WHEN {d2} % 2 = 0 THEN {ev2} END)")
