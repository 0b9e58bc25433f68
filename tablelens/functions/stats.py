"""Column expressions shared by the operators.

Everything here builds a ``Column`` (JVM-side, inside whole-stage codegen);
nothing collects. Conventions:

* Float NaN counts as missing (pandas ``isna``), so every numeric input goes
  through :func:`num` first.
* Undefined statistics are null, never an error: division is ``try_divide``
  (ANSI mode is on by default in Spark 4).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType,
)

# Strings treated as missing before a numeric conversion (bivariate rule).
SENTINELS = ["?", "N/A", "n/a", "NA", "na", "", " "]

# Strings pandas' CSV reader reads as missing by default (the subset
# that matters for reading text tables; "?" and "-" stay values).
CSV_NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# A plain decimal number with optional sign and exponent; surrounding blanks allowed.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def at(c: str) -> Column:
    """The column of this very name: dots, spaces and backticks in it are part of the name."""
    return F.col("`" + c.replace("`", "``") + "`")


def col_(c: str | Column) -> Column:
    return at(c) if isinstance(c, str) else c


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES) or isinstance(dt, T.BooleanType)


def num(c: str | Column, dt: T.DataType | None = None) -> Column:
    """Numeric value as double; NaN becomes null."""
    c = col_(c)
    if dt is not None and isinstance(dt, T.BooleanType):
        return c.cast("int").cast("double")
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def to_number(c: str | Column) -> Column:
    """String → double when the whole text is a plain number, else null."""
    c = col_(c).cast("string")
    return F.when(c.rlike(NUMBER_PATTERN), F.trim(c).try_cast("double"))


def without_sentinels(c: str | Column) -> Column:
    c = col_(c)
    return F.when(~c.isin(SENTINELS), c)


def pearson(a: Column, b: Column) -> Column:
    """Pearson r over the rows where both are present; null when undefined
    (fewer than two rows, or a constant side)."""
    both = a.isNotNull() & b.isNotNull()
    den = F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b))
    r = F.try_divide(F.covar_pop(a, b), den)
    # clamp the last-ulp excursions beyond ±1
    return F.when(r > 1.0, F.lit(1.0)).when(r < -1.0, F.lit(-1.0)).otherwise(r)


def adjusted_skewness(c: Column) -> Column:
    """Bias-adjusted sample skewness G1 (pandas/DuckDB ``skew``); 0.0 for a
    constant column, null below three values."""
    n = F.count(c).cast("double")
    g1 = F.skewness(c)  # null exactly when the variance is zero (or no value)
    return F.when(n >= 3, F.coalesce(g1 * F.sqrt(n * (n - 1)) / (n - 2), F.lit(0.0)))


def adjusted_kurtosis(c: Column) -> Column:
    """Bias-adjusted excess kurtosis G2; 0.0 for a constant column, null below four values."""
    n = F.count(c).cast("double")
    g2 = F.kurtosis(c)  # null exactly when the variance is zero (or no value)
    return F.when(n >= 4, F.coalesce((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6), F.lit(0.0)))


def correlation_strength(r: Column) -> Column:
    """strong > 0.7, moderate > 0.3, else weak, on |r|."""
    a = F.abs(r)
    return F.when(a > 0.7, "strong").when(a > 0.3, "moderate").otherwise("weak")


def association_strength(p: Column) -> Column:
    """p < 0.001 strong, < 0.05 moderate, else weak."""
    return F.when(p < 0.001, "strong").when(p < 0.05, "moderate").otherwise("weak")


def r6(c: Column, k: int = 6) -> Column:
    """Round for stable comparison; ``+ 0.0`` turns -0.0 into 0.0."""
    return F.round(c, k) + F.lit(0.0)
