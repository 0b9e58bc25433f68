"""Sources and sinks.

``read_table`` reads a CSV with a header the way a pandas user expects: the
usual null tokens become null, and each column becomes long, double, boolean
or string by its values. Spark's own ``inferSchema`` would need a second full
read and treats tokens differently; here the file is read once as text, one
aggregation decides every column's type, and ``try_cast`` applies it.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.functions.stats import CSV_NULL_TOKENS, NUMBER_PATTERN, at

INT_PATTERN = r"^\s*[+-]?\d+\s*$"
# Spellings of booleans recognised in text files.
BOOL_TOKENS = ["True", "False", "TRUE", "FALSE", "true", "false"]


def _decide(df: DataFrame) -> dict[str, str]:
    """Type per text column from one aggregation (one row fetched)."""
    checks = []
    for c in df.columns:
        v = at(c)
        checks += [F.count(v).alias(f"{c}__n"),
                   F.count(F.when(v.rlike(INT_PATTERN) & F.trim(v).try_cast("long").isNotNull(), 1)).alias(f"{c}__i"),
                   F.count(F.when(v.rlike(NUMBER_PATTERN), 1)).alias(f"{c}__d"),
                   F.count(F.when(v.isin(BOOL_TOKENS), 1)).alias(f"{c}__b")]
    r = df.agg(*checks).first()
    out = {}
    for c in df.columns:
        n = r[f"{c}__n"]
        if n == 0:
            out[c] = "string"
        elif r[f"{c}__i"] == n:
            out[c] = "long"
        elif r[f"{c}__d"] == n:
            out[c] = "double"
        elif r[f"{c}__b"] == n:
            out[c] = "boolean"
        else:
            out[c] = "string"
    return out


def _breaks_in_quotes(spark: SparkSession, path: str) -> bool:
    """A quoted field that goes on over a line break leaves an odd number of
    quotes on the line where it opens."""
    line = F.col("value")
    quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def read_table(spark: SparkSession, path: str, sep: str = ",", null_tokens=CSV_NULL_TOKENS,
               multi_line: bool | None = None, plain_names: bool = True) -> DataFrame:
    """CSV with a header → typed DataFrame; a doubled quote inside a quoted
    field is one quote, and a quoted field may hold line breaks. Whether any
    does is looked for first (``multi_line`` None): a file without them is
    split among tasks, one with them is read whole by one task, so a large
    source of that kind must be many files. Dots in column names become
    underscores, which spares callers the backticks (``plain_names=False``
    keeps the names; the operators take any).
    Raises ``ValueError`` when the file cannot be read."""
    try:
        if multi_line is None:
            multi_line = _breaks_in_quotes(spark, path)
        raw = spark.read.option("header", True).option("sep", sep).option("inferSchema", False) \
            .option("quote", '"').option("escape", '"').option("multiLine", multi_line).csv(path)
        cols = raw.columns
    except Exception as e:  # surfaced as the reference does
        raise ValueError(f"Error reading CSV: {e}") from e
    names: list[str] = []
    for c in cols:
        name = c.replace(".", "_") if plain_names else c
        while name in names or (name != c and name in cols):   # "a.b" beside "a_b"
            name += "_"
        names.append(name)
    text = raw.select(*[F.when(~at(c).isin(list(null_tokens)), at(c)).alias(n) for c, n in zip(cols, names)])
    cols = names
    types = _decide(text)

    def cast(c):
        t = types[c]
        v = at(c)
        if t == "string":
            return v.alias(c)
        if t == "boolean":
            return F.lower(v).isin("true").alias(c)
        return F.trim(v).try_cast(t).alias(c)

    return text.select(*[cast(c) for c in cols])


def read_named(spark: SparkSession, filename: str, base: str) -> DataFrame | None:
    """Read ``base/filename``; None when it cannot be read."""
    try:
        return read_table(spark, os.path.join(base, filename))
    except ValueError:
        return None


def preview(df: DataFrame, n: int = 10, order_by: list[str] | None = None) -> DataFrame:
    """S3: the first n rows (in ``order_by`` order when a fixed answer is needed)."""
    return (df.orderBy(*[at(c) for c in order_by]) if order_by else df).limit(n)


def sample_values(df: DataFrame, column: str, n: int = 5, order_by: list[str] | None = None) -> DataFrame:
    """The first n non-null values of a column."""
    v = df.where(at(column).isNotNull())
    if order_by:
        v = v.orderBy(*[at(c) for c in order_by])
    return v.select(at(column)).limit(n)


def write_results(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """Keep a result table (parquet, json or csv)."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w = w.option("header", True)
    w.format(fmt).save(path)
    return path
