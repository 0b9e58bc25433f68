"""Validation (V1–V6): issues as rows ``(check, column, value, message)``.

One aggregation pass gives what the asked checks need (the row count, the
non-null count of every column, a mergeable distinct-count sketch of every text
column); text columns that the sketch does not put five standard errors below
the threshold are counted exactly, on 96-bit hashes so that no text is
shuffled; one grouping on all columns gives the whole-row duplicates. A check of the schema alone reads no data. The issue
rows are projected from those two small results: the table is valid when the
result is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions.selection import two_levels
from tablelens.functions.stats import at, num
from tablelens.operators import kinds as K
from tablelens.operators import texts as X
from tablelens.operators.profile import duplicate_rows

# The thresholds of the checks.
MIN_ROWS = 10
MIN_COLS = 2
HIGH_CARDINALITY = 0.9


def _present(df, c):
    dt = df.schema[c].dataType
    return num(c, dt) if isinstance(dt, (T.FloatType, T.DoubleType)) else at(c)


#: size (log2) of the distinct-count sketches, and how many of their standard
#: errors an estimate must be away from the threshold to settle it
SKETCH_BITS = 14
ERRORS = 5


def table_counts(df: DataFrame, present: list[str] | None = None, texts: list[str] | None = None) -> dict:
    """rows, ``nn__{c}`` non-null per column (of ``present``, default all), and
    ``nd__{c}``, the estimate of a mergeable sketch, per text column (of ``texts``)."""
    present = df.columns if present is None else present
    texts = K.categorical_columns(df) if texts is None else texts
    parts = {"rows": (F.count(F.lit(1)), F.sum)}
    parts |= {f"nn__{c}": (F.count(_present(df, c)), F.sum) for c in present}
    for c in texts:
        parts[f"nd__{c}"] = (F.hll_sketch_agg(at(c).cast("string"), F.lit(SKETCH_BITS)),
                             lambda s: F.hll_sketch_estimate(F.hll_union_agg(at(s))))
    names = {f"p{i}": n for i, n in enumerate(parts)}
    row = two_levels(df, {p: parts[n] for p, n in names.items()})
    return {n: int(row[p] or 0) for p, n in names.items()}


def distinct_texts(df: DataFrame, cols: list[str]) -> dict[str, int]:
    """Exact distinct non-null values, counted on 96-bit hashes (no text is shuffled)."""
    pairs = [F.struct(F.lit(i).alias("c"), at(c).isNotNull().alias("seen"), F.xxhash64(at(c)).alias("h1"), F.hash(at(c)).alias("h2"))
             for i, c in enumerate(cols)]
    hashes = df.select(F.inline(F.array(*pairs))).where("seen").select("c", "h1", "h2").distinct()
    found = {r["c"]: r["n"] for r in hashes.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {c: found.get(i, 0) for i, c in enumerate(cols)}


ALL_CHECKS = ("min_rows", "min_cols", "all_null", "duplicates", "high_cardinality")


def validate(df: DataFrame, min_rows: int = MIN_ROWS, min_cols: int = MIN_COLS,
             high_cardinality: float = HIGH_CARDINALITY, approx: bool = False,
             checks: tuple[str, ...] = ALL_CHECKS) -> DataFrame:
    """V1–V6: one row per issue; no row means the table is valid. ``checks``
    picks a subset (V1 ``min_rows`` … V5 ``high_cardinality``)."""
    present = df.columns if "all_null" in checks else []
    texts = K.categorical_columns(df) if "high_cardinality" in checks else []
    ncols = len(df.columns)
    # the counts are one row: fetch it, then build the issues from that row
    counts = table_counts(df, present, texts) if set(checks) - {"min_cols"} else {"rows": 0}
    if not approx:      # only columns that may reach the threshold are counted exactly
        slack = 1 + ERRORS * 1.04 / 2 ** (SKETCH_BITS / 2)
        near = [c for c in texts if counts[f"nd__{c}"] * slack >= high_cardinality * counts["rows"]]
        counts |= {f"nd__{c}": n for c, n in (distinct_texts(df, near) if near else {}).items()}
    dups = duplicate_rows(df, rows_hint=counts["rows"]).first()[0] if "duplicates" in checks else 0
    stats = df.sparkSession.createDataFrame([(*counts.values(), int(dups))], [*counts, "duplicate_rows"])
    issue = "struct<check:string,column:string,value:double,message:string>"

    def mk(check, column, value, message, cond):
        return F.when(cond, F.struct(F.lit(check).alias("check"), F.lit(column).cast("string").alias("column"),
                                     value.cast("double").alias("value"), message.alias("message")))

    rows = F.col("rows")
    empty = [F.when(at(f"nn__{c}") == 0, F.lit(c)) for c in present]
    empty_list = F.filter(F.array(*empty), lambda x: x.isNotNull()) if empty else F.array().cast("array<string>")
    items = [
        mk("min_rows", None, rows,
           F.format_string(X.printf(X.ISSUE_MIN_ROWS), rows.cast("string"), F.lit(str(min_rows))), rows < min_rows),
        mk("min_cols", None, F.lit(ncols),
           F.lit(X.ISSUE_MIN_COLS.format(cols=ncols, limit=min_cols)), F.lit(ncols < min_cols)),
        mk("all_null", None, F.size(empty_list),
           F.format_string(X.printf(X.ISSUE_ALL_NULL),
                           F.array_join(F.transform(empty_list, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", ")),
           F.size(empty_list) > 0),
        mk("duplicates", None, F.col("duplicate_rows"),
           F.format_string(X.printf(X.ISSUE_DUPLICATES), F.col("duplicate_rows").cast("string")),
           F.col("duplicate_rows") > 0),
    ]
    for c in texts:
        items.append(mk("high_cardinality", c, at(f"nd__{c}"),
                        F.lit(X.ISSUE_CARDINALITY.format(column=c)),
                        at(f"nd__{c}") >= high_cardinality * rows))
    names = ["min_rows", "min_cols", "all_null", "duplicates"] + ["high_cardinality"] * len(texts)
    items = [i for i, nme in zip(items, names) if nme in checks]
    if not items:
        return df.sparkSession.createDataFrame([], "check string, column string, value double, message string")
    arr = F.filter(F.array(*[i.cast(issue) for i in items]), lambda x: x.isNotNull())
    return stats.select(F.inline(arr))


def check_min_rows(df: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """V1."""
    return validate(df, min_rows=min_rows, checks=("min_rows",))


def check_min_cols(df: DataFrame, min_cols: int = MIN_COLS) -> DataFrame:
    """V2."""
    return validate(df, min_cols=min_cols, checks=("min_cols",))


def check_all_null(df: DataFrame) -> DataFrame:
    """V3."""
    return validate(df, checks=("all_null",))


def check_duplicates(df: DataFrame) -> DataFrame:
    """V4."""
    return validate(df, checks=("duplicates",))


def check_cardinality(df: DataFrame, high_cardinality: float = HIGH_CARDINALITY, approx: bool = False) -> DataFrame:
    """V5."""
    return validate(df, high_cardinality=high_cardinality, approx=approx, checks=("high_cardinality",))


def is_valid(issues: DataFrame) -> bool:
    """V6 verdict (an action on the small issues table)."""
    return issues.isEmpty()
