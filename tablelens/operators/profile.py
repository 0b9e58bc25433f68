"""Whole-table profile and single-column analysis.

Every statistic for every column comes from one aggregation pass; value counts
for all text columns come from one unpivot and one ``groupBy`` (partial
aggregation collapses hot values map-side); top-k per column is a
``row_number() <= k`` filter, which Spark plans with a per-task group limit
before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions.frequent import top_counts
from tablelens.functions.frames import agg_by_column, numeric_long, per_column, rounded, string_long
from tablelens.functions.quantiles import SMALL_LIMIT, quantiles
from tablelens.functions.selection import Ordinal, OrderStatistics, order_statistics, ordinal
from tablelens.functions.stats import adjusted_kurtosis, adjusted_skewness, at, num, to_number
from tablelens.operators import kinds as K

_FIXED_WIDTH = {
    T.ByteType: 1, T.BooleanType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4,
    T.DateType: 4, T.LongType: 8, T.DoubleType: 8, T.TimestampType: 8, T.TimestampNTZType: 8,
    T.DecimalType: 16,
}


def _present(df: DataFrame, c: str):
    dt = df.schema[c].dataType
    return num(c, dt) if isinstance(dt, (T.FloatType, T.DoubleType)) else at(c)


def _round(c, decimals):
    return F.round(c, decimals) if decimals is not None else c


# ---------------------------------------------------------------- P1, P2, P3

#: candidate row hashes that may travel as a broadcast set (≈ 16 bytes each)
BROADCAST_HASHES = 4_000_000


def duplicate_rows(df: DataFrame, rows_hint: int | None = None) -> DataFrame:
    """Repeats of a whole row, first occurrence not counted (nulls equal).

    Exact, without shuffling whole rows: phase one shuffles only a 96-bit row
    hash (``xxhash64`` and ``hash`` of all columns, counted map-side); true
    duplicates always share a hash, so only rows whose hash repeats can be
    duplicates. Phase two counts those candidate rows exactly by their full
    values; they are picked by a broadcast semi-join when the candidate hash
    set is small (checked), else by a shuffle join. A small input
    (``rows_hint`` at most ``SMALL_LIMIT``) is grouped on its full rows
    directly. One row, one column."""
    spark = df.sparkSession
    if not df.columns:
        return spark.createDataFrame([(0,)], "duplicate_rows long")
    if rows_hint is not None and rows_hint <= SMALL_LIMIT:
        g = df.groupBy(*[at(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_tl_n"))
        dups = g.agg(F.coalesce(F.sum(F.col("_tl_n") - 1), F.lit(0))).first()[0]
        return spark.createDataFrame([(int(dups),)], "duplicate_rows long")
    cols = [at(c) for c in df.columns]
    hashed = df.select("*", F.xxhash64(*cols).alias("_tl_h1"), F.hash(*cols).alias("_tl_h2"))
    cand = (hashed.groupBy("_tl_h1", "_tl_h2").agg(F.count(F.lit(1)).alias("_tl_n"))
            .where(F.col("_tl_n") > 1).select("_tl_h1", "_tl_h2")).persist()
    try:
        k = cand.count()
        if k == 0:
            dups = 0
        else:
            side = F.broadcast(cand) if k <= BROADCAST_HASHES else cand
            subset = hashed.join(side, ["_tl_h1", "_tl_h2"], "left_semi").drop("_tl_h1", "_tl_h2")
            g = subset.groupBy(*[at(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_tl_n"))
            dups = g.agg(F.coalesce(F.sum(F.col("_tl_n") - 1), F.lit(0))).first()[0]
    finally:
        cand.unpersist()
    return spark.createDataFrame([(int(dups),)], "duplicate_rows long")


def dataset_info(df: DataFrame) -> DataFrame:
    """Rows, columns, duplicate rows and a size estimate in bytes / MB
    (fixed width per type plus the UTF-8 length of text)."""
    width = 0
    text = []
    for f in df.schema.fields:
        w = next((v for t, v in _FIXED_WIDTH.items() if isinstance(f.dataType, t)), None)
        if w is not None:
            width += w
        elif isinstance(f.dataType, T.StringType):
            text.append(F.coalesce(F.octet_length(at(f.name)), F.lit(0)))
    var = sum(text[1:], text[0]) if text else F.lit(0)
    b = df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(var).alias("_var")).first()
    rows = int(b["n_rows"])
    size = rows * width + int(b["_var"] or 0)
    dups = duplicate_rows(df, rows_hint=rows).first()[0]
    return df.sparkSession.createDataFrame(
        [(rows, len(df.columns), size, size / (1024.0 * 1024.0), int(dups))],
        "n_rows long, n_cols int, size_bytes long, memory_mb double, duplicate_rows long")


def missing_per_column(df: DataFrame) -> DataFrame:
    """(position, column, missing, missing_pct) with pct of rows; NaN counts as missing."""
    stats = agg_by_column(df, df.columns, [
        ("missing", lambda c: F.count(F.lit(1)) - F.count(_present(df, c))),
        ("rows", lambda c: F.count(F.lit(1))),
    ])
    pos = df.sparkSession.createDataFrame(list(enumerate(df.columns)), "position int, column string")
    return (stats.join(F.broadcast(pos), "column")
            .select("position", "column", F.col("missing").cast("long").alias("missing"),
                    F.try_divide(F.col("missing") * 100.0, F.col("rows")).alias("missing_pct")))


def missing_table(df: DataFrame, decimals: int | None = 2) -> DataFrame:
    """Missing count and % of rows, largest first (ties by column order)."""
    m = missing_per_column(df)
    return (m.select("position", "column", "missing", _round(F.col("missing_pct"), decimals).alias("missing_pct"))
            .orderBy(F.desc("missing_pct"), "position"))


def missing_summary(df: DataFrame) -> DataFrame:
    """One row — cells, total missing and its % of all cells."""
    m = missing_per_column(df)
    n = len(df.columns)
    rows = df.agg(F.count(F.lit(1)).alias("n_rows"))
    tot = m.agg(F.sum("missing").cast("long")).scalar()
    return rows.withColumn("total_missing", tot).select(
        "n_rows", F.lit(n).alias("n_cols"), (F.col("n_rows") * n).alias("cells"), "total_missing",
        F.try_divide(F.col("total_missing") * 100.0, F.col("n_rows") * n).alias("missing_pct"))


# ---------------------------------------------------------------- P4–P6, U1, U2

def moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, count, mean, std, min, max, skewness, kurtosis) — one pass."""
    return agg_by_column(df, cols, [
        ("count", lambda c: F.count(at(c))),
        ("mean", lambda c: F.avg(at(c))),
        ("std", lambda c: F.stddev_samp(at(c))),
        ("min", lambda c: F.min(at(c))),
        ("max", lambda c: F.max(at(c))),
        ("skewness", lambda c: adjusted_skewness(at(c))),
        ("kurtosis", lambda c: adjusted_kurtosis(at(c))),
    ])


def order_values(df: DataFrame, cols: Sequence[str], probs: Sequence[float] = (0.25, 0.5, 0.75)) -> dict[str, OrderStatistics]:
    """The exact values around ``probs`` per column, by sketch and bracket."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return order_statistics(df, {c: ordinal(at(c), types[c]) for c in cols}, probs)[0]


def quartiles(df: DataFrame, cols: Sequence[str], method: str = "auto") -> DataFrame:
    """(column, q25, median, q75) exact; columns without a value have no row.
    ``auto`` selects by sketch and bracket and never shuffles a column; the
    other methods force a plan of :func:`quantiles`."""
    if method == "auto":
        rows = [(c, o.linear(0.25), o.linear(0.5), o.linear(0.75)) for c, o in order_values(df, cols).items() if o.n]
        return df.sparkSession.createDataFrame(rows, "column string, q25 double, median double, q75 double")
    q = quantiles(numeric_long(df, cols), ["column"], "value", (0.25, 0.5, 0.75), method=method)
    return q.select("column", F.col("quantiles")[0].alias("q25"), F.col("quantiles")[1].alias("median"),
                    F.col("quantiles")[2].alias("q75"))


def iqr_bounds(df: DataFrame, cols: Sequence[str], method: str = "auto", k: float = 1.5) -> DataFrame:
    """(column, q25, median, q75, iqr, lower, upper) — Tukey fences."""
    q = quartiles(df, cols, method)
    iqr = F.col("q75") - F.col("q25")
    return q.select("*", iqr.alias("iqr"), (F.col("q25") - k * iqr).alias("lower"),
                    (F.col("q75") + k * iqr).alias("upper"))


def fences(df: DataFrame, cols: Sequence[str], method: str = "auto", k: float = 1.5) -> dict:
    """Quartiles and Tukey fences per column, fetched (one row per column)."""
    return per_column(iqr_bounds(df, cols, method, k).collect())


def _lit(v):
    return F.lit(v).cast("double")


def outlier_counts(df: DataFrame, cols: Sequence[str], bounds: dict | None = None) -> DataFrame:
    """Values strictly outside the fences, per column (fences as literals)."""
    bounds = bounds if bounds is not None else fences(df, cols)
    return agg_by_column(df, cols, [("outliers", lambda c: _outside(c, bounds))])


def _outside(c: str, bounds: dict):
    b = bounds.get(c)
    if b is None or b["lower"] is None:
        return F.lit(0).cast("long")
    return F.count_if((at(c) < _lit(b["lower"])) | (at(c) > _lit(b["upper"])))


_SUMMARY_SCHEMA = ("column string, count long, mean double, median double, std double, min double, max double, "
                   "q25 double, q75 double, skewness double, kurtosis double, missing_count long, "
                   "missing_pct double, outliers long, unique_count long, error string")


def distinct_values(df: DataFrame, cols: dict[str, Ordinal]) -> dict[str, int]:
    """Exact distinct non-null values per column, each compared in its own type.
    Exactness needs every distinct value once: one shuffle of (column, value),
    combined before it."""
    names = list(cols)
    null = F.lit(None)
    structs = [F.struct(F.lit(i).alias("c"), (cols[c].value if cols[c].whole else null).cast("long").alias("whole"),
                        (null if cols[c].whole else cols[c].value).cast("double").alias("real")) for i, c in enumerate(names)]
    long = df.select(F.inline(F.array(*structs))).where(F.coalesce(F.col("whole").isNotNull() | F.col("real").isNotNull(), F.lit(False)))
    counts = {r["c"]: r["n"] for r in long.distinct().groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = {c: counts.get(i, 0) for i, c in enumerate(names)}
    wide = [f.name for f in df.schema.fields if f.name in out and isinstance(f.dataType, T.DecimalType) and not cols[f.name].whole]
    if wide:   # decimals that neither a long nor a double can tell apart
        out |= df.agg(*[F.count_distinct(at(c)).alias(c) for c in wide]).first().asDict()
    return out


def numeric_summary(df: DataFrame, cols: Sequence[str] | None = None, method: str = "auto",
                    rule: str | None = "majority_non_null", distinct: bool = True) -> DataFrame:
    """Every U1 statistic of many numeric columns, without shuffling a column
    for anything but the exact distinct count (``distinct=False`` leaves that
    out). Two scans: one for totals, nulls, extremes and quantile sketches, one
    that turns the sketches' brackets into exact quartiles and gives the
    central moments (shifted by the mean) and the values outside the fences.
    The answer has one row per column, assembled from those small results.

    With ``rule='majority_non_null'`` and no explicit columns, text columns
    join speculatively as numbers (non-numbers become null) and are kept when
    most of their non-null values convert. ``method`` other than ``auto``
    forces a plan of :func:`quantiles` for the quartiles."""
    spark = df.sparkSession
    types = {f.name: f.dataType for f in df.schema.fields}
    texts: list[str] = []
    if cols is None:
        cols = K.numeric_columns(df)
        if rule == "majority_non_null":
            texts = K.categorical_columns(df)
            cols = cols + texts
    cols = list(cols)
    if not cols:
        return spark.createDataFrame([], _SUMMARY_SCHEMA)
    values = {c: to_number(c) if isinstance(types[c], T.StringType) else num(c, types[c]) for c in cols}
    exact = {c: ordinal(values[c], T.DoubleType()) if isinstance(types[c], T.StringType) else ordinal(at(c), types[c]) for c in cols}
    if texts:   # text columns are looked through before their quartiles are searched
        numbers = _mostly_numbers(df, texts, values)
        cols = [c for c in cols if c not in texts or c in numbers]
    rides: dict = {"rows": (F.count(F.lit(1)), F.sum)}
    for i, c in enumerate(cols):
        rides |= {f"min{i}": (F.min(values[c]), F.min), f"max{i}": (F.max(values[c]), F.max)}
    exact = {c: exact[c] for c in cols}
    probs = (0.25, 0.5, 0.75)
    orders, a = order_statistics(df, exact, probs if method == "auto" else (), rides, summary=True, fences=method == "auto")
    total = int(a["rows"] or 0)
    if method == "auto":
        quart = {c: tuple(map(o.linear, probs)) for c, o in orders.items() if o.n}
    else:
        view = df.select(*[values[c].alias(c) for c in cols])
        quart = {r["column"]: (r["q25"], r["median"], r["q75"]) for r in quartiles(view, cols, method).collect()} if cols else {}
        _outliers_apart(df, values, orders, quart)
    keep, n = cols, {c: o.n for c, o in orders.items()}
    unique = distinct_values(df, exact) if distinct and keep else {}
    rows = []
    for c in keep:
        i, cnt, m = cols.index(c), n[c], orders[c].powers
        low, high = a[f"min{i}"], a[f"max{i}"]
        q1, q2, q3 = quart.get(c, (None, None, None))
        std = skew = kurt = None
        if m is not None and cnt >= 2:
            std = 0.0 if low == high else math.sqrt(max(m[0], 0.0) / (cnt - 1))
        if m is not None and cnt >= 3:
            m2, m3 = m[0] / cnt, m[1] / cnt
            skew = 0.0 if m2 <= 0 or low == high else math.sqrt(cnt * (cnt - 1)) / (cnt - 2) * m3 / m2 ** 1.5
        if m is not None and cnt >= 4:
            m2, m4 = m[0] / cnt, m[2] / cnt
            kurt = 0.0 if m2 <= 0 or low == high else (cnt - 1) / ((cnt - 2) * (cnt - 3)) * ((cnt + 1) * (m4 / (m2 * m2) - 3) + 6)
        missing = total - cnt
        rows.append((c, cnt, orders[c].mean, q2, std, low, high, q1, q3, skew, kurt, missing,
                     missing * 100.0 / total if total else None, orders[c].outliers,
                     unique.get(c, 0) if distinct else None, "No valid numeric data" if cnt == 0 else None))
    return spark.createDataFrame(rows, _SUMMARY_SCHEMA)


def _outliers_apart(df: DataFrame, values: dict, orders: dict, quart: dict) -> None:
    """Outliers by a scan of their own (forced quantile plans)."""
    outside = []
    for q1, _, q3 in quart.values():
        outside.append((_lit(q1 - 1.5 * (q3 - q1)), _lit(q3 + 1.5 * (q3 - q1))))
    counts = [F.count_if((values[c] < lo) | (values[c] > hi)) for c, (lo, hi) in zip(quart, outside)]
    for c, k in zip(quart, df.agg(F.array(*counts).alias("k")).first()["k"] if counts else []):
        orders[c].outliers = int(k)


def _mostly_numbers(df: DataFrame, texts: list[str], values: dict) -> list[str]:
    """Text columns whose non-null values are mostly numbers."""
    if not texts:
        return []
    pairs = [F.struct(F.count(values[c]).alias("n"), F.count(at(c)).alias("raw")) for c in texts]
    return [c for c, r in zip(texts, df.agg(F.array(*pairs).alias("s")).first()["s"]) if r["n"] > 0.5 * r["raw"]]


def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None, method: str = "auto",
                     rule: str | None = None, decimals: int | None = None) -> DataFrame:
    """Count, mean, std, min, q25, median, q75, max, skewness, kurtosis
    per numeric column (one scan; see :func:`numeric_summary`). ``decimals=3``
    gives the rounded display table."""
    return rounded(numeric_summary(df, cols, method, rule, distinct=False).select(
        "column", "count", "mean", "std", "min", "q25", "median", "q75", "max", "skewness", "kurtosis"), decimals)


def univariate_numeric(df: DataFrame, cols: Sequence[str] | None = None, method: str = "auto",
                       rule: str | None = "majority_non_null") -> DataFrame:
    """U1 (+U2) for many columns at once: one row per column with count, mean,
    median, std, min, max, q25, q75, skewness, kurtosis, missing count and % of
    rows, IQR outliers, distinct values; ``error`` when a column has no value."""
    return numeric_summary(df, cols, method, rule if cols is None else None)


# ---------------------------------------------------------------- P8, P9, U3

def value_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, value, n) for all text columns in one shuffle; null values dropped."""
    cols = list(cols) if cols is not None else K.categorical_columns(df)
    long = string_long(df, cols).where(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, cols: Sequence[str] | None = None, k: int | None = 5,
               decimals: int | None = 2, method: str = "summary") -> DataFrame:
    """Per column, the k most frequent values (count desc, value
    asc) with % of ALL rows (nulls in the denominator); k=None keeps every
    value. ``summary`` finds them without shuffling the values (see
    ``top_counts``; its small jobs run here); ``shuffle`` counts every value in
    one lazy plan."""
    cols = list(cols) if cols is not None else K.categorical_columns(df)
    rows = df.agg(F.count(F.lit(1))).scalar()  # a scalar subquery, computed once
    if k is not None and method == "summary":
        pct = _round(F.try_divide(F.col("n") * 100.0, rows), decimals)
        return top_counts(df, cols, k).select("column", "rank", "value", "n", pct.alias("pct"))
    vc = value_counts(df, cols)
    if k is not None:
        w = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
        vc = vc.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    out = vc.withColumn("pct", _round(F.try_divide(F.col("n") * 100.0, rows), decimals))
    sel = ["column"] + (["rank"] if k is not None else []) + ["value", "n", "pct"]
    return out.select(*sel)


def categorical_profile(df: DataFrame, cols: Sequence[str] | None = None, k: int = 5,
                        decimals: int | None = 2) -> DataFrame:
    """Unique count, most frequent value and count, and the top-k table per
    text column (one row per (column, rank))."""
    cols = list(cols) if cols is not None else K.categorical_columns(df)
    # asking for n here too keeps both branches on one exchange of the value counts
    uniq = value_counts(df, cols).groupBy("column").agg(F.count_if(F.col("n") > 0).alias("unique_count"))
    w = Window.partitionBy("column").orderBy("rank")   # over the k rows left of a column
    top = (top_values(df, cols, k, decimals, "shuffle").withColumn("most_frequent", F.first("value").over(w))
           .withColumn("most_frequent_count", F.first("n").over(w)))
    return (top.join(uniq, "column")
            .select("column", "unique_count", "most_frequent", "most_frequent_count", "rank", "value", "n", "pct"))


def univariate_categorical(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """U3 summary per text column: unique count, most frequent value and its
    count, missing count and % of rows, non-null total; ``error`` if no value."""
    cols = list(cols) if cols is not None else K.categorical_columns(df)
    counted = value_counts(df, cols).groupBy("column").agg(
        F.count(F.lit(1)).alias("unique_count"), F.sum("n").alias("values"),
        F.min(F.struct((-F.col("n")).alias("neg"), "value")).alias("top"))
    base = agg_by_column(df, cols, [("rows", lambda c: F.count(F.lit(1)))])   # reads no column
    out = base.join(counted, "column", "left").withColumn("total_count", F.coalesce("values", F.lit(0)))
    return out.select(
        "column", F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
        F.col("top.value").alias("most_frequent"), (-F.col("top.neg")).alias("most_frequent_count"),
        (F.col("rows") - F.col("total_count")).alias("missing_count"),
        F.try_divide((F.col("rows") - F.col("total_count")) * 100.0, F.col("rows")).alias("missing_pct"),
        "total_count", F.when(F.col("total_count") == 0, F.lit("No valid categorical data")).alias("error"))


def frequency_table(df: DataFrame, cols: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    """U3 table: the k most frequent non-null values per text column."""
    return top_values(df, cols, k, None).select("column", "rank", "value", "n")


def univariate(df: DataFrame, column: str, method: str = "auto") -> DataFrame:
    """U4: dispatch one column on its kind (text columns whose values are mostly
    numbers are analysed as numbers)."""
    if column not in df.columns:
        raise ValueError(f"Column '{column}' not found")
    dt = df.schema[column].dataType
    if K.kind_of(dt) == "numeric":
        return univariate_numeric(df, [column], method, rule=None)
    if isinstance(dt, T.StringType):
        _, is_num = K.resolve_numeric(df, column, "majority_non_null")
        if is_num:
            return univariate_numeric(df, [column], method, rule=None)
    return univariate_categorical(df.select(at(column).cast("string").alias(column)), [column])


# ---------------------------------------------------------------- P10

def dataset_stats(df: DataFrame, parts: Sequence[str] = ("info", "missing", "top_values", "correlation")) -> dict[str, DataFrame]:
    """P10: the bundle — info, missing per column, top 3 per text column,
    correlation pairs; only the asked ``parts`` are built (building one runs
    its small statistics jobs)."""
    from tablelens.operators.pairs import correlation_matrix
    build = {
        "info": lambda: dataset_info(df),
        "missing": lambda: missing_per_column(df),
        "top_values": lambda: top_values(df, None, 3),
        "correlation": lambda: correlation_matrix(df),
    }
    return {p: build[p]() for p in parts}
