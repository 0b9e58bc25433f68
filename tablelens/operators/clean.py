"""Cleaning (C1–C7): fill → dedupe → cap → convert, in that order.

* Fill values (mode per text column, median per numeric column) and the
  capping fences are computed by the distributed operators and applied as
  literals, so the cleaned table is a lazy projection.
* Modes come from frequent-items summaries with an exact second count, medians
  and quartiles from sketches with exact brackets: no column is shuffled whole.
* Capping touches only columns with values outside their fences; the audit
  lists them. All other columns keep their type to the end.
* Type conversion changes the schema, so its decision is the one small result
  fetched to the driver (one row per text column). A date column has one
  reading, which reads all of its values.
* Columns keep their type through filling and dedupe, so no two different rows
  become equal. Booleans are neither filled nor capped. Null dates and
  timestamps take the column's exact lower median.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions.frames import materialize, per_column
from tablelens.functions.frequent import top_counts
from tablelens.functions.selection import OrderStatistics, order_statistics, ordinal
from tablelens.functions.stats import at, num
from tablelens.operators import kinds as K
from tablelens.operators import texts as X
from tablelens.operators.profile import order_values

UNKNOWN = "Unknown"


@dataclass
class Cleaned:
    table: DataFrame
    audit: DataFrame


def fill_values(df: DataFrame) -> DataFrame:
    """(column, kind, fill, fill_text, missing): mode for text columns (ties →
    smallest value; no value → 'Unknown'), median for numeric columns."""
    spark = df.sparkSession
    texts = K.categorical_columns(df)
    nums = _numbers(df)
    parts = []
    if texts:
        mode = top_counts(df, texts, 1).select("column", "value")
        allc = spark.createDataFrame([(c,) for c in texts], "column string")
        t = allc.join(mode, "column", "left").select(
            "column", F.lit("categorical").alias("kind"), F.lit(None).cast("double").alias("fill"),
            F.coalesce("value", F.lit(UNKNOWN)).alias("fill_text"),
            F.when(F.col("value").isNull(), F.lit(X.FILL_UNKNOWN))
            .otherwise(F.format_string(X.printf(X.FILL_MODE), F.col("value"))).alias("detail"))
        parts.append(t)
    if nums:
        rows = []
        for c, o in order_values(df, nums, (0.5,)).items():
            m = o.linear(0.5)
            rows.append((c, "numeric", m, None, X.FILL_MEDIAN.format(value=m if m is not None else float("nan"))))
        parts.append(spark.createDataFrame(rows, "column string, kind string, fill double, fill_text string, detail string"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def drop_duplicates(df: DataFrame, rows_hint: int | None = None) -> DataFrame:
    """Whole-row dedupe (nulls compare equal), exact.

    Rows are hashed (96 bits); only hashes that repeat can belong to
    duplicates. When that candidate set is small enough to broadcast
    (checked), rows with a unique hash pass through an anti-join without any
    shuffle and only the candidate rows go through ``dropDuplicates``;
    otherwise the plain ``dropDuplicates`` shuffles every row — as it also
    does for a small input (``rows_hint`` at most ``SMALL_LIMIT`` rows)."""
    from tablelens.functions.quantiles import SMALL_LIMIT
    from tablelens.operators.profile import BROADCAST_HASHES
    if not df.columns:
        return df
    if rows_hint is not None and rows_hint <= SMALL_LIMIT:
        return df.dropDuplicates()
    cols = [at(c) for c in df.columns]
    hashed = df.select("*", F.xxhash64(*cols).alias("_tl_h1"), F.hash(*cols).alias("_tl_h2"))
    cand = materialize(hashed.groupBy("_tl_h1", "_tl_h2").agg(F.count(F.lit(1)).alias("_tl_n"))
                       .where(F.col("_tl_n") > 1).select("_tl_h1", "_tl_h2"), "repeated-hashes")   # hashed once
    k = cand.count()
    if k == 0:
        return df
    if k > BROADCAST_HASHES:
        return df.dropDuplicates()
    side = F.broadcast(cand)
    single = hashed.join(side, ["_tl_h1", "_tl_h2"], "left_anti").drop("_tl_h1", "_tl_h2")
    repeated = hashed.join(side, ["_tl_h1", "_tl_h2"], "left_semi").drop("_tl_h1", "_tl_h2").dropDuplicates()
    return single.unionByName(repeated)


def _lit(v, t="double"):
    return F.lit(v).cast(t)


def _numbers(df: DataFrame) -> list[str]:
    """Number columns that are not booleans (which no stage alters)."""
    return [c for c in K.numeric_columns(df) if not isinstance(df.schema[c].dataType, T.BooleanType)]


def _filled(c: str, dt: T.DataType, value):
    """A column with its nulls filled in its own type: whole numbers stay exact
    (their median has at most one decimal place, which a decimal holds), so
    rows that differ stay different for the dedupe that follows."""
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.coalesce(at(c), F.lit(value).cast(dt))
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return F.coalesce(num(c, dt), _lit(value))
    if value is None:
        return at(c)
    if isinstance(dt, T.DecimalType):
        wide = T.DecimalType(min(38, dt.precision + 4), min(dt.scale + 2, 37))
        return F.coalesce(at(c).cast(wide), F.lit(str(value)).cast(wide))
    if value == int(value):
        return F.coalesce(at(c), F.lit(int(value)).cast(dt))
    return F.coalesce(at(c).cast("decimal(20,1)"), F.lit(str(value)).cast("decimal(20,1)"))


def fill_missing(df: DataFrame, fills: dict | None = None, keep_types: bool = False) -> DataFrame:
    """C1 + C2: one projection with the fill values as literals (``fills`` maps
    column → row of :func:`fill_values`; computed when not given; columns without
    one stay as they are). Numbers come out as double, or with ``keep_types`` exact in their own type."""
    fills = fills if fills is not None else per_column(fill_values(df).collect())
    texts, numbers = set(K.categorical_columns(df)), set(_numbers(df))
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = []
    for c in df.columns:
        if c in texts and c in fills:
            cols.append(F.coalesce(at(c), _lit(fills[c]["fill_text"], "string")).alias(c))
        elif c in fills and not keep_types and c in numbers:
            cols.append(F.coalesce(num(c, types[c]), _lit(fills[c]["fill"])).alias(c))
        elif c in fills:
            cols.append(_filled(c, types[c], fills[c]["fill"]).alias(c))
        else:
            cols.append(at(c))
    return df.select(*cols)


@dataclass(frozen=True)
class Fence:
    """Fences of a column: as doubles, and exactly (for types that are not doubles);
    ``capped`` values lie outside, ``wide`` ones are beyond what doubles tell apart."""
    lower: float
    upper: float
    exact: tuple[Decimal, Decimal] | None
    capped: int
    wide: bool


def fences_of(df: DataFrame, nums: list[str], k: float = 1.5) -> dict[str, Fence]:
    """Tukey fences and the values outside them, per numeric column with a
    value: two scans, one small shuffle (see ``order_statistics``)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = {c: ordinal(at(c), types[c]) for c in nums}
    whole = [c for c in nums if cols[c].whole]
    ends = {f"{e}{i}": (f(cols[c].value), f) for i, c in enumerate(whole) for e, f in (("min", F.min), ("max", F.max))}
    found, row = order_statistics(df, cols, (0.25, 0.75), ends, fences=True, reach=k)
    out = {}
    for c, o in found.items():
        if not o.n:
            continue
        exact, wide = None, False
        if cols[c].whole:
            q1, q3 = o.exact(0.25), o.exact(0.75)
            reach = Decimal(str(k)) * (q3 - q1)
            exact = (q1 - reach, q3 + reach)
            i = whole.index(c)
            wide = max(-row[f"min{i}"], row[f"max{i}"]) > 2 ** 53
        out[c] = Fence(*o.fences(), exact, o.outliers, wide)
    return out


def _clipped(c: str, dt: T.DataType, f: Fence):
    """A column clipped to its fences. Doubles stay doubles; decimals, and whole
    numbers that a double cannot hold, take decimals with room for the exact
    fences; other whole numbers become doubles, as fences have fractions."""
    if f.exact is not None and (f.wide or isinstance(dt, T.DecimalType)):
        wide = T.DecimalType(min(38, dt.precision + 3), min(dt.scale + 3, 37)) if isinstance(dt, T.DecimalType) else T.DecimalType(23, 3)
        v, (lo, hi) = at(c).cast(wide), (F.lit(str(x)).cast(wide) for x in f.exact)
    else:
        v, lo, hi = num(c, dt), _lit(f.lower), _lit(f.upper)
    return F.when(v < lo, lo).when(v > hi, hi).otherwise(v)


def cap_outliers(df: DataFrame, fences: dict[str, Fence] | None = None, k: float = 1.5) -> tuple[DataFrame, DataFrame]:
    """C4: clip the numeric columns that have values outside their Tukey fences
    (as literals); every other column stays as it is, type and all. Also
    returns (column, capped), the values outside."""
    nums = _numbers(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    fences = fences if fences is not None else fences_of(df, nums, k)
    out = df.select(*[_clipped(c, types[c], fences[c]).alias(c) if c in fences and fences[c].capped else at(c) for c in df.columns])
    rows = [(c, fences[c].capped if c in fences else 0) for c in nums]
    return out, df.sparkSession.createDataFrame(rows, "column string, capped long")


def conversions(df: DataFrame, with_readings: bool = False) -> dict[str, str] | tuple[dict[str, str], dict[str, int | None]]:
    """C5/T5 decision per text column: every value a number → numeric, else
    every value a date → datetime, else kept (one row per column fetched).
    ``with_readings``: also the reading of each column, seen in the same pass."""
    texts = K.categorical_columns(df)
    seen = K.conversion_counts(df, texts).select("column", "numeric", "readings", "non_null").collect() if texts else []
    words = {r["column"]: K.conversion_word(r["numeric"], r["readings"], r["non_null"]) for r in seen}
    return (words, {r["column"]: K.first_reading(r["readings"]) for r in seen}) if with_readings else words


def _exact_median(o: OrderStatistics):
    """The median in a type that holds it: whole numbers and decimals exactly."""
    if not o.n:
        return None
    return o.exact(0.5) if isinstance(next(iter(o.at.values())), (int, Decimal)) else o.linear(0.5)


def _moment(value, dt: T.DataType):
    """A date or timestamp as text that casts back to the column's type."""
    if value is None:
        return None
    return f"{value}+00:00" if isinstance(dt, T.TimestampType) else str(value)


def _fill_stats(df: DataFrame) -> tuple[dict, dict, int]:
    """Fill values, missing counts and the row count: one value-count shuffle
    for the text modes; exact medians of numbers and exact lower medians of
    dates and timestamps by sketch and bracket, with the counts riding along."""
    texts, nums = K.categorical_columns(df), _numbers(df)
    dates = K.datetime_columns(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    rides = {"rows": (F.count(F.lit(1)), F.sum)}
    for c in df.columns:
        rides[f"has {c}"] = (F.count(num(c, types[c]) if c in nums else at(c)), F.sum)
    orders, row = order_statistics(df, {c: ordinal(at(c), types[c]) for c in nums + dates}, (0.5,), rides)
    rows = int(row["rows"] or 0)
    missing = {c: rows - int(row[f"has {c}"] or 0) for c in df.columns}
    fills: dict[str, dict] = {}
    for c in nums:
        m = _exact_median(orders[c])
        fills[c] = {"kind": "numeric", "fill": m, "fill_text": None,
                    "detail": X.FILL_MEDIAN.format(value=m if m is not None else float("nan"))}
    for c in dates:
        m = _moment(orders[c].lower(0.5), types[c])
        fills[c] = {"kind": "datetime", "fill": m, "fill_text": None,
                    "detail": X.FILL_MEDIAN.replace("{value:.2f}", str(m) if m is not None else "nan")}
    if texts:
        modes = {r["column"]: r["value"] for r in top_counts(df, texts, 1).collect()}
        for c in texts:
            m = modes.get(c)
            fills[c] = {"kind": "categorical", "fill": None, "fill_text": m if m is not None else UNKNOWN,
                        "detail": X.FILL_MODE.format(value=m) if m is not None else X.FILL_UNKNOWN}
    return fills, missing, rows


def clean(df: DataFrame, fill: bool = True, dedupe: bool = True, cap: bool = True,
          convert: bool = True, materialize_dedupe: bool = True) -> Cleaned:
    """The whole pipeline with per-stage switches, plus the C6 audit as rows
    ``(stage, column, detail, n)``.

    Like a fitted imputer, each stage first computes its per-column statistics
    (fill values, fences, conversion decisions: one row per column), then
    applies them as literals. Passes over the data: the fill statistics (two
    scans for numbers, two for texts), the deduplication, written once to the
    shared checkpoint folder (the rows left and the conversion decisions are
    observed while it is written), and two scans of the written numbers for
    the fences and the values outside them."""
    spark = df.sparkSession
    audit_rows: list[tuple] = []
    out = df
    rows = None
    if fill:
        fv, miss, rows = _fill_stats(out)
        for c in out.columns:
            if c in fv:
                audit_rows.append(("missing", c, fv[c]["detail"], miss[c]))
        out = fill_missing(out, {c: f for c, f in fv.items() if miss[c]}, keep_types=True)
    texts = K.categorical_columns(out)
    conv_cols = texts if convert else []
    rules = K.conversion_exprs(conv_cols)
    wanted = [F.count(F.lit(1)).alias("rows"), *[e.alias(f"{n} {c}") for c, n, e in rules]]
    seen = None
    if dedupe:
        before = rows if rows is not None else out.count()
        out = drop_duplicates(out, rows_hint=before)
        if materialize_dedupe:
            watch = Observation("cleaning")
            out = materialize(out.observe(watch, *wanted), "deduped")
            seen = watch.get
    if seen is None and (conv_cols or dedupe):
        seen = out.agg(*wanted).first().asDict()
    if dedupe:
        audit_rows.append(("duplicates", None, X.DUPLICATES_REMOVED, before - int(seen["rows"])))
    nums = _numbers(out)
    if cap and nums:
        fences = fences_of(out, nums)
        for c in nums:
            if c in fences and fences[c].capped:
                audit_rows.append(("outliers", c, X.CAPPED.format(n=fences[c].capped), fences[c].capped))
        out, _ = cap_outliers(out, fences)
    if conv_cols:
        dec = {c: K.conversion_word(seen[f"numeric {c}"], seen[f"readings {c}"], seen[f"non_null {c}"]) for c in conv_cols}
        out = K.apply_conversions(out, dec, {c: K.first_reading(seen[f"readings {c}"]) for c in conv_cols})
        for c, d in dec.items():
            audit_rows.append(("conversion", c, d, None))
    audit = spark.createDataFrame(audit_rows, "stage string, column string, detail string, n long")
    return Cleaned(out, audit)
