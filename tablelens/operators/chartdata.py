"""The numbers behind the charts (D1–D3, D10–D12, D14); drawing is not done.

Binning uses one explicit formula, ``least(k, floor(k * (v - min) / (max - min)) + 1)``,
so every engine puts an edge value in the same bin; empty bins come from a
``sequence`` over the (at most 50) bin numbers, never from the data.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions.frames import materialize, per_column
from tablelens.functions.quantiles import SMALL_LIMIT, quantiles
from tablelens.functions.stats import at, num, to_number
from tablelens.operators import kinds as K
from tablelens.operators.profile import quartiles

#: categories up to this count travel to the executors as a broadcast table
BROADCAST_GROUPS = 100_000


def _value(df: DataFrame, column: str, rule: str = "any_value"):
    """The column as double; a text column counts as numeric when at least one
    value converts (chart rule)."""
    if column not in df.columns:
        raise ValueError(f"Column '{column}' not found")
    dt = df.schema[column].dataType
    if K.kind_of(dt) == "numeric":
        return num(column, dt)
    if isinstance(dt, T.StringType):
        row = K.coercion_rules(df, [column]).first()
        if row[rule]:
            return to_number(column)
    raise ValueError(f"Column '{column}' is not numeric")


def bin_count(n: int, lo: int = 10, hi: int = 50) -> int:
    """sqrt(n) bins, clipped to [lo, hi]."""
    return min(hi, max(lo, int(math.sqrt(n))))


def _bin(v, mn: float, mx: float, k: int):
    if mx == mn:
        return F.lit(1).cast("long")
    return F.least(F.lit(k).cast("long"), F.floor(F.lit(float(k)) * (v - F.lit(mn)) / F.lit(mx - mn)).cast("long") + 1)


def histogram(df: DataFrame, column: str, bins: int | None = None) -> DataFrame:
    """(bin, lower, upper, count) with equal-width bins between min and max;
    ``bins`` defaults to sqrt(n) clipped to 10..50. Needs two values at least."""
    v = df.select(_value(df, column).alias("v")).where(F.col("v").isNotNull())
    s = v.agg(F.count("v").alias("n"), F.min("v").alias("mn"), F.max("v").alias("mx")).first()
    if s["n"] < 2:
        raise ValueError(f"Insufficient data points ({s['n']})")
    k = bins or bin_count(s["n"])
    mn, mx = float(s["mn"]), float(s["mx"])
    width = (mx - mn) / k
    counts = v.groupBy(_bin(F.col("v"), mn, mx, k).alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = v.sparkSession.range(1, k + 1).select(F.col("id").alias("bin"))
    return (grid.join(counts, "bin", "left")
            .select("bin", (F.lit(mn) + (F.col("bin") - 1) * F.lit(width)).alias("lower"),
                    (F.lit(mn) + F.col("bin") * F.lit(width)).alias("upper"),
                    F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def box_stats(df: DataFrame, cols: Sequence[str] | None = None, method: str = "auto") -> DataFrame:
    """Per column q1, median, q3, fences, whiskers (extreme values inside
    the fences), outlier count, min, max. Quartiles first, then one pass."""
    cols = list(cols) if cols is not None else K.numeric_columns(df)
    view = df.select(*[_value(df, c).alias(c) for c in cols])
    q = per_column(quartiles(view, cols, method).collect())
    structs = []
    for c in cols:
        r = q.get(c)
        q1, med, q3 = (r["q25"], r["median"], r["q75"]) if r else (None, None, None)
        lo = q1 - 1.5 * (q3 - q1) if r else None
        hi = q3 + 1.5 * (q3 - q1) if r else None
        x = at(c)
        inside = (x >= F.lit(lo)) & (x <= F.lit(hi))
        structs.append(F.struct(
            F.lit(c).alias("column"), F.lit(q1).cast("double").alias("q1"), F.lit(med).cast("double").alias("median"),
            F.lit(q3).cast("double").alias("q3"), F.lit(lo).cast("double").alias("lower_fence"),
            F.lit(hi).cast("double").alias("upper_fence"),
            F.min(F.when(inside, x)).alias("whisker_low"), F.max(F.when(inside, x)).alias("whisker_high"),
            F.count_if((x < F.lit(lo)) | (x > F.lit(hi))).alias("outliers"),
            F.min(x).alias("min"), F.max(x).alias("max"), F.count(x).alias("n")))
    return view.agg(F.array(*structs).alias("_s")).select(F.inline("_s"))


def _complete(df: DataFrame, x: str, y: str) -> DataFrame:
    v = df.select(_value(df, x).cast("double").alias("x"), _value(df, y).cast("double").alias("y"))
    return v.where(F.col("x").isNotNull() & F.col("y").isNotNull())


def scatter_bins(df: DataFrame, x: str, y: str, bins: int | None = None) -> DataFrame:
    """The points of a scatter plot as counts on an equal-width grid over
    the complete rows, ``(x_bin, y_bin, x_lower, y_lower, count)``; cells
    without points are left out. ``bins`` per axis as in :func:`histogram`. No
    complete row gives no cell; a constant axis has one bin."""
    v = _complete(df, x, y)
    s = v.agg(F.count(F.lit(1)), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if not s[0]:
        return df.sparkSession.createDataFrame([], "x_bin long, y_bin long, x_lower double, y_lower double, count long")
    k = bins or bin_count(s[0])
    cells = v.groupBy(_bin(F.col("x"), s[1], s[2], k).alias("x_bin"), _bin(F.col("y"), s[3], s[4], k).alias("y_bin")).agg(
        F.count(F.lit(1)).alias("count"))

    def lower(b: str, mn: float, mx: float):
        return F.lit(mn) + (F.col(b) - 1) * F.lit((mx - mn) / k)

    return cells.select("x_bin", "y_bin", lower("x_bin", s[1], s[2]).alias("x_lower"),
                        lower("y_bin", s[3], s[4]).alias("y_lower"), "count")


def bottom_rows(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """A sample of exactly ``n`` rows (all, if fewer): those with the smallest
    hash of their values. Each task keeps its ``n`` smallest and they are
    merged, so the sample is the same on every run, whatever the partitions;
    copies of a row share its hash and stand beside each other."""
    values = [at(c) for c in df.columns]
    texts = [F.coalesce(v.cast("string"), F.lit("")) for v in values]
    picked = df.select("*", F.xxhash64(F.lit(seed), *values).alias("_tl_h"), F.concat_ws("\x1f", *texts).alias("_tl_t"))
    return picked.orderBy("_tl_h", "_tl_t").limit(n).drop("_tl_h", "_tl_t")


def scatter_points(df: DataFrame, x: str, y: str, n: int = 1000, seed: int = 42) -> DataFrame:
    """At most ``n`` points of the scatter plot, a fixed-size sample of the complete rows."""
    return bottom_rows(_complete(df, x, y), n, seed)


def scatter_margins(df: DataFrame, x: str, y: str, bins: int | None = None) -> DataFrame:
    """The histograms at the sides of a scatter plot, over its complete
    rows: ``(axis, bin, lower, upper, count)``."""
    v = _complete(df, x, y)
    sides = [histogram(v, axis, bins).select(F.lit(axis).alias("axis"), "*") for axis in ("x", "y")]
    return sides[0].unionByName(sides[1])


def grouped_box(df: DataFrame, category: str, column: str, method: str = "auto") -> DataFrame:
    """Box statistics of a numeric column per category.

    The rows are first counted per ``(category, value)`` (partial aggregation:
    a category holding a third of the table becomes one row per distinct
    value); quartiles, whiskers and outlier counts all come from that table.
    The per-category fences join back by broadcast when there are at most
    ``BROADCAST_GROUPS`` categories (checked), otherwise by a shuffle join of
    the counted table."""
    v = df.select(at(category).cast("string").alias("category"), _value(df, column).alias("v")).where(
        F.col("category").isNotNull())
    # written once to the shared folder: read by the sizing job, the quartiles
    # and the final aggregation, and the answer stays a lazy DataFrame
    counts = materialize(v.where(F.col("v").isNotNull()).groupBy("category", "v")
                         .agg(F.count(F.lit(1)).alias("n")), "box-counts")
    # one small job sizes both decisions: the number of categories (broadcast
    # or not) and the most distinct values in one category (quantile plan)
    size = counts.groupBy("category").agg(F.count(F.lit(1)).alias("d")).agg(
        F.count(F.lit(1)).alias("groups"), F.max("d").alias("largest")).first()
    groups, largest = int(size["groups"]), int(size["largest"] or 0)
    if method == "auto":
        method = "percentile" if largest <= SMALL_LIMIT else "distributed"
    q = quantiles(counts, ["category"], "v", (0.25, 0.5, 0.75), method=method, weight="n")
    fences = q.select("category", F.col("quantiles")[0].alias("q1"), F.col("quantiles")[1].alias("median"),
                      F.col("quantiles")[2].alias("q3"))
    fences = fences.select("*", (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("lower_fence"),
                           (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("upper_fence"))
    side = F.broadcast(fences) if groups <= BROADCAST_GROUPS else fences
    j = counts.join(side, "category")
    x, n = F.col("v"), F.col("n")
    inside = (x >= F.col("lower_fence")) & (x <= F.col("upper_fence"))
    agg = j.groupBy("category").agg(
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.first("lower_fence").alias("lower_fence"), F.first("upper_fence").alias("upper_fence"),
        F.min(F.when(inside, x)).alias("whisker_low"), F.max(F.when(inside, x)).alias("whisker_high"),
        F.sum(F.when((x < F.col("lower_fence")) | (x > F.col("upper_fence")), n).otherwise(0))
        .cast("long").alias("outliers"),
        F.min(x).alias("min"), F.max(x).alias("max"), F.sum(n).cast("long").alias("n"))
    return agg.withColumnRenamed("category", category)


def density(df: DataFrame, column: str, grid: int = 100, fine_bins: int = 512) -> DataFrame:
    """D3: Gaussian kernel density on ``grid`` points between min and max, from
    a fine histogram (binned KDE: O(bins × grid), independent of the row
    count); bandwidth 1.06 · sd · n^(-1/5)."""
    v = df.select(_value(df, column).alias("v")).where(F.col("v").isNotNull())
    s = v.agg(F.count("v").alias("n"), F.min("v").alias("mn"), F.max("v").alias("mx"),
              F.stddev_samp("v").alias("sd")).first()
    n, mn, mx, sd = s["n"], s["mn"], s["mx"], s["sd"]
    if n < 2 or not sd:
        raise ValueError("density needs two distinct values")
    h = 1.06 * sd * n ** (-0.2)
    width = (mx - mn) / fine_bins
    fine = v.groupBy(_bin(F.col("v"), mn, mx, fine_bins).alias("b")).agg(F.count(F.lit(1)).alias("w"))
    centre = F.lit(mn) + (F.col("b") - 0.5) * F.lit(width)
    step = (mx - mn) / (grid - 1)
    pts = fine.select(centre.alias("c"), "w", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("g"))
    x = F.lit(mn) + F.col("g") * F.lit(step)
    z = (x - F.col("c")) / F.lit(h)
    kern = F.col("w") * F.exp(-0.5 * z * z)
    norm = 1.0 / (n * h * math.sqrt(2 * math.pi))
    return (pts.groupBy("g").agg((F.sum(kern) * F.lit(norm)).alias("density"))
            .select(F.col("g").alias("point"), (F.lit(mn) + F.col("point") * F.lit(step)).alias("x"), "density"))


def parallel_coordinates(df: DataFrame, cols: Sequence[str] | None = None, fraction: float | None = None,
                         seed: int = 42, points: int | None = None) -> DataFrame:
    """Every numeric column min-max scaled to [0, 1], one output row per
    input row (all of them unless a sampling ``fraction``, or a fixed number of
    ``points``, is given); the scale is that of all rows; needs two
    numeric columns (two → scatter-matrix data, three or more → parallel axes)."""
    cols = list(cols) if cols is not None else K.numeric_columns(df)
    if len(cols) < 2:
        raise ValueError("needs at least two numeric columns")
    types = {f.name: f.dataType for f in df.schema.fields}
    view = df.select(*[num(c, types[c]).alias(c) for c in cols])
    s = view.agg(*[F.min(at(c)).alias(f"{c}__min") for c in cols], *[F.max(at(c)).alias(f"{c}__max") for c in cols]).first()
    if fraction is not None:
        view = view.sample(fraction=fraction, seed=seed)
    if points is not None:
        view = bottom_rows(view, points, seed)

    def scale(c):
        lo, hi = s[f"{c}__min"], s[f"{c}__max"]
        if lo is None or hi == lo:
            return F.when(at(c).isNotNull(), F.lit(0.0))
        return (at(c) - F.lit(lo)) / F.lit(hi - lo)

    return view.select(*[scale(c).alias(c) for c in cols])


def outlier_rows(df: DataFrame, column: str, method: str = "auto") -> DataFrame:
    """The rows whose value lies outside the Tukey fences (all columns,
    plus the fences)."""
    v = _value(df, column)
    q = quartiles(df.select(v.alias(column)), [column], method).first()
    if q is None or q["q25"] is None:
        return df.limit(0)
    lo, hi = q["q25"] - 1.5 * (q["q75"] - q["q25"]), q["q75"] + 1.5 * (q["q75"] - q["q25"])
    dt = df.schema[column].dataType
    if K.kind_of(dt) == "numeric" and not isinstance(dt, T.BooleanType):
        # the fence test on the raw column reaches the parquet scan (row-group
        # skipping); NaN, which compares above every number, is removed after
        raw = at(column)
        out = df.where((raw < F.lit(lo)) | (raw > F.lit(hi)))
        if isinstance(dt, (T.FloatType, T.DoubleType)):
            out = out.where(~F.isnan(raw))
    else:
        out = df.where((v < F.lit(lo)) | (v > F.lit(hi)))
    return (out.withColumn("lower_fence", F.lit(lo).cast("double"))
            .withColumn("upper_fence", F.lit(hi).cast("double")))


def time_series(df: DataFrame, date_col: str, value_col: str) -> DataFrame:
    """(date, value) with the date coerced under one reading of the column,
    the one that reads most values (what it cannot read is dropped), rows
    missing either dropped, sorted by date (a range-partitioned sort)."""
    dt = df.schema[date_col].dataType
    d = K.to_datetime(date_col, K.commonest_reading(df, date_col)) if isinstance(dt, T.StringType) else at(date_col).cast("timestamp_ntz") \
        if isinstance(dt, T.DateType) else at(date_col)
    vt = df.schema[value_col].dataType
    val = num(value_col, vt) if K.kind_of(vt) == "numeric" else at(value_col)
    # equal (date, value) rows are interchangeable; their scan position breaks
    # the tie so the range-partitioned sort can split a run of them
    return (df.select(d.alias(date_col), val.alias(value_col), F.monotonically_increasing_id().alias("_pos"))
            .where(at(date_col).isNotNull() & at(value_col).isNotNull())
            .orderBy(at(date_col), at(value_col), "_pos").drop("_pos"))
