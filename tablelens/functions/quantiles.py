"""Exact quantiles and average ranks without one-task groups.

Spark's ``percentile`` is exact but keeps a map of every distinct value of a
group in one aggregation buffer; that is fine for a few million values and
fails for a 100 TB column. Both functions here take a *long* table
``(keys..., value)`` and pick a plan by the size of the biggest group:

* small (a table of at most ``small_limit`` rows, known from a cheap row count;
  or a counted table whose largest key has at most ``small_limit`` distinct
  values): the built-in ``percentile`` with partial aggregation (weighted by
  the counts when they exist), or a window per key over the distinct values;
* large: the distinct ``(keys, value, n)`` table is range-partitioned on
  ``(keys, value)`` (balanced by Spark's sampler, so a key holding a third of
  all rows spans many partitions), written once to the shared checkpoint
  folder so partition ids are stable, and ranks become
  ``rows before this partition + running sum inside it``. Only the per-partition
  totals (one row per partition and key) are combined by a window, and a
  quantile only reads the partitions that hold its ranks.

Without a row hint, the distinct ``(keys, value, n)`` table is built once
(partial aggregation, one shuffle), written to the shared folder, sized, and
used by whichever plan follows — one scan of the input in every case.

Quantiles use linear interpolation between the order statistics at
``floor(p*(n-1))`` and ``ceil(p*(n-1))`` (pandas' default, DuckDB
``quantile_cont``, Spark ``percentile``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelens.session import scratch_path

#: groups with more distinct values than this take the range-partitioned plan
SMALL_LIMIT = 2_000_000
#: distinct values per range partition in that plan (sizes the number of ranges)
ROWS_PER_RANGE = 2_000_000

_PID, _PN, _BEFORE, _TOTAL, _CUM = "_tl_pid", "_tl_pn", "_tl_before", "_tl_total", "_tl_cum"


def value_counts(long_df: DataFrame, keys: Sequence[str], value: str = "value",
                 weight: str | None = None) -> DataFrame:
    """(keys..., value, n) over non-null values; map-side combined. With
    ``weight`` the input is already counted and the weights are summed."""
    agg = F.sum(weight).alias("n") if weight else F.count(F.lit(1)).alias("n")
    return long_df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(agg)


def _counted(long_df: DataFrame, keys: Sequence[str], value: str, weight: str | None,
             method: str, small_limit: int, rows_hint: int | None):
    """Pick the plan. Returns (plan, counts) where counts is the distinct
    ``(keys, value, n)`` table when it was built (written once to the shared
    folder, so sizing it and using it cost one scan of the input)."""
    if method in ("percentile", "window"):
        return "small", None
    if method == "approx":
        return "approx", None
    if method == "auto" and rows_hint is not None and rows_hint <= small_limit:
        return "small", None  # no group can hold more values than the table has rows
    from tablelens.functions.frames import materialize
    counts = materialize(value_counts(long_df, keys, value, weight), "counts")
    if method == "distributed":
        return "large", counts
    largest = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("d")).agg(F.max("d")).first()[0] or 0
    return ("small" if largest <= small_limit else "large"), counts


def _ranged(counts: DataFrame, keys: Sequence[str], value: str):
    """Range-partition the distinct table, persist it in the shared folder, and
    return it with the per-(partition, key) totals and offsets."""
    spark = counts.sparkSession
    # as many ranges as keep each near ROWS_PER_RANGE distinct values (the
    # counted table is a written copy here, so its row count is cheap)
    floor_ = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(floor_, -(-counts.count() // ROWS_PER_RANGE))
    ranged = (counts.repartitionByRange(parts, *keys, value)
              .withColumn(_PID, F.spark_partition_id()))
    path = scratch_path(spark, "ranked")
    ranged.write.parquet(path)
    ranged = spark.read.parquet(path)
    by_key = Window.partitionBy(*keys)
    part = (ranged.groupBy(_PID, *keys).agg(F.sum("n").alias(_PN))
            .withColumn(_BEFORE, F.coalesce(F.sum(_PN).over(
                by_key.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .withColumn(_TOTAL, F.sum(_PN).over(by_key)))
    return ranged, part


def average_ranks(long_df: DataFrame, keys: Sequence[str], value: str = "value",
                  method: str = "auto", small_limit: int = SMALL_LIMIT,
                  weight: str | None = None, rows_hint: int | None = None) -> DataFrame:
    """(keys..., value, n, rank): 1-based average rank of each distinct value
    within its key (ties share the mean of their positions). ``weight`` names
    a count column when the rows are already counted; ``rows_hint`` (the
    input's row count, when known cheaply) lets small inputs skip the sizing."""
    plan, built = _counted(long_df, keys, value, weight, method, small_limit, rows_hint)
    counts = built if built is not None else value_counts(long_df, keys, value, weight)
    if plan != "large":
        w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        cum = F.sum("n").over(w)
        return counts.withColumn("rank", (cum - F.col("n")) + (F.col("n") + 1) / 2.0)
    ranged, part = _ranged(counts, keys, value)
    w = Window.partitionBy(_PID, *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    inside = ranged.withColumn(_CUM, F.sum("n").over(w))
    out = inside.join(part.select(_PID, *keys, _BEFORE), [_PID, *keys])
    rank = F.col(_BEFORE) + F.col(_CUM) - F.col("n") + (F.col("n") + 1) / 2.0
    return out.select(*keys, value, "n", rank.alias("rank"))


def quantiles(long_df: DataFrame, keys: Sequence[str], value: str = "value",
              probs: Sequence[float] = (0.25, 0.5, 0.75), method: str = "auto",
              small_limit: int = SMALL_LIMIT, accuracy: int = 10000,
              weight: str | None = None, rows_hint: int | None = None, lower: bool = False) -> DataFrame:
    """(keys..., quantiles array<double>) in the order of ``probs``; exact unless
    ``method='approx'`` (``percentile_approx`` with the given accuracy).
    ``weight`` names a count column when the rows are already counted;
    ``rows_hint`` is the input's row count when it is known cheaply (a parquet
    scan counts from its footers): at most ``small_limit`` rows go straight to
    ``percentile``; otherwise the counted table is built once and sized.
    ``lower``: values of the column itself (its type kept), always exact; the
    small plan then is a window per key over the distinct values."""
    probs = [float(p) for p in probs]
    parr = F.array(*[F.lit(p) for p in probs])
    plan, built = _counted(long_df, keys, value, weight, method, small_limit, rows_hint)
    if lower and plan != "large":
        counts = built if built is not None else value_counts(long_df, keys, value, weight)
        w = Window.partitionBy(*keys)
        run = (counts.withColumn(_CUM, F.sum("n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
               .withColumn(_TOTAL, F.sum("n").over(w)))
        picks = [F.min(F.when(F.col(_CUM) > F.floor(F.lit(p) * (F.col(_TOTAL) - 1)), F.col(value))) for p in probs]
        return run.groupBy(*keys).agg(F.array(*picks).alias("quantiles"))
    if plan == "approx" and weight is None:
        return long_df.groupBy(*keys).agg(
            F.percentile_approx(value, parr, accuracy).cast("array<double>").alias("quantiles"))
    if plan in ("small", "approx"):
        src, freq = (built, F.col("n")) if built is not None else (
            long_df, F.col(weight) if weight else F.lit(1))
        return (src.where(F.col(value).isNotNull()).groupBy(*keys)
                .agg(F.percentile(F.col(value), parr, freq).alias("quantiles")))
    counts = built if built is not None else value_counts(long_df, keys, value, weight)
    ranged, part = _ranged(counts, keys, value)
    totals = part.select(*keys, _TOTAL).dropDuplicates(list(keys))
    h = F.col("p") * (F.col(_TOTAL) - 1)
    targets = (totals.select(*keys, _TOTAL, F.posexplode(parr).alias("pi", "p"))
               .withColumn("h", h)
               .withColumn("lo", F.floor("h")).withColumn("hi", F.col("lo") if lower else F.ceil("h"))
               .withColumn("k", F.explode(F.array_distinct(F.array("lo", "hi")))))
    located = targets.join(part.select(_PID, *keys, _BEFORE, _PN), list(keys)).where(
        (F.col("k") >= F.col(_BEFORE)) & (F.col("k") < F.col(_BEFORE) + F.col(_PN)))
    needed = located.select(_PID, *keys).dropDuplicates()
    w = Window.partitionBy(_PID, *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    rows = (ranged.join(needed, [_PID, *keys], "left_semi")
            .withColumn(_CUM, F.sum("n").over(w))
            .join(part.select(_PID, *keys, _BEFORE), [_PID, *keys])
            .withColumn("start", F.col(_BEFORE) + F.col(_CUM) - F.col("n")))
    picked = located.join(rows.select(_PID, *keys, "start", "n", value), [_PID, *keys]).where(
        (F.col("k") >= F.col("start")) & (F.col("k") < F.col("start") + F.col("n")))
    per_p = picked.groupBy(*keys, "pi", "h", "lo", "hi").agg(
        F.max(F.when(F.col("k") == F.col("lo"), F.col(value))).alias("vlo"),
        F.max(F.when(F.col("k") == F.col("hi"), F.col(value))).alias("vhi"))
    q = F.when(F.col("hi") == F.col("lo"), F.col("vlo")).otherwise(
        (F.col("hi") - F.col("h")) * F.col("vlo") + (F.col("h") - F.col("lo")) * F.col("vhi"))
    per_p = per_p.withColumn("q", F.col("vlo") if lower else q.cast("double"))
    return per_p.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pi", "q"))), lambda s: s["q"]).alias("quantiles"))
