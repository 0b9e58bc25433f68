"""The most frequent values of many columns by frequent-items summaries.

Pass one folds 64-bit hashes of the values into a mergeable summary a column
(a few thousand counters a task, merged in two levels). Pass two counts the
survivors exactly, by value: only they are shuffled. The summary's error bound
says how often a value it does not name can occur at most; when the k-th exact
count is above that (or the survivors make up the whole column), no other
value can be among the first k, ties included.

Where that proof fails (many values that are all rare), the hashes alone are
counted by a shuffle of 16 bytes a distinct value, and only the values behind
the highest counts are fetched. Values that occur once are taken smallest
first, each task passing on no more than it must. A hash that two values share
can only raise its count; the exact counts that follow find that out, and the
column is then counted in full.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelens.functions.selection import two_levels
from tablelens.functions.stats import at

#: counters of a summary
TRACKED = 10_000
#: survivors of a column that are counted exactly
SURVIVORS = 1_000
#: values behind the highest hash counts that may be fetched one by one
TIED = 100_000

SCHEMA = "column string, value string, n long"


def unnamed_bound(rows: int) -> float:
    """Most rows that a value can have which the summary does not name: it is
    off by 3.5 / (size of its map) at most, the map has at least 4/3 ``TRACKED``
    places, and it names every value that is certainly above its error."""
    return 2 * 3.5 * 0.75 / TRACKED * rows


def _hash(c: str) -> Column:
    text = at(c).cast("string")
    return F.when(text.isNotNull(), F.xxhash64(text))


def _values(df: DataFrame, cols: Sequence[str], keep: dict[str, Column]) -> DataFrame:
    """(column, value, h) of the rows whose hash ``keep`` admits."""
    pairs = [F.struct(F.lit(c).alias("column"), at(c).cast("string").alias("value"), keep[c].alias("keep")) for c in cols]
    return df.select(F.inline(F.array(*pairs))).where(F.col("value").isNotNull() & F.col("keep")).drop("keep")


def _count(rows: DataFrame) -> DataFrame:
    return rows.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def _first(counts: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_counts(df: DataFrame, cols: Sequence[str], k: int) -> DataFrame:
    """(column, value, n, rank): per column the ``k`` most frequent non-null
    values, exact, ties to the smaller value (``k`` rows a column at most)."""
    spark, cols = df.sparkSession, list(cols)
    empty = spark.createDataFrame([], SCHEMA + ", rank int")
    if not cols or df.isEmpty():     # summaries of no rows cannot be merged
        return empty
    parts: dict = {"all": (F.count(F.lit(1)), F.sum)}
    for i, c in enumerate(cols):
        parts[f"n{i}"] = (F.count(at(c)), F.sum)
        parts[f"s{i}"] = (F.call_function("approx_top_k_accumulate", _hash(c), F.lit(TRACKED)),
                          lambda s: F.call_function("approx_top_k_estimate", F.call_function("approx_top_k_combine", F.col(s), F.lit(TRACKED)), F.lit(SURVIVORS)))
    row = two_levels(df, parts)
    rows = {c: int(row[f"n{i}"] or 0) for i, c in enumerate(cols)}
    named = {c: [(r["item"], r["count"]) for r in (row[f"s{i}"] or []) if r["item"] is not None] for i, c in enumerate(cols)}
    asked = [c for c in cols if named[c]]
    counted: dict[str, list] = {c: [] for c in cols}
    if asked:
        some = _values(df, asked, {c: _hash(c).isin([h for h, _ in named[c]]) for c in asked})
        counts = _count(some).persist()
        try:
            total = {r["column"]: r["n"] for r in counts.groupBy("column").agg(F.sum("n").alias("n")).collect()}
            for r in _first(counts, k).orderBy("column", "rank").collect():
                counted[r["column"]].append((r["value"], r["n"]))
        finally:
            counts.unpersist()
    else:
        total = {}
    out, open_ = [], []
    for c in cols:
        best = counted[c]
        other = unnamed_bound(int(row["all"] or 0))
        if len(named[c]) >= SURVIVORS:      # more may have been named: they come after the last
            other = max(other, named[c][-1][1])
        if total.get(c, 0) == rows[c] or (len(best) >= k and best[-1][1] > other):
            out += [(c, v, n, j) for j, (v, n) in enumerate(best, 1)]
        else:
            open_.append(c)
    proved = spark.createDataFrame(out, SCHEMA + ", rank int") if out else empty
    for c in open_:
        proved = proved.unionByName(_by_hashes(df, c, k))
    return proved


def _by_hashes(df: DataFrame, c: str, k: int) -> DataFrame:
    """``top_counts`` of one column whose frequent values no summary proves."""
    from tablelens.functions.frames import materialize

    counts = materialize(df.select(_hash(c).alias("h")).where("h is not null").groupBy("h").agg(F.count(F.lit(1)).alias("n")), "hash-counts")
    level = [r["n"] for r in counts.orderBy(F.desc("n")).limit(k).select("n").collect()]
    text = df.select(F.lit(c).alias("column"), at(c).cast("string").alias("value"), _hash(c).alias("h"))
    if len(level) == k and level[-1] > 1:
        high = counts.where(F.col("n") >= level[-1]).select("h")
        if high.limit(TIED + 1).count() <= TIED:
            best = materialize(_first(_count(text.join(F.broadcast(high), "h", "left_semi")), k), "top-values").select("column", "value", "n", "rank")
            # values whose hashes were lower occur less often than that level
            if best.where(F.col("n") >= level[-1]).count() == k:
                return best
    elif len(level) == k:                    # fewer than k values occur twice: the rest are the smallest of all others
        twice = counts.where(F.col("n") > 1).select("h")
        some = _count(text.join(F.broadcast(twice), "h", "left_semi"))
        once = text.join(F.broadcast(twice), "h", "left_anti")
        w = Window.partitionBy("column").orderBy("value")
        small = once.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("column", "value", F.lit(1).cast("long").alias("n"))
        return _first(some.unionByName(small), k).select("column", "value", "n", "rank")
    return _first(_count(text.where(F.col("value").isNotNull())), k).select("column", "value", "n", "rank")
