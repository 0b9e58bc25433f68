"""Numbers and average ranks over a whole table by range partitions: no window
over all rows, no values joined back, no single task.

Rows are exchanged once by range (further columns split a value that holds
many rows), written, and read back with the number of their partition. What
comes before a partition, and how far the value at either of its ends reaches
into its neighbours, follows from one small row a partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelens.functions.frames import materialize
from tablelens.functions.quantiles import ROWS_PER_RANGE

_PID = "_tl_pid"


def ranged(df: DataFrame, order: Sequence[Column], rows: int | None = None, name: str = "ranged") -> DataFrame:
    """``df`` exchanged by range of ``order``, written, with its partition number ``_tl_pid``."""
    spark = df.sparkSession
    floor_ = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(floor_, -(-(rows or 0) // ROWS_PER_RANGE))
    return materialize(df.repartitionByRange(parts, *order).withColumn(_PID, F.spark_partition_id()), name)


def numbered(df: DataFrame, order: Sequence[Column], name: str, rows: int | None = None) -> DataFrame:
    """``df`` with ``name``: 0, 1, ... in ``order`` (whose columns tell all rows apart)."""
    cut = ranged(df, order, rows, "numbered")
    per = {r[_PID]: r["n"] for r in cut.groupBy(_PID).agg(F.count(F.lit(1)).alias("n")).collect()}   # a row a partition
    at_, starts = 0, []
    for pid in sorted(per):
        starts.append((pid, at_))
        at_ += per[pid]
    first = df.sparkSession.createDataFrame(starts, f"{_PID} int, _tl_first long")
    place = F.row_number().over(Window.partitionBy(_PID).orderBy(*order)) - 1
    return cut.join(F.broadcast(first), _PID).withColumn(name, place + F.col("_tl_first")).drop(_PID, "_tl_first")


def with_average_rank(df: DataFrame, value: str, weight: str, split: str, rank: str, rows: int | None = None) -> DataFrame:
    """``df`` with ``rank``, the average 1-based rank of ``value`` among rows that
    each stand for ``weight`` equal ones. ``split`` deals the rows of one value
    over several partitions."""
    cut = ranged(df, [F.col(value), F.col(split)], rows, f"ranked-{rank}")
    ends = cut.groupBy(_PID).agg(F.sum(weight).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
    per = Window.partitionBy(_PID)
    tie = F.sum(weight).over(Window.partitionBy(_PID, value))
    upto = F.sum(weight).over(per.orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    local = cut.withColumns({"_tl_tie": tie, "_tl_upto": upto})
    # weight of each partition's end values in the other partitions (a row a partition and end)
    edge = cut.join(F.broadcast(ends.select(_PID, "low", "high")), _PID).where((F.col(value) == F.col("low")) | (F.col(value) == F.col("high")))
    at_end = edge.groupBy(_PID, F.col(value).alias("v")).agg(F.sum(weight).alias("w")).collect()
    stats = sorted((r[_PID], r["n"], r["low"], r["high"]) for r in ends.collect())
    held: dict = {}
    for r in at_end:
        held.setdefault(r["v"], []).append((r[_PID], r["w"]))
    out, before = [], 0
    for pid, n, low, high in stats:
        earlier = sum(w for p, w in held[low] if p < pid)
        later = sum(w for p, w in held[high] if p > pid)
        out.append((pid, int(before), int(earlier), int(later), float(low), float(high)))
        before += n
    table = df.sparkSession.createDataFrame(out, f"{_PID} int, _tl_before long, _tl_earlier long, _tl_later long, _tl_low double, _tl_high double")
    local = local.join(F.broadcast(table), _PID)
    v = F.col(value)
    earlier = F.when(v == F.col("_tl_low"), F.col("_tl_earlier")).otherwise(0)
    later = F.when(v == F.col("_tl_high"), F.col("_tl_later")).otherwise(0)
    start = F.col("_tl_before") - earlier + F.col("_tl_upto") - F.col("_tl_tie")
    average = start + (F.col("_tl_tie") + earlier + later + 1) / 2.0
    return local.select(*df.columns, average.alias(rank))
