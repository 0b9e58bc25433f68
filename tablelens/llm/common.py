"""Helpers shared by the pipeline operators: table readers, written
intermediate tables in the cluster's shared folder, and gapless ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablelens.session import scratch_path


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once (zstd Parquet) under ``spark.checkpoint.dir`` and
    read back: later passes reuse it, and a lost executor re-reads files every
    other executor can see."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def text_or_empty(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("string"), F.lit(""))


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[str], rank: str, name: str = "ranked") -> DataFrame:
    """Add ``rank`` (0, 1, ... within ``group`` in ``order``) without putting a
    group into one task: the rows are exchanged once by range of (group,
    order), sorted and written; the rows of each (partition, group) are
    counted, and a running sum over those few counts gives each partition's
    first rank. The counts (at most partitions + groups rows) are broadcast.
    """
    keys = [*group, *order]
    cut = (df.repartitionByRange(*[F.col(c) for c in keys]).sortWithinPartitions(*keys)
           .withColumn("__pid", F.spark_partition_id())
           .withColumn("__seq", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    cut = stored(cut, name)
    per = cut.groupBy("__pid", *group).agg(F.count(F.lit(1)).alias("__n"), F.min("__seq").alias("__first"))
    before = Window.partitionBy(*group).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("__pid", *[F.col(c).alias(f"__g_{c}") for c in group],
                     (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__base"))
    on = [cut["__pid"] == per["__pid"]] + [cut[c].eqNullSafe(per[f"__g_{c}"]) for c in group]
    return (cut.join(F.broadcast(per), on, "inner")
            .select(*[cut[c] for c in df.columns], (cut["__seq"] + per["__base"]).cast("long").alias(rank)))
