"""Readers for the parquet test tables and the dirty view used by the cleaning checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


#: tables with at least this many rows (or bytes of input) are spread over the
#: cluster when the scan alone would give fewer tasks than there are cores
SPREAD_MIN_ROWS = 100_000
SPREAD_MIN_BYTES = 3 * 512 * 1024  # about 100k rows of the wider test tables


def _input_bytes(df: DataFrame) -> int | None:
    """Total size of the input files when they are local (None otherwise)."""
    import os
    from urllib.parse import urlparse
    total = 0
    for f in df.inputFiles():
        u = urlparse(f)
        if u.scheme not in ("", "file") or not os.path.exists(u.path):
            return None
        total += os.path.getsize(u.path)
    return total


def spread(df: DataFrame, min_rows: int = SPREAD_MIN_ROWS) -> DataFrame:
    """Spread the rows over ``defaultParallelism`` partitions when the scan
    yields fewer (a few big files or one big row group). A scan of many files
    is returned unchanged, so at cluster scale this is a no-op. Size comes
    from the input files when they are local, else from the row count (a
    parquet scan counts from its footers). The rows are hashed on their
    position in the file, which a re-run reproduces (no sort is needed, as a
    round-robin repartition would add for a retried task); as the position is
    a plain column of the scan, filters above still reach it."""
    from pyspark.sql import functions as F
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    size = _input_bytes(df)
    big = size >= SPREAD_MIN_BYTES if size is not None else df.count() >= min_rows
    if not big:
        return df
    return df.repartition(target, F.col("_metadata.row_index") if has_row_index(df) else F.monotonically_increasing_id())


def has_row_index(df: DataFrame) -> bool:
    """Does ``df`` come from one parquet scan, whose rows know their place in the file?"""
    from pyspark.errors import AnalysisException
    try:
        df.select("_metadata.row_index").schema
    except AnalysisException:
        return False
    return True


def table(spark: SparkSession, sf_dir: str, name: str, balance: bool = True) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if balance else df


# The dirty view: the same SQL text runs on Spark and DuckDB.
DIRTY_SQL = """
WITH base AS (
  SELECT l_orderkey, l_linenumber,
    CASE WHEN l_orderkey % 11 = 0 THEN NULL
         WHEN l_orderkey % 97 = 0 THEN l_quantity * 10 ELSE l_quantity END AS quantity,
    CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_returnflag END AS returnflag,
    CASE WHEN l_orderkey % 7 = 0 THEN '?'
         ELSE CAST(CAST(l_partkey AS INT) AS VARCHAR(20)) END AS part_text,
    CAST(l_suppkey AS VARCHAR(20)) AS supp_text,
    CAST(NULL AS VARCHAR(20)) AS empty_col
  FROM lineitem)
SELECT * FROM base UNION ALL SELECT * FROM base WHERE l_orderkey % 17 = 0
"""


def dirty_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with nulls, a sentinel, an all-null column and repeated rows."""
    li = table(spark, sf_dir, "lineitem", balance=False).select("l_orderkey", "l_linenumber", "l_quantity",
                                                 "l_returnflag", "l_partkey", "l_suppkey")
    view = f"lineitem_dirty_src_{abs(hash(sf_dir))}"
    li.createOrReplaceTempView(view)
    df = spark.sql(DIRTY_SQL.replace("FROM lineitem)", f"FROM {view})"))
    return spread(df)
