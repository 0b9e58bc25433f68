"""Running profile of an append-only source with Structured Streaming.

The reference profiles a table at rest; when the table keeps growing (files
landing in a folder), the same one-pass statistics — row count, missing
values, mean, std, min, max per numeric column and value counts per text
column — are streaming aggregations whose state is one buffer per column (or
per value), so ``complete`` output mode gives the current profile after every
micro-batch. Quantiles are not here: an exact quantile needs all values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions.stats import num
from tablelens.operators import kinds as K


def read_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                max_files_per_trigger: int | None = None, glob: str | None = None) -> DataFrame:
    """Files landing in the folder ``path`` (only names matching ``glob``)."""
    r = spark.readStream.schema(schema).format(fmt)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def running_numeric_profile(stream: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, rows, count, missing, mean, std, min, max) as a streaming aggregation."""
    cols = list(cols) if cols is not None else K.numeric_columns(stream)
    types = {f.name: f.dataType for f in stream.schema.fields}
    pairs = [F.struct(F.lit(c).alias("column"), num(c, types[c]).alias("value")) for c in cols]
    long = stream.select(F.inline(F.array(*pairs)))
    return long.groupBy("column").agg(
        F.count(F.lit(1)).alias("rows"), F.count("value").alias("count"),
        (F.count(F.lit(1)) - F.count("value")).alias("missing"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))


def running_value_counts(stream: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, value, n) for text columns as a streaming aggregation."""
    cols = list(cols) if cols is not None else K.categorical_columns(stream)
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in cols]
    return (stream.select(F.inline(F.array(*pairs))).where(F.col("value").isNotNull())
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))


def profile_once(spark: SparkSession, stream_df: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Run a streaming aggregation over everything available now into a
    memory table and return that table (for tests and one-off catch-ups)."""
    q = (stream_df.writeStream.outputMode("complete").format("memory").queryName(name)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.table(name)
