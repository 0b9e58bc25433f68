"""Small DataFrame shapes used everywhere: one aggregation row turned into one
row per column, long (column, value) views, and a one-row statistics table
joined back by broadcast (its size is one row, whatever the data size)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.functions.stats import at, num


def agg_by_column(df: DataFrame, cols: Sequence[str],
                  exprs: Sequence[tuple[str, Callable[[str], Column]]],
                  group: Sequence[str] = (), source: DataFrame | None = None) -> DataFrame:
    """Run every ``expr(c)`` for every column in ONE aggregation, then return
    one row per column (and group): ``(*group, column, name...)``. ``source``
    replaces ``df`` as the aggregated frame when extra columns are needed."""
    df = source if source is not None else df
    if not cols:
        fields = ", ".join(f"{n} double" for n, _ in exprs)
        return df.sparkSession.createDataFrame([], f"column string{', ' + fields if fields else ''}")
    structs = [F.struct(F.lit(c).alias("column"), *[e(c).alias(n) for n, e in exprs]) for c in cols]
    agg = df.groupBy(*group).agg(F.array(*structs).alias("_s"))
    return agg.select(*group, F.inline("_s"))


def numeric_long(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., column, value double) with NaN as null."""
    types = {f.name: f.dataType for f in df.schema.fields}
    pairs = [F.struct(F.lit(c).alias("column"), num(c, types[c]).alias("value")) for c in cols]
    return df.select(*keep, F.inline(F.array(*pairs)))


def string_long(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., column, value string)."""
    pairs = [F.struct(F.lit(c).alias("column"), at(c).cast("string").alias("value")) for c in cols]
    return df.select(*keep, F.inline(F.array(*pairs)))


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back: cuts
    the lineage (a lost executor recomputes from the files, not from the
    source) and lets several later passes reuse one shuffle result."""
    from tablelens.session import scratch_path
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def per_column(rows) -> dict:
    """Small per-column statistics (one row per column) as a dict keyed by column."""
    return {r["column"]: r for r in rows}


def rounded(df: DataFrame, decimals: int | None) -> DataFrame:
    """Round every double column to ``decimals`` places (display form, as the
    tables are printed); ``None`` keeps full precision."""
    if decimals is None:
        return df
    from pyspark.sql import types as T
    return df.select(*[F.round(at(f.name), decimals).alias(f.name)
                       if isinstance(f.dataType, T.DoubleType) else at(f.name) for f in df.schema.fields])
