"""Named queries over the test tables, each paired with DuckDB SQL that
computes the same answer independently (the correctness gate).

Every query reads whole tables (or the dirty view Spark derives from
lineitem); doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.sources.tables import dirty_lineitem, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None, exact: bool = False):
    """``exact``: doubles as computed (a mean that lies on a rounding tie
    would otherwise depend on the last bit of a sum)."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return df if exact else round_doubles(df)
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run
    return deco


def round_doubles(df: DataFrame, k: int = 6) -> DataFrame:
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append((F.round(F.col(f"`{f.name}`"), k) + F.lit(0.0)).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def T_(spark, sf, name):
    return table(spark, sf, name)


def dirty(spark, sf):
    return dirty_lineitem(spark, sf)


# the catalogs register themselves on import
from tablelens.plans import catalog_profile  # noqa: E402,F401
from tablelens.plans import catalog_pairs  # noqa: E402,F401
from tablelens.plans import catalog_clean  # noqa: E402,F401
from tablelens.plans import catalog_charts  # noqa: E402,F401
from tablelens.plans import catalog_more  # noqa: E402,F401
from tablelens.plans import catalog_parts  # noqa: E402,F401
from tablelens.plans import catalog_text  # noqa: E402,F401
from tablelens.plans import catalog_summary  # noqa: E402,F401
from tablelens.plans import catalog_rules  # noqa: E402,F401
from tablelens.plans import catalog_gates  # noqa: E402,F401
from tablelens.plans import catalog_cases  # noqa: E402,F401
