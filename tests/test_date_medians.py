"""Null dates and timestamps take the exact lower median."""
import datetime as d

import pytest
from pyspark.sql import functions as F

from tablelens.functions import quantiles as Q
from tablelens.functions import selection as S
from tablelens.operators import clean as C

STEP = 7_919_000_001     # microseconds between two timestamps
FIRST = d.datetime(2001, 1, 1)


def lower_median(values):
    values = sorted(values)
    return values[(len(values) - 1) // 2]


def moments(spark, n, nulls=10):
    """``n`` different timestamps in no order, and ``nulls`` missing ones."""
    at = F.timestamp_micros((F.lit(978_307_200_000_000) + (F.col("id") * 7_368_787 % n) * F.lit(STEP)).cast("long"))
    df = spark.range(n + nulls).select("id", F.when(F.col("id") < n, at).alias("ts"))
    return df.withColumn("day", F.to_date("ts")).withColumn("wall", F.col("ts").cast("timestamp_ntz"))


@pytest.mark.parametrize("n", [1_000_001, 1_000_002])
@pytest.mark.parametrize("limit", [S.LIMIT, 1000])   # 1000: brackets are narrowed first
def test_fill_of_many_distinct_timestamps(spark, monkeypatch, n, limit):
    monkeypatch.setattr(S, "LIMIT", limit)
    df = moments(spark, n)
    fills, missing, rows = C._fill_stats(df.select("ts", "day", "wall"))
    k = (n - 1) // 2
    want = FIRST + d.timedelta(microseconds=k * STEP)
    assert (rows, missing) == (n + 10, {"ts": 10, "day": 10, "wall": 10})
    assert fills["ts"]["fill"] == str(want) + "+00:00" and fills["wall"]["fill"] == str(want)
    assert fills["day"]["fill"] == str(want.date())


@pytest.mark.parametrize("method", ["auto", "distributed"])
def test_lower_quantiles_keep_the_type(spark, method):
    values = [2**62 + k for k in (5, 1, 3, 3)] + [None]     # doubles cannot tell these apart
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 7), ("c", None)], "column string, value long")
    got = {r["column"]: r["quantiles"] for r in
           Q.quantiles(df, ["column"], "value", (0.0, 0.5, 0.9, 1.0), method=method, rows_hint=10, lower=True).collect()}
    assert got == {"a": [2**62 + 1, 2**62 + 3, 2**62 + 3, 2**62 + 5], "b": [7] * 4}


def test_table_is_filled(spark):
    days = [d.date(2020, 1, k) for k in (9, 1, 4, 30)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*days, None])], "i int, day date")
    got = {r["i"]: r["day"] for r in C.clean(df, cap=False).table.collect()}
    assert got[4] == lower_median(days) == d.date(2020, 1, 4)
