"""Numbers, average ranks and dense grids by range partitions; samples of a fixed size."""
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablelens.functions import ranges as R
from tablelens.operators import chartdata as D
from tablelens.operators import pairs as B


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_average_ranks_with_values_across_partitions(spark):
    rnd = random.Random(1)
    rows = [(float(rnd.choice([1, 1, 1, 1, 2, 3, 50])), i * 0.5, rnd.randrange(1, 5)) for i in range(3000)] + [(9.0, -1.0, 7)]
    df = spark.createDataFrame(rows, "x double, y double, w long").repartition(4)
    got = {r["y"]: r["rk"] for r in R.with_average_rank(df, "x", "w", "y", "rk").collect()}
    every = pd.Series([x for x, _, w in rows for _ in range(w)]).rank()
    at, want = 0, {}
    for x, y, w in rows:
        want[y] = every[at]
        at += w
    assert got == want


def test_spearman_by_two_range_exchanges(spark):
    rnd = random.Random(2)
    rows = [(float(rnd.randrange(40)), rnd.random() if i % 3 else 0.5) for i in range(4000)] + [(None, 1.0), (2.0, None)]
    df = spark.createDataFrame(rows, "a double, b double")
    pdf = pd.DataFrame(rows[:-2], columns=["a", "b"])
    assert B.spearman_test(df, "a", "b").first()["rho"] == pytest.approx(pdf["a"].rank().corr(pdf["b"].rank()), rel=1e-12)
    one = R.with_average_rank(df.where("a is not null and b is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("w")), "a", "w", "b", "r")
    assert "SinglePartition" not in plan(one) and "SortMergeJoin" not in plan(one)
    assert B.spearman_test(df.limit(0), "a", "b").first()["rho"] is None
    assert B.spearman_test(spark.createDataFrame([(1.0, 2.0)] * 5, "a double, b double"), "a", "b").first()["rho"] is None


def test_numbers_are_gapless(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"))
    got = sorted((r["n"], r["k"]) for r in R.numbered(df, [F.desc("k")], "n").collect())
    assert [n for n, _ in got] == list(range(5000)) and [k for _, k in got] == sorted((k for _, k in got), reverse=True)
    assert R.numbered(df.limit(0), [F.col("k")], "n").count() == 0


def test_dense_table_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(B, "DENSE_STEP", 3)
    rnd = random.Random(3)
    rows = [(f"a{rnd.randrange(9)}", f"b{rnd.randrange(11)}") for _ in range(60)] + [(None, "b1"), ("a1", None)]
    df = spark.createDataFrame(rows, "a string, b string")
    out = B.contingency(df, "a", "b", zeros=True)
    full = [(x, y) for x, y in rows if x and y]
    want = {(x, y): full.count((x, y)) for x in {r[0] for r in full} for y in {r[1] for r in full}}
    assert {(r["a"], r["b"]): r["n"] for r in out.collect()} == want
    assert "CartesianProduct" not in plan(out) and "NestedLoop" not in plan(out)
    assert B.contingency(df.limit(0), "a", "b", zeros=True).count() == 0


@pytest.mark.parametrize("n", [10, 700])
def test_sample_is_the_same_under_any_partitions(spark, n):
    df = spark.range(2000).select((F.col("id") % 37).cast("double").alias("x"), (F.col("id") * 0.25).alias("y"))
    got = [sorted(map(tuple, D.scatter_points(df.repartition(p), "x", "y", n).collect())) for p in (1, 8, 200)]
    assert got[0] == got[1] == got[2] and len(got[0]) == n
    assert D.scatter_points(df, "x", "y", 10_000).count() == 2000
    wide = df.withColumn("z", F.col("y") * 2)
    a, b = (sorted(map(tuple, D.parallel_coordinates(wide.repartition(p), points=n).collect())) for p in (3, 50))
    assert a == b and len(a) == n
