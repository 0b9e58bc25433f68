"""Exact medians per group: hot, small, tied and empty groups, every path."""
import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablelens.functions import selection as S
from tablelens.operators import pairs


def check(spark, rows):
    df = spark.createDataFrame(rows, "g string, h int, value double").repartition(6)
    got = {(r["g"], r["h"]): r for r in S.grouped_medians(df, ["g", "h"], {"n": F.count("value"), "s": F.sum("value")}).collect()}
    by = {}
    for g, h, v in rows:
        by.setdefault((g, h), []).append(v)
    assert got.keys() == by.keys()
    for k, vs in by.items():
        vs = [v for v in vs if v is not None]
        assert got[k]["n"] == len(vs)
        assert got[k]["median"] == (statistics.median(vs) if vs else None), k


def rows_():
    rnd = random.Random(4)
    out = [("hot", 1, rnd.gauss(0, 1)) for _ in range(5001)] + [("even", 1, rnd.random()) for _ in range(2000)]
    out += [("ties", 2, float(rnd.choice([1, 1, 1, 2, 7]))) for _ in range(3000)] + [("two", 2, float(i % 2)) for i in range(4000)]
    out += [("none", 3, None)] * 5 + [("one", 3, 4.5)] + [("const", 4, 2.5)] * 1500 + [("inf", 5, rnd.choice([float("inf"), 1.0, float("-inf")])) for _ in range(900)]
    out += [(f"s{i}", i % 7, rnd.random()) for i in range(300) for _ in range(1 + i % 9)]
    return out + [("hot", 1, None)] * 50


@pytest.mark.parametrize("limit", [10 ** 6, 150])
def test_exact_by_every_path(spark, monkeypatch, limit):
    monkeypatch.setattr(S, "LIMIT", limit)
    check(spark, rows_())


def test_brackets_that_miss_are_searched_again(spark, monkeypatch):
    monkeypatch.setattr(S, "_around", lambda grid, rank, honest=S._around: tuple(
        F.when(F.col("_tl_k") % 2 == 0, F.lit(-5.0)).otherwise(x) for x in honest(grid, rank)))
    check(spark, rows_()[:9000])


def test_a_hundred_thousand_categories_in_one_grouping(spark):
    n = 100_000
    df = spark.range(4 * n).select(F.concat(F.lit("c"), (F.col("id") % n).cast("string")).alias("cat"), ((F.col("id") * 7919) % 1_000_003).cast("double").alias("x"))
    ids = np.arange(4 * n)
    pdf = pd.DataFrame({"cat": ids % n, "x": ((ids * 7919) % 1_000_003).astype(float)})
    want = pdf.groupby("cat")["x"].agg(["count", "mean", "median"])
    got = pairs.grouped_stats(df, ["cat"], ["x"], ("count", "mean", "median")).toPandas()
    got = got.assign(cat=got["category"].str[1:].astype(int)).set_index("cat").sort_index()
    assert len(got) == n and (got["count"] == 4).all()
    assert np.allclose(got["median"], want["median"]) and np.allclose(got["mean"], want["mean"])
    plan = pairs.grouped_stats(df, ["cat"], ["x"], ("count", "median"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan        # all groups are small: the written grouping is the answer
