"""The k most frequent values by summaries, hashes or full counts: always exact."""
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablelens.functions import frequent as Q


def want(values, k):
    n = Counter(v for v in values if v is not None)
    return [(v, c) for v, c in sorted(n.items(), key=lambda x: (-x[1], x[0].encode()))[:k]]


def columns():
    rnd = random.Random(9)
    n = 4000
    return {
        "heavy": [rnd.choice("aab") if i % 3 else f"rare{i}" for i in range(n)],
        "few": [rnd.choice(["x", "y", "", "ä"]) for _ in range(n)],
        "distinct": [f"id{rnd.random()}" for _ in range(n)],
        "nearly": [f"id{i % (n - 3)}" for i in range(n)],
        "pairs": [f"p{i // 2}" for i in range(n)],
        "none": [None] * n,
        "ties": [f"t{i % 40}" for i in range(n)],
        "some": [None if i % 2 else "v" for i in range(n)],
    }


@pytest.mark.parametrize("tracked,survivors,tied", [(10_000, 1_000, 100_000), (64, 16, 100_000), (64, 4, 10)])
def test_exact_by_every_path(spark, monkeypatch, tracked, survivors, tied):
    monkeypatch.setattr(Q, "TRACKED", tracked)
    monkeypatch.setattr(Q, "SURVIVORS", survivors)
    monkeypatch.setattr(Q, "TIED", tied)
    data = columns()
    names = list(data)
    df = spark.createDataFrame(list(zip(*data.values())), ", ".join(f"`{c}` string" for c in names)).repartition(5)
    for k in (1, 5) if tied == 10 else (5,):
        got = {}
        for r in Q.top_counts(df, names, k).orderBy("column", "rank").collect():
            got.setdefault(r["column"], []).append((r["value"], r["n"]))
        for c in names:
            assert got.get(c, []) == want(data[c], k), (c, k)


def test_shared_hashes_are_found_out(spark, monkeypatch):
    """With a hash that maps many values onto few, counts stay those of values."""
    monkeypatch.setattr(Q, "_hash", lambda c: F.when(F.col(c).isNotNull(), F.pmod(F.crc32(F.col(c).cast("binary")), F.lit(5))))
    data = [f"v{i % 97}" for i in range(3000)] + ["top"] * 60
    df = spark.createDataFrame([(v,) for v in data], "c string")
    for tracked in (10_000, 64):
        monkeypatch.setattr(Q, "TRACKED", tracked)
        monkeypatch.setattr(Q, "SURVIVORS", min(1_000, tracked))
        assert [(r["value"], r["n"]) for r in Q.top_counts(df, ["c"], 3).orderBy("rank").collect()] == want(data, 3)


def test_a_distinct_column_is_not_shuffled_whole(spark):
    df = spark.range(60_000).select(F.concat(F.lit("long text " * 20), F.col("id").cast("string")).alias("t"))
    out = Q.top_counts(df, ["t"], 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan        # each task passes on three values
    assert [r["n"] for r in out.collect()] == [1, 1, 1]


def test_empty(spark):
    df = spark.createDataFrame([], "a string, b string")
    assert Q.top_counts(df, ["a", "b"], 3).count() == 0 and Q.top_counts(df, [], 3).count() == 0
