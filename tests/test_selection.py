"""Order statistics by sketch and bracket: exact on every type, with ties,
nulls, few and many values, through narrowing passes and missed brackets."""
import datetime
import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tablelens.functions import selection as S

PROBS = [0.0, 0.001, 0.25, 0.5, 0.75, 0.999, 1.0]


def data():
    rnd = random.Random(11)
    out = []
    for i in range(5000):
        t = datetime.datetime(1965, 1, 1) + datetime.timedelta(microseconds=rnd.randrange(3 * 10 ** 15))
        out.append((rnd.gauss(0, 1) if i % 7 else None, float(rnd.randrange(4)), 2 ** 53 + rnd.randrange(3000),
                    rnd.choice([5, 5, 5, 9]), Decimal(rnd.randrange(10 ** 6)).scaleb(-2), t.date(), t, rnd.random() < 0.3,
                    None, float("nan") if i % 3 else float(i), 3.0 if i else -1.0, rnd.choice([-math.inf, 0.0, math.inf])))
    return out


SCHEMA = ("normal double, few double, wide long, tied int, money decimal(12,2), day date, moment timestamp_ntz, flag boolean, "
          "none double, nan double, most double, infinite float")


def want(values, p):
    v = sorted(values)
    h = p * (len(v) - 1)
    return v[math.floor(h)], (math.ceil(h) - h or 1.0) * float(v[math.floor(h)]) + (h - math.floor(h)) * float(v[math.ceil(h)]) if math.ceil(h) > h else float(v[math.floor(h)])


@pytest.mark.parametrize("sketch,limit", [(4096, 10 ** 6), (128, 300)])
def test_exact_through_every_path(spark, monkeypatch, sketch, limit):
    monkeypatch.setattr(S, "SKETCH", sketch)
    monkeypatch.setattr(S, "LIMIT", limit)
    rows = data()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    cols = {f.name: S.ordinal(F.col(f.name), f.dataType) for f in df.schema.fields}
    got, also = S.order_statistics(df, cols, PROBS, {"rows": (F.count(F.lit(1)), F.sum)}, summary=True, fences=False)
    assert also == {"rows": 5000}
    for i, c in enumerate(df.columns):
        present = [r[i] for r in rows if r[i] is not None and r[i] == r[i]]
        assert got[c].n == len(present), c
        for p in PROBS:
            if not present:
                assert got[c].lower(p) is None and got[c].linear(p) is None
            else:
                low, line = want(present, p) if not isinstance(present[0], (datetime.date,)) else (sorted(present)[math.floor(p * (len(present) - 1))], None)
                assert got[c].lower(p) == low, (c, p)
                if line is not None and not math.isinf(float(low)):
                    assert got[c].linear(p) == pytest.approx(line, rel=1e-15), (c, p)


def test_a_wrong_bracket_is_found_out(spark, monkeypatch):
    """A sketch that answers far from the truth costs passes, never the answer."""
    monkeypatch.setattr(S, "LIMIT", 100)
    honest = S._read_off
    monkeypatch.setattr(S, "_read_off", lambda spark, asked: {n: [v if calls.append(n) or len(calls) > 4 else 7.0 for v in vs] for n, vs in honest(spark, asked).items()})
    calls: list = []
    df = spark.range(3000).select((F.col("id") * 1.5).alias("x"))
    got, _ = S.order_statistics(df, {"x": S.ordinal(F.col("x"), df.schema["x"].dataType)}, [0.25, 0.9])
    assert got["x"].lower(0.25) == 749 * 1.5 and got["x"].lower(0.9) == 2699 * 1.5


def test_only_bracketed_values_are_shuffled(spark):
    df = spark.range(200_000).select((F.col("id") * 0.25).alias("x"))
    cols = {"x": S.ordinal(F.col("x"), df.schema["x"].dataType)}
    view, place = df.select(cols["x"].value.alias("v0")), {"x": 0}
    near = {("x", k): S._Target(k * 0.25 - 100, k * 0.25 + 100, 800) for k in (50_000, 100_000, 150_000)}
    counted, edges, _ = S.counted_regions(view, place, cols, near)
    assert counted.count() == 3 * 801 + 4 and len(edges[0]) == 3
    text = counted._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and text.count("HashAggregate") == 2   # counted before the shuffle
    assert {k: v[0] for k, v in S._fetch(view, place, cols, near).items()} == {("x", k): k * 0.25 for k in (50_000, 100_000, 150_000)}


def test_empty_and_single(spark):
    df = spark.createDataFrame([], "x double, y long")
    cols = {c: S.ordinal(F.col(c), df.schema[c].dataType) for c in df.columns}
    got, _ = S.order_statistics(df, cols, [0.5])
    assert got["x"].n == 0 and got["y"].linear(0.5) is None
    one = spark.createDataFrame([(1.5, 7)], "x double, y long")
    got, _ = S.order_statistics(one, cols, PROBS)
    assert [got["x"].linear(p) for p in PROBS] == [1.5] * 7 and got["y"].lower(0.5) == 7


@pytest.mark.parametrize("limit", [10 ** 6, 300])
def test_power_sums_and_outliers_from_the_same_scan(spark, monkeypatch, limit):
    monkeypatch.setattr(S, "LIMIT", limit)
    rnd = random.Random(2)
    rows = [(rnd.gauss(0, 1), rnd.choice([1, 1, 1, 2, 900]), Decimal(rnd.randrange(100)).scaleb(-1), 4.0, rnd.choice([0, 10 ** 16 + 1])) for _ in range(4000)]
    df = spark.createDataFrame(rows, "a double, b int, c decimal(9,1), d double, e long").repartition(3)
    cols = {f.name: S.ordinal(F.col(f.name), f.dataType) for f in df.schema.fields}
    got, _ = S.order_statistics(df, cols, (0.25, 0.5, 0.75), summary=True, fences=True)
    for i, c in enumerate(df.columns):
        v = [float(r[i]) for r in rows]
        lo, hi = got[c].fences()
        assert got[c].outliers == sum(x < lo or x > hi for x in v), c
        mean = sum(v) / len(v)
        assert got[c].mean == pytest.approx(mean)
        for p, m in zip((2, 3, 4), got[c].powers):
            assert m == pytest.approx(sum((x - got[c].mean) ** p for x in v), rel=1e-9, abs=1e-6), (c, p)
