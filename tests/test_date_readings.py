"""Text dates: which readings read a value, and how often that is looked for."""
import itertools

import pytest
from pyspark.sql import functions as F

from tablelens.operators import clean as C
from tablelens.operators import kinds as K
from tablelens.plans.registry import QUERIES

SHORT = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
LONG = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]


def _texts() -> list[str]:
    numbers = ["0", "00", "1", "01", "2", "02", "9", "12", "13", "28", "29", "30", "31", "32", "99"]
    years = ["0000", "1900", "2023", "2024", "9999"]
    days = []
    for a, b, y in itertools.product(numbers, numbers, years):
        days += [f"{y}/{a}/{b}", f"{a}/{b}/{y}", f"{a}-{b}-{y}", f"{a}.{b}.{y}", f"{a}/{b}-{y}", f"{y}{a}{b}", f"{y}-{a}-{b}"]
    names = SHORT + LONG + [n.upper() for n in SHORT + LONG] + ["mAy", "jAnuary", "Sept", "Foo", "Janu", "ſep", "Aprıl", "APRİL", "Mai"]
    for name, d, y in itertools.product(names, ["0", "1", "05", "29", "30", "31", "32"], ["2023", "2024"]):
        days += [f"{d} {name} {y}", f"{name} {d}, {y}", f"{d}-{name}-{y}"]
    clocks = [" 5:30", "T05:30", " 23:59:59", " 24:00", " 5:60", " 05:30:60", "T 5:30", " 5:3", "05:30", "t05:30", " 5:30 ", " 5:30Z", " 0:00:0", " 29:00"]
    some = ["2024/1/2", "1/2/2024", "13/2/2024", "31-12-2024", "1.31.2024", "20240229", "2 Jan 2024", "2 May 2024", "January 2, 2024", "2024-01-02", "30/2/2024"]
    days += [d + c for d in some for c in clocks]
    days += [a + d + b for d in some for a, b in [(" ", " "), ("\t", ""), ("", "\n"), ("", "\t "), ("x", ""), ("", "x"), ("", " ")]]
    return sorted(set(days)) + ["", " ", "soon", "12345678", "1/2", None]


def test_masks_are_those_of_plain_parsing(spark):
    df = spark.createDataFrame([(t,) for t in _texts()], "t string").repartition(8)
    t = F.col("t")
    parsed = [F.when(F.try_to_timestamp(F.trim(t), F.lit(r + K.CLOCK)).isNotNull(), 2 << i).otherwise(0) for i, r in enumerate(K.READINGS)]
    iso = F.when(F.trim(t).try_cast("timestamp").isNotNull(), 1).otherwise(0)
    plain = F.when(t.isNotNull(), F.when(t.rlike(K.ISO_SHAPE), iso).when(t.rlike(K.DATE_SHAPE), sum(parsed[1:], parsed[0])).otherwise(0))
    rows = df.select("t", K.date_mask("t").alias("got"), plain.alias("want")).collect()
    assert [r for r in rows if r["got"] != r["want"]] == []
    assert set(range(K.N_READINGS)) == {i for r in rows for i in range(K.N_READINGS) if r["got"] and r["got"] >> i & 1}


@pytest.mark.parametrize("day", ["2024-01-02", "2024-05-06", "2023-12-31", "2024-02-29"])
def test_only_readings_that_fit_are_tried(spark, day):
    """Every parse that is tried succeeds: no reading is tried on another's text."""
    moment = F.lit(day).cast("timestamp")
    texts = [F.concat(F.date_format(moment, r), F.lit(clock)) for r in K.READINGS for clock in ("", " 10:30")]
    df = spark.range(1).select(F.explode(F.array(*texts)).alias("t"))
    tried = sum(F.when(F.col("t").rlike(s) & F.col("t").contains(m), 2 << i).otherwise(0) for i, (s, m) in enumerate(zip(K.READING_SHAPES, K.READING_MARKS)))
    rows = df.select("t", tried.alias("tried"), K.date_mask("t").alias("mask")).collect()
    assert len(rows) == 24 and all(r["tried"] == r["mask"] > 0 for r in rows)


def test_counting_code_does_not_grow_with_the_columns(spark):
    def parses(n):
        df = spark.range(5).select(*[F.concat(F.lit("1/2/20"), F.col("id") + 10).alias(f"c{i}") for i in range(n)])
        counts = K.conversion_counts(df)
        assert [r["column"] for r in counts.collect()] == df.columns and {r["readings"] for r in counts.collect()} == {0b1100}
        return counts._jdf.queryExecution().optimizedPlan().toString().count(K.READINGS[0])
    assert parses(1) == parses(12)


def test_counts_of_empty_tables_and_columns(spark):
    empty = spark.createDataFrame([], "`a.b` string, c string, n int")
    rows = K.conversion_counts(empty).collect()
    assert [tuple(r) for r in rows] == [("a.b", 0, 0, 0, 0, 0, None), ("c", 0, 0, 0, 0, 0, None)]
    assert K.conversion_counts(empty.select("n")).collect() == [] and K.date_readings(empty, ["c"]) == {"c": None}
    nulls = spark.createDataFrame([(None, "1/2/2024"), (None, None)], "`a.b` string, c string")
    assert [tuple(r) for r in K.conversion_counts(nulls).collect()] == [("a.b", 2, 0, 0, 0, 0, None), ("c", 2, 1, 0, 0, 1, 0b1100)]
    assert C.conversions(nulls, with_readings=True) == ({"a.b": "Converted to numeric", "c": "Converted to datetime"}, {"a.b": None, "c": 2})


@pytest.mark.parametrize("name", ["c5_one_reading_a_date_column_orders", "c5_convert_types_dirty"])
def test_readings_are_looked_for_once(spark, monkeypatch, name):
    """The pass that decides a conversion also finds its reading."""
    def again(df, cols):
        raise AssertionError("a second pass over the dates")
    monkeypatch.setattr(K, "date_readings", again)
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
