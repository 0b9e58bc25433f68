"""Invariants on the test tables."""
from pyspark.sql import functions as F

from tablelens.operators import chartdata as D
from tablelens.operators import clean as C
from tablelens.operators import pairs as B
from tablelens.operators import profile as P
from tablelens.sources.tables import dirty_lineitem, table

SF = "/root/testdata/sf0.001"


def test_histogram_counts_sum_to_n(spark):
    li = table(spark, SF, "lineitem")
    h = D.histogram(li, "l_extendedprice")
    assert h.agg(F.sum("count")).first()[0] == li.where(F.col("l_extendedprice").isNotNull()).count()
    assert 10 <= h.count() <= 50


def test_contingency_margins_equal_value_counts(spark):
    li = table(spark, SF, "lineitem")
    cells = B.contingency(li, "l_returnflag", "l_linestatus", zeros=True)
    margins = {r["l_returnflag"]: r["s"] for r in cells.groupBy("l_returnflag").agg(F.sum("n").alias("s")).collect()}
    counts = {r["value"]: r["n"] for r in P.value_counts(li, ["l_returnflag"]).collect()}
    assert margins == counts


def test_cleaning_twice_adds_nothing(spark):
    d = dirty_lineitem(spark, SF)
    once = C.clean(d).table
    twice = C.clean(once).table
    assert once.count() == twice.count()
    assert twice.select([F.sum(F.col(c).isNull().cast("int")) for c in twice.columns]).first() == \
        tuple([0] * len(twice.columns))
    assert once.count() == once.dropDuplicates().count()


def test_box_whiskers_inside_fences(spark):
    b = D.box_stats(table(spark, SF, "orders"), ["o_totalprice"]).first()
    assert b["lower_fence"] <= b["whisker_low"] <= b["whisker_high"] <= b["upper_fence"]


def test_duplicate_rows_two_phase_is_exact(spark, monkeypatch):
    """Hash-first duplicate counting equals the whole-row grouping, via broadcast and shuffle joins."""
    import tablelens.operators.profile as prof
    d = dirty_lineitem(spark, SF)
    want = d.groupBy(*d.columns).count().agg(F.sum(F.col("count") - 1)).first()[0]
    assert prof.duplicate_rows(d).first()[0] == want
    monkeypatch.setattr(prof, "BROADCAST_HASHES", 0)
    assert prof.duplicate_rows(d).first()[0] == want
    nulls = spark.createDataFrame([(None, 1), (1, None), (None, 1), (None, None), (None, None)], "a int, b int")
    assert prof.duplicate_rows(nulls).first()[0] == 2


def test_drop_duplicates_hash_path_is_exact(spark, monkeypatch):
    import tablelens.operators.profile as prof
    from tablelens.operators.clean import drop_duplicates
    d = dirty_lineitem(spark, SF)
    want = sorted(tuple(r) for r in d.dropDuplicates().collect())
    assert sorted(tuple(r) for r in drop_duplicates(d).collect()) == want
    monkeypatch.setattr(prof, "BROADCAST_HASHES", 0)
    assert sorted(tuple(r) for r in drop_duplicates(d).collect()) == want
