"""The dirty view's published figures at sf0.01 (FIXTURES §3), through the operators."""
from pyspark.sql import functions as F

from tablelens.operators import profile as P
from tablelens.sources.tables import dirty_lineitem

SF = "/root/testdata/sf0.01"


def test_dirty_view_figures(spark):
    d = dirty_lineitem(spark, SF)
    info = P.dataset_info(d).first()
    assert info["n_rows"] == 63555 and info["duplicate_rows"] == 3555
    miss = {r["column"]: r["missing"] for r in P.missing_per_column(d).collect()}
    assert 63555 - miss["quantity"] == 57848
    assert 63555 - miss["returnflag"] == 58722
    assert miss["empty_col"] == 63555
    q = {r["value"]: r["n"] for r in P.value_counts(d, ["part_text"]).where(F.col("value") == "?").collect()}
    assert q["?"] == 9226
    s = d.agg(F.sum("quantity").alias("s"), F.max("quantity").alias("m")).first()
    assert s["s"] == 1601343.0 and s["m"] == 500.0
