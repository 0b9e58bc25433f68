"""Top-k with rows without an id, and with more queries than one group holds."""
import os
import sys

import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from tablelens.llm import cover_tree  # noqa: E402


def test_null_ids_and_query_groups(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "QUERY_ROWS", 7)
    x = np.random.default_rng(6).normal(size=(200, 8)).astype(np.float32)
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(None, [9.0] * 8), (None, (x[0] * 50).tolist())]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in cover_tree.top_k(df, F.col("vec_id") % 4 == 0, k=3, block_rows=60).collect())
    v = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    want = []
    for q in range(0, len(v), 4):
        best = sorted((-int(n), j) for j, n in enumerate(v @ v[q]) if j != q)[:3]
        want += [(q, r, j, -n) for r, (n, j) in enumerate(best, 1)]
    assert got == sorted(want)
