"""Column tiles give the same correlations as one aggregation, whatever the tile and the budget."""
import math
import random

import numpy as np
import pytest

from tablelens.functions import gram
from tablelens.operators import pairs


@pytest.mark.parametrize("tile,budget", [(256, 256 << 20), (3, 1), (5, 5000)])
def test_tiles_agree_with_the_aggregation(spark, monkeypatch, tile, budget):
    monkeypatch.setattr(gram, "TILE", tile)
    monkeypatch.setattr(gram, "BUDGET", budget)
    rnd = random.Random(7)
    k = 11
    rows = []
    for i in range(700):
        base = rnd.gauss(0, 1)
        rows.append(tuple(None if rnd.random() < 0.1 and c % 3 == 0 else 1e6 * c + base * (c + 1) + rnd.gauss(0, c) if c != 4 else 2.5 for c in range(k)))
    df = spark.createDataFrame(rows, ", ".join(f"`c.{c}` double" for c in range(k))).repartition(7)
    for diagonal in (True, False):
        a, b = ({(r["i"], r["j"]): r for r in pairs.correlation_matrix(df, diagonal=diagonal, method=m).collect()} for m in ("gram", "auto"))
        assert a.keys() == b.keys() and len(a) == (k * (k + 1) if diagonal else k * (k - 1)) // 2
        for key in a:
            assert a[key]["n"] == b[key]["n"] and a[key]["col_a"] == b[key]["col_a"]
            x, y = a[key]["r"], b[key]["r"]
            assert (x is None) == (y is None) and (x is None or math.isclose(x, y, abs_tol=1e-9)), key
    assert pairs.correlation_matrix(df.limit(0), method="gram").count() in (0, k * (k + 1) // 2)


def test_memory_of_a_scan_is_bounded():
    scans = gram.tile_scans(5000, 256, 256 << 20)
    assert sum(map(len, scans)) == 20 * 21 // 2 and max(map(len, scans)) * 6 * 256 * 256 * 8 <= 256 << 20
    assert np.prod([len(scans)]) == 3
