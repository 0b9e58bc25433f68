"""Exact top-k on inputs the given tables do not hold: repeated query rows,
scores beyond 2^53, vectors far from the origin."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelens.llm import cover_tree


def plain_version(ids, v, queries, k):
    out = []
    for q in queries:
        s = [sum(int(a) * int(b) for a, b in zip(v[q], r)) for r in v]
        best = sorted((-s[j], ids[j]) for j in range(len(v)) if j != q)[:k]
        out += [(ids[q], n, i, -m) for n, (m, i) in enumerate(best, 1)]
    return sorted(out)


def run(spark, ids, v, scale, step, k=5, **how):
    df = spark.createDataFrame([(int(i), [float(x) for x in r]) for i, r in zip(ids, v)], "vec_id long, embedding array<double>").repartition(3)
    return sorted(tuple(r) for r in cover_tree.top_k(df, F.col("vec_id") % step == 0, k=k, scale=scale, **how).collect())


@pytest.mark.parametrize("block_rows", [8192, 60])
def test_repeated_rows_are_queries_and_candidates_of_their_own(spark, block_rows):
    v = np.random.default_rng(1).integers(-9, 9, (200, 6))
    ids = list(range(200)) + [10, 10, 20, 7]
    v = np.vstack([v, v[10], v[10], v[33], v[7]])
    want = plain_version(ids, v, [j for j, i in enumerate(ids) if i % 10 == 0], 5)
    assert run(spark, ids, v, 1, 10, block_rows=block_rows) == want


def test_scores_beyond_what_doubles_hold(spark):
    v = np.random.default_rng(2).integers(-120_000, 120_000, (150, 64)) * 256 + 1
    assert run(spark, range(150), v, 1, 3) == plain_version(list(range(150)), v, range(0, 150, 3), 5)
    x = np.random.default_rng(2).uniform(4e4, 1.2e5, (90, 64)).astype(np.float32)
    whole = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    assert run(spark, range(90), x, 256, 3, block_rows=40) == plain_version(list(range(90)), whole, range(0, 90, 3), 5)


def test_vectors_far_from_the_origin_end(spark):
    v = 10 ** 9 + np.random.default_rng(3).integers(0, 4, (200, 8))
    assert run(spark, range(200), v, 1, 4) == plain_version(list(range(200)), v, range(0, 200, 4), 5)


def test_scores_beyond_64_bits_raise():
    with pytest.raises(OverflowError):
        cover_tree.exact_scores(np.full((1, 8), 2.0 ** 40), np.full((1, 8), 2.0 ** 40))
    low, high = np.array([[2.0 ** 40, -(2.0 ** 40)]]), np.array([[2.0 ** 40, 2.0 ** 40]])
    assert cover_tree.exact_scores(low, high)[0][0] == 0
