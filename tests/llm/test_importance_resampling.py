"""Importance resampling against a plain version, on nulls, empty texts, ties,
repeated rows, clashing columns and empty tables."""
import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablelens.llm import importance_resampling as R
from test_llm import SCHEMA, rows

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def feats(t, max_n, buckets):
    w = words(t)
    return [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]


def plain_version(docs, target, max_n=2, buckets=10000, seed=7, percent=25, least=20):
    f = [feats(t, max_n, buckets) for _, t in docs]
    s, t = Counter(b for x in f for b in x), Counter(b for x in target for b in feats(x, max_n, buckets))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (S + buckets) / ((s[b] + 1.0) * (T + buckets)))) for b in range(buckets)]
    out = []
    for (i, text), x in zip(docs, f):
        weight = sum(gain[b] for b in x) // len(x) if x else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(x), weight, score, None, len(words(text))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(able[:percent * len(able) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize("how", [{}, {"max_n": 3, "buckets": 97, "percent": 60, "min_words": 3}, {"max_n": 1, "seed": 1, "percent": 100, "min_words": 0}])
def test_equal_to_the_plain_version(spark, how):
    data = rows()
    docs = spark.createDataFrame(data, SCHEMA).withColumn("rank", F.lit("clash")).withColumn("__ir_words", F.lit("c")).withColumn("weight", F.lit(1)).repartition(4)
    goal = [r[1] for r in data[:5]] + [None, "", "stone river"]
    target = spark.createDataFrame([(g,) for g in goal], "text string")
    got = R.resample(docs, target, **how).collect()
    named = {"max_n": "max_n", "buckets": "buckets", "percent": "percent", "min_words": "least", "seed": "seed"}
    want = plain_version([(r[0], r[1]) for r in data], goal, **{named[k]: v for k, v in how.items()})
    assert sorted((tuple(r) for r in got), key=repr) == want
    chosen = R.drawn_documents(docs, target, **how)
    assert chosen.columns == docs.columns
    assert sorted(repr(r["doc_id"]) for r in chosen.collect()) == sorted(repr(r[0]) for r in want if r[4] is not None)


def test_scan_of_ngrams_is_whole():
    text = "A b,c--Äd 7x\x00\x7f 東京 e'f " * 50
    n, got = R.bucket_ids(text.encode(), R.scanners(3), 1 << 16)
    assert n == len(words(text)) and sorted(got.tolist()) == sorted(feats(text, 3, 1 << 16))
    for t in ("", " \n", "one", "one two"):
        n, got = R.bucket_ids(t.encode(), R.scanners(2), 1000)
        assert n == len(t.split()) and sorted(got.tolist()) == sorted(feats(t, 2, 1000))


def test_empty_tables_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(R, "FLUSH_BYTES", 3000)   # many batches
    long = [(i, ("deep river stone " * 9000) + str(i)) for i in range(5)] + [(9, None)] + [(20 + i, "w%d " % i * 25) for i in range(9)]
    docs = spark.createDataFrame(long, "doc_id long, text string").coalesce(1)
    empty = spark.createDataFrame([], "text string")
    assert sorted((tuple(r) for r in R.resample(docs, empty).collect()), key=repr) == plain_version(long, [])
    assert R.resample(docs.limit(0), docs).count() == 0
    with pytest.raises(ValueError):
        R.features(docs, buckets=70000)


def test_equal_scores_go_to_the_smaller_id(spark):
    data = [(i, "same words in every text " * 5) for i in range(40)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(7)
    got = R.resample(docs, docs, percent=50)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_version(data, [t for _, t in data], percent=50)
    assert sorted(r["rank"] for r in got.where("rank is not null").collect()) == list(range(1, 21))
