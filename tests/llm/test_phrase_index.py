"""The positional index against a plain version: nulls, empty, short and
repeated items, long texts, ties, equal rows, proximity and empty tables."""
import random
import re

import pytest
from pyspark.sql import functions as F

from tablelens.llm import phrase_index as P
from test_llm import SCHEMA, rows

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def windows(t, k):
    w = words(t)
    k = min(k, len(w))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()


def plain_version(docs, items, window):
    every = {}
    for i, t in items:
        for p in windows(t, window):
            every.setdefault(p, set()).add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, named = words(t), set(), set()
        for s in range(len(w)):
            for k in {len(p) for p in every}:
                if s + k <= len(w) and tuple(w[s:s + k]) in every:
                    hit.update(range(s, s + k))
                    named |= every[tuple(w[s:s + k])]
        out.append((i, len(w), len(hit), len(named), sorted(named)))
    return sorted(out, key=repr)


def items_of(data):
    t = [r[1] for r in data]
    return [(1, " ".join(words(t[0])[5:40])), (2, t[1]), (3, None), (4, ""), (5, "one two"), (6, "GO"), (7, "go go " * 8),
            (8, " ".join(words(t[2])[:9])), (9, " ".join(words(t[0])[5:40])), (9, t[4]), (None, t[6]), (10, "ünknown word here"),
            (11, " ".join(words(t[3])[10:20]) + " unseen7 " + " ".join(words(t[3])[21:31])), (12, "--")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).withColumn("row", F.lit("clash")).withColumn("term", F.lit(1)).repartition(4)


def digest(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("window", [10, 3, 1])
def test_equal_to_the_plain_version(spark, docs, window):
    items = spark.createDataFrame(items_of(rows()), "item_id long, text string").withColumn("word", F.lit("clash"))
    want = plain_version([(r[0], r[1]) for r in rows()], items_of(rows()), window)
    assert sum(r[2] for r in want) > 50
    assert digest(P.contamination(docs, items, window)) == want


def test_vocabulary_beyond_a_broadcast(spark, docs, monkeypatch):
    monkeypatch.setattr(P, "BROADCAST_TERMS", 3)
    items = spark.createDataFrame(items_of(rows()), "item_id long, text string")
    assert digest(P.contamination(docs, items)) == plain_version([(r[0], r[1]) for r in rows()], items_of(rows()), 10)


def test_index_of_all_words_answers_any_items(spark, docs):
    index = P.build(docs)
    n = sum(len(words(r[1])) for r in rows())
    assert index.lists().count() == n and index.headers().agg(F.sum("n_words")).first()[0] == n
    items = spark.createDataFrame(items_of(rows()), "item_id long, text string")
    wanted = P.phrases(items, 10)
    few = P.matches(P.build(docs, wanted.words), wanted).count()
    assert few > 0 and P.matches(index, wanted).count() == few


@pytest.mark.parametrize("slop", [1, 2])
def test_proximity(spark, slop):
    rnd = random.Random(slop)
    data = [(i, " ".join(rnd.choice("abcdefg") for _ in range(rnd.randrange(1, 60)))) for i in range(40)]
    items = [(1, "a b c d"), (2, "g f"), (3, "e"), (4, "b b a")]
    index = P.build(spark.createDataFrame(data, "doc_id long, text string").repartition(3))
    wanted = P.phrases(spark.createDataFrame(items, "item_id long, text string"), 4)
    order = {}
    for r in P.by_rarity(index, wanted).collect():
        order.setdefault(r["phrase"], []).append((r["turn"], r["offset"]))
    text = {}
    for r in wanted.words.collect():
        text.setdefault(r["phrase"], {})[r["offset"]] = r["word"]
    want = []
    for i, t in data:
        w = t.split()
        for phrase, offsets in text.items():
            first = min(order[phrase])[1]
            for at, x in enumerate(w):
                if x != offsets[first]:
                    continue
                start, far = at - first, []
                for o, y in offsets.items():
                    near = [abs(d) for d in range(-slop, slop + 1) if 0 <= start + o + d < len(w) and w[start + o + d] == y]
                    far.append(0 if o == first else min(near) if near else None)
                if None not in far:
                    want.append((i, phrase, start, max(far)))
    got = P.matches(index, wanted, slop).join(index.headers(), "row").select("doc_id", "phrase", "start", "distance")
    assert digest(got) == sorted(want, key=repr)
    exact = digest(P.matches(index, wanted).join(index.headers(), "row").select("doc_id", "phrase", "start", "distance"))
    assert exact == sorted((r for r in want if r[3] == 0), key=repr)


def test_empty_tables_and_long_texts(spark, docs):
    items = spark.createDataFrame(items_of(rows()), "item_id long, text string")
    assert P.contamination(docs.limit(0), items).count() == 0
    none = P.contamination(docs, items.limit(0)).collect()
    assert len(none) == len(rows()) and all(r["n_hit"] == 0 and r["items"] == [] for r in none)
    long = [(1, "go " * 30000), (2, "stone river " * 20000 + "the end of it all is near my dear old friend"), (3, None)]
    bench = [(1, "go go go go go go go go go go go go"), (2, "end of it all is near my dear old friend")]
    got = digest(P.contamination(spark.createDataFrame(long, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")))
    assert got == [(1, 30000, 30000, 1, ["1"]), (2, 40011, 10, 1, ["2"]), (3, 0, 0, 0, [])]


def test_native_plan(spark, docs):
    items = spark.createDataFrame(items_of(rows()), "item_id long, text string")
    plan = P.contamination(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
