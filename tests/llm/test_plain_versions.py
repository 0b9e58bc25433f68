"""Shards and the pipeline's stages against plain versions."""
import os
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline as C  # noqa: E402
from tablelens.llm import kneser_ney, markov_secrets as m  # noqa: E402
from tablelens.llm.queries import QUERIES, tokenizer_path  # noqa: E402
from test_llm import SCHEMA, labels, rows  # noqa: E402
from test_long_tokens import plain_spans  # noqa: E402


@pytest.fixture(scope="module")
def where(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plain"))
    spark.createDataFrame(rows(), SCHEMA).repartition(4).write.parquet(path + "/documents.parquet")
    labels(spark).write.parquet(path + "/labels.parquet")
    return path


def test_shards_size_checksum_and_balance(spark, where):
    got = QUERIES["op1_histogram_shards"](spark, where).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    total, size, slots = sum(r["size"] for r in got), Counter(), {}
    for r in got:
        size[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(size) <= set(range(8)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    longest = max(r["size"] for r in got)
    assert max(size.values()) <= total / 8 + longest and all(r["law"] == "bytes" and r["grown_shard"] is None for r in got)


def simhash(t):
    import xxhash

    w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def key(r):
    return tuple(r)


def test_every_stage_equals_its_plain_version(spark, where):
    docs = spark.read.parquet(where + "/documents.parquet")
    # quality: documents whose verdict is to stay
    scored = {(r["doc_id"], r["perplexity"]): r["kept"] for r in kneser_ney.classify(docs, spark.read.parquet(where + "/labels.parquet")).collect()}
    good = C.stored(C.quality(spark, docs, where), "plain-1")
    assert good.count() == sum(scored[k] * n for k, n in Counter(
        (r["doc_id"], r["perplexity"]) for r in kneser_ney.classify(docs, spark.read.parquet(where + "/labels.parquet")).collect()).items())
    # exact copies: of equal texts the largest id
    best = {}
    for r in good.collect():
        t = r["text"] or ""
        if t not in best or (r["doc_id"] is not None and (best[t] is None or r["doc_id"] > best[t])):
            best[t] = r["doc_id"]
    single = C.stored(C.exact_copies(spark, good, where), "plain-2")
    assert sorted((repr(r["doc_id"]), r["text"] or "") for r in single.collect()) == sorted((repr(i), t) for t, i in best.items())
    # near copies: the smallest id of each component
    left = [(r["doc_id"], simhash(r["text"])) for r in single.collect()]
    group = list(range(len(left)))
    for i in range(len(left)):
        for j in range(i):
            if (left[i][1] ^ left[j][1]).bit_count() <= 4:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    least = [min((left[i][0] for i in range(len(left)) if group[i] == g and left[i][0] is not None), default=None) for g in set(group)]
    apart = C.stored(C.near_copies(spark, single, where), "plain-3")
    assert sorted(map(repr, least)) == sorted(repr(r["doc_id"]) for r in apart.collect())
    # secrets: every span of the plain rules and of the plain walk is replaced
    model = m.train(m.labelled_sample(apart, spark.read.parquet(where + "/labels.parquet")))
    clean = C.stored(C.secrets(spark, apart, where), "plain-4")
    assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    want = []
    for r in apart.collect():
        t = r["text"]
        spans = [] if t is None else (
            [x.span() for x in assign.finditer(t) if len(x[2]) >= 6] + [x.span() for x in re.finditer("AKIA[A-Z0-9]+", t) if len(x[0]) >= 20]
            + [x.span() for x in re.finditer("[0-9a-f]+", t) if len(x[0]) >= 24] + plain_spans(t, model))
        out, at = "", 0
        for s, e in sorted(spans):
            if s >= at:
                out += t[at:s] + "[SECRET]"
            at = max(at, e)
        want.append((repr(r["doc_id"]), None if t is None else out + t[at:]))
    assert sorted(want, key=repr) == sorted(((repr(r["doc_id"]), r["text"]) for r in clean.collect()), key=repr)
    # packing: every piece of every document, in as few sequences as their tokens allow
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    pieces = []
    for r in clean.collect():
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        pieces += [(repr(r["doc_id"]), k // 2048, k, len(ids[k:k + 2048]), zlib.crc32(np.array(ids[k:k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)]
    packed = C.packed(spark, clean, where).collect()
    assert sorted(pieces) == sorted((repr(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed)
    assert len({r["sequence_id"] for r in packed}) == -(-sum(p[3] for p in pieces) // 2048)
    assert sorted(map(key, C.run(spark, where).select("doc_id", "piece", "length", "ids_crc32").collect()), key=repr) == sorted(
        ((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in packed), key=repr)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(path + "/documents.parquet")
    labels(spark, 0).write.parquet(path + "/labels.parquet")
    assert C.run(spark, path).count() == 0
