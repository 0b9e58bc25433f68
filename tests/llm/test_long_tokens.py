"""The Markov judgement walks a token once: one of a megabyte takes seconds,
and the spans equal a plain version's."""
import random
import re
import string
import time

from tablelens.llm import markov_secrets as m
from test_short_keys import SF


def plain_spans(text, model):
    out = []
    for x in re.finditer(m.TOKEN, text):
        t = x[0]
        total = sum(model.ratio[ord(a) * 128 + ord(b)] for a, b in zip(t, t[1:]))
        if total >= max(int(m.MIN_SUM * 1000), int(m.MIN_MEAN * 1000) * (len(t) - 1)):
            out.append((x.start(), x.end()))
    return out


def test_long_tokens_and_plain_version(spark):
    model = m.train(m.labelled_sample(spark.read.parquet(SF + "/documents.parquet"), spark.read.parquet(SF + "/labels.parquet")))
    rnd = random.Random(3)
    key = lambda n: "".join(rnd.choice(string.ascii_letters + string.digits + "+/") for _ in range(n))
    texts = [" ".join(rnd.choice([key(rnd.randrange(1, 60)), "ordinaryIdentifier_name", "the river stone", "a=b", "1700000000000"]) for _ in range(40)) for _ in range(30)]
    texts += [key(1_000_000), "see " + key(200_000) + " end", "word_" * 50_000, "", None, "short"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    m.find_secrets(df.limit(3), model).collect()   # compiled before the clock starts
    start = time.time()
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["secret_spans"] if s["kind"] == "markov"] for r in m.find_secrets(df, model).collect()}
    assert time.time() - start < 25
    for i, t in enumerate(texts):
        assert got[i] == plain_spans(t or "", model), i
