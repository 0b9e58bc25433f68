"""Bare random keys of 12 characters and more are found where they stand; words, names and numbers are not."""
import os
import random
import string
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from tablelens.llm import markov_secrets as m  # noqa: E402

SF = "/root/testdata/sf0.01"
ORDINARY = ["straightforward", "the_river_stone", "nationHappiness", "RIVER_LIGHT_STONE", "happy-nation-light", "internationally",
            "4929963689861572", "2024-01-15", "1700000000000", "short7Kq"]


def test_short_keys(spark):
    model = m.train(m.labelled_sample(spark.read.parquet(SF + "/documents.parquet"), spark.read.parquet(SF + "/labels.parquet")))
    rnd = random.Random(8)
    cases = []
    for n in range(12, 24):
        for letters in (string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, "0123456789abcdef"):
            cases.append(("Größe, 東京: ", "".join(rnd.choice(letters) for _ in range(n - 2)) + "Q7" if n % 2 else
                          "x9" + "".join(rnd.choice(letters) for _ in range(n - 2))))
    rows = [(a + key + " straightforward " + key + ".", len(a), len(key)) for a, key in cases]
    got = m.find_secrets(spark.createDataFrame(rows, "text string, at int, n int"), model).collect()
    found = 0
    for r in got:
        second = r["at"] + r["n"] + len(" straightforward ")
        spans = [(s["start"], s["end"]) for s in r["secret_spans"] if s["kind"] == "markov"]
        assert spans in ([], [(r["at"], r["at"] + r["n"]), (second, second + r["n"])]), r["text"]
        found += bool(spans)
    assert found >= len(rows) - 1
    plain = m.find_secrets(spark.createDataFrame([(" ".join(ORDINARY),), *[(w,) for w in ORDINARY]], "text string"), model)
    assert [r["secret_spans"] for r in plain.collect()] == [[]] * (1 + len(ORDINARY))
