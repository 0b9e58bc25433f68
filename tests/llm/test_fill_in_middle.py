"""Fill-in-the-middle against a plain version, on nulls, empty and very long
texts, marks in the text, repeated rows, clashing columns and an empty table."""
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tablelens.llm import fill_in_middle as M
from test_llm import SCHEMA, rows

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_version(id_, text, seed=42, rate=50, spm=80, marks=("<P>", "<S>", "<M>")):
    t = text or ""
    h = hashlib.sha256(f"{seed}:{'' if id_ is None else id_}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    u = UNIT.findall(t)
    n = len(u)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not t or any(x in t for x in marks) or h3 % 100 >= rate:
        return n, "plain", t, None, None
    if h4 % 100 < spm:
        return n, "spm", marks[1] + s + marks[0] + p + marks[2] + m, len(p), len(m)
    return n, "psm", marks[0] + p + marks[1] + s + marks[2] + m, len(p), len(m)


EXTRA = [(500 + i, t) for i, t in enumerate(
    ["a <P> b", "x<S>", "<M>", "<", "end <", "<S", "a <P", " lead", "trail \n", "\t\n", "price $1 \\0 $$", "<<S <<M <<P", "two parts here"] * 4)]


def table(spark):
    return spark.createDataFrame(rows() + [(i, t) + rows()[0][2:] for i, t in EXTRA], SCHEMA)


@pytest.mark.parametrize("how", [{}, {"seed": 7, "rate": 100, "spm_rate": 0}, {"rate": 100, "spm_rate": 100, "marks": ("$p", "\\s", "#m")}])
def test_equal_to_the_plain_version(spark, how):
    df = table(spark).withColumn("fim_form", F.lit("clash")).withColumn("__fim_clash", F.lit(1))
    marks = how.get("marks", M.MARKS)
    got = M.digests(M.fill_in_middle(df, **how), marks).withColumn("back", M.restored(F.col("fim_output"), F.col("fim_form"), marks))
    assert set(df.columns) < set(got.columns) and len(set(got.columns)) == len(got.columns)
    keys = {"rate": "rate", "spm_rate": "spm", "seed": "seed", "marks": "marks"}
    seen = set()
    for r in got.collect():
        want = plain_version(r["doc_id"], r["text"], **{keys[k]: v for k, v in how.items()})
        assert (r["fim_units"], r["fim_form"], r["fim_output"], r["fim_prefix_chars"], r["fim_middle_chars"]) == want, r["doc_id"]
        assert r["back"] == (r["text"] or "")
        assert r["restored_sha256"] == hashlib.sha256(r["back"].encode()).hexdigest()
        assert r["output_sha256"] == hashlib.sha256(want[2].encode()).hexdigest()
        seen.add(r["fim_form"])
    assert len(seen) == (3 if not how else 2)
    assert got.count() == df.count()


def test_very_long_text_and_empty_table(spark):
    long = "word 東京\U0001F600 next\n" * 60_000
    df = spark.createDataFrame([(i, long + str(i)) for i in range(4)], "doc_id long, text string")
    for r in M.fill_in_middle(df, rate=100).withColumn("back", M.restored(F.col("fim_output"), F.col("fim_form"))).collect():
        assert r["fim_units"] == 180_001 and r["back"] == r["text"]
        assert (r["fim_units"], r["fim_form"], r["fim_output"], r["fim_prefix_chars"], r["fim_middle_chars"]) == plain_version(r["doc_id"], r["text"], rate=100)
    assert M.fill_in_middle(df.limit(0)).count() == 0


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("aba", "<S>", "<M>"), ("<P>", "<P>x", "<M>"), ("", "<S>", "<M>"), ("x<", "<S>", "<M>")])
def test_ambiguous_marks_are_refused(spark, marks):
    with pytest.raises(ValueError):
        M.fill_in_middle(spark.createDataFrame([(1, "a")], "doc_id long, text string"), marks=marks)


def test_no_shuffle_and_no_python(spark):
    plan = M.digests(M.fill_in_middle(table(spark)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "InArrow" not in plan
