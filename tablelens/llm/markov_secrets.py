"""Secret scans (DataFrame and SQL functions only).

Base rules find assignments, access keys and hex strings. On top of them two
character Markov models, one of random strings and one of ordinary
identifiers, are trained: the ordinary one from words of documents labelled
good, the random one from generated strings (digests of those documents' ids).
A token whose transitions are likelier under the random model (log-likelihood
ratio above the thresholds) is reported as kind ``markov``. Tokens of 12
characters or more are judged; below 20 only those with a letter, since a card
number, a date or a time stamp is as random as a key to a model of characters.
Up to 20 transitions the sum alone decides.

The model is one table of 128 x 128 log-ratio entries, whatever the corpus;
scanning stays inside the row, so there is no shuffle and no group to skew.

Defined cases: null and empty texts hold no spans; spans are code points, end
exclusive; repeated rows are scanned one by one; other columns are carried.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import text_or_empty

# The base patterns, the part whose length counts, its least length.
BASE: list[tuple[str, str, int, int]] = [
    ("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),     # a run of 20+ characters is AKIA and 16+ more
    ("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),  # runs are maximal, so the bound may stand in the pattern
]
KINDS = [k for k, _, _, _ in BASE] + ["markov"]

# what the models judge
TOKEN = r"(?<![A-Za-z0-9+/=_-])(?:[A-Za-z0-9+/=_-]{20,}|(?=[0-9+/=_-]*[A-Za-z])[A-Za-z0-9+/=_-]{12,})"
ORDINARY = r"[A-Za-z][A-Za-z0-9]{3,}"                   # words of the ordinary sample
MIN_MEAN = 0.4     # nats a transition
MIN_SUM = 8.0      # nats in all
ALPHABET = 66      # characters a token may hold, for smoothing
SMOOTH = 0.5
SAMPLE_DOCS = 2000  # bound of the labelled sample
EMPTY = "array<struct<kind:string,start:bigint,end:bigint>>"


@dataclass(frozen=True)
class Model:
    """log P(next | char, random) - log P(next | char, ordinary), by ASCII pair, in 1/1000 nat."""
    ratio: list[int]

    def column(self) -> Column:
        return F.split(F.lit(",".join(map(str, self.ratio))), ",").cast("array<int>")


def spans_of(text: Column, kind: str, pattern: str, group: int = 0, least: int = 0,
             judge: Callable[[Column], Column] | None = None) -> Column:
    """Leftmost non-overlapping matches as spans, those whose ``group`` is long
    enough and passes ``judge``. The pieces between matches give their places:
    a match starts where the pieces and matches before it end."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    steps = F.arrays_zip(found.alias("m"), parts.alias("g"), F.split(text, pattern, -1).alias("before"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["before"])
        end = start + F.length(x["m"])
        span = F.struct(F.lit(kind).alias("kind"), start.cast("long").alias("start"), end.cast("long").alias("end"))
        keep = F.length(x["g"]) >= least if judge is None else judge(x["g"])
        return F.struct(end.cast("long").alias("at"),
                        F.when(keep, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(EMPTY).alias("out"))
    walked = F.aggregate(F.filter(steps, lambda x: x["m"].isNotNull()), zero, step, lambda a: a["out"])
    return F.when(text.rlike(pattern), walked).otherwise(F.array().cast(EMPTY))


def labelled_sample(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                    limit: int = SAMPLE_DOCS) -> DataFrame:
    """(token, random): the words of at most ``limit`` good documents, alone and
    joined the ways identifiers are (snake, camel, upper), labelled 0; for each
    of those documents strings with no structure (Base64 and hex of a digest,
    upper-case and mixed letters from it) labelled 1."""
    good = (labels.filter(F.col("quality") == 1).select(F.col(id_col).alias("__ms_id")).distinct()
            .orderBy(F.xxhash64("__ms_id")).limit(limit))
    rows = docs.join(F.broadcast(good), F.col(id_col) == F.col("__ms_id"), "left_semi").select(
        F.col(id_col).alias("__ms_id"), text_or_empty(text_col).alias("__ms_text"))
    clean = F.regexp_replace("__ms_text", r"[0-9]", " ")
    words = F.regexp_extract_all(clean, F.lit(ORDINARY), F.lit(0))
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    joined = F.filter(pairs, lambda p: p["b"].isNotNull())
    ordinary = F.concat(
        words,
        F.transform(joined, lambda p: F.concat(F.lower(p["a"]), F.lit("_"), F.lower(p["b"]))),
        F.transform(joined, lambda p: F.concat(F.lower(p["a"]), F.initcap(p["b"]))),
        F.transform(joined, lambda p: F.concat(F.upper(p["a"]), F.lit("_"), F.upper(p["b"]))),
        F.transform(joined, lambda p: F.concat(F.lower(p["a"]), F.lit("-"), F.lower(p["b"]))))
    digest = [F.sha2(F.concat_ws(":", F.lit(str(i)), F.col("__ms_id").cast("string")), 256) for i in range(8)]
    raw = [F.base64(F.unhex(d)) for d in digest[:5]]
    random = F.array(*raw, digest[5], digest[6], F.translate(F.upper(raw[0]), "+/=", "QZ7"),
                     F.translate(F.upper(raw[1]), "+/=", "KX2"), F.translate(raw[2], "+/=", "-_a"))
    return (rows.select(F.explode(ordinary).alias("token"), F.lit(0).alias("random"))
            .unionByName(rows.select(F.explode(random).alias("token"), F.lit(1).alias("random"))))


def train(sample: DataFrame) -> Model:
    """Transition counts of both labels (at most 2 x 128 x 128 rows reach the driver)."""
    pair = F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring("token", i, F.lit(2)))
    counts = (sample.filter(F.length("token") >= 2).select("random", F.explode(pair).alias("p"))
              .filter(F.col("p").rlike(r"^[\x00-\x7F]{2}$")).groupBy("random", "p").count().collect())
    n = [[0] * 16384 for _ in range(2)]
    for r in counts:
        n[r["random"]][ord(r["p"][0]) * 128 + ord(r["p"][1])] += r["count"]
    import math

    ratio = []
    for a in range(128):
        sums = [sum(n[k][a * 128:a * 128 + 128]) + SMOOTH * ALPHABET for k in (0, 1)]
        for b in range(128):
            p = [(n[k][a * 128 + b] + SMOOTH) / sums[k] for k in (0, 1)]
            ratio.append(round(1000 * math.log(p[1] / p[0])))
    return Model(ratio)


def log_ratio(token: Column, model: Model) -> Column:
    """Sum over a token's transitions, in 1/1000 nat: the token is split into
    its characters once, and each meets its neighbour."""
    table = model.column()
    chars = F.split(token, "")
    step = lambda a, b: F.when(b.isNull(), 0).otherwise(F.element_at(table, F.ascii(a) * 128 + F.ascii(b) + 1))
    steps = F.zip_with(chars, F.slice(chars, 2, F.greatest(F.length(token) - 1, F.lit(0))), step)
    return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)


def find_secrets(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with ``secret_spans`` (kind, start, end), by start, then kind as in ``KINDS``."""
    text = text_or_empty(text_col)
    out = df.withColumn("__ms_text", text)
    t = F.col("__ms_text")
    base = [spans_of(t, *rule) for rule in BASE]
    judged = spans_of(t, "markov", TOKEN, judge=lambda token: _is_random(token, model))
    out = out.withColumn("__ms_base", F.concat(*base)).withColumn("__ms_more", judged)
    order = lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))
    back = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    every = F.concat("__ms_base", "__ms_more")
    ranked = F.when(F.size(every) > 1, F.transform(F.array_sort(F.transform(every, order)), back)).otherwise(every)
    return out.withColumn("secret_spans", ranked).drop("__ms_text", "__ms_base", "__ms_more")


def _is_random(token: Column, model: Model) -> Column:
    least = F.greatest(F.lit(int(MIN_SUM * 1000)), F.lit(int(MIN_MEAN * 1000)) * (F.length(token) - 1))
    return log_ratio(token, model) >= least


def spans_text(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"] != "markov")


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``df`` with every span of ``secret_spans`` replaced by ``mark`` in the
    text (overlapping spans by one mark); rows without spans are unchanged."""
    text = F.col(text_col)

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"].cast("int") + 1, F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        fresh = (s["start"] >= acc["at"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    done = F.aggregate("secret_spans", zero, step,
                       lambda a: F.concat(a["out"], F.substring(text, a["at"].cast("int") + 1, F.length(text))))
    return df.withColumn(text_col, F.when(F.size("secret_spans") > 0, done).otherwise(text))
