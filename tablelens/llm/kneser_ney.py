"""Quality classifier: an interpolated modified Kneser-Ney character n-gram model.

The model of each language is trained on its trusted text (documents labelled
good); every document gets its perplexity under the model of its language, and
documents above a language's threshold are rejected. The threshold is a
quantile of the perplexities of trusted documents that were held out of
training, with a margin.

How the counting is sharded: texts are dealt once into blocks (compressed).
Blocks count the 4-grams of their trusted texts and ask for the probabilities
of the distinct 4-grams of all their texts. Counts and questions go to the
shard of the 4-gram's third character: everything interpolation needs (the
4-gram, its context, the 3-gram and 2-gram it backs off to, and their
continuation counts) has that character at the same place, so one shard has it
all; the single-character table and the discounts are a few rows a language.
A shard with many questions is dealt again by block. The answers go back to
the blocks, which sum them along their texts. Blocks, counts and answers use
one exchange of the texts. What the model gathers grows with the trusted text.

A limit of the method: perplexity is the only verdict. Toxic words in fluent
text hardly move it, so nearly all such documents are kept (README has the
measured recall); this is no toxicity filter.

Characters beyond U+FFFF share 2,048 codes (a 4-gram is one 64-bit number).

Defined cases: a null or empty text has no perplexity and is kept (nothing
speaks against it); a null language is a language of its own; a language with
no trusted text has no model: its perplexities are null and its documents are
kept; a language whose held-out documents are fewer than ``MIN_HELD`` takes
the threshold of all languages together; contradictory labels of one id count
as not trusted; repeated rows are scored each; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelens.llm.common import stored

ORDER = 4
SHARDS = 48              # of the model, by third character
BLOCK_CHARS = 12_000_000
ASKS_A_TASK = 64         # blocks whose questions meet one copy of a shard
CHUNK = 1_000_000        # characters looked at together
HELD_OUT = 5             # every fifth trusted document (by hash) sets thresholds instead of training
MIN_HELD = 20
QUANTILE = 0.99
MARGIN = 1.15            # times the quantile
STEP = 0.001             # width of the perplexity histogram's bins, in nats

NO_ID = -(1 << 63)       # a null id inside the joins

U16 = np.uint64(16)


def codes(text: str) -> np.ndarray:
    """16-bit codes of a text's characters, three starts (0) in front."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    cp = np.where(cp > 0xFFFF, np.uint64(0xD800) + cp % np.uint64(2048), cp)
    return np.concatenate([np.zeros(ORDER - 1, dtype=np.uint64), cp])


def grams(text: str) -> np.ndarray:
    """The 4-gram that ends at each character, as one 64-bit number."""
    c = codes(text)
    two = (c[:-1] << U16) | c[1:]
    return (two[:-2] << np.uint64(32)) | two[2:]


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    third = (keys >> U16) & np.uint64(0xFFFF)
    return ((third * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(shards)


def _chunks(texts: list[str]) -> Iterator[list[np.ndarray]]:
    """4-grams of texts, some million characters at a time."""
    held, size = [], 0
    for t in texts:
        for g in ([grams(t)] if len(t) <= CHUNK else _long(t)):
            held.append(g)
            size += len(g)
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def _long(text: str) -> Iterator[np.ndarray]:
    g = grams(text)
    for at in range(0, len(g), CHUNK):
        yield g[at:at + CHUNK]


def _distinct(texts: list[str]) -> np.ndarray:
    parts = [pd.unique(np.concatenate(c)) for c in _chunks(texts)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.uint64)


def _counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = [], []
    for c in _chunks(texts):
        code, uniq = pd.factorize(np.concatenate(c))
        keys.append(uniq)
        n.append(np.bincount(code, minlength=len(uniq)))
    if not keys:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return summed(np.concatenate(keys), np.concatenate(n))


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _by_shard(keys: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places) with the keys' order kept inside a shard."""
    s = shard_of(keys, shards)
    order = np.argsort(s, kind="stable")
    cuts = np.flatnonzero(np.diff(s[order])) + 1
    for places in np.split(order, cuts):
        if len(places):
            yield int(s[places[0]]), places


class ShardCounts:
    """A shard's 4-grams with counts, and the continuation counts below them."""

    def __init__(self, keys: np.ndarray, n: np.ndarray) -> None:
        tri, tri_n = np.unique(keys & np.uint64(0xFFFFFFFFFFFF), return_counts=True)
        bi, bi_n = np.unique(tri & np.uint64(0xFFFFFFFF), return_counts=True)
        self.levels = [(keys, n), (tri, tri_n), (bi, bi_n)]     # orders 4, 3, 2

    def totals(self) -> pd.DataFrame:
        """Rows (order, key, n): how many n-grams have count 1..4 (key), and, as
        order 1, how many 2-grams end in each character (key)."""
        rows = []
        for order, (_, n) in zip((4, 3, 2), self.levels):
            rows += [(order, k, int((n == k).sum())) for k in (1, 2, 3, 4)]
        last, n = np.unique(self.levels[2][0] & np.uint64(0xFFFF), return_counts=True)
        rows += [(1, int(c), int(k)) for c, k in zip(last, n)]
        return pd.DataFrame(rows, columns=["order", "key", "n"])


def discounts(n: list[float]) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more, from how many have count 1..4."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not (n1 and n2 and n3 and n4):
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0, *[min(max(x, 0.05), k) for x, k in zip(d, (0.95, 1.95, 2.95))]])


class LanguageTotals:
    """Discounts and single-character probabilities of a language."""

    def __init__(self, rows: list[tuple[int, int, int]]) -> None:
        of = {(o, k): n for o, k, n in rows}
        self.discount = {o: discounts([of.get((o, k), 0) for k in (1, 2, 3, 4)]) for o in (4, 3, 2)}
        chars = sorted(k for o, k in of if o == 1)
        n = np.array([of[(1, k)] for k in chars], dtype=np.float64)
        d = discounts([float((n == k).sum()) for k in (1, 2, 3, 4)])
        cut = d[np.minimum(n, 3).astype(np.int64)]
        self.chars = np.array(chars, dtype=np.uint64)
        self.rest = float(cut.sum() / n.sum() / (len(chars) + 1)) if len(chars) else 1.0   # also what an unseen character gets
        self.p = (n - cut) / n.sum() + self.rest if len(chars) else n

    def unigram(self, c: np.ndarray) -> np.ndarray:
        if not len(self.chars):
            return np.full(len(c), self.rest)
        at = np.minimum(np.searchsorted(self.chars, c), len(self.chars) - 1)
        return np.where(self.chars[at] == c, self.p[at], self.rest)


def log_probability(counts: ShardCounts, totals: LanguageTotals, asked: np.ndarray) -> np.ndarray:
    """log P(last character | three before) of 4-grams of this shard."""
    p = totals.unigram(asked & np.uint64(0xFFFF))
    for order, mask, (keys, n) in ((2, 0xFFFFFFFF, counts.levels[2]), (3, 0xFFFFFFFFFFFF, counts.levels[1]),
                                   (4, 0xFFFFFFFFFFFFFFFF, counts.levels[0])):
        d = totals.discount[order]
        cut = d[np.minimum(n, 3)]
        context = keys >> U16
        if not len(keys):
            continue
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        total, left, names = np.add.reduceat(n, first), np.add.reduceat(cut, first), context[first]
        ask = asked & np.uint64(mask)
        at = np.minimum(np.searchsorted(keys, ask), len(keys) - 1)
        own = np.where(keys[at] == ask, n[at] - cut[at], 0.0)
        c = np.minimum(np.searchsorted(names, ask >> U16), len(names) - 1)
        seen = names[c] == ask >> U16
        p = np.where(seen, own / total[c] + left[c] / total[c] * p, p)
    return np.log(p)


# ---- the Spark side ----

def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    z = zstandard.ZstdCompressor(level=3)
    for b in batches:
        packed = [z.compress((t or "").encode("utf-8", "surrogatepass")) for t in b.column(4).to_pylist()]
        yield pa.record_batch([*b.columns[:4], pa.array(packed, pa.binary())], names=["block", "id", "th", "lang", "z"])


def _texts(z: pd.Series | pa.ChunkedArray) -> list[str]:
    import zstandard

    d = zstandard.ZstdDecompressor()
    return [d.decompress(x).decode("utf-8", "surrogatepass") for x in z]


def _languages(pdf: pd.DataFrame) -> Iterator[tuple[str, pd.DataFrame]]:
    yield from sorted(pdf.groupby("lang"), key=lambda x: x[0])


def _train_block(shards: int):
    def run(docs: pd.DataFrame, labels: pd.DataFrame) -> pd.DataFrame:
        rows = []
        good = docs[docs["id"].isin(labels.loc[labels["train"], "id"])] if len(docs) and len(labels) else docs.iloc[:0]
        for lang, part in _languages(good):
            keys, n = _counted(_texts(part["z"]))
            rows.append(pd.DataFrame({"shard": shard_of(keys, shards).astype(np.int32), "lang": lang, "key": keys.view(np.int64), "n": n}))
        return pd.concat(rows) if rows else pd.DataFrame(columns=["shard", "lang", "key", "n"])

    return run


def _table(rows) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 4-grams and counts of a shard's rows (none: a shard no trusted text reached)."""
    rows = [] if rows is None else rows
    keys = np.array([r["key"] for r in rows], dtype=np.int64).view(np.uint64)
    n = np.array([r["n"] for r in rows], dtype=np.int64)
    order = np.argsort(keys)
    return keys[order], n[order]


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lang, grams_ in zip(b.column(0).to_pylist(), b.column(1)):
            t = ShardCounts(*_table(grams_.as_py())).totals()
            yield pa.record_batch([pa.array([lang] * len(t)), pa.array(t["order"], pa.int32()), pa.array(t["key"], pa.int32()),
                                   pa.array(t["n"], pa.int64())], names=["lang", "order", "key", "n"])


def _ask_block(shards: int):
    def run(docs: pd.DataFrame) -> pd.DataFrame:
        rows, block = [], int(docs["block"].iloc[0])
        for lang, part in _languages(docs):
            keys = _distinct(_texts(part["z"]))
            rows += [(shard, block // ASKS_A_TASK, block, lang, keys[at].tobytes()) for shard, at in _by_shard(keys, shards)]
        return pd.DataFrame(rows, columns=["shard", "salt", "block", "lang", "asked"])

    return run


def _answer(asks: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
    rows = []
    if len(model):
        m = model.iloc[0]
        counts = ShardCounts(*_table(m["grams"]))
        totals = LanguageTotals([(r["order"], r["key"], r["n"]) for r in m["totals"]])
        for block, lang, shard, asked in zip(asks["block"], asks["lang"], asks["shard"], asks["asked"]):
            p = log_probability(counts, totals, np.frombuffer(asked, dtype=np.uint64))
            rows.append((block, lang, shard, p.astype(np.float32).tobytes()))
    return pd.DataFrame(rows, columns=["block", "lang", "shard", "logp"])


def _score_block(shards: int):
    def run(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        for lang, part in _languages(docs):
            texts = _texts(part["z"])
            own = answers[answers["lang"] == lang]
            answered = dict(zip(own["shard"], own["logp"]))
            known = bool(answered)     # a model has every shard of its language
            keys = _distinct(texts)
            logp = np.zeros(len(keys))
            if known:
                for shard, at in _by_shard(keys, shards):
                    logp[at] = np.frombuffer(answered[shard], dtype=np.float32)
            total = np.zeros(len(texts))
            long = np.array([len(t) for t in texts])
            sums: list[float] = []
            for chunk in _chunks(texts):
                code, uniq = pd.factorize(np.concatenate(chunk))
                p = logp[np.searchsorted(keys, uniq)][code]
                cut = np.cumsum([0] + [len(c) for c in chunk])
                sums += [float(p[a:b].sum()) for a, b in zip(cut[:-1], cut[1:])]
            pieces = [max(1, -(-int(n) // CHUNK)) for n in long]
            at = 0
            for doc, k in enumerate(pieces):
                total[doc] = sum(sums[at:at + k])
                at += k
            ppl = np.where((long > 0) & known, np.exp(-total / np.maximum(long, 1)), np.nan)
            out.append(pd.DataFrame({"id": part["id"].to_numpy(), "th": part["th"].to_numpy(), "lang": lang, "n_chars": long, "ppl": ppl}))
        return pd.concat(out) if out else pd.DataFrame(columns=["id", "th", "lang", "n_chars", "ppl"])

    return run


def trusted_labels(labels: DataFrame) -> DataFrame:
    """(id, train): ids all of whose labels say good and none toxic; ``train``
    is False for the held-out ones."""
    good = F.when((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0), 1).otherwise(0)
    ids = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min(good).alias("good")).filter(F.col("good") == 1)
    held = F.pmod(F.xxhash64(F.col("id"), F.lit("held")), F.lit(HELD_OUT)) == 0
    return ids.filter(F.col("id").isNotNull()).select("id", (~held).alias("train"))


def _keyed(df: DataFrame, id_col: str, text_col: str) -> tuple:
    return (F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), F.xxhash64(F.col(text_col).cast("string")))


def scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
           shards: int = SHARDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, th, lang, n_chars, ppl) for every row; ``th`` is a hash of the text."""
    blocks = df.agg(F.coalesce(F.sum(F.length(F.col(text_col).cast("string"))), F.lit(0))).first()[0] // block_chars + 1
    id_, th = _keyed(df, id_col, text_col)
    at = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("long"), th)), F.lit(blocks)).cast("int")
    texts = (df.select(at.alias("block"), id_.alias("id"), th.alias("th"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
                       F.col(text_col).cast("string").alias("text"))
             .mapInArrow(_pack, "block int, id long, th long, lang string, z binary").repartition(blocks, "block"))
    trusted = trusted_labels(labels)
    dealt = trusted.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    grams4 = (texts.groupBy("block").cogroup(dealt.groupBy("block"))
              .applyInPandas(_train_block(shards), "shard int, lang string, key long, n long")
              .groupBy("shard", "lang", "key").agg(F.sum("n").alias("n")))
    model = grams4.groupBy("shard", "lang").agg(F.collect_list(F.struct("key", "n")).alias("grams"))
    totals = (model.select("lang", "grams").mapInArrow(_totals, "lang string, order int, key int, n long")
              .groupBy("lang", "order", "key").agg(F.sum("n").alias("n"))
              .groupBy("lang").agg(F.collect_list(F.struct("order", "key", "n")).alias("totals")))   # 65,536 characters at most
    every = totals.select(F.col("lang").alias("l"), "totals", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s"))
    full = every.join(model, (every["s"] == model["shard"]) & (every["l"] == model["lang"]), "left").select(
        F.col("s").alias("shard"), F.col("l").alias("lang"), "grams", "totals",
        F.explode(F.sequence(F.lit(0), F.lit((blocks - 1) // ASKS_A_TASK))).alias("salt"))
    asks = texts.groupBy("block").applyInPandas(_ask_block(shards), "shard int, salt int, block int, lang string, asked binary")
    answers = (asks.groupBy("shard", "lang", "salt").cogroup(full.groupBy("shard", "lang", "salt"))
               .applyInPandas(_answer, "block int, lang string, shard int, logp binary"))
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(
        _score_block(shards), "id long, th long, lang string, n_chars long, ppl double")


def thresholds(scored: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """(lang, threshold): of each language, and for lang null of all together.
    The quantile is read off a histogram of log perplexity (bins of ``STEP``)."""
    held = trusted_labels(labels).filter(~F.col("train")).select("id")
    ppl = scored.filter(F.col("ppl").isNotNull()).join(held, "id", "left_semi")
    cells = ppl.groupBy("lang", F.floor(F.log("ppl") / STEP).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    cells = cells.unionByName(cells.groupBy("bin").agg(F.sum("n").alias("n")).withColumn("lang", F.lit(None).cast("string")))
    w = Window.partitionBy("lang")
    run = cells.withColumn("below", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    edge = F.min(F.when(F.col("below") >= F.col("all") * F.lit(quantile), F.col("bin")))
    return run.groupBy("lang").agg(edge.alias("bin"), F.max("all").alias("n")).filter(
        F.col("lang").isNull() | (F.col("n") >= MIN_HELD)).select(
        "lang", (F.exp((F.col("bin") + 1) * F.lit(STEP)) * F.lit(margin)).alias("threshold"))


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """One row per input row: ``doc_id, th, lang, n_chars, perplexity, threshold, kept``."""
    scored = stored(scores(df, labels, id_col, text_col, lang_col), "kn-scores")
    limits = {r["lang"]: r["threshold"] for r in thresholds(scored, labels, quantile, margin).collect()}   # one row a language
    limit = F.lit(limits.pop(None, None)).cast("double")
    for lang, t in limits.items():
        limit = F.when(F.col("lang") == F.lit(lang), F.lit(t)).otherwise(limit)
    out = scored.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "th", "lang", "n_chars",
                        F.col("ppl").alias("perplexity"), limit.alias("threshold"))
    return out.withColumn("kept", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``df`` that the classifier keeps, with their columns."""
    bad = classify(df, labels, id_col, text_col, lang_col).filter(~F.col("kept"))
    bad = bad.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("__kn_id"), F.col("th").alias("__kn_th")).distinct()
    id_, th = _keyed(df, id_col, text_col)
    return (df.withColumn("__kn_i", id_).withColumn("__kn_t", th)
            .join(bad, (F.col("__kn_i") == F.col("__kn_id")) & (F.col("__kn_t") == F.col("__kn_th")), "left_anti").select(*df.columns))
