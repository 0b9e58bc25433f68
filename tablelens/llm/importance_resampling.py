"""Resampling towards a target distribution (importance weights of hashed
n-grams, Gumbel top-k), the n-grams found by overlapped pattern scanning.

A text is lower-cased (A-Z) and everything between words collapses to single
spaces; a pattern of n words bounded by spaces is then scanned with
``overlapped=True``, so each match is one n-gram of the text, passed straight
to CRC-32. All of it works on UTF-8 bytes: no byte of a character beyond ASCII
is a separator. The buckets of a document's features are written once (two
bytes each); the corpus counts, the weights and the draw read that table and
never the texts again.

Counting is a histogram a task, added by bucket: a frequent word costs nothing
extra. The gains of the ``buckets`` buckets are the only table every task
holds; its size is that parameter. The draw is one range exchange of narrow
rows, and no window or task holds all of them.

Defined cases: a null text has no words, weight 0 and no rank (below the least
number of words); a null id counts as the empty string in the digest and comes
after all other ids in ties; repeated rows are scored and ranked one by one;
other columns are carried on request (``keep``), under any name; empty tables
give no rows, an empty target leaves t and T at zero.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tablelens.llm.common import ranked, stored, text_or_empty

#: every byte that no word holds becomes a space, A-Z become a-z
FOLD = bytes((c | 32) if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
FLUSH_BYTES = 4 << 20   # of buckets a batch holds before it is passed on
INNER = ["__ir_words", "__ir_features", "__ir_buckets"]


def collapsed(text: bytes) -> bytes:
    """The folded words of ``text`` with one space before and after each."""
    return b" " + b" ".join(text.translate(FOLD).split()) + b" "


def scanners(max_n: int) -> list:
    """One pattern for each n: n words between spaces, the last space looked at only."""
    import regex

    return [regex.compile(rb" ([^ ]++(?: [^ ]++){%d})(?= )" % (n - 1)) for n in range(1, max_n + 1)]


def bucket_ids(text: bytes, patterns: list, buckets: int) -> tuple[int, np.ndarray]:
    """Words of a text and the buckets of all its features."""
    t = collapsed(text)
    crcs, words = [], 0
    for i, p in enumerate(patterns):
        found = p.findall(t, overlapped=True)
        words = words or len(found)
        crcs.append(np.fromiter(map(zlib.crc32, found), np.uint32, len(found)))
        if not found:
            break
    return words, np.concatenate(crcs) % np.uint32(buckets)


def features(df: DataFrame, text_col: str = "text", keep: Sequence[Column] = (), max_n: int = 2, buckets: int = 10000) -> DataFrame:
    """``keep`` columns, number of words, number of features and the packed buckets."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must fit two bytes")
    src = df.select(*keep, F.encode(text_or_empty(text_col), "UTF-8").alias("__ir_text"))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField(INNER[0], T.LongType()),
                           T.StructField(INNER[1], T.LongType()), T.StructField(INNER[2], T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = scanners(max_n)
        for b in batches:
            at, rows, size = 0, [], 0

            def flush(to: int) -> pa.RecordBatch:
                carried = [c.slice(at, to - at) for c in b.columns[:-1]]
                mine = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))]
                return pa.RecordBatch.from_arrays([*carried, *mine], schema=pa.schema(
                    [pa.field(f.name, c.type) for f, c in zip(arrow, [*carried, *mine])]))

            for i, text in enumerate(b.columns[-1]):
                words, found = bucket_ids(text.as_py(), patterns, buckets)
                rows.append((words, len(found), found.astype("<u2").tobytes()))
                size += 2 * len(found)
                if size >= FLUSH_BYTES:
                    yield flush(i + 1)
                    at, rows, size = i + 1, [], 0
            if rows:
                yield flush(b.num_rows)

    return src.mapInArrow(scan, schema)


def bucket_counts(feats: DataFrame, buckets: int) -> np.ndarray:
    """Features a bucket over all rows: a histogram a task, added by bucket
    (``buckets`` rows reach the driver)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for x in b.column(0):
                n += np.bincount(np.frombuffer(x.as_py(), "<u2"), minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in feats.select(INNER[2]).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log of how much likelier a bucket is in the target, rounded down."""
    k, s_all, t_all = float(len(source)), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + k) / ((s + 1) * (t_all + k))))
                     for s, t in zip(source.astype(float).tolist(), target.astype(float).tolist())], dtype=np.int64)


def weighted(feats: DataFrame, gain: np.ndarray) -> DataFrame:
    """``feats`` with ``weight``, the mean gain of a row's features rounded down."""
    plain = feats.drop(INNER[2])
    schema = T.StructType([*plain.schema.fields, T.StructField("weight", T.LongType())])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = b.column(b.num_columns - 1)
            w = []
            for x in packed:
                at = np.frombuffer(x.as_py(), "<u2")
                w.append(int(gain[at].sum()) // len(at) if len(at) else 0)
            cols = [*b.columns[:-1], pa.array(w, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, schema=pa.schema(
                [pa.field(n, c.type) for n, c in zip([*b.schema.names[:-1], "weight"], cols)]))

    return feats.select(*plain.columns, INNER[2]).mapInArrow(weigh, schema)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
             keep: Sequence[str] = (), max_n: int = 2, buckets: int = 10000, seed: int = 7, percent: int = 25,
             min_words: int = 20) -> DataFrame:
    """One row per document: ``doc_id, n_features, weight, score, rank`` and the
    ``keep`` columns (as ``keep_<name>``). Of the documents with ``min_words``
    or more, ``percent`` % with the highest scores (Gumbel noise of the id added
    to the weight) get ranks 1, 2, ..., ties to the smaller id; the rest null."""
    carried = [F.col(id_col).alias("doc_id"), *[F.col(c).alias(f"keep_{c}") for c in keep]]
    feats = stored(features(docs, text_col, carried, max_n, buckets), "resampling-features")
    goal = features(target, target_text, (), max_n, buckets)
    gain = gains(bucket_counts(feats, buckets), bucket_counts(goal, buckets))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    noise = F.floor(F.lit(-1000) * F.log(-F.log(u)))
    scored = stored(weighted(feats, gain).withColumn("score", (F.col("weight") + noise).cast("long")), "resampling-scores")
    able = F.col(INNER[0]) >= min_words
    drawn = percent * scored.filter(able).count() // 100
    order = scored.filter(able).withColumns({"__ir_down": -F.col("score"), "__ir_null": F.col("doc_id").isNull()})
    placed = ranked(order, [], ["__ir_down", "__ir_null", "doc_id", INNER[1], "weight"], "__ir_rank", "resampling-order")
    rank = F.when(F.col("__ir_rank") < drawn, F.col("__ir_rank") + 1).cast("long")
    cols = ["doc_id", F.col(INNER[1]).alias("n_features"), "weight", "score"]
    more = [f"keep_{c}" for c in keep]
    return (placed.select(*cols, rank.alias("rank"), *more)
            .unionByName(scored.filter(~able).select(*cols, F.lit(None).cast("long").alias("rank"), *more)))


def drawn_documents(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The drawn rows of ``docs`` with their own columns."""
    out = resample(docs, target, keep=docs.columns, **how).filter(F.col("rank").isNotNull())
    return out.select(*[F.col(f"keep_{c}").alias(c) for c in docs.columns])


def oracle_sql() -> str:
    """The query's rows in DuckDB. CRC-32 is a fold over the bytes with the
    table that its polynomial generates."""

    def folded(table: str, id_: str) -> str:
        return (f"SELECT {id_} AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
                f"'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table}")

    both = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
WITH tab AS (
  SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS crc_of
  FROM (SELECT unnest(range(256)) AS n)),
d AS (SELECT id, len(w) AS n_words, {both} AS f FROM ({folded('documents', 'doc_id')})),
b AS (SELECT {both} AS f FROM ({folded('benchmark', 'item_id')})),
e AS (SELECT id, unnest(f) AS f FROM d), eb AS (SELECT unnest(f) AS f FROM b),
k AS (SELECT DISTINCT f FROM (SELECT f FROM e UNION ALL SELECT f FROM eb)),
h AS (SELECT f, hex(encode(f)) AS x FROM k),
g AS (SELECT f, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(CAST(length(x) / 2 AS BIGINT)),
        lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
        lambda a, c: xor(a >> 8, crc_of[CAST(xor(a, c) & 255 AS BIGINT) + 1])), 4294967295) % 10000 AS bucket FROM h, tab),
s AS (SELECT bucket, count(*) AS s FROM e JOIN g USING (f) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM eb JOIN g USING (f) GROUP BY 1),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM e) + 10000)::DOUBLE
    / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM eb) + 10000)::DOUBLE))) AS gain FROM s FULL JOIN t USING (bucket)),
w AS (SELECT id, CAST(sum(gain) AS BIGINT) AS total FROM e JOIN g USING (f) JOIN gain USING (bucket) GROUP BY 1),
r AS (
  SELECT id, n_words, CAST(len(f) AS BIGINT) AS n_features,
    CAST(CASE WHEN len(f) = 0 THEN 0 ELSE floor(total / len(f)) END AS BIGINT) AS weight,
    CAST('0x' || substr(sha256('7:' || coalesce(CAST(id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM d LEFT JOIN w USING (id)),
z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296::DOUBLE))) AS BIGINT) AS score FROM r),
p AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank, count(*) OVER () AS n FROM z WHERE n_words >= 20)
SELECT z.id AS doc_id, n_features, weight, score, CASE WHEN p.rank <= 25 * p.n // 100 THEN p.rank END AS rank
FROM z LEFT JOIN p USING (id)"""
