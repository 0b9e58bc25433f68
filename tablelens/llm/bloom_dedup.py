"""Exact dedup by two-pass Bloom filtering.

Pass 1 reads every text's SHA-256 and fills a counting Bloom filter whose
counters stop at 2. Tasks send only the bit positions they touched, packed by
filter chunk; each chunk is merged on its own, and the result is one bitmap
"touched at least twice". Pass 2 asks that bitmap: a row all of whose
positions were touched twice is *possibly repeated*; only those rows shuffle
(grouped by hash), every other row passes straight through.

The bitmap is the only thing broadcast; ``MAX_FILTER_BYTES`` bounds it. Beyond
the row count that size suits, more unique rows count as possibly repeated and
shuffle too; the answer stays exact.

Defined cases: a null text is the empty text; a null id sorts below every id;
of repeated rows with the same id and text exactly one stays; an empty table
gives an empty result; other columns are carried untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.llm.common import stored, text_or_empty

MAX_FILTER_BYTES = 64 << 20   # proven bound of the broadcast bitmap
BITS_PER_ROW = 16
PROBES = 4                    # one position in each quarter of the filter
CHUNK_BITS = 1 << 15

SHA, FLAG = "__bd_sha", "__bd_maybe"


def sha_of(text: Column | str) -> Column:
    return F.unhex(F.sha2(F.encode(text_or_empty(text), "UTF-8"), 256))


def filter_bits(rows: int, max_bytes: int = MAX_FILTER_BYTES) -> int:
    """A power of two, at least one chunk for each probe, at most the bound."""
    want = max(PROBES * CHUNK_BITS, rows * BITS_PER_ROW)
    return min(1 << (want - 1).bit_length(), max_bytes * 8)


def _positions(hashes: list[bytes], bits: int) -> np.ndarray:
    """(rows, PROBES) positions; each probe owns a quarter of the filter."""
    words = np.frombuffer(b"".join(hashes), dtype="<u8").reshape(-1, PROBES)
    quarter = bits // PROBES
    return (words & np.uint64(quarter - 1)) + (np.arange(PROBES, dtype=np.uint64) * np.uint64(quarter))


def repeated_bitmap(hashed: DataFrame, bits: int) -> bytes:
    """Pass 1: the bitmap of positions that at least two rows touched."""

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            pos, n = np.unique(_positions(b.column(0).to_pylist(), bits).ravel(), return_counts=True)
            pos = np.repeat(pos, np.minimum(n, 2))
            chunk = (pos // CHUNK_BITS).astype(np.int32)
            low = (pos % CHUNK_BITS).astype("<u2")
            edges = np.flatnonzero(np.diff(chunk)) + 1
            starts = np.concatenate([[0], edges])
            yield pa.record_batch([pa.array(chunk[starts], pa.int32()),
                                   pa.array([x.tobytes() for x in np.split(low, edges)], pa.binary())],
                                  names=["chunk", "low"])

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(CHUNK_BITS, dtype=np.int64)
        for x in pdf["low"]:
            n += np.bincount(np.frombuffer(x, "<u2"), minlength=CHUNK_BITS)
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "bitmap": [np.packbits(n >= 2, bitorder="little").tobytes()]})

    parts = (hashed.select(SHA).mapInArrow(touched, "chunk int, low binary")
             .groupBy("chunk").applyInPandas(merged, "chunk int, bitmap binary"))
    out = bytearray(bits // 8)
    step = CHUNK_BITS // 8
    for r in parts.toLocalIterator():
        out[r["chunk"] * step:(r["chunk"] + 1) * step] = r["bitmap"]
    return bytes(out)


def maybe_repeated(hashed: DataFrame, bits: int) -> Column:
    """Pass 2's test as a column over ``SHA``."""
    known = hashed.sparkSession.sparkContext.broadcast(repeated_bitmap(hashed, bits))

    @F.pandas_udf(T.BooleanType())
    def test(sha: pd.Series) -> pd.Series:
        if not len(sha):
            return pd.Series([], dtype=bool)
        bitmap = np.frombuffer(known.value, dtype=np.uint8)
        pos = _positions(list(sha), bits)
        hit = (bitmap[pos >> np.uint64(3)] >> (pos & np.uint64(7)).astype(np.uint8)) & 1
        return pd.Series(hit.all(axis=1))

    return test(F.col(SHA))


def duplicate_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     max_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``
    (of equal texts the row with the largest id stays)."""
    hashed = stored(df.select(F.col(id_col).alias("doc_id"), sha_of(F.col(text_col)).alias(SHA)), "bloom-hashes")
    marked = hashed.withColumn(FLAG, maybe_repeated(hashed, filter_bits(hashed.count(), max_bytes)))
    hexed = F.lower(F.hex(SHA)).alias("text_sha256")
    alone = marked.filter(~F.col(FLAG)).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), hexed)
    maybe = (marked.filter(FLAG).select("doc_id", SHA).repartition(F.col(SHA), F.col("doc_id"))
             .withColumn("__bd_rn", F.row_number().over(Window.partitionBy(SHA, "doc_id").orderBy("doc_id"))))
    groups = stored(maybe.groupBy(SHA).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")),
                    "bloom-groups")   # written, so that the join below can split a group with very many rows
    grouped = maybe.join(groups, SHA).select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("__bd_rn") == 1)).alias("kept"), hexed)
    return alone.unionByName(grouped)


def drop_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    max_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """The rows that stay, with the columns of ``df``. Texts that pass the
    filter never move; of the rest only each group's row with the largest id
    is shuffled and kept."""
    hashed = stored(df.select(F.col(id_col).alias("__bd_id"), sha_of(F.col(text_col)).alias(SHA)), "bloom-hashes")
    flag = maybe_repeated(hashed, filter_bits(hashed.count(), max_bytes))
    win = (hashed.filter(flag).groupBy(SHA).agg(F.max("__bd_id").alias("__bd_keep"))
           .withColumnRenamed(SHA, "__bd_win"))
    marked = df.withColumn(SHA, sha_of(F.col(text_col))).withColumn(FLAG, flag)
    maybe = marked.filter(FLAG)
    kept = (maybe.join(win, (F.col(SHA) == F.col("__bd_win")) & F.col(id_col).eqNullSafe(F.col("__bd_keep")))
            .dropDuplicates([SHA, id_col]))
    return marked.filter(~F.col(FLAG)).select(*df.columns).unionByName(kept.select(*df.columns))
