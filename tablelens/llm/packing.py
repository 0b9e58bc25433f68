"""Vector best-fit packing of tokenised documents into sequences.

Documents are tokenised inside tasks (the ids of a text are the ids of its
space-separated words in a row, since the tokenizer drops white space and no
token crosses it; a bounded per-worker table remembers words). The tokenizer is
used as its file sets it up: special strings in a text (``<|endoftext|>``) give
their own ids. Longer documents are cut into pieces of the token capacity.

A bin has three capacities: tokens, documents and attention cost (the sum of
squared piece lengths). Pieces of one length are interchangeable, so the plan
is made on the histogram of lengths (at most ``tokens`` rows, whatever the
corpus): lengths from long to short, each put into the open kind of bin that
fits under every constraint with the smallest weighted residual norm (or the
largest weighted dot product), as many bins of a kind at a time as the count
allows. That is best fit over all pieces of the corpus, not per task. The plan
is a short table (bounded by lengths and patterns) and is broadcast; every
piece finds its place from its rank among the pieces of its length.

Defined cases: a null text is the empty text (one end token); repeated rows
are packed each; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import ranked, stored

WORDS_KEPT = 1_200_000   # words a worker remembers (about 200 MB); beyond it starts anew
LONGEST_KEPT = 64        # characters of a word that is remembered
END_ID = 0

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordTokenizer:
    """Ids of whole texts (little-endian unsigned 32-bit) by way of their words."""

    _made: dict[str, "WordTokenizer"] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}

    @classmethod
    def of(cls, path: str) -> "WordTokenizer":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def ids(self, texts: list[str | None]) -> Iterator[bytes]:
        if len(self.known) > WORDS_KEPT:
            self.known = {"": b""}
        for text in texts:
            words = (text or "").replace("\n", " ").split(" ")
            known = self.known
            new = list({w for w in words if w not in known})
            if new:
                found = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
                fresh = {w: np.array(e.ids, dtype="<u4").tobytes() for w, e in zip(new, found)}
                if max(map(len, new)) > LONGEST_KEPT:
                    known = {**{w: known[w] for w in set(words) if w in known}, **fresh}
                    self.known.update({w: b for w, b in fresh.items() if len(w) <= LONGEST_KEPT})
                else:
                    known.update(fresh)
            yield b"".join(map(known.__getitem__, words))


def token_pieces(df: DataFrame, tokenizer_path: str, tokens: int, id_col: str = "doc_id", text_col: str = "text",
                 with_ids: bool = False) -> DataFrame:
    """The pieces of every document; ``with_ids`` adds their ids (binary)."""
    schema = PIECES + (", ids binary" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = WordTokenizer.of(tokenizer_path)
        end = np.array([END_ID], dtype="<u4").tobytes()
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for doc, ids in zip(b.column(0).to_pylist(), made.ids(b.column(1).to_pylist())):
                ids += end
                for p, at in enumerate(range(0, len(ids), 4 * tokens)):
                    part = ids[at:at + 4 * tokens]
                    for col, v in zip(cols, (doc, p, at // 4, len(part) // 4, zlib.crc32(part), part)):
                        col.append(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            k = 6 if with_ids else 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols[:k], kinds[:k])], names=names[:k])

    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(cut, schema)


@dataclass(frozen=True)
class Capacity:
    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], dtype=np.int64)


def best_fit_plan(counts: dict[int, int], cap: Capacity, weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3),
                  rule: str = "norm") -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Bins by content: ``(((length, how many), ...), bins)``, lengths falling."""
    full = cap.vector()
    w = np.array(weights)
    room = np.zeros((0, 3), dtype=np.int64)      # residual capacities of each kind of bin
    bins: list[int] = []                          # how many of the kind
    holds: list[tuple[tuple[int, int], ...]] = []
    live = np.zeros(0, dtype=bool)
    free: list[int] = []

    def add(left: np.ndarray, content: tuple[tuple[int, int], ...], n: int) -> None:
        nonlocal room, live
        if not free:
            grow = max(64, len(room))
            free.extend(range(len(room) + grow - 1, len(room) - 1, -1))
            room = np.vstack([room, np.zeros((grow, 3), dtype=np.int64)])
            live = np.concatenate([live, np.zeros(grow, dtype=bool)])
            bins.extend([0] * grow)
            holds.extend([()] * grow)
        i = free.pop()
        room[i], live[i], bins[i], holds[i] = left, True, n, content

    done: list[tuple[tuple[tuple[int, int], ...], int]] = []
    for length in sorted(counts, reverse=True):
        item = np.array([length, 1, length * length], dtype=np.int64)
        if (item > full).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacities {cap}")
        n = counts[length]
        while n:
            fits = np.flatnonzero(live & (room >= item).all(axis=1))
            if len(fits):
                rest = (room[fits] - item) / full
                score = -((rest * rest) @ w) if rule == "norm" else (room[fits] / full * (item / full)) @ w
                i = int(fits[np.argmax(score)])
                left, content, have = room[i].copy(), holds[i], bins[i]
            else:
                i, left, content, have = -1, full.copy(), (), n
            each = int(min(left[0] // length, left[1], left[2] // (length * length)))
            whole = min(have, n // each)
            if whole:
                add(left - each * item, (*content, (length, each)), whole)
                n -= whole * each
            used = whole
            if n and used < have:     # fewer than a bin's worth is left
                add(left - n * item, (*content, (length, n)), 1)
                n, used = 0, used + 1
            if i >= 0:
                bins[i] -= used
                if not bins[i]:
                    live[i] = False
                    free.append(i)
    done.extend((holds[i], bins[i]) for i in np.flatnonzero(live))
    return done


def _plan_table(plan: list[tuple[tuple[tuple[int, int], ...], int]]) -> pd.DataFrame:
    """One row per (pattern, length): which ranks of the length it takes, and where they go."""
    rows, taken, sequence = [], {}, 0
    for content, n in sorted(plan):
        offset = 0
        for length, each in content:
            first = taken.get(length, 0)
            rows.append((length, first, each, sequence, offset))
            taken[length] = first + each * n
            offset += length * each
        sequence += n
    return pd.DataFrame(rows, columns=["length", "first", "each", "sequence", "offset"]).sort_values(["length", "first"])


def place(pieces: DataFrame, cap: Capacity, weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3),
          rule: str = "norm") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``."""
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = _plan_table(best_fit_plan(counts, cap, weights, rule))
    shift = np.int64(1 << 44)
    key = plan["length"].to_numpy(np.int64) * shift + plan["first"].to_numpy(np.int64)
    table = pieces.sparkSession.sparkContext.broadcast(
        (key, *[plan[c].to_numpy(np.int64) for c in ("first", "each", "sequence", "offset")]))

    @F.pandas_udf("sequence_id long, offset long")
    def at(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        key, first, each, sequence, offset = table.value
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        i = np.searchsorted(key, n * shift + r, side="right") - 1
        q = r - first[i]
        return pd.DataFrame({"sequence_id": sequence[i] + q // each[i], "offset": offset[i] + q % each[i] * n})

    rows = ranked(pieces, ["length"], ["doc_id", "piece", "start"], "__pk_rank", "pack-ranks")
    return (rows.withColumn("__pk_at", at("length", "__pk_rank"))
            .select(*pieces.columns, "__pk_at.sequence_id", "__pk_at.offset"))


def pack(df: DataFrame, tokenizer_path: str, cap: Capacity = Capacity(), id_col: str = "doc_id", text_col: str = "text",
         with_ids: bool = False, rule: str = "norm") -> DataFrame:
    """Every document's pieces with their sequence and their offset in it."""
    pieces = stored(token_pieces(df, tokenizer_path, cap.tokens, id_col, text_col, with_ids), "pack-pieces")
    return place(pieces, cap, rule=rule)
