"""Substring dedup with a compressed FM-index per shard.

A window of ``window`` words that also starts earlier is removed. The work is
cut into shards so that equal windows meet in one shard: every window has an
anchor (the smallest hash among its runs of ``RUN`` words), windows in a row
with one anchor form a segment, and a segment goes to the shard of its anchor.

1. Anchors of all texts are counted; a segment whose anchor is nowhere else
   cannot hold a repeated window and is not looked at again (never the other
   way round: an anchor found twice by chance only costs work).
2. The other segments go to their shards. A task sends each distinct word
   sequence once (its earliest place); the task's later copies of it are
   repeats already. An anchor with more segments than a shard should hold is
   dealt by window instead, so a passage that a third of all documents share
   is spread over shards.
3. Each shard builds an FM-index over its segments (suffix order, Burrows-
   Wheeler transform in a wavelet matrix of rank-indexed bit vectors) and
   streams the segments through it by backward search. The matching
   statistics, kept at the window length, give every window's suffix interval;
   a window whose interval holds an earlier place is reported.
4. The reported intervals are merged per document and cut out of its words.

Defined cases: a null text has no words; texts shorter than the window lose
nothing; rows that repeat an id are one document if their texts are equal too
(each gets its result), else they come in the order of a hash of their texts;
a null id sorts first; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelens.llm.common import stored

RUN = 6                    # words of an anchor
SHARD_WORDS = 400_000      # words a shard should hold
WORDS_KEPT = 1_000_000     # word hashes a worker remembers
NO_ID = -(1 << 63)         # a null id inside the joins

_hash_of: dict[bytes, int] = {}


def _word_hashes(words: list[bytes]) -> np.ndarray:
    known = _hash_of
    if len(known) > WORDS_KEPT:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words, by doubling (position i: words i .. i+k-1)."""
    whole, at, part, length = None, 0, h, 1
    while True:
        if k & length:
            piece = part[at:]
            whole = piece if whole is None else _mixed(whole[:len(piece)] * np.uint64(0xC2B2AE3D27D4EB4F) + piece[:len(whole)])
            at += length
        length *= 2
        if length > k:
            return whole
        part = _mixed(part[:len(part) - length // 2] * np.uint64(0xD6E8FEB86659FD93) + part[length // 2:])


def _window_least(x: np.ndarray, w: int) -> np.ndarray:
    """Place of the smallest (the first of equals) of every ``w`` neighbours."""
    n, length, at = len(x) - w + 1, 1, np.arange(len(x))

    def lesser(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.where(x[left] <= x[right], left, right)

    while length * 2 <= w:
        at = lesser(at[:len(at) - length], at[length:])
        length *= 2
    return lesser(at[:n], at[w - length:w - length + n])


def text_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text (what bytes.split() cuts at is that set)."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def segments_of(words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, windows) of a text's segments."""
    if len(words) < window:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    runs = _runs(_word_hashes(words), RUN)
    at = _window_least(runs, window - RUN + 1)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))   # by place: a text may repeat itself
    return runs[at[first]].view(np.int64), first, np.diff(np.concatenate([first, [len(at)]]))


def _anchors(window: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            for row, text in enumerate(b.column(2).to_pylist()):
                a, first, n = segments_of(text_words(text), window)
                for col, v in zip(out, (a, first, n, np.full(len(a), row))):
                    col.append(v)
            if not out[0]:
                continue
            a, first, n, row = (np.concatenate(c) for c in out)
            # an anchor met twice here is known to repeat: one row of it still tells the others
            order = np.argsort(a, kind="stable")
            fresh = np.concatenate([[True], a[order][1:] != a[order][:-1]])
            size = np.diff(np.concatenate([np.flatnonzero(fresh), [len(a)]]))
            count = np.empty(len(a), dtype=np.int64)
            count[order] = np.repeat(size, size)
            asks = np.empty(len(a), dtype=bool)
            asks[order] = fresh
            rows = pa.array(row)
            yield pa.record_batch([
                pa.array(a), pa.array(asks), pa.array(count), b.column(0).take(rows), b.column(1).take(rows),
                pa.array(first << 24 | n)], names=["anchor", "asks", "met", "id", "th", "place"])

    return make


def repeated_segments(docs: DataFrame, window: int) -> DataFrame:
    """(id, th, anchor, place) of the segments whose anchor stands elsewhere too.

    A task sends one asking row for each of its anchors; only those meet (so
    an anchor's group holds at most one row a batch, however frequent it is).
    The task's other rows of the anchor are known to repeat and need no answer.
    """
    rows = docs.mapInArrow(_anchors(window), "anchor long, asks boolean, met long, id long, th long, place long")
    spread = F.when(F.col("asks"), F.lit(0)).otherwise(F.xxhash64("id", "place"))
    asked = Window.partitionBy("anchor", "spread")
    rows = rows.withColumn("spread", spread).withColumn("all", F.sum("met").over(asked))
    return rows.filter((F.col("met") > 1) | (F.col("all") > 1)).select("id", "th", "anchor", "place")


def _segment_rows(window: int, shards: int):
    """Segments of a batch by shard: each distinct word sequence once, at its
    earliest place; the places after it come out as repeats (shard -1). A
    segment of a frequent anchor (``hot``) is dealt window by window."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            least: dict[bytes, tuple[int, ...]] = {}     # (id, th, first, n, anchor, hot) of the earliest place
            again: list[tuple[int, ...]] = []
            segments = b.column(3)      # one flat array a field: a list of structs is slow to read
            ends, flat = segments.offsets.to_numpy(), segments.values
            fields = [flat.field(k).to_pylist() for k in ("anchor", "hot", "place")]
            for row, (id_, th, text) in enumerate(zip(*(c.to_pylist() for c in b.columns[:3]))):
                words = text_words(text)
                pieces = []
                at = slice(ends[row], ends[row + 1])
                for a, hot, place in zip(*(f[at] for f in fields)):
                    first, n = place >> 24, place & 0xFFFFFF
                    pieces.extend([(a, hot, first + i, 1) for i in range(n)] if hot else [(a, hot, first, n)])
                for a, hot, first, n in pieces:
                    seq = b" ".join(words[first:first + n + window - 1])
                    here, had = (id_, th, first, n, a, hot), least.get(seq)
                    if had is None or here < had:
                        least[seq], here = here, had
                    if here is not None and here[:3] != least[seq][:3]:   # a row twice is one document
                        again.append(here)
            rows = [(xxhash.xxh3_64_intdigest(seq) % shards if h[5] else (h[4] * 0x9E3779B1 >> 8) % shards, seq, *h[:4])
                    for seq, h in least.items()]
            rows += [(-1, None, *h[:4]) for h in again]
            kinds = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)],
                                  names=["shard", "seq", "id", "th", "first", "n"])

    return make


class BitVector:
    """Packed bits with a running count per 64-bit word."""

    def __init__(self, bits: np.ndarray) -> None:
        pad = np.zeros(-len(bits) % 64 + 64, dtype=bool)
        self.words = np.packbits(np.concatenate([bits, pad]), bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1].astype(np.int32)

    def rank1(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class WaveletMatrix:
    """Rank of any symbol at any place of a sequence."""

    def __init__(self, seq: np.ndarray, symbols: int) -> None:
        self.depth = max(1, int(symbols - 1).bit_length())
        self.levels: list[tuple[BitVector, int]] = []
        for level in range(self.depth - 1, -1, -1):
            bit = (seq >> level & 1).astype(bool)
            self.levels.append((BitVector(bit), int(len(seq) - bit.sum())))
            seq = np.concatenate([seq[~bit], seq[bit]])
        every = np.arange(symbols, dtype=np.int64)
        self.start = self._down(every, np.zeros_like(every))   # where each symbol's places begin below the last level

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in enumerate(self.levels):
            one = (symbol >> (self.depth - 1 - k) & 1).astype(bool)
            ones = bits.rank1(at)
            at = np.where(one, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of ``symbol`` before ``lo`` and before ``hi``."""
        start = self.start[symbol]
        return self._down(symbol, lo) - start, self._down(symbol, hi) - start


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first ``depth`` symbols at least (prefix
    doubling), and their classes of equal ``depth``-prefixes as run starts."""
    n = len(text)
    rank = text.astype(np.int64)
    length, order = 1, None
    while True:
        step = min(length, depth - length) if length < depth else 0
        if step <= 0:
            break
        nxt = np.zeros(n, dtype=np.int64)
        nxt[:n - step] = rank[step:] + 1
        key = rank * (n + 2 + int(text.max())) + nxt
        order = np.argsort(key, kind="stable")
        s = key[order]
        cls = np.cumsum(np.concatenate([[0], (s[1:] != s[:-1]).astype(np.int64)]))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = cls
        length += step
    return order, rank


class FMIndex:
    """FM-index over a text of symbols 1.. with 0 as separator, in ``depth``-prefix order."""

    def __init__(self, text: np.ndarray, depth: int) -> None:
        self.text, self.depth = text, depth
        self.order, cls = suffix_order(text, depth)
        self.symbols = int(text.max()) + 1
        self.bwt = WaveletMatrix(text[self.order - 1], self.symbols)    # place -1 is the last separator
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.symbols))])
        # intervals one symbol short of the depth, for dropping a window's last word
        short = _prefix_classes(text, self.order, depth - 1)
        starts = np.flatnonzero(np.concatenate([[True], short[1:] != short[:-1]]))
        run = np.cumsum(np.concatenate([[0], (short[1:] != short[:-1]).astype(np.int64)]))
        ends = np.concatenate([starts[1:], [len(text)]])
        self.short_lo, self.short_hi = starts[run], ends[run]

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the interval of symbol + pattern."""
        a, b = self.bwt.rank(symbol, lo, hi)
        base = self.first[symbol]
        return base + a, base + b

    def shorten(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of a window without its last word."""
        return self.short_lo[lo], self.short_hi[lo]


def _prefix_classes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Class of each suffix (in suffix order) by its first ``depth`` symbols."""
    h = _runs(_mixed(np.concatenate([text, np.zeros(depth, dtype=text.dtype)]).astype(np.uint64) + np.uint64(1)), depth)
    return h[:len(text)][order]


def repeated_windows(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, offset) of every window whose word sequence stands earlier in
    the text of segments (which lie in document order)."""
    fm = FMIndex(text, window)
    at = starts + lengths - 1                      # the streams' heads; all go backwards together
    lo = np.zeros(len(starts), dtype=np.int64)
    hi = np.full(len(starts), len(text), dtype=np.int64)
    alive = np.arange(len(starts))
    depth, segs, offs = 0, [], []
    earliest = None
    while len(alive):
        if depth == window:
            lo[alive], hi[alive] = fm.shorten(lo[alive])
            depth -= 1
        lo[alive], hi[alive] = fm.extend(text[at[alive]], lo[alive], hi[alive])
        depth += 1
        if depth == window:
            if earliest is None:                   # smallest place in each class of equal windows
                cls = _prefix_classes(text, fm.order, window)
                run = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]]))
                earliest = np.zeros(len(text), dtype=np.int64)
                earliest[run] = np.minimum.reduceat(fm.order, run)
            back = earliest[lo[alive]] < at[alive]
            segs.append(alive[back])
            offs.append((at[alive] - starts[alive])[back])
        at[alive] -= 1
        alive = alive[at[alive] >= starts[alive]]
    if not segs:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(segs), np.concatenate(offs)


def _shard_repeats(window: int):
    """One shard: index its segments, stream them, report intervals (id, th, first, end)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["id", "th", "first", "n"]).sort_values(["id", "th", "first"], kind="stable")
        words = pc.split_pattern(pa.array(pdf["seq"], pa.large_binary()), b" ")
        lengths = np.diff(words.offsets.to_numpy()).astype(np.int64)
        flat = words.flatten().dictionary_encode().indices.to_numpy()
        symbols = flat.astype(np.int64) + 1
        starts = np.cumsum(lengths + 1) - lengths - 1
        text = np.zeros(int((lengths + 1).sum()), dtype=np.int64)
        text[np.arange(len(flat)) + np.repeat(np.arange(len(lengths)), lengths)] = symbols
        seg, off = repeated_windows(text, starts, lengths, window)
        order = np.lexsort((off, seg))
        seg, off = seg[order], off[order]
        joins = np.zeros(len(seg), dtype=bool)         # windows in a row are one interval
        joins[1:] = (seg[1:] == seg[:-1]) & (off[1:] == off[:-1] + 1)
        head = np.flatnonzero(~joins)
        tail = np.concatenate([head[1:], [len(seg)]])[:len(head)] - 1
        ids, th, first = (pdf[c].to_numpy(np.int64)[seg[head]] for c in ("id", "th", "first"))
        return pd.DataFrame({"id": ids, "th": th, "first": first + off[head], "end": first + off[tail] + window})

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols: list[list] = [[], [], []]
        for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            words = text_words(text)
            if spans:
                keep = np.ones(len(words) + 1, dtype=np.int64)
                cover = np.zeros(len(words) + 1, dtype=np.int64)
                for s in spans:
                    cover[s["first"]] += 1
                    cover[s["end"]] -= 1
                keep = np.cumsum(cover)[:-1] == 0
                left = [w for w, k in zip(words, keep) if k]
            else:
                left = words
            cols[0].append(len(words))
            cols[1].append(len(words) - len(left))
            cols[2].append(b" ".join(left))
        yield pa.record_batch([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                               pa.array(cols[2], pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _kept(batches):
        yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array([hashlib.sha256(k).hexdigest() for k in b.column(3).to_pylist()])],
                              names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, th, text deflated): what the two joins by document move."""
    import zstandard

    z = zstandard.ZstdCompressor(level=1)
    for b in batches:
        yield pa.record_batch([b.column(0), b.column(1), pa.array([z.compress((t or "").encode("utf-8", "surrogatepass")) for t in b.column(2).to_pylist()], pa.binary())],
                              names=["id", "th", "z"])


def _unpacked(make):
    """``make`` over batches whose third column is a packed text."""
    import zstandard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()

        def texts() -> Iterator[pa.RecordBatch]:
            for b in batches:
                i = b.schema.get_field_index("z")
                cols = list(b.columns)
                cols[i] = pa.array([d.decompress(x).decode("utf-8", "surrogatepass") for x in b.column(i).to_pylist()], pa.string())
                yield pa.record_batch(cols, names=b.schema.names)

        return make(texts())

    return run


def repeated_spans(docs: DataFrame, window: int) -> DataFrame:
    """(id, th, first, end): words covered by repeated windows. ``docs``: id, th, text."""
    found = stored(repeated_segments(docs, window), "fm-segments")
    n = found.count()
    # a segment is a few words more than a window; shards follow the number of segments
    shards = max(1, -(-n * (window + 8) // SHARD_WORDS))
    limit = max(1, SHARD_WORDS // (window + 8))
    # the frequent anchors (at most n / limit) are written and joined: their number grows with the input
    hot = stored(found.groupBy("anchor").count().filter(F.col("count") > limit).select(F.col("anchor").alias("__hot")), "fm-frequent")
    marked = found.join(hot, found["anchor"] == hot["__hot"], "left").withColumn("hot", F.col("__hot").isNotNull())
    lists = marked.groupBy("id", "th").agg(F.collect_list(F.struct("anchor", "hot", "place")).alias("segments"))
    packed = docs.mapInArrow(_packed, "id long, th long, z binary")
    lists = lists.select(F.col("id").alias("__id"), F.col("th").alias("__th"), "segments")
    joined = packed.join(lists, (packed["id"] == lists["__id"]) & (packed["th"] == lists["__th"]))
    rows = stored(joined.select("id", "th", "z", "segments").mapInArrow(
        _unpacked(_segment_rows(window, shards)), "shard int, seq binary, id long, th long, first long, n long"), "fm-shards")
    known = rows.filter(F.col("shard") < 0).select("id", "th", "first", (F.col("first") + F.col("n") + (window - 1)).alias("end"))
    searched = rows.filter(F.col("shard") >= 0).groupBy("shard").applyInPandas(
        _shard_repeats(window), "id long, th long, first long, end long")
    return known.unionByName(searched)


def remove_repeats(df: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text",
                   digest: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_removed`` and the kept words
    joined by one space (``kept``, UTF-8), or with ``digest`` their SHA-256."""
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("th"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    spans = stored(repeated_spans(docs, window), "fm-spans")
    spans = spans.groupBy("id", "th").agg(F.collect_set(F.struct("first", "end")).alias("spans"))
    spans = spans.select(F.col("id").alias("__id"), F.col("th").alias("__th"), "spans")
    packed = docs.mapInArrow(_packed, "id long, th long, z binary")
    joined = packed.join(spans, (packed["id"] == spans["__id"]) & (packed["th"] == spans["__th"]), "left")
    last = "kept_sha256 string" if digest else "kept binary"
    return joined.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "z", "spans").mapInArrow(
        _unpacked(_digested if digest else _kept), f"doc_id long, n_words long, n_removed long, {last}")
