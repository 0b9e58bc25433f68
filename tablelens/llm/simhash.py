"""SimHash near-dedup by the generalised pigeonhole principle.

Fingerprints are made inside tasks from whole texts; from then on only
distinct fingerprints matter (one row a class of equal ones).

Two fingerprints at most ``distance`` bits apart must, for any partition of
the 64 bits and any per-partition thresholds t_i >= -1 with
sum(t_i + 1) = distance + 1, be within t_i on some partition i. Bits that go
together (by their correlation over all fingerprints) are put into one
partition; how often two fingerprints fall within each distance on each
partition is counted over all of them; a dynamic programme gives each
partition its own threshold so that the estimated probe rows and candidates
cost least. Every fingerprint is then indexed under its value on each used
partition and probes the values within t_i of it (only those made by raising
bits, so that each pair meets once). Members of a bucket are verified by the
exact bit distance; a bucket gives the links of a spanning forest, never all
pairs. A bucket of more than ``BLOCK`` rows is cut into blocks that meet two by
two in tasks of their own. Components come from ``components``.

Defined cases: null, empty and blank texts have fingerprint zero, linked like
any other; repeated rows share their class; a null id takes no part in the
smallest id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import stored
from tablelens.llm.components import components

BITS = 64
WIDTHS = (2, 3, 4, 5)     # numbers of partitions tried
PROBE_COST = 200.0        # a probe row (shuffled, sorted) against one candidate check
SHIFTS = 16               # pairs of fingerprints looked at per fingerprint for the estimate
SMALL = 8                 # buckets up to this size are compared all at once
BLOCK = 20_000            # rows of a bucket that one task compares with one another block


def _bit_counts(digests: bytes) -> np.ndarray:
    """How many of the 8-byte digests have each bit (most significant first)."""
    bits = np.unpackbits(np.frombuffer(digests, dtype=np.uint8)).view(np.uint64).reshape(-1, 8)
    pad = -len(bits) % 255
    if pad:
        bits = np.vstack([bits, np.zeros((pad, 8), dtype=np.uint64)])
    sums = bits.reshape(-1, 255, 8).sum(axis=1, dtype=np.uint64)   # byte counters stay below 256
    return np.ascontiguousarray(sums).view(np.uint8).reshape(-1, BITS).sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, shingle: int, seed: int = 42) -> int:
    """Signed 64-bit fingerprint of a whole text."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = (np.concatenate([[0], ends[:-1]]))[:n].tolist()
    stops = (ends - 1)[min(shingle, len(words)) - 1:].tolist()
    digest, total = xxhash.xxh64_digest, np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        total += _bit_counts(b"".join([digest(joined[a:z], seed) for a, z in zip(starts[at:at + (1 << 16)], stops[at:at + (1 << 16)])]))
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big", signed=True)


def fingerprints(df: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, fp) for every row; ``th`` is a hash of the text."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(t, shingle) for t in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(fp, pa.int64())], names=["doc_id", "th", "fp"])

    text = F.col(text_col).cast("string")
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(
        make, "doc_id long, th long, fp long")


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def bit_groups(classes: DataFrame, widths: tuple[int, ...] = WIDTHS) -> dict[int, list[int]]:
    """For each number of partitions, the masks: bits that go together (by
    correlation over all fingerprints) fill a partition one after the other."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS + 1, BITS + 1))
        for b in batches:
            x = _unsigned(b.column(0))
            bits = ((x[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
            bits = np.hstack([bits, np.ones((len(x), 1), dtype=np.float32)])
            total += bits.T @ bits
        yield pa.record_batch([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel().astype(np.int64))], names=["cell", "n"])

    got = classes.select("fp").mapInArrow(pairs, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    c = np.zeros((BITS + 1) ** 2)
    for r in got:
        c[r["cell"]] = r["n"]
    c = c.reshape(BITS + 1, BITS + 1)
    n = max(1.0, c[BITS, BITS])
    p = c[:BITS, BITS] / n
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((c[:BITS, :BITS] / n - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    out: dict[int, list[int]] = {}
    for m in widths:
        left, masks = list(range(BITS)), []
        for i in range(m):
            size = (BITS * (i + 1)) // m - (BITS * i) // m
            sub = corr[np.ix_(left, left)]
            group = [left[int(sub.sum(axis=1).argmax())]]
            left.remove(group[0])
            while len(group) < size:
                best = left[int(corr[np.ix_(left, group)].mean(axis=1).argmax())]
                group.append(best)
                left.remove(best)
            masks.append(sum(1 << b for b in group))
        out[m] = masks
    return out


def distance_counts(classes: DataFrame, groups: dict[int, list[int]]) -> tuple[dict[int, np.ndarray], float]:
    """For each mask, how many of the looked-at pairs (every fingerprint with
    ``SHIFTS`` others) are 0, 1, ... bits apart on it; and the number of pairs."""
    masks = sorted({m for g in groups.values() for m in g})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(masks), BITS + 1), dtype=np.int64)
        for b in batches:
            x = _unsigned(b.column(0))
            for s in range(1, min(SHIFTS, len(x) - 1) + 1):
                d = x[s:] ^ x[:-s]
                for i, mask in enumerate(masks):
                    total[i] += np.bincount(np.bitwise_count(d & np.uint64(mask)), minlength=BITS + 1)
        yield pa.record_batch([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], names=["cell", "n"])

    got = classes.select("fp").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(len(masks) * (BITS + 1))
    for r in got:
        flat[r["cell"]] = r["n"]
    table = flat.reshape(len(masks), BITS + 1)
    return {m: table[i] for i, m in enumerate(masks)}, float(table[0].sum()) if len(masks) else 0.0


def thresholds(groups: dict[int, list[int]], near: dict[int, np.ndarray], pairs: float, n: int,
               distance: int) -> list[tuple[int, int]]:
    """(mask, threshold) of the used partitions: least estimated cost over the
    numbers of partitions, by dynamic programming over their thresholds."""
    best: tuple[float, list[tuple[int, int]]] = (float("inf"), [])
    for masks in groups.values():
        table: dict[int, tuple[float, list[tuple[int, int]]]] = {0: (0.0, [])}
        for mask in masks:
            width, step = mask.bit_count(), {}
            for spent, (cost, chosen) in table.items():
                for u in range(0, distance + 2 - spent):   # u = threshold + 1
                    more, pick = cost, chosen
                    if u:
                        probes = n * (1 + sum(comb(width, j) / 2 ** j for j in range(1, min(u, width + 1))))
                        share = (near[mask][:u].sum() + 0.5) / (pairs + 1)
                        more, pick = cost + PROBE_COST * probes + share * n * n / 2, [*chosen, (mask, u - 1)]
                    if spent + u not in step or more < step[spent + u][0]:
                        step[spent + u] = (more, pick)
            table = step
        if table[distance + 1][0] < best[0]:
            best = table[distance + 1]
    return best[1]


def _bucket_rows(plan: list[tuple[int, int]]):
    """Index and probe rows (key, fp, probe) of a batch of fingerprints."""
    todo = []
    for i, (mask, t) in enumerate(plan):
        bits = [b for b in range(BITS) if mask >> b & 1]
        flips = [0] + [sum(1 << b for b in c) for k in range(1, t + 1) for c in combinations(bits, k)]
        todo.append((i, np.uint64(mask), flips))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _unsigned(b.column(0))
            for i, mask, flips in todo:
                keys, fps, probe = [], [], []
                part = np.uint64((i + 1) * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF)
                for flip in flips:
                    f = np.uint64(flip)
                    # one of a pair has the lowest differing bit unset: only that one probes
                    own = x if not flip else x[(x & np.uint64(flip & -flip)) == 0]
                    keys.append(((own & mask) ^ f) * np.uint64(0x9E3779B97F4A7C15) + part)
                    fps.append(own)
                    probe.append(np.full(len(own), bool(flip)))
                k, f, p = (np.concatenate(c) for c in (keys, fps, probe))
                k ^= k >> np.uint64(29)
                yield pa.record_batch([pa.array(k.view(np.int64)), pa.array(f.view(np.int64)), pa.array(p)], names=["key", "fp", "probe"])

    return make


def _forest(fp: np.ndarray, probe: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one bucket: a breadth-first forest over the verified pairs."""
    left = np.arange(len(fp))
    a, b, queue = [], [], []
    while len(left):
        if not queue:
            queue.append(left[0])
            left = left[1:]
        i = queue.pop()
        ok = np.bitwise_count(fp[left] ^ fp[i]) <= distance
        if probe[i]:
            ok &= ~probe[left]
        hit = left[ok]
        if len(hit):
            a.append(np.full(len(hit), fp[i]))
            b.append(fp[hit])
            queue.extend(hit.tolist())
            left = left[~ok]
    if not a:
        return fp[:0], fp[:0]
    return np.concatenate(a), np.concatenate(b)


def _bucket_links(key: np.ndarray, fp: np.ndarray, probe: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links of whole buckets (rows sorted by key)."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(key)]]))
    a, b = [], []
    for gap in range(1, SMALL):       # small buckets: all pairs that are `gap` rows apart, over all buckets at once
        if gap >= len(key):
            break
        size = np.repeat(sizes, sizes)
        i = np.flatnonzero((key[gap:] == key[:-gap]) & (size[gap:] <= SMALL))
        i = i[(np.bitwise_count(fp[i] ^ fp[i + gap]) <= distance) & ~(probe[i] & probe[i + gap])]
        a.append(fp[i])
        b.append(fp[i + gap])
    for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
        x, y = _forest(fp[s:s + n], probe[s:s + n], distance)
        a.append(x)
        b.append(y)
    if not a:
        return fp[:0], fp[:0]
    return np.concatenate(a), np.concatenate(b)


def dealt_buckets(buckets: DataFrame, block: int) -> DataFrame:
    """``buckets`` with those of more than ``block`` rows cut up: their rows
    are dealt to blocks by fingerprint and every two blocks meet under a key of
    their own, so that each pair of the bucket still meets and no task holds
    more than about two blocks of it. At most rows / ``block`` buckets are that
    large; their sizes are written, and joined however Spark finds best."""
    big = stored(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > block)
                 .select(F.col("key").alias("big"), F.ceil(F.col("rows") / block).cast("long").alias("blocks")), "simhash-big")
    marked = buckets.join(big, buckets["key"] == big["big"], "left")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    others = F.when(F.col("blocks").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    met = marked.select("key", "fp", "probe", own.alias("own"), F.explode(others).alias("other"))
    key = F.when(F.col("other").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    return met.select(key.alias("key"), "fp", "probe")


def near_links(classes: DataFrame, distance: int, block: int = BLOCK) -> DataFrame:
    """(a, b): links between distinct fingerprints, enough to connect every
    pair at most ``distance`` bits apart."""
    n = classes.count()
    groups = bit_groups(classes)
    near, pairs = distance_counts(classes, groups)
    plan = thresholds(groups, near, pairs, n, distance)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def out(parts: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            x, y = _bucket_links(*parts, distance)
            return pa.record_batch([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = (_unsigned(batch.column(0)), _unsigned(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False).astype(bool))
            held.append(now)
            rows += batch.num_rows
            if now[0][-1] == held[0][0][0]:   # still inside one bucket
                continue
            parts = tuple(np.concatenate(c) for c in zip(*held))
            cut = int(np.flatnonzero(parts[0] != parts[0][-1])[-1]) + 1   # the last bucket may go on
            yield out(tuple(c[:cut] for c in parts))
            held = [tuple(c[cut:] for c in parts)]
        if held:
            yield out(tuple(np.concatenate(c) for c in zip(*held)))

    buckets = classes.select("fp").mapInArrow(_bucket_rows(plan), "key long, fp long, probe boolean")
    return dealt_buckets(buckets, block).repartition("key").sortWithinPartitions("key", "fp").mapInArrow(link, "a long, b long")


def near_duplicates(df: DataFrame, shingle: int = 4, distance: int = 4, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, th, fp, root, component_id`` (the smallest
    id reachable; ``root`` is the component's smallest fingerprint)."""
    rows = stored(fingerprints(df, shingle, id_col, text_col), "simhash")
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    roots = components(near_links(classes, distance), "a", "b")
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = stored(rooted, "simhash-roots")
    least = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")
    names = rooted.join(least, "root").select(F.col("fp").alias("__sh_fp"), "root", "component_id")
    return rows.join(names, rows["fp"] == names["__sh_fp"]).select("doc_id", "th", "fp", "root", "component_id")


def keep_one(df: DataFrame, shingle: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row with the smallest id of every component (null ids come last),
    with the columns of ``df``."""
    first = near_duplicates(df, shingle, distance, id_col, text_col).groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("w"))
    first = first.select(F.col("w.doc_id").alias("__sh_id"), F.col("w.th").alias("__sh_w"))
    marked = df.withColumn("__sh_th", F.xxhash64(F.col(text_col).cast("string")))
    on = F.col(id_col).cast("long").eqNullSafe(F.col("__sh_id")) & (F.col("__sh_th") == F.col("__sh_w"))
    return marked.join(first, on).dropDuplicates([id_col, "__sh_th"]).select(*df.columns)


def hexed(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")
