"""Pairwise-complete sums of many columns by column tiles.

The columns are cut into tiles; a scan serves as many pairs of tiles as fit
``BUDGET`` bytes of accumulators a task (and reads only their columns), so a
task's memory does not grow with the square of the columns. A task sends one
packed row for each column and tile, never a row a pair; packed rows are added
in two levels (among groups of tasks, then once), one key at a time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: columns a tile
TILE = 256
#: bytes of accumulators a task holds in one scan
BUDGET = 256 << 20
SUMS = ("n", "sa", "sb", "sab", "saa", "sbb")
PACKED = "i int, q int, part int, sums binary"


def tile_scans(k: int, tile: int, budget: int) -> list[list[tuple[int, int]]]:
    """Pairs of tiles (first <= second) dealt to scans that fit the budget."""
    tiles = -(-k // tile)
    pairs = [(p, q) for p in range(tiles) for q in range(p, tiles)]
    fit = max(1, budget // (len(SUMS) * tile * tile * 8))
    return [pairs[i:i + fit] for i in range(0, len(pairs), fit)]


def _scan(v: DataFrame, cols: Sequence[str], means: Sequence[float], pairs: list[tuple[int, int]], tile: int, fan: int) -> DataFrame:
    used = sorted({t for pair in pairs for t in pair})
    places = [c for t in used for c in range(t * tile, min((t + 1) * tile, len(cols)))]
    where = {t: slice(used.index(t) * tile, used.index(t) * tile + len(range(t * tile, min((t + 1) * tile, len(cols))))) for t in used}
    shift = np.array([means[c] for c in places])
    narrow = v.select(*[F.col(f"c{c}") for c in places])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1).astype(np.float64) - shift
            m = ~np.isnan(x)
            x[~m] = 0.0
            m = m.astype(np.float64)
            sq = x * x
            for p, q in pairs:
                a, d = where[p], where[q]
                part = np.stack([m[:, a].T @ m[:, d], x[:, a].T @ m[:, d], m[:, a].T @ x[:, d], x[:, a].T @ x[:, d],
                                 sq[:, a].T @ m[:, d], m[:, a].T @ sq[:, d]], axis=1)
                if (p, q) in acc:
                    acc[p, q] += part
                else:
                    acc[p, q] = part
        part_no = TaskContext.get().partitionId() % fan
        for (p, q), s in acc.items():
            n = len(s)
            yield pa.record_batch([pa.array(np.arange(p * tile, p * tile + n, dtype=np.int32)), pa.array(np.full(n, q, np.int32)),
                                   pa.array(np.full(n, part_no, np.int32)), pa.array([r.tobytes() for r in s], pa.binary())],
                                  names=["i", "q", "part", "sums"])

    return narrow.mapInArrow(fold, PACKED)


def _added(packed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Packed rows of equal keys added, one key in memory at a time."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for b in batches:
            done = []
            for i, q, part, sums in zip(*(c.to_pylist() for c in b.columns)):
                own = (i, q, part) if "part" in keys else (i, q, 0)
                row = np.frombuffer(sums, np.float64)
                if own == key:
                    total += row
                else:
                    if key is not None:
                        done.append((*key, total.tobytes()))
                    key, total = own, row.copy()
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), (pa.int32(), pa.int32(), pa.int32(), pa.binary()))],
                                                 names=["i", "q", "part", "sums"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*key, total.tobytes()), (pa.int32(), pa.int32(), pa.int32(), pa.binary()))],
                                             names=["i", "q", "part", "sums"])

    return packed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(add, PACKED)


def gram_sums(v: DataFrame, cols: Sequence[str], means: Sequence[float], diagonal: bool = True,
              tile: int | None = None, budget: int | None = None) -> DataFrame:
    """(i, j, n, sa, sb, sab, saa, sbb) for i <= j (i < j without ``diagonal``):
    over the rows where both columns of ``v`` are present, their number and the
    sums of x, y, xy, x², y² (shifted by the columns' means)."""
    tile, budget, k = tile or TILE, budget or BUDGET, len(cols)
    v = v.toDF(*[f"c{c}" for c in range(k)])
    fan = max(1, int(round(int(v.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 0.5)))
    out = None
    for pairs in tile_scans(k, tile, budget):
        part = _added(_added(_scan(v, cols, means, pairs, tile, fan), ("i", "q", "part")), ("i", "q"))
        out = part if out is None else out.unionByName(part)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, q, sums in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()):
                s = np.frombuffer(sums, np.float64).reshape(len(SUMS), -1)
                j = np.arange(q * tile, q * tile + s.shape[1])
                use = j >= i if diagonal else j > i
                if use.any():
                    yield pa.record_batch([pa.array(np.full(int(use.sum()), i, np.int32)), pa.array(j[use].astype(np.int32)),
                                           *[pa.array(x[use]) for x in s]], names=["i", "j", *SUMS])

    return out.mapInArrow(unpack, "i int, j int, " + ", ".join(f"{s} double" for s in SUMS))
