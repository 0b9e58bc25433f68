"""Sharding by histogram sort (DataFrame and SQL functions only).

Every row gets a sort key: texts of one group share a key (a hash), and the
groups too heavy to ignore come first, largest first, so that a shard boundary
rarely meets one. The splitters between shards are found by counting: probe
keys are laid over each open interval, the exact bytes below every probe are
counted across partitions in one aggregate, and the interval that holds the
target is probed again until the bytes below a probe are within tolerance of
it. Then the rows are exchanged once, by range.

Law ``bytes``: shard sizes are near equal (``TOLERANCE`` of a shard each
boundary). Equal texts stay in one shard; only where a group of them is so
heavy that a boundary has to fall inside it by more than ``GROUP_SLACK`` of a
shard is it split, by id.

Defined cases: a null text has no bytes and the checksum of the empty text; a
null id sorts first; repeated rows get neighbouring slots; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import ranked, stored, text_or_empty

TOLERANCE = 0.0005    # of a shard's bytes
GROUP_SLACK = 0.01    # of a shard's bytes a boundary may move to keep a group whole
PROBES = 512          # per open interval and round

K, W, ID = "__hs_key", "__hs_bytes", "__hs_id"


def heavy_groups(rows: DataFrame, least: float) -> DataFrame:
    """Groups with more than ``least`` bytes: at most total / least of them,
    which is the proven bound for broadcasting them."""
    return (rows.groupBy("__hs_h").agg(F.sum(W).alias("__hs_sum")).filter(F.col("__hs_sum") > F.lit(float(least)))
            .withColumnRenamed("__hs_h", "__hs_hh"))


def find_splitters(df: DataFrame, key: str, weight: str, targets: list[float], tol: float,
                   probes: int = PROBES) -> list[tuple[int, float, float, bool]]:
    """For each target weight: (splitter, weight below it, weight of the
    splitter's own key, met). A splitter ``s`` sends rows with key < s below.
    Where no key boundary meets the tolerance, ``s`` is the key that holds the
    target and ``met`` is False."""
    lo_, hi_, total = df.agg(F.min(key), F.max(key), F.sum(weight)).first()
    if lo_ is None:
        return [(0, 0.0, 0.0, True) for _ in targets]
    state = [dict(lo=int(lo_), hi=int(hi_) + 1, below=0, upto=int(total)) for _ in targets]
    out: list[tuple[int, float, float, bool] | None] = [None] * len(targets)

    def settle(i: int) -> None:
        s, t = state[i], targets[i]
        if abs(s["below"] - t) <= tol:
            out[i] = (s["lo"], s["below"], 0.0, True)
        elif abs(s["upto"] - t) <= tol:
            out[i] = (s["hi"], s["upto"], 0.0, True)
        elif s["hi"] - s["lo"] <= 1:
            out[i] = (s["lo"], s["below"], s["upto"] - s["below"], False)

    while True:
        for i, done in enumerate(out):
            if done is None:
                settle(i)
        spans = sorted({(s["lo"], s["hi"]) for s, done in zip(state, out) if done is None})
        if not spans:
            return out
        step = {(lo, hi): max(1, -(-(hi - lo) // probes)) for lo, hi in spans}
        bucket = F.lit(None).cast("long")
        for j, (lo, hi) in enumerate(spans):
            cell = F.lit(j * (probes + 1)).cast("long") + F.expr(f"(`{key}` - {lo}L) div {step[(lo, hi)]}L")
            bucket = F.when((F.col(key) >= F.lit(lo)) & (F.col(key) < F.lit(hi)), cell).otherwise(bucket)
        counts: dict[int, int] = {r[0]: r[1] for r in df.groupBy(bucket.alias("__hs_cell")).agg(F.sum(weight)).collect()
                                  if r[0] is not None}
        for i, done in enumerate(out):
            if done is not None:
                continue
            s = state[i]
            lo, hi = s["lo"], s["hi"]
            j, st, run = spans.index((lo, hi)), step[(lo, hi)], s["below"]
            for b in range(-(-(hi - lo) // st)):
                w = counts.get(j * (probes + 1) + b, 0)
                if run + w >= targets[i] or lo + (b + 1) * st >= hi:
                    state[i] = dict(lo=lo + b * st, hi=min(lo + (b + 1) * st, hi), below=run, upto=run + w)
                    break
                run += w


def shard_keys(df: DataFrame, id_col: str, text_col: str, shards: int,
               payload: list[Column] | None) -> tuple[DataFrame, int]:
    """Rows (all columns, or ``payload``) with their key, written once; and the total size."""
    text = text_or_empty(text_col)
    rows = stored(df.select(
        *(payload or ["*"]),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 62)).cast("long")).alias(ID),
        (F.octet_length(text) + 1).cast("long").alias(W),
        F.xxhash64(text).alias("__hs_h")), "shard-rows")
    total = rows.agg(F.coalesce(F.sum(W), F.lit(0))).first()[0]
    heavy = heavy_groups(rows, max(1.0, total / shards * TOLERANCE))
    rank = F.when(F.col("__hs_sum").isNull(), F.lit(63)).otherwise(62 - F.floor(F.log2("__hs_sum"))).cast("long")
    keyed = (rows.join(F.broadcast(heavy), F.col("__hs_h") == F.col("__hs_hh"), "left")
             .withColumn(K, F.shiftleft(F.greatest(rank, F.lit(0).cast("long")), 56)
                         + F.shiftrightunsigned(F.col("__hs_h"), 8)))
    return keyed.drop("__hs_h", "__hs_hh", "__hs_sum"), total


def _at_or_above(splitters: list[tuple[int, int | None]], lo: int, hi: int) -> Column:
    """How many splitters lie at or below a row, as a balanced tree of tests."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    s, d = splitters[mid]
    above = F.col(K) >= F.lit(s) if d is None else (F.col(K) > F.lit(s)) | ((F.col(K) == F.lit(s)) & (F.col(ID) >= F.lit(d)))
    return F.when(above, _at_or_above(splitters, mid + 1, hi)).otherwise(_at_or_above(splitters, lo, mid))


def histogram_shards(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text",
                     payload: list[Column] | None = None) -> DataFrame:
    """``df`` (or only the ``payload`` columns of it) with ``shard`` (int) and
    ``slot`` (long, gapless from 0 within the shard); columns of ``df`` with
    these two names are replaced."""
    keyed, total = shard_keys(df, id_col, text_col, shards, payload)
    size = total / shards
    found = find_splitters(keyed, K, W, [size * i for i in range(1, shards)], max(1.0, size * TOLERANCE))
    splitters: list[tuple[int, int | None]] = []
    for i, (s, below, own, met) in enumerate(found, 1):
        target = size * i
        if met:
            splitters.append((s, None))
        elif min(target - below, below + own - target) <= GROUP_SLACK * size:
            splitters.append((s, None) if target - below <= below + own - target else (s + 1, None))
        else:  # one group holds the boundary: count inside it, by id
            inside = find_splitters(keyed.filter(F.col(K) == F.lit(s)), ID, W, [target - below], max(1.0, size * TOLERANCE))
            splitters.append((s, inside[0][0]))
    cut = keyed.drop("slot").withColumn("shard", _at_or_above(splitters, 0, len(splitters)).cast("int"))
    return ranked(cut, ["shard"], [K, ID], "slot", "shard-slots").drop(K, W, ID)
