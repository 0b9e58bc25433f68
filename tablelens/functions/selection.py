"""Exact order statistics by sketch and bracket, without shuffling the values.

Pass one folds every column into a mergeable quantile sketch (KLL, a buffer a
task, merged in two levels) and reads a bracket around each wanted rank off
it. Pass two scans again and, in one grouping, counts what lies below and
between the brackets (one row a task and region) and the distinct values
inside them: only those few values are shuffled. The exact counts prove each
bracket: a wanted rank either falls on a counted value, or the counts say
between which brackets it lies, and that gap is searched next.

A bracket that may hold more than ``LIMIT`` values is first narrowed by a
sketch of its inside alone; every such pass divides it by hundreds (ties at
its ends are counted exactly, so they cannot stop the progress). A table of
10^12 rows takes five scans and moves a few million values, never itself.

Values are compared in a type of their own: whole numbers, dates, timestamps
and decimals of up to 18 digits as longs, everything else as doubles.
"""

from __future__ import annotations

import datetime
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions.stats import num

#: size of a sketch: its ranks are off by ``rank_error`` at most 99 times in 100
SKETCH = 4096
#: values a bracket may hold when its distinct values are counted
LIMIT = 1_000_000
#: a bracket reaches so many rank errors to both sides
MARGIN = 2.0


def rank_error(k: int) -> float:
    """Published 99 % bound of a KLL sketch of size ``k`` (share of all ranks)."""
    return 2.296 / k ** 0.9723


@dataclass(frozen=True)
class Ordinal:
    """A column as ordered numbers: ``whole`` longs or doubles, and the way
    back; ``scale`` decimal places of a long are behind the point."""
    value: Column
    whole: bool
    back: Callable
    scale: int = 0

    def real(self, v: Column) -> Column:
        return v.cast("double") / F.lit(10.0 ** self.scale) if self.scale else v.cast("double")


def _days(v: int):
    return datetime.date(1970, 1, 1) + datetime.timedelta(days=v)


def _instant(v: int):
    return datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=v)


def ordinal(c: Column, dt: T.DataType) -> Ordinal:
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return Ordinal(c.cast("long"), True, int)
    if isinstance(dt, T.BooleanType):
        return Ordinal(c.cast("int").cast("long"), True, int)
    if isinstance(dt, T.DateType):
        return Ordinal(F.unix_date(c).cast("long"), True, _days)
    if isinstance(dt, T.TimestampType):
        return Ordinal(F.unix_micros(c), True, _instant)
    if isinstance(dt, T.TimestampNTZType):   # its wall clock, read as if it were UTC
        return Ordinal(_wall_clock(c), True, _instant)
    if isinstance(dt, T.DecimalType) and dt.precision <= 18:
        unscaled = (c * F.lit(Decimal(10) ** dt.scale)).cast("long")
        return Ordinal(unscaled, True, lambda v, s=dt.scale: Decimal(v).scaleb(-s), dt.scale)
    return Ordinal(num(c, dt), False, float)


def _wall_clock(c: Column) -> Column:
    day = F.unix_date(c.cast("date")).cast("long")
    minutes = (F.hour(c) * 60 + F.minute(c)).cast("long")
    micros = minutes * 60_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
    return day * 86_400_000_000 + micros


@dataclass
class OrderStatistics:
    """``n`` present values of a column and those at the wanted ranks (0-based);
    on request the values outside the Tukey fences and the sums of the second
    to fourth powers of the distances from ``mean``."""
    n: int
    at: dict[int, object] = field(default_factory=dict)
    mean: float | None = None
    powers: tuple[float, float, float] | None = None
    outliers: int | None = None
    reach: float = 1.5

    def exact(self, p: float) -> Decimal:
        """As ``linear``, without rounding (whole numbers and decimals)."""
        h = Decimal(str(p)) * (self.n - 1)
        lo, hi = Decimal(self.at[math.floor(h)]), Decimal(self.at[math.ceil(h)])
        return lo + (h - math.floor(h)) * (hi - lo)

    def fences(self) -> tuple[float, float] | None:
        """``reach`` quartile distances beyond the quartiles."""
        if not self.n:
            return None
        q1, q3 = self.linear(0.25), self.linear(0.75)
        return q1 - self.reach * (q3 - q1), q3 + self.reach * (q3 - q1)

    def lower(self, p: float):
        return self.at[math.floor(p * (self.n - 1))] if self.n else None

    def linear(self, p: float) -> float | None:
        """Linear interpolation between the two ranks around ``p``, in doubles."""
        if not self.n:
            return None
        h = p * (self.n - 1)
        lo, hi = math.floor(h), math.ceil(h)
        if lo == hi:
            return float(self.at[lo])
        return (hi - h) * float(self.at[lo]) + (h - lo) * float(self.at[hi])


@dataclass
class _Target:
    """A rank being searched: in [lo, hi] (None: no bound), which holds about
    ``inside`` values; ``least`` and ``most`` are bounds that counts proved."""
    lo: object = None
    hi: object = None
    inside: float = math.inf
    least: object = None
    most: object = None


def _margin() -> float:
    """Below a half, so that each pass moves at least one end of a bracket inwards."""
    return min(0.1, MARGIN * rank_error(SKETCH))


def _sketch(c: Column, whole: bool) -> Column:
    return (F.kll_sketch_agg_bigint if whole else F.kll_sketch_agg_double)(c, SKETCH)


def _merge(c: str, whole: bool) -> Column:
    return (F.kll_merge_agg_bigint if whole else F.kll_merge_agg_double)(c, SKETCH)


def two_levels(view: DataFrame, parts: dict[str, tuple[Column, Callable[[str], Column]]]):
    """One row of aggregates, merged first among groups of tasks, then once."""
    fan = max(1, int(view.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    some = view.groupBy((F.spark_partition_id() % fan).alias("_task")).agg(*[e.alias(n) for n, (e, _) in parts.items()])
    return some.agg(*[m(n).alias(n) for n, (_, m) in parts.items()]).first()


def _read_off(spark, sketches: dict[str, tuple[bytes, bool, list[float]]]) -> dict[str, list]:
    """Quantiles of each sketch at its own probabilities (one local row)."""
    if not sketches:
        return {}
    schema = ", ".join(f"{n} binary" for n in sketches)
    row = spark.createDataFrame([tuple(bytes(s) for s, _, _ in sketches.values())], schema)
    return row.select(*[
        (F.kll_sketch_get_quantile_bigint if whole else F.kll_sketch_get_quantile_double)(
            F.col(n), F.array(*[F.lit(float(p)) for p in probs])).alias(n)
        for n, (_, whole, probs) in sketches.items()]).first().asDict()


def order_statistics(df: DataFrame, cols: dict[str, Ordinal], probs: Sequence[float],
                     extra: dict[str, tuple[Column, Callable[[str], Column]]] | None = None,
                     summary: bool = False, fences: bool = False, reach: float = 1.5) -> tuple[dict[str, OrderStatistics], dict]:
    """For every column the exact values at the ranks of ``probs``. ``extra``
    names aggregates over ``df`` (and how to merge them) that ride along with
    pass one; their values are the second result. ``summary`` (power sums) and
    ``fences`` (outliers; needs the quartiles in ``probs``) ride along with
    pass two: the fences' own brackets follow from those of the quartiles."""
    names, extra = list(cols), extra or {}
    parts: dict = {}
    for i, c in enumerate(names):
        parts[f"n{i}"] = (F.count(cols[c].value), F.sum)
        parts[f"s{i}"] = (_sketch(cols[c].value, cols[c].whole), lambda n, w=cols[c].whole: _merge(n, w))
        if summary:
            parts[f"t{i}"] = (F.sum(cols[c].real(cols[c].value)), F.sum)
    parts.update({f"x{j}": x for j, x in enumerate(extra.values())})
    if not parts:
        return {}, {}
    row = two_levels(df, parts)
    also = {n: row[f"x{j}"] for j, n in enumerate(extra)}
    found, wanted, ask = {}, {}, {}
    margin = _margin()
    for i, c in enumerate(names):
        n = int(row[f"n{i}"] or 0)
        found[c] = OrderStatistics(n, mean=row[f"t{i}"] / n if summary and n else None, reach=reach)
        if not n:
            continue
        ranks = sorted({r for p in probs for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))})
        around = [(max(0.0, (k + 0.5) / n - margin), min(1.0, (k + 0.5) / n + margin)) for k in ranks]
        ask[f"s{i}"] = (row[f"s{i}"], cols[c].whole, [p for pair in around for p in pair])
        wanted.update({(c, k): _Target() for k in ranks})
    values = _read_off(df.sparkSession, ask)
    for i, c in enumerate(names):
        n = found[c].n
        for j, key in enumerate(key for key in wanted if key[0] == c):
            p = (key[1] + 0.5) / n
            lo, hi = values[f"s{i}"][2 * j:2 * j + 2]
            wanted[key] = _Target(lo if p > margin else None, hi if p < 1 - margin else None, 2 * margin * n)
    view = df.select(*[cols[c].value.alias(f"v{i}") for i, c in enumerate(names)])
    place = {c: i for i, c in enumerate(names)}
    counted = False
    while wanted:
        wide = {key: t for key, t in wanted.items() if t.inside > LIMIT}
        if wide:
            step = _narrow(view, place, cols, wide)
        else:
            step = _fetch(view, place, cols, wanted, found, summary and not counted, fences and not counted)
            counted = True
        for key, got in step.items():
            if isinstance(got, _Target):
                wanted[key] = got
            else:
                found[key[0]].at[key[1]] = cols[key[0]].back(got[0])
                del wanted[key]
    _count_late(view, place, cols, {c: o for c, o in found.items() if o.n}, summary, fences)
    return found, also


def _count_late(view: DataFrame, place: dict, cols: dict, found: dict, summary: bool, fences: bool) -> None:
    """One more scan for columns that no counting of regions could serve: a
    bracket was wrong, or ties settled all ranks before."""
    parts = {}
    for c, o in found.items():
        x = cols[c].real(F.col(f"v{place[c]}"))
        if summary and o.powers is None:
            d = x - F.lit(o.mean)
            parts[c, "powers"] = F.array(F.sum(d * d), F.sum(d * d * d), F.sum(d * d * d * d))
        if fences and o.outliers is None:
            lo, hi = o.fences()
            parts[c, "outliers"] = F.count_if((x < F.lit(lo)) | (x > F.lit(hi)))
    if parts:
        row = view.agg(*[e.alias(f"p{i}") for i, e in enumerate(parts.values())]).first()
        for i, (c, what) in enumerate(parts):
            setattr(found[c], what, tuple(row[f"p{i}"]) if what == "powers" else int(row[f"p{i}"]))


def _literal(v, whole: bool) -> Column:
    return F.lit(v).cast("long" if whole else "double")


def _narrow(view: DataFrame, place: dict, cols: dict, wide: dict) -> dict:
    """One scan: exact counts around each wide bracket and a sketch of its
    inside, from which a narrower one is read."""
    spark = view.sparkSession
    brackets = list(dict.fromkeys((c, t.lo, t.hi) for (c, _), t in wide.items()))
    parts: dict = {}
    for b, (c, lo, hi) in enumerate(brackets):
        v, whole = F.col(f"v{place[c]}"), cols[c].whole
        above = v.isNotNull() if lo is None else v > _literal(lo, whole)
        under = v.isNotNull() if hi is None else v < _literal(hi, whole)
        parts[f"below{b}"] = (F.lit(0) * F.count(v) if lo is None else F.count_if(v < _literal(lo, whole)), F.sum)
        parts[f"first{b}"] = (F.lit(0) * F.count(v) if lo is None else F.count_if(v == _literal(lo, whole)), F.sum)
        parts[f"last{b}"] = (F.lit(0) * F.count(v) if hi is None or hi == lo else F.count_if(v == _literal(hi, whole)), F.sum)
        parts[f"inside{b}"] = (F.count_if(above & under), F.sum)
        parts[f"s{b}"] = (_sketch(F.when(above & under, v), whole), lambda n, w=whole: _merge(n, w))
    row = two_levels(view, parts)
    margin = _margin()
    out, ask, at_ = {}, {}, {}
    for (c, k), t in wide.items():
        b = brackets.index((c, t.lo, t.hi))
        below, first, inside, last = (int(row[f"{x}{b}"] or 0) for x in ("below", "first", "inside", "last"))
        if k < below:                                   # the sketch was off: search what lies before
            out[c, k] = _Target(t.least, t.lo, math.inf, t.least, t.lo)
        elif k < below + first:
            out[c, k] = (t.lo,)
        elif k < below + first + inside:
            p = (k - below - first + 0.5) / inside
            ask.setdefault(f"s{b}", (row[f"s{b}"], cols[c].whole, []))[2].extend([max(0.0, p - margin), min(1.0, p + margin)])
            at_[c, k] = (b, len(ask[f"s{b}"][2]) - 2, t, p, inside)
        elif k < below + first + inside + last:
            out[c, k] = (t.hi,)
        else:
            out[c, k] = _Target(t.hi, t.most, math.inf, t.hi, t.most)
    values = _read_off(spark, ask)
    for key, (b, j, t, p, inside) in at_.items():
        lo, hi = values[f"s{b}"][j:j + 2]
        out[key] = _Target(lo if p > margin else t.lo, hi if p < 1 - margin else t.hi, 2 * margin * inside, t.lo, t.hi)
    return out


def _spans(targets) -> list[list]:
    """Brackets in order, those that touch joined."""
    out: list[list] = []
    for lo, hi in sorted({(t.lo, t.hi) for t in targets},
                         key=lambda s: (-math.inf if s[0] is None else s[0], math.inf if s[1] is None else s[1])):
        if out and (out[-1][1] is None or lo is None or lo <= out[-1][1]):
            out[-1][1] = None if hi is None or out[-1][1] is None else max(hi, out[-1][1])
        else:
            out.append([lo, hi])
    return out


def _fence_brackets(o: OrderStatistics, own: dict[int, _Target], scale: int):
    """Where the two fences must lie, given the quartiles' brackets (None: no bound known)."""
    def ends(p):
        h = p * (o.n - 1)
        lo, hi = math.floor(h), math.ceil(h)
        ts = [own.get(lo), own.get(hi)]
        low = float(o.at[lo]) if ts[0] is None else None if ts[0].lo is None else ts[0].lo / 10.0 ** scale
        high = float(o.at[hi]) if ts[1] is None else None if ts[1].hi is None else ts[1].hi / 10.0 ** scale
        return low, high

    (l1, h1), (l3, h3) = ends(0.25), ends(0.75)
    if None in (l1, h1, l3, h3) or not all(map(math.isfinite, (l1, h1, l3, h3))):
        return None
    k, slack = o.reach, 1e-9 * max(abs(l1), abs(h1), abs(l3), abs(h3))   # far beyond the rounding of the sums below
    return (l1 - k * (h3 - l1) - slack, h1 - k * (l3 - h1) + slack), (l3 + k * (l3 - h1) - slack, h3 + k * (h3 - l1) + slack)


def counted_regions(view: DataFrame, place: dict, cols: dict, wanted: dict, found: dict | None = None,
                    summary: bool = False, fences: bool = False) -> tuple[DataFrame, dict, dict]:
    """(c, region, zone, whole, real, n): regions below, between and above a
    column's brackets counted as wholes, the distinct values inside brackets
    one by one (all that is shuffled); likewise the zones around the fences.
    Also the brackets of each column, overlaps joined, and the fences' ones."""
    structs, edges, walls = [], {}, {}
    null = F.lit(None)
    for c in dict.fromkeys(c for c, _ in wanted):
        i, whole = place[c], cols[c].whole
        v = F.col(f"v{i}")
        own = {k: t for (x, k), t in wanted.items() if x == c}
        spans = edges[i] = _spans(own.values())
        region = None
        for r, (lo, hi) in enumerate(spans):   # 2r: before the bracket, 2r + 1: inside
            if lo is not None:
                below = v < _literal(lo, whole)
                region = F.when(below, 2 * r) if region is None else region.when(below, 2 * r)
            inside = v.isNotNull() if hi is None else v <= _literal(hi, whole)
            region = F.when(inside, 2 * r + 1) if region is None else region.when(inside, 2 * r + 1)
        region = region.otherwise(2 * len(spans))
        x = cols[c].real(v)
        zone = F.lit(2)
        wall = _fence_brackets(found[c], own, cols[c].scale) if fences else None
        if wall is not None:
            walls[i] = wall
            (a, b), (d, e) = wall
            zone = (F.when(x < F.lit(a), 0).when(x <= F.lit(b), 1).when(x < F.lit(d), 2).when(x <= F.lit(e), 3).otherwise(4))
        kept = F.when((region % 2 == 1) | (zone % 2 == 1), v)
        off = x - F.lit(found[c].mean) if summary else null.cast("double")
        structs.append(F.struct(F.lit(i).alias("c"), v.isNotNull().alias("present"), region.alias("region"), zone.alias("zone"),
                                (kept if whole else null).cast("long").alias("whole"),
                                (null if whole else kept).cast("double").alias("real"), off.alias("off")))
    d = F.col("off")
    powers = [F.sum(d * d).alias("m2"), F.sum(d * d * d).alias("m3"), F.sum(d * d * d * d).alias("m4")] if summary else []
    return (view.select(F.inline(F.array(*structs))).where("present")
            .groupBy("c", "region", "zone", "whole", "real").agg(F.count(F.lit(1)).alias("n"), *powers)), edges, walls


def _fetch(view: DataFrame, place: dict, cols: dict, wanted: dict, found: dict | None = None,
           summary: bool = False, fences: bool = False) -> dict:
    """One scan and one small shuffle: the running sums over the counted
    regions say which value stands at a wanted rank; the rest of what was
    asked for is read off the same counts."""
    spark = view.sparkSession
    counted, edges, walls = counted_regions(view, place, cols, wanted, found, summary, fences)
    counted = counted.persist()
    try:
        odd = F.col("region") % 2 == 1
        only = counted.groupBy("c", "region", F.when(odd, F.col("whole")).alias("whole"), F.when(odd, F.col("real")).alias("real")).agg(F.sum("n").alias("n"))
        run = Window.partitionBy("c").orderBy("region", "whole", "real").rowsBetween(Window.unboundedPreceding, 0)
        upto = only.withColumn("upto", F.sum("n").over(run))
        asked = F.broadcast(spark.createDataFrame([(place[c], k) for c, k in wanted], "c int, k long"))
        hits = upto.join(asked, "c").where((F.col("k") < F.col("upto")) & (F.col("k") >= F.col("upto") - F.col("n")))
        names = {i: c for c, i in place.items()}
        out = {}
        for r in hits.collect():
            c = names[r["c"]]
            if r["region"] % 2:
                out[c, r["k"]] = (r["whole"] if cols[c].whole else r["real"],)
            else:                                    # the gap between two brackets
                gap, spans = r["region"] // 2, edges[r["c"]]
                lo, hi = spans[gap - 1][1] if gap else None, spans[gap][0] if gap < len(spans) else None
                out[c, r["k"]] = _Target(lo, hi, float(r["n"]), lo, hi)
        if summary or walls:
            _read_counts(counted, names, cols, found, out, summary, walls)
    finally:
        counted.unpersist()
    return out


def _read_counts(counted: DataFrame, names: dict, cols: dict, found: dict, got: dict, summary: bool, walls: dict) -> None:
    """Power sums, and what lies outside the fences of columns whose quartiles
    are now known and inside their brackets, from the counted regions."""
    limits = []
    for i in walls:
        c = names[i]
        if any(x == c and isinstance(t, _Target) for (x, _), t in got.items()):
            continue
        known = OrderStatistics(found[c].n, found[c].at | {k: cols[c].back(t[0]) for (x, k), t in got.items() if x == c}, reach=found[c].reach)
        (a, b), (d, e), (lo, hi) = *walls[i], known.fences()
        if a <= lo <= b and d <= hi <= e:
            limits.append((i, lo, hi, 10.0 ** cols[c].scale))
    table = counted.join(F.broadcast(counted.sparkSession.createDataFrame(limits, "c int, lo double, hi double, unit double")), "c", "left")
    x = F.coalesce(F.col("real"), F.col("whole").cast("double") / F.col("unit"))
    out = (F.col("zone") == 0) | (F.col("zone") == 4) | ((F.col("zone") == 1) & (x < F.col("lo"))) | ((F.col("zone") == 3) & (x > F.col("hi")))
    powers = [F.sum(m).alias(m) for m in ("m2", "m3", "m4")] if summary else []
    for r in table.groupBy("c").agg(F.max("lo").alias("lo"), F.sum(F.when(out, F.col("n")).otherwise(0)).alias("out"), *powers).collect():
        o = found[names[r["c"]]]
        if r["lo"] is not None:
            o.outliers = int(r["out"])
        if summary:
            o.powers = (r["m2"], r["m3"], r["m4"])


# ---------------------------------------------------------------- per group

#: size of a group's sketch: groups of at most so many values are exact at once
GROUP_SKETCH = 512
#: steps of the grid on which a group's sketch is read
GRID = 64
#: groups (with their brackets) that may be sent to every task
BROADCAST_GROUPS = 1_000_000


def _grid(sketch: str) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]))


def _around(grid: Column, rank: Column) -> tuple[Column, Column]:
    """The bracket around a relative rank, one grid step and the sketch's error wider."""
    slack = MARGIN * rank_error(GROUP_SKETCH)
    low = F.greatest(F.floor((rank - slack) * GRID), F.lit(0)).cast("int")
    high = F.least(F.ceil((rank + slack) * GRID), F.lit(GRID)).cast("int")
    return F.get(grid, low), F.get(grid, high)


def grouped_medians(long: DataFrame, keys: Sequence[str], aggs: dict[str, Column], value: str = "value") -> DataFrame:
    """``keys``, the aggregates ``aggs`` and the exact ``median`` of a double
    column per group, from one grouping whose buffers also hold a quantile
    sketch. Groups of up to ``GROUP_SKETCH`` values are exact in it; for the
    others a second scan counts what lies below their brackets and fetches the
    values inside, narrowed before where a bracket holds more than ``LIMIT``."""
    from tablelens.functions.frames import materialize

    n, s, q = "_tl_n", "_tl_sketch", "_tl_grid"
    base = long.groupBy(*keys).agg(*[e.alias(a) for a, e in aggs.items()], F.count(value).alias(n),
                                   F.kll_sketch_agg_double(value, GROUP_SKETCH).alias(s))
    some = F.col(n) > 0
    middle = F.kll_sketch_get_quantile_double(s, F.array(F.lit(0.5), F.lit(0.5 + 0.25 / GROUP_SKETCH)))
    exact = F.when(some & (F.col(n) <= GROUP_SKETCH), (F.get(middle, F.lit(0)) + F.get(middle, F.lit(1))) / 2)
    base = materialize(base.select(*keys, *aggs, n, F.when(F.col(n) > GROUP_SKETCH, _grid(s)).alias(q), exact.alias("median")), "grouped")
    large = base.where(F.col(n) > GROUP_SKETCH)
    if large.isEmpty():
        return base.drop(n, q)
    ranks = F.explode(F.array_distinct(F.array(F.floor((F.col(n) - 1) / 2), F.ceil((F.col(n) - 1) / 2))))
    targets = large.select(*keys, n, q, ranks.alias("_tl_k"))
    lo, hi = _around(F.col(q), (F.col("_tl_k") + 0.5) / F.col(n))
    share = 2 * MARGIN * rank_error(GROUP_SKETCH) + 2 / GRID
    state = targets.select(*keys, n, "_tl_k", lo.alias("_tl_lo"), hi.alias("_tl_hi"), (share * F.col(n)).alias("_tl_in"))
    done = None
    while True:
        state = materialize(state, "group-brackets")
        if state.isEmpty():
            break
        wide = state.where(F.col("_tl_in") > LIMIT)
        step = _narrow_groups(long, keys, value, wide) if not wide.isEmpty() else _fetch_groups(long, keys, value, state)
        step = materialize(step, "group-step")
        found = step.where(F.col("_tl_v").isNotNull()).select(*keys, "_tl_v")
        done = found if done is None else done.unionByName(found)
        rest = state.where(F.col("_tl_in") <= LIMIT) if not wide.isEmpty() else None
        state = step.where(F.col("_tl_v").isNull()).drop("_tl_v")
        state = state if rest is None else state.unionByName(rest)
    mean = done.groupBy(*keys).agg(F.avg("_tl_v").alias("_tl_median"))   # one or two middle values
    out = base.join(mean, list(keys), "left")
    return out.select(*keys, *aggs, F.coalesce("median", "_tl_median").alias("median"))


def _side(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_GROUPS else df


_TARGET = ("_tl_n", "_tl_k", "_tl_lo", "_tl_hi", "_tl_in")


def _narrow_groups(long: DataFrame, keys: Sequence[str], value: str, wide: DataFrame) -> DataFrame:
    """Targets with exact counts around their brackets: the value where a tie
    at an end settles it (``_tl_v``), else a bracket that is proved and narrower."""
    v, lo, hi, k = F.col(value), F.col("_tl_lo"), F.col("_tl_hi"), F.col("_tl_k")
    inner = (v > lo) & (v < hi)
    met = (long.where(v.isNotNull()).join(_side(wide), list(keys)).groupBy(*keys, *_TARGET)
           .agg(F.count_if(v < lo).alias("below"), F.count_if(v == lo).alias("first"), F.count_if(inner).alias("inside"),
                F.count_if((v == hi) & (hi > lo)).alias("last"), F.kll_sketch_agg_double(F.when(inner, v), GROUP_SKETCH).alias("s")))
    start = F.col("below") + F.col("first")
    hit = (k >= start) & (k < start + F.col("inside"))
    a, b = _around(F.col("grid"), (k - start + 0.5) / F.col("inside"))
    met = met.withColumn("grid", F.when(F.col("inside") > 0, _grid("s")))
    tie = F.when((k >= F.col("below")) & (k < start), lo).when((k >= start + F.col("inside")) & (k < start + F.col("inside") + F.col("last")), hi)
    share = 2 * MARGIN * rank_error(GROUP_SKETCH) + 2 / GRID
    return met.select(
        *keys, "_tl_n", "_tl_k",
        F.when(hit, F.greatest(a, lo)).when(k < F.col("below"), F.lit(-math.inf)).otherwise(hi).alias("_tl_lo"),
        F.when(hit, F.least(b, hi)).when(k < F.col("below"), lo).otherwise(F.lit(math.inf)).alias("_tl_hi"),
        F.when(hit, share * F.col("inside")).otherwise(F.lit(math.inf)).alias("_tl_in"), tie.alias("_tl_v"))


def _fetch_groups(long: DataFrame, keys: Sequence[str], value: str, state: DataFrame) -> DataFrame:
    """Targets with the value at their rank (``_tl_v``), from the counts below
    their brackets and of each value inside; a target that its bracket missed
    comes back with the whole group as its bracket."""
    v, lo, hi = F.col(value), F.col("_tl_lo"), F.col("_tl_hi")
    inside = v >= lo
    met = (long.where(v.isNotNull()).join(_side(state), list(keys)).where(v <= hi)
           .groupBy(*keys, *_TARGET, F.when(inside, v).alias("_tl_v")).agg(F.count(F.lit(1)).alias("c")))
    run = Window.partitionBy(*keys, "_tl_k").orderBy(F.asc_nulls_first("_tl_v")).rowsBetween(Window.unboundedPreceding, 0)
    upto = met.withColumn("upto", F.sum("c").over(run))
    hit = upto.where((F.col("_tl_k") < F.col("upto")) & (F.col("_tl_k") >= F.col("upto") - F.col("c")) & F.col("_tl_v").isNotNull())
    got = hit.select(*keys, "_tl_k", "_tl_v")
    return state.join(got, [*keys, "_tl_k"], "left").select(
        *keys, "_tl_n", "_tl_k", F.lit(-math.inf).alias("_tl_lo"), F.lit(math.inf).alias("_tl_hi"),
        F.col("_tl_n").cast("double").alias("_tl_in"), "_tl_v")
