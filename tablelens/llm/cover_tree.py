"""Exact top-k by inner product with dual cover trees.

The data is dealt into blocks of bounded size; a cover tree is built over each
block and over the queries that meet it. Both trees are walked together: for a
query node and a data node the largest inner product any of their members can
have is bounded by the two centres and their covering radii,

    <q, r>  <=  <cq, cr> + rq |cr| + rr |cq| + rq rr,

and a pair of nodes is dropped when that bound is below the worst k-th score
among the node's queries. Queries carry their k-th score so far: they first
meet one block (phase one), which gives every query a true lower bound, and
then all other blocks (phase two) with that bound already in hand.

Scores are exact integers: a product of doubles where no sum can pass 2^53,
else of 64-bit integers (a score beyond those raises). A node pair is dropped
only when its bound is *below* the worst score (never on a tie), so ties go to
the smaller id. A node that its net does not divide stays whole as a leaf.

Defined cases: null vectors, vectors with null or non-finite components and
empty vectors take no part; vectors meet only vectors of their own length;
rows without an id are left out; of repeated rows each is a query of its own
and a candidate of all others (its copies too); a query with fewer candidates
than ``k`` gets all it has; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelens.llm.common import stored

BLOCK_ROWS = 8192    # data vectors a block (the bound on what a task holds)
QUERY_ROWS = 2048    # queries a group
LEAF = 32            # nodes of at most this many members are not split
SLACK = 1e-6         # relative allowance for rounding in the bounds
NO_FLOOR = -(1 << 63)   # the k-th score of a query that has fewer candidates yet


class CoverTree:
    """Centres, covering radii and members of the nodes; children halve the radius."""

    def __init__(self, x: np.ndarray) -> None:
        self.x = x
        self.center: list[np.ndarray] = []
        self.radius: list[float] = []
        self.members: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self._build(np.arange(len(x)))
        self.c = np.array(self.center)
        self.r = np.array(self.radius)
        self.norm = np.sqrt((self.c * self.c).sum(axis=1))

    def _node(self, idx: np.ndarray) -> int:
        pts = self.x[idx]
        c = pts.mean(axis=0)
        self.center.append(c)
        self.radius.append(float(np.sqrt(((pts - c) ** 2).sum(axis=1).max())))
        self.members.append(idx)
        self.children.append([])
        return len(self.center) - 1

    def _build(self, idx: np.ndarray) -> None:
        todo = [self._node(idx)]
        while todo:
            at = todo.pop()
            idx, radius = self.members[at], self.radius[at]
            if len(idx) <= LEAF or radius == 0.0:
                continue
            parts = self._cover(idx, radius / 2)
            if len(parts) < 2:               # nothing told apart: a leaf, whatever its size
                continue
            for part in parts:
                child = self._node(part)
                self.children[at].append(child)
                todo.append(child)

    def _cover(self, idx: np.ndarray, radius: float) -> list[np.ndarray]:
        """A net of points more than ``radius`` apart that covers all; when it
        grows past a few dozen centres the rest goes to its nearest centre (the
        covering radius is measured afterwards, so bounds stay true)."""
        pts = self.x[idx] - self.x[idx].mean(axis=0)   # far from the origin squares would cancel
        sq = (pts * pts).sum(axis=1)
        near = np.full(len(idx), np.inf)
        own = np.zeros(len(idx), dtype=np.int64)
        nxt, n = 0, 0
        while n < 48:
            d = sq - 2 * (pts @ pts[nxt]) + sq[nxt]
            closer = d < near
            near[closer], own[closer] = d[closer], n
            near[nxt], own[nxt] = 0.0, n
            n += 1
            nxt = int(near.argmax())
            if near[nxt] <= radius * radius:
                break
        return [idx[own == i] for i in range(n) if (own == i).any()]


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors (held as doubles), exact in 64 bits."""
    if not len(q) or not len(x):
        return np.zeros((len(q), len(x)), dtype=np.int64)
    reach = float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1]
    if reach < 2.0 ** 53:
        return (q @ x.T).astype(np.int64)
    if reach < 2.0 ** 62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    whole = np.array([[int(v) for v in r] for r in q], dtype=object) @ np.array([[int(v) for v in r] for r in x], dtype=object).T
    if max(map(abs, whole.ravel())) >= 1 << 63:
        raise OverflowError("a score does not fit 64 bits")
    return whole.astype(np.int64)


def _merge(score: np.ndarray, ids: np.ndarray, more: np.ndarray, more_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Best k of a query's kept and new candidates: higher score, then smaller id."""
    s, i = np.concatenate([score, more]), np.concatenate([ids, more_ids])
    if len(s) > 4 * k + 64:
        cut = np.partition(s, len(s) - k)[len(s) - k]
        keep = s >= cut
        s, i = s[keep], i[keep]
    order = np.lexsort((i, -s))[:k]
    return s[order], i[order]


def dual_top_k(q: np.ndarray, q_rows: np.ndarray, floor: np.ndarray, x: np.ndarray, x_rows: np.ndarray, x_ids: np.ndarray,
               k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the candidates of this block that can be among its best
    ``k``: (scores, ids). ``floor`` is the k-th score each query has already."""
    best = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)) for _ in q]
    worst = floor.astype(np.int64)           # a true lower bound of each query's final k-th score
    qt, xt = CoverTree(q), CoverTree(x)

    def bounds(a: int, nodes: np.ndarray) -> np.ndarray:
        b = xt.c[nodes] @ qt.c[a] + qt.r[a] * xt.norm[nodes] + xt.r[nodes] * qt.norm[a] + qt.r[a] * xt.r[nodes]
        return b + SLACK * (1 + np.abs(b))

    stack = [(0, np.array([0]))]
    while stack:
        a, nodes = stack.pop()
        limit = worst[qt.members[a]].min()
        nodes = nodes[bounds(a, nodes) >= limit]
        if not len(nodes):
            continue
        open_ = [n for n in nodes if xt.children[n]]
        leaves = [n for n in nodes if not xt.children[n]]
        if open_:                            # go down in the data, and in the queries with it
            down = np.array(leaves + [c for n in open_ for c in xt.children[n]])
            stack.extend((c, down) for c in (qt.children[a] or [a]))
            continue
        if qt.children[a]:
            stack.extend((c, nodes) for c in qt.children[a])
            continue
        mine = qt.members[a]
        b = bounds(a, nodes)
        at, group = 0, 1
        order = np.argsort(-b)
        while at < len(order):               # most promising leaves first; the bound tightens as they are read
            now = order[at:at + group]
            now = now[b[now] >= worst[mine].min()]
            if not len(now):
                break
            idx = np.concatenate([xt.members[nodes[i]] for i in now])
            scores = exact_scores(q[mine], x[idx])
            for row, j in enumerate(mine):
                s = scores[row]
                ok = (s >= worst[j]) & (x_rows[idx] != q_rows[j])
                if ok.any():
                    best[j] = _merge(*best[j], s[ok], x_ids[idx[ok]], k)
                    if len(best[j][0]) == k:
                        worst[j] = max(worst[j], best[j][0][-1])
            at += group
            group = min(group * 2, 64)
    return best


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(row, vec_id, vec): floor(scale * component) as double, of vectors with an id whose components are all finite."""
    v = F.col(vec_col).cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.filter(F.coalesce(fine, F.lit(False)) & F.col(id_col).cast("long").isNotNull()).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"),
        F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("double")).alias("vec"))


def _matrix(col: pa.ChunkedArray | pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in col])


def _search(pairs: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(query_row, query_id, vec_id, score) of every (query group, block) that meets."""

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(left) and len(right):
            x, rows, ids = _matrix(right["vec"]), right["row"].to_numpy(np.int64), right["vec_id"].to_numpy(np.int64)
            for at in range(0, len(left), QUERY_ROWS):
                part = left.iloc[at:at + QUERY_ROWS]
                q_rows = part["query_row"].to_numpy(np.int64)
                found = dual_top_k(_matrix(part["vec"]), q_rows, part["floor"].to_numpy(np.int64), x, rows, ids, k)
                n = [len(s) for s, _ in found]
                out.append(pd.DataFrame({"query_row": np.repeat(q_rows, n), "query_id": np.repeat(part["query_id"].to_numpy(np.int64), n),
                                         "vec_id": np.concatenate([i for _, i in found]), "score": np.concatenate([s for s, _ in found])}))
        return pd.concat(out) if out else pd.DataFrame({"query_row": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")

    keys = ("dim", "block", "part")
    return (pairs.groupBy(*keys).cogroup(blocks.groupBy(*keys))
            .applyInPandas(meet, "query_row long, query_id long, vec_id long, score long"))


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_k(df: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id",
          vec_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best for every row where
    ``is_query`` holds (an expression over ``vec_id``), against every other row."""
    rows = stored(integer_vectors(df, id_col, vec_col, scale).withColumn("dim", F.size("vec")), "vectors")
    n = rows.count()
    blocks_n = max(1, -(-n // block_rows))
    blocks = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks_n)).cast("int")).withColumn("part", F.lit(0))
    queries = rows.filter(is_query).select(*[F.col(a).alias(b) for a, b in (("row", "query_row"), ("vec_id", "query_id"), ("vec", "vec"), ("dim", "dim"))])
    home = F.pmod(F.xxhash64("query_row"), F.lit(blocks_n)).cast("int")
    none = F.lit(NO_FLOOR).cast("long")
    asked = ("query_row", "query_id", "vec", "dim")
    first = stored(_search(queries.select(*asked, home.alias("block"), F.lit(0).alias("part"), none.alias("floor")), blocks, k), "top-first")
    if blocks_n == 1:
        return _best(first, k).select("query_id", "rank", "vec_id", "score")
    kth = _best(first, k).groupBy(F.col("query_row").alias("__ct_row")).agg(
        F.when(F.count(F.lit(1)) == k, F.min("score")).alias("kth"))
    parts_n = max(1, -(-queries.count() // QUERY_ROWS))   # a task meets about QUERY_ROWS queries, however many there are
    part = F.pmod(F.hash("query_row"), F.lit(parts_n)).cast("int")
    met = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts_n - 1))))
    rest = (queries.join(kth, F.col("query_row") == F.col("__ct_row"), "left")
            .select(*asked, F.coalesce("kth", none).alias("floor"), home.alias("__ct_home"), part.alias("part"))
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks_n - 1))))
            .filter(F.col("block") != F.col("__ct_home")).drop("__ct_home"))
    return _best(first.unionByName(_search(rest, met, k)), k).select("query_id", "rank", "vec_id", "score")
