"""Pairs of columns and the multivariate view.

* Correlations of all numeric pairs come from ONE aggregation (pairwise
  complete rows, null when a side is constant).
* Spearman ranks are exact average ranks: the rows are first collapsed to
  distinct ``(a, b)`` pairs with a weight, which take the ranks of either side
  from a range exchange (:mod:`tablelens.functions.ranges`).
* Contingency tables are long ``(a, b, n)``; the chi-square statistic needs only
  the observed cells and the margins. Zero cells are listed only on request.
* Tail probabilities are computed on the result rows (one per test).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.functions import special
from tablelens.functions.frames import materialize, rounded
from tablelens.functions.gram import gram_sums
from tablelens.functions.quantiles import average_ranks, quantiles
from tablelens.functions.ranges import numbered, with_average_rank
from tablelens.functions.selection import grouped_medians
from tablelens.functions.stats import at, num, pearson
from tablelens.operators import kinds as K

#: column values per literal array when a dense contingency table is listed
DENSE_STEP = 10_000
#: most column pairs computed as one built-in aggregation (beyond: matrix products per task)
PAIRS_PER_AGG = 1_000


def _num(df: DataFrame, c: str):
    return num(c, df.schema[c].dataType)


# ---------------------------------------------------------------- P7, M1, D5–D7

def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None, diagonal: bool = True,
                       method: str = "auto", decimals: int | None = None) -> DataFrame:
    """Long (col_a, col_b, i, j, r, n) for every pair i <= j of numeric
    columns (i == j only with ``diagonal``), pairwise-complete rows.

    Two passes: column means and null counts (one row fetched), then the sums
    of the mean-shifted values — Σa, Σb, Σab, Σa², Σb² per pair over its
    complete rows. The shift keeps the sums free of cancellation. Up to
    ``PAIRS_PER_AGG`` pairs the sums are ONE built-in aggregation (for columns
    without nulls the per-pair sums are the same expression for every pair,
    so Spark computes each once); wider tables (or ``method='gram'``) use
    matrix products of column tiles in the tasks (``gram_sums``)."""
    cols = list(cols) if cols is not None else K.numeric_columns(df)
    schema = "col_a string, col_b string, i int, j int, r double, n long"
    pairs = [(i, j) for i in range(len(cols)) for j in range(i if diagonal else i + 1, len(cols))]
    if not pairs:
        return df.sparkSession.createDataFrame([], schema)
    v = df.select(*[_num(df, c).alias(c) for c in cols])
    first = v.agg(F.count(F.lit(1)).alias("_rows"), *[F.avg(at(c)).alias(f"m{k}") for k, c in enumerate(cols)],
                  *[F.count(at(c)).alias(f"n{k}") for k, c in enumerate(cols)]).first()
    rows = first["_rows"]
    means = [float(first[f"m{k}"] or 0.0) for k in range(len(cols))]
    if method == "gram" or (method == "auto" and len(pairs) > PAIRS_PER_AGG):
        sums = gram_sums(v, cols, means, diagonal)
    else:
        full = [first[f"n{k}"] == rows for k in range(len(cols))]
        x = [at(c) - F.lit(means[k]) for k, c in enumerate(cols)]
        structs = []
        for i, j in pairs:
            if full[i] and full[j]:
                a, b, n = x[i], x[j], F.count(F.lit(1))
            else:
                both = at(cols[i]).isNotNull() & at(cols[j]).isNotNull()
                a, b = F.when(both, x[i]), F.when(both, x[j])
                n = F.count(a)
            structs.append(F.struct(
                F.lit(i).alias("i"), F.lit(j).alias("j"),
                n.cast("double").alias("n"), F.sum(a).alias("sa"), F.sum(b).alias("sb"), F.sum(a * b).alias("sab"),
                F.sum(a * a).alias("saa"), F.sum(b * b).alias("sbb")))
        sums = v.agg(F.array(*structs).alias("_s")).select(F.inline("_s"))
    names = df.sparkSession.createDataFrame([(k, c) for k, c in enumerate(cols)], "k int, name string")
    sums = (sums.join(F.broadcast(names.select(F.col("k").alias("i"), F.col("name").alias("col_a"))), "i")
            .join(F.broadcast(names.select(F.col("k").alias("j"), F.col("name").alias("col_b"))), "j"))
    n = F.col("n").cast("double")
    cov = F.col("sab") - F.col("sa") * F.col("sb") / n
    va = F.col("saa") - F.col("sa") * F.col("sa") / n
    vb = F.col("sbb") - F.col("sb") * F.col("sb") / n
    r = F.when((n >= 2) & (va > 0) & (vb > 0), cov / F.sqrt(va * vb))
    r = F.when(r > 1.0, F.lit(1.0)).when(r < -1.0, F.lit(-1.0)).otherwise(r)
    return rounded(sums.select("col_a", "col_b", "i", "j", r.alias("r"), F.col("n").cast("long").alias("n")), decimals)


def correlation_pairs(df: DataFrame, cols: Sequence[str] | None = None,
                      strong: float = 0.7, moderate: float = 0.3) -> DataFrame:
    """M1: upper-triangle pairs with |r| > moderate, labelled strong/moderate."""
    m = correlation_matrix(df, cols, diagonal=False)
    a = F.abs(F.col("r"))
    return (m.where(a > moderate)
            .select(F.concat_ws(" - ", "col_a", "col_b").alias("pair"), "col_a", "col_b", "i", "j", "r",
                    F.when(a > strong, "strong").otherwise("moderate").alias("strength")))


def correlation_heatmap(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """The full square matrix (both triangles and the diagonal), long form."""
    m = correlation_matrix(df, cols, diagonal=True)
    mirror = m.where(F.col("i") != F.col("j")).select(
        F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), F.col("j").alias("i"),
        F.col("i").alias("j"), "r", "n")
    return m.unionByName(mirror)


def correlation_network(df: DataFrame, cols: Sequence[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """Pairs with |r| above the threshold."""
    return (correlation_matrix(df, cols, diagonal=False)
            .where(F.abs("r") > threshold).select("col_a", "col_b", "r"))


def correlation_strength_bars(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Every pair with |r|, weakest first."""
    m = correlation_matrix(df, cols, diagonal=False)
    return (m.select(F.concat_ws(" - ", "col_a", "col_b").alias("pair"), F.abs("r").alias("abs_r"))
            .orderBy("abs_r", "pair"))


def scatter_trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line of y on x over complete rows, with r and r²."""
    a, b = _num(df, x), _num(df, y)
    v = df.select(a.alias("x"), b.alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    return v.agg(
        F.regr_count("y", "x").alias("n"), F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"),
        pearson(F.col("x"), F.col("y")).alias("r"))


# ---------------------------------------------------------------- B1, B2, B3

def _strength(r):
    if r is None:
        return "weak"
    a = abs(r)
    return "strong" if a > 0.7 else "moderate" if a > 0.3 else "weak"


def _association(p):
    if p is None:
        return "weak"
    return "strong" if p < 0.001 else "moderate" if p < 0.05 else "weak"


def _nan_none(x):
    return None if x is None or (isinstance(x, float) and math.isnan(x)) else x


def pearson_test(df: DataFrame, a: str, b: str) -> DataFrame:
    """B1 + B3: r, pairs used, two-sided p, strength. One aggregation; the p of
    the single result row is computed where the row lands."""
    x, y = _num(df, a), _num(df, b)
    v = df.select(x.alias("x"), y.alias("y"))
    row = v.agg(pearson(F.col("x"), F.col("y")).alias("r"),
                F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)).alias("n")).first()
    r, n = row["r"], int(row["n"])
    p = _nan_none(special.t_two_sided_from_r(r, n)) if r is not None else None
    return df.sparkSession.createDataFrame(
        [(a, b, n, r, p, _strength(r))],
        "column1 string, column2 string, n long, r double, p_value double, strength string")


def spearman_r(v: DataFrame, method: str = "auto") -> tuple[int, float | None]:
    """(n, rho) of columns x, y (doubles) over complete rows, from exact average ranks.

    The complete rows are shuffled once, into distinct ``(x, y, w)`` pairs; a
    range exchange by x gives them the ranks of x, one by y those of y, and
    nothing is joined back by value (``method`` ``window`` or ``distributed``
    forces a plan that does). Average ranks of n rows always sum to n(n+1)/2,
    so one pass of plain weighted sums gives rho."""
    comp = v.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    sums = [F.sum("w").alias("n"), F.sum(F.col("w") * F.col("rx") * F.col("ry")).alias("sxy"),
            F.sum(F.col("w") * F.col("rx") * F.col("rx")).alias("sxx"), F.sum(F.col("w") * F.col("ry") * F.col("ry")).alias("syy")]
    pairs = comp.groupBy("x", "y").agg(F.count(F.lit(1)).alias("w"))
    if method == "auto":
        pairs = materialize(pairs, "pairs")
        rows = pairs.count()
        by_x = with_average_rank(pairs, "x", "w", "y", "rx", rows)
        row = with_average_rank(by_x, "y", "w", "x", "ry", rows).agg(*sums).first()
    else:
        pairs = pairs.persist()
        try:
            long = pairs.select("w", F.inline(F.array(
                F.struct(F.lit("x").alias("column"), F.col("x").alias("value")),
                F.struct(F.lit("y").alias("column"), F.col("y").alias("value")))))
            ranks = average_ranks(long, ["column"], "value", method=method, weight="w")
            rx = ranks.where(F.col("column") == "x").select(F.col("value").alias("x"), F.col("rank").alias("rx"))
            ry = ranks.where(F.col("column") == "y").select(F.col("value").alias("y"), F.col("rank").alias("ry"))
            row = pairs.join(rx, "x").join(ry, "y").agg(*sums).first()
        finally:
            pairs.unpersist()
    n = int(row["n"] or 0)
    if n < 2:
        return n, None
    m2 = n * ((n + 1) / 2.0) ** 2
    vx, vy = row["sxx"] - m2, row["syy"] - m2
    if vx <= 0 or vy <= 0:
        return n, None
    rho = (row["sxy"] - m2) / math.sqrt(vx * vy)
    return n, max(-1.0, min(1.0, rho))


def spearman_test(df: DataFrame, a: str, b: str, method: str = "auto") -> DataFrame:
    """B2: Spearman rho (average ranks on ties) over complete rows and its p."""
    v = df.select(_num(df, a).alias("x"), _num(df, b).alias("y"))
    n, rho = spearman_r(v, method)
    p = _nan_none(special.t_two_sided_from_r(rho, n)) if rho is not None else None
    return df.sparkSession.createDataFrame(
        [(a, b, n, rho, p, _strength(rho))],
        "column1 string, column2 string, n long, rho double, p_value double, strength string")


# ---------------------------------------------------------------- B4, B5, B6, G8

def contingency(df: DataFrame, a: str, b: str, zeros: bool = False) -> DataFrame:
    """(a, b, n) over rows where both are present. ``zeros=True`` adds
    the empty cells: the result is then the whole dense table, as asked."""
    pair = df.select(at(a).cast("string").alias("a"), at(b).cast("string").alias("b")).where(
        F.col("a").isNotNull() & F.col("b").isNotNull())
    cells = pair.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    if not zeros:
        return cells.select(F.col("a").alias(a), F.col("b").alias(b), "n")
    # every a-value meets every chunk of DENSE_STEP b-values; the values stay
    # data (never column names, never on the driver), so any text is allowed
    cells = materialize(cells, "cells")
    bvals = cells.select("b").distinct()
    chunks = numbered(bvals, [F.col("b")], "_k").withColumn("_chunk", F.floor(F.col("_k") / DENSE_STEP))
    chunks = materialize(chunks.groupBy("_chunk").agg(F.collect_list("b").alias("_bs")), "dense-chunks")
    last = chunks.agg(F.max("_chunk")).first()[0]
    if last is None:
        return cells.select(F.col("a").alias(a), F.col("b").alias(b), "n")
    grid = (cells.select(F.col("a").alias("_a")).distinct().withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(last).cast("long"))))
            .join(chunks, "_chunk").select("_a", F.explode("_bs").alias("_b")))
    dense = grid.join(cells, (F.col("_a") == F.col("a")) & (F.col("_b") == F.col("b")), "left")
    return dense.select(F.col("_a").alias(a), F.col("_b").alias(b), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def chi_square_stats(cells: DataFrame) -> dict:
    """B5 on a long contingency table ``(a, b, n)`` of observed (non-zero) cells:
    n, dof, chi2 and p, with Yates' continuity correction when dof = 1.

    chi2 = Σ (o − e)² / e over the observed cells, plus the expected counts of
    the empty ones (N − Σ e); it needs only observed cells and margins;
    the 2×2 case lists its four cells (zeros included) from the margins."""
    cells = cells.persist()
    try:
        ra = cells.groupBy("a").agg(F.sum("n").alias("ra"))
        cb = cells.groupBy("b").agg(F.sum("n").alias("cb"))
        tot = cells.agg(F.sum("n").alias("nn"), F.count_distinct("a").alias("r"),
                        F.count_distinct("b").alias("c"), F.count(F.lit(1)).alias("cells")).first()
        total, r, c = int(tot["nn"] or 0), int(tot["r"]), int(tot["c"])
        dof = (r - 1) * (c - 1)
        if total == 0:
            return {"n": 0, "dof": dof, "chi2": None, "p_value": None}
        if dof == 0:
            return {"n": total, "dof": 0, "chi2": 0.0, "p_value": 1.0}
        if dof == 1:  # 2×2: the four cells, zeros included, from the margins (bounded)
            rows = {x["a"]: x["ra"] for x in ra.collect()}
            cols = {x["b"]: x["cb"] for x in cb.collect()}
            obs = {(x["a"], x["b"]): x["n"] for x in cells.collect()}
            chi2 = 0.0
            for ka, na in rows.items():
                for kb, nb in cols.items():
                    e = na * nb / total
                    d = abs(obs.get((ka, kb), 0) - e)
                    chi2 += (d - min(0.5, d)) ** 2 / e
        else:
            # doubles (bigint products overflow), and no cancellation: the
            # observed cells' (o - e)^2 / e, plus what the empty cells expect
            e = F.col("ra").cast("double") * F.col("cb").cast("double") / F.lit(float(total))
            s = cells.join(ra, "a").join(cb, "b").select("n", e.alias("e")).agg(
                F.sum((F.col("n") - F.col("e")) * (F.col("n") - F.col("e")) / F.col("e")).alias("s"),
                F.sum("e").alias("e")).first()
            full = int(tot["cells"]) == r * c
            chi2 = s["s"] + (0.0 if full else max(total - s["e"], 0.0))
    finally:
        cells.unpersist()
    return {"n": total, "dof": dof, "chi2": chi2, "p_value": _nan_none(special.chi2_sf(chi2, dof))}


def chi_square(cells: DataFrame) -> DataFrame:
    """B5 as a one-row DataFrame (n, dof, chi2, p_value)."""
    st = chi_square_stats(cells)
    return cells.sparkSession.createDataFrame([(st["n"], st["dof"], st["chi2"], st["p_value"])],
                                              "n long, dof long, chi2 double, p_value double")


def chi_square_test(df: DataFrame, a: str, b: str) -> DataFrame:
    """B5 + B6 on two columns."""
    st = chi_square_stats(contingency(df, a, b).select(at(a).alias("a"), at(b).alias("b"), "n"))
    return df.sparkSession.createDataFrame(
        [(a, b, st["n"], st["dof"], st["chi2"], st["p_value"], _association(st["p_value"]))],
        "column1 string, column2 string, n long, dof long, chi2 double, p_value double, association string")


# ---------------------------------------------------------------- B7, B8, M2

def grouped_stats(df: DataFrame, cats: Sequence[str], nums: Sequence[str],
                  stats: Sequence[str] = ("count", "mean", "median", "std", "min", "max"),
                  complete_only: bool = False, method: str = "auto") -> DataFrame:
    """(cat_col, category, num_col, stats...) for every pair of a text column
    and a numeric column, from one unpivot and one grouping (medians by a sketch
    in its buffers, with an exact second scan for large groups; ``method`` forces
    a plan of the exact quantile helper). Null categories are dropped."""
    types = {f.name: f.dataType for f in df.schema.fields}
    structs = []
    for c in cats:
        for x in nums:
            structs.append(F.struct(F.lit(c).alias("cat_col"), at(c).cast("string").alias("category"),
                                    F.lit(x).alias("num_col"), num(x, types[x]).alias("value")))
    long = df.select(F.inline(F.array(*structs))).where(F.col("category").isNotNull())
    if complete_only:
        long = long.where(F.col("value").isNotNull())
    keys = ["cat_col", "category", "num_col"]
    fns = {"count": F.count("value"), "mean": F.avg("value"), "std": F.stddev_samp("value"),
           "min": F.min("value"), "max": F.max("value"), "var": F.var_samp("value")}
    if "median" in stats and method == "auto":   # one grouping: the medians' sketches ride with the moments
        return grouped_medians(long, keys, {s: fns[s] for s in stats if s in fns}).select(*keys, *stats)
    base = long.groupBy(*keys).agg(*[fns[s].alias(s) for s in stats if s in fns])
    if "median" in stats:
        med = quantiles(long, keys, "value", (0.5,), method=method).select(
            *keys, F.col("quantiles")[0].alias("median"))
        base = base.join(med, keys, "left")
    return base.select(*keys, *stats)


def group_statistics(df: DataFrame, cat: str, value: str, method: str = "auto",
                     decimals: int | None = None) -> DataFrame:
    """Mean, median, std, count of a numeric column per category over rows
    complete in both (``decimals=3`` for the rounded display table)."""
    g = grouped_stats(df, [cat], [value], ("mean", "median", "std", "count"), True, method)
    return rounded(g.select(F.col("category").alias(cat), "mean", "median", "std", "count"), decimals)


def anova_oneway(df: DataFrame, cat: str, value: str) -> DataFrame:
    """One-way ANOVA F and p of a numeric column across categories
    (complete rows); null when undefined (one group, or no spread inside).
    Group (n, mean, variance) in one aggregation, then SSB and SSW in a second
    over the (small) group table."""
    v = df.select(at(cat).cast("string").alias("g"), _num(df, value).alias("x")).where(
        F.col("g").isNotNull() & F.col("x").isNotNull())
    groups = v.groupBy("g").agg(F.count("x").alias("n"), F.avg("x").alias("m"),
                                F.coalesce(F.var_samp("x"), F.lit(0.0)).alias("s2")).persist()
    try:
        g = groups.agg(F.sum("n").alias("nn"), F.count(F.lit(1)).alias("k"),
                       (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand")).first()
        total, k = int(g["nn"] or 0), int(g["k"])
        f = p = None
        if total:
            ss = groups.agg(
                F.sum(F.col("n") * (F.col("m") - F.lit(g["grand"])) * (F.col("m") - F.lit(g["grand"]))).alias("ssb"),
                F.sum((F.col("n") - 1) * F.col("s2")).alias("ssw")).first()
            d1, d2 = k - 1, total - k
            if k >= 2 and d2 > 0 and ss["ssw"] > 0:
                f = (ss["ssb"] / d1) / (ss["ssw"] / d2)
                p = _nan_none(special.f_sf(f, d1, d2))
    finally:
        groups.unpersist()
    return df.sparkSession.createDataFrame(
        [(cat, value, total, k, k - 1, total - k, f, p)],
        "column1 string, column2 string, n long, groups long, df_between long, df_within long, "
        "f double, p_value double")


def groupby_grid(df: DataFrame, max_cats: int = 3, max_nums: int = 3, method: str = "auto",
                 decimals: int | None = None) -> DataFrame:
    """M2: count, mean, median, std, min, max of the first numeric columns by
    the first text columns (3 × 3 by default, as arguments)."""
    cats = K.categorical_columns(df)[:max_cats]
    nums = K.numeric_columns(df)[:max_nums]
    return rounded(grouped_stats(df, cats, nums, method=method), decimals)


# ---------------------------------------------------------------- B9

def bivariate(df: DataFrame, col1: str, col2: str, method: str = "auto") -> DataFrame:
    """Convert each side by the sentinel-aware majority rule, then run the
    numeric–numeric (Pearson, Spearman), text–text (chi-square) or mixed (group
    statistics + ANOVA) test. One result row with the fields of its type."""
    kinds = K.resolve_numeric_many(df, [col1, col2], "majority_rows")  # one pass for both sides
    (e1, n1), (e2, n2) = kinds[col1], kinds[col2]
    v = df.select(e1.alias(col1), e2.alias(col2)) if col1 != col2 else df.select(e1.alias(col1))
    if n1 and n2:
        p = pearson_test(v, col1, col2)
        s = spearman_test(v, col1, col2, method).select(
            F.col("rho").alias("spearman_r"), F.col("p_value").alias("spearman_p"))
        pr, sr = p.first(), s.first()
        return df.sparkSession.createDataFrame(
            [(col1, col2, "numeric_numeric", pr["n"], pr["r"], pr["p_value"], sr["spearman_r"], sr["spearman_p"],
              pr["strength"])],
            "column1 string, column2 string, type string, n long, pearson_r double, pearson_p double, "
            "spearman_r double, spearman_p double, correlation_strength string")
    if not n1 and not n2:
        return chi_square_test(v, col1, col2).select(
            "column1", "column2", F.lit("categorical_categorical").alias("type"), "n", "chi2", "p_value", "dof",
            F.col("association").alias("association_strength"))
    num_col, cat_col = (col1, col2) if n1 else (col2, col1)
    return anova_oneway(v, cat_col, num_col).select(
        F.lit(col1).alias("column1"), F.lit(col2).alias("column2"),
        F.lit("numeric_categorical").alias("type"), "n", "groups",
        F.col("f").alias("anova_f"), F.col("p_value").alias("anova_p"))
