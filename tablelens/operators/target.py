"""Target analysis (G1–G13): which columns look like targets, and how every
feature relates to a chosen target.

A feature's relation depends on the two kinds: numeric–numeric → Pearson r;
numeric–text (either way round) → statistics of the numeric side per category;
text–text → contingency and chi-square. The all-features views (G10, G12) take
every numeric feature in ONE aggregation and every text feature in ONE
unpivoted grouping, instead of a pass per feature.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions.frames import agg_by_column, rounded
from tablelens.functions.ranges import numbered
from tablelens.functions.stats import adjusted_skewness, at, num, pearson
from tablelens.operators import kinds as K
from tablelens.operators import pairs as B
from tablelens.operators import texts as X

# Name fragments that mark a likely target column.
TARGET_NAMES = ["target", "label", "y", "class", "category", "outcome", "result", "prediction"]

#: sketch estimates above this rule out 10 or fewer distinct values
FEW_CLASSES = 16


def _is_num(df: DataFrame, c: str) -> bool:
    return K.kind_of(df.schema[c].dataType) == "numeric"


def _check(df: DataFrame, *cols: str):
    for c in cols:
        if c not in df.columns:
            raise ValueError(f"Column '{c}' not found")


# ---------------------------------------------------------------- G1

def detect_targets(df: DataFrame) -> DataFrame:
    """G1: (seq, column, reason, confidence). Name match → high; text column
    with 2–10 distinct values → medium; numeric column within [0, 1000] → low.
    A column can appear more than once. An approximate count rules out most
    text columns first (at most 10 distinct values touch at most 10 registers
    of the sketch, so its estimate is never above ``FEW_CLASSES`` for them);
    only the others are counted exactly, in the pass that takes the ranges."""
    spark = df.sparkSession
    rows = []
    for c in df.columns:
        if any(t in c.lower() for t in TARGET_NAMES):
            rows.append((c, X.TARGET_BY_NAME, "high"))
    named = spark.createDataFrame(rows, "column string, reason string, confidence string").withColumn(
        "seq", F.lit(0))
    texts, nums = K.categorical_columns(df), K.numeric_columns(df)
    if not texts and not nums:
        return named.select("seq", "column", "reason", "confidence")
    types = {f.name: f.dataType for f in df.schema.fields}
    items = []
    if texts:
        about = df.agg(*[F.approx_count_distinct(at(c)).alias(f"a{i}") for i, c in enumerate(texts)]).first()
        texts = [c for i, c in enumerate(texts) if about[i] <= FEW_CLASSES]
    for c in texts:
        d = F.count_distinct(at(c))
        items.append(F.when((d >= 2) & (d <= 10), F.struct(
            F.lit(1).alias("seq"), F.lit(c).alias("column"),
            F.format_string(X.printf(X.TARGET_BY_CLASSES), d.cast("string")).alias("reason"),
            F.lit("medium").alias("confidence"))))
    for c in nums:
        v = num(c, types[c])
        mn, mx = F.min(v), F.max(v)
        items.append(F.when((mn >= 0) & (mx <= 1000), F.struct(
            F.lit(2).alias("seq"), F.lit(c).alias("column"),
            F.format_string(X.printf(X.TARGET_BY_RANGE), mn.cast("double"), mx.cast("double")).alias("reason"),
            F.lit("low").alias("confidence"))))
    if not items:
        return named.select("seq", "column", "reason", "confidence")
    found = df.agg(F.filter(F.array(*items), lambda x: x.isNotNull()).alias("_s")).select(F.inline("_s"))
    return named.select("seq", "column", "reason", "confidence").unionByName(found)


# ---------------------------------------------------------------- G2–G5

def target_by_category(df: DataFrame, target: str, feature: str, method: str = "auto",
                       decimals: int | None = None) -> DataFrame:
    """G2 (numeric target, text feature) / G3 (text target, numeric feature):
    count, mean, median, std, min, max of the numeric side per category."""
    _check(df, target, feature)
    num_col, cat_col = (target, feature) if _is_num(df, target) else (feature, target)
    g = B.grouped_stats(df, [cat_col], [num_col], method=method)
    return rounded(g.select(F.col("category").alias(cat_col), "count", "mean", "median", "std", "min", "max"),
                   decimals)


def target_analysis_type(df: DataFrame, target: str, feature: str) -> str:
    t, f = _is_num(df, target), _is_num(df, feature)
    if t and not f:
        return "numeric_target_categorical_feature"
    if not t and f:
        return "categorical_target_numeric_feature"
    if not t and not f:
        return "categorical_target_categorical_feature"
    return "numeric_target_numeric_feature"


def target_correlation(df: DataFrame, target: str, feature: str) -> DataFrame:
    """Pearson r of two numeric columns (pairwise complete)."""
    _check(df, target, feature)
    return df.agg(pearson(num(target, df.schema[target].dataType), num(feature, df.schema[feature].dataType))
                  .alias("correlation")).select(F.lit(target).alias("target"), F.lit(feature).alias("feature"),
                                                "correlation")


def target_contingency(df: DataFrame, target: str, feature: str) -> DataFrame:
    """(feature value, target value, n) over rows with both present."""
    return B.contingency(df, feature, target)


# ---------------------------------------------------------------- G6, G7

def _class_moments(df: DataFrame, target: str, feature: str) -> DataFrame:
    """(category, count, mean, std) of the numeric side per category — what
    G6/G7 read (no medians, so no quantile job)."""
    _check(df, target, feature)
    num_col, cat_col = (target, feature) if _is_num(df, target) else (feature, target)
    g = B.grouped_stats(df, [cat_col], [num_col], stats=("count", "mean", "std"))
    return g.select("category", "count", "mean", "std")


def category_impact(df: DataFrame, target: str, feature: str, method: str = "auto") -> DataFrame:
    """Numeric target by a text feature — best and worst category by mean,
    their range against the mean within-category std, most/least stable
    category by |std/mean|, smallest group and the flags derived from them."""
    g = _class_moments(df, target, feature)
    cv = F.abs(F.try_divide(F.col("std"), F.col("mean")))
    s = g.agg(
        F.min_by("category", F.struct(-F.col("mean"), F.col("category"))).alias("best_category"),
        F.max("mean").alias("best_mean"),
        F.min_by("category", F.struct(F.col("mean"), F.col("category"))).alias("worst_category"),
        F.min("mean").alias("worst_mean"),
        F.avg("std").alias("mean_std"),
        F.min_by(F.when(cv.isNotNull(), F.col("category")), F.struct(cv.isNull(), cv, F.col("category"))).alias("most_stable"),
        F.min_by(F.when(cv.isNotNull(), F.col("category")), F.struct(cv.isNull(), -cv, F.col("category"))).alias("least_stable"),
        F.min("count").alias("min_count"), F.max("count").alias("max_count"))
    rng = F.col("best_mean") - F.col("worst_mean")
    return s.select(
        F.lit(target).alias("target"), F.lit(feature).alias("feature"), "best_category", "best_mean",
        "worst_category", "worst_mean", rng.alias("impact_range"), "mean_std",
        F.when(rng > F.col("mean_std"), "high").otherwise("moderate").alias("impact"),
        "most_stable", "least_stable", "min_count", "max_count",
        (F.col("min_count") < 30).alias("small_sample"), (rng > 2 * F.col("mean_std")).alias("action"))


def class_separation(df: DataFrame, target: str, feature: str, method: str = "auto") -> DataFrame:
    """Numeric feature by a text target — highest/lowest class mean and
    range; with two classes Cohen's d, its strength and the midpoint threshold;
    with more, high discrimination when the range exceeds twice the mean std."""
    g = _class_moments(df, target, feature)
    s = g.agg(
        F.count(F.lit(1)).alias("classes"),
        F.min_by("category", F.struct(-F.col("mean"), F.col("category"))).alias("highest_class"),
        F.max("mean").alias("highest_mean"),
        F.min_by("category", F.struct(F.col("mean"), F.col("category"))).alias("lowest_class"),
        F.min("mean").alias("lowest_mean"), F.avg("std").alias("mean_std"),
        F.min(F.struct("category", "mean", "std")).alias("_first"), F.max(F.struct("category", "mean", "std")).alias("_last"))
    two = F.col("classes") == 2
    m1, m2 = F.col("_first")["mean"], F.col("_last")["mean"]
    s1, s2 = F.col("_first")["std"], F.col("_last")["std"]
    d = F.try_divide(F.abs(m1 - m2), F.sqrt((s1 * s1 + s2 * s2) / 2))
    rng = F.col("highest_mean") - F.col("lowest_mean")
    return s.select(
        F.lit(target).alias("target"), F.lit(feature).alias("feature"), "classes", "highest_class", "highest_mean",
        "lowest_class", "lowest_mean", rng.alias("feature_range"),
        F.when(two, d).alias("cohens_d"),
        F.when(two, F.when(d > 0.8, "strong").when(d > 0.5, "moderate").otherwise("weak")).alias("separation"),
        F.when(two, (m1 + m2) / 2).alias("threshold"),
        F.when(~two, F.when(rng > 2 * F.col("mean_std"), "high").otherwise("moderate")).alias("discrimination"))


# ---------------------------------------------------------------- G8

def association_residuals(df: DataFrame, target: str, feature: str) -> DataFrame:
    """Chi-square test of a text feature against a text target, plus the
    extreme standardised residuals over ALL cells of the dense table (empty
    cells from the margins; the dense table is never built), the smallest cell
    count and the reading of both."""
    cells = B.contingency(df, feature, target).select(
        at(feature).alias("a"), at(target).alias("b"), "n").persist()
    try:
        st = B.chi_square_stats(cells)
        ra = cells.groupBy("a").agg(F.sum("n").cast("double").alias("ra"), F.count(F.lit(1)).alias("seen"))
        cb = numbered(cells.groupBy("b").agg(F.sum("n").cast("double").alias("cb")), [F.desc("cb"), F.asc("b")], "rank")
        cb = cb.withColumn("rank", (F.col("rank") + 1).cast("int"))
        total = float(st["n"] or 0) or 1.0
        full = cells.join(ra, "a").join(cb, "b").withColumn("e", F.col("ra") * F.col("cb") / F.lit(total))
        # the residual as first defined on proportions, and the plain Pearson residual
        prop = (F.col("n") / total - F.col("e") / total) / F.sqrt(F.col("e") / total)
        plain = (F.col("n") - F.col("e")) / F.sqrt(F.col("e"))
        res = full.agg(F.min(prop).alias("mn"), F.max(prop).alias("mx"), F.max(plain).alias("mp"), F.min("n").alias("mc"),
                       F.count(F.lit(1)).alias("cells"), F.count_distinct("a").alias("r"), F.count_distinct("b").alias("c")).first()
        low, least = res["mn"], res["mc"]
        if res["cells"] < res["r"] * res["c"]:
            # an empty cell's residual is -sqrt(e / N): the lowest belongs to the
            # largest margin product among empty cells, that is, in each row, to
            # the largest class the row has not (its first missing rank)
            place = F.row_number().over(Window.partitionBy("a").orderBy("rank"))
            first = (full.withColumn("place", place).groupBy("a", "ra", "seen")
                     .agg(F.min(F.when(F.col("place") != F.col("rank"), F.col("place"))).alias("gap"))
                     .select("ra", F.coalesce("gap", F.col("seen") + 1).cast("int").alias("rank")))
            top = first.join(cb, "rank").agg(F.max(F.col("ra") * F.col("cb")).alias("e")).first()["e"]
            low, least = min(low, -((top / total / total) ** 0.5)), 0
    finally:
        cells.unpersist()
    p = st["p_value"]
    assoc = None if p is None else "very strong" if p < 0.001 else "strong" if p < 0.05 else "weak"
    mx = res["mx"]
    pattern = None if mx is None else "strong" if abs(mx) > 2 else "moderate" if abs(mx) > 1 else "weak"
    mc = int(least) if least is not None else None
    return df.sparkSession.createDataFrame(
        [(target, feature, st["chi2"], p, st["dof"], assoc, low, mx, res["mp"], pattern, mc,
          None if mc is None else mc < 5)],
        "target string, feature string, chi2 double, p_value double, dof long, association string, "
        "min_residual double, max_residual double, max_pearson_residual double, pattern string, "
        "min_count long, small_counts boolean")


# ---------------------------------------------------------------- G9

def correlation_reading(df: DataFrame, target: str, feature: str) -> DataFrame:
    """R of a numeric feature with a numeric target, read as strength,
    direction, predictive power, driver flag, r² and explanatory power."""
    r = target_correlation(df, target, feature)
    a = F.abs(F.col("correlation"))
    r2 = F.col("correlation") * F.col("correlation")
    return r.select(
        "target", "feature", "correlation",
        F.when(a > 0.7, "very strong").when(a > 0.5, "strong").when(a > 0.3, "moderate").otherwise("weak")
        .alias("strength"),
        F.when(F.col("correlation") > 0, "positive").otherwise("negative").alias("direction"),
        F.when(a > 0.7, "high").when(a > 0.3, "moderate").otherwise("low").alias("predictive_power"),
        (a > 0.5).alias("key_driver"), r2.alias("r_squared"),
        F.when(r2 > 0.5, "high").when(r2 > 0.25, "moderate").otherwise("low").alias("explanatory_power"))


# ---------------------------------------------------------------- G10–G12

def _relations(df: DataFrame, target: str, features: Sequence[str], text_only: bool = False) -> DataFrame:
    """(position, feature, impact_type, value, mean_std) for numeric–numeric
    (r) and numeric–text pairs (range of the category means of the numeric
    side, and the mean of the category stds); text–text pairs are left out."""
    spark = df.sparkSession
    types = {f.name: f.dataType for f in df.schema.fields}
    pos = {c: i for i, c in enumerate(features)}
    t_num = _is_num(df, target)
    num_f = [c for c in features if _is_num(df, c)]
    cat_f = [c for c in features if not _is_num(df, c)]
    if text_only:  # the ranking view groups by text columns only (dates and others are left out)
        cat_f = [c for c in cat_f if K.kind_of(types[c]) == "categorical"]
    parts = []
    if t_num and num_f:
        tv = num(target, types[target])
        corr = agg_by_column(df, num_f, [("value", lambda c: pearson(tv, num(c, types[c])))])
        parts.append(corr.select(F.col("column").alias("feature"), F.lit("Correlation").alias("impact_type"),
                                 "value", F.lit(None).cast("double").alias("mean_std")))
    if t_num and cat_f:  # numeric target, text features: target stats per feature category
        structs = [F.struct(F.lit(c).alias("feature"), at(c).cast("string").alias("category")) for c in cat_f]
        long = df.select(num(target, types[target]).alias("y"), F.inline(F.array(*structs))).where(
            F.col("category").isNotNull())
        g = long.groupBy("feature", "category").agg(F.avg("y").alias("m"), F.stddev_samp("y").alias("s"))
        rng = g.groupBy("feature").agg((F.max("m") - F.min("m")).alias("value"), F.avg("s").alias("mean_std"),
                                       F.count(F.lit(1)).alias("groups"))
        parts.append(rng.select("feature", F.lit("Range").alias("impact_type"), "value", "mean_std", "groups"))
    if not t_num and num_f:  # text target, numeric features: feature stats per target class
        structs = [F.struct(F.lit(c).alias("feature"), num(c, types[c]).alias("x")) for c in num_f]
        long = df.select(at(target).cast("string").alias("category"), F.inline(F.array(*structs))).where(
            F.col("category").isNotNull())
        g = long.groupBy("feature", "category").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"))
        rng = g.groupBy("feature").agg((F.max("m") - F.min("m")).alias("value"), F.avg("s").alias("mean_std"),
                                       F.count(F.lit(1)).alias("groups"))
        parts.append(rng.select("feature", F.lit("Range").alias("impact_type"), "value", "mean_std", "groups"))
    if not parts:
        return spark.createDataFrame([], "position int, feature string, impact_type string, value double, "
                                         "mean_std double, groups long")
    out = None
    for p in parts:
        if "groups" not in p.columns:
            p = p.withColumn("groups", F.lit(None).cast("long"))
        out = p if out is None else out.unionByName(p)
    posdf = spark.createDataFrame(list(pos.items()), "feature string, position int")
    return out.join(F.broadcast(posdf), "feature").select("position", "feature", "impact_type", "value",
                                                           "mean_std", "groups")


def feature_impact(df: DataFrame, target: str, max_features: int | None = 10) -> DataFrame:
    """For the first ``max_features`` columns other than the target: the
    correlation (High > 0.7, Medium > 0.3) or the range of group means (High
    above the mean std, Medium above half of it), with its printed value."""
    _check(df, target)
    feats = [c for c in df.columns if c != target]
    feats = feats[:max_features] if max_features is not None else feats
    rel = _relations(df, target, feats)
    a = F.abs(F.col("value"))
    corr = F.col("impact_type") == "Correlation"
    strength = F.when(corr, F.when(a > 0.7, "High").when(a > 0.3, "Medium").otherwise("Low")).otherwise(
        F.when(F.col("value") > F.col("mean_std"), "High")
        .when(F.col("value") > F.col("mean_std") / 2, "Medium").otherwise("Low"))
    text = F.when(corr, F.format_string("%.3f", F.col("value"))).otherwise(F.format_string("%.2f", F.col("value")))
    return rel.where(F.col("value").isNotNull()).select(
        "position", "feature", "impact_type", "value", text.alias("impact_value"), strength.alias("strength"))


def top_impact(impact: DataFrame, k: int = 5) -> DataFrame:
    """The k largest |impact| as printed (r to 3, ranges to 2 decimals);
    ties keep column order."""
    shown = F.when(F.col("impact_type") == "Correlation", F.round("value", 3)).otherwise(F.round("value", 2))
    w = Window.orderBy(F.desc("abs_impact"), "position")
    return (impact.withColumn("abs_impact", F.abs(shown))
            .orderBy(F.desc("abs_impact"), "position").limit(k)
            .withColumn("rank", F.row_number().over(w))
            .select("rank", "feature", "impact_type", "impact_value", "strength", "abs_impact"))


def feature_ranking(df: DataFrame, target: str, k: int | None = 3) -> DataFrame:
    """Numeric target only — every other column ranked by |r| (numeric)
    or by the range of target means across its categories (text, more than
    one category); the top k."""
    _check(df, target)
    if not _is_num(df, target):
        raise ValueError("feature ranking needs a numeric target")
    feats = [c for c in df.columns if c != target]
    rel = _relations(df, target, feats, text_only=True).where(
        F.col("value").isNotNull() & ((F.col("impact_type") == "Correlation") | (F.col("groups") > 1)))
    strength = F.when(F.col("impact_type") == "Correlation", F.abs("value")).otherwise(F.col("value"))
    ranked = rel.select("position", "feature", "impact_type", strength.alias("strength"), "value")
    ranked = ranked.orderBy(F.desc("strength"), "position")
    if k is not None:
        ranked = ranked.limit(k)
    w = Window.orderBy(F.desc("strength"), "position")
    return ranked.withColumn("rank", F.row_number().over(w)).select(
        "rank", "feature", "impact_type", "strength", "value")


# ---------------------------------------------------------------- G13

def target_summary(df: DataFrame, target: str) -> DataFrame:
    """Numeric target → distinct count, min, max, mean, std, adjusted
    skewness and whether it is skewed (|skew| > 1) and which way; text target →
    distinct count, most common value, its % of all rows, imbalance (> 50 %)."""
    _check(df, target)
    dt = df.schema[target].dataType
    if _is_num(df, target):
        v = num(target, dt)
        own = v if isinstance(dt, (T.StringType, T.FloatType, T.DoubleType)) else at(target)   # whole numbers beyond doubles stay apart
        s = df.select(v.alias("v"), own.alias("own")).agg(
            F.count_distinct("own").alias("unique"), F.min("v").alias("min"), F.max("v").alias("max"),
            F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), adjusted_skewness(F.col("v")).alias("skewness"))
        return s.select(
            F.lit(target).alias("target"), F.lit("numeric").alias("type"), "unique", "min", "max", "mean", "std",
            "skewness", (F.abs("skewness") > 1).alias("skewed"),
            F.when(F.abs("skewness") > 1, F.when(F.col("skewness") > 0, "right").otherwise("left")).alias("skew_direction"))
    c = at(target).cast("string")
    vc = df.select(c.alias("v")).where(F.col("v").isNotNull()).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    top = vc.agg(F.count(F.lit(1)).alias("unique"),
                 F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("most_common"),
                 F.max("n").alias("most_common_count"))
    rows = df.agg(F.count(F.lit(1))).scalar()
    pct = F.try_divide(F.col("most_common_count") * 100.0, rows)
    return top.select(
        F.lit(target).alias("target"), F.lit("categorical").alias("type"), "unique", "most_common",
        pct.alias("most_common_pct"), (pct > 50).alias("imbalanced"))
