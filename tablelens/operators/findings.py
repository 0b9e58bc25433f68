"""Findings as rows (N1–N7): ``(seq, topic, finding)``.

All numbers come from the distributed operators, each reduced to a handful of
rows (one per column, pair or test) before it reaches the driver; the
sentences are then formatted in Python from the fixed texts in
:mod:`tablelens.operators.texts`, so that numbers print exactly as Python's
``format`` prints them (Java's formatter rounds some halves the other way).
No table row passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelens.functions.stats import at, num
from tablelens.operators import kinds as K
from tablelens.operators import pairs as B
from tablelens.operators import profile as P
from tablelens.operators import target as G
from tablelens.operators import texts as X

SCHEMA = "seq int, topic string, finding string"


def _rows(spark, topic: str, lines: list[str]) -> DataFrame:
    return spark.createDataFrame([(i + 1, topic, s) for i, s in enumerate(lines)], SCHEMA)


def _nan(x) -> float:
    """Undefined statistics are printed as nan."""
    return float("nan") if x is None else x


def _known_target(df: DataFrame, target: str | None) -> None:
    if target and target not in df.columns:
        raise ValueError(f"Target column '{target}' not found")


def _side(x: float) -> str:
    return "right" if x > 0 else "left"


# ---------------------------------------------------------------- N1

def distribution_findings(df: DataFrame, column: str) -> DataFrame:
    """Distribution of one column in words."""
    spark = df.sparkSession
    if column not in df.columns:
        raise ValueError(f"Column '{column}' not found")
    lines = [X.N1_HEAD.format(column=column)]
    if K.kind_of(df.schema[column].dataType) == "numeric":
        u = P.univariate_numeric(df, [column], rule=None).first()
        rows = u["count"] + u["missing_count"]
        lines.append(X.N1_MEAN_STD.format(mean=_nan(u["mean"]), std=_nan(u["std"])))
        sk, ku = u["skewness"], u["kurtosis"]
        if sk is not None and abs(sk) > 1:
            lines.append(X.N1_SKEWED.format(side=_side(sk), skew=sk))
        elif sk is not None:
            lines.append(X.N1_NORMAL.format(skew=sk))
        if ku is not None and abs(ku) > 3:
            lines.append(X.N1_TAILS.format(kind="heavy-tailed" if ku > 0 else "light-tailed", kurt=ku))
        if u["outliers"]:
            lines.append(X.N1_OUTLIERS.format(n=u["outliers"], pct=u["outliers"] / rows * 100))
    else:
        u = P.univariate_categorical(df.select(at(column).cast("string").alias(column)), [column]).first()
        rows = u["total_count"] + u["missing_count"]
        pct = (u["most_frequent_count"] or 0) / rows * 100 if rows else 0.0
        lines.append(X.N1_UNIQUE.format(n=u["unique_count"]))
        lines.append(X.N1_TOP.format(value=u["most_frequent"], pct=pct))
        if pct > 50:
            lines.append(X.N1_IMBALANCE)
        elif pct < 20:
            lines.append(X.N1_SPREAD)
    return _rows(spark, "distribution", lines)


# ---------------------------------------------------------------- N2

def _pairs(df: DataFrame):
    """The first three strong and moderate pairs, each with its kind's ``total``."""
    kind = Window.partitionBy("strength")
    m = (B.correlation_pairs(df).where(F.col("strength").isin("strong", "moderate"))
         .withColumn("total", F.count(F.lit(1)).over(kind))
         .withColumn("place", F.row_number().over(kind.orderBy("i", "j")))
         .where(F.col("place") <= 3).orderBy("i", "j").collect())
    strong = [r for r in m if r["strength"] == "strong"]
    moderate = [r for r in m if r["strength"] == "moderate"]
    return strong, moderate


def correlation_findings(df: DataFrame) -> DataFrame:
    """Counts of strong and moderate pairs with the first three of each."""
    strong, moderate = _pairs(df)
    lines = [X.N2_HEAD]
    if strong:
        lines.append(X.N2_STRONG.format(n=strong[0]["total"]))
        lines += [X.N2_PAIR.format(pair=r["pair"], r=r["r"]) for r in strong]
        lines.append(X.N2_STRONG_NOTE)
    if moderate:
        lines.append(X.N2_MODERATE.format(n=moderate[0]["total"]))
        lines += [X.N2_PAIR.format(pair=r["pair"], r=r["r"]) for r in moderate]
        lines.append(X.N2_MODERATE_NOTE)
    if not strong and not moderate:
        lines.append(X.N2_NONE)
    return _rows(df.sparkSession, "correlation", lines)


# ---------------------------------------------------------------- N3

def bivariate_findings(df: DataFrame, col1: str, col2: str) -> DataFrame:
    """The pair test in words (statistic, strength, significance at 0.05)."""
    r = B.bivariate(df, col1, col2).first().asDict()
    lines = [X.N3_HEAD.format(a=col1, b=col2)]
    t = r["type"]
    if t == "numeric_numeric":
        pr, p = _nan(r["pearson_r"]), _nan(r["pearson_p"])
        lines += [X.N3_PEARSON.format(r=pr), X.N3_STRENGTH.format(strength=r["correlation_strength"]),
                  X.N3_P.format(p=p), X.N3_REL_SIG if p < 0.05 else X.N3_REL_NOT]
        lines.append(X.N3_LINEAR_STRONG if abs(pr) > 0.7 else X.N3_LINEAR_MODERATE if abs(pr) > 0.3
                     else X.N3_LINEAR_WEAK)
    elif t == "categorical_categorical":
        p = _nan(r["p_value"])
        lines += [X.N3_CHI2.format(chi2=_nan(r["chi2"])), X.N3_ASSOCIATION.format(strength=r["association_strength"]),
                  X.N3_P.format(p=p), X.N3_ASSOC_SIG if p < 0.05 else X.N3_ASSOC_NOT]
    else:
        f, p = r["anova_f"], r["anova_p"]
        lines.append(X.N3_ANOVA.format(f=f) if f is not None else X.N3_ANOVA_UNDEFINED)
        if p is not None:
            lines += [X.N3_P.format(p=p), X.N3_GROUPS_SIG if p < 0.05 else X.N3_GROUPS_NOT]
    return _rows(df.sparkSession, "bivariate", lines)


# ---------------------------------------------------------------- N4

def target_findings(df: DataFrame, target: str, feature: str) -> DataFrame:
    """Two-part reading of a feature against the target, by kind pair."""
    kind = G.target_analysis_type(df, target, feature)
    lines = [X.N4_HEAD.format(feature=feature, target=target)]
    if kind == "numeric_target_categorical_feature":
        r = G.category_impact(df, target, feature).first()
        lines += [X.N4_NC_P1, X.N4_NC_IMPACT.format(feature=feature, target=target),
                  X.N4_NC_BEST.format(category=r["best_category"], mean=_nan(r["best_mean"])),
                  X.N4_NC_WORST.format(category=r["worst_category"], mean=_nan(r["worst_mean"])),
                  X.N4_NC_RANGE.format(range=_nan(r["impact_range"])),
                  X.N4_NC_HIGH.format(std=_nan(r["mean_std"])) if r["impact"] == "high" else X.N4_NC_MODERATE,
                  X.N4_NC_P2, X.N4_NC_STABLE.format(category=r["most_stable"]),
                  X.N4_NC_UNSTABLE.format(category=r["least_stable"]),
                  (X.N4_NC_SMALL if r["small_sample"] else X.N4_NC_GOOD).format(n=r["min_count"])]
        if r["action"]:
            lines += [X.N4_NC_ACTION.format(category=r["worst_category"]),
                      X.N4_NC_OPPORTUNITY.format(category=r["best_category"])]
        else:
            lines += [X.N4_NC_OBSERVATION.format(feature=feature, target=target), X.N4_NC_NEXT]
    elif kind == "categorical_target_numeric_feature":
        r = G.class_separation(df, target, feature).first()
        lines += [X.N4_CN_P1, X.N4_CN_VARIES.format(feature=feature, target=target),
                  X.N4_CN_HIGHEST.format(category=r["highest_class"], mean=_nan(r["highest_mean"])),
                  X.N4_CN_LOWEST.format(category=r["lowest_class"], mean=_nan(r["lowest_mean"])),
                  X.N4_CN_RANGE.format(range=_nan(r["feature_range"])), X.N4_CN_P2]
        if r["classes"] == 2:
            lines.append(X.N4_CN_D.format(d=_nan(r["cohens_d"])))
            lines.append({"strong": X.N4_CN_STRONG, "moderate": X.N4_CN_MODERATE,
                          "weak": X.N4_CN_WEAK}[r["separation"] or "weak"])
            lines.append(X.N4_CN_THRESHOLD.format(t=_nan(r["threshold"])))
        else:
            lines += [X.N4_CN_MULTI.format(n=r["classes"]), X.N4_CN_DISCRIMINATION.format(range=_nan(r["feature_range"])),
                      X.N4_CN_HIGH if r["discrimination"] == "high" else X.N4_CN_SOME]
    elif kind == "categorical_target_categorical_feature":
        r = G.association_residuals(df, target, feature).first()
        lines += [X.N4_CC_P1, X.N4_CC_CHI2.format(chi2=_nan(r["chi2"])), X.N4_CC_P.format(p=_nan(r["p_value"])),
                  X.N4_CC_DOF.format(dof=r["dof"]),
                  {"very strong": X.N4_CC_VERY_STRONG, "strong": X.N4_CC_STRONG,
                   "weak": X.N4_CC_WEAK}[r["association"] or "weak"],
                  X.N4_CC_P2, X.N4_CC_RANGE.format(lo=_nan(r["min_residual"]), hi=_nan(r["max_residual"])),
                  {"strong": X.N4_CC_PATTERN_STRONG, "moderate": X.N4_CC_PATTERN_MODERATE,
                   "weak": X.N4_CC_PATTERN_WEAK}[r["pattern"] or "weak"],
                  X.N4_CC_SMALL.format(n=r["min_count"]) if r["small_counts"] else X.N4_CC_GOOD]
    else:
        r = G.correlation_reading(df, target, feature).first()
        c = _nan(r["correlation"])
        lines += [X.N4_NN_P1, X.N4_NN_R.format(r=c),
                  X.N4_NN_RELATION.format(strength=r["strength"], direction=r["direction"]),
                  {"high": X.N4_NN_HIGH, "moderate": X.N4_NN_MODERATE, "low": X.N4_NN_LOW}[r["predictive_power"]],
                  X.N4_NN_P2]
        if r["key_driver"]:
            lines.append(X.N4_NN_DRIVER.format(feature=feature, target=target))
            lines.append((X.N4_NN_INCREASE if c > 0 else X.N4_NN_DECREASE).format(feature=feature, target=target))
        else:
            lines += [X.N4_NN_LIMITED.format(feature=feature, target=target), X.N4_NN_NONLINEAR]
        lines.append(X.N4_NN_EXPLAINED.format(r2=_nan(r["r_squared"]), target=target, feature=feature))
        lines.append({"high": X.N4_NN_EXPLAIN_HIGH, "moderate": X.N4_NN_EXPLAIN_MODERATE,
                      "low": X.N4_NN_EXPLAIN_LOW}[r["explanatory_power"]])
    return _rows(df.sparkSession, "target", lines)


# ---------------------------------------------------------------- N5, N6

def _overview(df: DataFrame, target: str | None, with_dups: bool):
    """The small statistics N5/N6 need, each fetched as a few rows."""
    nums, cats = K.numeric_columns(df), K.categorical_columns(df)
    ms = P.missing_summary(df).first()
    info = P.dataset_info(df).first() if with_dups else None
    types = {f.name: f.dataType for f in df.schema.fields}
    # only mean, std and skewness are read: one moments pass, no quartiles
    desc = {r["column"]: r for r in P.moments(df.select(*[num(c, types[c]).alias(c) for c in nums[:3]]),
                                               nums[:3]).collect()} if nums else {}
    # distinct count and mode of the first text columns from one value-count shuffle
    catp = {}
    if cats:
        vc = P.value_counts(df, cats[:3])
        for r in vc.groupBy("column").agg(
                F.count(F.lit(1)).alias("unique_count"),
                F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("most_frequent")).collect():
            catp[r["column"]] = r
    strong, moderate = _pairs(df) if len(nums) > 1 else ([], [])
    tgt = G.target_summary(df, target).first() if target and target in df.columns else None
    return nums, cats, ms, info, desc, catp, strong, moderate, tgt


def dataset_findings(df: DataFrame, target: str | None = None) -> DataFrame:
    """Numbered data-quality, target, distribution, cardinality and
    correlation findings."""
    _known_target(df, target)
    nums, cats, ms, _, desc, catp, strong, moderate, tgt = _overview(df, target, False)
    rows = ms["n_rows"]
    mp = ms["missing_pct"] or 0.0
    out = [(X.N5_MISSING_ALERT if mp > 10 else X.N5_MISSING_SOME if mp > 5 else X.N5_MISSING_LOW).format(pct=mp)]
    if tgt is not None:
        out.append(X.N5_TARGET.format(target=target, kind=tgt["type"], n=tgt["unique"]))
        out.append(X.N5_TARGET_STATS.format(mean=_nan(tgt["mean"]), std=_nan(tgt["std"])) if tgt["type"] == "numeric"
                   else X.N5_TARGET_MODE.format(value=tgt["most_common"]))
    if nums:
        out.append(X.N5_NUMERIC.format(n=len(nums)))
        for c in nums[:3]:
            sk = desc[c]["skewness"] if c in desc else None
            if sk is not None and abs(sk) > 1:
                out.append(X.N5_SKEW.format(column=c, side=_side(sk), skew=sk))
    if cats:
        out.append(X.N5_CATEGORICAL.format(n=len(cats)))
        for c in cats[:3]:
            u = catp[c]["unique_count"] if c in catp else 0
            if u > rows * 0.8:
                out.append(X.N5_CARDINALITY.format(column=c, n=u, pct=u / rows * 100))
    if strong:
        out.append(X.N5_STRONG.format(n=strong[0]["total"]))
    if moderate:
        out.append(X.N5_MODERATE.format(n=moderate[0]["total"]))
    out.append(X.N5_TARGET_FOCUS.format(target=target) if target
               else X.N5_BUSINESS.format(rows=rows, cols=len(df.columns)))
    return _rows(df.sparkSession, "dataset", [X.N5_ITEM.format(i=i, text=s) for i, s in enumerate(out, 1)])


def executive_summary(df: DataFrame, target: str | None = None) -> DataFrame:
    """The nine-section summary (overview, quality, variables, target,
    statistics, relations, top features, recommendations, actions)."""
    _known_target(df, target)
    nums, cats, ms, info, desc, catp, strong, moderate, tgt = _overview(df, target, True)
    rows, mp = ms["n_rows"], ms["missing_pct"] or 0.0
    s = [X.N6_TITLE, X.N6_SIZE.format(rows=rows, cols=len(df.columns)),
         X.N6_FOCUS.format(target=target) if target else X.N6_EXPLORE, X.N6_QUALITY,
         X.N6_QUALITY_EXCELLENT if mp < 5 else X.N6_QUALITY_GOOD if mp < 15 else X.N6_QUALITY_POOR,
         X.N6_MISSING.format(pct=mp), X.N6_DUPLICATES.format(n=info["duplicate_rows"]),
         X.N6_MEMORY.format(mb=info["memory_mb"]), X.N6_VARIABLES,
         X.N6_NUMERIC_COUNT.format(n=len(nums)), X.N6_CATEGORICAL_COUNT.format(n=len(cats))]
    if nums:
        s.append(X.N6_KEY_NUMERIC.format(names=", ".join(nums[:3]), more="..." if len(nums) > 3 else ""))
    if cats:
        s.append(X.N6_KEY_CATEGORICAL.format(names=", ".join(cats[:3]), more="..." if len(cats) > 3 else ""))
    ranking = []
    if tgt is not None:
        s += [X.N6_TARGET.format(target=target), X.N6_TYPE.format(kind=tgt["type"].title()),
              X.N6_UNIQUE.format(n=tgt["unique"])]
        if tgt["type"] == "numeric":
            s += [X.N6_RANGE.format(lo=_nan(tgt["min"]), hi=_nan(tgt["max"])), X.N6_AVERAGE.format(mean=_nan(tgt["mean"]), std=_nan(tgt["std"])),
                  X.N6_SKEWED.format(side=tgt["skew_direction"]) if tgt["skewed"] else X.N6_NORMAL]
            ranking = G.feature_ranking(df, target, 3).collect()
        else:
            s += [X.N6_MOST_COMMON.format(value=tgt["most_common"], pct=_nan(tgt["most_common_pct"])),
                  X.N6_IMBALANCE if tgt["imbalanced"] else X.N6_BALANCED]
    s.append(X.N6_FINDINGS)
    if nums:
        s.append(X.N6_NUMERIC)
        s += [X.N6_NUMERIC_LINE.format(column=c, mean=desc[c]["mean"], std=desc[c]["std"])
              for c in nums[:3] if c in desc and desc[c]["mean"] is not None and desc[c]["std"] is not None]
    if cats:
        s.append(X.N6_CATEGORICAL)
        s += [X.N6_CATEGORICAL_LINE.format(column=c, n=catp[c]["unique_count"], value=catp[c]["most_frequent"])
              for c in cats[:3] if c in catp]
    s.append(X.N6_RELATIONS)
    if strong:
        s.append(X.N6_STRONG.format(n=strong[0]["total"]))
        s += [X.N6_PAIR.format(pair=r["pair"], r=r["r"]) for r in strong[:2]]
    if moderate:
        s.append(X.N6_MODERATE.format(n=moderate[0]["total"]))
        s += [X.N6_PAIR.format(pair=r["pair"], r=r["r"]) for r in moderate[:2]]
    if not strong and not moderate:
        s.append(X.N6_INDEPENDENT)
    if tgt is not None:
        s.append(X.N6_TARGET_INSIGHTS.format(target=target))
        if ranking:
            s.append(X.N6_TOP_FEATURES)
            s += [(X.N6_FEATURE_CORR if r["impact_type"] == "Correlation" else X.N6_FEATURE_RANGE)
                  .format(rank=r["rank"], feature=r["feature"], value=r["value"]) for r in ranking]
    s.append(X.N6_RECOMMENDATIONS)
    if mp > 10:
        s.append(X.N6_COLLECT)
    if target:
        s.append(X.N6_MODELING.format(target=target))
        if ranking:
            s.append(X.N6_PREDICTOR.format(feature=ranking[0]["feature"]))
    if strong:
        s.append(X.N6_MULTICOLLINEARITY)
    if nums and cats:
        s.append(X.N6_MIXED)
    s += [X.N6_NEXT, X.N6_ACTIONS, X.N6_ACTION_1, X.N6_ACTION_2]
    if target:
        s.append(X.N6_ACTION_3.format(target=target))
    s += [X.N6_ACTION_4, X.N6_ACTION_5]
    return _rows(df.sparkSession, "summary", s)


# ---------------------------------------------------------------- N7

def one_paragraph(df: DataFrame) -> DataFrame:
    """Rows, columns, columns with missing values, top 3 values of the
    first three text columns — one paragraph."""
    ms = P.missing_per_column(df).orderBy("position").collect()
    rows = df.count()
    cats = K.categorical_columns(df)[:3]
    top = P.top_values(df, cats, 3, None).orderBy("column", "rank").collect() if cats else []
    s = X.N7_SIZE.format(rows=rows, cols=len(df.columns))
    miss = [X.N7_ITEM.format(name=r["column"], n=r["missing"]) for r in ms if r["missing"] > 0]
    if miss:
        s += X.N7_MISSING.format(items=", ".join(miss))
    for c in cats:
        s += X.N7_TOP.format(column=c, items=", ".join(X.N7_ITEM.format(name=r["value"], n=r["n"])
                                                        for r in top if r["column"] == c))
    return _rows(df.sparkSession, "paragraph", [s])
