"""Column names with dots, spaces and backticks: every operator answers as it
does for plain names."""
import math
import random

import pytest
from pyspark.sql import functions as F

from tablelens.operators import chartdata as D
from tablelens.operators import checks as V
from tablelens.operators import clean as C
from tablelens.operators import findings as N
from tablelens.operators import kinds as K
from tablelens.operators import pairs as B
from tablelens.operators import profile as P
from tablelens.operators import target as G
from tablelens.sources import io

ODD = {"x": "a.x", "y": "net price", "z": "z`z", "kind": "k.in.d", "group": "the group", "day": "d.ay", "word": "w.o rd", "yes": "y.es"}


def table(spark, names):
    rnd = random.Random(5)
    rows = []
    for i in range(240):
        x = rnd.gauss(10, 3)
        rows.append((x if i % 17 else None, 2 * x + rnd.random(), i % 9, "abc"[i % 3] if i % 31 else None, "pq"[(i // 3) % 2],
                     f"2024-01-{1 + i % 28:02d}", str(i * 1.5) if i % 5 else "?", "no" if x < 10 else "yes"))
    rows += rows[:7]
    return spark.createDataFrame(rows, "x double, y double, z int, kind string, group string, day string, word string, yes string").toDF(*[names.get(c, c) for c in ["x", "y", "z", "kind", "group", "day", "word", "yes"]])


CASES = {
    "t1": lambda d, n: K.column_kinds(d), "t2": lambda d, n: K.coercion_rules(d), "t6": lambda d, n: K.schema_overview(d),
    "v6": lambda d, n: V.validate(d), "p1": lambda d, n: P.dataset_info(d), "p3": lambda d, n: P.missing_table(d),
    "p4": lambda d, n: P.describe_numeric(d), "p5": lambda d, n: P.moments(d, [n("x"), n("z")]), "u1": lambda d, n: P.univariate_numeric(d),
    "u1 forced": lambda d, n: P.univariate_numeric(d, method="distributed"), "u2": lambda d, n: P.outlier_counts(d, [n("x")]),
    "u3": lambda d, n: P.univariate_categorical(d), "u4": lambda d, n: P.univariate(d, n("word")), "p8": lambda d, n: P.categorical_profile(d),
    "p7": lambda d, n: B.correlation_matrix(d), "b1": lambda d, n: B.pearson_test(d, n("x"), n("y")), "b2": lambda d, n: B.spearman_test(d, n("x"), n("y")),
    "b4": lambda d, n: B.contingency(d, n("kind"), n("group")), "b4 zeros": lambda d, n: B.contingency(d, n("kind"), n("group"), zeros=True),
    "b5": lambda d, n: B.chi_square_test(d, n("kind"), n("group")), "b7": lambda d, n: B.group_statistics(d, n("kind"), n("x")),
    "b8": lambda d, n: B.anova_oneway(d, n("kind"), n("x")), "b9": lambda d, n: B.bivariate(d, n("word"), n("kind")), "m2": lambda d, n: B.groupby_grid(d),
    "m1": lambda d, n: B.correlation_pairs(d), "d8": lambda d, n: D.scatter_bins(d, n("x"), n("y")),
    "g1": lambda d, n: G.detect_targets(d), "g6": lambda d, n: G.category_impact(d, n("kind"), n("x")), "g7": lambda d, n: G.class_separation(d, n("x"), n("yes")),
    "g8": lambda d, n: G.association_residuals(d, n("kind"), n("yes")), "g10": lambda d, n: G.feature_impact(d, n("y")), "g10 text": lambda d, n: G.feature_impact(d, n("yes")),
    "g12": lambda d, n: G.feature_ranking(d, n("y")), "g13": lambda d, n: G.target_summary(d, n("y")), "d1": lambda d, n: D.histogram(d, n("x")),
    "d2": lambda d, n: D.box_stats(d, [n("x"), n("z")]), "d3": lambda d, n: D.density(d, n("x")), "d10": lambda d, n: D.grouped_box(d, n("kind"), n("x")),
    "d12": lambda d, n: D.outlier_rows(d, n("y")), "d14": lambda d, n: D.time_series(d, n("day"), n("x")), "d11": lambda d, n: D.parallel_coordinates(d),
    "c1": lambda d, n: C.fill_values(d), "c2": lambda d, n: C.fill_missing(d), "c3": lambda d, n: C.drop_duplicates(d), "c4": lambda d, n: C.cap_outliers(d)[0],
    "c7": lambda d, n: C.clean(d).table, "c6": lambda d, n: C.clean(d).audit, "s4": lambda d, n: io.sample_values(d, n("kind"), 3, [n("y")]),
    "n1": lambda d, n: N.distribution_findings(d, n("x")), "n3": lambda d, n: N.bivariate_findings(d, n("x"), n("y")), "n4": lambda d, n: N.target_findings(d, n("yes"), n("x")),
    "n5": lambda d, n: N.dataset_findings(d), "n6": lambda d, n: N.executive_summary(d), "n7": lambda d, n: N.one_paragraph(d),
}


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.6g}")
    if isinstance(v, str):
        for safe, odd in ODD.items():
            v = v.replace(odd, safe)
    return v


@pytest.fixture(scope="module")
def both(spark):
    return table(spark, {}).persist(), table(spark, ODD).persist()


@pytest.mark.parametrize("case", CASES)
def test_same_answer(both, case):
    safe = CASES[case](both[0], lambda c: c)
    odd = CASES[case](both[1], lambda c: ODD[c])
    assert [plain(c) for c in odd.columns] == safe.columns
    one, two = (sorted(repr([plain(v) for v in r]) for r in d.collect()) for d in (safe, odd))
    if case != "g1":      # which goes by names
        assert one == two
    assert one


def test_read_table_keeps_names_and_line_breaks(spark, tmp_path):
    (tmp_path / "q.csv").write_text('id,te.xt,a b\n1,"two\nlines, ""quoted""",3\n2,plain,4\n')
    d = io.read_table(spark, str(tmp_path / "q.csv"), plain_names=False)
    assert d.columns == ["id", "te.xt", "a b"]
    assert [tuple(r) for r in d.collect()] == [(1, 'two\nlines, "quoted"', 3), (2, "plain", 4)]
    assert io.read_named(spark, "q.csv", str(tmp_path)).count() == 2
    (tmp_path / "p.csv").write_text("id,t\n" + "".join(f'{i},"say ""{i}"""\n' for i in range(50)))
    assert not io._breaks_in_quotes(spark, str(tmp_path / "p.csv")) and io.read_table(spark, str(tmp_path / "p.csv")).count() == 50
