"""End-to-end flows built from the operators.

* ``analyze``: validate → clean → profile → pairs → target → findings. The
  cleaned table is written once to the shared checkpoint folder and every
  later result reads that copy (lineage cut, one cleaning shuffle).
* ``save``: keep every result table (S5).

Everything returned is a DataFrame; nothing but per-column statistics passes
through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tablelens.functions.frames import materialize
from tablelens.operators import checks as V
from tablelens.operators import clean as C
from tablelens.operators import findings as N
from tablelens.operators import kinds as K
from tablelens.operators import pairs as B
from tablelens.operators import profile as P
from tablelens.operators import target as G
from tablelens.sources.io import write_results


def analyze(df: DataFrame, target: str | None = None, clean: bool = True, fill: bool = True,
            dedupe: bool = True, cap: bool = True, convert: bool = True,
            max_features: int | None = 10) -> dict[str, DataFrame]:
    """Entry A (+B, +C when a target is given): the reference's analysis of one table."""
    out: dict[str, DataFrame] = {"issues": V.validate(df)}
    if clean:
        res = C.clean(df, fill=fill, dedupe=dedupe, cap=cap, convert=convert)
        table = materialize(res.table, "cleaned")
        out["cleaning_audit"] = res.audit
    else:
        table = df
    out["table"] = table
    out["schema"] = K.schema_overview(table)
    out["info"] = P.dataset_info(table)
    out["missing"] = P.missing_table(table)
    if K.numeric_columns(table):
        out["numeric_profile"] = P.describe_numeric(table)
    if K.categorical_columns(table):
        out["categorical_profile"] = P.categorical_profile(table)
    if len(K.numeric_columns(table)) > 1:
        out["correlations"] = B.correlation_matrix(table)
        out["correlation_pairs"] = B.correlation_pairs(table)
        out["correlation_findings"] = N.correlation_findings(table)
    if K.numeric_columns(table) and K.categorical_columns(table):
        out["groupby_grid"] = B.groupby_grid(table)
    out["target_candidates"] = G.detect_targets(table)
    if target is not None:
        out["target_summary"] = G.target_summary(table, target)
        impact = G.feature_impact(table, target, max_features)
        out["feature_impact"] = impact
        out["top_impact"] = G.top_impact(impact)
    out["findings"] = N.dataset_findings(table, target)
    out["summary"] = N.executive_summary(table, target)
    return out


def save(results: dict[str, DataFrame], base: str, fmt: str = "parquet") -> dict[str, str]:
    """Write every result table under ``base``; the cleaned table too."""
    return {name: write_results(df, f"{base}/{name}", fmt) for name, df in results.items()}
