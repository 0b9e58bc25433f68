"""Run queries() on Spark and oracle_sql() on DuckDB and compare them the way
the driver does: same row count, same column names, same values as a
multiset (doubles rounded to 6 places)."""

from __future__ import annotations

import math
import sys
import time

import duckdb

sys.path.insert(0, "/root/repo")

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, int):
        return v
    try:
        from decimal import Decimal
        if isinstance(v, Decimal):
            return round(float(v), 6) + 0.0
    except Exception:
        pass
    return v


def rows_key(rows):
    return sorted((tuple(norm(x) for x in r) for r in rows), key=lambda t: repr(t))


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE",
                 "date": "DATE", "smallint": "SMALLINT", "tinyint": "TINYINT", "array<double>": "DOUBLE[]"}


def type_mismatches(sdf, rel) -> list[str]:
    """Columns whose Spark type does not map to the DuckDB result type."""
    duck = {d[0]: str(d[1]) for d in rel.description}
    out = []
    for f in sdf.schema.fields:
        want = SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
        got = duck.get(f.name)
        if got is not None and got != want:
            out.append(f"{f.name}: spark {f.dataType.simpleString()} vs duck {got}")
    return out


def compare(spark, name, fn, sql, sf_dir, con):
    t = time.time()
    sdf = fn(spark, sf_dir)
    cols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    ts = time.time() - t
    if sql is None:
        return dict(name=name, ok=None, rows=len(srows), sec=round(ts, 2), note="no oracle")
    rel = con.execute(sql)
    types = type_mismatches(sdf, rel)
    dcols = [d[0] for d in rel.description]
    drows = rel.fetchall()
    if sorted(cols) != sorted(dcols):
        return dict(name=name, ok=False, note=f"columns differ: spark={cols} duck={dcols}")
    order = [dcols.index(c) for c in cols]
    drows = [tuple(r[i] for i in order) for r in drows]
    if len(srows) != len(drows):
        return dict(name=name, ok=False, note=f"rows differ: spark={len(srows)} duck={len(drows)}")
    a, b = rows_key(srows), rows_key(drows)
    if a != b and len(srows) == len(drows):   # doubles as computed may differ in their last bits
        a, b = (sorted((tuple(x for x in r) for r in rows), key=lambda t: repr(tuple(round(v, 3) if isinstance(v, float) else v for v in t)))
                for rows in (srows, drows))
        same = all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9))
                   for r, t in zip(a, b) for x, y in zip(r, t))
        a = b if same else a
    if a != b:
        diffs = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return dict(name=name, ok=False, note=f"values differ: {diffs}")
    if types:
        return dict(name=name, ok=False, note=f"types differ: {types}")
    return dict(name=name, ok=True, rows=len(srows), sec=round(ts, 2))


def main(argv):
    import importlib
    entry = importlib.import_module("__spark_entry__")
    from tablelens.session import local_session
    sf_dir = "/root/testdata/sf0.01"
    spark = local_session()
    con = duck(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    names = [n for n in qs if not argv or any(a in n for a in argv)]
    bad = 0
    for n in names:
        try:
            res = compare(spark, n, qs[n], sqls.get(n), sf_dir, con)
        except Exception as e:  # report and go on
            res = dict(name=n, ok=False, note=f"error: {type(e).__name__}: {str(e)[:400]}")
        bad += res.get("ok") is False
        print(res, flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")


if __name__ == "__main__":
    main(sys.argv[1:])
