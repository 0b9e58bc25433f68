"""Column kinds and value-based type rules.

Kinds come from the schema (``numeric`` for number and boolean types,
``categorical`` for strings, ``datetime`` for dates and timestamps, ``other``
for the rest). Value-based rules decide whether a *string* column is analysed
as a number; each is one aggregation pass:

* majority of non-null values convert      (univariate, profile)
* sentinels to null, then majority of rows  (bivariate)
* any value converts                        (distribution chart data)
* every value converts, else every value parses as a date (cleaning)
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions.stats import at, is_numeric_type, to_number, without_sentinels
from tablelens.operators import texts as X

# The readings of a text date in order of preference (month first
# where both fit). A time of day may follow any of them.
READINGS = [
    "yyyy/M/d", "M/d/yyyy", "d/M/yyyy", "M-d-yyyy", "d-M-yyyy", "M.d.yyyy", "d.M.yyyy", "yyyyMMdd",
    "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy",
]
CLOCK = "[['T'][ ]H:mm[:ss]]"
# what a trimmed text must look like for a reading to be tried: a parse that fails
# costs many times one that succeeds, so it is kept to days that a month lacks
_MONTH, _DAY, _CLOCK = r"(0?[1-9]|1[0-2])", r"(0?[1-9]|[12]\d|3[01])", r"([ T]([01]?\d|2[0-3]):[0-5]\d(:[0-5]\d)?)?"
_SHORT, _LONG = r"\p{L}{3}", r"(\p{L}{4,9}|(?iu:may))"
READING_SHAPES = ["^" + shape + _CLOCK + r"\z" for shape in [
    rf"\d{{4}}/{_MONTH}/{_DAY}",
    *[f"{first}{sep}{second}{sep}" + r"\d{4}" for sep in ("/", "-", r"\.") for first, second in ((_MONTH, _DAY), (_DAY, _MONTH))],
    r"\d{4}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])",
    rf"{_DAY} {_SHORT} \d{{4}}", rf"{_DAY} {_LONG} \d{{4}}", rf"{_SHORT} {_DAY}, \d{{4}}", rf"{_LONG} {_DAY}, \d{{4}}",
]]
# the mark that a text of each reading holds, and no text of the others does
READING_MARKS = [next((m for m in "/-.," if m in reading), "") for reading in READINGS]
# a text can only have one of these readings if it has this shape; testing it
# first spares the (costly) failing parses on ordinary text
DATE_SHAPE = (r"^\s*(\d{4}/\d{1,2}/\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4}|\d{8}|\d{1,2} \p{L}{3,9} \d{4}|\p{L}{3,9} \d{1,2}, \d{4})"
              r"([ T]\d{1,2}:\d{2}(:\d{2})?)?\s*$")
# ISO 8601 with any of minutes, seconds, a fraction and a zone: Spark's own cast
# reads it. It is the first reading (bit 0 of a mask; READINGS[i] is bit i + 1).
ISO_SHAPE = r"^\s*\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})?)?\s*$"
N_READINGS = len(READINGS) + 1


def kind_of(dt: T.DataType) -> str:
    if is_numeric_type(dt):
        return "numeric"
    if isinstance(dt, (T.StringType, T.VarcharType, T.CharType)):
        return "categorical"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "other"


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if kind_of(f.dataType) == "numeric"]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if kind_of(f.dataType) == "categorical"]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if kind_of(f.dataType) == "datetime"]


def column_kinds(df: DataFrame) -> DataFrame:
    """(position, column, dtype, kind), one row per column (schema only)."""
    rows = [(i, f.name, f.dataType.simpleString(), kind_of(f.dataType))
            for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(
        rows, "position int, column string, dtype string, kind string")


def dtype_summary(df: DataFrame) -> DataFrame:
    """Column → dtype name."""
    return column_kinds(df).select("column", "dtype")


def _stack(df: DataFrame, cols: Sequence[str], exprs) -> DataFrame:
    """One wide aggregation row → one row per column."""
    structs = [F.struct(F.lit(c).alias("column"), *[e(c).alias(n) for n, e in exprs]) for c in cols]
    return df.agg(F.array(*structs).alias("s")).select(F.inline("s"))


def schema_overview(df: DataFrame) -> DataFrame:
    """Column, dtype, non-null count, null count — one pass."""
    from tablelens.functions.stats import num
    types = {f.name: f.dataType for f in df.schema.fields}

    def present(c):
        dt = types[c]
        v = num(c, dt) if isinstance(dt, (T.FloatType, T.DoubleType)) else at(c)
        return v

    counts = _stack(df, df.columns, [
        ("non_null", lambda c: F.count(present(c))),
        ("rows", lambda c: F.count(F.lit(1))),
    ])
    kinds = column_kinds(df)
    return (counts.join(F.broadcast(kinds), "column")
            .select("position", "column", "dtype", "non_null",
                    (F.col("rows") - F.col("non_null")).alias("null_count")))


def conversion_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per string column: rows, non-null, convertible as number (plain),
    convertible after sentinel removal, convertible as date. One pass, over one
    value a row: its code does not grow with the columns, so it gets compiled."""
    spark = df.sparkSession
    cols = list(cols) if cols is not None else categorical_columns(df)
    names = spark.range(1).select(F.posexplode(F.array(*[F.lit(c) for c in cols]).cast("array<string>")).alias("pos", "column"))
    if not cols:
        df, cols = df.limit(0).select(F.lit(None).cast("string").alias("value")), ["value"]
    values = df.select(F.posexplode(F.array(*[at(c).cast("string") for c in cols])).alias("pos", "value"))
    counts = values.select("*", date_mask("value").alias("mask")).groupBy("pos").agg(   # the mask computed once a value
        F.count(F.lit(1)).alias("rows"),
        F.count("value").alias("non_null"),
        F.count(to_number("value")).alias("numeric"),
        F.count(to_number(without_sentinels("value"))).alias("numeric_no_sentinel"),
        F.count_if(F.col("mask") != 0).alias("datetime"),
        F.bit_and("mask").alias("readings"))
    totals = ["rows", "non_null", "numeric", "numeric_no_sentinel", "datetime"]
    return names.join(F.broadcast(counts), "pos", "left").select(
        "column", *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in totals], "readings")


def conversion_exprs(cols: Sequence[str]):
    """(column, name, aggregate) triples deciding the all-or-nothing conversion."""
    out = []
    for c in cols:
        out += [(c, "non_null", F.count(at(c))), (c, "numeric", F.count(to_number(c))),
                (c, "readings", F.bit_and(date_mask(c)))]
    return out


def conversion_word(numeric: int, readings: int | None, non_null: int) -> str:
    if numeric == non_null:
        return X.TO_NUMERIC
    return X.TO_DATETIME if readings else X.KEPT


def first_reading(readings: int | None) -> int | None:
    """The preferred reading (its bit) of those that read every value."""
    return (readings & -readings).bit_length() - 1 if readings else None


def coercion_rules(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """T2–T5 for every string column in one pass: which rule calls it numeric,
    and what the cleaning conversion does with it."""
    cc = conversion_counts(df, cols)
    return cc.select(
        "column", "rows", "non_null", "numeric", "numeric_no_sentinel", "datetime",
        (F.col("numeric") > 0.5 * F.col("non_null")).alias("majority_non_null"),
        F.when(F.col("rows") > 0, F.col("numeric_no_sentinel") / F.col("rows") > 0.5)
        .otherwise(False).alias("majority_rows"),
        (F.col("numeric") > 0).alias("any_value"),
        F.when(F.col("numeric") == F.col("non_null"), X.TO_NUMERIC)
        .when(F.col("readings") != 0, X.TO_DATETIME)
        .otherwise(X.KEPT).alias("conversion"),
    )


def _read(col, reading: int):
    """The timestamp that one reading makes of a text, else null."""
    if reading == 0:
        return F.when(col.rlike(ISO_SHAPE), F.trim(col).try_cast("timestamp"))
    return F.try_to_timestamp(F.trim(col), F.lit(READINGS[reading - 1] + CLOCK))


def date_mask(c: str):
    """Bits of the readings that read this value whole (null stays null). The
    ``bit_and`` over a column keeps the readings that read every value of it."""
    col = at(c).cast("string")
    iso, *bits = [F.when(_read(col, i).isNotNull(), 1 << i).otherwise(0) for i in range(N_READINGS)]
    marked = {m: F.lit(0) for m in dict.fromkeys(READING_MARKS)}
    for mark, shape, bit in zip(READING_MARKS, READING_SHAPES, bits):
        marked[mark] = marked[mark] + F.when(F.trim(col).rlike(shape), bit).otherwise(0)
    dates = marked.pop("")
    for mark, some in marked.items():
        dates = F.when(col.contains(mark), some).otherwise(dates)
    return F.when(col.isNotNull(), F.when(col.rlike(ISO_SHAPE), iso).when(col.rlike(DATE_SHAPE), dates).otherwise(0))


def to_datetime(c: str, reading: int):
    """Text → timestamp under one reading of the whole column."""
    return _read(at(c).cast("string"), reading)


def date_readings(df: DataFrame, cols: Sequence[str]) -> dict[str, int | None]:
    """Per text column the reading that reads every value (null: none does), one pass."""
    if not cols:
        return {}
    masks = conversion_counts(df, cols).select("column", "readings").collect()
    return {r["column"]: first_reading(r["readings"]) for r in masks}


def commonest_reading(df: DataFrame, c: str) -> int:
    """The reading that reads most values of a text column (ties: the preferred one)."""
    row = df.select(date_mask(c).alias("m")).agg(*[F.count_if(F.col("m").bitwiseAND(1 << i) != 0).alias(f"n{i}") for i in range(N_READINGS)]).first()
    return max(range(N_READINGS), key=lambda i: (row[f"n{i}"], -i))


def apply_conversions(df: DataFrame, decisions: dict[str, str], readings: dict[str, int | None] | None = None) -> DataFrame:
    """Cast the columns named in ``decisions`` (column → conversion word); dates
    under one reading a column (``readings``, looked for when not given)."""
    dates = [c for c in df.columns if decisions.get(c) == X.TO_DATETIME]
    readings = readings if readings is not None else date_readings(df, dates)
    out = []
    for c in df.columns:
        d = decisions.get(c)
        if d == X.TO_NUMERIC:
            out.append(to_number(c).alias(c))
        elif d == X.TO_DATETIME:
            out.append(to_datetime(c, readings[c]).alias(c))
        else:
            out.append(at(c))
    return df.select(*out)


def resolve_numeric_many(df: DataFrame, columns: Sequence[str], rule: str = "majority_non_null") -> dict:
    """``resolve_numeric`` for several columns, deciding every text column in
    ONE aggregation: column → (expression, is_numeric)."""
    from tablelens.functions.stats import num
    texts = [c for c in dict.fromkeys(columns) if isinstance(df.schema[c].dataType, T.StringType)]
    rules = {r["column"]: r for r in coercion_rules(df, texts).collect()} if texts else {}
    out = {}
    for c in dict.fromkeys(columns):
        dt = df.schema[c].dataType
        if is_numeric_type(dt):
            out[c] = (num(c, dt), True)
        elif c in rules and rules[c][rule]:
            src = without_sentinels(at(c)) if rule == "majority_rows" else at(c)
            out[c] = (to_number(src), True)
        else:
            out[c] = (at(c), False)
    return out


def resolve_numeric(df: DataFrame, column: str, rule: str = "majority_non_null"):
    """(column expression, is_numeric) for one column under a value rule.

    Needs one small aggregation when the column is a string; the answer decides
    the *schema* of what follows, so it is the one place a result is fetched."""
    dt = df.schema[column].dataType
    from tablelens.functions.stats import num
    if is_numeric_type(dt):
        return num(column, dt), True
    if not isinstance(dt, T.StringType):
        return at(column), False
    row = coercion_rules(df, [column]).first()
    ok = bool(row[rule])
    if not ok:
        return at(column), False
    src = without_sentinels(at(column)) if rule == "majority_rows" else at(column)
    return to_number(src), True
