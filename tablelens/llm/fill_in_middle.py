"""Fill-in-the-middle transformation by counted-quantifier patterns.

A text is tiled by units (white space with the word after it, or trailing
white space). ``regexp_count`` gives their number n; two draws from a digest of
the id give the cuts a <= b. Each row then gets a pattern of its own,
``((?:unit){a}+)((?:unit){b-a}+)(.*)``, and one match of it captures prefix,
middle and suffix, which the row's replacement string writes out in the order
of its form. The counted groups are possessive, so the matcher walks the text
once and never keeps places to go back to, however long the text is.

Everything happens inside the row: no shuffle, no Python worker, nothing that
grows with the number of rows.

Defined cases: a null text is empty; empty texts and texts that hold a mark
stay plain; a null id counts as the empty string in the digest; equal ids draw
equal cuts, so repeated rows give repeated results; other columns are carried,
those named as a result column are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import text_or_empty

# The unit a text is cut in, and the marks of prefix, suffix and middle.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
MARKS = ("<P>", "<S>", "<M>")

RESULT = ["fim_units", "fim_form", "fim_output", "fim_prefix_chars", "fim_middle_chars"]


def check_marks(marks: Sequence[str]) -> None:
    """Marks must be found again at the places where they were put: a mark
    begins with a character that no mark holds further on, so no text without
    marks can form one together with the mark that follows it."""
    if len(marks) != 3 or len(set(marks)) != 3 or not all(marks):
        raise ValueError("three different marks are needed")
    if any(m[0] in other[1:] for m in marks for other in marks) or any(a != b and b.startswith(a) for a in marks for b in marks):
        raise ValueError("a mark may not begin inside a mark")


def draws(id_: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers: the first digit groups of sha256("seed:id")."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _plain_text(s: str) -> str:
    """``s`` as a literal of a Java replacement string."""
    return s.replace("\\", "\\\\").replace("$", "\\$")


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50,
                   spm_rate: int = 80, marks: Sequence[str] = MARKS, unit: str = UNIT) -> DataFrame:
    """``df`` with ``fim_units`` (n), ``fim_form`` (plain, psm or spm),
    ``fim_output``, and the code points of prefix and middle (null if plain).
    ``rate`` % of the texts are cut, ``spm_rate`` % of those put the suffix first."""
    check_marks(marks)
    p, s, m = map(_plain_text, marks)
    h = [F.col(f"__fim_h{i}") for i in range(4)]
    n, a, b, text = F.col("fim_units"), F.col("__fim_a"), F.col("__fim_b"), F.col("__fim_text")
    out = df.drop(*RESULT).withColumn("__fim_text", text_or_empty(text_col))
    out = out.withColumns({f"__fim_h{i}": c for i, c in enumerate(draws(F.col(id_col), seed))} | {
        "fim_units": F.regexp_count(text, F.lit(unit)).cast("long")})
    marked = F.lit(False)
    for mark in marks:
        marked = marked | F.contains(text, F.lit(mark))
    plain = (text == "") | marked | (h[2] % 100 >= rate)
    out = out.withColumns({
        "__fim_a": F.least(h[0] % (n + 1), h[1] % (n + 1)),
        "__fim_b": F.greatest(h[0] % (n + 1), h[1] % (n + 1)),
        "fim_form": F.when(plain, "plain").when(h[3] % 100 < spm_rate, "spm").otherwise("psm")})
    form = F.col("fim_form")
    pattern = F.concat(F.lit(f"(?s)^((?:{unit}){{"), a.cast("string"), F.lit(f"}}+)((?:{unit}){{"),
                       (b - a).cast("string"), F.lit("}+)(.*)"))
    order = F.when(form == "psm", f"{p}$1{s}$3{m}$2").otherwise(f"{s}$3{p}$1{m}$2")
    out = out.withColumn("fim_output", F.when(form == "plain", text).otherwise(F.regexp_replace(text, pattern, order)))
    place = {mark: F.instr(F.col("fim_output"), mark) for mark in marks}
    after_prefix = F.when(form == "psm", place[marks[1]]).otherwise(place[marks[2]])
    before_middle = place[marks[2]] + len(marks[2]) - 1
    out = out.withColumns({
        "fim_prefix_chars": F.when(form != "plain", after_prefix - place[marks[0]] - len(marks[0])).cast("long"),
        "fim_middle_chars": F.when(form != "plain", F.length("fim_output") - before_middle).cast("long")})
    return out.drop("__fim_text", "__fim_a", "__fim_b", *[f"__fim_h{i}" for i in range(4)])


def restored(output: Column, form: Column, marks: Sequence[str] = MARKS) -> Column:
    """The text before the transformation, from output and form alone."""
    check_marks(marks)
    p, s, m = (f"\\Q{x}\\E" for x in marks)
    return (F.when(form == "psm", F.regexp_replace(output, f"(?s)^{p}(.*?){s}(.*?){m}(.*)", "$1$3$2"))
            .when(form == "spm", F.regexp_replace(output, f"(?s)^{s}(.*?){p}(.*?){m}(.*)", "$2$3$1"))
            .otherwise(output))


def digests(df: DataFrame, marks: Sequence[str] = MARKS) -> DataFrame:
    """``df`` with the SHA-256 of the output and of the text rebuilt from it."""
    back = restored(F.col("fim_output"), F.col("fim_form"), marks)
    return df.withColumns({"output_sha256": F.sha2("fim_output", 256), "restored_sha256": F.sha2(back, 256)})


def oracle_sql() -> str:
    """The query's rows in DuckDB: lists of units cut by slices."""
    p, s, m = MARKS
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '{UNIT}') AS u FROM documents),
r AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '{p}') OR contains(t, '{s}') OR contains(t, '{m}') OR h3 % 100 >= 50 THEN 'plain'
         WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM r),
x AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid,
    coalesce(array_to_string(u[b + 1:n], ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{p}' || pre || '{s}' || suf || '{m}' || mid
    ELSE '{s}' || suf || '{p}' || pre || '{m}' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM x"""
