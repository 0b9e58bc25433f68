"""License scans by sentence rules (DataFrame and SQL functions only).

A text is cut into units at sentence ends and blank lines (a line of comment
marks only is blank), each unit into parts at its line breaks and after ';' or
':'. Parts are normalised (lower case, runs of anything but letters and digits
become one space). A known licence sentence is found where one part, or several
in a row, make up its words, so notices wrapped at any width, behind comment
marks or with a ';' inside are found whole, and so is a line of its own. This
gives a sequence of sentence identifiers in text order. The
ordered rules are then matched against that sequence: the first rule whose
identifiers stand there in a row takes them, so that a full licence is not
reported again by the short notice inside it. Identifiers no rule takes are
returned as ``unmatched``.

All of it happens inside the row: no shuffle, and no group to skew.

Defined cases: where known sentences overlap, the one that starts first counts,
the longest if several start there; comment marks that are words (``REM``,
``dnl``) are part of the sentence, which is then not found; null and empty texts have no sentences (empty lists); repeated
rows are scanned one by one; other columns are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import text_or_empty

# Published licence sentences, normalised, and their identifiers.
SENTENCES: dict[str, str] = {
    "released under the mit license": "MITref",
    "licensed under the mit license": "MITref",
    "this project is licensed under the mit license": "MITref",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
    " documentation files the software to deal in the software without restriction including without limitation the"
    " rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit"
    " persons to whom the software is furnished to do so subject to the following conditions": "MITperm",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of"
    " the software": "MITnotice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the"
    " warranties of merchantability fitness for a particular purpose and noninfringement": "MITwarranty",
    "licensed under the apache license version 2 0": "Apache2ref",
    "licensed under the apache license version 2 0 the license": "Apache2ref",
    "you may not use this file except in compliance with the license": "Apache2comply",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed"
    " on an as is basis without warranties or conditions of any kind either express or implied": "Apache2asis",
    "see the license for the specific language governing permissions and limitations under the license": "Apache2see",
    "this work is licensed under the gnu general public license version 3": "GPL3ref",
    "licensed under the gnu general public license version 3": "GPL3ref",
    "licensed under the gnu general public license version 2": "GPL2ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public"
    " license as published by the free software foundation either version 3 of the license or at your option any later"
    " version": "GPL3plus",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public"
    " license as published by the free software foundation either version 2 of the license or at your option any later"
    " version": "GPL2plus",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied"
    " warranty of merchantability or fitness for a particular purpose": "GPLnowarranty",
    "see the gnu general public license for more details": "GPLsee",
    "licensed under cc by 4 0": "CCBYref",
    "licensed under cc by sa 4 0": "CCBYSAref",
    "licensed under cc by nc 4 0": "CCBYNCref",
    "this work is licensed under a creative commons attribution 4 0 international license": "CCBYref",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the"
    " following conditions are met": "BSDperm",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following"
    " disclaimer": "BSDsource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following"
    " disclaimer in the documentation and or other materials provided with the distribution": "BSDbinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
    " products derived from this software without specific prior written permission": "BSDendorse",
    "all rights reserved": "AllRights",
}

# The rules in the order in which they are tried.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("MIT", ("MITperm", "MITnotice", "MITwarranty")),
    ("BSD-3-Clause", ("BSDperm", "BSDsource", "BSDbinary", "BSDendorse")),
    ("BSD-2-Clause", ("BSDperm", "BSDsource", "BSDbinary")),
    ("Apache-2.0", ("Apache2ref", "Apache2comply", "Apache2asis", "Apache2see")),
    ("GPL-3.0-or-later", ("GPL3plus", "GPLnowarranty", "GPLsee")),
    ("GPL-2.0-or-later", ("GPL2plus", "GPLnowarranty", "GPLsee")),
    ("GPL-3.0-or-later", ("GPL3plus",)),
    ("GPL-2.0-or-later", ("GPL2plus",)),
    ("GPL-3.0-only", ("GPL3ref",)),
    ("GPL-2.0-only", ("GPL2ref",)),
    ("Apache-2.0", ("Apache2ref",)),
    ("MIT", ("MITref",)),
    ("CC-BY-4.0", ("CCBYref",)),
    ("CC-BY-SA-4.0", ("CCBYSAref",)),
    ("CC-BY-NC-4.0", ("CCBYNCref",)),
]

#: ends of units: a sentence end, or a line without letters and digits
UNIT = r"[.!?][ \t\r\n]+|\n[^a-z0-9\n]*(?=\n)"
#: ends of parts besides line breaks
PART = r"[;:][ \t\r]+"
NOT_WORD = "[^a-z0-9]+"
#: every known sentence holds one of these words; other units are not normalised
HINT = "licen|permission|warrant|rights|redistribut"


def sentence_ids(text: Column, known: dict[str, str] = SENTENCES) -> Column:
    """Identifiers of the known sentences, in text order."""
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    longest_first = sorted(known, key=len, reverse=True)
    found_in = "(?m)^(?:" + "|".join(s.replace(" ", "[ \\n]") for s in longest_first) + ")$"

    def ids(unit: Column) -> Column:
        words = F.regexp_replace(F.regexp_replace(unit, PART, "\n"), r"[^a-z0-9\n]+", " ")
        parts = F.trim(F.regexp_replace(words, r" ?\n[ \n]*", "\n"))
        found = F.regexp_extract_all(parts, F.lit(found_in), F.lit(0))
        return F.transform(found, lambda s: F.element_at(table, F.replace(s, F.lit("\n"), F.lit(" "))))

    hinted = F.filter(F.split(F.lower(text), UNIT, -1), lambda u: u.rlike(HINT))
    return F.flatten(F.transform(hinted, ids))


def match_rules(ids: Column, rules: list[tuple[str, tuple[str, ...]]] = RULES) -> tuple[Column, Column]:
    """(licences in rule order, identifiers left over): each rule in turn takes
    every run of its identifiers out of the sequence."""
    rest = F.concat(F.lit("|"), F.concat_ws("||", ids), F.lit("|"))
    names = []
    for name, need in rules:
        run = F.lit("|" + "||".join(need) + "|")
        names.append(F.when(F.contains(rest, run), F.lit(name)))
        rest = F.replace(rest, run, F.lit("|taken|"))
    left = F.filter(F.split(rest, r"\|+"), lambda i: (i != "") & (i != "taken"))
    return F.array_distinct(F.array_compact(F.array(*names))), left


def scan_licenses(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``sentence_ids``, ``licenses`` and ``unmatched`` (arrays of strings)."""
    ids = df.withColumn("sentence_ids", sentence_ids(text_or_empty(text_col)))
    names, left = match_rules(F.col("sentence_ids"))
    empty = F.array().cast("array<string>")
    any_ = F.size("sentence_ids") > 0
    return ids.withColumns({"licenses": F.when(any_, names).otherwise(empty),
                            "unmatched": F.when(any_, left).otherwise(empty)})


def oracle_sql() -> str:
    """The same scan in DuckDB SQL, one digest row per document."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    table = "MAP {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in SENTENCES.items()) + "}"
    steps, names, rest = [], [], "r0"
    for i, (name, need) in enumerate(RULES):
        run = quote("|" + "||".join(need) + "|")
        names.append(f"CASE WHEN contains(r{i}, {run}) THEN {quote(name)} END")
        steps.append(f"s{i + 1} AS (SELECT *, replace(r{i}, {run}, '|taken|') AS r{i + 1} FROM s{i})")
        rest = f"r{i + 1}"
    return f"""
WITH cut AS (
  SELECT doc_id, list_transform(
    list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[.!?;:][ \\t\\r]+|\\n+'),
                lambda s: regexp_matches(s, '{HINT}')),
    lambda s: trim(regexp_replace(s, '{NOT_WORD}', ' ', 'g'))) AS sents FROM documents),
known AS (SELECT {table} AS m),
ids AS (SELECT doc_id, list_filter(list_transform(sents, lambda s: m[s]), lambda i: i IS NOT NULL) AS sentence_ids
        FROM cut, known),
s0 AS (SELECT *, '|' || array_to_string(sentence_ids, '||') || '|' AS r0 FROM ids),
{", ".join(steps)},
named AS (SELECT doc_id, sentence_ids, {rest} AS rest,
  list_filter([{", ".join(names)}], lambda x: x IS NOT NULL) AS found FROM s{len(RULES)}),
once AS (SELECT *, list_filter(found, lambda x, i: list_position(found, x) = i) AS licenses,
  list_filter(string_split_regex(rest, '[|]+'), lambda i: i <> '' AND i <> 'taken') AS left_over FROM named)
SELECT doc_id, CAST(len(sentence_ids) AS INTEGER) AS n_sentences, coalesce(array_to_string(sentence_ids, ','), '') AS sentence_ids,
  coalesce(array_to_string(licenses, ','), '') AS licenses, coalesce(array_to_string(left_over, ','), '') AS unmatched
FROM once"""
