"""Benchmark decontamination through a distributed positional inverted index
(DataFrame functions only).

The index stores the postings of training words: (term, row, place), sorted by
term inside every file, plus one header a row (term -1: its id and number of
words). Words are matched to terms where they are read, so building it
shuffles no text. An index built for given test items holds the postings of
their words only: no other word can stand in a match.

A test phrase (every distinct window of consecutive item words, stored once
however many items hold it) starts from the postings of its rarest term, moved
back by the term's offset: those are all the places where it can begin. That
list meets the moved list of the second rarest term, and what is left meets
the lists of all others. With ``slop`` a term may stand up to so many words
from its exact place (proximity; distance 0 is the exact phrase). Phrases with
a term that the corpus lacks are dropped before anything is read.

Lists are rows, not arrays, so a word that stands in a third of all documents
is a longer run of rows and no larger row; every intersection is an equi-join
on (row, place, term), unique on the index's side. The vocabulary is broadcast
below ``BROADCAST_TERMS`` terms and ``BROADCAST_BYTES`` bytes, tables of test
phrases and numbers of rows in question below ``BROADCAST_ROWS`` rows (all
counted first); beyond that they are joined by shuffle.

Defined cases: null and empty texts have no words and are never hit; an item
without words has no window, one shorter than the window is one window of its
own length; a null id of an item counts as the empty string, and rows of items
with equal ids are one item; repeated rows (null ids too) are told apart by
their row numbers and reported one by one; columns of other names are not
read; empty tables give no rows, or rows without hits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelens.llm.common import stored, text_or_empty

# The contract's words, after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HEADER = "\x00"     # stands after a text's last word; no word holds it

BROADCAST_TERMS = 1_000_000
BROADCAST_BYTES = 64 << 20
BROADCAST_ROWS = 4_000_000      # rows of at most three longs each


@dataclass(frozen=True)
class Index:
    """``terms`` (word, term) and ``postings`` (term, row, place, doc_id); in a
    header (term -1) ``place`` is the number of words, and only it has the id."""
    terms: DataFrame
    postings: DataFrame

    def headers(self) -> DataFrame:
        return self.postings.filter(F.col("term") == -1).select("row", "doc_id", F.col("place").cast("long").alias("n_words"))

    def lists(self) -> DataFrame:
        return self.postings.filter(F.col("term") >= 0).select("term", "row", "place")

    def frequencies(self) -> DataFrame:
        return self.lists().groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def _bounded(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` as the broadcast side of a join when it has at most ``limit``
    rows; a larger one is joined by shuffle."""
    return F.broadcast(df) if df.count() <= limit else df


def words(text: Column | str) -> Column:
    return F.regexp_extract_all(F.translate(text_or_empty(text), UPPER, LOWER), F.lit(WORD), F.lit(0))


def build(docs: DataFrame, only: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of ``docs``, of all their words or of those in ``only`` (column ``word``)."""
    if only is None:
        only = docs.select(F.explode(words(text_col)).alias("word"))
    terms = stored(only.select("word").distinct().withColumn("term", F.monotonically_increasing_id()), "phrase-terms")
    known = terms.unionByName(docs.sparkSession.range(1).select(F.lit(HEADER).alias("word"), F.lit(-1).cast("long").alias("term")))
    size = terms.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0)).alias("bytes")).first()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"),
                       F.concat(words(text_col), F.array(F.lit(HEADER))).alias("words"))
    if size["n"] <= BROADCAST_TERMS and size["bytes"] <= BROADCAST_BYTES:
        known = F.broadcast(known)
    else:
        rows = stored(rows, "phrase-words")   # row numbers are fixed before words move
    places = rows.select("row", "doc_id", F.posexplode("words").alias("place", "word")).join(known, "word")
    header = F.when(F.col("term") == -1, F.col("doc_id"))
    postings = places.select("term", "row", "place", header.alias("doc_id")).sortWithinPartitions("term", "row", "place")
    return Index(terms, stored(postings, "phrase-postings"))


@dataclass(frozen=True)
class Phrases:
    """``members`` (phrase, item) and ``words`` (phrase, length, offset, word)."""
    members: DataFrame
    words: DataFrame


def phrases(items: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> Phrases:
    """Every distinct window of ``window`` consecutive words (all of a shorter
    item's words), and the items that hold it."""
    found = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words(text_col).alias("w")).filter(F.size("w") > 0)
    length = F.least(F.lit(window), F.size("w"))
    starts = F.sequence(F.lit(1), F.size("w") - length + 1)
    cut = found.select("item", F.explode(F.transform(starts, lambda s: F.concat_ws(" ", F.slice("w", s, length)))).alias("text"))
    held = stored(cut.distinct(), "phrase-items")
    texts = stored(held.select("text").distinct().withColumn("phrase", F.monotonically_increasing_id()), "phrase-windows")
    w = F.split("text", " ")
    return Phrases(stored(held.join(texts, "text").select("phrase", "item"), "phrase-members"),
                   texts.select("phrase", F.size(w).alias("length"), F.posexplode(w).alias("offset", "word")))


def by_rarity(index: Index, wanted: Phrases) -> DataFrame:
    """(phrase, length, offset, term, turn): a phrase's terms from the rarest
    (turn 1) on; phrases with a term without postings are left out."""
    known = index.terms.join(index.frequencies(), "term")
    terms = wanted.words.join(known, "word")
    whole = Window.partitionBy("phrase")       # at most ``window`` rows
    turn = F.row_number().over(whole.orderBy("n", "offset"))
    out = terms.withColumns({"turn": turn, "__found": F.count(F.lit(1)).over(whole)}).filter(F.col("__found") == F.col("length"))
    return stored(out.select("phrase", "length", "offset", "term", "turn"), "phrase-order")


def _narrowed(begins: DataFrame, asked: DataFrame, index: Index, slop: int, name: str) -> DataFrame:
    """Of ``begins`` (phrase, row, start, distance) those whose phrase's
    ``asked`` terms all have a posting at start + offset, give or take ``slop``."""
    shifts = F.explode(F.array(*[F.lit(d) for d in range(-slop, slop + 1)]))
    need = asked.groupBy("phrase").agg(F.count(F.lit(1)).alias("need"))
    asks = (begins.join(_bounded(asked.join(need, "phrase")), "phrase").select("*", shifts.alias("shift"))
            .withColumn("place", F.col("start") + F.col("offset") + F.col("shift")))
    # only postings of asked terms in rows that are still in question move
    lists = (index.lists().join(_bounded(asked.select("term").distinct()), "term", "left_semi")
             .join(_bounded(begins.select("row").distinct()), "row", "left_semi"))
    met = asks.join(lists, ["row", "place", "term"])
    if slop:
        keys = ["phrase", "row", "start", "distance", "need"]
        met = met.groupBy(*keys, "offset").agg(F.min(F.abs("shift")).alias("shift"))
    whole = met.groupBy("phrase", "row", "start", "need").agg(
        F.count(F.lit(1)).alias("got"), F.max(F.greatest(F.col("distance"), F.abs("shift"))).alias("distance"))
    return stored(whole.filter(F.col("got") == F.col("need")).select("phrase", "row", "start", "distance"), name)


def matches(index: Index, wanted: Phrases, slop: int = 0) -> DataFrame:
    """(phrase, row, start, length, distance): every place where a phrase
    stands. ``start`` is where its rarest term says it begins; ``distance`` is
    how far the furthest term is from its exact place (0: the exact phrase)."""
    order = by_rarity(index, wanted)
    rarest = order.filter(F.col("turn") == 1).select("phrase", "term", "offset")
    begins = (index.lists().join(_bounded(rarest), "term").select("phrase", "row", (F.col("place") - F.col("offset")).alias("start"), F.lit(0).alias("distance")))
    if slop == 0:
        begins = begins.filter(F.col("start") >= 0)
    begins = stored(begins, "phrase-begins")
    lengths = order.filter(F.col("turn") == 1).select("phrase", "length")
    alone, longer = lengths.filter(F.col("length") == 1), lengths.filter(F.col("length") > 1)
    second = order.filter(F.col("turn") == 2).select("phrase", "term", "offset")
    left = _narrowed(begins, second, index, slop, "phrase-pairs")
    rest = order.filter(F.col("turn") > 2).select("phrase", "term", "offset")
    whole = _narrowed(left, rest, index, slop, "phrase-matches")
    pairs = left.join(longer.filter(F.col("length") == 2).select("phrase"), "phrase", "left_semi")
    single = begins.join(alone.select("phrase"), "phrase", "left_semi")
    return single.unionByName(pairs).unionByName(whole).join(_bounded(lengths), "phrase")


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit`` (words inside an exact
    match), ``n_items, items`` (ids of items with a match, sorted as strings)."""
    wanted = phrases(items, window, item_col, item_text)
    index = build(docs, wanted.words, id_col, text_col)
    found = matches(index, wanted)
    places = found.select("row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("place"))
    hit = stored(places.distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_hit")), "phrase-hits")
    held = found.select("row", "phrase").distinct().join(_bounded(wanted.members), "phrase").select("row", "item").distinct()
    named = stored(held.groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items")), "phrase-named")
    return (index.headers().join(hit, "row", "left").join(named, "row", "left")
            .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items")))


def oracle_sql(window: int = 10) -> str:
    """The query's rows in DuckDB: windows as strings, joined by length and text."""
    def folded(table: str) -> str:
        return (f"regexp_extract_all(translate(coalesce({table}.text, ''), '{UPPER}', '{LOWER}'), "
                "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {folded('documents')} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {folded('benchmark')} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, k, array_to_string(w[s:s + k - 1], ' ') AS p
  FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS s FROM (SELECT *, least({window}, len(w)) AS k FROM b WHERE len(w) > 0))),
dw AS (
  SELECT r, k, s, array_to_string(w[s:s + k - 1], ' ') AS p
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
m AS (SELECT r, s, k, item FROM dw JOIN bw USING (k, p)),
h AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS place FROM m) GROUP BY 1),
i AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)"""
