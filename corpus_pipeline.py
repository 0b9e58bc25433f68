"""From raw documents to packed training sequences.

Five stages, each calling one operator and working on all that the stage
before it kept: the quality classifier drops documents it rejects, exact
copies and near copies are reduced to one document each, secrets are replaced
by a mark in the text, and what is left is packed into sequences.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes it as Parquet in the shared folder and reads it back for the next one.
A stage keeps the columns of ``documents``; the last returns packed pieces.
Nulls, empty texts, repeated rows and empty tables are handled as each
operator's docstring says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm import bloom_dedup, kneser_ney, markov_secrets, packing, simhash
from tablelens.llm.common import read, stored
from tablelens.llm.queries import ORACLE, QUERIES, tokenizer_path

TOKENS = 2048
SHINGLE, DISTANCE = 4, 4


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the Kneser-Ney classifier keeps (9)."""
    return kneser_ney.keep_good(docs, read(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id (10)."""
    return bloom_dedup.drop_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies the document with the smallest id (7)."""
    return simhash.keep_one(docs, SHINGLE, DISTANCE)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark and ``n_chars`` counted anew (8)."""
    m = markov_secrets
    model = m.train(m.labelled_sample(docs, read(spark, sf_dir, "labels")))
    found = m.redact(m.find_secrets(docs, model))
    changed = F.size("secret_spans") > 0
    return found.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and place (5)."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), packing.Capacity(tokens=TOKENS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("secret_scans", secrets),
    ("best_fit_packing", packed),
]

#: The language model, the components and the packing plan are beyond SQL; the tests hold every stage against a plain version (the classifier against its own verdicts).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw documents through all stages: packed pieces."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


QUERIES["pipeline"] = run
if ORACLE_SQL:
    ORACLE["pipeline"] = ORACLE_SQL
