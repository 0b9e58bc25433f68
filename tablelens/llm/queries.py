"""The operators' registered queries (whole tables, production parameters) and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm import bloom_dedup, cover_tree, fill_in_middle, fm_index, histogram_shards, importance_resampling, kneser_ney
from tablelens.llm import license_rules, markov_secrets, packing, phrase_index, piece_trie, simhash
from tablelens.llm.common import read, text_or_empty

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


#: place of the public tokenizers' files; ``public_tokenizers.path`` unless set
TOKENIZERS: dict[str, str] = {}


def tokenizer_path(name: str) -> str:
    if name not in TOKENIZERS:
        import public_tokenizers

        return public_tokenizers.path(name)
    return TOKENIZERS[name]


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@register("op1_histogram_shards")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents dealt to 8 shards of near equal bytes by histogram sort."""
    text = text_or_empty("text")
    docs = read(spark, sf_dir, "documents")
    cut = histogram_shards.histogram_shards(docs, 8, payload=[
        F.col("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")])
    return cut.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


@register("op2_cover_tree_top_k", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.vec, c.vec), lambda z: CAST(z[1] AS HUGEINT) * z[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s)
SELECT query_id, CAST(rn AS INTEGER) AS "rank", vec_id, score FROM r WHERE rn <= 5""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best by inner product for every 50th embedding, against all others."""
    return cover_tree.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


@register("op3_license_rules", license_rules.oracle_sql())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named by the sentences of every document."""
    out = license_rules.scan_licenses(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size("sentence_ids").alias("n_sentences"),
                      *[F.concat_ws(",", c).alias(c) for c in ("sentence_ids", "licenses", "unmatched")])


@register("op4_piece_trie")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents encoded to SentencePiece ids and decoded again."""
    return piece_trie.round_trip(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@register("op5_best_fit_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents packed into sequences of at most 2048 tokens by vector best-fit."""
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), packing.Capacity(tokens=2048))


@register("op6_fm_index_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents without the words of 20-word windows that also start earlier."""
    return fm_index.remove_repeats(read(spark, sf_dir, "documents"), window=20, digest=True)


@register("op7_simhash_pigeonhole")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among documents: SimHash of 4-word shingles, links at 4 or fewer bits."""
    out = simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=4, distance=4)
    return out.select("doc_id", simhash.hexed("fp").alias("fingerprint"), "component_id")


@register("op8_markov_secrets")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: base rules, and tokens the Markov models call random."""
    m = markov_secrets
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = m.train(m.labelled_sample(docs, read(spark, sf_dir, "labels")))
    found = m.find_secrets(docs, model)
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(m.spans_text(m.base_only(F.col("secret_spans"))), 256).alias("base_sha256"),
                        m.spans_text(F.col("secret_spans")).alias("spans"))


@register("op9_kneser_ney_quality")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under its language's model, and whether it is kept."""
    out = kneser_ney.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "lang", "n_chars", F.round("perplexity", 5).alias("perplexity"),
                      F.round("threshold", 5).alias("threshold"), "kept")


@register("op10_bloom_dedup", """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies among documents; of equal texts the largest doc_id stays."""
    return bloom_dedup.duplicate_groups(read(spark, sf_dir, "documents"))


@register("op11_positional_index", phrase_index.oracle_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with words inside a 10-word window of benchmark, found through a positional index."""
    out = phrase_index.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                      (F.col("n_hit") > 0).alias("contaminated"))


@register("op12_regex_fill_in_middle", fill_in_middle.oracle_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents cut into prefix, middle and suffix and put in another order, and back."""
    out = fill_in_middle.digests(fill_in_middle.fill_in_middle(read(spark, sf_dir, "documents").select("doc_id", "text")))
    return out.select("doc_id", F.col("fim_units").alias("n"), F.col("fim_form").alias("form"),
                      F.col("fim_prefix_chars").alias("prefix_chars"), F.col("fim_middle_chars").alias("middle_chars"),
                      "output_sha256", "restored_sha256")


@register("op13_overlapped_resampling", importance_resampling.oracle_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents drawn towards the n-gram distribution of benchmark."""
    return importance_resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
