"""The operators applied to whole tables, in the shape that each one's contract names."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, imatch, language_model, near_duplicates, oracles, prefix_trie, secret_scan, sharding, suffix_dedup, token_counts, toxicity, url_filter, whitening
from .common import shared_dir, table

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
SHARDS = 40
TOKEN_LIMIT = 512


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    host, path = url_filter.host_and_path(F.col("url"))
    urls = pages.select("url", host.alias("host"), path.alias("path"))
    model = url_filter.train(url_filter.weak_labels(urls))
    return url_filter.judge(pages, RULES, model)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = model.score(docs)
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN, decoded=True)
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return imatch.compare_with_edits(docs, imatch.lexicon(docs))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own, so that every run encodes all distinct texts."""
    cache = f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}"
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cache)
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_bytes, kept = F.col("passages.n_bytes"), F.col("passages.kept")
    return found.select(
        "doc_id",
        n_bytes.alias("n_bytes"),
        (n_bytes - F.octet_length(kept)).alias("n_removed"),
        F.size("passages.spans").cast("long").alias("n_spans"),
        F.sha2(kept, 256).alias("kept_sha256"),
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = language_model.train(docs.where(~language_model.held_out(F.col("doc_id"))))
    return model.score(docs).select(
        "doc_id", language_model.held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score"
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: whether it overlaps a benchmark item, the items, and where."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("leaks") > 0).alias("contaminated"), F.array_sort(F.array_distinct("leaks.item_id")).alias("item_ids"), "leaks")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    model = whitening.fit(embeddings)
    rows = model.transform(embeddings).select("vec_id", F.expr("try_cast(deviation AS bigint)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    explained = F.array(*map(F.lit, model.explained)).cast("array<double>")
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, "at").alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"),
    )


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's source is its owner; what the source has in one language is a repository."""
    repository = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"), F.col("source"), repository)


QUERIES = {
    f.__name__: f
    for f in (op1_url_filter, op2_toxicity, op3_byte_bpe, op4_imatch, op5_near_duplicates, op6_token_counts, op7_suffix_dedup, op8_sharding, op9_language_model, op10_decontamination, op11_prefix_trie, op12_whitening, op13_secret_scan)
}

ORACLE_SQL = oracles.ORACLE_SQL
