"""The corpus pipeline: toxic documents go, one of each near-duplicate class stays, repeated passages go, documents
that leak benchmark items go, and what is left is encoded. Each stage takes (spark, docs, sf_dir) and works on all that
the one before kept; its result is written as Parquet and read again by the next."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from offerlake.llm import bpe, decontamination, near_duplicates, suffix_dedup, toxicity
from offerlake.llm.common import shared_dir, stored, table

#: Documents of this toxicity or more are rejected.
TOXIC = 0.3
#: A column that a stage adds; no table has it.
KEY = "_near_duplicates_key"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score below TOXIC, by a model of the labels whose ids' checksums leave 0, 1 or 3 of 4.

    Each row is judged by its text alone: null and empty texts have the score of a text without words, equal texts go or
    stay together, rows without id are judged like others but not learned from, and other columns are kept."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out))
    return model.score(docs).where(F.col("toxicity") < TOXIC).select(*[f"`{c}`" for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of each class that has the smallest id.

    Of rows of one id the text with the smallest SHA-256 counts, and one row of that text stays (by a hash of its other columns, so
    that two runs agree). A row without id takes part under a number that its text gives it, above 2**62 and so behind all other ids:
    it goes if its text is a copy or near copy of another document, else one row of its text stays, without an id. Null texts
    are empty; empty texts are copies of one another; other columns are kept as they are.
    """
    text = F.coalesce("text", F.lit(""))
    behind = F.xxhash64(text).bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62)
    keyed = docs.withColumn(KEY, F.coalesce(F.col("doc_id").cast("long"), behind))
    digests = keyed.groupBy(KEY).agg(F.min(F.sha2(text, 256)).alias(f"{KEY}_text"), F.count("*").alias("n"))
    repeated = stored(digests.where("n > 1").select(KEY, f"{KEY}_text"), "repeated-ids")
    own = keyed
    if repeated.head(1):
        own = keyed.join(repeated, KEY, "left").where(F.col(f"{KEY}_text").isNull() | (F.col(f"{KEY}_text") == F.sha2(text, 256))).drop(f"{KEY}_text")
    classes = near_duplicates.near_duplicates(own.select(F.col(KEY).alias("doc_id"), "text"))
    named = classes.where("doc_id = class_id").select(F.col("doc_id").alias(KEY)).distinct()
    kept = own.join(named, KEY, "left_semi")
    if repeated.head(1):
        order = Window.partitionBy(KEY).orderBy(F.xxhash64(*[f"`{c}`" for c in docs.columns]))
        kept = kept.withColumn(f"{KEY}_nth", F.row_number().over(order)).where(F.col(f"{KEY}_nth") == 1)
    return kept.select(*[f"`{c}`" for c in docs.columns])


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur earlier; those of which nothing but white space is left go. Characters
    that a cut splits are dropped, and n_chars counts what stays."""
    cut = suffix_dedup.remove_repeats(docs)
    whole = F.size("passages.spans") == 0
    valid = F.make_valid_utf8(F.col("passages.kept").cast("string"))
    text = F.when(whole, F.col("text")).otherwise(F.when(F.contains("text", F.lit("�")), valid).otherwise(F.replace(valid, F.lit("�"), F.lit(""))))
    out = cut.where(whole | (F.length(F.trim(F.regexp_replace(text, r"\s+", " "))) > 0)).withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*[f"`{c}`" for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that overlap no benchmark item. Null and empty texts overlap none; equal texts go or stay together, with an id
    or without; other columns are kept. Without benchmark items all stay."""
    found = decontamination.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("leaks") == 0).select(*[f"`{c}`" for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens) of every document: a row for each row, those without id and repeated ones too; null and empty texts
    have no ids. Other columns go."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", cut_passages),
    ("decontamination", drop_leaks),
    ("encode", encode),
]

#: Trained trees, suffix arrays and byte-level BPE have no SQL form; tests compare two stages with
#: `op5` and `op10`, which have tests against brute force of their own; toxicity and encode are not compared here.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over documents."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
