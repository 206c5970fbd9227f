"""Token counts behind a cache keyed by digests of content and tokenizer."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed, slices, stored, texts

CACHE = "content_digest binary, tokenizer_digest string, n_tokens long"


@lru_cache(2)
def _tokenizer(path: str):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda batch: [len(x) for x in model.encode(batch, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda batch: [len(x) for x in model.encode_batch_fast(batch, add_special_tokens=False)]


def tokenizer_digest(path: str) -> str:
    """A tokenizer's version: the digest of its file and of the library that reads it."""
    import sentencepiece
    import tokenizers

    with open(path, "rb") as f:
        digest = hashlib.file_digest(f, "sha256")
    digest.update((sentencepiece if path.endswith(".model") else tokenizers).__version__.encode())
    return digest.hexdigest()


def _stored(docs: DataFrame, cache: str, version: str) -> DataFrame:
    spark = docs.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    begun = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    known = spark.read.schema(CACHE).parquet(cache) if begun else spark.createDataFrame([], CACHE)
    return known.where(F.col("tokenizer_digest") == version).select("content_digest", "n_tokens")


def count_tokens(docs: DataFrame, tokenizer: str, cache: str) -> DataFrame:
    """One row (doc_id, n_bytes, n_tokens) for each row of docs (doc_id, text).

    tokenizer: a file that every executor has (.json: tokenizers, .model: sentencepiece). cache: a folder in storage
    that all executors share, which is read first and then appended to, under the digests of content and tokenizer.
    The normalised content is the text in UTF-8 with null as empty, and no more: a tokenizer's own normalising belongs to its
    version, and any other (of case, spaces or Unicode) could change the count. Only digests are shuffled to look them up;
    the texts of misses follow, one for each, by digest and id, so that copies of one text are spread: where the misses' digests
    are few enough to be sent to all tasks nothing else moves, else all texts are shuffled to meet them. Null texts count as empty; empty texts have no tokens;
    repeated rows each get a row; other columns are ignored; an empty table gives an empty one. If a run is lost
    between its append and its result, the next finds the counts there; if two runs append the same, either's holds.
    """
    version = tokenizer_digest(tokenizer)
    one = F.coalesce("doc_id", F.lit(-(1 << 63)))
    own = texts(docs).withColumn("content_digest", F.unhex(F.sha2("text", 256))).withColumn("one", one)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _tokenizer(tokenizer)
        with freed():
            for batch in slices(batches, limit=4 << 20):
                n = count(batch.column("text").to_pylist())
                yield pa.record_batch([batch.column("content_digest"), pa.array(n, pa.int64())], ["content_digest", "n_tokens"])

    # digests move first; of each that the cache lacks, the row of the smallest id is the one to encode
    wanted = own.groupBy("content_digest").agg(F.min("one").alias("one"))
    missing = stored(wanted.join(_stored(docs, cache, version).distinct(), "content_digest", "left_anti"), "token-misses")
    (
        own.select("content_digest", "one", "text")
        .join(missing, ["content_digest", "one"], "left_semi")
        .dropDuplicates(["content_digest", "one"])
        .mapInArrow(run, "content_digest binary, n_tokens long")
        .select("content_digest", F.lit(version).alias("tokenizer_digest"), "n_tokens")
        .write.mode("append")
        .parquet(cache)
    )
    # stored, so that the join after it has nothing but its two shuffles in a stage, and a hot digest can be split
    counts = stored(_stored(docs, cache, version).groupBy("content_digest").agg(F.min("n_tokens").alias("n_tokens")), "token-counts")
    sizes = own.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "content_digest")
    return sizes.join(counts, "content_digest").select("doc_id", "n_bytes", "n_tokens")
