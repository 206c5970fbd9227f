"""What the operators share: reading tables, a shared folder for intermediate results, texts in Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as empty; other columns, whatever their names, are left behind."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session of one machine (tests) may leave it
    unset and gets a temporary one; a cluster's executors would not see that, so there it is an error."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="offerlake-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame, name: str = "rows") -> DataFrame:
    """df from a written table in the shared folder, so that a lost executor costs a read and not the lineage. Its size is
    known afterwards: iterations whose plans only carry estimates multiply these without end. The tables live as long
    as the folder, as checkpoints do."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def freed(*caches: dict) -> Iterator[None]:
    """What a task has remembered goes when it ends, and back to the system: Python workers live on, and the next stage
    needs the room."""
    try:
        yield
    finally:
        for cache in caches:
            cache.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # a C library without it
            ctypes.CDLL(None).malloc_trim(0)


def one_core() -> None:
    """Matrix products keep to the one core that a task has: threads beyond it only wait for one another, at full load."""
    with suppress(OSError):
        with open("/proc/self/maps") as f:
            paths = set(re.findall(r"/\S*openblas\S*\.so\S*", f.read()))
        for path in paths:
            for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
                if call := getattr(ctypes.CDLL(path), name, None):
                    call(1)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of text at most (single rows may be longer)."""
    for batch in batches:
        step = max(1, min(batch.num_rows, int(batch.num_rows * limit / max(1, batch.column(column).nbytes))))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)
