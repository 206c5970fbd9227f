"""Usage kept by organization, provider, day and hour in a stored table that each micro-batch adds to, and rollups on schedules."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import exists

KEYS = ("organization_id", "provider_id", "usage_date", "usage_hour")
SUMS = ("requests", "tokens", "confidence_sum", "confidences")


def usage(events: DataFrame) -> DataFrame:
    """What a batch of events adds: KEYS and SUMS. A mean is kept as its sum and count, which add up in any order; events
    without a confidence have no part in it. Null keys are a key of their own."""
    parts = events.select(
        (F.col("user_id") % 10).alias("organization_id"), (F.col("event_id") % 5).alias("provider_id"), F.to_date("ts").alias("usage_date"), F.hour("ts").cast("long").alias("usage_hour"),
        F.get_json_object("props", "$.k").cast("long").alias("tokens"), F.when(F.col("event_id") % 7 > 0, (F.col("event_id") % 100).cast("decimal(10,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(10,2)").alias("confidence"),
    )
    return parts.groupBy(*KEYS).agg(
        F.count("*").alias("requests"), F.sum("tokens").alias("tokens"), F.sum("confidence").cast("decimal(20,2)").alias("confidence_sum"), F.count("confidence").alias("confidences")
    )


def current(spark: SparkSession, path: str, below: int | None = None) -> DataFrame:
    """The table's rows: for each day those of its last batch (before `below`, if it is given)."""
    rows = spark.read.option("basePath", path).parquet(path)
    rows = rows if below is None else rows.where(F.col("batch") < below)
    last = rows.groupBy("usage_date").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["usage_date", "batch"]).select(*KEYS, *SUMS)


def upsert(batch: DataFrame, number: int, path: str) -> None:
    """Adds a micro-batch to the table at path (for foreachBatch).

    Only the days that the batch touches are written, each as a whole, into a partition of its day and the batch's number. It
    starts from what earlier batches left, so a batch that is repeated after a failure replaces its own partitions and nothing
    counts twice; other days' files stay as they are.
    """
    spark, added = batch.sparkSession, usage(batch)
    rows = added
    if exists(spark, path):
        before = current(spark, path, below=number)
        rows = added.unionByName(before.join(added.select("usage_date").distinct(), "usage_date", "left_semi"))
    whole = rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS]).withColumn("confidence_sum", F.col("confidence_sum").cast("decimal(20,2)"))
    whole = whole.repartition("usage_date").withColumn("batch", F.lit(number).cast("long"))
    whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("usage_date", "batch").parquet(path)


def with_mean(rows: DataFrame) -> DataFrame:
    """average_confidence in place of its sum and count; null where no event had one."""
    mean = F.when(F.col("confidences") > 0, F.col("confidence_sum").cast("double") / F.col("confidences").cast("double"))
    return rows.withColumn("average_confidence", mean).drop("confidence_sum", "confidences")


# schedules
#: Seconds between the runs of each job.
SCHEDULES = {"budgets": 900, "usage": 3_600, "cleanup": 86_400}


def interval(ts: Column, seconds: int) -> Column:
    """Where the interval of a time begins, in seconds since 1970."""
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / seconds) * seconds


#: Rollups are stored by day: intervals are a day long at most, and a partition for each quarter of an hour would be a file each.
DAY = 86_400


def roll_up(events: DataFrame, times: DataFrame, seconds: int, path: str) -> None:
    """Computes the intervals of the days that times (ts) lie in anew, from all events of these days, and overwrites the days'
    partitions at path, and no others; a day that is run again is the same afterwards, and late events are in."""
    day, start = interval(F.col("ts"), DAY).alias("day"), interval(F.col("ts"), seconds).alias("start")
    own = events.select("*", day, start).join(times.select(day).distinct(), "day", "left_semi")
    by = own.groupBy("day", "start", (F.col("user_id") % 10).alias("organization_id"))
    made = by.agg(F.count("*").alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("tokens"))
    made.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def scheduled(stream: DataFrame, source: DataFrame, path: str, jobs: dict[str, int] | None = None, once: bool = False) -> list[StreamingQuery]:
    """Starts a query for each job over one stream, each at its own trigger (or for what there is, once), into path/job.

    A micro-batch only says which days have new events; these are rolled up from the source, which holds all that the stream has
    read."""

    def touched(batch: DataFrame, number: int, seconds: int, to: str) -> None:
        roll_up(source, batch, seconds, to)

    queries = []
    for name, seconds in (jobs or SCHEDULES).items():
        writer = stream.writeStream.foreachBatch(partial(touched, seconds=seconds, to=f"{path}/{name}")).option("checkpointLocation", f"{path}/_{name}")
        queries.append((writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start())
    return queries
