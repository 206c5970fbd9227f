"""Event streams: hourly usage, latest progress, rate windows from a key's first event; counters and retention."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.shared import new_folder


#: Files that a micro-batch reads, which bounds what one of a key's groups brings to a task. Files are in order of time.
FILES = 8


def events(spark: SparkSession, sf_dir: str, files: int = FILES) -> DataFrame:
    """The events as a file stream, the oldest file first. Their times have no zone; watermarks need one, so they are read as
    UTC. Rows behind an operator's watermark are lost to it: files must be in order of time, as far as its `late` does not
    cover them."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/events.parque[t]")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB, which operators with several kinds of state and timers need."""
    name, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, store)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def replay(stream: DataFrame, mode: str = "update", keys: list[str] | None = None) -> DataFrame:
    """All that a stream gives on what is there now, as a table: by key the row of the last batch, if there are keys.
    Batches go to Parquet under their number, so that a batch that is repeated after a failure replaces itself."""
    spark = stream.sparkSession
    folder = new_folder(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    with state_store(spark):
        query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").foreachBatch(keep).start()
        query.awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    if keys:
        last = Window.partitionBy(*keys).orderBy(F.desc("batch"))
        out = out.withColumn("_nth", F.row_number().over(last)).where("_nth = 1").drop("_nth")
    return out.drop("batch")


def usage_by_hour(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Requests and tokens by organization and hour; events later than the watermark are left out."""
    hour = F.window("ts", "1 hour")
    tokens = F.get_json_object("props", "$.k").cast("long")
    by = stream.withWatermark("ts", late).groupBy(hour, (F.col("user_id") % 10).alias("organization_id"))
    return by.agg(F.count("*").alias("requests"), F.sum(tokens).alias("tokens")).select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "organization_id", "requests", "tokens")


def latest(stream: DataFrame) -> DataFrame:
    """The last event of each user."""
    return stream.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


def progress(status: Column, page: Column, pages: Column) -> Column:
    """How far a document is: pages count from 35 to 80 percent."""
    fixed = {"uploaded": 0.0, "processing": 0.1, "extracting": 0.35, "validating": 0.85, "completed": 1.0, "failed": -1.0}
    out = F.when(page.isNotNull(), 0.35 + page / pages * 0.45)
    for name, value in fixed.items():
        out = out.when(status == name, value)
    return out


def _until(state: GroupState, seconds: float) -> None:
    """The state goes when the watermark passes the time."""
    state.setTimeoutTimestamp(max(int(seconds * 1000), state.getCurrentWatermarkMs()) + 1)


def rate_windows(stream: DataFrame, seconds: int, limit: int, late: str = "1 hour") -> DataFrame:
    """(user_id, event_id, nth, allowed): the count in a window that opens with a user's first event and lasts `seconds`;
    the next event after it opens another. Events of a batch are taken in order of time. State ends with its window, once
    the watermark (`late` behind the latest event) has passed it."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        opened, n = state.get if state.exists else (None, 0)
        rows = pd.concat([b[["ts", "event_id"]] for b in batches]).sort_values(["ts", "event_id"])
        counts = []
        for now in rows["ts"].map(pd.Timestamp.timestamp):
            if opened is None or now >= opened + seconds:
                opened, n = now, 0
            n += 1
            counts.append(n)
        state.update((opened, n))
        _until(state, opened + seconds)
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"].to_numpy(), "nth": counts, "allowed": [c <= limit for c in counts]})

    timed = stream.select("user_id", "event_id", "ts").withWatermark("ts", late)
    return timed.groupBy("user_id").applyInPandasWithState(run, "user_id long, event_id long, nth long, allowed boolean", "opened double, n long", "append", GroupStateTimeout.EventTimeTimeout)


def live_latest(latest_rows: DataFrame, seconds: int, as_of: Column) -> DataFrame:
    """The latest rows that are not older than their lifetime."""
    return latest_rows.where(F.col("ts") >= as_of - F.make_interval(secs=F.lit(seconds)))


def disabled_hooks(deliveries: DataFrame, most: int) -> DataFrame:
    """(hook, at): hooks with `most` failures one after the other, and the delivery that switched them off; a success starts
    the count anew."""
    order = Window.partitionBy("hook").orderBy("created_at", "id")
    runs = deliveries.withColumn("run", F.sum(F.when(F.col("status") == "success", 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    nth = F.row_number().over(Window.partitionBy("hook", "run").orderBy("created_at", "id"))
    failed = runs.where(F.col("status") != "success").withColumn("nth", nth).where(F.col("nth") == most)
    return failed.groupBy("hook").agg(F.min_by("id", F.struct("created_at", "id")).alias("at"))


def provider_counters(audit: DataFrame, as_of: str) -> DataFrame:
    """By provider what was spent in the month and day, and requested in the hour, that hold as_of: what counters with lazy
    resets would show then."""
    now = F.lit(as_of).cast("timestamp_ntz")
    inside = lambda unit: F.date_trunc(unit, "created_at") == F.date_trunc(unit, now)
    past = audit.where((F.col("created_at") <= now) & inside("month"))
    return past.groupBy("provider_id").agg(F.sum("cost").alias("month_spent"), F.coalesce(F.sum(F.when(inside("day"), F.col("cost"))), F.lit(0)).cast("decimal(28,4)").alias("day_spent"), F.count_if(inside("hour")).alias("hour_requests"))


def budget_states(providers: DataFrame, counters: DataFrame) -> DataFrame:
    """Providers with their counters and whether each limit still holds; a null budget is no limit, and no events are 0."""
    both = providers.join(counters, "provider_id", "left").fillna(0, ["month_spent", "day_spent", "hour_requests"])
    under = lambda spent, budget: F.coalesce(F.col(spent) < F.col(budget), F.lit(True))
    return both.withColumns({"month_ok": under("month_spent", "monthly_budget"), "day_ok": under("day_spent", "daily_budget"), "hour_ok": F.col("hour_requests") < F.col("max_requests_per_hour")}).withColumn("ok", F.expr("month_ok and day_ok and hour_ok"))


def cost_spikes(audit: DataFrame) -> DataFrame:
    """Days that cost over twice the mean day's, high over three times; none before there are three days."""
    by = audit.groupBy("usage_date").agg(F.sum("cost").alias("cost"))
    whole = by.agg((F.sum("cost").cast("double") / F.count("*").cast("double")).alias("mean"), F.count("*").alias("days"))  # one row
    found = by.join(F.broadcast(whole)).where((F.col("days") >= 3) & (F.col("cost").cast("double") > 2 * F.col("mean")))
    return found.select("usage_date", "cost", F.when(F.col("cost").cast("double") > 3 * F.col("mean"), "high").otherwise("medium").alias("severity"))


def within_quota(audit: DataFrame, limit: int, *by: str) -> DataFrame:
    """Events up to the limit by key, in order of time; 0 is no limit."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy("created_at", "id"))
    return audit if limit == 0 else audit.withColumn("_nth", nth).where(F.col("_nth") <= limit).drop("_nth")


def error_hours(audit: DataFrame, least: int, share: float) -> DataFrame:
    """Hours with more than `least` events of which more than `share` are errors, high where more than half are."""
    by = audit.groupBy("usage_date", "usage_hour").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "error").alias("errors"))
    found = by.where((F.col("n") > least) & (F.col("errors") > share * F.col("n")))
    return found.withColumn("severity", F.when(F.col("errors") > 0.5 * F.col("n"), "high").otherwise("medium"))


def retry_delays(attempts: Column, base: int) -> Column:
    """Seconds until each further attempt of a delivery: base times its number."""
    return F.transform(F.sequence(F.lit(1), attempts), lambda k: k * base)


def kept(df: DataFrame, stamp: str, as_of: str, days: int, keep_errors: bool = False) -> DataFrame:
    """Rows that retention leaves: the last `days`, and errors for good if asked."""
    recent = F.col(stamp) >= F.date_sub(F.to_date(F.lit(as_of)), days)
    return df.where(recent | (F.col("status") == "error") if keep_errors else recent)
