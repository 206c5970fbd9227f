"""Stored tables that streams add to: batches that are repeated, and intervals that are run again."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from offerlake.streaming import upsert as up
from offerlake.streaming import usage as u

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.startswith("part")}


def rows(df):
    return sorted(map(str, df.collect()))


def test_batches_add_up_and_a_repeated_one_changes_nothing(spark, events, tmp_path):
    path = f"{tmp_path}/table"
    parts = [events.where(F.col("event_id") % 3 == k) for k in range(3)]
    for number, part in enumerate(parts):
        up.upsert(part, number, path)
    whole = rows(up.usage(events))
    assert rows(up.current(spark, path)) == whole
    before = rows(up.current(spark, path))
    up.upsert(parts[2], 2, path)
    assert rows(up.current(spark, path)) == before == whole
    # what was written for one day alone leaves the others' files
    kept = files(path)
    up.upsert(events.where("to_date(ts) = date'2024-01-05'"), 3, path)
    assert set(files(path)) - set(kept) and all("2024-01-05" in f for f in set(files(path)) - set(kept)) and set(kept) <= set(files(path))


def test_running_mean_equals_the_mean_of_all(spark, events, tmp_path):
    path = f"{tmp_path}/table"
    for number in range(2):
        up.upsert(events.where(F.col("event_id") % 2 == number), number, path)
    made = {tuple(r[k] for k in up.KEYS): r.average_confidence for r in up.with_mean(up.current(spark, path)).collect()}
    sums = {}
    for r in events.collect():
        key = (r.user_id % 10, r.event_id % 5, r.ts.date(), r.ts.hour)
        n, total = sums.get(key, (0, 0.0))
        sums[key] = (n + (r.event_id % 7 > 0), total + (r.event_id % 100 / 100 if r.event_id % 7 else 0))
    assert set(made) == set(sums)
    assert all(made[k] == pytest.approx(total / n) if n else made[k] is None for k, (n, total) in sums.items())


def test_rollups_run_again(spark, events, tmp_path):
    path = f"{tmp_path}/usage"
    up.roll_up(events, events, 3_600, path)
    before, kept = rows(spark.read.parquet(path)), files(path)
    up.roll_up(events, events.where("to_date(ts) = date'2024-01-07'"), 3_600, path)
    assert rows(spark.read.parquet(path)) == before
    day = 19_729 * 86_400
    changed = {f for f in set(files(path)) | set(kept) if files(path).get(f) != kept.get(f)}
    assert changed and all(f"day={day}/" in f for f in changed)


def test_schedules_over_one_stream(spark, events, tmp_path):
    folder = f"{tmp_path}/in"
    os.makedirs(f"{folder}/events.parquet")
    for k in range(3):  # a day's events come in several files
        spark.read.parquet(f"{SF}/events.parquet").where(F.col("event_id") % 3 == k).coalesce(1).write.parquet(f"{tmp_path}/part{k}")
        (name,) = [f for f in os.listdir(f"{tmp_path}/part{k}") if f.startswith("part")]
        shutil.copy(f"{tmp_path}/part{k}/{name}", f"{folder}/events.parquet/{k}.parquet")
    source = spark.read.parquet(f"{folder}/events.parquet")
    for query in up.scheduled(u.events(spark, folder, 1), source, f"{tmp_path}/out", {"usage": 3_600, "cleanup": 86_400}, once=True):
        query.awaitTermination()
    for job, seconds in (("usage", 3_600), ("cleanup", 86_400)):
        made = spark.read.parquet(f"{tmp_path}/out/{job}")
        assert made.agg(F.sum("requests")).first()[0] == events.count() and made.where(F.col("start") % seconds != 0).count() == 0
        assert made.groupBy("start", "organization_id").count().where("count > 1").count() == 0
