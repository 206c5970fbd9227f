"""Streams with state over several files, in and out of order, against plain loops."""

import collections
import os
import time

import pytest
from pyspark.sql import functions as F

from offerlake.streaming import stateful as st
from offerlake.streaming import usage as u

SF = "/root/testdata/sf0.001"
DAY = 86_400_000_000


@pytest.fixture(scope="module")
def events(spark):
    rows = spark.read.parquet(f"{SF}/events.parquet").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).orderBy("ts", "event_id").collect()
    assert len(rows) > 500
    return rows


def written(spark, tmp_path, parts):
    """A folder with one file for each part, whose times are in the parts' order."""
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    for k, part in enumerate(parts):
        spark.createDataFrame([tuple(r)[:6] for r in part], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
        new = max((os.path.join(tmp_path, "events.parquet", x) for x in os.listdir(f"{tmp_path}/events.parquet") if x.startswith("part")), key=os.path.getmtime)
        os.utime(new, (time.time() - 1000 + k, time.time() - 1000 + k))
    return u.events(spark, str(tmp_path), 1)


def quarters(rows):
    n = len(rows) // 4
    return [rows[:n], rows[n : 2 * n], rows[2 * n : 3 * n], rows[3 * n :]]


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def loops_latest(events, lifetime, late):
    mark = max(r.us for r in events) - late
    last = {r.user_id: r for r in events}
    return sorted((k, r.event_id, r.event_type) for k, r in last.items() if r.us + lifetime > mark)


def test_latest_ends_with_its_lifetime(spark, events, tmp_path):
    out = u.replay(st.latest_alive(written(spark, tmp_path, quarters(events)), 40_000), keys=["user_id"])
    expected = loops_latest(events, 40_000_000_000, 3_600_000_000)
    assert 0 < len(expected) < len({r.user_id for r in events})
    assert rows_of(out.where("live").drop("live")) == expected


def test_state_is_gone_after_its_time(spark, events, tmp_path):
    stream, check = written(spark, tmp_path, quarters(events)), f"{tmp_path}/check"
    with u.state_store(spark):
        query = st.latest_alive(stream, 40_000).writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", check).format("noop").start()
        query.awaitTermination()
    kept = spark.read.format("statestore").option("stateVarName", "latest").load(check).select("key.user_id").collect()
    assert sorted(r.user_id for r in kept) == [k for k, *_ in loops_latest(events, 40_000_000_000, 3_600_000_000)]


def loops_replay(order):
    history, out = collections.defaultdict(list), []
    for r in order:
        channel = r.user_id % 7
        if r.event_type == "signup":
            out += [(channel, r.event_id, e, n) for n, e in enumerate(history[channel][-20:][-10:], 1)]
        else:
            history[channel].append(r.event_id)
    return sorted(out)


@pytest.mark.parametrize("late_files", [False, True])
def test_histories(spark, events, tmp_path, late_files):
    parts = quarters(events)
    if late_files:  # a file that comes after a newer one is taken when it comes, as long as the watermark allows
        parts = [parts[0], parts[2], parts[1], parts[3]]
    stream = written(spark, tmp_path, parts)
    out = u.replay(st.replayed(stream, F.col("user_id") % 7, F.col("event_type") == "signup", late="60 days"), "append")
    assert rows_of(out) == loops_replay([r for part in parts for r in part])


def test_late_files_behind_the_watermark_are_dropped(spark, events, tmp_path):
    parts = quarters(events)
    out = u.replay(st.replayed(written(spark, tmp_path, [parts[1], parts[2], parts[0], parts[3]]), F.col("user_id") % 7, F.col("event_type") == "signup"), "append")
    # rows are late by the watermark that the batch before has used, which comes from the one before that
    mark = max(r.us for r in parts[1]) - 3_600_000_000
    assert max(r.us for r in parts[0]) < mark + 3_600_000_000
    assert rows_of(out) == loops_replay([*parts[1], *parts[2], *[r for r in parts[0] if r.us > mark], *parts[3]])


def loops_alerts(events, threshold, cooldown, per_day):
    spent, state, out = collections.Counter(), {}, []
    for r in events:
        org, day = r.user_id % 10, r.us // DAY
        spent[org, day] += round(abs(r.value) * 100)
        last, fired, active = state.get(org, (None, 0, True))
        if not active or spent[org, day] < threshold or last is not None and r.us - last < cooldown:
            continue
        fired = fired + 1 if last is not None and last // DAY == day else 1
        state[org] = (r.us, fired, fired < per_day)
        out.append((org, r.event_id, spent[org, day], fired < per_day))
    return sorted(out)


@pytest.mark.parametrize(("cooldown", "per_day"), [(3600, 3), (100_000, 3), (60, 100)])
def test_alerts_keep_their_cooldown_over_midnight(spark, events, tmp_path, cooldown, per_day):
    out = u.replay(st.budget_alerts(written(spark, tmp_path, quarters(events)), 2_000, cooldown, per_day), "append")
    expected = loops_alerts(events, 2_000, cooldown * 1_000_000, per_day)
    assert expected and rows_of(out) == expected


def loops_deliveries(events, retries, delay, most, hooks):
    out, waiting, state = [], collections.defaultdict(list), {}

    def attempt(hook, us, delivery, n, fails):
        failures, active = state.get(hook, (0, True))
        outcome = "success" if n > fails else "retry" if n <= retries else "failed"
        if outcome == "success":
            failures = 0
        elif outcome == "failed":
            failures += 1
            active = active and failures < most
        else:
            waiting[hook].append((us + delay * n, delivery, n + 1, fails))
        state[hook] = failures, active
        out.append((hook, delivery, n, us, outcome))

    def until(hook, us):
        while waiting[hook] and min(waiting[hook])[0] <= us:
            due = min(waiting[hook])
            waiting[hook].remove(due)
            attempt(hook, *due)

    for r in events:
        hook = r.user_id % hooks
        until(hook, r.us)
        if state.get(hook, (0, True))[1]:
            attempt(hook, r.us, r.event_id, 1, r.event_id % 6 if r.event_type == "error" else 0)
        else:
            out.append((hook, r.event_id, 0, r.us, "skipped"))
    for hook in range(hooks):
        until(hook, max(r.us for r in events) - 3_600_000_000)
    return sorted(out)


@pytest.mark.parametrize("most", [1, 3])
def test_deliveries(spark, events, tmp_path, most):
    fails = F.when(F.col("event_type") == "error", F.col("event_id") % 6).otherwise(0)
    out = u.replay(st.deliveries(written(spark, tmp_path, quarters(events)), F.col("user_id") % 5, fails, 2, 7_200, most), "append")
    expected = loops_deliveries(events, 2, 7_200_000_000, most, 5)
    assert {r[4] for r in expected} == {"success", "retry", "failed", "skipped"} or most == 3
    assert rows_of(out) == expected
