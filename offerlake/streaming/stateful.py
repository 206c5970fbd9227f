"""Streams with state of several kinds and timers in event time: latest events with a lifetime, replayed histories, budget alerts,
deliveries with retries.

Rows of a key in one batch are taken in order of time. Rows that come in a later batch than newer ones are taken when they come.
Rows behind the watermark (`late` behind the latest event of the batches before) are lost: a table that was written out of order needs a
`late` that covers it, or must be sorted by time into its files.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY = 86_400_000_000


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A key's rows of one batch; a batch reads a bounded number of files."""
    return pd.concat(list(rows)).sort_values(["us", "event_id"])


def _timed(stream: DataFrame, late: str, *columns: Column) -> DataFrame:
    """The columns, and the time in microseconds as us, with a watermark on ts."""
    return stream.select("ts", F.unix_micros("ts").alias("us"), "event_id", *columns).withWatermark("ts", late)


def _timer(us: int) -> int:
    """The first millisecond that is later than a time in microseconds."""
    return us // 1000 + 1


class _Latest(StatefulProcessor):
    def __init__(self, lifetime: int):
        self.lifetime = lifetime

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("latest", "us long, event_id long, event_type string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        best = before = self.state.get()
        for part in rows:
            row = max(part[["us", "event_id", "event_type"]].itertuples(index=False, name=None))
            best = row if best is None or row[:2] > tuple(best)[:2] else best
        if best is before:
            return
        if before is not None:
            self.handle.deleteTimer(_timer(before[0] + self.lifetime))
        best = (int(best[0]), int(best[1]), best[2])
        self.state.update(best)
        self.handle.registerTimer(_timer(best[0] + self.lifetime))
        yield pd.DataFrame({"user_id": [key[0]], "event_id": [best[1]], "event_type": [best[2]], "live": [True]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ended = self.state.get()
        self.state.clear()
        yield pd.DataFrame({"user_id": [key[0]], "event_id": [ended[1]], "event_type": [ended[2]], "live": [False]})

    def close(self) -> None:
        pass


def latest_alive(stream: DataFrame, lifetime: int, late: str = "1 hour") -> DataFrame:
    """(user_id, event_id, event_type, live): each user's latest event whenever it changes, and once more, not live, when the
    watermark is `lifetime` seconds past it; its state ends then. Run it in update mode."""
    keyed = _timed(stream, late, F.col("user_id"), F.col("event_type")).groupBy("user_id")
    return keyed.transformWithStateInPandas(_Latest(lifetime * 1_000_000), "user_id long, event_id long, event_type string, live boolean", "Update", "EventTime")


class _Replay(StatefulProcessor):
    def __init__(self, kept: int, sent: int):
        self.kept, self.sent = kept, sent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.history = handle.getListState("history", "event_id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        history, out = deque((x[0] for x in self.history.get()), self.kept), []
        for event_id, joins in _in_order(rows)[["event_id", "joins"]].itertuples(index=False, name=None):
            if joins:
                out += [(key[0], event_id, sent, nth) for nth, sent in enumerate(list(history)[-self.sent :], 1)]
            else:
                history.append(int(event_id))
        if history:
            self.history.put([(x,) for x in history])
        yield pd.DataFrame(out, columns=["channel", "join_id", "event_id", "nth"])

    def close(self) -> None:
        pass


def replayed(stream: DataFrame, channel: Column, joins: Column, kept: int = 20, sent: int = 10, late: str = "1 hour") -> DataFrame:
    """(channel, join_id, event_id, nth): to each that joins a channel its last `sent` events, the oldest first. A channel's
    state is a list of its last `kept` events."""
    keyed = _timed(stream, late, channel.alias("channel"), joins.alias("joins")).groupBy("channel")
    return keyed.transformWithStateInPandas(_Replay(kept, sent), "channel long, join_id long, event_id long, nth long", "Append", "EventTime")


class _Alerts(StatefulProcessor):
    def __init__(self, threshold: int, cooldown: int, per_day: int):
        self.threshold, self.cooldown, self.per_day = threshold, cooldown, per_day

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.alert = handle.getValueState("alert", "last long, fired long, active boolean")
        self.spent = handle.getMapState("spent", "day long", "cents long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, fired, active = self.alert.get() or (None, 0, True)
        spent, out = {}, []
        for us, event_id, cents in _in_order(rows)[["us", "event_id", "cents"]].itertuples(index=False, name=None):
            day = us // DAY
            if day not in spent:
                spent[day] = self.spent.getValue((day,))[0] if self.spent.containsKey((day,)) else 0
            spent[day] += int(cents)
            if not active or spent[day] < self.threshold or last is not None and us - last < self.cooldown:
                continue
            fired = fired + 1 if last is not None and last // DAY == day else 1
            last, active = int(us), fired < self.per_day
            out.append((key[0], event_id, spent[day], active))
        self.alert.update((last, fired, active))
        for day, cents in spent.items():
            self.spent.updateValue((int(day),), (cents,))
            self.handle.registerTimer(_timer((int(day) + 1) * DAY))
        yield pd.DataFrame(out, columns=["organization_id", "event_id", "spent", "active"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        day = (expiredTimerInfo.getExpiryTimeInMs() - 1) * 1000 // DAY - 1
        if self.spent.containsKey((day,)):
            self.spent.removeKey((day,))
        return iter(())

    def close(self) -> None:
        pass


def budget_alerts(stream: DataFrame, threshold: int, cooldown: int = 3600, per_day: int = 10, late: str = "1 hour") -> DataFrame:
    """(organization_id, event_id, spent, active): an alert when a day's spending, in hundredths, is at the threshold or more,
    at least `cooldown` seconds after the one before, whatever its day; with the `per_day`-th of a day the alert is switched
    off for good. The state is one of an alert (last time, count of that day, active) and of each day's spending, which goes
    when the watermark has passed the day."""
    cents = F.round(F.abs("value") * 100).cast("long").alias("cents")
    keyed = _timed(stream, late, (F.col("user_id") % 10).alias("organization_id"), cents).groupBy("organization_id")
    return keyed.transformWithStateInPandas(_Alerts(threshold, cooldown * 1_000_000, per_day), "organization_id long, event_id long, spent long, active boolean", "Append", "EventTime")


class _Deliveries(StatefulProcessor):
    def __init__(self, retries: int, delay: int, most: int):
        self.retries, self.delay, self.most = retries, delay, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hook = handle.getValueState("hook", "failures long, active boolean")
        self.pending = handle.getListState("pending", "due long, delivery_id long, attempt long, fails long")

    def _load(self) -> None:
        self.failures, self.active = self.hook.get() or (0, True)
        self.waiting = sorted(tuple(map(int, x)) for x in self.pending.get())
        self.timers = {due for due, *_ in self.waiting}

    def _save(self) -> None:
        self.hook.update((self.failures, self.active))
        self.pending.clear()
        if self.waiting:
            self.pending.put(self.waiting)
        for due in {due for due, *_ in self.waiting} - self.timers:
            self.handle.registerTimer(_timer(due))

    def _attempt(self, us: int, delivery: int, attempt: int, fails: int, out: list) -> None:
        if attempt > fails:
            outcome, self.failures = "success", 0
        elif attempt <= self.retries:
            outcome = "retry"
            self.waiting = sorted([*self.waiting, (us + self.delay * attempt, delivery, attempt + 1, fails)])
        else:
            outcome, self.failures = "failed", self.failures + 1
            self.active = self.active and self.failures < self.most
        out.append((self.key, delivery, attempt, us, outcome))

    def _until(self, us: int, out: list) -> None:
        """Attempts that are due by then."""
        while self.waiting and self.waiting[0][0] <= us:
            due, *what = self.waiting.pop(0)
            self._attempt(due, *what, out)

    def _frame(self, out: list) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["hook", "delivery_id", "attempt", "us", "outcome"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self._load()
        self.key, out = key[0], []
        for us, delivery, fails in _in_order(rows)[["us", "event_id", "fails"]].itertuples(index=False, name=None):
            self._until(us, out)
            if self.active:
                self._attempt(int(us), int(delivery), 1, int(fails), out)
            else:
                out.append((self.key, delivery, 0, us, "skipped"))
        self._save()
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self._load()
        self.key, out = key[0], []
        self._until(timerValues.getCurrentWatermarkInMs() * 1000, out)
        self._save()
        yield self._frame(out)

    def close(self) -> None:
        pass


def deliveries(stream: DataFrame, hook: Column, fails: Column, retries: int = 3, delay: int = 60, most: int = 10, late: str = "1 hour") -> DataFrame:
    """(hook, delivery_id, attempt, us, outcome) of each attempt, outcome being success, retry, failed or skipped.

    A delivery's first `fails` attempts fail; after attempt k the next follows `delay` * k seconds later, up to `retries` more,
    at a timer in event time. A success sets the hook's count of failed deliveries to zero; with `most` failed ones in a row it is
    switched off, and its further deliveries are skipped (attempt 0), while retries that wait are still made. Attempts come out
    once the watermark, or a later delivery of the hook, has passed their time. State: the hook's count, and what waits.
    """
    keyed = _timed(stream, late, hook.alias("hook"), fails.cast("long").alias("fails")).groupBy("hook")
    return keyed.transformWithStateInPandas(_Deliveries(retries, delay * 1_000_000, most), "hook long, delivery_id long, attempt long, us long, outcome string", "Append", "EventTime")
