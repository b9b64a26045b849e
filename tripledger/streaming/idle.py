"""Keyed state machine for prolonged idling, one state for each vehicle."""

from __future__ import annotations

import bisect
import hashlib
import itertools
from collections.abc import Iterator
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tripledger.operators.idle import CRITICAL_MINUTES, TIMEOUT_HOURS, WARNING_MINUTES

ALERT = "alert_id string, vehicle_id string, severity string, idle_minutes double, idle_since_sim timestamp, raised_at_sim timestamp, zone_id string"
EPOCH = datetime(1970, 1, 1)


def micros(t: datetime) -> int:
    return (t - EPOCH) // timedelta(microseconds=1)


def moment(us: int) -> datetime:
    return EPOCH + timedelta(microseconds=us)


def episodes(pings: list[tuple], open_since: int | None) -> Iterator[tuple[int, list[tuple], bool]]:
    """Stretches of idle pings, in order: when each began, its pings, and whether it is still open at the end.

    pings: (micros, event_id, status, zone_id) in order; a first stretch goes on with what was open before.
    """
    stretches = [(idle, list(own)) for idle, own in itertools.groupby(pings, key=lambda p: p[2] == "idle")]
    if not stretches and open_since is not None:
        yield open_since, [], True
    for k, (idle, own) in enumerate(stretches):
        if idle:
            yield (open_since if k == 0 and open_since is not None else own[0][0]), own, k == len(stretches) - 1


def risen(since: int, pings: list[tuple], levels: list[tuple[float, str]], raised: int) -> Iterator[tuple[int, tuple]]:
    """The levels (minutes, name), ascending, that an episode reaches beyond the first ``raised``, each with the ping that does; a ping that reaches several counts for the highest."""
    times = [p[0] for p in pings]
    at = [bisect.bisect_left(times, since + minutes * 60e6) for minutes, _ in levels]
    for k in range(raised, len(levels)):
        if at[k] < len(pings) and at[k] not in at[k + 1 :]:
            yield k, pings[at[k]]


class IdleDetector(StatefulProcessor):
    """State: start of the episode, number of levels raised, and the time of the last ping. It goes after a day without pings.

    The timer fires only when the watermark passes, so a silence is also looked for between pings, as the batch twin does.
    """

    def __init__(self, warning: int = WARNING_MINUTES, critical: int = CRITICAL_MINUTES, timeout_hours: int = TIMEOUT_HOURS):
        self.warning, self.critical, self.timeout_us = warning, critical, timeout_hours * 3_600_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("idle", "since bigint, raised int, last bigint")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        pings = sorted((r["event_us"], r["event_id"], r["status"], r["zone_id"]) for r in rows)
        since, raised, last = self.state.get() if self.state.exists() else (None, 0, None)
        levels = [(self.warning, "WARNING"), (self.critical, "CRITICAL")]
        # A silence longer than the state's lifetime parts what comes before it from what comes after.
        times = [p[0] for p in pings]
        before = [times[0] if last is None else last, *times]
        cuts = [i for i, (a, b) in enumerate(zip(itertools.accumulate(before, max), times)) if b - a > self.timeout_us]
        for lo, hi in zip([0, *cuts], [*cuts, len(pings)]):
            if lo in cuts:
                since, raised = None, 0
            kept = (None, 0)
            for began, own, is_open in episodes(pings[lo:hi], since):
                known = raised if began == since else 0
                for k, ping in risen(began, own, levels, known):
                    name = hashlib.sha1(f"{key[0]}|{moment(began).isoformat()}".encode(), usedforsecurity=False).hexdigest()[:16]
                    yield Row(alert_id=name, vehicle_id=key[0], severity=levels[k][1], idle_minutes=round((ping[0] - began) / 60e6, 1), idle_since_us=began, raised_at_us=ping[0], zone_id=ping[3])
                    known = k + 1
                if is_open:
                    kept = (began, known)
            since, raised = kept if hi > lo else (since, raised)
        self.state.update((since, raised, max(before)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((max(before) + self.timeout_us) // 1000)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def idle_alert_stream(pings: DataFrame, watermark: str = "30 minutes", **levels) -> DataFrame:
    """Alerts of a stream of valid pings with zones; the session needs the RocksDB state store."""
    schema = "alert_id string, vehicle_id string, severity string, idle_minutes double, idle_since_us bigint, raised_at_us bigint, zone_id string"
    rows = pings.withColumn("event_us", F.unix_micros("event_time")).withWatermark("event_time", watermark)
    found = rows.select("vehicle_id", "event_id", "status", "zone_id", "event_us", "event_time").groupBy("vehicle_id").transformWithState(
        statefulProcessor=IdleDetector(**levels), outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )
    return found.select("alert_id", "vehicle_id", "severity", "idle_minutes", F.timestamp_micros("idle_since_us").alias("idle_since_sim"), F.timestamp_micros("raised_at_us").alias("raised_at_sim"), "zone_id")
