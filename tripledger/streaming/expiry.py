"""The newest ping of each vehicle as state that expires: a vehicle that falls silent leaves the view by itself."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tripledger.operators.live import VEHICLE_TTL_MINUTES


class NewestPing(StatefulProcessor):
    """State: time and identifier of the newest ping, with a timer for when it will have been silent too long. Gives the newest ping when it
    changes, and a removal when the timer fires; an older ping changes nothing."""

    def __init__(self, ttl_minutes: int):
        self.ttl_us = ttl_minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "event_us bigint, event_id string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        ping = max(((r["event_us"], r["event_id"], r["status"], r["zone_id"]) for r in rows), key=lambda p: p[:2])
        if self.newest.exists() and tuple(self.newest.get()) >= ping[:2]:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        # A vehicle is alive until its silence is longer than the limit: the first whole millisecond after that.
        self.handle.registerTimer((ping[0] + self.ttl_us) // 1000 + 1)
        self.newest.update(ping[:2])
        yield Row(vehicle_id=key[0], status=ping[2], zone_id=ping[3], event_us=ping[0], removed=False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        last = self.newest.get()[0]
        self.newest.clear()
        yield Row(vehicle_id=key[0], status=None, zone_id=None, event_us=last, removed=True)

    def close(self) -> None:
        pass


def vehicle_changes(pings: DataFrame, watermark: str, ttl_minutes: int = VEHICLE_TTL_MINUTES) -> DataFrame:
    """vehicle_id, status, zone_id, event_us, removed of a stream of valid pings with zones; silence is measured against the watermark. The session needs the RocksDB state store."""
    rows = pings.where("vehicle_id IS NOT NULL").withWatermark("event_time", watermark)
    rows = rows.select("vehicle_id", "event_id", "status", "zone_id", "event_time", F.unix_micros("event_time").alias("event_us"))
    return rows.groupBy("vehicle_id").transformWithState(
        statefulProcessor=NewestPing(ttl_minutes), outputStructType="vehicle_id string, status string, zone_id string, event_us bigint, removed boolean", outputMode="Update", timeMode="EventTime"
    )
