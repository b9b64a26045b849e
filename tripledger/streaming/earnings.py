"""Earnings that follow a trip's last ping: a stream of credits and retractions, one state for each trip of a day."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tripledger.operators import utilization

DAY_MS = 86_400_000


class LastPing(StatefulProcessor):
    """State: the ping at which the trip's fare is credited. A later one takes it over: the old credit is taken back, the new one given.

    A trip's state lasts until the watermark has passed its day by ``delay_ms``; pings of the day that came after that would be late.
    """

    def __init__(self, delay_ms: int):
        self.delay_ms = delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.credited = handle.getValueState("credited", "event_us bigint, event_id string, zone_id string, fare double")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        last = max(((r["event_us"], r["event_id"], r["zone_id"], r["fare"]) for r in rows), key=lambda p: p[:2])
        before = tuple(self.credited.get()) if self.credited.exists() else None
        if before is not None and before[:2] >= last[:2]:
            return
        if before is not None:
            yield Row(zone_id=before[2], event_us=before[0], fare=-before[3], n=-1)
        else:
            end_of_day = (last[0] // 1000 // DAY_MS + 1) * DAY_MS
            self.handle.registerTimer(end_of_day + self.delay_ms)
        yield Row(zone_id=last[2], event_us=last[0], fare=last[3], n=1)
        self.credited.update(last)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.credited.clear()
        return iter(())

    def close(self) -> None:
        pass


def earnings_changes(pings: DataFrame, watermark: str = utilization.WATERMARK, mode: str = "Update") -> DataFrame:
    """zone_id, event_time, fare and n (1 or -1) of a stream of valid pings with zones; the session needs the RocksDB state store.

    Spark leaves out pings later than the watermark, so none meets a state that has gone.
    """
    delay = max(utilization.seconds_of(watermark), utilization.TRIP_DELAY_MINUTES * 60) * 1000
    rows = utilization.priced(pings).withWatermark("event_time", watermark)
    rows = rows.select("trip_id", "sim_date", "event_id", "zone_id", "fare", "event_time", F.unix_micros("event_time").alias("event_us"))
    changes = rows.groupBy("trip_id", "sim_date").transformWithState(
        statefulProcessor=LastPing(delay), outputStructType="zone_id string, event_us bigint, fare double, n int", outputMode=mode, timeMode="EventTime"
    )
    return changes.select("zone_id", F.timestamp_micros("event_us").alias("event_time"), "fare", "n")
