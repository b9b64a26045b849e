"""Each zone's earnings series as bounded state: the newest windows, the oldest of which gives way when one is added."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tripledger.functions.rounding import units
from tripledger.operators import utilization
from tripledger.operators.live import SERIES
from tripledger.streaming.earnings import earnings_changes

#: Windows kept beyond those shown, to take the place of ones whose trips move away.
SPARE = 96


class NewestWindows(StatefulProcessor):
    """State: cents and trips by window, ``keep`` + ``spare`` of them. Gives a zone's whole series, newest first, when it changes.

    A change of a window older than all that a full state holds is passed over; more than ``spare`` windows would have to be emptied before one of those were missed.
    """

    def __init__(self, keep: int = SERIES, spare: int = SPARE):
        self.keep, self.spare = keep, spare

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.windows = handle.getMapState("windows", "window_end_s bigint", "cents bigint, n bigint")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = {k[0]: (v[0], v[1]) for k, v in self.windows.iterator()}
        now = dict(held)
        for r in rows:
            cents, n = now.get(r["window_end_s"], (0, 0))
            now[r["window_end_s"]] = (cents + r["cents"], n + r["n"])
        stay = sorted((w for w, v in now.items() if v != (0, 0)), reverse=True)[: self.keep + self.spare]
        for w in held.keys() - set(stay):
            self.windows.removeKey((w,))
        for w in stay:
            if held.get(w) != now[w]:
                self.windows.updateValue((w,), now[w])
        yield Row(zone_id=key[0], ends=stay[: self.keep], cents=[now[w][0] for w in stay[: self.keep]])

    def close(self) -> None:
        pass


def series_changes(pings: DataFrame, watermark: str = utilization.WATERMARK, keep: int = SERIES) -> DataFrame:
    """zone_id, ends and cents (arrays, newest first) of a stream of valid pings with zones, after each batch that changes a zone."""
    changes = earnings_changes(pings, watermark, "Append").where("zone_id IS NOT NULL")
    pane = F.timestamp_seconds(F.floor(F.unix_seconds("event_time") / utilization.seconds_of(utilization.SLIDE)) * utilization.seconds_of(utilization.SLIDE))
    rows = utilization.windows_of(changes.select("zone_id", pane.alias("pane"), units("fare", 2).alias("cents"), F.col("n").cast("long").alias("n")), "pane")
    return rows.select("zone_id", F.unix_seconds("window_end").alias("window_end_s"), "cents", "n").groupBy("zone_id").transformWithState(
        statefulProcessor=NewestWindows(keep), outputStructType="zone_id string, ends array<bigint>, cents array<bigint>", outputMode="Append", timeMode="None"
    )
