"""The simulated clock: simulated = epoch_sim + (real - epoch_wall) * 86400 / day_seconds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SimClock:
    """Both epochs in seconds since 1970; a simulated day lasts day_seconds real seconds."""

    epoch_sim: float
    epoch_wall: float
    day_seconds: float

    @property
    def rate(self) -> float:
        if self.day_seconds <= 0:
            raise ValueError("a simulated day takes some real time")
        return 86400 / self.day_seconds


def sim_time_of(real: Column, clock: SimClock) -> Column:
    """The simulated time of a real timestamp, to the microsecond."""
    since = (F.unix_micros(real) - F.lit(round(clock.epoch_wall * 1e6))) * F.lit(clock.rate)
    return F.timestamp_micros(F.lit(round(clock.epoch_sim * 1e6)) + F.round(since).cast("long"))


def sim_now(clock: SimClock) -> Column:
    return sim_time_of(F.current_timestamp(), clock)


def reference_time(ingest: Column, clock: SimClock) -> Column:
    """What a row's event time is held against: its own arrival on the simulated clock, or now where that is unknown."""
    return F.coalesce(sim_time_of(ingest, clock), sim_now(clock))


def isoformat(ts: Column) -> Column:
    """2026-03-01T12:00:00, with microseconds only where there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat_ws(".", whole, micros))
