"""Prolonged idling: the batch twin of the streaming state machine, on window islands.

An episode is a run of idle pings of one vehicle; any other status, null included, ends it, and so does a silence
longer than the state's lifetime. Its first ping opens it; a later one raises WARNING or CRITICAL when the minutes since
then reach the level and the level is higher than any raised before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripledger.functions.clock import isoformat
from tripledger.functions.rounding import half_up
from tripledger.schemas import ALERT_ENVELOPE, envelope

WARNING_MINUTES, CRITICAL_MINUTES, TIMEOUT_HOURS, FEED = 45, 90, 24, 200


def alert_id(vehicle_id: Column, idle_since: Column) -> Column:
    """The same for every alert of an episode, so a replay repeats it."""
    return F.substring(F.sha1(F.concat_ws("|", vehicle_id, isoformat(idle_since))), 1, 16)


def idle_runs(pings: DataFrame, timeout_hours: int = TIMEOUT_HOURS) -> DataFrame:
    """The idle pings with idle_since_sim, when their episode began.

    Runs are found inside each vehicle's day. One row for each vehicle and day then says how the day ended, and an episode that is open
    at midnight is carried into the days after it, so no task holds more of a vehicle's history than a day, and a row for each day.
    """
    us, day, timeout = F.unix_micros("event_time"), ["vehicle_id", "_day"], timeout_hours * 3_600_000_000
    order = Window.partitionBy(*day).orderBy("event_time", "event_id")
    idle = F.col("status").eqNullSafe("idle")
    silent = F.coalesce(us - F.lag(us).over(order) > timeout, F.lit(False))
    rows = pings.withColumn("_day", F.to_date("event_time")).withColumn("_ends", (~idle | silent).cast("int"))
    rows = rows.withColumn("_run", F.sum("_ends").over(order.rowsBetween(Window.unboundedPreceding, 0)))

    runs = rows.groupBy(*day, "_run").agg(F.min(F.when(idle, us)).alias("_since"), F.min(us).alias("_first"), F.max(us).alias("_last"))
    days = runs.groupBy(*day).agg(F.max_by("_since", "_run").alias("_open"), F.max("_run").alias("_breaks"), F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    by_day = Window.partitionBy("vehicle_id").orderBy("_day")
    days = days.withColumn("_gap", F.coalesce(F.col("_first") - F.lag("_last").over(by_day) > timeout, F.lit(True)))
    days = days.withColumn("_chain", F.sum((F.col("_gap") | (F.col("_breaks") > 0)).cast("int")).over(by_day))
    so_far = F.min("_open").over(Window.partitionBy("vehicle_id", "_chain").orderBy("_day"))
    days = days.withColumn("_so_far", so_far).withColumn("_carried", F.when(~F.col("_gap"), F.lag("_so_far").over(by_day)))

    began = runs.join(days.select(*day, "_carried"), day).withColumn("_began", F.when(F.col("_run") == 0, F.coalesce("_carried", "_since")).otherwise(F.col("_since")))
    return rows.where(idle).join(began.select(*day, "_run", "_began"), [*day, "_run"]).withColumn("idle_since_sim", F.timestamp_micros("_began")).drop("_day", "_ends", "_run", "_began")


def idle_alerts(pings: DataFrame, warning: int = WARNING_MINUTES, critical: int = CRITICAL_MINUTES, timeout_hours: int = TIMEOUT_HOURS) -> DataFrame:
    """The first ping of each episode at each level it reaches."""
    minutes = (F.unix_micros("event_time") - F.unix_micros("idle_since_sim")) / F.lit(6e7)
    rows = idle_runs(pings, timeout_hours).withColumn("idle_minutes", minutes)
    rows = rows.withColumn("severity", F.when(minutes >= critical, "CRITICAL").when(minutes >= warning, "WARNING")).where("severity IS NOT NULL")
    zone = F.col("zone_id") if "zone_id" in pings.columns else F.lit(None).cast("string")
    first = F.min(F.struct("event_time", "event_id", "idle_minutes", zone.alias("zone_id"))).alias("f")
    found = rows.groupBy("vehicle_id", "idle_since_sim", "severity").agg(first)
    named = alert_id(F.col("vehicle_id"), F.col("idle_since_sim")).alias("alert_id")
    return found.select(named, "vehicle_id", "severity", F.bround("f.idle_minutes", 1).alias("idle_minutes"), "idle_since_sim", F.col("f.event_time").alias("raised_at_sim"), "f.zone_id")


# An alert's type, layer and sentence.
ALERT_TYPE, SOURCE_LAYER, SENTENCE = "VEHICLE_IDLE_PROLONGED", "speed", ("idle for ", " simulated minutes since ")


def alert_envelopes(alerts: DataFrame) -> DataFrame:
    """_key and the envelope of each alert."""
    whole = half_up("idle_minutes", 0).cast("int").cast("string")
    said = {"detail": F.concat(F.lit(SENTENCE[0]), whole, F.lit(SENTENCE[1]), F.date_format("idle_since_sim", "yyyy-MM-dd HH:mm")), "alert_type": F.lit(ALERT_TYPE), "source_layer": F.lit(SOURCE_LAYER)}
    measured = {"value": F.col("idle_minutes"), "threshold": F.lit(None), "raised_at_real": F.current_timestamp()}
    return alerts.select(F.col("vehicle_id").alias("_key"), envelope(ALERT_ENVELOPE, said | measured))


def alert_feed(alerts: DataFrame, newest: int = FEED) -> DataFrame:
    """The newest alerts by simulated time, a repeated one once."""
    return alerts.dropDuplicates().orderBy(F.col("raised_at_sim").desc(), "alert_id", "severity").limit(newest)


def is_stale(idle_since: Column, now: Column, ttl_minutes: int) -> Column:
    """Whether a vehicle's idle state is worth nothing: it has no start, or began longer ago than its lifetime."""
    return idle_since.isNull() | (F.unix_micros(now) - F.unix_micros(idle_since) > ttl_minutes * 60_000_000)


def idle_states(pings: DataFrame) -> DataFrame:
    """Each vehicle's last status, and when its current idle episode began."""
    last = pings.groupBy("vehicle_id").agg(F.max_by("status", F.struct("event_time", "event_id")).alias("last_status"), F.max("event_time").alias("last_seen"))
    busy = pings.where(~F.col("status").eqNullSafe("idle")).groupBy("vehicle_id").agg(F.max(F.struct("event_time", "event_id")).alias("_busy"))
    began = pings.where("status = 'idle'").join(busy, "vehicle_id", "left").where(F.col("_busy").isNull() | (F.struct("event_time", "event_id") > F.col("_busy")))
    return last.join(began.groupBy("vehicle_id").agg(F.min("event_time").alias("idle_since_sim")), "vehicle_id", "left")
