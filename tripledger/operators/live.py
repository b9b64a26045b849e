"""The live view as tables: the newest window of each zone, the fleet, each vehicle, and what has expired."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripledger.functions.rounding import half_up, mean_of

SERIES = 96
ZONE_TTL_MINUTES, VEHICLE_TTL_MINUTES = 120, 30


def newest_window(windowed: DataFrame) -> DataFrame:
    """Each zone's latest window; rows without a zone are no part of the view."""
    return windowed.where("zone_id IS NOT NULL").groupBy("zone_id").agg(F.max_by(F.struct(*windowed.columns), "window_end").alias("r")).select("r.*")


def last_pane(pings: DataFrame, pane_seconds: int = 300) -> DataFrame:
    """The pings of each zone's last pane, which are all that its newest sliding window holds; zoneless ones are no part of the view."""
    start = lambda c: F.floor(F.unix_seconds(c) / pane_seconds) * pane_seconds
    last = pings.where("zone_id IS NOT NULL").groupBy("zone_id").agg(F.max("event_time").alias("_last"))  # a row for each zone
    return pings.join(last, "zone_id").where(F.unix_seconds("event_time") >= start("_last")).drop("_last")


def fleet_of(zones: DataFrame) -> DataFrame:
    """One row over the zones' newest windows; the idle ratio is the unweighted mean."""
    return zones.agg(
        F.sum("active_vehicles").alias("active_vehicles"), F.sum("trips").alias("trips"), half_up(mean_of("idle_ratio", 4), 4).alias("idle_ratio"),
        F.count(F.lit(1)).alias("zones_reporting"), F.max("window_end").alias("window_end"),
    )


def earnings_series(earnings: DataFrame, keep: int = SERIES) -> DataFrame:
    """Each zone's newest points, as window_end in seconds, a colon, and the earnings."""
    w = Window.partitionBy("zone_id").orderBy(F.col("window_end").desc())
    points = earnings.where("zone_id IS NOT NULL").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep)
    point = F.concat_ws(":", F.unix_timestamp("window_end").cast("string"), half_up("earnings", 2).cast("decimal(14,2)").cast("string"))
    return points.select("zone_id", F.col("_n").alias("age"), point.alias("point"))


def parse_series(points: DataFrame) -> DataFrame:
    """The inverse, split at the last colon; what does not parse is null."""
    at = F.regexp_extract("point", r"^(.*):([^:]*)$", 1)
    value = F.regexp_extract("point", r"^(.*):([^:]*)$", 2)
    whole = lambda c: c.try_cast("double").try_cast("long")
    return points.withColumns({"window_end_s": whole(at), "earnings": value.try_cast("double")})


def zone_view(activity: DataFrame, earnings: DataFrame) -> DataFrame:
    """Both column families of each zone, written apart and read together."""
    a = newest_window(activity).withColumnRenamed("window_end", "activity_window_end").drop("window_start")
    e = newest_window(earnings).withColumnRenamed("window_end", "earnings_window_end").drop("window_start")
    return a.join(e, "zone_id", "full_outer")


def vehicle_state(pings: DataFrame) -> DataFrame:
    """The newest ping of each vehicle as text: positions to 5 places, speed to 1, nulls empty."""
    newest = pings.where("vehicle_id IS NOT NULL").groupBy("vehicle_id").agg(F.max_by(F.struct("status", "zone_id", "trip_id", "lat", "lon", "speed_kmh", "event_time"), F.struct("event_time", "event_id")).alias("r")).select("vehicle_id", "r.*")
    text = lambda c, places: F.coalesce(half_up(c, places).cast(f"decimal(12,{places})").cast("string"), F.lit(""))
    plain = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return newest.select("vehicle_id", plain("status"), plain("zone_id"), plain("trip_id"), text("lat", 5).alias("lat"), text("lon", 5).alias("lon"), text("speed_kmh", 1).alias("speed_kmh"), F.col("event_time").alias("updated_at_sim"))


def alive(rows: DataFrame, updated: str, now, ttl_minutes: int) -> DataFrame:
    return rows.where(F.col(updated) >= now - F.expr(f"INTERVAL {ttl_minutes} MINUTES"))


def every_zone(zones: DataFrame, view: DataFrame) -> DataFrame:
    """All zones in grid order, the silent ones with reporting false."""
    seen = view.withColumn("_seen", F.lit(True))
    return zones.select("zone_id", "zone_name").join(seen, "zone_id", "left").withColumn("reporting", F.coalesce("_seen", F.lit(False))).drop("_seen").orderBy("zone_id")
