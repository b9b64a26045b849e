"""How far the live view was from the exact tables, in the same units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripledger.functions.rounding import half_up, mean_of, units

KEY = ["sim_date", "zone_id", "sim_hour"]


def _deltas(rows: DataFrame, zone: Column, metrics: list[tuple[str, Column, Column]]) -> DataFrame:
    each = F.inline(F.array(*[F.struct(F.lit(name).alias("metric"), s.cast("double").alias("s"), b.cast("double").alias("b")) for name, s, b in metrics]))
    long = rows.select("sim_date", zone.alias("zone_id"), each)
    pct = F.when(F.abs("b") != 0, half_up(F.lit(100.0) * (F.col("s") - F.col("b")) / F.abs("b"), 3))
    return long.select("sim_date", "zone_id", "metric", half_up("s", 4).alias("speed_value"), half_up("b", 4).alias("batch_value"), pct.alias("delta_pct"))


def paired(snapshot: DataFrame, hourly: DataFrame) -> DataFrame:
    s = snapshot.select(*KEY, "window_minutes", *[F.col(c).alias(f"s_{c}") for c in ("trips", "earnings", "idle_ratio", "active_vehicles")])
    return s.join(hourly.select(*KEY, *[F.col(c).alias(f"b_{c}") for c in ("trips", "earnings", "idle_ratio", "active_vehicles")]), KEY)


def _per_minute(flow: Column, minutes: Column) -> Column:
    return F.when(minutes != 0, flow / minutes)


def reconcile_zone(snapshot: DataFrame, hourly: DataFrame) -> DataFrame:
    """Flows as rates a minute; distinct vehicles raw, and named for the bias of the shorter window."""
    c, hour = F.col, F.lit(60.0)
    return _deltas(paired(snapshot, hourly), c("zone_id"), [
        ("trips_per_min", _per_minute(c("s_trips"), c("window_minutes")), c("b_trips") / hour),
        ("earnings_per_min", _per_minute(c("s_earnings"), c("window_minutes")), c("b_earnings") / hour),
        ("idle_ratio", c("s_idle_ratio"), c("b_idle_ratio")),
        ("active_vehicles_window_biased", c("s_active_vehicles"), c("b_active_vehicles")),
    ])


def reconcile_fleet(snapshot: DataFrame, hourly: DataFrame) -> DataFrame:
    g = paired(snapshot, hourly).groupBy("sim_date").agg(
        F.sum("s_trips").alias("st"), F.sum("s_earnings").alias("se"), mean_of("s_idle_ratio", 4).alias("si"), F.max("window_minutes").alias("w"),
        F.sum("b_trips").alias("bt"), F.sum("b_earnings").alias("be"), mean_of("b_idle_ratio", 4).alias("bi"),
    )
    c, hour = F.col, F.lit(60.0)
    return _deltas(g, F.lit("ALL"), [
        ("fleet_trips_per_min", _per_minute(c("st"), c("w")), c("bt") / hour),
        ("fleet_earnings_per_min", _per_minute(c("se"), c("w")), c("be") / hour),
        ("fleet_idle_ratio", c("si"), c("bi")),
    ])


def reconcile_earnings(held: DataFrame, hourly: DataFrame) -> DataFrame:
    """Earnings alone, for each zone and, by day, for the fleet. held: KEY, earnings and window_minutes, from a view or from a processor's state."""
    c, hour = F.col, F.lit(60.0)
    both = held.select(*KEY, "window_minutes", c("earnings").alias("s_earnings")).join(hourly.select(*KEY, c("earnings").alias("b_earnings")), KEY)
    zones = _deltas(both, c("zone_id"), [("earnings_per_min", _per_minute(c("s_earnings"), c("window_minutes")), c("b_earnings") / hour)])
    days = both.groupBy("sim_date").agg(F.sum(units("s_earnings", 2)).alias("s"), F.sum(units("b_earnings", 2)).alias("b"), F.max("window_minutes").alias("w"))
    cents = F.lit(1e2)
    return zones.unionByName(_deltas(days, F.lit("ALL"), [("fleet_earnings_per_min", _per_minute(c("s") / cents, c("w")), c("b") / cents / hour)]))


def summary(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("metric").agg(F.count("delta_pct").alias("n"), half_up(mean_of(F.abs("delta_pct"), 3), 2).alias("avg_abs_delta_pct"), half_up(F.max(F.abs("delta_pct")), 2).alias("max_abs_delta_pct"))
