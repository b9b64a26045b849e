"""Zones and registry attributes on pings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripledger.zones import zone_of


def with_zone(pings: DataFrame) -> DataFrame:
    """zone_id by half-open boxes; a ping outside all of them stays, without one. The boxes are a grid, so no join is needed."""
    return pings.withColumn("zone_id", zone_of(F.col("lat"), F.col("lon")))


def with_registry(pings: DataFrame, registry: DataFrame) -> DataFrame:
    """Three attributes of the vehicle; Spark broadcasts the registry if its size allows, and shuffles both sides if not."""
    return pings.join(registry.select("vehicle_id", "fuel_type", "capacity", F.col("home_zone").alias("registry_home_zone")), "vehicle_id", "left")
