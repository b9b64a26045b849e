"""Schemas of the tables that cross a boundary; files and streams are read with them, never inferred."""

from pyspark.sql import Column
from pyspark.sql import functions as F

TELEMETRY = (
    "event_id string, vehicle_id string, driver_id string, trip_id string, lat double, lon double, speed_kmh double, status string, fare double, "
    "event_time timestamp, ingest_time timestamp, producer_id string, schema_version int"
)
LOG_RECORD = "key binary, value binary, partition int, offset long, timestamp timestamp"
EXPENSE_FILE = "vehicle_id string, fuel_cost double, maintenance_cost double, distance_covered double, service_flag boolean, submitted_at timestamp, partner_id string"
EXPENSES = "vehicle_id string, fuel_cost double, maintenance_cost double, partner_distance_km double, service_flag boolean, partner_id string, sim_date date"
REGISTRY = "vehicle_id string, model string, fuel_type string, capacity int, home_zone string, driver_id string, onboarded_sim_date date, updated_at timestamp"
STATUSES = ("idle", "enroute", "on_trip")
ZONE_HOURLY_KEY = ("zone_id", "sim_date", "sim_hour")
PNL_KEY = ("vehicle_id", "sim_date")

# The fields of the two envelopes, in the order of their schemas.
DEAD_LETTER = (
    "original_payload binary, rejection_reason string, rejection_detail string, validator string, vehicle_id string, rejected_at_sim timestamp, rejected_at_real timestamp, "
    "source_topic string, source_partition int, source_offset bigint, trace_id string"
)
ALERT_ENVELOPE = (
    "alert_id string, vehicle_id string, alert_type string, severity string, detail string, zone_id string, value double, threshold double, raised_at_sim timestamp, "
    "raised_at_real timestamp, source_layer string"
)


def envelope(schema: str, values: dict[str, Column]) -> Column:
    """A struct of the schema's fields from values by name; a field without one is the row's column of that name."""
    fields = [f.split() for f in schema.split(", ")]
    return F.struct(*[values.get(name, F.col(name)).cast(kind).alias(name) for name, kind in fields]).alias("envelope")
