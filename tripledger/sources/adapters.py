"""The driver's tables in the engine's shapes: events as telemetry, orders as expenses, customer as registry.

The arithmetic is the same in plans/oracle.py, in DuckDB's SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: There are ten customers for each user, so orders and registry changes meet the fleet at every scale.
CUSTOMERS_EACH, DIGITS = 10, 9
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vehicle_id(number) -> Column:
    return F.concat(F.lit("V"), F.lpad(number.cast("string"), DIGITS, "0"))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry_of(table(spark, sf_dir, "events"))


def telemetry_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The same as a stream; the source needs a pattern, not the name of one file."""
    reader = spark.readStream.schema(EVENTS)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return telemetry_of(reader.parquet(f"{sf_dir.rstrip('/')}/events*.parquet"))


def telemetry_of(events: DataFrame) -> DataFrame:
    """Pings with the defects that validation looks for. reference_time is what a ping's time is held against."""
    e = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    has = lambda k: F.col("event_id") % k == 0
    number = F.col("user_id")
    slot = F.floor(F.hour("ts") / 4)
    e = e.withColumn("vehicle_id", vehicle_id(number))
    e = e.withColumn("status", F.when(F.col("event_type") == "view", "enroute").when(F.col("event_type").isin("click", "purchase"), "on_trip").otherwise("idle"))
    trip = F.concat_ws("-", "vehicle_id", F.date_format("ts", "yyyy-MM-dd"), slot.cast("string"))
    fare = F.lit(5) + (number * 7 + slot * 13 + F.dayofmonth("ts") * 3) % 40
    e = e.withColumns({
        "trip_id": F.when((F.col("status") != "idle") | has(109), trip),
        "fare": F.when((F.col("status") == "on_trip") & ~has(113), F.when(has(103), F.lit(-5.0)).otherwise(fare.cast("double"))),
        "event_time": F.when(has(107), F.col("ts") + F.expr("INTERVAL 2 HOURS")).otherwise(F.col("ts")),
        "lat": F.when(has(97), None).when(has(101), F.lit(51.5)).otherwise(F.lit(6.85) + F.lit(0.14) * ((F.col("event_id") * 7919) % 1000) / F.lit(1e3)),
        "lon": F.when(~has(97), F.lit(79.82) + F.lit(0.12) * ((F.col("event_id") * 104729) % 1000) / F.lit(1e3)),
    })
    return e.select(
        F.col("event_id").cast("string").alias("event_id"), "vehicle_id", F.concat(F.lit("D"), F.substring("vehicle_id", 2, DIGITS)).alias("driver_id"), "trip_id", "lat", "lon",
        F.col("value").alias("speed_kmh"), "status", "fare", "event_time", F.col("ts").alias("reference_time"), F.to_date("event_time").alias("sim_date"),
        (F.col("user_id") % 6).cast("int").alias("source_partition"), F.col("event_id").alias("source_offset"),
    )


def expenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partner's costs for each vehicle and day; some of its vehicles send no pings, and some days are missing."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    o = o.withColumns({"vno": F.floor(F.col("o_custkey") / CUSTOMERS_EACH), "day": (F.col("o_orderkey") % 30).cast("int")})
    o = o.where(~((F.col("vno") < 4) & ((F.col("o_orderkey") + F.col("o_custkey")) % 7 == 0)))
    g = o.groupBy("vno", "day").agg(F.sum("cents").alias("cents"), F.sum("o_orderkey").alias("keys")).where(F.col("keys") % 11 != 0)
    thousandth = lambda x: x.cast("double") / F.lit(1e2)
    return g.select(
        vehicle_id(F.col("vno")).alias("vehicle_id"),
        F.when(F.col("keys") % 17 != 0, thousandth(F.col("cents") % 9000)).alias("fuel_cost"),
        thousandth(F.floor(F.col("cents") / 9000) % 4000).alias("maintenance_cost"),
        thousandth(F.col("cents") % 30000).alias("partner_distance_km"),
        (F.col("keys") % 2 == 0).alias("service_flag"),
        F.lit("partner-1").alias("partner_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("day")).alias("sim_date"),
    )


def registry_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry's change log: several versions of a vehicle, the largest offset the latest."""
    c = table(spark, sf_dir, "customer")
    fuels = F.array(F.lit("petrol"), F.lit("diesel"), F.lit("hybrid"), F.lit("electric"))
    return c.select(
        vehicle_id(F.floor(F.col("c_custkey") / CUSTOMERS_EACH)).alias("vehicle_id"),
        F.concat(F.lit("model-"), F.lower(F.substring("c_mktsegment", 1, 4))).alias("model"),
        F.element_at(fuels, (F.col("c_nationkey") % 4 + 1).cast("int")).alias("fuel_type"),
        (F.col("c_nationkey") % 3 + 4).cast("int").alias("capacity"),
        F.concat(F.lit("Z"), F.lpad((F.col("c_nationkey") % 12 + 1).cast("string"), 2, "0")).alias("home_zone"),
        F.col("c_custkey").alias("offset"),
    )
