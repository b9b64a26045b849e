"""What keyed processors hold, read from a query's checkpoint by the state data source: a batch frame at a stated batch, without the sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripledger.operators.live import SERIES


def operator_of(spark: SparkSession, checkpoint: str, variable: str) -> int:
    """The number of the query's stateful operator that has a variable of this name; a query may chain several."""
    rows = spark.read.format("state-metadata").load(checkpoint).select("operatorId", "operatorProperties")
    named = F.from_json("operatorProperties", "stateVariables array<struct<stateName string>>")
    found = rows.where(F.exists(named["stateVariables"], lambda v: v["stateName"] == variable)).select("operatorId").distinct().collect()
    if len(found) != 1:
        raise ValueError(f"{len(found)} operators of {checkpoint} hold {variable}")
    return found[0][0]


def held(spark: SparkSession, checkpoint: str, variable: str, batch: int | None = None) -> DataFrame:
    """key and value (user_map_key, user_map_value of maps) of a state variable, as of the last committed batch or the given one."""
    reader = spark.read.format("statestore").option("operatorId", operator_of(spark, checkpoint, variable)).option("stateVarName", variable)
    return (reader if batch is None else reader.option("batchId", batch)).load(checkpoint)


def earnings_held(spark: SparkSession, checkpoint: str, keep: int = SERIES, batch: int | None = None) -> DataFrame:
    """zone_id, window_end, earnings and completed_trips of the newest ``keep`` windows that the series' state holds for each zone.

    A zone has a bounded number of windows in state, so no window's group is large.
    """
    rows = held(spark, checkpoint, "windows", batch).select(
        F.col("key.zone_id").alias("zone_id"), F.col("user_map_key.window_end_s").alias("end_s"), F.col("user_map_value.cents").alias("cents"), F.col("user_map_value.n").alias("completed_trips")
    )
    age = F.row_number().over(Window.partitionBy("zone_id").orderBy(F.desc("end_s")))
    rows = rows.withColumn("age", age).where(F.col("age") <= keep)
    return rows.select("zone_id", F.timestamp_seconds("end_s").alias("window_end"), (F.col("cents") / F.lit(1e2)).alias("earnings"), "completed_trips")


def hour_ends(windows: DataFrame, window_minutes: int = 15) -> DataFrame:
    """The last of the windows that end in each zone's hour, keyed as the hourly table."""
    rows = windows.where("zone_id IS NOT NULL").withColumns({"sim_date": F.to_date("window_end"), "sim_hour": F.hour("window_end")})
    last = rows.groupBy("zone_id", "sim_date", "sim_hour").agg(F.max_by("earnings", "window_end").alias("earnings"))
    return last.withColumn("window_minutes", F.lit(window_minutes))
