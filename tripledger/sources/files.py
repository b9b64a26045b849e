"""Files and logs: the partitioned event dataset, expense files, and the record log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripledger import schemas

WIRE_HEADER_BYTES = 5


def scan_day(dataset: DataFrame, sim_date: str) -> DataFrame:
    """One day of the event dataset; the filter prunes partitions where it is partitioned by sim_date."""
    return dataset.where(F.col("sim_date") == F.lit(sim_date).cast("date"))


def read_master(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root)


def expense_paths(spark: SparkSession, pattern: str) -> list[str]:
    """The files that a pattern names, in any file system Spark can read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return [f.getPath().toString() for f in found or []]


def read_expenses(spark: SparkSession, path: str, sim_date: str | None = None, quarantine: DataFrame | None = None) -> DataFrame:
    """Expense files by the declared schema; where no file is, an empty frame of the same shape.

    The day is given, or it is that of the folder, sim_date=<day>, that holds a file. Files named in ``quarantine`` (file) are left out.
    """
    if not expense_paths(spark, path):
        return spark.createDataFrame([], schemas.EXPENSES)
    reader = spark.read.schema(schemas.EXPENSE_FILE).option("header", True)
    if sim_date is None:
        reader = reader.option("basePath", path[: path.rindex("/sim_date=")])
    raw = reader.csv(path)
    raw = raw.withColumn("sim_date", (F.lit(sim_date) if sim_date else F.col("sim_date")).cast("date"))
    if quarantine is not None:
        raw = raw.withColumn("file", file_of(F.input_file_name())).join(quarantine.select("file").distinct(), "file", "left_anti")
    return shaped_expenses(raw)


def file_of(path: Column) -> Column:
    """The folder sim_date=<day> that holds a file names it."""
    return F.regexp_extract(path, r"sim_date=([0-9-]+)/[^/]*$", 1)


def shaped_expenses(raw: DataFrame) -> DataFrame:
    return raw.withColumnRenamed("distance_covered", "partner_distance_km").select(*[c.split()[0] for c in schemas.EXPENSES.split(", ")])


def to_wire(payload: Column, schema_id: int) -> Column:
    """A zero byte, the schema's number in four, and the payload."""
    return F.concat(F.unhex(F.lit(f"00{schema_id:08x}")), payload)


def from_wire(value: Column) -> Column:
    return F.substring(value, WIRE_HEADER_BYTES + 1, F.length(value) - WIRE_HEADER_BYTES)


def decode(records: DataFrame, schema: str = schemas.TELEMETRY, flag_failures: bool = False) -> DataFrame:
    """Log records to telemetry: permissive, so a bad payload gives nulls; the log position stays.

    With flag_failures a column decode_error says DESERIALIZATION_FAILED for such payloads.
    """
    payload = F.from_json(from_wire(F.col("value")).cast("string"), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    out = records.withColumn("_p", payload)
    bad = F.col("value").isNull() | F.col("_p").isNull() | F.forall(F.array(*[F.col(f"_p.{c.split()[0]}").isNull() for c in schema.split(", ")]), lambda x: x)
    extra = [F.when(bad, "DESERIALIZATION_FAILED").alias("decode_error")] if flag_failures else []
    return out.select("_p.*", F.col("partition").alias("source_partition"), F.col("offset").alias("source_offset"), F.col("timestamp").alias("log_timestamp"), *extra)


def log_of(telemetry: DataFrame, schema_id: int = 1) -> DataFrame:
    """Telemetry as log records: key, wire-framed JSON value, partition, offset, timestamp."""
    columns = [c for c in telemetry.columns if c not in ("source_partition", "source_offset", "reference_time", "sim_date")]
    return telemetry.select(
        F.col("vehicle_id").cast("binary").alias("key"),
        to_wire(F.to_json(F.struct(*columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).cast("binary"), schema_id).alias("value"),
        F.col("source_partition").alias("partition"), F.col("source_offset").alias("offset"), F.col("event_time").alias("timestamp"),
    )


def profile(log: DataFrame) -> DataFrame:
    """A slice of the log at a glance: rows, nulls, keys that differ from the payload's vehicle, and the span of event times."""
    rows = decode(log.withColumn("timestamp", F.col("timestamp"))).withColumn("_one", F.lit(1))
    keyed = log.select(F.col("key").cast("string").alias("k"), F.get_json_object(from_wire(F.col("value")).cast("string"), "$.vehicle_id").alias("v"))
    wrong = keyed.agg(F.count_if(~F.col("k").eqNullSafe(F.col("v"))).alias("wrong_keys"))
    about = rows.agg(
        F.count("_one").alias("n_rows"), F.count_if(F.col("lat").isNull() | F.col("lon").isNull()).alias("null_coordinates"), F.count_if(F.col("trip_id").isNull()).alias("null_trips"),
        F.min("event_time").alias("first_event"), F.max("event_time").alias("last_event"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in schemas.STATUSES],
    )
    return about.crossJoin(F.broadcast(wrong))  # one row each
