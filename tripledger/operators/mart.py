"""Tables of the mart: keyed upserts as functions from tables to tables, the watermark, and the reads.

Plain tables have no MERGE: an upsert takes the stored and the incoming rows and returns the new table, which
``Store`` writes as a new version, so no plan overwrites what it reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripledger.functions.rounding import half_up, mean_of


def upsert(stored: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Incoming rows replace stored ones of the same key; doing it twice changes nothing."""
    s, i = F.col("s"), F.col("i")
    old = stored.select(*key, F.struct(*stored.columns).alias("s"))
    new = incoming.select(*key, F.struct(*stored.columns).alias("i"))
    return old.join(new, key, "full_outer").select(F.coalesce(i, s).alias("r")).select("r.*")


def upsert_restated(stored: DataFrame, incoming: DataFrame, key: list[str], now: Column) -> DataFrame:
    """An upsert that audits: a row written by another run than the stored one counts as restated, the same run does not.

    stored has restated_at and restatement_count besides the incoming columns.
    """
    values = [c for c in incoming.columns]
    old = stored.select(*key, F.struct(*stored.columns).alias("s"))
    new = incoming.select(*key, F.struct(*values).alias("i"))
    both = old.join(new, key, "full_outer")
    again = F.col("s").isNotNull() & F.col("i").isNotNull() & ~F.col("s.job_run_id").eqNullSafe(F.col("i.job_run_id"))
    picked = [F.when(F.col("i").isNotNull(), F.col(f"i.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in values]
    audit = [F.when(again, now).otherwise(F.col("s.restated_at")).alias("restated_at"), (F.coalesce("s.restatement_count", F.lit(0)) + again.cast("int")).alias("restatement_count")]
    return both.select(*picked, *audit)


def advance_high_water_mark(stored: DataFrame, done: DataFrame) -> DataFrame:
    """One row, never earlier than it was; done has the finished sim_date, or several. No rows: a cold start."""
    return stored.select("sim_date").unionByName(done.select("sim_date")).agg(F.max("sim_date").alias("sim_date")).where("sim_date IS NOT NULL")


def speed_snapshot(live: DataFrame, window_minutes: int, captured_at: Column) -> DataFrame:
    """What the live view said, keyed by the hour its window ends in; silent zones and windows without an end are passed over."""
    ends = F.col("window_end").cast("timestamp")
    rows = live.where(ends.isNotNull() & F.col("zone_id").isNotNull())
    return rows.select(F.to_date(ends).alias("sim_date"), "zone_id", F.hour(ends).alias("sim_hour"), captured_at.alias("captured_at_sim"), F.lit(window_minutes).alias("window_minutes"), "trips", "earnings", "active_vehicles", "idle_ratio", "avg_speed_kmh")


def dq_rows(checks: DataFrame, run_id: str) -> DataFrame:
    """Rows for dq_run_log; a status other than PASS, WARN and FAIL is an error."""
    known = F.col("status").isin("PASS", "WARN", "FAIL")
    return checks.select(F.lit(run_id).alias("job_run_id"), "sim_date", "check_name", F.when(known, F.col("status")).otherwise(F.raise_error(F.concat(F.lit("unknown status "), F.coalesce("status", F.lit("null"))))).alias("status"), "observed", "threshold", "detail")


def zone_daily(hourly: DataFrame) -> DataFrame:
    return hourly.groupBy("zone_id", "sim_date").agg(
        F.sum("trips").alias("trips"), half_up(F.sum("earnings"), 2).alias("earnings"), F.max("active_vehicles").alias("active_vehicles"),
        half_up(mean_of("idle_ratio", 4), 4).alias("idle_ratio"), half_up(mean_of("avg_speed_kmh", 1), 1).alias("avg_speed_kmh"), F.count(F.lit(1)).alias("hours_reported"),
    )


def unprofitable(pnl: DataFrame, limit: int = 50, classification: str | None = None) -> DataFrame:
    """The latest day's worst vehicles by trend; at most 200."""
    latest = pnl.agg(F.max("sim_date").alias("sim_date"))
    rows = pnl.join(F.broadcast(latest), "sim_date", "left_semi")  # one row
    if classification:
        rows = rows.where(F.col("classification") == classification)
    return rows.orderBy(F.col("rolling_avg_profit").asc_nulls_last(), F.col("net_profit").asc_nulls_last(), "vehicle_id").limit(min(limit, 200))


def vehicle_history(pnl: DataFrame, vehicle_id: str, days: int) -> DataFrame:
    return pnl.where(F.col("vehicle_id") == vehicle_id).orderBy(F.col("sim_date").desc()).limit(days)


def revenue_crosscheck(pnl: DataFrame, hourly: DataFrame) -> DataFrame:
    """Both paths' revenue by day; they must agree to the cent."""
    a = pnl.groupBy("sim_date").agg(half_up(F.sum("revenue"), 2).alias("pnl_revenue"))
    b = hourly.groupBy("sim_date").agg(half_up(F.sum("earnings"), 2).alias("zone_earnings"))
    return a.join(b, "sim_date", "full_outer").withColumn("delta", half_up(F.coalesce("pnl_revenue", F.lit(0.0)) - F.coalesce("zone_earnings", F.lit(0.0)), 2))


def scd2(changes: DataFrame, key: str, order: str, attributes: list[str]) -> DataFrame:
    """Validity ranges of a key's versions; a change that changes no attribute opens none."""
    w = Window.partitionBy(key).orderBy(order)
    state = F.struct(*attributes)
    moved = changes.withColumn("_before", F.lag(state).over(w)).where(~state.eqNullSafe(F.col("_before")) | F.col("_before").isNull())
    return moved.select(key, *attributes, F.col(order).alias("valid_from"), F.lead(order).over(w).alias("valid_to")).withColumn("is_current", F.col("valid_to").isNull())


def calendar(bounds: DataFrame) -> DataFrame:
    """bounds: one row of first and last. The days between them."""
    days = bounds.select(F.explode(F.sequence("first", "last")).alias("sim_date"))
    return days.withColumns({"day_of_week": F.dayofweek("sim_date"), "is_weekend": F.dayofweek("sim_date").isin(1, 7)})


def restatements(upserted: DataFrame, run_id: str) -> DataFrame:
    """Rows for the restatement log: a marker for each day that a run restated, and how many of its rows."""
    own = upserted.where((F.col("job_run_id") == run_id) & (F.col("restatement_count") > 0)).groupBy("sim_date").agg(F.count(F.lit(1)).alias("n_rows"))
    return own.select("sim_date", F.concat_ws("/", F.col("sim_date").cast("string"), F.lit(run_id)).alias("marker_key"), F.lit(run_id).alias("triggered_run"), "n_rows")


def unmarked(rows: DataFrame, log: DataFrame) -> DataFrame:
    """Log rows whose marker is not in the log yet, so that a repeated run adds none."""
    return rows.join(log.select("marker_key").distinct(), "marker_key", "left_anti").select(*rows.columns)


class Store:
    """Versioned Parquet tables in folders _v=<number>: a write makes a new version, which counts once its _SUCCESS is there.

    A plain write is the whole table. With partition, a write replaces the days in its rows and those in ``days``, also where they have
    no rows now, and the newest versions of all other days stand. An append adds its rows to all before. A table is written in one of these ways.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _glob(self, pattern: str) -> list[str]:
        fs, path = self._fs()
        return sorted(f.getPath().toString() for f in fs.globStatus(path(f"{self.root}/{pattern}")) or [])

    def versions(self, name: str) -> list[str]:
        """The complete versions, oldest first."""
        return [p.removesuffix("/_SUCCESS") for p in self._glob(f"{name}/_v=*/_SUCCESS")]

    def _next(self, name: str) -> str:
        taken = [int(p.rsplit("=", 1)[1]) for p in self._glob(f"{name}/_v=*")]
        return f"{self.root}/{name}/_v={max(taken, default=-1) + 1:08d}"

    def days(self, name: str, partition: str = "sim_date") -> dict[str, str]:
        """The folder that holds each day's newest rows; days that a later version emptied are left out."""
        newest: dict[str, str] = {}
        for version in self.versions(name):
            own = version[version.rindex("_v=") :]
            for folder in self._glob(f"{name}/{own}/{partition}=*"):
                newest[folder.rsplit("=", 1)[1]] = folder
        fs, path = self._fs()
        return {d: f for d, f in newest.items() if fs.globStatus(path(f"{f}/[^_]*"))}

    def read(self, name: str, schema: str | None = None, partition: str | None = None) -> DataFrame:
        """The newest complete version, or each day's; an empty frame where there is none."""
        found = list(self.days(name, partition).values()) if partition else self.versions(name)[-1:]
        return self._rows(name, found, schema)

    def read_all(self, name: str, schema: str | None = None) -> DataFrame:
        """All that was appended."""
        return self._rows(name, self.versions(name), schema)

    def _rows(self, name: str, found: list[str], schema: str | None) -> DataFrame:
        if not found:
            if schema is None:
                raise ValueError(f"no table {name}")
            return self.spark.createDataFrame([], schema)
        return self.spark.read.option("basePath", f"{self.root}/{name}").parquet(*found).drop("_v")

    def write(self, name: str, rows: DataFrame, partition: str | None = None, days: list[str] = ()) -> str:
        """days: dates that the rows stand for besides those that they have."""
        target = self._next(name)
        (rows.write.partitionBy(partition) if partition else rows.write).parquet(target)
        fs, path = self._fs()
        for day in days:
            fs.mkdirs(path(f"{target}/{partition}={day}"))
        return target

    def append(self, name: str, rows: DataFrame) -> str:
        return self.write(name, rows)

    def compact(self, name: str, files: int, partition: str | None = None) -> str:
        """The newest rows again, in so many files, or so many for each day."""
        rows = self.read(name, partition=partition)
        rows = rows.repartition(F.col(partition), F.pmod(F.xxhash64(*rows.columns), F.lit(files))) if partition else rows.coalesce(files)
        return self.write(name, rows, partition)

    def retain(self, name: str, keep: int) -> int:
        """Drops all but the newest versions of a table whose versions are whole."""
        fs, path = self._fs()
        return sum(bool(fs.delete(path(v), True)) for v in (self.versions(name)[:-keep] if keep else []))

    def retain_days(self, name: str, since: str, partition: str = "sim_date") -> int:
        """Drops the rows of days before since, and those that later versions replaced."""
        fs, path = self._fs()
        stands = {f for d, f in self.days(name, partition).items() if d >= since}
        return sum(bool(fs.delete(path(f), True)) for f in self._glob(f"{name}/_v=*/{partition}=*") if f not in stands and fs.globStatus(path(f"{f}/[^_]*")))
