"""The six live queries: each has its own checkpoint, and every write can be repeated.

Appending sinks (master, dead letters, alerts) rely on the file sink's log or write by batch number; views are runs in levels
(``views``), of which a reader takes the newest row of each key, or the sum of its changes.
"""

from __future__ import annotations

import contextlib
import threading
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tripledger.functions.rounding import half_up
from tripledger.operators import clean, enrich, live, utilization
from tripledger.sources import folders
from tripledger.streaming import held, views
from tripledger.streaming.earnings import earnings_changes
from tripledger.streaming.expiry import vehicle_changes
from tripledger.streaming.idle import idle_alert_stream
from tripledger.streaming.series import series_changes

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LEAST_WATERMARK_REAL_SECONDS = 5


def check_watermark(watermark: str, day_seconds: float) -> None:
    """A watermark worth less than five real seconds would drop what is merely in flight."""
    if utilization.seconds_of(watermark) * day_seconds / 86400 < LEAST_WATERMARK_REAL_SECONDS:
        raise ValueError(f"a watermark of {watermark} is too short on this clock")


@dataclass
class SpeedLayer:
    """pings: a stream of telemetry with reference_time. trigger: keyword arguments of writeStream.trigger."""

    spark: SparkSession
    pings: DataFrame
    root: str
    trigger: dict
    watermark: str = utilization.WATERMARK
    checkpoints: str | None = None  # where the queries keep theirs, if not under root

    def checkpoint(self, name: str) -> str:
        return f"{self.checkpoints or self.root + '/_checkpoints'}/{name}"

    def checked(self) -> DataFrame:
        """With each batch's rows by rejection reason counted in passing, for the progress listener."""
        by_reason = [F.count_if(F.col("rejection_reason") == r).alias(r) for r in clean.REASONS]
        return clean.validate_telemetry(self.pings, F.col("reference_time")).observe("checked", F.count(F.lit(1)).alias("rows"), *by_reason)

    def valid(self) -> DataFrame:
        return enrich.with_zone(self.checked().where("is_valid"))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _append(self, name: str, rows: DataFrame, partition: str | None = None) -> StreamingQuery:
        writer = rows.writeStream.queryName(name).format("parquet").outputMode("append").option("checkpointLocation", self.checkpoint(name)).option("path", self.path(name))
        return (writer.partitionBy(partition) if partition else writer).trigger(**self.trigger).start()

    def _each_batch(self, name: str, rows: DataFrame, mode: str, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
        return rows.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", self.checkpoint(name)).foreachBatch(write).trigger(**self.trigger).start()

    #: What makes one row of a key's rows, for each view.
    VIEWS = {
        "activity": views.newest_by(["pane_start", "zone_id"]),
        "earnings": views.summed_by(["window_start", "window_end", "zone_id"], ["cents", "completed_trips"]),
        "vehicles": views.newest_by(["vehicle_id"]),
        "alive": views.newest_by(["vehicle_id"]),
        "series": views.newest_by(["zone_id"]),
    }
    STANDING = {"earnings": "completed_trips <> 0 OR cents <> 0", "alive": "NOT removed"}

    def view(self, name: str) -> views.LeveledView:
        return views.LeveledView(self.spark, self.path(name), self.VIEWS[name], self.STANDING.get(name, "true"))

    def _view(self, name: str, rows: DataFrame, reduce: Callable[[DataFrame], DataFrame] = lambda x: x, mode: str = "update") -> StreamingQuery:
        return self._each_batch(name, rows, mode, lambda batch, k: self.view(name).add(reduce(batch), k))

    @contextlib.contextmanager
    def _rocksdb(self):
        """The state store that keyed processors need; a query keeps the settings that it started with."""
        name = "spark.sql.streaming.stateStore.providerClass"
        before = self.spark.conf.get(name, None)
        self.spark.conf.set(name, ROCKSDB)
        try:
            yield
        finally:
            self.spark.conf.unset(name) if before is None else self.spark.conf.set(name, before)

    def master(self) -> StreamingQuery:
        rows = self.checked().where("is_valid").withColumn("sim_date", F.to_date("event_time"))
        return self._append("master", rows.drop("is_valid", "rejection_reason", "reference_time"), "sim_date")

    def dlq(self) -> StreamingQuery:
        return self._append("dlq", clean.dead_letters(self.checked().where("NOT is_valid")))

    def activity(self) -> StreamingQuery:
        """The view holds panes; windows are made of them when it is read."""
        return self._view("activity", utilization.panes(self.valid(), watermark=self.watermark))

    def earnings(self) -> StreamingQuery:
        """The view holds changes of windows: a trip's fare moves with its last ping."""
        changed = lambda rows: utilization.zone_earnings(rows).select("window_start", "window_end", "zone_id", F.round(F.col("earnings") * 100).cast("long").alias("cents"), "completed_trips")
        with self._rocksdb():
            return self._view("earnings", earnings_changes(self.valid(), self.watermark), changed)

    def series(self) -> StreamingQuery:
        with self._rocksdb():
            return self._view("series", series_changes(self.valid(), self.watermark), mode="append")

    def vehicles(self) -> StreamingQuery:
        return self._view("vehicles", self.valid(), live.vehicle_state)

    def alive(self) -> StreamingQuery:
        """Vehicles whose last ping is not too long before the watermark; the others' removals are rows as well."""
        with self._rocksdb():
            return self._view("alive", vehicle_changes(self.valid(), self.watermark))

    def late(self) -> StreamingQuery:
        """Valid pings older than the watermark of the batches before, in a table of their own, late, and all others in ontime.

        What a stateful operator would leave out silently is kept as rows. The watermark is a table of the latest event time up to each batch, so a batch
        that is written again is split as it was.
        """
        delay = utilization.seconds_of(self.watermark)

        def write(batch: DataFrame, k: int) -> None:
            marks, spark = f"{self.path('marks')}", self.spark
            known = [n for n in (int(p.rsplit("/", 2)[1].removeprefix("v=")) for p in folders.matching(spark, f"{marks}/v=*/_SUCCESS")) if n < k]
            before = spark.read.schema("latest timestamp").parquet(f"{marks}/v={max(known):012d}") if known else spark.createDataFrame([(None,)], "latest timestamp")
            batch.persist()
            try:
                mark = before.agg(F.max("latest").alias("latest")).select((F.col("latest") - F.expr(f"INTERVAL {delay} SECONDS")).alias("_mark"))
                split = batch.crossJoin(F.broadcast(mark))  # one row
                is_late = F.coalesce(F.col("event_time") < F.col("_mark"), F.lit(False))
                for name, rows in (("late", split.where(is_late)), ("ontime", split.where(~is_late))):
                    rows.drop("_mark").write.mode("overwrite").parquet(f"{self.path(name)}/batch={k}")
                before.unionByName(batch.select(F.col("event_time").alias("latest"))).agg(F.max("latest").alias("latest")).coalesce(1).write.mode("overwrite").parquet(f"{marks}/v={k:012d}")
            finally:
                batch.unpersist()
            for old in (n for n in known if n < k - 1):
                folders.drop(spark, f"{marks}/v={old:012d}")

        return self._each_batch("late", self.valid(), "append", write)

    def idle(self) -> StreamingQuery:
        """One query, two sinks: the durable alert log first, then the feed; the batch is computed once."""
        def write(batch: DataFrame, k: int) -> None:
            batch.persist()
            try:
                batch.write.mode("overwrite").parquet(f"{self.path('alerts')}/batch={k}")
                batch.orderBy(F.col("raised_at_sim").desc()).limit(200).write.mode("overwrite").parquet(f"{self.path('alert_feed')}/batch={k}")
            finally:
                batch.unpersist()

        with self._rocksdb():
            return self._each_batch("idle", idle_alert_stream(self.valid(), self.watermark), "append", write)

    def start(self, names: list[str]) -> list[StreamingQuery]:
        return [getattr(self, name)() for name in names]

    def activity_windows(self) -> DataFrame:
        return utilization.slid(self.view("activity").read())

    def earnings_windows(self) -> DataFrame:
        rows = self.view("earnings").read()
        return rows.select("window_start", "window_end", "zone_id", half_up(F.col("cents") / F.lit(1e2), 2).alias("earnings"), "completed_trips")

    def earnings_series(self) -> DataFrame:
        """zone_id, age and point, as live.earnings_series."""
        rows = self.view("series").read().select("zone_id", F.posexplode(F.arrays_zip("ends", "cents")).alias("i", "p"))
        point = F.concat_ws(":", F.col("p.ends").cast("string"), (F.col("p.cents").cast("decimal(16,0)") / 100).cast("decimal(14,2)").cast("string"))
        return rows.select("zone_id", (F.col("i") + 1).alias("age"), point.alias("point"))

    def earnings_in_state(self, batch: int | None = None) -> DataFrame:
        """What the series' processor holds, without the view."""
        return held.earnings_held(self.spark, self.checkpoint("series"), batch=batch)

    def newest_vehicles(self) -> DataFrame:
        return self.view("vehicles").read()


def finished(queries: list[StreamingQuery]) -> None:
    for q in queries:
        q.awaitTermination()


class Progress(StreamingQueryListener):
    """Progress of every query as a table: rates, rows, state, watermark lag, late rows, and what the plan observed (rows by rejection reason).

    Rows wait here until there are ``every`` of them and then go to a folder of the table, so the driver holds a bounded number.
    """

    def __init__(self, spark: SparkSession, root: str, every: int = 20):
        self.spark, self.root, self.every = spark, root.rstrip("/"), every
        self.rows: list[tuple] = []
        self.lock = threading.Lock()

    SCHEMA = "query string, batch bigint, at string, kind string, input_rows_per_s double, processed_rows_per_s double, batch_s double, rows_in bigint, rows_out bigint, state_rows bigint, late_rows bigint, watermark_lag_s double, observed map<string,bigint>"

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self._add(self.of(event.progress))

    def onQueryIdle(self, event) -> None:
        self._add((None, None, event.timestamp, "idle", *[None] * 9))

    def onQueryTerminated(self, event) -> None:
        pass

    @staticmethod
    def of(p) -> tuple:
        number = lambda x: x if x is not None and x == x and x >= 0 else None
        times = p.eventTime or {}
        lag = None
        if times.get("max") and times.get("watermark"):
            from datetime import datetime

            lag = (datetime.fromisoformat(times["max"]) - datetime.fromisoformat(times["watermark"])).total_seconds()
        state = p.stateOperators or []
        took = (p.durationMs or {}).get("triggerExecution")
        return (
            p.name, p.batchId, p.timestamp, "progress", number(p.inputRowsPerSecond), number(p.processedRowsPerSecond), None if took is None else took / 1e3, number(p.numInputRows),
            number(p.sink.numOutputRows), sum(s.numRowsTotal for s in state), sum(s.numRowsDroppedByWatermark for s in state), lag,
            {k: int(v) for row in (p.observedMetrics or {}).values() for k, v in row.asDict().items() if v is not None},
        )

    def _add(self, row: tuple) -> None:
        with self.lock:
            self.rows.append(row)
            full = len(self.rows) >= self.every
        if full:
            self.flush()

    def flush(self) -> None:
        with self.lock:
            rows, self.rows = self.rows, []
        if rows:
            self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode("append").parquet(self.root)

    def table(self) -> DataFrame:
        """All that has been reported so far."""
        self.flush()
        if not folders.matching(self.spark, self.root):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.root)


def rejections(progress: DataFrame) -> DataFrame:
    """query, rejection_reason, n from the progress of queries that observed them; reasons that never occurred are left out."""
    rows = progress.where("kind = 'progress'").select("query", F.explode("observed").alias("rejection_reason", "n")).where(F.col("rejection_reason") != "rows")
    return rows.groupBy("query", "rejection_reason").agg(F.sum("n").alias("n")).where("n > 0")


def stalled(progress: DataFrame, now: DataFrame, seconds: int = 120) -> DataFrame:
    """Queries without progress for so long. now: one row of now, a timestamp."""
    last = progress.where("query IS NOT NULL").groupBy("query").agg(F.max(F.to_timestamp("at")).alias("last_progress"))
    return last.crossJoin(F.broadcast(now.select("now"))).where(F.unix_micros("now") - F.unix_micros("last_progress") > seconds * 1_000_000).drop("now")
