"""The vehicle-operations queries, each over the driver's tables."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripledger import zones
from tripledger.functions import clock
from tripledger.functions.rounding import half_up, mean_of
from tripledger.operators import clean, control, enrich, idle, live, mart, merge, profitability, reconcile, utilization
from tripledger.sources import adapters, files, keyed, log
from tripledger.streaming import held, jobs

CLOCK = clock.SimClock(epoch_sim=1767225600.0, epoch_wall=1704067200.0, day_seconds=300.0)


class Tables:
    """The steps that queries share, over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def pings(self):
        return adapters.telemetry(self.spark, self.sf_dir)

    def checked(self):
        return clean.validate_telemetry(self.pings(), F.col("reference_time"))

    def valid(self):
        return clean.split_valid(self.checked())[0]

    def rejected(self):
        return clean.split_valid(self.checked())[1]

    def zoned(self):
        return enrich.with_zone(self.valid())

    def expenses(self):
        return adapters.expenses(self.spark, self.sf_dir)

    def registry(self):
        return clean.latest_per_key(adapters.registry_changes(self.spark, self.sf_dir), "vehicle_id")

    def totals(self):
        return profitability.daily_totals(self.valid())

    def joined(self):
        return profitability.join_with_expenses(self.totals(), self.expenses())

    def profit(self):
        return profitability.compute_profit(self.joined())

    def pnl(self):
        return profitability.vehicle_daily_pnl(self.valid(), self.expenses())

    def hourly(self):
        return utilization.zone_hourly(self.zoned())

    def mart_hourly(self):
        return self.hourly().where("zone_id IS NOT NULL")

    def activity(self):
        return utilization.zone_activity(self.zoned())

    def newest_activity(self):
        """Each zone's newest window, from the pings that it can hold."""
        return live.newest_window(self.exact_activity(live.last_pane(self.zoned())))

    def exact_activity(self, pings=None):
        p = self.zoned() if pings is None else pings
        out = p.groupBy(F.window("event_time", utilization.WINDOW, utilization.SLIDE).alias("w"), "zone_id").agg(
            F.count_distinct("vehicle_id").alias("active_vehicles"), F.count_distinct(F.when(F.col("status") == "on_trip", F.col("trip_id"))).alias("trips"),
            half_up(mean_of("speed_kmh", 6), 1).alias("avg_speed_kmh"), half_up(utilization.idle_ratio(), 4).alias("idle_ratio"), F.count(F.lit(1)).alias("pings"),
        )
        return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "zone_id", "active_vehicles", "trips", "avg_speed_kmh", "idle_ratio", "pings")

    def earnings(self):
        return utilization.zone_earnings(utilization.trip_completions(self.zoned()))

    def alerts(self):
        return idle.idle_alerts(self.zoned())

    def live_zones(self):
        a, e = self.newest_activity(), live.newest_window(self.earnings())
        return a.join(e.select("zone_id", "earnings"), "zone_id", "left").withColumn("earnings", F.coalesce("earnings", F.lit(0.0)))

    def snapshot(self):
        """The last window of each zone's hour."""
        rows = self.exact_activity()
        hour = [F.to_date("window_end").alias("_day"), F.hour("window_end").alias("_hour")]
        a = rows.groupBy("zone_id", *hour).agg(F.max_by(F.struct(*[c for c in rows.columns if c != "zone_id"]), "window_end").alias("r")).select("zone_id", "r.*")
        both = a.join(self.earnings().select("window_end", "zone_id", "earnings"), ["window_end", "zone_id"], "left").withColumn("earnings", F.coalesce("earnings", F.lit(0.0)))
        return mart.speed_snapshot(both, 15, F.col("window_end"))

    def span(self):
        """One row: first and last day of the hourly table."""
        return self.zoned().agg(F.min("sim_date").alias("first"), F.max("sim_date").alias("last"))

    def run_bounds(self):
        return self.span().select(F.col("first").alias("epoch"), F.col("last").alias("today"), F.lit(None).cast("date").alias("hwm"))

    def asked(self):
        """A range that has every owner, around the last day of the data."""
        at = lambda n, name: F.date_add("last", n).alias(name)
        return self.span().select(at(-4, "hwm"), at(-8, "first"), at(2, "last"), at(-1, "today"))

    def keyed(self, name, key):
        return keyed.KeyedTable(self.spark, scratch(self.spark, name), key, "sim_date")

    def store(self, name):
        return mart.Store(self.spark, scratch(self.spark, name))


def day(c="sim_date"):
    return F.date_format(c, "yyyy-MM-dd").alias("sim_date")


def us(c, name):
    return F.unix_micros(c).alias(name)


def end_s(c="window_end"):
    return F.unix_timestamp(c).alias(f"{c}_s")


def six(*names):
    return [half_up(c, 6).alias(c) for c in names]


def pnl_columns(df: DataFrame, *more: str) -> DataFrame:
    return df.select(
        "vehicle_id", day(), "trips", *six("telemetry_distance_km", "paid_distance_km", "deadhead_distance_km", "on_trip_hours", "idle_hours"), "pings", "revenue", "fuel_cost", "maintenance_cost",
        "expense_status", "distance_variance_pct", "net_profit", "profit_per_km", "margin_pct", "utilization_pct", "rolling_avg_profit", "history_days", "profit_slope", "classification", *more,
    )


def scratch(spark: SparkSession, name: str) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def q_wire(t: Tables) -> DataFrame:
    log = t.pings().select("event_id", "vehicle_id", F.col("vehicle_id").cast("binary").alias("payload"))
    out = log.withColumn("wire", files.to_wire(F.col("payload"), 7))
    return out.select("event_id", "vehicle_id", F.length("wire").alias("wire_bytes"), (files.from_wire(F.col("wire")) == F.col("payload")).alias("same"))


def q_decode(t: Tables) -> DataFrame:
    return files.decode(files.log_of(t.pings())).select("event_id", "vehicle_id", "trip_id", "status", "fare", us("event_time", "event_us"), "source_partition", "source_offset")


def q_profile(t: Tables) -> DataFrame:
    return files.profile(files.log_of(t.pings())).select("n_rows", "null_coordinates", "null_trips", "wrong_keys", us("first_event", "first_event_us"), us("last_event", "last_event_us"), "n_idle", "n_enroute", "n_on_trip")


def expense_lines(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Daily expense files as text lines and headers, the third digit of the day choosing what is wrong with them."""
    e = t.expenses().withColumn("day", F.datediff("sim_date", F.lit("2024-01-01").cast("date")))
    e = e.select(
        F.concat(F.lit("day-"), F.lpad(F.col("day").cast("string"), 2, "0")).alias("file"), "day", "vehicle_id", F.coalesce(F.col("fuel_cost").cast("string"), F.lit("")).alias("fuel_cost"),
        F.col("maintenance_cost").cast("string").alias("maintenance_cost"), F.col("partner_distance_km").cast("string").alias("distance_covered"),
    )
    kind = F.col("day") % 10
    first = e.groupBy("file", "day").agg(F.min("vehicle_id").alias("first"))
    e = e.join(first, ["file", "day"])
    at_first = F.col("vehicle_id") == F.col("first")
    again = e.where((kind == 4) & at_first)
    lines = e.withColumns({
        "vehicle_id": F.when((kind == 3) & at_first, F.lit(" ")).otherwise(F.col("vehicle_id")),
        "maintenance_cost": F.when((kind == 5) & at_first, F.lit("-1.5")).when((kind == 6) & at_first, F.lit("n/a")).otherwise(F.col("maintenance_cost")),
    }).unionByName(again)
    header = F.array(*[F.lit(c) for c in clean.EXPENSE_COLUMNS])
    headers = first.select("file", F.when(kind == 1, None).when(kind == 2, F.array_remove(header, "fuel_cost")).otherwise(header).alias("columns"))
    return lines.select("file", "vehicle_id", "fuel_cost", "maintenance_cost", "distance_covered"), headers


def q_calendar(t: Tables) -> DataFrame:
    """The days of the data and two on either side, which have no file."""
    verdicts = clean.expense_file_verdicts(*expense_lines(t)).withColumn("sim_date", F.date_add(F.lit("2024-01-01").cast("date"), F.substring("file", 5, 2).cast("int")))
    around = t.span().select(F.date_sub("first", 2).alias("first"), F.date_add("last", 2).alias("last"))
    return clean.expense_calendar(mart.calendar(around).select("sim_date"), verdicts).select(day(), "verdict", "dq_status")


def q_read_expenses(t: Tables) -> DataFrame:
    """The partner's files, a folder for each day, written as CSV and read back by the declared schema; a day without a file adds nothing."""
    root = scratch(t.spark, "landing")
    rows = t.expenses().select("vehicle_id", "fuel_cost", "maintenance_cost", F.col("partner_distance_km").alias("distance_covered"), "service_flag", F.lit("2024-02-01T00:00:00").alias("submitted_at"), "partner_id", "sim_date")
    rows.repartition("sim_date").write.partitionBy("sim_date").option("header", True).csv(root)
    found = files.read_expenses(t.spark, f"{root}/sim_date=*").unionByName(files.read_expenses(t.spark, f"{root}/sim_date=1999-01-01", "1999-01-01"))
    return found.select("vehicle_id", "fuel_cost", "maintenance_cost", "partner_distance_km", "service_flag", "partner_id", day())


def q_quarantine(t: Tables) -> DataFrame:
    """Corrupt files go to a stored table with the reason, and are read no more."""
    lines, headers = expense_lines(t)
    store = t.store("quarantine")
    store.append("quarantine", clean.quarantined(lines, clean.expense_file_verdicts(lines, headers))[1])
    bad = store.read_all("quarantine")
    good = lines.join(bad.select("file").distinct(), "file", "left_anti").withColumn("reason", F.lit("kept"))
    return good.select("reason").unionByName(bad.select("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def q_scan_day(t: Tables) -> DataFrame:
    root = scratch(t.spark, "master")
    t.valid().drop("is_valid", "rejection_reason", "reference_time").write.partitionBy("sim_date").parquet(root)
    return files.scan_day(files.read_master(t.spark, root), "2024-01-15").select("event_id", "vehicle_id", "status", day(), "source_partition", "source_offset")


def q_zone_dim(t: Tables) -> DataFrame:
    seen = t.zoned().groupBy("zone_id").agg(F.count(F.lit(1)).alias("pings"))
    return zones.zone_table(t.spark).join(seen, "zone_id", "left").withColumn("pings", F.coalesce("pings", F.lit(0)))


def q_activity(t: Tables) -> DataFrame:
    """Without the approximate counts, which SQL cannot repeat; tests hold them against exact ones."""
    return t.activity().select(end_s(), "zone_id", "avg_speed_kmh", "idle_ratio", "pings")


def q_status(t: Tables) -> DataFrame:
    p = restated_pnl(t).agg(F.date_format(F.max("sim_date"), "yyyy-MM-dd").alias("latest_fact"), F.count(F.lit(1)).alias("pnl_rows"), F.count_if(F.col("restatement_count") > 0).alias("restated_rows"))
    z = t.mart_hourly().agg(F.count(F.lit(1)).alias("zone_rows"))
    return p.crossJoin(F.broadcast(z)).select("latest_fact", "pnl_rows", "zone_rows", "restated_rows")  # one row each


def labelled(one: DataFrame, names: dict[str, str]) -> DataFrame:
    """A row's columns as rows of what and n. names: column to label."""
    return one.select(F.inline(F.array(*[F.struct(F.lit(what).alias("what"), F.col(c).cast("long").alias("n")) for c, what in names.items()])))


def q_batch_check(t: Tables) -> DataFrame:
    pnl = restated_pnl(t).agg(F.count(F.lit(1)).alias("a"), F.count_distinct("sim_date").alias("b"), F.count_if(F.col("restatement_count") > 0).alias("c"))
    zh = t.hourly().agg(F.count_if(F.col("zone_id").isNotNull()).alias("a"), F.count_distinct("sim_date").alias("b"), F.datediff(F.max("sim_date"), F.lit("1970-01-01").cast("date")).alias("c"))
    return labelled(pnl, {"a": "pnl rows", "b": "pnl dates", "c": "restated rows"}).unionByName(labelled(zh, {"a": "zone rows", "b": "zone dates", "c": "watermark day"}))


def q_run_totals(t: Tables) -> DataFrame:
    kinds = t.pnl().groupingSets([["expense_status"], ["classification"]], "expense_status", "classification").agg(F.count(F.lit(1)).alias("n"))
    zh = t.hourly().agg(F.count_distinct("zone_id").alias("a"), F.count_distinct("sim_date", "sim_hour").alias("b"))
    return kinds.select(F.coalesce("expense_status", "classification").alias("what"), "n").unionByName(labelled(zh, {"a": "zones", "b": "hours"}))


def q_alert_json(t: Tables) -> DataFrame:
    a = idle.alert_envelopes(t.alerts())
    text = a.select(F.to_json("envelope").alias("j")).unionByName(a.select(F.lit("{broken").alias("j")))
    back = text.select(F.from_json("j", "alert_id string, vehicle_id string, severity string", {"mode": "PERMISSIVE"}).alias("a"))
    return back.where("a.alert_id IS NOT NULL").select("a.*")


def q_stale(t: Tables) -> DataFrame:
    s, now = idle.idle_states(t.zoned()), t.zoned().agg(F.max("event_time").alias("now"))
    return s.crossJoin(F.broadcast(now)).select("vehicle_id", "last_status", us("idle_since_sim", "idle_since_us"), idle.is_stale(F.col("idle_since_sim"), F.col("now"), 120).alias("stale"))  # now is one row


def q_ttl(t: Tables) -> DataFrame:
    p = t.zoned()
    state, now = live.vehicle_state(p), p.agg(F.max("event_time").alias("now"))
    return live.alive(state.crossJoin(F.broadcast(now)), "updated_at_sim", F.col("now"), live.VEHICLE_TTL_MINUTES).select("vehicle_id", us("updated_at_sim", "updated_us"))  # now is one row


def q_upsert_hourly(t: Tables) -> DataFrame:
    """Two runs: the second merges what the first wrote from the tenth day on, which rewrites those days' files only."""
    store, stored = t.store("mart"), t.keyed("fact_zone_hourly", ["zone_id", "sim_date", "sim_hour"])
    store.write("run", t.mart_hourly())
    rows = store.read("run")
    stored.write(rows.where("sim_date <= DATE '2024-01-20'").withColumn("job_run_id", F.lit("run-1")))
    new = rows.where("sim_date >= DATE '2024-01-10'").withColumn("job_run_id", F.lit("run-2"))
    for _ in range(2):  # the second time changes nothing
        stored.merge(new, mart.upsert)
    stored.vacuum()
    return stored.read().select("zone_id", day(), "sim_hour", "trips", "earnings", "job_run_id")


def q_merge_files(t: Tables) -> DataFrame:
    """A day is merged into the hourly mart: which days' files are where they were, and the rows of each."""
    store, stored = t.store("mart"), t.keyed("fact_zone_hourly", ["zone_id", "sim_date", "sim_hour"])
    store.write("run", t.mart_hourly().withColumn("job_run_id", F.lit("run-1")))
    stored.write(store.read("run"))
    done = stored.merge(stored.read(["2024-01-15"]).withColumns({"trips": F.col("trips") + 1, "job_run_id": F.lit("run-2")}), mart.upsert)
    before, after = stored.manifest(done.version - 1), stored.manifest(done.version)
    stays = after.join(before.select("file", F.lit(True).alias("stays")), "file", "left")
    by_day = stays.groupBy("sim_date").agg(F.every(F.coalesce("stays", F.lit(False))).alias("kept"), F.sum("n_rows").alias("n_rows"))
    sums = stored.read().groupBy("sim_date").agg(F.sum("trips").alias("trips"), F.count_if(F.col("job_run_id") == "run-2").alias("of_run_2"))
    return by_day.join(sums, "sim_date").select(day(), "kept", "n_rows", "trips", "of_run_2")


def restated_pnl(t: Tables) -> DataFrame:
    """The P&L of two runs that overlap from the tenth to the twentieth day; the second is done twice, which restates nothing more."""
    store, stored = t.store("mart"), t.keyed("fact_pnl", ["vehicle_id", "sim_date"])
    store.write("run", t.pnl())
    rows = store.read("run")
    first = rows.where("sim_date <= DATE '2024-01-20'").withColumn("job_run_id", F.lit("run-1"))
    stored.write(first.withColumns({"restated_at": F.lit(None).cast("timestamp"), "restatement_count": F.lit(0)}))
    new = rows.where("sim_date >= DATE '2024-01-10'").withColumn("job_run_id", F.lit("run-2"))
    for _ in range(2):
        stored.merge(new, lambda old, incoming, key: mart.upsert_restated(old, incoming, key, F.current_timestamp()))
    return stored.read()


def q_upsert_pnl(t: Tables) -> DataFrame:
    return restated_pnl(t).select("vehicle_id", day(), "net_profit", "job_run_id", "restatement_count", F.col("restated_at").isNotNull().alias("restated"))


def q_restatement_log(t: Tables) -> DataFrame:
    """Each restated day's marker, once, though the run logs twice."""
    store, rows = t.store("log"), mart.restatements(restated_pnl(t), "run-2")
    for _ in range(2):
        store.append("restatement_log", mart.unmarked(rows, store.read_all("restatement_log", "marker_key string")))
    return store.read_all("restatement_log").select(day(), "marker_key", "triggered_run", "n_rows")


def q_trend_refresh(t: Tables) -> DataFrame:
    """The partner doubles a day's maintenance: that day's moments are merged, and it and the six days after it get their trend anew from the moments of those days and
    the six before; all other days stand. No row of the P&L is read again but the restated day's."""
    store, kept, d = t.store("refresh"), t.keyed("moments", ["vehicle_id", "sim_date"]), F.col("sim_date")
    trend = lambda rows: profitability.classify(profitability.trend_of_moments(rows))
    rows = t.joined()
    kept.write(profitability.moments(profitability.compute_profit(rows)))
    store.write("trend", trend(kept.read()), partition="sim_date")
    changed = rows.where(d == F.lit("2024-01-15").cast("date")).withColumn("maintenance_cost", F.col("maintenance_cost") * 2)
    store.write("restated", profitability.moments(profitability.compute_profit(changed)))
    kept.merge(store.read("restated"), mart.upsert)
    near = [f"2024-01-{k:02d}" for k in range(9, 22)]
    store.write("trend", trend(kept.read(near)).where(d.isin(*(F.lit(x).cast("date") for x in near[6:]))), partition="sim_date", days=near[6:])
    return store.read("trend", partition="sim_date").select("vehicle_id", day(), "net_profit", "rolling_avg_profit", "history_days", "profit_slope", "classification")


def q_recompute(t: Tables) -> DataFrame:
    """Derived rows written for all days, then again for some: the days written again have the new rows only, the others stand."""
    store, d = t.store("derived"), F.col("sim_date")
    store.write("source", reconcile.reconcile_zone(t.snapshot(), t.hourly()))
    deltas = store.read("source")
    store.write("delta", deltas.withColumn("run", F.lit("run-1")), partition="sim_date")
    some = d.between(F.lit("2024-01-05").cast("date"), F.lit("2024-01-09").cast("date")) & (F.col("metric") == "idle_ratio")
    store.write("delta", deltas.where(some).withColumn("run", F.lit("run-2")), partition="sim_date", days=["2024-01-05", "2024-01-06", "2024-01-07", "2024-01-08", "2024-01-09", "2024-01-10"])
    return store.read("delta", partition="sim_date").select(day(), "zone_id", "metric", "speed_value", "batch_value", "delta_pct", "run")


def q_retention(t: Tables) -> DataFrame:
    """Days written in two runs, made into fewer files, and those older than ten days dropped."""
    store, rows = t.store("tiers"), t.mart_hourly()
    store.write("hourly", rows, partition="sim_date")
    store.write("hourly", rows.where("sim_date >= DATE '2024-01-25'").withColumn("trips", F.col("trips") + 100), partition="sim_date")
    store.compact("hourly", 1, partition="sim_date")
    store.retain_days("hourly", "2024-01-20")
    return store.read("hourly", partition="sim_date").groupBy("sim_date").agg(F.count(F.lit(1)).alias("n"), F.sum("trips").alias("trips")).select(day(), "n", "trips")


def q_zone_history(t: Tables) -> DataFrame:
    hwm = t.span().select(F.date_sub("last", 1).alias("hwm"))
    return merge.zone_history(t.hourly(), t.snapshot(), hwm, 48).withColumn("sim_date", day())


def q_stalled(t: Tables) -> DataFrame:
    """Each source partition as a query, whose pings are its progress, held against the last ping of all."""
    progress = t.pings().select(F.concat(F.lit("query-"), F.col("source_partition").cast("string")).alias("query"), F.col("event_time").alias("at"))
    return jobs.stalled(progress, progress.agg(F.max("at").alias("now"))).select("query", us("last_progress", "last_progress_us"))


def q_hwm(t: Tables) -> DataFrame:
    mark = lambda d: t.spark.range(1).select(F.lit(d).cast("date").alias("sim_date"))
    done = t.hourly().select("sim_date")
    a = mart.advance_high_water_mark(mark("2024-01-12"), done).select(F.date_format("sim_date", "yyyy-MM-dd").alias("high_water_mark"))
    b = mart.advance_high_water_mark(mark("2024-06-01"), done).select(F.date_format("sim_date", "yyyy-MM-dd").alias("never_backwards"))
    return a.crossJoin(F.broadcast(b))  # one row each


def q_dq_log(t: Tables) -> DataFrame:
    """Two runs append their results to the log."""
    n, store = F.count_if(~F.col("is_valid")).cast("double"), t.store("dq")
    checks = t.checked().groupBy("sim_date").agg(n.alias("observed")).select("sim_date", F.lit("rejected_rows").alias("check_name"), F.when(F.col("observed") > 10, "WARN").otherwise("PASS").alias("status"), "observed", F.lit(10.0).alias("threshold"), F.lit(None).cast("string").alias("detail"))
    for run in ("run-1", "run-2"):
        store.append("dq_run_log", mart.dq_rows(checks, run))
    return store.read_all("dq_run_log").select("job_run_id", day(), "check_name", "status", "observed", "threshold")


def q_owners(t: Tables) -> DataFrame:
    return merge.date_ownership(t.asked()).select(day(), "owner")


def q_merged(t: Tables) -> DataFrame:
    daily = mart.zone_daily(t.mart_hourly())
    out = merge.merged_utilization(merge.date_ownership(t.asked()), daily, t.live_zones())
    return out.select(day(), "zone_id", "trips", "earnings", "source", "exact", "utilization_pct")


def q_envelope(t: Tables) -> DataFrame:
    return merge.envelope(merge.date_ownership(t.asked())).drop("missing_stores")


def q_degraded(t: Tables) -> DataFrame:
    owners = merge.date_ownership(t.asked())
    rows = merge.merged_utilization(owners, mart.zone_daily(t.mart_hourly()), None)
    return rows.crossJoin(F.broadcast(merge.envelope(owners, ("speed",)).select("missing_stores"))).select(day(), "zone_id", "source", "missing_stores")  # one row


def q_watermark_age(t: Tables) -> DataFrame:
    """Held against four days after the last ping."""
    m = t.hourly().agg(F.max("sim_date").alias("d")).crossJoin(F.broadcast(t.pings().agg(F.date_add(F.to_date(F.max("event_time")), 4).alias("today"))))  # one row each
    age = F.datediff("today", "d")
    return m.select(F.date_format("d", "yyyy-MM-dd").alias("high_water_mark"), age.alias("age_days"), (age > 2).alias("alert"))


def q_complete(t: Tables) -> DataFrame:
    return control.complete_dates(t.run_bounds(), 7).select(day())


def q_next(t: Tables) -> DataFrame:
    return control.next_batch_date(t.run_bounds()).select(day())


def q_backfill(t: Tables) -> DataFrame:
    """Two ranges of days that overlap, each in one plan, the trend's six days of history before it included, written by day."""
    store, d = t.store("backfill"), F.col("sim_date")
    for run, first, last in (("run-1", "2024-01-08", "2024-01-14"), ("run-2", "2024-01-12", "2024-01-18")):
        a, b = F.lit(first).cast("date"), F.lit(last).cast("date")
        days = d.between(F.date_sub(a, profitability.TREND_DAYS - 1), b)
        rows = profitability.vehicle_daily_pnl(t.valid().where(days), t.expenses().where(days)).where(d >= a)
        store.write("fact_pnl", rows.withColumn("job_run_id", F.lit(run)), partition="sim_date")
    rows = store.read("fact_pnl", partition="sim_date")
    return pnl_columns(rows, "job_run_id")


def speed_layer(t: Tables, names: list[str]) -> jobs.SpeedLayer:
    layer = jobs.SpeedLayer(t.spark, adapters.telemetry_stream(t.spark, t.sf_dir), scratch(t.spark, "stream"), {"availableNow": True})
    jobs.finished(layer.start(names))
    return layer


def q_stream_master(t: Tables) -> DataFrame:
    rows = files.read_master(t.spark, speed_layer(t, ["master"]).path("master"))
    return rows.groupBy("sim_date").agg(F.count(F.lit(1)).alias("n"), F.sum("source_offset").alias("offsets")).select(day(), "n", "offsets")


def q_stream_log_master(t: Tables) -> DataFrame:
    """The pings as a log of framed records, read by offsets from the earliest, decoded, validated and kept by day."""
    root = scratch(t.spark, "log")
    sent = t.pings()
    records = files.log_of(sent).drop("timestamp")
    times = sent.select(F.col("source_partition").alias("partition"), F.col("source_offset").alias("offset"), F.col("reference_time").alias("timestamp"))
    log.write_log(records.join(times, ["partition", "offset"]), root)
    pings = files.decode(log.stream_log(t.spark, root)).withColumnRenamed("log_timestamp", "reference_time")
    layer = jobs.SpeedLayer(t.spark, pings, scratch(t.spark, "stream"), {"availableNow": True})
    jobs.finished(layer.start(["master"]))
    rows = files.read_master(t.spark, layer.path("master"))
    return rows.groupBy("sim_date").agg(F.count(F.lit(1)).alias("n"), F.sum("source_offset").alias("offsets")).select(day(), "n", "offsets")


def q_stream_dlq(t: Tables) -> DataFrame:
    rows = t.spark.read.parquet(speed_layer(t, ["dlq"]).path("dlq"))
    return rows.groupBy(F.col("envelope.rejection_reason").alias("rejection_reason")).agg(F.count(F.lit(1)).alias("n"))


def q_stream_activity(t: Tables) -> DataFrame:
    rows = speed_layer(t, ["activity"]).activity_windows()
    return rows.select(end_s(), "zone_id", "avg_speed_kmh", "idle_ratio", "pings")


def q_stream_earnings(t: Tables) -> DataFrame:
    """A trip's fare moves to the windows of its last ping, so the view holds what the batch computes."""
    return speed_layer(t, ["earnings"]).earnings_windows().select(end_s(), "zone_id", "earnings", "completed_trips")


def q_stream_earnings_total(t: Tables) -> DataFrame:
    """A trip's fare counts in three windows."""
    return speed_layer(t, ["earnings"]).earnings_windows().agg(F.sum("completed_trips").alias("completed_trips"), half_up(F.sum("earnings"), 2).alias("earnings"))


def q_stream_series(t: Tables) -> DataFrame:
    return speed_layer(t, ["series"]).earnings_series()


def q_stream_replay(t: Tables) -> DataFrame:
    """The whole stream once more with its checkpoint lost: what the view has of a batch stays as it is, and sums do not grow."""
    layer = speed_layer(t, ["earnings"])
    jobs.finished(replace(layer, checkpoints=scratch(t.spark, "checkpoints")).start(["earnings"]))
    return layer.earnings_windows().select(end_s(), "zone_id", "earnings", "completed_trips")


def q_reconcile_state(t: Tables) -> DataFrame:
    """The hours against what the stream's state holds, read from its checkpoint."""
    ends = held.hour_ends(speed_layer(t, ["series"]).earnings_in_state())
    return reconcile.reconcile_earnings(ends, t.hourly()).withColumn("sim_date", day())


def q_stream_vehicles(t: Tables) -> DataFrame:
    return speed_layer(t, ["vehicles"]).newest_vehicles().select("vehicle_id", "status", us("updated_at_sim", "updated_us"))


def q_stream_idle(t: Tables) -> DataFrame:
    rows = t.spark.read.parquet(speed_layer(t, ["idle"]).path("alerts"))
    return rows.select("alert_id", "vehicle_id", "severity", us("idle_since_sim", "idle_since_us"), us("raised_at_sim", "raised_at_us"))


def watched(t: Tables, run) -> jobs.Progress:
    """The progress of the queries that run() starts and waits for."""
    listener = jobs.Progress(t.spark, scratch(t.spark, "progress"))
    t.spark.streams.addListener(listener)
    try:
        run()
        t.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        t.spark.streams.removeListener(listener)
    return listener


def q_stream_progress(t: Tables) -> DataFrame:
    rows = watched(t, lambda: speed_layer(t, ["vehicles"])).table().where("kind = 'progress'").groupBy("query")
    return rows.agg(F.sum("rows_in").alias("rows_in"), F.sum("late_rows").alias("late_rows"))


def q_stream_rejections(t: Tables) -> DataFrame:
    """Rows by rejection reason, counted by the running query in the pass that splits them."""
    return jobs.rejections(watched(t, lambda: speed_layer(t, ["master"])).table()).select("rejection_reason", "n")


def q_stream_alive(t: Tables) -> DataFrame:
    """The vehicles that the stream has not removed when it has seen all pings."""
    layer = jobs.SpeedLayer(t.spark, adapters.telemetry_stream(t.spark, t.sf_dir), scratch(t.spark, "stream"), {"availableNow": True}, "0 seconds")
    jobs.finished(layer.start(["alive"]))
    return layer.view("alive").read().select("vehicle_id", F.col("event_us").alias("updated_us"))


def late_parts(t: Tables) -> str:
    """A folder of event files: two halves, the last hour once more, then a part of the first half, late."""
    events, root = adapters.table(t.spark, t.sf_dir, "events"), scratch(t.spark, "late")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    ends = events.agg(F.min(us).alias("a"), F.max(us).alias("b"))
    rows = events.crossJoin(F.broadcast(ends)).withColumn("us", us)  # one row
    first = F.col("us") < F.floor((F.col("a") + F.col("b")) / 2)
    parts = (first, ~first, F.col("us") >= F.col("b") - 3_600_000_000, first & (F.col("event_type") == "view"))
    for k, part in enumerate(parts):
        rows.where(part).select(*events.columns).repartition(FILES_EACH, "event_id").write.parquet(f"{root}/events-{k}.parquet")
    return root


FILES_EACH = 2


def q_stream_late(t: Tables) -> DataFrame:
    """The events in two halves, their last hour once more, then a part of the first half, late: what the stream counts as dropped, and the windows it keeps.

    Rows are late by the watermark of the batch before, so the last hour counts twice, and the late part not at all."""
    root = late_parts(t)
    layer = jobs.SpeedLayer(t.spark, adapters.telemetry_stream(t.spark, root, FILES_EACH), f"{root}/out", {"availableNow": True})
    listener = watched(t, lambda: jobs.finished(layer.start(["activity"])))
    dropped = listener.table().agg((F.sum("late_rows") > 0).alias("late_rows_dropped"))
    return layer.activity_windows().select(end_s(), "zone_id", "pings").crossJoin(F.broadcast(dropped))  # one row


def q_stream_late_side(t: Tables) -> DataFrame:
    """The same stream's late rows as rows: the part of the last hour that is older than the watermark by then, and the whole late part."""
    root = late_parts(t)
    layer = jobs.SpeedLayer(t.spark, adapters.telemetry_stream(t.spark, root, FILES_EACH), f"{root}/out", {"availableNow": True})
    jobs.finished(layer.start(["late"]))
    return t.spark.read.parquet(layer.path("late")).groupBy("event_id", "vehicle_id").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "scan_day": q_scan_day,
    "read_expenses": q_read_expenses,
    "stream_profile": q_profile,
    "wire_roundtrip": q_wire,
    "decode_payload": q_decode,
    "zone_dim": q_zone_dim,
    "dlq_envelope": lambda t: clean.dead_letters(t.rejected()).select(
        "_key", F.col("envelope.original_payload").cast("string").alias("payload"), "envelope.rejection_reason", F.regexp_extract("envelope.rejection_detail", "^(.*?) (lat|speed|fare)=", 1).alias("detail_start"),
        "envelope.validator", us("envelope.rejected_at_sim", "rejected_at_us"), "envelope.source_topic", "envelope.source_partition", "envelope.source_offset"),
    "validate_telemetry": lambda t: t.checked().select("event_id", "rejection_reason", "is_valid"),
    "rejected_by_reason": lambda t: t.rejected().groupBy("rejection_reason").agg(F.count(F.lit(1)).alias("n")),
    "dedup_events": lambda t: clean.deduplicate(t.pings().unionByName(t.pings())).select("event_id", "vehicle_id"),
    "sim_time_of": lambda t: t.pings().select("event_id", us("event_time", "real_us"), us(clock.sim_time_of(F.col("event_time"), CLOCK), "sim_us")),
    "haversine_km": lambda t: profitability.with_segments(t.valid()).select("event_id", *six("segment_km"), "segment_minutes"),
    "expense_file_verdict": lambda t: clean.expense_file_verdicts(*expense_lines(t)),
    "expense_calendar_verdict": q_calendar,
    "quarantine_expenses": q_quarantine,
    "with_zone": lambda t: t.zoned().select("event_id", "zone_id", day()),
    "with_registry": lambda t: enrich.with_registry(t.valid(), t.registry()).select("event_id", "vehicle_id", "fuel_type", "capacity", "registry_home_zone"),
    "latest_per_key": lambda t: t.registry().select("vehicle_id", "model", "fuel_type", "capacity", "home_zone", "offset"),
    "scd2_vehicle": lambda t: mart.scd2(adapters.registry_changes(t.spark, t.sf_dir), "vehicle_id", "offset", ["fuel_type", "capacity"]),
    "dim_date": lambda t: mart.calendar(t.span()).select(day(), "day_of_week", "is_weekend"),
    "zone_activity": q_activity,
    "zone_earnings": lambda t: t.earnings().select(end_s(), "zone_id", "earnings", "completed_trips"),
    "zone_hourly_exact": lambda t: t.hourly().select("zone_id", day(), "sim_hour", "trips", "active_vehicles", "idle_ratio", "avg_speed_kmh", "earnings"),
    "dedup_trips": lambda t: utilization.first_pings(t.zoned()).select("trip_id", "fare"),
    "fleet_snapshot": lambda t: utilization.fleet_snapshot(t.exact_activity()).select(end_s(), "active_vehicles", "trips", "idle_ratio", "avg_speed_kmh"),
    "trip_completions": lambda t: utilization.trip_completions(t.zoned()).select("trip_id", day(), "event_id", "zone_id", "fare"),
    "reconstruct_trips": lambda t: profitability.reconstruct_trips(t.valid()).select("vehicle_id", day(), "trips", *six("telemetry_distance_km", "paid_distance_km", "deadhead_distance_km", "on_trip_hours", "idle_hours"), "pings"),
    "daily_revenue": lambda t: profitability.daily_revenue(t.valid()).select("vehicle_id", day(), "revenue"),
    "expense_reconciliation": lambda t: t.joined().select("vehicle_id", day(), "expense_status", "fuel_cost", "maintenance_cost", "pings", "revenue", "distance_variance_pct"),
    "compute_profit": lambda t: t.profit().select("vehicle_id", day(), "net_profit", "profit_per_km", "margin_pct", "utilization_pct"),
    "profit_trend": lambda t: profitability.with_trend(t.profit()).select("vehicle_id", day(), "net_profit", "rolling_avg_profit", "history_days", "profit_slope"),
    "profit_trend_asof": lambda t: profitability.classify(profitability.with_trend(t.profit().where("sim_date BETWEEN DATE '2024-01-14' AND DATE '2024-01-20'"))).where("sim_date = DATE '2024-01-20'").select("vehicle_id", day(), "rolling_avg_profit", "history_days", "profit_slope", "classification"),
    "classify_vehicles": lambda t: profitability.classify(profitability.with_trend(t.profit())).select("vehicle_id", day(), "classification"),
    "distance_outliers": lambda t: profitability.distance_outliers(t.joined()).select("vehicle_id", day(), "distance_variance_pct"),
    "vehicle_daily_pnl": lambda t: pnl_columns(t.pnl()),
    "unprofitable_topk": lambda t: mart.unprofitable(t.pnl(), 10).select("vehicle_id", day(), "rolling_avg_profit", "net_profit", "classification"),
    "vehicle_history": lambda t: mart.vehicle_history(t.pnl(), "V000000007", 14).select("vehicle_id", day(), "net_profit", "rolling_avg_profit", "classification"),
    "zone_daily": lambda t: mart.zone_daily(t.hourly()).select("zone_id", day(), "trips", "earnings", "active_vehicles", "idle_ratio", "avg_speed_kmh", "hours_reported"),
    "revenue_crosscheck": lambda t: mart.revenue_crosscheck(t.pnl(), t.hourly()).select(day(), "pnl_revenue", "zone_earnings", "delta"),
    "pipeline_status": q_status,
    "classification_counts": lambda t: t.pnl().groupBy("sim_date", "classification").agg(F.count(F.lit(1)).alias("n")).select(day(), "classification", "n"),
    "batch_check": q_batch_check,
    "run_totals": q_run_totals,
    "live_zone_view": lambda t: live.zone_view(t.newest_activity(), t.earnings()).select("zone_id", end_s("activity_window_end"), "trips", "active_vehicles", "idle_ratio", "avg_speed_kmh", "pings", end_s("earnings_window_end"), "earnings", "completed_trips"),
    "live_fleet_snapshot": lambda t: live.fleet_of(t.newest_activity()).select("active_vehicles", "trips", "idle_ratio", "zones_reporting", end_s()),
    "live_zone_earnings_series": lambda t: live.earnings_series(t.earnings()),
    "parse_series": lambda t: live.parse_series(live.earnings_series(t.earnings())).select("zone_id", "age", "window_end_s", "earnings"),
    "live_vehicle_state": lambda t: live.vehicle_state(t.zoned()).withColumn("updated_us", F.unix_micros("updated_at_sim")).drop("updated_at_sim"),
    "live_vehicle_lookup": lambda t: live.vehicle_state(t.zoned().where("vehicle_id = 'V000000007'")).select("vehicle_id", "status", "zone_id", us("updated_at_sim", "updated_us")),
    "live_view_ttl": q_ttl,
    "zones_live_complete": lambda t: live.every_zone(zones.zone_table(t.spark), t.newest_activity().where("trips > 0").select("zone_id", "trips")).select("zone_id", "zone_name", "trips", "reporting"),
    "idle_alerts": lambda t: t.alerts().select("alert_id", "vehicle_id", "severity", us("idle_since_sim", "idle_since_us"), us("raised_at_sim", "raised_at_us"), "zone_id"),
    "alert_envelope": lambda t: idle.alert_envelopes(t.alerts()).select("_key", "envelope.alert_id", "envelope.alert_type", "envelope.severity", "envelope.source_layer", F.regexp_extract("envelope.detail", r"^idle for \d+( .*)$", 1).alias("detail_end"), "envelope.zone_id"),
    "alert_feed": lambda t: idle.alert_feed(t.alerts()).select("alert_id", "severity", us("raised_at_sim", "raised_at_us")),
    "alert_json_roundtrip": q_alert_json,
    "stale_state": q_stale,
    "upsert_zone_hourly": q_upsert_hourly,
    "merge_files": q_merge_files,
    "upsert_pnl_restatement": q_upsert_pnl,
    "restatement_log": q_restatement_log,
    "trend_refresh": q_trend_refresh,
    "recompute_days": q_recompute,
    "retention": q_retention,
    "zone_history": q_zone_history,
    "stalled_queries": q_stalled,
    "advance_hwm": q_hwm,
    "speed_snapshot": lambda t: t.snapshot().select("zone_id", day(), "sim_hour", "window_minutes", "trips", "earnings", "active_vehicles", "idle_ratio", "avg_speed_kmh"),
    "dq_log": q_dq_log,
    "dq_checks": lambda t: control.dq_checks(t.checked(), t.pnl()).select(day(), "check_name", "observed", "threshold", "status"),
    "reconcile_zone": lambda t: reconcile.reconcile_zone(t.snapshot(), t.hourly()).withColumn("sim_date", day()),
    "reconcile_fleet": lambda t: reconcile.reconcile_fleet(t.snapshot(), t.hourly()).withColumn("sim_date", day()),
    "reconcile_summary": lambda t: reconcile.summary(reconcile.reconcile_zone(t.snapshot(), t.hourly())),
    "date_ownership": q_owners,
    "merged_utilization": q_merged,
    "merge_envelope": q_envelope,
    "merge_degraded": q_degraded,
    "watermark_age": q_watermark_age,
    "complete_dates": q_complete,
    "next_batch_date": q_next,
    "backfill_range": q_backfill,
    "dlq_rate": lambda t: control.dead_letter_rate(t.rejected(), t.valid()).select(day(), "rejected", "accepted", "rate", "alert"),
    "stream_master": q_stream_master,
    "stream_log_master": q_stream_log_master,
    "stream_dlq": q_stream_dlq,
    "stream_zone_activity": q_stream_activity,
    "stream_zone_earnings": q_stream_earnings,
    "stream_vehicles": q_stream_vehicles,
    "stream_idle": q_stream_idle,
    "stream_zone_earnings_total": q_stream_earnings_total,
    "stream_progress": q_stream_progress,
    "stream_late_rows": q_stream_late,
    "stream_late_side": q_stream_late_side,
    "stream_zone_earnings_series": q_stream_series,
    "stream_replay": q_stream_replay,
    "reconcile_state": q_reconcile_state,
    "stream_rejections": q_stream_rejections,
    "stream_alive": q_stream_alive,
}


def queries() -> dict:
    def made(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")  # days and hours are simulated ones, and mean the same everywhere
            return build(Tables(spark, sf_dir))

        return run

    return {name: made(build) for name, build in QUERIES.items()}
