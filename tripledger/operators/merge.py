"""One answer from the batch tables and the live view: each date has exactly one owner."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripledger.functions.rounding import half_up


def asked(spark: SparkSession, hwm: str | None, first: str, last: str, today: str) -> DataFrame:
    """One row of dates: the watermark, the range asked for, and today."""
    if last < first:
        raise ValueError("the range ends before it begins")
    return spark.range(1).select(*[F.lit(v).cast("date").alias(c) for c, v in (("hwm", hwm), ("first", first), ("last", last), ("today", today))])


def date_ownership(bounds: DataFrame) -> DataFrame:
    """bounds: one row as of ``asked``. sim_date and owner for each date: batch up to the watermark, speed today, else a gap or the future; with hwm and today."""
    day, today = F.col("sim_date"), F.col("today")
    owner = F.when(day <= F.col("hwm"), "batch").when(day == today, "speed").when(day > today, "future").otherwise("gap")
    return bounds.select("hwm", "today", F.explode(F.sequence("first", "last")).alias("sim_date")).select("sim_date", owner.alias("owner"), "hwm", "today")


def merged_utilization(owners: DataFrame, daily: DataFrame | None, live: DataFrame | None) -> DataFrame:
    """Zone-days of the dates that batch owns and live zones of the one that speed owns, labelled; a missing side leaves the other."""
    if daily is None and live is None:
        raise ValueError("neither store can be read")
    measures = ("trips", "earnings", "active_vehicles", "idle_ratio", "avg_speed_kmh")
    parts = []
    if daily is not None:
        rows = daily.join(F.broadcast(owners.where("owner = 'batch'").select("sim_date")), "sim_date")  # one row a date
        parts.append(rows.select("sim_date", "zone_id", *measures, F.lit("batch").alias("source"), F.lit(True).alias("exact"), F.lit(None).cast("string").alias("note")))
    if live is not None:
        today = F.broadcast(owners.where("owner = 'speed'").select("sim_date"))  # at most one row
        rows = live.where("zone_id IS NOT NULL").crossJoin(today)
        parts.append(rows.select("sim_date", "zone_id", *measures, F.lit("speed").alias("source"), F.lit(False).alias("exact"), F.lit("approximate distinct counts; earnings of trips seen so far").alias("note")))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.withColumn("utilization_pct", half_up((F.lit(1.0) - F.col("idle_ratio")) * 100, 2))


# The sentences that an answer's consistency is told in.
UNKNOWN_WATERMARK, NO_BATCH, SPEED_ONLY = "no watermark could be read", "no batch data available; all values approximate", "speed view only; batch complete through "
BATCH_ONLY, COMPLETE = "batch view only; complete through ", "batch-complete-through "
GAP = (" date(s) in neither view (", ") - the batch layer is behind the simulated clock")
LATER = (" requested date(s) are in the future (", ") - the simulation has only reached ")
DEGRADED = ("degraded: ", " unavailable")


def envelope(owners: DataFrame, missing_stores: tuple[str, ...] = ()) -> DataFrame:
    """One row: who covers what, the watermark's age, and what the answer's consistency is."""
    n = lambda who: F.count_if(F.col("owner") == who).alias(f"{who}_dates")
    ends = lambda who, f: f(F.when(F.col("owner") == who, F.col("sim_date"))).cast("string")
    one = owners.agg(
        n("batch"), n("speed"), n("gap"), n("future"), F.max("hwm").alias("hwm"), F.max("today").alias("today"),
        ends("gap", F.min).alias("g0"), ends("gap", F.max).alias("g1"), ends("future", F.min).alias("f0"), ends("future", F.max).alias("f1"),
    )
    mark, today = F.col("hwm").cast("string"), F.col("today").cast("string")
    base = (
        F.when(F.col("hwm").isNull(), UNKNOWN_WATERMARK if "batch" in missing_stores else NO_BATCH)
        .when(F.col("batch_dates") == 0, F.concat(F.lit(SPEED_ONLY), mark))
        .when(F.col("speed_dates") == 0, F.concat(F.lit(BATCH_ONLY), mark))
        .otherwise(F.concat(F.lit(COMPLETE), mark))
    )
    told = lambda count, a, b, words, *after: F.when(F.col(count) > 0, F.concat(F.col(count).cast("string"), F.lit(words[0]), F.concat_ws("..", a, b), F.lit(words[1]), *after))
    degraded = F.lit(f"{DEGRADED[0]}{', '.join(missing_stores)}{DEGRADED[1]}" if missing_stores else None).cast("string")
    return one.select(
        "batch_dates", "speed_dates", "gap_dates", "future_dates", F.datediff("today", "hwm").alias("watermark_age_days"),
        F.concat_ws("; ", base, told("gap_dates", "g0", "g1", GAP), told("future_dates", "f0", "f1", LATER, today), degraded).alias("consistency"), F.lit(",".join(missing_stores)).alias("missing_stores"),
    )


def zone_history(hourly: DataFrame, snapshot: DataFrame, hwm: DataFrame, hours: int) -> DataFrame:
    """Each zone's last hours across the boundary: the exact hour up to the watermark's day, the live view's after it. hwm: one row with hwm, a date."""
    columns = ["zone_id", "sim_date", "sim_hour", "trips", "earnings", "active_vehicles", "idle_ratio"]
    mark = F.broadcast(hwm.select("hwm"))  # one row
    exact = hourly.where("zone_id IS NOT NULL").crossJoin(mark).where("sim_date <= hwm").select(*columns, F.lit("batch").alias("source"))
    live = snapshot.crossJoin(mark).where("sim_date > hwm").select(*columns, F.lit("speed").alias("source"))
    both = exact.unionByName(live).withColumn("_at", F.datediff("sim_date", F.lit("1970-01-01").cast("date")) * 24 + F.col("sim_hour"))
    newest = F.broadcast(both.agg(F.max("_at").alias("_newest")))  # one row
    return both.crossJoin(newest).where(F.col("_at") > F.col("_newest") - hours).drop("_at", "_newest")
