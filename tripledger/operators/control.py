"""Which days a batch run takes, and the rules that watch the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripledger.functions.rounding import half_up


def run_bounds(spark: SparkSession, epoch: str, today: str, hwm: str | None = None) -> DataFrame:
    """One row of dates: the first day there is, today, and the day that was finished last."""
    return spark.range(1).select(*[F.lit(v).cast("date").alias(c) for c, v in (("epoch", epoch), ("today", today), ("hwm", hwm))])


def complete_dates(bounds: DataFrame, days: int) -> DataFrame:
    """The last finished days, oldest first; none on the first day."""
    d = F.col("sim_date")
    return bounds.select("today", F.explode(F.sequence("epoch", "today")).alias("sim_date")).where((d < F.col("today")) & (d >= F.date_sub("today", days))).select("sim_date").orderBy("sim_date")


def next_batch_date(bounds: DataFrame) -> DataFrame:
    """Yesterday, unless it is before the epoch or done; one row, null where there is nothing to do."""
    yesterday = F.date_sub("today", 1)
    due = (yesterday >= F.col("epoch")) & (F.col("hwm").isNull() | (yesterday > F.col("hwm")))
    return bounds.select(F.when(due, yesterday).alias("sim_date"))


def dead_letter_rate(rejected: DataFrame, accepted: DataFrame, limit: float = 0.05) -> DataFrame:
    """Dead letters to accepted rows by day, and whether that is above the limit."""
    both = rejected.select("sim_date", F.lit(1).alias("bad")).unionByName(accepted.select("sim_date", F.lit(0).alias("bad")))
    g = both.groupBy("sim_date").agg(F.sum("bad").alias("rejected"), F.count_if(F.col("bad") == 0).alias("accepted"))
    rate = F.col("rejected") / F.greatest(F.col("accepted"), F.lit(1))
    return g.withColumn("rate", half_up(rate, 6)).withColumn("alert", rate > limit)


def dq_checks(checked: DataFrame, pnl: DataFrame) -> DataFrame:
    """Threshold checks by day as rows for dq_run_log: check_name, observed, threshold, status."""
    ratio = lambda part, whole: F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
    n = F.count(F.lit(1))
    a = checked.groupBy("sim_date").agg(
        ratio(F.count_if(~F.col("is_valid")), n).alias("rejected_share"), ratio(F.count_if(F.col("lat").isNull()), n).alias("null_coordinate_share"),
        (n - F.count_distinct("event_id")).cast("double").alias("duplicate_events"), F.count_distinct("vehicle_id").cast("double").alias("vehicles"),
    )
    p = pnl.groupBy("sim_date").agg(
        ratio(F.count_if(F.col("expense_status") == "MISSING_EXPENSE"), n).alias("missing_expense_share"), ratio(F.count_if(F.col("expense_status") == "MISSING_TELEMETRY"), n).alias("missing_telemetry_share"),
        ratio(F.count_if(F.col("distance_variance_pct") > 10), n).alias("distance_outlier_share"),
    )
    rules = [("rejected_share", 0.05, 0.2), ("null_coordinate_share", 0.02, 0.1), ("duplicate_events", 0.0, 100.0), ("missing_expense_share", 0.1, 0.5), ("missing_telemetry_share", 0.1, 0.5), ("distance_outlier_share", 0.2, 1.0)]
    rows = [F.struct(F.lit(name).alias("check_name"), F.col(name).alias("observed"), F.lit(warn).alias("threshold"), F.when(F.col(name) > fail, "FAIL").when(F.col(name) > warn, "WARN").otherwise("PASS").alias("status")) for name, warn, fail in rules]
    few = F.struct(F.lit("vehicles").alias("check_name"), F.col("vehicles").alias("observed"), F.lit(1.0).alias("threshold"), F.when(F.col("vehicles") < 1, "FAIL").otherwise("PASS").alias("status"))
    long = a.join(p, "sim_date").select("sim_date", F.inline(F.array(*rows, few)))
    return long.withColumn("observed", half_up("observed", 6))
