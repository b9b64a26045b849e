"""Streams against their batch twins, over several micro-batches."""

from datetime import datetime, timedelta, timezone
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tripledger.operators import clean, enrich, idle, live, reconcile, utilization
from tripledger.sources import adapters
from tripledger.streaming import held, jobs, views
from tripledger.streaming.idle import episodes, risen
from tripledger.streaming.series import NewestWindows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The events in four files, one after the other in time."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    root = tmp_path_factory.mktemp("events")
    rows = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts").toPandas()
    for k in range(4):
        part = rows.iloc[k * len(rows) // 4 : (k + 1) * len(rows) // 4]
        part.astype({"ts": "datetime64[us]"}).to_parquet(root / f"events-{k}.parquet", index=False)
    return str(root)


def layer(spark, parts, tmp_path, watermark="30 minutes"):
    return jobs.SpeedLayer(spark, adapters.telemetry_stream(spark, parts, max_files_per_trigger=1), str(tmp_path), {"availableNow": True}, watermark)


def batch(spark):
    checked = clean.validate_telemetry(adapters.telemetry(spark, SF), F.col("reference_time"))
    return checked, enrich.with_zone(checked.where("is_valid"))


def test_master_and_dead_letters_split_the_stream(spark, parts, tmp_path):
    s = layer(spark, parts, tmp_path)
    jobs.finished(s.start(["master", "dlq"]))
    checked, valid = batch(spark)
    assert spark.read.parquet(s.path("master")).count() == valid.count()
    assert spark.read.parquet(s.path("dlq")).count() == checked.where("NOT is_valid").count()
    jobs.finished(s.start(["master"]))  # nothing new: nothing is written again
    assert spark.read.parquet(s.path("master")).count() == valid.count()


def test_views_equal_their_batch_twins(spark, parts, tmp_path):
    s = layer(spark, parts, tmp_path, "3 hours")
    jobs.finished(s.start(["activity", "vehicles"]))
    _, valid = batch(spark)
    columns = ["window_start", "window_end", "zone_id", "avg_speed_kmh", "idle_ratio", "pings"]
    want = {tuple(r) for r in utilization.zone_activity(valid).select(columns).collect()}
    assert {tuple(r) for r in s.activity_windows().select(columns).collect()} == want
    newest = s.newest_vehicles()
    assert {tuple(r) for r in newest.select("vehicle_id", "status").collect()} == {tuple(r) for r in live.vehicle_state(valid).select("vehicle_id", "status").collect()}


def test_idle_alerts_equal_the_batch_twin(spark, parts, tmp_path):
    s = layer(spark, parts, tmp_path)
    jobs.finished(s.start(["idle"]))
    columns = ["alert_id", "vehicle_id", "severity", "idle_since_sim", "raised_at_sim"]
    got = [tuple(r) for r in spark.read.parquet(s.path("alerts")).select(columns).collect()]
    want = [tuple(r) for r in idle.idle_alerts(batch(spark)[1]).select(columns).collect()]
    assert want and sorted(got) == sorted(want)


def test_earnings_follow_the_last_ping_over_batches(spark, parts, tmp_path):
    s = layer(spark, parts, tmp_path, "30 days")
    jobs.finished(s.start(["earnings"]))
    columns = ["window_start", "window_end", "zone_id", "earnings", "completed_trips"]
    want = utilization.zone_earnings(utilization.trip_completions(batch(spark)[1])).select(columns).collect()
    assert want and sorted(map(tuple, s.earnings_windows().select(columns).collect()), key=str) == sorted(map(tuple, want), key=str)


def test_a_later_ping_takes_a_credit_back(spark, tmp_path):
    """Three batches: a trip's ping, a later one elsewhere, and an earlier one, which changes nothing; a repeated ping changes nothing either."""
    start = datetime(2024, 1, 2, 9)
    schema = "event_id string, trip_id string, vehicle_id string, status string, zone_id string, fare double, event_time timestamp, sim_date date"
    ping = lambda i, minutes, zone: (str(i), "t", "v", "on_trip", zone, 120.5, start + timedelta(minutes=minutes), start.date())
    for k, rows in enumerate(([ping(1, 0, "Z1")], [ping(2, 20, "Z2"), ping(2, 20, "Z2")], [ping(0, 10, "Z3")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        s = jobs.SpeedLayer(spark, stream, str(tmp_path / "out"), {"availableNow": True}, "3 hours")
        s.valid = lambda: stream  # noqa: B023
        jobs.finished(s.start(["earnings"]))
        got = {(r.zone_id, r.earnings, r.completed_trips) for r in s.earnings_windows().collect()}
        assert got == {("Z1" if k == 0 else "Z2", 120.5, 1)} and s.earnings_windows().count() == 3


def test_series_over_batches_equal_the_batch_twin(spark, parts, tmp_path):
    s = layer(spark, parts, tmp_path, "30 days")
    jobs.finished(s.start(["series"]))
    want = live.earnings_series(utilization.zone_earnings(utilization.trip_completions(batch(spark)[1]))).collect()
    assert want and sorted(map(tuple, s.earnings_series().select("zone_id", "age", "point").collect())) == sorted(map(tuple, want))


@pytest.mark.parametrize("name", ["earnings", "activity", "series", "alive"])
def test_a_batch_that_was_written_but_not_committed(spark, parts, tmp_path, name):
    """The driver is lost between the view and the commit: the batch comes again, the view stays, and the query goes on."""
    s = layer(spark, parts, tmp_path)
    jobs.finished(s.start([name]))
    rows = lambda: sorted(map(str, s.view(name).read().drop("vehicles").collect()))
    want = rows()
    commits = tmp_path / "_checkpoints" / name / "commits"
    last = max(int(f.name) for f in commits.iterdir() if f.name.isdigit())
    for f in (commits / str(last), commits / f".{last}.crc"):
        f.unlink(missing_ok=True)
    jobs.finished(s.start([name]))
    assert want and rows() == want and (commits / str(last)).exists()


def test_reconciliation_from_state_equals_that_from_the_view(spark, parts, tmp_path):
    """The deltas of the state's windows, and of the view's; and the state as it was after an earlier batch."""
    s = layer(spark, parts, tmp_path, "30 days")
    jobs.finished(s.start(["series"]))
    hourly = utilization.zone_hourly(batch(spark)[1])
    shown = live.parse_series(s.earnings_series()).select("zone_id", F.timestamp_seconds("window_end_s").alias("window_end"), F.col("earnings").cast("double").alias("earnings"))
    deltas = lambda windows: sorted(map(str, reconcile.reconcile_earnings(held.hour_ends(windows), hourly).collect()))
    want = deltas(shown)
    assert want and any("'ALL'" in r for r in want) and deltas(s.earnings_in_state()) == want
    assert 0 < s.earnings_in_state(batch=0).agg(F.max("window_end")).first()[0].timestamp() < s.earnings_in_state().agg(F.max("window_end")).first()[0].timestamp()
    checkpoint = str(tmp_path / "_checkpoints" / "series")
    assert held.operator_of(spark, checkpoint, "credited") != held.operator_of(spark, checkpoint, "windows")
    with pytest.raises(ValueError):
        held.operator_of(spark, checkpoint, "nothing")


def test_a_series_keeps_the_newest_windows():
    """Evicted and emptied windows leave the state; a late change of a window that the state no longer holds is passed over only when it is full."""
    state = {}
    machine = NewestWindows(keep=2, spare=1)
    machine.windows = SimpleNamespace(iterator=lambda: iter(list(state.items())), removeKey=state.pop, updateValue=state.__setitem__)
    step = lambda *rows: next(machine.handleInputRows(("Z",), iter([{"window_end_s": w, "cents": c, "n": n} for w, c, n in rows]), None))
    assert step((1, 100, 1), (2, 200, 1)).ends == [2, 1]
    r = step((3, 300, 1), (4, 400, 1))
    assert r.ends == [4, 3] and r.cents == [400, 300] and set(state) == {(4,), (3,), (2,)}
    r = step((4, -400, -1))  # a trip moves away
    assert r.ends == [3, 2] and r.cents == [300, 200] and set(state) == {(3,), (2,)}


def test_first_seen_keeps_one_ping_of_a_trip(spark, parts, tmp_path):
    s = layer(spark, parts, tmp_path, "30 days")
    q = utilization.first_seen(s.valid(), "30 days").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "seen")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "seen")).count() == utilization.first_pings(batch(spark)[1]).count()


def test_a_view_stays_small_over_many_batches(spark, tmp_path):
    """50 batches of 20 keys each: the runs that a read touches stay few, and old files go."""
    view = views.LeveledView(spark, str(tmp_path / "view"), views.newest_by(["k"]))
    total = views.LeveledView(spark, str(tmp_path / "sums"), views.summed_by(["k"], ["n"]))
    want, sums, most = {}, {}, 0
    for batch in range(50):
        rows = [(k % 37, batch * 100 + k) for k in range(batch, batch + 20)]
        want |= dict(rows)
        for k, v in rows:
            sums[k] = sums.get(k, 0) + v
        frame = spark.createDataFrame(rows, "k int, n bigint").coalesce(1)
        view.add(frame, batch)
        if batch < 22:
            total.add(frame, batch)
            final = dict(sums)
        most = max(most, len(view.runs()))
    assert most <= 2 * (views.FAN - 1) + 1
    assert {r.k: r.n for r in view.read().collect()} == want and view.read().columns == ["k", "n"]
    assert {r.k: r.n for r in total.read().collect()} == final
    assert len(list((tmp_path / "view" / "runs").iterdir())) <= 2 * most and len(list((tmp_path / "view" / "_manifests").iterdir())) == 2
    view.add(spark.createDataFrame([(1, -1)], "k int, n bigint"), 49)  # a batch that is written again changes nothing
    assert {r.k: r.n for r in view.read().collect()} == want


PING = "event_id string, trip_id string, vehicle_id string, status string, zone_id string, fare double, event_time timestamp, sim_date date"


def stepwise(spark, tmp_path, batches, name, watermark):
    """The layer after each batch of pings (vehicle, minutes), one after the other."""
    start = datetime(2024, 1, 2, 9)
    for k, rows in enumerate(batches):
        pings = [(f"{k}-{i}", "t", v, "on_trip", "Z1", 1.0, start + timedelta(minutes=m), start.date()) for i, (v, m) in enumerate(rows)]
        spark.createDataFrame(pings, PING).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(PING).parquet(str(tmp_path / "in"))
        s = jobs.SpeedLayer(spark, stream, str(tmp_path / "out"), {"availableNow": True}, watermark)
        s.valid = lambda: stream  # noqa: B023
        jobs.finished(s.start([name]))
        yield s


def test_a_silent_vehicle_leaves_the_view(spark, tmp_path):
    batches = [[("A", 0), ("B", 0)], [("A", 20), ("A", 10)], [("A", 45)], [("C", 76)], [("B", 80)]]
    alive = [{"A", "B"}, {"A", "B"}, {"A"}, {"C"}, {"B", "C"}]  # B is silent for 45 minutes at 45, A for 31 at 76
    for s, want in zip(stepwise(spark, tmp_path, batches, "alive", "0 seconds"), alive):
        assert {r.vehicle_id for r in s.view("alive").read().collect()} == want
    rows = s.view("alive").read().collect()
    assert {r.vehicle_id: r.event_us for r in rows}["B"] == int(datetime(2024, 1, 2, 10, 20, tzinfo=timezone.utc).timestamp() * 1e6)


def test_late_rows_become_rows(spark, tmp_path):
    batches = [[("A", 0), ("A", 100)], [("A", 71), ("A", 69), ("A", 200)], [("A", 171), ("A", 1)]]
    for s in stepwise(spark, tmp_path, batches, "late", "30 minutes"):
        pass
    seen = lambda name: {r.event_id for r in spark.read.parquet(s.path(name)).collect()}
    assert seen("late") == {"1-1", "2-1"} and seen("ontime") == {"0-0", "0-1", "1-0", "1-2", "2-0"}
    assert len(list((tmp_path / "out" / "marks").iterdir())) <= 2


def test_rejections_counted_in_passing(spark, parts, tmp_path):
    s = layer(spark, parts, tmp_path)
    listener = jobs.Progress(spark, str(tmp_path / "progress"), every=3)
    spark.streams.addListener(listener)
    try:
        jobs.finished(s.start(["master"]))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    assert len(listener.rows) < 3
    want = {(r.rejection_reason, r["count"]) for r in batch(spark)[0].where("NOT is_valid").groupBy("rejection_reason").count().collect()}
    assert {(r.rejection_reason, r.n) for r in jobs.rejections(listener.table()).collect()} == want and want


def test_late_rows_are_counted(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    start = datetime(2024, 1, 2)
    for k, hours in enumerate((0, 10, 11, 1)):  # the last file is late
        rows = [(k * 10 + i, start + timedelta(hours=hours, minutes=i), 7, "view", 50.0, "{}") for i in range(5)]
        frame = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").toPandas()
        frame.astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / f"events-{k}.parquet", index=False)
    listener = jobs.Progress(spark, str(tmp_path / "progress"), every=2)
    spark.streams.addListener(listener)
    try:
        s = jobs.SpeedLayer(spark, adapters.telemetry_stream(spark, str(tmp_path), 1), str(tmp_path / "out"), {"availableNow": True})
        jobs.finished(s.start(["activity"]))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    assert len(listener.rows) < 2
    progress = listener.table().where("kind = 'progress'")
    assert progress.agg(F.sum("late_rows")).first()[0] > 0
    assert progress.where("batch_s > 0").count() >= 3
    now = lambda text: spark.sql(f"SELECT TIMESTAMP '{text}' AS now")
    assert jobs.stalled(progress, now("2100-01-01 00:00:00")).count() == 1 and jobs.stalled(progress, now("2000-01-01 00:00:00")).count() == 0


def test_episodes_over_batches():
    at = lambda m, status="idle": (m * 60_000_000, f"e{m}", status, "Z")
    levels = [(45, "WARNING"), (90, "CRITICAL")]
    (first,) = episodes([at(0), at(50)], None)
    assert (first[0], first[2]) == (0, True) and [k for k, _ in risen(0, first[1], levels, 0)] == [0]
    (again,) = episodes([at(60), at(91), at(120)], 0)
    assert [(k, p[1]) for k, p in risen(again[0], again[1], levels, 1)] == [(1, "e91")]
    assert list(episodes([at(130, None)], 0)) == [] and list(episodes([], 7)) == [(7, [], True)]
    assert [k for k, _ in risen(0, [at(0), at(95)], levels, 0)] == [1]  # straight past both
    assert [(s, o) for s, _, o in episodes([at(1), at(2, "enroute"), at(3), at(4, None)], 0)] == [(0, False), (3 * 60_000_000, False)]


def test_a_watermark_has_to_last_a_while():
    jobs.check_watermark("30 minutes", 300)
    with pytest.raises(ValueError):
        jobs.check_watermark("10 minutes", 300)
