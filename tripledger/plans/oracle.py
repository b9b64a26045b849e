"""DuckDB SQL for the queries in plans/vehicle.py, over the same tables.

PRELUDE names the steps as common table expressions; each query selects from them.
"""

from __future__ import annotations

import re

from tripledger.functions.geo import EARTH_RADIUS_KM
from tripledger.zones import LAT_MAX, LAT_MIN, LON_MAX, LON_MIN, zone_rows


def _e(x: float) -> str:
    return f"{x!r}e0"


def _zones() -> str:
    return ",\n    ".join(f"('{i}', '{n}', '{k}', {_e(a)}, {_e(b)}, {_e(c)}, {_e(d)}, {_e(w)})" for i, n, k, a, b, c, d, w in zone_rows())


PRELUDE = f"""
WITH zones(zone_id, zone_name, zone_class, lat_min, lat_max, lon_min, lon_max, demand_weight) AS (VALUES
    {_zones()}
), ev AS (
  SELECT event_id, ts, user_id, event_type, value, user_id AS vno, 'V' || lpad(user_id::VARCHAR, 9, '0') AS vehicle_id,
         CASE WHEN event_type = 'view' THEN 'enroute' WHEN event_type IN ('click', 'purchase') THEN 'on_trip' ELSE 'idle' END AS status, hour(ts) // 4 AS slot
  FROM events
), tel AS (
  SELECT event_id::VARCHAR AS event_id, event_id AS num, vehicle_id, 'D' || substr(vehicle_id, 2, 9) AS driver_id, status, value AS speed_kmh, ts AS reference_time,
         CASE WHEN status <> 'idle' OR event_id % 109 = 0 THEN vehicle_id || '-' || strftime(ts, '%Y-%m-%d') || '-' || slot END AS trip_id,
         CASE WHEN status = 'on_trip' AND event_id % 113 <> 0 THEN CASE WHEN event_id % 103 = 0 THEN -5e0 ELSE (5 + (vno * 7 + slot * 13 + day(ts) * 3) % 40)::DOUBLE END END AS fare,
         CASE WHEN event_id % 107 = 0 THEN ts + INTERVAL 2 HOUR ELSE ts END AS event_time,
         CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 101 = 0 THEN 51.5e0 ELSE 6.85e0 + 0.14e0 * ((event_id * 7919) % 1000) / 1e3 END AS lat,
         CASE WHEN event_id % 97 <> 0 THEN 79.82e0 + 0.12e0 * ((event_id * 104729) % 1000) / 1e3 END AS lon,
         (user_id % 6)::INTEGER AS source_partition, event_id AS source_offset
  FROM ev
), checked AS (
  SELECT *, event_time::DATE AS sim_date,
         CASE WHEN lat IS NULL OR lon IS NULL THEN 'NULL_COORDINATES'
              WHEN NOT (lat BETWEEN {_e(LAT_MIN)} AND {_e(LAT_MAX)} AND lon BETWEEN {_e(LON_MIN)} AND {_e(LON_MAX)}) THEN 'COORDINATES_OUT_OF_BOUNDS'
              WHEN fare < 0 THEN 'NEGATIVE_FARE'
              WHEN NOT speed_kmh BETWEEN 0 AND 200 THEN 'IMPLAUSIBLE_SPEED'
              WHEN event_time > reference_time + INTERVAL 5 MINUTE THEN 'FUTURE_TIMESTAMP'
              WHEN (trip_id IS NULL) <> (status = 'idle') THEN 'STATUS_TRIP_MISMATCH'
              WHEN status = 'on_trip' AND fare IS NULL THEN 'MISSING_FARE_ON_TRIP' END AS rejection_reason
  FROM tel
), valid AS (
  SELECT * FROM checked WHERE rejection_reason IS NULL
), zoned AS (
  SELECT v.*, z.zone_id FROM valid v LEFT JOIN zones z ON v.lat >= z.lat_min AND v.lat < z.lat_max AND v.lon >= z.lon_min AND v.lon < z.lon_max
), completions AS (
  SELECT * FROM zoned WHERE trip_id IS NOT NULL AND fare IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY sim_date, trip_id ORDER BY event_time DESC, event_id DESC) = 1
), firsts AS (
  SELECT * FROM zoned WHERE trip_id IS NOT NULL AND fare IS NOT NULL QUALIFY row_number() OVER (PARTITION BY trip_id ORDER BY event_time, event_id) = 1
), prev AS (
  SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(event_time) OVER w AS ptime, lag(status) OVER w AS pstatus
  FROM valid WINDOW w AS (PARTITION BY vehicle_id, sim_date ORDER BY event_time, event_id)
), chords AS (
  SELECT *, pow(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lon - plon) / 2), 2) AS chord FROM prev
), seg AS (
  SELECT *, coalesce({2 * EARTH_RADIUS_KM!r}e0 * asin(sqrt(CASE WHEN chord > 1 THEN 1e0 ELSE chord END)), 0e0) AS km,
         coalesce((floor(epoch(event_time)) - floor(epoch(ptime))) / 60e0, 0e0) AS minutes
  FROM chords
), trips AS (
  SELECT vehicle_id, sim_date, count(DISTINCT CASE WHEN status = 'on_trip' THEN trip_id END) AS trips, sum(km) AS telemetry_distance_km,
         sum(CASE WHEN pstatus = 'on_trip' THEN km ELSE 0e0 END) AS paid_distance_km, sum(CASE WHEN pstatus = 'enroute' THEN km ELSE 0e0 END) AS deadhead_distance_km,
         sum(CASE WHEN pstatus = 'on_trip' THEN minutes ELSE 0e0 END) / 60e0 AS on_trip_hours, sum(CASE WHEN pstatus = 'idle' THEN minutes ELSE 0e0 END) / 60e0 AS idle_hours,
         count(*) AS pings
  FROM seg GROUP BY 1, 2
), revenue AS (
  SELECT vehicle_id, sim_date, sum(fare) AS revenue
  FROM (SELECT vehicle_id, sim_date, trip_id, max(fare) AS fare FROM valid WHERE trip_id IS NOT NULL AND fare IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2
), totals AS (
  SELECT * FROM trips LEFT JOIN revenue USING (vehicle_id, sim_date)
), o1 AS (
  SELECT o_custkey // 10 AS vno, (o_orderkey % 30)::INTEGER AS day, round(o_totalprice * 100)::BIGINT AS cents, o_orderkey
  FROM orders WHERE NOT (o_custkey // 10 < 4 AND (o_orderkey + o_custkey) % 7 = 0)
), o2 AS (
  SELECT vno, day, sum(cents)::BIGINT AS cents, sum(o_orderkey)::BIGINT AS keys FROM o1 GROUP BY 1, 2 HAVING sum(o_orderkey) % 11 <> 0
), exp AS (
  SELECT 'V' || lpad(vno::VARCHAR, 9, '0') AS vehicle_id, CASE WHEN keys % 17 <> 0 THEN (cents % 9000)::DOUBLE / 1e2 END AS fuel_cost,
         ((cents // 9000) % 4000)::DOUBLE / 1e2 AS maintenance_cost, (cents % 30000)::DOUBLE / 1e2 AS partner_distance_km, keys % 2 = 0 AS service_flag, 'partner-1' AS partner_id,
         (DATE '2024-01-01' + day) AS sim_date
  FROM o2
), joined AS (
  SELECT vehicle_id, sim_date, t.* EXCLUDE (vehicle_id, sim_date), e.* EXCLUDE (vehicle_id, sim_date),
         CASE WHEN fuel_cost IS NULL THEN 'MISSING_EXPENSE' WHEN pings IS NULL THEN 'MISSING_TELEMETRY' ELSE 'MATCHED' END AS expense_status,
         round(CASE WHEN telemetry_distance_km > 0 THEN abs(partner_distance_km - telemetry_distance_km) / telemetry_distance_km * 100 END, 2) AS distance_variance_pct
  FROM totals t FULL JOIN exp e USING (vehicle_id, sim_date)
), net AS (
  SELECT *, round(revenue - fuel_cost - maintenance_cost, 2) AS net_profit FROM joined
), profit AS (
  SELECT *, CASE WHEN telemetry_distance_km > 0 THEN round(net_profit / telemetry_distance_km, 4) END AS profit_per_km,
         CASE WHEN revenue > 0 THEN round(net_profit / revenue * 100, 2) END AS margin_pct,
         CASE WHEN on_trip_hours + idle_hours > 0 THEN round(on_trip_hours / (on_trip_hours + idle_hours) * 100, 2) END AS utilization_pct
  FROM net
), known AS (
  SELECT *, date_diff('day', DATE '2026-01-01', sim_date) AS day_index FROM profit WHERE net_profit IS NOT NULL
), trend0 AS (
  SELECT *, round(sum(round(net_profit * 1e2)::BIGINT) OVER w / count(net_profit) OVER w / 1e2, 2) AS rolling_avg_profit, count(net_profit) OVER w AS history_days,
         CASE WHEN count(net_profit) OVER w > 1 THEN round(regr_slope(net_profit, day_index::DOUBLE) OVER w, 4) END AS profit_slope
  FROM known WINDOW w AS (PARTITION BY vehicle_id ORDER BY day_index RANGE BETWEEN 6 PRECEDING AND CURRENT ROW)
), trend AS (
  SELECT *, CASE WHEN history_days < 4 OR rolling_avg_profit IS NULL THEN 'INSUFFICIENT_DATA' WHEN rolling_avg_profit <= 0 AND profit_slope < 0 THEN 'CRITICAL'
                 WHEN rolling_avg_profit <= 0 THEN 'UNPROFITABLE' WHEN profit_slope < 0 THEN 'WATCH' ELSE 'HEALTHY' END AS classification
  FROM trend0
), pnl AS (
  SELECT p.vehicle_id, p.sim_date, coalesce(p.trips, 0) AS trips, coalesce(p.telemetry_distance_km, 0) AS telemetry_distance_km, coalesce(p.paid_distance_km, 0) AS paid_distance_km,
         coalesce(p.deadhead_distance_km, 0) AS deadhead_distance_km, coalesce(p.on_trip_hours, 0) AS on_trip_hours, coalesce(p.idle_hours, 0) AS idle_hours, coalesce(p.pings, 0) AS pings,
         coalesce(p.revenue, 0) AS revenue, p.fuel_cost, p.maintenance_cost, p.partner_distance_km, p.expense_status, p.distance_variance_pct, p.net_profit, p.profit_per_km,
         p.margin_pct, p.utilization_pct, t.rolling_avg_profit, coalesce(t.history_days, 0) AS history_days, t.profit_slope, coalesce(t.classification, 'INSUFFICIENT_DATA') AS classification
  FROM profit p LEFT JOIN trend t USING (vehicle_id, sim_date)
), zact AS (
  SELECT zone_id, sim_date, hour(event_time)::INTEGER AS sim_hour, count(DISTINCT CASE WHEN status = 'on_trip' THEN trip_id END) AS trips, count(DISTINCT vehicle_id) AS active_vehicles,
         round(count(*) FILTER (status = 'idle') / count(*), 4) AS idle_ratio, round(sum(round(speed_kmh * 1e6)::BIGINT) / count(speed_kmh) / 1e6, 1) AS avg_speed_kmh
  FROM zoned GROUP BY 1, 2, 3
), zearn AS (
  SELECT zone_id, sim_date, hour(event_time)::INTEGER AS sim_hour, round(sum(fare), 2) AS earnings FROM completions GROUP BY 1, 2, 3
), zh AS (
  SELECT a.*, coalesce(e.earnings, 0e0) AS earnings FROM zact a LEFT JOIN zearn e USING (zone_id, sim_date, sim_hour)
), zd AS (
  SELECT zone_id, sim_date, sum(trips)::BIGINT AS trips, round(sum(earnings), 2) AS earnings, max(active_vehicles) AS active_vehicles, round(sum(round(idle_ratio * 1e4)::BIGINT) / count(idle_ratio) / 1e4, 4) AS idle_ratio,
         round(sum(round(avg_speed_kmh * 1e1)::BIGINT) / count(avg_speed_kmh) / 1e1, 1) AS avg_speed_kmh, count(*) AS hours_reported
  FROM zh GROUP BY 1, 2
), win AS (
  SELECT z.*, to_timestamp(ws)::TIMESTAMP AS window_start, to_timestamp(ws + 900)::TIMESTAMP AS window_end
  FROM (SELECT *, unnest([floor(epoch(event_time) / 300) * 300 - 600, floor(epoch(event_time) / 300) * 300 - 300, floor(epoch(event_time) / 300) * 300]) AS ws FROM zoned) z
), act AS (
  SELECT window_start, window_end, zone_id, count(DISTINCT vehicle_id) AS active_vehicles, count(DISTINCT CASE WHEN status = 'on_trip' THEN trip_id END) AS trips,
         round(sum(round(speed_kmh * 1e6)::BIGINT) / count(speed_kmh) / 1e6, 1) AS avg_speed_kmh, round(count(*) FILTER (status = 'idle') / count(*), 4) AS idle_ratio, count(*) AS pings
  FROM win GROUP BY 1, 2, 3
), earn AS (
  SELECT to_timestamp(ws)::TIMESTAMP AS window_start, to_timestamp(ws + 900)::TIMESTAMP AS window_end, zone_id, round(sum(fare), 2) AS earnings, count(*) AS completed_trips
  FROM (SELECT *, unnest([floor(epoch(event_time) / 300) * 300 - 600, floor(epoch(event_time) / 300) * 300 - 300, floor(epoch(event_time) / 300) * 300]) AS ws FROM completions) GROUP BY 1, 2, 3
), newest_act AS (
  SELECT * FROM act WHERE zone_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY zone_id ORDER BY window_end DESC) = 1
), newest_earn AS (
  SELECT * FROM earn WHERE zone_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY zone_id ORDER BY window_end DESC) = 1
), runs AS (
  SELECT *, sum(ends) OVER (PARTITION BY vehicle_id ORDER BY event_time, event_id) AS run
  FROM (SELECT *, CASE WHEN status IS DISTINCT FROM 'idle' OR coalesce(epoch_us(event_time) - lag(epoch_us(event_time)) OVER (PARTITION BY vehicle_id ORDER BY event_time, event_id) > 86400000000, false) THEN 1 ELSE 0 END AS ends FROM zoned)
), idle0 AS (
  SELECT *, min(event_time) OVER (PARTITION BY vehicle_id, run) AS idle_since FROM runs WHERE status = 'idle'
), idle1 AS (
  SELECT *, epoch_us(event_time) - epoch_us(idle_since) AS idle_us,
         CASE WHEN epoch_us(event_time) - epoch_us(idle_since) >= 5400000000 THEN 'CRITICAL' WHEN epoch_us(event_time) - epoch_us(idle_since) >= 2700000000 THEN 'WARNING' END AS severity
  FROM idle0
), alerts AS (
  SELECT *, substr(sha1(vehicle_id || '|' || strftime(idle_since, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(idle_since) % 1000000 = 0 THEN '' ELSE '.' || lpad((epoch_us(idle_since) % 1000000)::VARCHAR, 6, '0') END), 1, 16) AS alert_id
  FROM idle1 WHERE severity IS NOT NULL QUALIFY row_number() OVER (PARTITION BY vehicle_id, run, severity ORDER BY event_time, event_id) = 1
), snap AS (
  SELECT a.window_end::DATE AS sim_date, a.zone_id, hour(a.window_end)::INTEGER AS sim_hour, 15 AS window_minutes, a.trips, coalesce(e.earnings, 0e0) AS earnings, a.active_vehicles, a.idle_ratio, a.avg_speed_kmh
  FROM act a LEFT JOIN earn e USING (window_end, zone_id)
  WHERE a.zone_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY a.zone_id, a.window_end::DATE, hour(a.window_end) ORDER BY a.window_end DESC) = 1
), held AS (
  SELECT e.sim_date, e.zone_id, e.earnings AS se, b.earnings AS be
  FROM (SELECT *, window_end::DATE AS sim_date, hour(window_end)::INTEGER AS sim_hour FROM earn WHERE zone_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY zone_id ORDER BY window_end DESC) <= 96) e
  JOIN zh b USING (sim_date, zone_id, sim_hour) QUALIFY row_number() OVER (PARTITION BY e.zone_id, e.sim_date, sim_hour ORDER BY e.window_end DESC) = 1
), pairs AS (
  SELECT s.sim_date, s.zone_id, s.window_minutes, s.trips AS st, s.earnings AS se, s.idle_ratio AS si, s.active_vehicles AS sa, b.trips AS bt, b.earnings AS be, b.idle_ratio AS bi, b.active_vehicles AS ba
  FROM snap s JOIN zh b USING (sim_date, zone_id, sim_hour)
), rzone AS (
  SELECT sim_date, zone_id, 'trips_per_min' AS metric, st / window_minutes::DOUBLE AS s, bt / 60e0 AS b FROM pairs
  UNION ALL SELECT sim_date, zone_id, 'earnings_per_min', se / window_minutes, be / 60e0 FROM pairs
  UNION ALL SELECT sim_date, zone_id, 'idle_ratio', si, bi FROM pairs
  UNION ALL SELECT sim_date, zone_id, 'active_vehicles_window_biased', sa::DOUBLE, ba::DOUBLE FROM pairs
), dzone AS (
  SELECT sim_date, zone_id, metric, round(s, 4) AS speed_value, round(b, 4) AS batch_value, CASE WHEN abs(b) <> 0 THEN round(100e0 * (s - b) / abs(b), 3) END AS delta_pct FROM rzone
), pfleet AS (
  SELECT sim_date, sum(st) AS st, sum(se) AS se, sum(round(si * 1e4)::BIGINT) / count(si) / 1e4 AS si, max(window_minutes) AS w, sum(bt) AS bt, sum(be) AS be, sum(round(bi * 1e4)::BIGINT) / count(bi) / 1e4 AS bi FROM pairs GROUP BY 1
), rfleet AS (
  SELECT sim_date, 'fleet_trips_per_min' AS metric, st / w::DOUBLE AS s, bt / 60e0 AS b FROM pfleet
  UNION ALL SELECT sim_date, 'fleet_earnings_per_min', se / w, be / 60e0 FROM pfleet
  UNION ALL SELECT sim_date, 'fleet_idle_ratio', si, bi FROM pfleet
), reg AS (
  SELECT 'V' || lpad((c_custkey // 10)::VARCHAR, 9, '0') AS vehicle_id, 'model-' || lower(substr(c_mktsegment, 1, 4)) AS model,
         (['petrol', 'diesel', 'hybrid', 'electric'])[c_nationkey % 4 + 1] AS fuel_type, (c_nationkey % 3 + 4)::INTEGER AS capacity,
         'Z' || lpad((c_nationkey % 12 + 1)::VARCHAR, 2, '0') AS home_zone, c_custkey AS "offset"
  FROM customer
), registry AS (
  SELECT * FROM reg QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY "offset" DESC) = 1
), days AS (
  SELECT unnest(generate_series((SELECT min(sim_date) FROM zoned), (SELECT max(sim_date) FROM zoned), INTERVAL 1 DAY))::DATE AS sim_date
)
"""

_D = "strftime(sim_date, '%Y-%m-%d') AS sim_date"
_PNL = f"""vehicle_id, {_D}, trips, round(telemetry_distance_km, 6) AS telemetry_distance_km, round(paid_distance_km, 6) AS paid_distance_km, round(deadhead_distance_km, 6) AS deadhead_distance_km,
  round(on_trip_hours, 6) AS on_trip_hours, round(idle_hours, 6) AS idle_hours, pings, revenue, fuel_cost, maintenance_cost, expense_status, distance_variance_pct, net_profit, profit_per_km, margin_pct,
  utilization_pct, rolling_avg_profit, history_days, profit_slope, classification"""

#: What each query selects after the prelude.
SELECTS = {
    "scan_day": f"SELECT event_id, vehicle_id, status, {_D}, source_partition, source_offset FROM valid WHERE sim_date = DATE '2024-01-15'",
    "stream_replay": "SELECT epoch(window_end)::BIGINT AS window_end_s, zone_id, earnings, completed_trips FROM earn",
    "read_expenses": f"SELECT vehicle_id, fuel_cost, maintenance_cost, partner_distance_km, service_flag, partner_id, {_D} FROM exp",
    "stream_profile": """SELECT count(*) AS n_rows, count(*) FILTER (lat IS NULL OR lon IS NULL) AS null_coordinates, count(*) FILTER (trip_id IS NULL) AS null_trips, 0::BIGINT AS wrong_keys,
        epoch_us(min(event_time)) AS first_event_us, epoch_us(max(event_time)) AS last_event_us, count(*) FILTER (status = 'idle') AS n_idle, count(*) FILTER (status = 'enroute') AS n_enroute,
        count(*) FILTER (status = 'on_trip') AS n_on_trip FROM tel""",
    "wire_roundtrip": "SELECT event_id, vehicle_id, length(vehicle_id)::INTEGER + 5 AS wire_bytes, true AS same FROM tel",
    "decode_payload": "SELECT event_id, vehicle_id, trip_id, status, fare, epoch_us(event_time) AS event_us, source_partition, source_offset FROM tel",
    "zone_dim": "SELECT zones.*, coalesce(n, 0) AS pings FROM zones LEFT JOIN (SELECT zone_id, count(*) AS n FROM zoned GROUP BY 1) USING (zone_id)",
    "dlq_envelope": """SELECT vehicle_id AS _key, event_id AS payload, rejection_reason, 'event_id= ' || event_id || ' status= ' || status AS detail_start, 'validate_telemetry' AS validator,
        epoch_us(event_time) AS rejected_at_us, 'telemetry' AS source_topic, source_partition, source_offset FROM checked WHERE rejection_reason IS NOT NULL""",
    "validate_telemetry": "SELECT event_id, rejection_reason, rejection_reason IS NULL AS is_valid FROM checked",
    "rejected_by_reason": "SELECT rejection_reason, count(*) AS n FROM checked WHERE rejection_reason IS NOT NULL GROUP BY 1",
    "dedup_events": "SELECT event_id, vehicle_id FROM tel",
    "sim_time_of": "SELECT event_id, epoch_us(event_time) AS real_us, (1767225600000000 + (epoch_us(event_time) - 1704067200000000) * 288)::BIGINT AS sim_us FROM tel",
    "haversine_km": "SELECT event_id, round(km, 6) AS segment_km, minutes AS segment_minutes FROM seg",
    "expense_file_verdict": """SELECT 'day-' || lpad(day::VARCHAR, 2, '0') AS file,
        CASE WHEN day % 10 IN (1, 2, 3, 4, 5, 6) THEN 'corrupt' ELSE 'ok' END AS verdict,
        CASE day % 10 WHEN 1 THEN 'unreadable' WHEN 2 THEN 'missing columns: fuel_cost' WHEN 3 THEN 'blank vehicle_id' WHEN 4 THEN 'duplicate vehicle_id'
             WHEN 5 THEN 'negative or non-numeric amount' WHEN 6 THEN 'negative or non-numeric amount' END AS detail,
        (count(*) + CASE WHEN day % 10 = 4 THEN 1 ELSE 0 END)::BIGINT AS n_rows
        FROM o2 GROUP BY day""",
    "expense_calendar_verdict": f"""SELECT {_D}, CASE WHEN day IS NULL THEN 'missing' WHEN day % 10 IN (1, 2, 3, 4, 5, 6) THEN 'corrupt' ELSE 'ok' END AS verdict,
        CASE WHEN day IS NULL THEN 'WARN' WHEN day % 10 IN (1, 2, 3, 4, 5, 6) THEN 'FAIL' ELSE 'PASS' END AS dq_status
        FROM (SELECT unnest(generate_series((SELECT min(sim_date) - 2 FROM zoned), (SELECT max(sim_date) + 2 FROM zoned), INTERVAL 1 DAY))::DATE AS sim_date) LEFT JOIN (SELECT DISTINCT day, DATE '2024-01-01' + day AS sim_date FROM o2) USING (sim_date)""",
    "quarantine_expenses": """SELECT reason, count(*) AS n FROM (SELECT CASE day % 10 WHEN 1 THEN 'unreadable' WHEN 2 THEN 'missing columns: fuel_cost' WHEN 3 THEN 'blank vehicle_id'
        WHEN 4 THEN 'duplicate vehicle_id' WHEN 5 THEN 'negative or non-numeric amount' WHEN 6 THEN 'negative or non-numeric amount' ELSE 'kept' END AS reason FROM o2
        UNION ALL SELECT 'duplicate vehicle_id' FROM (SELECT DISTINCT day FROM o2 WHERE day % 10 = 4)) GROUP BY 1""",
    "with_zone": f"SELECT event_id, zone_id, {_D} FROM zoned",
    "with_registry": "SELECT event_id, vehicle_id, fuel_type, capacity, home_zone AS registry_home_zone FROM valid LEFT JOIN registry USING (vehicle_id)",
    "latest_per_key": 'SELECT vehicle_id, model, fuel_type, capacity, home_zone, "offset" FROM registry',
    "scd2_vehicle": """SELECT vehicle_id, fuel_type, capacity, valid_from, lead(valid_from) OVER w AS valid_to, lead(valid_from) OVER w IS NULL AS is_current FROM (
        SELECT vehicle_id, fuel_type, capacity, "offset" AS valid_from, lag(fuel_type || capacity) OVER (PARTITION BY vehicle_id ORDER BY "offset") AS before FROM reg)
        WHERE before IS DISTINCT FROM fuel_type || capacity WINDOW w AS (PARTITION BY vehicle_id ORDER BY valid_from)""",
    "dim_date": f"SELECT {_D}, (dayofweek(sim_date) + 1)::INTEGER AS day_of_week, dayofweek(sim_date) IN (0, 6) AS is_weekend FROM days",
    "zone_activity": """SELECT epoch(window_end)::BIGINT AS window_end_s, zone_id, avg_speed_kmh, idle_ratio, pings FROM act""",
    "zone_earnings": "SELECT epoch(window_end)::BIGINT AS window_end_s, zone_id, earnings, completed_trips FROM earn",
    "zone_hourly_exact": f"SELECT zone_id, {_D}, sim_hour, trips, active_vehicles, idle_ratio, avg_speed_kmh, earnings FROM zh",
    "dedup_trips": "SELECT DISTINCT trip_id, fare FROM zoned WHERE trip_id IS NOT NULL AND fare IS NOT NULL",
    "fleet_snapshot": "SELECT epoch(window_end)::BIGINT AS window_end_s, sum(active_vehicles)::BIGINT AS active_vehicles, sum(trips)::BIGINT AS trips, round(sum(round(idle_ratio * 1e4)::BIGINT) / count(idle_ratio) / 1e4, 4) AS idle_ratio, round(sum(round(avg_speed_kmh * 1e1)::BIGINT) / count(avg_speed_kmh) / 1e1, 1) AS avg_speed_kmh FROM act GROUP BY window_start, window_end",
    "trip_completions": f"SELECT trip_id, {_D}, event_id, zone_id, fare FROM completions",
    "reconstruct_trips": f"SELECT vehicle_id, {_D}, trips, round(telemetry_distance_km, 6) AS telemetry_distance_km, round(paid_distance_km, 6) AS paid_distance_km, round(deadhead_distance_km, 6) AS deadhead_distance_km, round(on_trip_hours, 6) AS on_trip_hours, round(idle_hours, 6) AS idle_hours, pings FROM trips",
    "daily_revenue": f"SELECT vehicle_id, {_D}, revenue FROM revenue",
    "expense_reconciliation": f"SELECT vehicle_id, {_D}, expense_status, fuel_cost, maintenance_cost, pings, revenue, distance_variance_pct FROM joined",
    "compute_profit": f"SELECT vehicle_id, {_D}, net_profit, profit_per_km, margin_pct, utilization_pct FROM profit",
    "profit_trend": f"SELECT vehicle_id, {_D}, net_profit, rolling_avg_profit, history_days, profit_slope FROM trend0",
    "profit_trend_asof": f"SELECT vehicle_id, {_D}, rolling_avg_profit, history_days, profit_slope, classification FROM trend WHERE sim_date = DATE '2024-01-20'",
    "classify_vehicles": f"SELECT vehicle_id, {_D}, classification FROM trend",
    "distance_outliers": f"SELECT vehicle_id, {_D}, distance_variance_pct FROM joined WHERE distance_variance_pct > 10",
    "vehicle_daily_pnl": f"SELECT {_PNL} FROM pnl",
    "unprofitable_topk": f"SELECT vehicle_id, {_D}, rolling_avg_profit, net_profit, classification FROM pnl WHERE pnl.sim_date = (SELECT max(sim_date) FROM pnl) ORDER BY pnl.rolling_avg_profit ASC NULLS LAST, pnl.net_profit ASC NULLS LAST, vehicle_id LIMIT 10",
    "vehicle_history": f"SELECT vehicle_id, {_D}, net_profit, rolling_avg_profit, classification FROM pnl WHERE vehicle_id = 'V000000007' ORDER BY pnl.sim_date DESC LIMIT 14",
    "zone_daily": f"SELECT zone_id, {_D}, trips, earnings, active_vehicles, idle_ratio, avg_speed_kmh, hours_reported FROM zd",
    "revenue_crosscheck": f"""SELECT {_D}, pnl_revenue, zone_earnings, round(coalesce(pnl_revenue, 0) - coalesce(zone_earnings, 0), 2) AS delta
        FROM (SELECT sim_date, round(sum(revenue), 2) AS pnl_revenue FROM pnl GROUP BY 1) FULL JOIN (SELECT sim_date, round(sum(earnings), 2) AS zone_earnings FROM zh GROUP BY 1) USING (sim_date)""",
    "pipeline_status": "SELECT (SELECT strftime(max(sim_date), '%Y-%m-%d') FROM pnl) AS latest_fact, (SELECT count(*) FROM pnl) AS pnl_rows, (SELECT count(*) FROM zh WHERE zone_id IS NOT NULL) AS zone_rows, (SELECT count(*) FROM pnl WHERE sim_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20') AS restated_rows",
    "classification_counts": f"SELECT {_D}, classification, count(*) AS n FROM pnl GROUP BY pnl.sim_date, classification",
    "batch_check": """SELECT 'pnl rows' AS what, count(*) AS n FROM pnl UNION ALL SELECT 'pnl dates', count(DISTINCT sim_date) FROM pnl UNION ALL SELECT 'zone rows', count(*) FROM zh WHERE zone_id IS NOT NULL
        UNION ALL SELECT 'zone dates', count(DISTINCT sim_date) FROM zh UNION ALL SELECT 'restated rows', count(*) FROM pnl WHERE sim_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'
        UNION ALL SELECT 'watermark day', (max(sim_date) - DATE '1970-01-01')::BIGINT FROM zh""",
    "run_totals": """SELECT expense_status AS what, count(*) AS n FROM joined GROUP BY 1 UNION ALL SELECT classification, count(*) FROM pnl GROUP BY 1 UNION ALL SELECT 'zones', count(DISTINCT zone_id) FROM zh
        UNION ALL SELECT 'hours', count(DISTINCT (sim_date, sim_hour)) FROM zh""",
    "live_zone_view": """SELECT zone_id, epoch(a.window_end)::BIGINT AS activity_window_end_s, a.trips, a.active_vehicles, a.idle_ratio, a.avg_speed_kmh, a.pings, epoch(e.window_end)::BIGINT AS earnings_window_end_s, e.earnings, e.completed_trips
        FROM newest_act a FULL JOIN newest_earn e USING (zone_id)""",
    "live_fleet_snapshot": "SELECT sum(active_vehicles)::BIGINT AS active_vehicles, sum(trips)::BIGINT AS trips, round(sum(round(idle_ratio * 1e4)::BIGINT) / count(idle_ratio) / 1e4, 4) AS idle_ratio, count(*) AS zones_reporting, epoch(max(window_end))::BIGINT AS window_end_s FROM newest_act",
    "live_zone_earnings_series": """SELECT zone_id, age::INTEGER AS age, epoch(window_end)::BIGINT || ':' || (round(earnings, 2)::DECIMAL(14,2))::VARCHAR AS point FROM (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY window_end DESC) AS age FROM earn WHERE zone_id IS NOT NULL) WHERE age <= 96""",
    "stream_zone_earnings_series": """SELECT zone_id, age::INTEGER AS age, epoch(window_end)::BIGINT || ':' || (round(earnings, 2)::DECIMAL(14,2))::VARCHAR AS point FROM (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY window_end DESC) AS age FROM earn WHERE zone_id IS NOT NULL) WHERE age <= 96""",
    "reconcile_state": f"""SELECT {_D}, zone_id, metric, round(s, 4) AS speed_value, round(b, 4) AS batch_value, CASE WHEN abs(b) <> 0 THEN round(100e0 * (s - b) / abs(b), 3) END AS delta_pct FROM (
        SELECT sim_date, zone_id, 'earnings_per_min' AS metric, se / 15e0 AS s, be / 60e0 AS b FROM held
        UNION ALL SELECT sim_date, 'ALL', 'fleet_earnings_per_min', sum(round(se * 1e2)::BIGINT) / 1e2 / 15e0, sum(round(be * 1e2)::BIGINT) / 1e2 / 60e0 FROM held GROUP BY 1)""",
    "parse_series": "SELECT zone_id, age::INTEGER AS age, epoch(window_end)::BIGINT AS window_end_s, earnings FROM (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY window_end DESC) AS age FROM earn WHERE zone_id IS NOT NULL) WHERE age <= 96",
    "live_vehicle_state": """SELECT vehicle_id, status, coalesce(zone_id, '') AS zone_id, coalesce(trip_id, '') AS trip_id, (round(lat, 5)::DECIMAL(12,5))::VARCHAR AS lat, (round(lon, 5)::DECIMAL(12,5))::VARCHAR AS lon, (round(speed_kmh, 1)::DECIMAL(12,1))::VARCHAR AS speed_kmh, epoch_us(event_time) AS updated_us
        FROM zoned QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY event_time DESC, event_id DESC) = 1""",
    "live_vehicle_lookup": """SELECT vehicle_id, status, coalesce(zone_id, '') AS zone_id, epoch_us(event_time) AS updated_us FROM zoned WHERE vehicle_id = 'V000000007' QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY event_time DESC, event_id DESC) = 1""",
    "live_view_ttl": """SELECT vehicle_id, epoch_us(last) AS updated_us FROM (SELECT vehicle_id, max(event_time) AS last FROM zoned GROUP BY 1) WHERE last >= (SELECT max(event_time) FROM zoned) - INTERVAL 30 MINUTE""",
    "zones_live_complete": "SELECT z.zone_id, z.zone_name, a.trips, a.zone_id IS NOT NULL AS reporting FROM zones z LEFT JOIN (SELECT * FROM newest_act WHERE trips > 0) a USING (zone_id)",
    "idle_alerts": "SELECT alert_id, vehicle_id, severity, epoch_us(idle_since) AS idle_since_us, epoch_us(event_time) AS raised_at_us, zone_id FROM alerts",
    "alert_envelope": "SELECT vehicle_id AS _key, alert_id, 'VEHICLE_IDLE_PROLONGED' AS alert_type, severity, 'speed' AS source_layer, ' simulated minutes since ' || strftime(idle_since, '%Y-%m-%d %H:%M') AS detail_end, zone_id FROM alerts",
    "alert_feed": "SELECT alert_id, severity, epoch_us(event_time) AS raised_at_us FROM alerts ORDER BY event_time DESC, alert_id, severity LIMIT 200",
    "alert_json_roundtrip": "SELECT alert_id, vehicle_id, severity FROM alerts",
    "stale_state": """SELECT s.vehicle_id, s.last_status, epoch_us(i.since) AS idle_since_us, i.since IS NULL OR epoch_us((SELECT max(event_time) FROM zoned)) - epoch_us(i.since) > 7200000000 AS stale FROM
        (SELECT vehicle_id, status AS last_status FROM zoned QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY event_time DESC, event_id DESC) = 1) s
        LEFT JOIN (SELECT z.vehicle_id, min(z.event_time) AS since FROM zoned z LEFT JOIN (SELECT vehicle_id, event_time AS bt, event_id AS be FROM zoned WHERE status <> 'idle' QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY event_time DESC, event_id DESC) = 1) b USING (vehicle_id)
                   WHERE z.status = 'idle' AND (b.bt IS NULL OR z.event_time > b.bt OR (z.event_time = b.bt AND z.event_id > b.be)) GROUP BY 1) i USING (vehicle_id)""",
    "upsert_zone_hourly": f"SELECT zone_id, {_D}, sim_hour, trips, earnings, CASE WHEN zh.sim_date >= DATE '2024-01-10' THEN 'run-2' ELSE 'run-1' END AS job_run_id FROM zh WHERE zone_id IS NOT NULL",
    "merge_files": f"""SELECT {_D}, zh.sim_date <> DATE '2024-01-15' AS kept, count(*) AS n_rows, (sum(trips) + CASE WHEN zh.sim_date = DATE '2024-01-15' THEN count(*) ELSE 0 END)::BIGINT AS trips,
        CASE WHEN zh.sim_date = DATE '2024-01-15' THEN count(*) ELSE 0 END AS of_run_2 FROM zh WHERE zone_id IS NOT NULL GROUP BY zh.sim_date""",
    "upsert_pnl_restatement": f"""SELECT vehicle_id, {_D}, net_profit, CASE WHEN pnl.sim_date >= DATE '2024-01-10' THEN 'run-2' ELSE 'run-1' END AS job_run_id,
        (pnl.sim_date >= DATE '2024-01-10' AND pnl.sim_date <= DATE '2024-01-20')::INTEGER AS restatement_count, pnl.sim_date >= DATE '2024-01-10' AND pnl.sim_date <= DATE '2024-01-20' AS restated FROM pnl""",
    "restatement_log": f"SELECT {_D}, strftime(pnl.sim_date, '%Y-%m-%d') || '/run-2' AS marker_key, 'run-2' AS triggered_run, count(*) AS n_rows FROM pnl WHERE pnl.sim_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' GROUP BY pnl.sim_date",
    "trend_refresh": f"SELECT vehicle_id, {_D}, net_profit, rolling_avg_profit, history_days, profit_slope, classification FROM trend",
    "recompute_days": f"""SELECT {_D}, zone_id, metric, speed_value, batch_value, delta_pct, CASE WHEN dzone.sim_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-09' THEN 'run-2' ELSE 'run-1' END AS run
        FROM dzone WHERE dzone.sim_date NOT BETWEEN DATE '2024-01-05' AND DATE '2024-01-10' OR (dzone.sim_date <= DATE '2024-01-09' AND metric = 'idle_ratio')""",
    "retention": f"SELECT {_D}, count(*) AS n, (sum(trips) + CASE WHEN zh.sim_date >= DATE '2024-01-25' THEN 100 * count(*) ELSE 0 END)::BIGINT AS trips FROM zh WHERE zone_id IS NOT NULL AND zh.sim_date >= DATE '2024-01-20' GROUP BY zh.sim_date",
    "zone_history": f"""SELECT {_D}, zone_id, sim_hour, trips, earnings, active_vehicles, idle_ratio, source FROM (
        SELECT *, (sim_date - DATE '1970-01-01') * 24 + sim_hour AS at_hour, max((sim_date - DATE '1970-01-01') * 24 + sim_hour) OVER () AS newest FROM (
          SELECT zone_id, sim_date, sim_hour, trips, earnings, active_vehicles, idle_ratio, 'batch' AS source FROM zh WHERE zone_id IS NOT NULL AND sim_date <= (SELECT max(sim_date) - 1 FROM zoned)
          UNION ALL SELECT zone_id, sim_date, sim_hour, trips, earnings, active_vehicles, idle_ratio, 'speed' FROM snap WHERE sim_date > (SELECT max(sim_date) - 1 FROM zoned))) AS h WHERE at_hour > newest - 48""",
    "stalled_queries": "SELECT 'query-' || source_partition AS query, epoch_us(max(event_time)) AS last_progress_us FROM tel GROUP BY source_partition HAVING epoch_us((SELECT max(event_time) FROM tel)) - epoch_us(max(event_time)) > 120000000",
    "advance_hwm": "SELECT strftime(greatest(DATE '2024-01-12', (SELECT max(sim_date) FROM zh)), '%Y-%m-%d') AS high_water_mark, '2024-06-01' AS never_backwards",
    "speed_snapshot": f"SELECT zone_id, {_D}, sim_hour, window_minutes, trips, earnings, active_vehicles, idle_ratio, avg_speed_kmh FROM snap",
    "dq_log": f"SELECT unnest(['run-1', 'run-2']) AS job_run_id, {_D}, 'rejected_rows' AS check_name, CASE WHEN count(*) FILTER (rejection_reason IS NOT NULL) > 10 THEN 'WARN' ELSE 'PASS' END AS status, count(*) FILTER (rejection_reason IS NOT NULL)::DOUBLE AS observed, 10e0 AS threshold FROM checked GROUP BY checked.sim_date",
    "dq_checks": f"""SELECT {_D}, check_name, round(observed, 6) AS observed, threshold,
        CASE WHEN check_name = 'vehicles' THEN CASE WHEN observed < 1 THEN 'FAIL' ELSE 'PASS' END WHEN observed > fail THEN 'FAIL' WHEN observed > threshold THEN 'WARN' ELSE 'PASS' END AS status
        FROM (SELECT sim_date, unnest([
            {{'check_name': 'rejected_share', 'observed': rejected, 'threshold': 5e-2, 'fail': 2e-1}}, {{'check_name': 'null_coordinate_share', 'observed': nulls, 'threshold': 2e-2, 'fail': 1e-1}},
            {{'check_name': 'duplicate_events', 'observed': twice, 'threshold': 0e0, 'fail': 1e2}}, {{'check_name': 'missing_expense_share', 'observed': noexp, 'threshold': 1e-1, 'fail': 5e-1}},
            {{'check_name': 'missing_telemetry_share', 'observed': notel, 'threshold': 1e-1, 'fail': 5e-1}}, {{'check_name': 'distance_outlier_share', 'observed': far, 'threshold': 2e-1, 'fail': 1e0}},
            {{'check_name': 'vehicles', 'observed': cars, 'threshold': 1e0, 'fail': 0e0}}], recursive := true)
          FROM (SELECT sim_date, count(*) FILTER (rejection_reason IS NOT NULL) / count(*) AS rejected, count(*) FILTER (lat IS NULL) / count(*) AS nulls,
                       (count(*) - count(DISTINCT event_id))::DOUBLE AS twice, count(DISTINCT vehicle_id)::DOUBLE AS cars FROM checked GROUP BY 1)
          JOIN (SELECT sim_date, count(*) FILTER (expense_status = 'MISSING_EXPENSE') / count(*) AS noexp, count(*) FILTER (expense_status = 'MISSING_TELEMETRY') / count(*) AS notel,
                       count(*) FILTER (distance_variance_pct > 10) / count(*) AS far FROM pnl GROUP BY 1) USING (sim_date))""",
    "reconcile_zone": f"SELECT {_D}, zone_id, metric, speed_value, batch_value, delta_pct FROM dzone",
    "reconcile_fleet": f"SELECT {_D}, 'ALL' AS zone_id, metric, round(s, 4) AS speed_value, round(b, 4) AS batch_value, CASE WHEN abs(b) <> 0 THEN round(100e0 * (s - b) / abs(b), 3) END AS delta_pct FROM rfleet",
    "reconcile_summary": "SELECT metric, count(delta_pct) AS n, round(sum(round(abs(delta_pct) * 1e3)::BIGINT) / count(delta_pct) / 1e3, 2) AS avg_abs_delta_pct, round(max(abs(delta_pct)), 2) AS max_abs_delta_pct FROM dzone GROUP BY 1",
    "date_ownership": "SELECT strftime(d, '%Y-%m-%d') AS sim_date, CASE WHEN d <= (SELECT max(sim_date) - 4 FROM zh) THEN 'batch' WHEN d = (SELECT max(sim_date) - 1 FROM zh) THEN 'speed' WHEN d > (SELECT max(sim_date) - 1 FROM zh) THEN 'future' ELSE 'gap' END AS owner FROM (SELECT unnest(generate_series((SELECT max(sim_date) - 8 FROM zh), (SELECT max(sim_date) + 2 FROM zh), INTERVAL 1 DAY))::DATE AS d)",
    "merged_utilization": """SELECT strftime(sim_date, '%Y-%m-%d') AS sim_date, zone_id, trips, earnings, 'batch' AS source, true AS exact, round((1e0 - idle_ratio) * 100, 2) AS utilization_pct FROM zd
        WHERE zone_id IS NOT NULL AND sim_date BETWEEN (SELECT max(sim_date) - 8 FROM zh) AND (SELECT max(sim_date) - 4 FROM zh)
        UNION ALL SELECT strftime((SELECT max(sim_date) - 1 FROM zh), '%Y-%m-%d'), a.zone_id, a.trips, coalesce(e.earnings, 0e0), 'speed', false, round((1e0 - a.idle_ratio) * 100, 2) FROM newest_act a LEFT JOIN newest_earn e USING (zone_id)""",
    "merge_envelope": """SELECT 5::BIGINT AS batch_dates, 1::BIGINT AS speed_dates, 2::BIGINT AS gap_dates, 3::BIGINT AS future_dates, 3 AS watermark_age_days,
        'batch-complete-through ' || strftime(m - 4, '%Y-%m-%d') || '; 2 date(s) in neither view (' || strftime(m - 3, '%Y-%m-%d') || '..' || strftime(m - 2, '%Y-%m-%d') || ') - the batch layer is behind the simulated clock; 3 requested date(s) are in the future ('
        || strftime(m, '%Y-%m-%d') || '..' || strftime(m + 2, '%Y-%m-%d') || ') - the simulation has only reached ' || strftime(m - 1, '%Y-%m-%d') AS consistency FROM (SELECT max(sim_date) AS m FROM zh)""",
    "merge_degraded": """SELECT strftime(sim_date, '%Y-%m-%d') AS sim_date, zone_id, 'batch' AS source, 'speed' AS missing_stores FROM zd WHERE zone_id IS NOT NULL AND sim_date BETWEEN (SELECT max(sim_date) - 8 FROM zh) AND (SELECT max(sim_date) - 4 FROM zh)""",
    "watermark_age": "SELECT strftime(max(sim_date), '%Y-%m-%d') AS high_water_mark, date_diff('day', max(sim_date), (SELECT max(event_time)::DATE + 4 FROM tel)) AS age_days, date_diff('day', max(sim_date), (SELECT max(event_time)::DATE + 4 FROM tel)) > 2 AS alert FROM zh",
    "complete_dates": "SELECT strftime(d, '%Y-%m-%d') AS sim_date FROM (SELECT unnest(generate_series((SELECT greatest(min(sim_date), max(sim_date) - 7) FROM zh), (SELECT max(sim_date) - 1 FROM zh), INTERVAL 1 DAY))::DATE AS d)",
    "next_batch_date": "SELECT strftime(max(sim_date) - 1, '%Y-%m-%d') AS sim_date FROM zh",
    "backfill_range": f"SELECT {_PNL}, CASE WHEN pnl.sim_date >= DATE '2024-01-12' THEN 'run-2' ELSE 'run-1' END AS job_run_id FROM pnl WHERE pnl.sim_date BETWEEN DATE '2024-01-08' AND DATE '2024-01-18'",
    "dlq_rate": f"SELECT {_D}, count(*) FILTER (rejection_reason IS NOT NULL) AS rejected, count(*) FILTER (rejection_reason IS NULL) AS accepted, round(count(*) FILTER (rejection_reason IS NOT NULL) / greatest(count(*) FILTER (rejection_reason IS NULL), 1), 6) AS rate, count(*) FILTER (rejection_reason IS NOT NULL) / greatest(count(*) FILTER (rejection_reason IS NULL), 1) > 5e-2 AS alert FROM checked GROUP BY checked.sim_date",
    "stream_master": f"SELECT {_D}, count(*) AS n, sum(source_offset)::BIGINT AS offsets FROM valid GROUP BY valid.sim_date",
    "stream_log_master": f"SELECT {_D}, count(*) AS n, sum(source_offset)::BIGINT AS offsets FROM valid GROUP BY valid.sim_date",
    "stream_dlq": "SELECT rejection_reason, count(*) AS n FROM checked WHERE rejection_reason IS NOT NULL GROUP BY 1",
    "stream_idle": "SELECT alert_id, vehicle_id, severity, epoch_us(idle_since) AS idle_since_us, epoch_us(event_time) AS raised_at_us FROM alerts",
    "stream_zone_activity": "SELECT epoch(window_end)::BIGINT AS window_end_s, zone_id, avg_speed_kmh, idle_ratio, pings FROM act",
    "stream_zone_earnings": "SELECT epoch(window_end)::BIGINT AS window_end_s, zone_id, earnings, completed_trips FROM earn",
    "stream_zone_earnings_total": "SELECT (3 * count(*))::BIGINT AS completed_trips, round(3 * sum(fare), 2) AS earnings FROM completions",
    "stream_alive": """SELECT vehicle_id, epoch_us(last) AS updated_us FROM (SELECT vehicle_id, max(event_time) AS last FROM zoned GROUP BY 1) WHERE last >= (SELECT max(event_time) FROM zoned) - INTERVAL 30 MINUTE""",
    "stream_rejections": "SELECT rejection_reason, count(*) AS n FROM checked WHERE rejection_reason IS NOT NULL GROUP BY 1",
    "stream_late_side": """SELECT event_id, vehicle_id, count(*) AS n FROM (
        SELECT * FROM valid WHERE reference_time >= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
        UNION ALL SELECT * FROM valid WHERE epoch_us(reference_time) < (SELECT (epoch_us(min(ts)) + epoch_us(max(ts))) // 2 FROM events) AND status = 'enroute'
      ) WHERE event_time < (SELECT max(event_time) FROM valid) - INTERVAL 30 MINUTE GROUP BY 1, 2""",
    "stream_progress": "SELECT 'vehicles' AS query, count(*) AS rows_in, 0::BIGINT AS late_rows FROM events",
    "stream_late_rows": """SELECT epoch(window_end)::BIGINT AS window_end_s, zone_id, pings + coalesce(again, 0) AS pings, true AS late_rows_dropped FROM act LEFT JOIN (
        SELECT window_end AS we, zone_id AS z, count(*) AS again FROM win WHERE reference_time >= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2) ON window_end = we AND zone_id IS NOT DISTINCT FROM z""",
    "stream_vehicles": "SELECT vehicle_id, status, epoch_us(event_time) AS updated_us FROM zoned QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY event_time DESC, event_id DESC) = 1",
}


def half_up(sql: str) -> str:
    """round(x, n) as functions/rounding.py rounds; DuckDB's own rounds some halves the other way."""
    at = 0
    while (at := sql.find("round(", at)) >= 0:
        depth, end, comma = 1, at + len("round("), -1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            comma = end if sql[end] == "," and depth == 1 else comma
            end += 1
        if comma < 0:
            at += 1
            continue
        x, scale = sql[at + len("round(") : comma], f"1e{int(sql[comma + 1 : end - 1])}"
        new = f"(CASE WHEN ({x}) < 0 THEN -(floor(-({x}) * {scale} + 0.5e0)::BIGINT) ELSE floor(({x}) * {scale} + 0.5e0)::BIGINT END / {scale})"
        sql = sql[:at] + new + sql[end:]
        at += 1
    return sql


def needed(sql: str) -> str:
    """sql without the common tables that it does not reach."""
    parts = re.split(r"(?:^WITH |^\), )(\w+)((?:\([^)]*\))?) AS \(", sql.strip(), flags=re.MULTILINE)
    names, heads, bodies = parts[1::3], parts[2::3], parts[3::3]
    last, select = bodies[-1].split("\n)\n", 1)
    bodies = [b.rstrip() for b in [*bodies[:-1], last]]
    words = lambda text: set(re.findall(r"\w+", text))
    reached, todo = set(), words(select)
    for name, body in zip(reversed(names), reversed(bodies)):  # a table names earlier ones only
        if name in todo:
            reached.add(name)
            todo |= words(body)
    kept = ", ".join(f"{n}{h} AS ({b}\n)" for n, h, b in zip(names, heads, bodies) if n in reached)
    return f"WITH {kept}\n{select}" if kept else select


def oracle_sql() -> dict[str, str]:
    found = {name: half_up(needed(f"{PRELUDE}{select}")) for name, select in SELECTS.items()}
    # The restated day's maintenance is doubled.
    cost = "((cents // 9000) % 4000)::DOUBLE / 1e2 AS maintenance_cost"
    restated = PRELUDE.replace(cost, f"CASE WHEN day = 14 THEN 2 ELSE 1 END * {cost}")
    return found | {"trend_refresh": half_up(needed(f"{restated}{SELECTS['trend_refresh']}"))}
