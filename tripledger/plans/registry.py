"""Every query of the vehicle-operations engine by name, with the DuckDB SQL that checks it."""

from __future__ import annotations

from tripledger.plans import oracle, vehicle

FLAGSHIP = "vehicle_daily_pnl"


def queries() -> dict:
    return vehicle.queries()


def oracle_sql() -> dict:
    return oracle.oracle_sql()
