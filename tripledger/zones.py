"""The city's zones: a 4 by 3 grid of half-open boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The city's bounds, and its zones by row and column from the south-west.
LAT_MIN, LAT_MAX = 6.85, 6.99
LON_MIN, LON_MAX = 79.82, 79.94
ROWS, COLUMNS = 3, 4
GRID = [
    (2, 1, "Fort", "cbd", 1.8),
    (2, 2, "Union Place", "cbd", 1.8),
    (2, 3, "Airport Road", "airport", 1.4),
    (1, 0, "Kelaniya", "residential", 1.0),
    (1, 1, "Maradana", "residential", 1.0),
    (1, 2, "Borella", "residential", 1.0),
    (1, 3, "Rajagiriya", "residential", 1.0),
    (2, 0, "Wattala", "residential", 1.0),
    (0, 1, "Ratmalana", "industrial", 0.6),
    (0, 2, "Kotte Works", "industrial", 0.6),
    (0, 0, "Moratuwa South", "outskirts", 0.3),
    (0, 3, "Kaduwela", "outskirts", 0.3),
]

SCHEMA = "zone_id string, zone_name string, zone_class string, lat_min double, lat_max double, lon_min double, lon_max double, demand_weight double"


def zone_rows() -> list[tuple]:
    lat, lon = (LAT_MAX - LAT_MIN) / ROWS, (LON_MAX - LON_MIN) / COLUMNS
    return [
        (f"Z{k:02d}", name, kind, LAT_MIN + row * lat, LAT_MIN + (row + 1) * lat, LON_MIN + column * lon, LON_MIN + (column + 1) * lon, weight)
        for k, (row, column, name, kind, weight) in enumerate(GRID, 1)
    ]


def zone_table(spark: SparkSession) -> DataFrame:
    """Twelve rows, so a broadcast of it has a fixed size."""
    return spark.createDataFrame(zone_rows(), SCHEMA)


def zone_of(lat: Column, lon: Column) -> Column:
    """The zone whose half-open box holds a point, from how many rows and columns of the grid begin at or before it; null outside."""
    boxes = zone_rows()
    south, west = (sorted({r[k] for r in boxes}) for k in (3, 5))
    north, east = (max(r[k] for r in boxes) for k in (4, 6))
    steps = lambda c, edges: sum(((c >= F.lit(e)).cast("int") for e in edges[1:]), F.lit(0))
    named = {(r[3], r[5]): r[0] for r in boxes}
    ids = F.array(*[F.lit(named[a, b]) for a in south for b in west])
    inside = (lat >= F.lit(south[0])) & (lat < F.lit(north)) & (lon >= F.lit(west[0])) & (lon < F.lit(east))
    return F.when(inside, F.element_at(ids, steps(lat, south) * len(west) + steps(lon, west) + 1))


def in_city(lat: Column, lon: Column) -> Column:
    """Inclusive at the upper edges, unlike the boxes: a point there is valid and has no zone."""
    return lat.between(F.lit(LAT_MIN), F.lit(LAT_MAX)) & lon.between(F.lit(LON_MIN), F.lit(LON_MAX))
