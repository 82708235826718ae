"""Column expressions over coordinates in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371000.0
DEGREE_M = 111320.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points; angles are converted before they are subtracted."""
    return _arc(F.radians(lat2) - F.radians(lat1), F.radians(lon2) - F.radians(lon1), lat1, lat2)


def haversine_of_differences(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points; degrees are subtracted first, which may differ in the last bits."""
    return _arc(F.radians(lat2 - lat1), F.radians(lon2 - lon1), lat1, lat2)


def _arc(dlat: Column, dlon: Column, lat1: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(dlat / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), F.lit(2.0))
    # not least(), which leaves nulls out: a distance from nowhere is null
    return 2 * EARTH_M * F.asin(F.sqrt(F.when(a > 1, F.lit(1.0)).otherwise(a)))


def local_x(lon: Column, lat0: Column, lon0: Column) -> Column:
    """Metres east of an origin on the flat."""
    return F.radians(lon - lon0) * EARTH_M * F.cos(F.radians(lat0))


def local_y(lat: Column, lat0: Column) -> Column:
    """Metres north of an origin."""
    return F.radians(lat - lat0) * EARTH_M


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment on the flat; of a segment without length, from its start."""
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.nullif(size, F.lit(0.0))))).otherwise(F.lit(0.0))
    return F.sqrt(F.pow(px - (ax + t * dx), F.lit(2.0)) + F.pow(py - (ay + t * dy), F.lit(2.0)))


def segment_fraction(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """How far along a segment, from 0 to 1, it is nearest to a point; 0 on one without length."""
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    return F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.nullif(size, F.lit(0.0))))).otherwise(F.lit(0.0))


def sinuosity(path_m: Column, straight_m: Column) -> Column:
    """Path over straight length; 1 where the ends are within a metre."""
    return F.when(straight_m <= 1, F.lit(1.0)).otherwise(path_m / F.nullif(straight_m, F.lit(0.0)))


def ray_crosses(lat: Column, lon: Column, alat: Column, alon: Column, blat: Column, blon: Column) -> Column:
    """Whether a ray from the point along its longitude's growth crosses the edge a-b."""
    return ((alat > lat) != (blat > lat)) & (lon < (blon - alon) * (lat - alat) / F.nullif(blat - alat, F.lit(0.0)) + alon)
