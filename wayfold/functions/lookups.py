"""Units, and codes turned into words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Factors of units, bounds of weather codes, types of sports, severity ranks.
KM_TO_MILES = 0.621371
M_TO_FEET = 3.28084
#: Greatest code of each class; codes above the last are thunderstorms.
WEATHER = ((0, "clear"), (3, "cloud"), (48, "fog"), (67, "rain"), (77, "snow"), (82, "rain"), (86, "snow"))
SPORTS = {
    "AlpineSki": "ski",
    "BackcountrySki": "ski",
    "NordicSki": "ski",
    "Snowboard": "snowboard",
    "MountainBikeRide": "mtb",
    "EMountainBikeRide": "mtb",
    "GravelRide": "mtb",
    "Hike": "hike",
    "Walk": "hike",
    "TrailRun": "hike",
}


def distance(km: Column, imperial: bool) -> Column:
    return km * KM_TO_MILES if imperial else km


def height(m: Column, imperial: bool) -> Column:
    return m * M_TO_FEET if imperial else m


def weather_class(code: Column) -> Column:
    """Class of a weather code; null without one."""
    out = F.when(code.isNull(), F.lit(None).cast("string"))
    for most, name in WEATHER:
        out = out.when(code <= most, name)
    return out.otherwise("storm")


def sport_type(sport: Column) -> Column:
    """Type of a sport, null for sports that are left to be tagged by hand."""
    return F.coalesce(*(F.when(sport == k, v) for k, v in SPORTS.items()))
