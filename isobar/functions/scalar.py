"""Column expressions: units, geometry, localisation, coordinates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_008.8
EARTH_AREA_M2, OCEAN_AREA_M2 = 510e12, 361e12
SECONDS_PER_DAY, DAYS_PER_YEAR = 86_400, 365.2422
#: Sea water: density times heat capacity.
RHO_CP = 1025.0 * 3850.0
#: Fields of the ocean.
OCEAN_FIELDS = ("tos", "siconc", "siconcn", "siconcs", "ohc300", "ohc700")


def to_si(value: Column, unit: Column) -> Column:
    return F.when(unit == "degC", value + 273.15).when(unit == "0.001", value / 1000).when(unit.isin("%", "centimeters"), value / 100).when(unit == "hPa", value * 100).otherwise(value)


def si_unit(unit: Column) -> Column:
    return F.when(unit == "degC", "K").when(unit.isin("0.001", "%"), "1").when(unit == "centimeters", "m").when(unit == "hPa", "Pa").otherwise(unit)


def round_to(x: Column, base: float, precision: int = 1) -> Column:
    """Nearest multiple of ``base`` (half to even), rounded to ``precision`` digits."""
    return F.bround(base * F.rint(x / base), precision)


def wrap_longitude(lon: Column) -> Column:
    return F.pmod(lon, F.lit(360.0))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return F.lit(2 * EARTH_RADIUS_M / 1e3) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def cartesian_km(lat: Column, lon: Column) -> tuple[Column, Column]:
    r = EARTH_RADIUS_M / 1e3
    return 2 * math.pi * r * F.cos(F.radians(lat)) * lon / 360, math.pi * r * lat / 180


def mask_poles(value: Column, lat: Column, limit: float = 88.0) -> Column:
    return F.when(F.abs(lat) <= limit, value)


def filter_valid(value: Column, low: Column, high: Column) -> Column:
    return F.when(value.between(low, high), value)


def area_weight(lat: Column, squared: bool = False) -> Column:
    w = F.cos(F.radians(lat))
    return w * w if squared else w


def gaspari_cohn(distance: Column, radius: float) -> Column:
    """Fifth-order localisation that falls from 1 at 0 to 0 at ``radius``."""
    c = radius / 2
    z = distance / c
    near = 1 + z * z * (F.lit(-5 / 3) + z * (F.lit(5 / 8) + z * (F.lit(0.5) - z * 0.25)))
    far = 4 - 5 * z + z * z * (F.lit(5 / 3) + z * (F.lit(5 / 8) + z * (F.lit(-0.5) + z / 12))) - F.try_divide(F.lit(2 / 3), z)
    return F.when(z <= 1, near).when(z <= 2, far).otherwise(0.0)


def cell_area_m2(lat: Column, dlat: float, dlon: float) -> Column:
    """Area of a grid cell between its parallels and meridians."""
    r2 = EARTH_RADIUS_M**2
    up = F.sin(F.radians(F.least(lat + dlat / 2, F.lit(90.0))))
    low = F.sin(F.radians(F.greatest(lat - dlat / 2, F.lit(-90.0))))
    return r2 * math.radians(dlon) * (up - low)


def hybrid_pressure(ps: Column, b: Column, a: Column | None = None, p0: float | None = None, ap: Column | None = None) -> Column:
    """Pressure of hybrid levels: ``a p0 + b ps``, or ``ap + b ps``."""
    if ap is not None:
        return ap + b * ps
    return a * p0 + b * ps


def hybrid_level(a: Column, b: Column) -> Column:
    """Nominal pressure of a level in hPa."""
    return 1000 * (a + b)


def sigma_z(sigma: Column, zlev: Column, eta: Column, depth: Column, depth_c: Column, level: Column, nsigma: int) -> Column:
    """Height (positive down) of sigma-over-z ocean levels: sigma levels first, fixed ones below."""
    return -F.when(level < nsigma, eta + sigma * (F.least(depth_c, depth) + eta)).otherwise(zlev)


def ohc_total(per_area: Column, area: float = OCEAN_AREA_M2) -> Column:
    return per_area * area


def ohc_per_area(total: Column, area: float = EARTH_AREA_M2) -> Column:
    return total / area
