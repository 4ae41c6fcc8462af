"""Distances, angles and projections as column expressions. A null input gives a null, if not said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
#: Equatorial radius and flattening of WGS84.
WGS84_M, WGS84_F = 6_378_137.0, 1 / 298.257223563


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_M) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    # least() would skip a null.
    return F.when(a.isNotNull(), F.lit(2 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(a))))


def angle_delta_deg(a: Column, b: Column) -> Column:
    """The smallest difference of two directions, 0 to 180."""
    d = F.pmod(a - b, F.lit(360.0))
    return F.when(d.isNotNull(), F.least(d, 360.0 - d))


def distance_3d_m(lat1: Column, lon1: Column, alt1: Column, lat2: Column, lon2: Column, alt2: Column) -> Column:
    """Horizontal distance and height together; horizontal alone where a height is unknown."""
    flat = haversine_m(lat1, lon1, lat2, lon2)
    return F.when(alt1.isNull() | alt2.isNull(), flat).otherwise(F.hypot(flat, F.abs(alt1 - alt2)))


def local_xyz_m(lat: Column, lon: Column, alt: Column, lat0: Column, lon0: Column, radius: float = EARTH_M) -> Column:
    """Metres east and north of a point, and the height, 0 where it is unknown."""
    return F.struct(
        (F.radians(lon - lon0) * F.cos(F.radians(lat0)) * radius).alias("x"),
        (F.radians(lat - lat0) * radius).alias("y"),
        F.coalesce(alt, F.lit(0.0)).alias("z"),
    )


def quaternion(yaw: Column, pitch: Column, roll: Column) -> Column:
    """Rotation by yaw, then pitch, then roll (degrees), as a struct of w, x, y, z."""
    (cy, sy), (cp, sp), (cr, sr) = ((F.cos(F.radians(a) / 2), F.sin(F.radians(a) / 2)) for a in (yaw, pitch, roll))
    return F.struct(
        (cr * cp * cy + sr * sp * sy).alias("w"),
        (sr * cp * cy - cr * sp * sy).alias("x"),
        (cr * sp * cy + sr * cp * sy).alias("y"),
        (cr * cp * sy - sr * sp * cy).alias("z"),
    )


def utm_zone(lon: Column) -> Column:
    return ((lon + 180.0) / 6.0).cast("int") + 1


def utm_epsg(lat: Column, lon: Column) -> Column:
    """The code of the UTM zone of a mean position: 326xx to the north, equator included, 327xx to the south."""
    return F.when(lat >= 0, 32600).otherwise(F.when(lat.isNotNull(), 32700)) + utm_zone(lon)


def utm_xy_m(lat: Column, lon: Column, epsg: Column) -> Column:
    """Easting and northing in a UTM zone by the series of the transverse Mercator projection, to well below a millimetre."""
    n = WGS84_F / (2 - WGS84_F)
    scale = 0.9996 * WGS84_M / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    series = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    root = 2 * n**0.5 / (1 + n)
    east = F.radians(lon - (F.pmod(epsg, F.lit(100)) * 6 - 183))
    sin = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(sin) - F.lit(root) * F.atanh(F.lit(root) * sin))
    xi, eta = F.atan2(t, F.cos(east)), F.atanh(F.sin(east) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(series, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    south = F.when(epsg >= 32700, 10_000_000.0).otherwise(0.0)
    return F.struct((500_000.0 + scale * x).alias("x"), (south + scale * y).alias("y"))


def dms_to_degrees(dms: Column, ref: Column) -> Column:
    """An array of degrees, minutes and seconds as text or numbers; south and west are negative; bad input gives null."""
    part = lambda i: F.try_element_at(dms, F.lit(i)).try_cast("double")
    degrees = part(1) + part(2) / 60.0 + part(3) / 3600.0
    return F.when(ref.isin("S", "W"), -degrees).otherwise(degrees)
