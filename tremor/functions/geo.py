"""Columns on the sphere: distance, antipode, wrapping, bounds of circles, great-circle steps, distance to a segment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tremor.constants import EARTH_RADIUS_KM, KM_PER_DEGREE


def _c(x: Column | float | str) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance; null where a coordinate is. Differences are taken in degrees, as in the SQL, so that ties are the same."""
    a, b, c, d = (_c(x) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin(F.radians(c - a) / 2), F.lit(2)) + F.cos(F.radians(a)) * F.cos(F.radians(c)) * F.pow(F.sin(F.radians(d - b) / 2), F.lit(2))
    return 2 * EARTH_RADIUS_KM * F.asin(F.when(h > 1, F.lit(1.0)).otherwise(F.sqrt(h)))


def antipode(lat, lon) -> tuple[Column, Column]:
    lo = _c(lon)
    return -_c(lat), F.when(lo >= 0, lo - 180).otherwise(lo + 180)


def wrap_half_open(lon) -> Column:
    """Into [-180, 180); null for what is not finite."""
    x = _c(lon)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(F.pmod(x + 180, F.lit(360.0)) - 180)


def wrap_upper(lon) -> Column:
    """Into (-180, 180]."""
    w = F.pmod(_c(lon) + 180, F.lit(360.0)) - 180
    return F.when(w == -180, F.lit(180.0)).otherwise(w)


def within_degrees(lon, centre, degrees) -> Column:
    return F.abs(F.pmod(_c(lon) - _c(centre) + 180, F.lit(360.0)) - 180) <= _c(degrees)


def around(lat, lon, centre_lat, centre_lon, radius_km) -> Column:
    """A band of latitude and a span of longitude, either way round, that bound a circle; near a pole every longitude."""
    reach = _c(radius_km) / KM_PER_DEGREE
    cosine = F.cos(F.radians(F.least(F.lit(90.0), F.abs(_c(centre_lat)) + reach)))
    span = F.when(cosine < 0.01, F.lit(180.0)).otherwise(reach / F.greatest(cosine, F.lit(0.01)))
    return _c(lat).between(_c(centre_lat) - reach, _c(centre_lat) + reach) & within_degrees(lon, centre_lon, span)


def in_circle(lat, lon, centre_lat, centre_lon, radius_km) -> Column:
    """Within the circle; the band of latitude comes first, so that files can be skipped by it."""
    return around(lat, lon, centre_lat, centre_lon, radius_km) & (haversine_km(centre_lat, centre_lon, lat, lon) <= _c(radius_km))


def segment_km(lat, lon, ax, ay, bx, by) -> Column:
    """Distance to the segment a-b in a plane around the point; longitudes by the short way."""
    scale = F.cos(F.radians(_c(lat))) * KM_PER_DEGREE
    step = lambda x: F.pmod(_c(x) - _c(lon) + 180, F.lit(360.0)) - 180
    x1, y1, x2, y2 = step(ax) * scale, (_c(ay) - _c(lat)) * KM_PER_DEGREE, step(bx) * scale, (_c(by) - _c(lat)) * KM_PER_DEGREE
    dx, dy = x2 - x1, y2 - y1
    size = dx * dx + dy * dy
    t = F.when(size == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(x1 * dx + y1 * dy) / F.when(size == 0, F.lit(1.0)).otherwise(size))))
    return F.sqrt(F.pow(x1 + t * dx, F.lit(2)) + F.pow(y1 + t * dy, F.lit(2)))


def great_circle(lat1, lon1, lat2, lon2, fraction) -> tuple[Column, Column]:
    """The point at a fraction of the way, by spherical interpolation."""
    a, b, c, d = (F.radians(_c(x)) for x in (lat1, lon1, lat2, lon2))
    w = haversine_km(lat1, lon1, lat2, lon2) / EARTH_RADIUS_KM
    f = _c(fraction)
    near = w < 1e-12
    p = F.when(near, 1 - f).otherwise(F.sin((1 - f) * w) / F.when(near, F.lit(1.0)).otherwise(F.sin(w)))
    q = F.when(near, f).otherwise(F.sin(f * w) / F.when(near, F.lit(1.0)).otherwise(F.sin(w)))
    x = p * F.cos(a) * F.cos(b) + q * F.cos(c) * F.cos(d)
    y = p * F.cos(a) * F.sin(b) + q * F.cos(c) * F.sin(d)
    z = p * F.sin(a) + q * F.sin(c)
    return F.degrees(F.atan2(z, F.sqrt(x * x + y * y))), F.degrees(F.atan2(y, x))
