"""The sun's and the moon's places and the equilibrium tide, as columns of an instant and a place."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor import constants as K
from tremor.functions import geo

# SI units; epochs in days since 1970.
GM_MOON, GM_SUN = 4.90280066e12, 1.32712440018e20
ASTRONOMICAL_UNIT_M, EARTH_RADIUS_M, GRAVITY = 1.495978707e11, 6_371_000.0, 9.80665
J2000_DAYS, LUNAR_DAYS = 10_957.5, 10_956.0
ECCENTRICITY, SEMI_AXIS, INCLINATION = 0.0549, 60.2666, 5.1454

# Fixed values of the moon's periodic terms: the amplitude, and the multiples of the moon's and the sun's mean anomaly, the elongation and the argument of latitude.
LONGITUDE_TERMS = [
    (-1.274, 1, 0, -2, 0), (0.658, 0, 0, 2, 0), (-0.186, 0, 1, 0, 0), (-0.059, 2, 0, -2, 0), (-0.057, 1, 1, -2, 0), (0.053, 1, 0, 2, 0),
    (0.046, 0, -1, 2, 0), (0.041, 1, -1, 0, 0), (-0.035, 0, 0, 1, 0), (-0.031, 1, 1, 0, 0), (-0.015, 0, 0, -2, 2), (0.011, 1, 0, -4, 0),
]
LATITUDE_TERMS = [(-0.173, 0, 0, -2, 1), (-0.055, 1, 0, -2, -1), (-0.046, 1, 0, -2, 1), (0.033, 0, 0, 2, 1), (0.017, 2, 0, 0, 1)]
DISTANCE_TERMS = [(-0.58, 1, 0, -2, 0), (-0.46, 0, 0, 2, 0)]
NEWTON_STEPS = 3


def kepler(anomaly: str, eccentricity: float, df: DataFrame, to: str, steps: int = NEWTON_STEPS) -> DataFrame:
    """df with the eccentric anomaly `to` for a mean anomaly in radians: a first guess and so many Newton steps, a column each."""
    m = F.col(anomaly)
    df = df.withColumn(to, m + eccentricity * F.sin(m) * (1 + eccentricity * F.cos(m)))
    for _ in range(steps):
        e = F.col(to)
        df = df.withColumn(to, e - (e - eccentricity * F.sin(e) - m) / (1 - eccentricity * F.cos(e)))
    return df


def series_of(terms: list[tuple], angles: list[Column], wave) -> Column:
    """The sum of amplitude * wave(multiples . angles)."""
    out = F.lit(0.0)
    for amplitude, *multiples in terms:
        out = out + amplitude * wave(sum((k * a for k, a in zip(multiples, angles) if k), F.lit(0.0)))
    return out


def _place(df: DataFrame, name: str, ascension: Column, declination: Column, distance_m: Column, gm: float, time: Column) -> DataFrame:
    """Columns of a body from its right ascension and declination: the point below it, its distance and the amplitude of its tide."""
    sidereal = F.pmod(280.46061837 + 360.98564736629 * (time / K.DAY_MS - J2000_DAYS), F.lit(360.0))
    return df.withColumns({f"{name}_latitude": declination, f"{name}_longitude": geo.wrap_upper(ascension - sidereal), f"{name}_distance_m": distance_m}).withColumn(
        f"{name}_amplitude_m", gm * EARTH_RADIUS_M**2 / F.pow(f"{name}_distance_m", F.lit(3.0)) / GRAVITY
    )


def with_bodies(df: DataFrame, time_ms: str = "time_ms") -> DataFrame:
    """df with latitude, longitude, distance_m and amplitude_m of the sun and of the moon (sun_..., moon_...) at each instant."""
    columns, t, rad = df.columns, F.col(time_ms), F.radians
    d = t / K.DAY_MS - J2000_DAYS
    w = df.withColumns({"_tilt": rad(23.4393 - 3.563e-7 * d), "_ms": rad(357.528 + 0.9856003 * d)})
    w = w.withColumn("_l", rad(280.46 + 0.9856474 * d + 1.915 * F.sin("_ms") + 0.02 * F.sin(2 * F.col("_ms"))))
    w = _place(
        w, "sun", F.degrees(F.atan2(F.cos("_tilt") * F.sin("_l"), F.cos("_l"))), F.degrees(F.asin(F.sin("_tilt") * F.sin("_l"))),
        (1.00014 - 0.01671 * F.cos("_ms") - 0.00014 * F.cos(2 * F.col("_ms"))) * ASTRONOMICAL_UNIT_M, GM_SUN, t,
    )
    d = t / K.DAY_MS - LUNAR_DAYS
    node, perigee, anomaly = 125.1228 - 0.0529538083 * d, 318.0634 + 0.1643573223 * d, 115.3654 + 13.0649929509 * d
    w = w.withColumns({"_node": rad(node), "_mm": rad(anomaly), "_ma": rad(356.047 + 0.9856002585 * d)})
    lunar = node + perigee + anomaly
    solar = 356.047 + 0.9856002585 * d + 282.9404 + 4.70935e-5 * d
    w = w.withColumns({"_d": rad(lunar - solar), "_f": rad(lunar - node)})
    w = kepler("_mm", ECCENTRICITY, w, "_e")
    x, y = SEMI_AXIS * (F.cos("_e") - ECCENTRICITY), SEMI_AXIS * math.sqrt(1 - ECCENTRICITY**2) * F.sin("_e")
    w = w.withColumns({"_x": x, "_y": y})
    w = w.withColumns({"_r": F.sqrt(F.col("_x") ** 2 + F.col("_y") ** 2), "_u": F.atan2("_y", "_x") + rad(perigee)})
    tilt = math.radians(INCLINATION)
    w = w.withColumns(
        {
            "_xe": F.cos("_node") * F.cos("_u") - F.sin("_node") * F.sin("_u") * math.cos(tilt),
            "_ye": F.sin("_node") * F.cos("_u") + F.cos("_node") * F.sin("_u") * math.cos(tilt),
            "_ze": F.sin("_u") * math.sin(tilt),
        }
    )
    angles = [F.col(c) for c in ("_mm", "_ma", "_d", "_f")]
    w = w.withColumns(
        {
            "_lon": rad(F.degrees(F.atan2("_ye", "_xe")) + series_of(LONGITUDE_TERMS, angles, F.sin)),
            "_lat": rad(F.degrees(F.atan2("_ze", F.sqrt(F.col("_xe") ** 2 + F.col("_ye") ** 2))) + series_of(LATITUDE_TERMS, angles, F.sin)),
            "_far": (F.col("_r") + series_of(DISTANCE_TERMS, angles, F.cos)) * EARTH_RADIUS_M,
        }
    )
    w = w.withColumns({"_x": F.cos("_lat") * F.cos("_lon"), "_y": F.cos("_lat") * F.sin("_lon") * F.cos("_tilt") - F.sin("_lat") * F.sin("_tilt"), "_z": F.cos("_lat") * F.sin("_lon") * F.sin("_tilt") + F.sin("_lat") * F.cos("_tilt")})
    w = _place(w, "moon", F.degrees(F.atan2("_y", "_x")), F.degrees(F.atan2("_z", F.sqrt(F.col("_x") ** 2 + F.col("_y") ** 2))), F.col("_far"), GM_MOON, t)
    return w.select(*columns, *(f"{b}_{c}" for b in ("sun", "moon") for c in ("latitude", "longitude", "distance_m", "amplitude_m")))


def tide_m(latitude: str = "latitude", longitude: str = "longitude") -> Column:
    """The equilibrium tide in metres at a place, for rows of with_bodies()."""
    out = F.lit(0.0)
    for body in ("sun", "moon"):
        a, b, c, d = (F.radians(x) for x in (latitude, longitude, f"{body}_latitude", f"{body}_longitude"))
        near = F.cos(a) * F.cos(c) * F.cos(b - d) + F.sin(a) * F.sin(c)
        out = out + F.col(f"{body}_amplitude_m") * (3 * near * near - 1) / 2
    return out


def tide_grid(instants: DataFrame, step_degrees: float) -> DataFrame:
    """For each instant (time_ms) the tide on a grid, rows from the north pole down and columns from 180 degrees west on.

    Bodies are worked out once an instant; the grid has a fixed size, so an instant's rows are made where it is.
    """
    width, height = round(360 / step_degrees), round(180 / step_degrees) + 1
    bodies = with_bodies(instants.select("time_ms").distinct())
    cells = bodies.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(width * height - 1))))
    at = cells.withColumns({"row": F.floor(F.col("_k") / width), "column": (F.col("_k") % width).cast("long")})
    at = at.withColumns({"latitude": 90 - F.col("row") * step_degrees, "longitude": -180 + F.col("column") * step_degrees})
    return at.select("time_ms", "row", "column", "latitude", "longitude", tide_m().alias("tide_m"))
