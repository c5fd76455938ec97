"""The main magnetic field from spherical-harmonic coefficients, at places and instants."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The sphere of the coefficients and the ellipsoid of geodetic latitudes, in km.
REFERENCE_KM = 6371.2
EQUATOR_KM = 6378.137
POLE_KM = EQUATOR_KM * (1 - 1 / 298.257223563)

PARTS = ("north", "east", "down", "horizontal", "intensity", "declination", "inclination")


def decimal_year(time_ms: Column) -> Column:
    """The year with its fraction passed, in UTC."""
    t = F.timestamp_millis(time_ms)
    start, next_ = (F.unix_millis(F.make_timestamp(F.year(t) + k, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0), F.lit("UTC"))) for k in (0, 1))
    return F.year(t) + (time_ms - start) / (next_ - start)


def synthesis(epochs: np.ndarray, g: np.ndarray, h: np.ndarray) -> Callable[..., np.ndarray]:
    """A function of arrays (latitude, longitude, year, altitude) to (north, east, down), for g and h by epoch, degree and order.

    Schmidt functions P, their derivatives and P / sin are carried up by the same recursion on the degree, so nothing is divided by
    a sine that vanishes at the poles. Between epochs coefficients are linear, outside them those of the nearest.
    """
    degree = g.shape[1] - 1
    reference, a, b = REFERENCE_KM, EQUATOR_KM, POLE_KM

    def field(latitude: np.ndarray, longitude: np.ndarray, year: np.ndarray, altitude: np.ndarray) -> np.ndarray:
        year = np.clip(year, epochs[0], epochs[-1])
        k = np.clip(np.searchsorted(epochs, year, side="right") - 1, 0, max(0, len(epochs) - 2))
        on = np.minimum(k + 1, len(epochs) - 1)
        share = np.where(on > k, (year - epochs[k]) / np.where(on > k, epochs[on] - epochs[k], 1), 0)
        at = lambda c, n, m: c[k, n, m] + share * (c[on, n, m] - c[k, n, m])

        south = np.radians(90 - latitude)
        ct, st = np.cos(south), np.sin(south)
        rho = np.sqrt((a * st) ** 2 + (b * ct) ** 2)
        radius = np.sqrt(altitude * (altitude + 2 * rho) + ((a * a * st) ** 2 + (b * b * ct) ** 2) / rho**2)
        cd, sd = (altitude + rho) / radius, (a * a - b * b) * ct * st / (rho * radius)
        c = np.clip(ct * cd - st * sd, -1, 1)
        s = np.sqrt(1 - c * c)

        ratio = reference / radius
        phi = np.radians(longitude)
        outward, southward, eastward = np.zeros_like(c), np.zeros_like(c), np.zeros_like(c)
        one, nil = np.ones_like(c), np.zeros_like(c)
        p = {(0, 0): (one, nil, nil)}  # P, its derivative, P / sin
        for m in range(degree + 1):
            cm, sm = np.cos(m * phi), np.sin(m * phi)
            if m:
                before, slope, over = p[m - 1, m - 1]
                f = math.sqrt((2 * m - 1) / (2 * m)) if m > 1 else 1.0
                p[m, m] = (f * s * before, f * (c * before + s * slope), f * s * over if m > 1 else one)
            for n in range(m, degree + 1):
                if n > m:
                    q, w = math.sqrt(n * n - m * m), math.sqrt((n - 1) ** 2 - m * m)
                    x, dx, ox = p[n - 1, m]
                    y, dy, oy = p.get((n - 2, m), (nil, nil, nil))
                    p[n, m] = (((2 * n - 1) * c * x - w * y) / q, ((2 * n - 1) * (c * dx - s * x) - w * dy) / q, ((2 * n - 1) * c * ox - w * oy) / q)
                if n:
                    gn, hn = at(g, n, m), at(h, n, m)
                    wave, power = gn * cm + hn * sm, ratio ** (n + 2)
                    outward += (n + 1) * power * p[n, m][0] * wave
                    southward -= power * p[n, m][1] * wave
                    eastward += m * power * p[n, m][2] * (gn * sm - hn * cm)
            if m > 1:
                for n in range(m - 1, degree + 1):
                    p.pop((n, m - 1), None) if n > m - 1 else None
        north, down = -southward, -outward
        return np.stack((north * cd + down * sd, eastward, down * cd - north * sd), axis=1)

    return field


def coefficient_arrays(table: DataFrame, degree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Epochs, and g and h by epoch, degree and order up to a degree: at most degree * (degree + 2) rows an epoch reach the driver."""
    rows = table.where(F.col("n") <= degree).orderBy("year", "n", "m", "kind").collect()
    epochs = sorted({r.year for r in rows})
    if not epochs or len(rows) != len(epochs) * degree * (degree + 2):
        raise ValueError("a coefficient is missing at some epoch")
    g, h = (np.zeros((len(epochs), degree + 1, degree + 1)) for _ in "gh")
    for r in rows:
        (g if r.kind == "g" else h)[epochs.index(r.year), r.n, r.m] = r.value
    return np.array(epochs), g, h


def main_field(points: DataFrame, table: DataFrame, degree: int = 13, *, latitude: str = "latitude", longitude: str = "longitude", time_ms: str = "time_ms", altitude_km: Column | float = 0.0) -> DataFrame:
    """points with the field in nT (north, east, down, horizontal, intensity), its declination and inclination in degrees, and
    `covered`, whether the instant lies within the epochs.

    A null place, instant or altitude gives nulls. Coefficients, of a size that the degree bounds, go to the tasks; points are
    neither shuffled nor gathered.
    """
    epochs, g, h = coefficient_arrays(table, degree)
    first, last = float(epochs[0]), float(epochs[-1])
    field = synthesis(epochs, g, h)

    @F.pandas_udf("north double, east double, down double")
    def of(lat: pd.Series, lon: pd.Series, year: pd.Series, alt: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(field(*(x.to_numpy(dtype=float) for x in (lat, lon, year, alt))), columns=["north", "east", "down"])

    alt = altitude_km if isinstance(altitude_km, Column) else F.lit(float(altitude_km))
    known = F.col(latitude).isNotNull() & F.col(longitude).isNotNull() & F.col(time_ms).isNotNull() & alt.isNotNull()
    year = decimal_year(F.col(time_ms))
    placed = points.withColumn("_year", year).withColumn("_f", of(F.col(latitude).cast("double"), F.col(longitude).cast("double"), "_year", alt.cast("double")))
    parts = {c: F.when(known, F.col(f"_f.{c}")) for c in ("north", "east", "down")}
    out = placed.withColumns(parts | {"covered": F.col("_year").between(first, last)})
    flat = F.sqrt(F.col("north") ** 2 + F.col("east") ** 2)
    out = out.withColumns({"horizontal": flat, "declination": F.degrees(F.atan2("east", "north"))})
    return out.withColumns({"intensity": F.sqrt(F.col("horizontal") ** 2 + F.col("down") ** 2), "inclination": F.degrees(F.atan2("down", "horizontal"))}).select(*points.columns, *PARTS, "covered")


def field_grid(table: DataFrame, time_ms: int, width: int, height: int, degree: int = 13) -> DataFrame:
    """The field at the middles of width x height cells, rows from the north edge down: (row, column, latitude, longitude, ...)."""
    cells = table.sparkSession.range(width * height).select(F.floor(F.col("id") / width).alias("row"), (F.col("id") % width).alias("column"))
    at = cells.withColumns({"latitude": 90 - (F.col("row") + 0.5) / height * 180, "longitude": -180 + (F.col("column") + 0.5) / width * 360, "time_ms": F.lit(time_ms).cast("long")})
    return main_field(at, table, degree).drop("time_ms", "covered")
