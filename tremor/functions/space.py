"""Columns of space physics: wind pressure and the magnetopause (Shue and others, 1998)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the fit and of the units.
PROTON_PRESSURE = 1.6726e-6
LEAST_PRESSURE = 0.01
FITTED_PRESSURE, FITTED_BZ = (0.5, 8.5), (-18.0, 15.0)
GEOSYNCHRONOUS_RE = 6.6


def dynamic_pressure(density: Column, speed: Column) -> Column:
    """In nPa, from protons a cm3 and km/s."""
    return PROTON_PRESSURE * density * speed * speed


def magnetopause(bz: Column, pressure: Column) -> Column:
    """A struct: standoff in Earth radii, flaring, pressure used, and whether the fit is stretched or the boundary inside 6.6."""
    p = F.greatest(pressure, F.lit(LEAST_PRESSURE))
    standoff = (10.22 + 1.29 * F.tanh(0.184 * (bz + 8.14))) * F.pow(p, F.lit(-1 / 6.6))
    flaring = (0.58 - 0.007 * bz) * (1 + 0.024 * F.log(p))
    beyond = ~(p.between(*FITTED_PRESSURE) & bz.between(*FITTED_BZ))
    return F.struct(standoff.alias("standoff_re"), flaring.alias("flaring"), p.alias("pressure_npa"), beyond.alias("extrapolated"), (standoff < GEOSYNCHRONOUS_RE).alias("inside_geosynchronous"))


def boundary_radius(standoff: Column, flaring: Column, theta: Column) -> Column:
    """Distance to the boundary at an angle from the sunward line; infinite straight away from the sun."""
    opening = 1 + F.cos(theta)
    return F.when(opening <= 0, F.lit(float("inf"))).otherwise(standoff * F.pow(2 / F.when(opening > 0, opening), flaring))


def profile(shape: Column, max_degrees: float = 120.0, steps: int = 60) -> Column:
    """The boundary of a magnetopause() struct as an array of (step, theta, radius_re), from the sunward line to at most 179 degrees."""
    top = math.radians(min(max_degrees, 179.0))
    return F.transform(
        F.sequence(F.lit(0), F.lit(steps)),
        lambda k: F.struct(k.alias("step"), (top * k / steps).alias("theta"), boundary_radius(shape["standoff_re"], shape["flaring"], top * k / steps).alias("radius_re")),
    )
