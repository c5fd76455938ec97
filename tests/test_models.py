"""The field and tide models against other ways to work them out."""

import datetime
import math
import os
from math import factorial, sqrt

import numpy as np
import pytest

from tremor import constants as K
from tremor.functions import field, tides
from tremor.sources.coefficients import coefficient_table, epochs_of

HEAD = "g/h n m 1900.0 1905.0 1905-10"
ROWS = ["g 1 0  -10 -20  2", "g 1 1\t5 6 0.5", "h 1 1   7.5 8 -1", "# a comment", ""]


def table(spark, lines, degree=1):
    return coefficient_table(spark.createDataFrame([(x,) for x in lines], "value string").repartition(3), degree)


def test_coefficient_text(spark):
    t = table(spark, [*ROWS, HEAD])
    assert sorted(map(tuple, t.collect())) == sorted(
        [("g", 1, 0, 1900.0, -10.0), ("g", 1, 0, 1905.0, -20.0), ("g", 1, 0, 1910.0, -10.0), ("g", 1, 1, 1900.0, 5.0), ("g", 1, 1, 1905.0, 6.0), ("g", 1, 1, 1910.0, 8.5), ("h", 1, 1, 1900.0, 7.5), ("h", 1, 1, 1905.0, 8.0), ("h", 1, 1, 1910.0, 3.0)]
    )
    assert [tuple(r) for r in epochs_of(t).orderBy("year").collect()] == [(1900.0, 3, 1905.0), (1905.0, 3, 1910.0), (1910.0, 3, None)]


@pytest.mark.parametrize(
    "lines, said",
    [
        (ROWS, "no header"), ([HEAD, HEAD, *ROWS], "more than one"), (["g/h n m 1900.0 1905.0", *ROWS], "yearly change"), (["g/h n m x 1905.0 1905-10", *ROWS], "no number"), ([HEAD, *ROWS[1:]], "not 3"),
        ([HEAD, *ROWS, "g 2 0 1 2 3"], "not 3"), ([HEAD, ROWS[0], ROWS[1], ROWS[1]], "different"), ([HEAD, ROWS[0], ROWS[1], "h 1 1 7.5 None 1"], "no number"), ([HEAD, ROWS[0], ROWS[1], "h 1 1 7.5 8"], "not 3"), (["g/h n m 1905-10"], "no epochs"),
    ],
)
def test_bad_coefficient_text_is_an_error(spark, lines, said):
    with pytest.raises(ValueError, match=said):
        table(spark, lines)


def direct(epochs, g, h, lat, lon, year, alt):
    """The field by polynomials of Legendre, point by point; near the poles from a point by the side."""
    degree = g.shape[1] - 1
    year = min(max(year, epochs[0]), epochs[-1])
    k = max(i for i in range(len(epochs) - 1) if epochs[i] <= year)
    t = (year - epochs[k]) / (epochs[k + 1] - epochs[k])
    a, b = field.EQUATOR_KM, field.POLE_KM
    th, phi = math.radians(90 - lat), math.radians(lon)
    n0 = a * a / math.sqrt((a * math.sin(th)) ** 2 + (b * math.cos(th)) ** 2)
    p, z = (n0 + alt) * math.sin(th), (n0 * b * b / a / a + alt) * math.cos(th)
    r, geo_th = math.hypot(p, z), math.atan2(p, z)
    turn = geo_th - th  # geocentric colatitudes are larger in the north
    c, s = math.cos(geo_th), max(math.sin(geo_th), 1e-9)
    out = np.zeros(3)
    for n in range(1, degree + 1):
        leg = np.polynomial.legendre.leg2poly([0] * n + [1])
        for m in range(n + 1):
            q = (np.polynomial.polynomial.polyder(leg, m) if m else leg) * (sqrt(2 * factorial(n - m) / factorial(n + m)) if m else 1)
            v, dv = np.polynomial.polynomial.polyval(c, q), np.polynomial.polynomial.polyval(c, np.polynomial.polynomial.polyder(q))
            pn, dp = s**m * v, (m * s ** (m - 1) * c * v if m else 0) - s ** (m + 1) * dv
            gg, hh = g[k, n, m] + t * (g[k + 1, n, m] - g[k, n, m]), h[k, n, m] + t * (h[k + 1, n, m] - h[k, n, m])
            f, wave = (field.REFERENCE_KM / r) ** (n + 2), gg * math.cos(m * phi) + hh * math.sin(m * phi)
            out += f * np.array([(n + 1) * pn * wave, -dp * wave, m * pn / s * (gg * math.sin(m * phi) - hh * math.cos(m * phi))])
    up, south, east = out
    x, zz = -south, -up
    return x * math.cos(turn) + zz * math.sin(turn), east, zz * math.cos(turn) - x * math.sin(turn)  # up at the ellipsoid leans north


def test_field_equals_polynomials(spark):
    rng = np.random.default_rng(3)
    epochs = [1900.0, 1905.0, 1910.0]
    rows = [(k, n, m, e, float(rng.normal(0, 30000 / n**2))) for n in range(1, 14) for m in range(n + 1) for k in ("gh" if m else "g") for e in epochs]
    t = spark.createDataFrame(rows, "kind string, n int, m int, year double, value double")
    e, g, h = field.coefficient_arrays(t, 13)
    pts = [(i, float(rng.uniform(-90, 90)), float(rng.uniform(-180, 180)), int(rng.integers(-75 * 365, -55 * 365)) * K.DAY_MS, float(rng.uniform(0, 600))) for i in range(60)]
    pts += [(100, 90.0, 20.0, -65 * 365 * K.DAY_MS, 0.0), (101, -90.0, 20.0, -65 * 365 * K.DAY_MS, 0.0), (102, 0.0, 180.0, 0, 0.0), (103, None, 1.0, 0, 0.0), (104, 1.0, 1.0, None, 0.0)]
    df = spark.createDataFrame(pts, "id int, latitude double, longitude double, time_ms long, alt double").repartition(3)
    got = {r.id: r for r in field.main_field(df, t, altitude_km=df["alt"]).collect()}
    assert got[103].north is None and got[103].intensity is None and got[104].down is None and got[102].covered is False and len(got) == len(pts)
    for i, lat, lon, ms, alt in pts[:-2]:
        at = datetime.datetime(1970, 1, 1) + datetime.timedelta(milliseconds=ms)
        start, end = datetime.datetime(at.year, 1, 1), datetime.datetime(at.year + 1, 1, 1)
        want = direct(e, g, h, lat, lon, at.year + (at - start) / (end - start), alt)
        r = got[i]
        assert np.allclose((r.north, r.east, r.down), want, rtol=1e-6, atol=0.05 if abs(lat) == 90 else 1e-5), (i, want, r)
        assert abs(r.intensity - math.sqrt(sum(x * x for x in want))) < 0.1 and abs(r.horizontal - math.hypot(r.north, r.east)) < 1e-6
        assert abs(r.declination - math.degrees(math.atan2(r.east, r.north))) < 1e-9 and abs(r.inclination - math.degrees(math.atan2(r.down, r.horizontal))) < 1e-9
    with pytest.raises(ValueError):
        field.coefficient_arrays(t.where("not (n = 2 and m = 1 and kind = 'h' and year = 1905)"), 13)


def test_axial_dipole_and_grid(spark):
    t = spark.createDataFrame([("g", 1, 0, y, -30000.0) for y in (2000.0, 2005.0)] + [(k, 1, 1, y, 0.0) for k in "gh" for y in (2000.0, 2005.0)], "kind string, n int, m int, year double, value double")
    rows = field.field_grid(t, 978_307_200_000, 8, 4, 1).orderBy("row", "column").collect()
    assert len(rows) == 32 and rows[0].latitude == 67.5 and rows[0].longitude == -157.5 and rows[-1].latitude == -67.5
    assert all(r.north > 0 and abs(r.east) < 1e-9 and (r.down > 0) == (r.latitude > 0) for r in rows)
    north = {r.latitude: r.intensity for r in rows}
    assert abs(north[67.5] - north[-67.5]) < 1e-6 and north[67.5] > north[22.5]


def test_kepler_settles(spark):
    df = spark.range(100).selectExpr("id * 0.37D as m")
    for r in tides.kepler("m", 0.0549, df, "e").collect():
        assert abs(r.e - 0.0549 * math.sin(r.e) - r.m) < 1e-12


def test_tides(spark):
    eclipse = int(datetime.datetime(1999, 8, 11, 11, 8, tzinfo=datetime.timezone.utc).timestamp() * 1000)  # new moon
    full = int(datetime.datetime(2000, 1, 21, 4, 40, tzinfo=datetime.timezone.utc).timestamp() * 1000)  # full moon
    df = spark.createDataFrame([(eclipse, 1), (full, 1), (None, 1)], "time_ms long, sun_latitude int").drop("sun_latitude")
    a, b, c = sorted(tides.with_bodies(df).collect(), key=lambda r: (r.time_ms is None, r.time_ms))
    assert abs(a.sun_latitude - a.moon_latitude) < 1 and abs(a.sun_longitude - a.moon_longitude) < 1
    assert abs(b.sun_latitude + b.moon_latitude) < 1.5 and abs(abs(b.sun_longitude - b.moon_longitude) - 180) < 1.5
    assert 0.15 < a.sun_amplitude_m < 0.18 and 0.28 < a.moon_amplitude_m < 0.46 and c.moon_distance_m is None
    assert 356e6 < a.moon_distance_m < 407e6 and 1.46e11 < b.sun_distance_m < 1.48e11
    grid = tides.tide_grid(df.where("time_ms is not null"), 30.0).collect()
    assert len(grid) == 2 * 12 * 7
    top = max((r for r in grid if r.time_ms == eclipse), key=lambda r: r.tide_m)
    assert abs(abs(top.latitude) - 15) <= 20 and 0.3 < top.tide_m < 0.65 and min(r.tide_m for r in grid) < -0.15
    poles = {r.tide_m for r in grid if r.time_ms == full and r.row == 0}
    assert max(poles) - min(poles) < 1e-12


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_text_is_made_of_the_staged_parts_alone(spark):
    """Over the table itself, filters on the text make it for each of its rows."""
    from tremor.sources import fixtures as X

    lines = X.coefficient_lines(spark, "/root/testdata/sf0.001")
    assert not [f for f in lines.inputFiles() if "part.parquet" in f] and lines.count() == 197
