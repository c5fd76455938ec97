"""Queries of the field and tide models over the supplied tables, each with its SQL."""

from __future__ import annotations

from math import factorial, sqrt

import numpy as np
from pyspark.sql import functions as F

from tremor.functions import field, tides
from tremor.plans.catalogue import DAY, query
from tremor.sources import fixtures as X
from tremor.sources.coefficients import coefficient_table
from tremor.sources.fixtures import EPOCHS, QUAKES_SQL

DEGREE = 13

COEFFICIENTS_SQL = f"""parts AS (
    SELECT p_partkey + 1 AS i, CAST(floor(sqrt(p_partkey + 1)) AS BIGINT) AS n, CAST(round(p_retailprice * 100) AS BIGINT) % 2000000 AS cents, p_size FROM part WHERE p_partkey < {DEGREE * (DEGREE + 2)}
), published AS (
    SELECT CASE WHEN i - n * n = 0 OR (i - n * n) % 2 = 1 THEN 'g' ELSE 'h' END AS kind, n, (i - n * n + 1) // 2 AS m, k,
        (cents // (n * n) - 1000000 // (n * n) + CASE WHEN k < {len(EPOCHS)} THEN k ELSE 0 END * (p_size % 11) * 100 - CASE WHEN k = {len(EPOCHS)} THEN 700 ELSE 0 END) / 100.0 AS v
    FROM parts, range({len(EPOCHS) + 1}) e(k)
), coefficients AS (
    SELECT a.kind, a.n, a.m, {EPOCHS[0]} + 5.0 * a.k AS year, CASE WHEN a.k = {len(EPOCHS)} THEN b.v + 5 * a.v ELSE a.v END AS value
    FROM published a LEFT JOIN published b ON a.k = {len(EPOCHS)} AND b.k = a.k - 1 AND a.kind = b.kind AND a.n = b.n AND a.m = b.m
)"""


def polynomials_sql(degree: int) -> str:
    """Rows (n, m, a) of the polynomials in the cosine that, times sine^m, are Schmidt's functions."""
    rows = []
    for n in range(1, degree + 1):
        p = np.polynomial.legendre.leg2poly([0] * n + [1])
        for m in range(n + 1):
            q = (np.polynomial.polynomial.polyder(p, m) if m else p) * (sqrt(2 * factorial(n - m) / factorial(n + m)) if m else 1)
            rows.append(f"({n}, {m}, [{', '.join(repr(float(x)) + '::DOUBLE' for x in q)}])")
    return "schmidt(n, m, a) AS (VALUES " + ", ".join(rows) + ")"


def field_sql(degree: int) -> str:
    first, last = EPOCHS[0], EPOCHS[-1] + 5
    a, b = f"{field.EQUATOR_KM!r}", f"{field.POLE_KM!r}"
    return f"""WITH {QUAKES_SQL}, {COEFFICIENTS_SQL}, {polynomials_sql(degree)}, aged AS (
    SELECT event_id, radians(longitude) AS phi, radians(90 - latitude) AS th, coalesce(depth_km, 0) / 10.0 AS alt, time_ms - (event_id % 140) * 365 * {DAY} AS t FROM quakes
), dated AS (
    SELECT *, make_timestamp(t * 1000) AS ts FROM aged
), timed AS (
    SELECT *, year(ts) + (t - epoch_ms(make_timestamp(year(ts), 1, 1, 0, 0, 0))) / CAST(epoch_ms(make_timestamp(year(ts) + 1, 1, 1, 0, 0, 0)) - epoch_ms(make_timestamp(year(ts), 1, 1, 0, 0, 0)) AS DOUBLE) AS y FROM dated
), placed AS (
    SELECT *, greatest({first}, least({last}, y)) AS yc, sqrt(pow({a} * sin(th), 2) + pow({b} * cos(th), 2)) AS rho FROM timed
), turned AS (
    SELECT *, greatest({first}, least({last} - 5, {first} + 5 * floor((yc - {first}) / 5))) AS y0, sqrt(alt * (alt + 2 * rho) + (pow({a} * {a} * sin(th), 2) + pow({b} * {b} * cos(th), 2)) / (rho * rho)) AS r FROM placed
), pts AS (
    SELECT *, (alt + rho) / r AS cd, ({a} * {a} - {b} * {b}) * cos(th) * sin(th) / (rho * r) AS sd, (yc - y0) / 5 AS share FROM turned
), rounded_c AS (
    SELECT *, greatest(-1, least(1, cos(th) * cd - sin(th) * sd)) AS c FROM pts
), spans AS (
    SELECT a.n, a.m, a.year, max(a.value) FILTER (a.kind = 'g') AS g0, max(b.value) FILTER (a.kind = 'g') AS g1, coalesce(max(a.value) FILTER (a.kind = 'h'), 0) AS h0, coalesce(max(b.value) FILTER (a.kind = 'h'), 0) AS h1
    FROM coefficients a JOIN coefficients b ON a.kind = b.kind AND a.n = b.n AND a.m = b.m AND b.year = a.year + 5 WHERE a.n <= {degree} GROUP BY 1, 2, 3
), terms AS (
    SELECT event_id, n, m, phi, pow({field.REFERENCE_KM} / r, n + 2) AS f, c, sqrt(1 - c * c) AS s, g0 + share * (g1 - g0) AS g, h0 + share * (h1 - h0) AS h,
        list_sum(list_transform(range(1, len(a) + 1), lambda i: a[i] * pow(c, i - 1))) AS q,
        coalesce(list_sum(list_transform(range(2, len(a) + 1), lambda i: (i - 1) * a[i] * pow(c, i - 2))), 0) AS dq
    FROM rounded_c JOIN spans ON spans.year = y0 JOIN schmidt USING (n, m)
), sums AS (
    SELECT event_id, sum((n + 1) * f * pow(s, m) * q * (g * cos(m * phi) + h * sin(m * phi))) AS outward,
        sum(f * (CASE WHEN m > 0 THEN m * pow(s, m - 1) * c * q ELSE 0 END - pow(s, m + 1) * dq) * (g * cos(m * phi) + h * sin(m * phi))) AS northward,
        sum(CASE WHEN m > 0 THEN m * f * pow(s, m - 1) * q * (g * sin(m * phi) - h * cos(m * phi)) ELSE 0 END) AS east
    FROM terms GROUP BY 1
), vectors AS (
    SELECT event_id, y BETWEEN {first} AND {last} AS covered, northward * cd - outward * sd AS north, east, -outward * cd - northward * sd AS down FROM sums JOIN rounded_c USING (event_id)
)
SELECT event_id, covered, round(north, 3) AS north, round(east, 3) AS east, round(down, 3) AS down, round(sqrt(north * north + east * east), 3) AS horizontal, round(sqrt(north * north + east * east + down * down), 3) AS intensity,
    round(degrees(atan2(east, north)), 5) AS declination, round(degrees(atan2(down, sqrt(north * north + east * east))), 5) AS inclination
FROM vectors"""


def _field(spark, d, degree):
    table = coefficient_table(X.coefficient_lines(spark, d), DEGREE)
    aged = X.quakes(spark, d).selectExpr("event_id", "latitude", "longitude", f"time_ms - (event_id % 140) * 365 * {DAY} as time_ms", "coalesce(depth_km, 0) / 10.0D as altitude_km")
    f = field.main_field(aged, table, degree, altitude_km=F.col("altitude_km"))
    return f.select("event_id", "covered", *(F.round(c, 5 if "ination" in c else 3).alias(c) for c in field.PARTS))


@query(field_sql(2))
def main_field_low_degree(spark, d):
    return _field(spark, d, 2)


@query(field_sql(DEGREE))
def main_field(spark, d):
    return _field(spark, d, DEGREE)


@query(f"WITH {COEFFICIENTS_SQL} SELECT kind, CAST(n AS INTEGER) AS n, CAST(m AS INTEGER) AS m, year, round(value, 6) AS value FROM coefficients")
def coefficient_epochs(spark, d):
    return coefficient_table(X.coefficient_lines(spark, d), DEGREE).withColumn("value", F.round("value", 6))


def wave_sql(terms: list[tuple], wave: str) -> str:
    return " + ".join(f"({a!r}) * {wave}({i} * mm + {j} * ma + {k} * el + {n} * f)" for a, i, j, k, n in terms)


def wrap_sql(x: str) -> str:
    return f"(180 - (((180 - ({x})) % 360) + 360) % 360)"


NEWTON_SQL = "e - (e - 0.0549 * sin(e) - mm) / (1 - 0.0549 * cos(e)) AS e"

TIDES_SQL = f"""WITH {QUAKES_SQL}, t0 AS (
    SELECT event_id, latitude, longitude, time_ms / {DAY}.0 - 10957.5 AS d, time_ms / {DAY}.0 - 10956 AS dl FROM quakes
), t1 AS (
    SELECT *, radians(23.4393 - 3.563e-7 * d) AS ob, radians(357.528 + 0.9856003 * d) AS ms, (((280.46061837 + 360.98564736629 * d) % 360) + 360) % 360 AS sid,
        radians(125.1228 - 0.0529538083 * dl) AS nd, radians(318.0634 + 0.1643573223 * dl) AS pg, radians(115.3654 + 13.0649929509 * dl) AS mm, radians(356.047 + 0.9856002585 * dl) AS ma, radians(282.9404 + 4.70935e-5 * dl) AS ps
    FROM t0
), t2 AS (
    SELECT *, radians(280.46 + 0.9856474 * d + 1.915 * sin(ms) + 0.02 * sin(2 * ms)) AS l, nd + pg + mm - ma - ps AS el, pg + mm AS f, mm + 0.0549 * sin(mm) * (1 + 0.0549 * cos(mm)) AS e FROM t1
), n1 AS (SELECT * EXCLUDE (e), {NEWTON_SQL} FROM t2), n2 AS (SELECT * EXCLUDE (e), {NEWTON_SQL} FROM n1), n3 AS (SELECT * EXCLUDE (e), {NEWTON_SQL} FROM n2
), t3 AS (
    SELECT *, 60.2666 * (cos(e) - 0.0549) AS x, 60.2666 * sqrt(1 - 0.0549 * 0.0549) * sin(e) AS y FROM n3
), t4 AS (SELECT *, sqrt(x * x + y * y) AS r, atan2(y, x) + pg AS u, radians(5.1454) AS i FROM t3
), t5 AS (
    SELECT *, cos(nd) * cos(u) - sin(nd) * sin(u) * cos(i) AS xe, sin(nd) * cos(u) + cos(nd) * sin(u) * cos(i) AS ye, sin(u) * sin(i) AS ze FROM t4
), t6 AS (
    SELECT *, radians(degrees(atan2(ye, xe)) + {wave_sql(tides.LONGITUDE_TERMS, 'sin')}) AS lo, radians(degrees(atan2(ze, sqrt(xe * xe + ye * ye))) + {wave_sql(tides.LATITUDE_TERMS, 'sin')}) AS la,
        (r + {wave_sql(tides.DISTANCE_TERMS, 'cos')}) * 6371000 AS far
    FROM t5
), t7 AS (
    SELECT *, cos(la) * cos(lo) AS qx, cos(la) * sin(lo) * cos(ob) - sin(la) * sin(ob) AS qy, cos(la) * sin(lo) * sin(ob) + sin(la) * cos(ob) AS qz,
        (1.00014 - 0.01671 * cos(ms) - 0.00014 * cos(2 * ms)) * 1.495978707e11 AS sun_far FROM t6
), bodies AS (
    SELECT *, degrees(asin(sin(ob) * sin(l))) AS sun_latitude, {wrap_sql('degrees(atan2(cos(ob) * sin(l), cos(l))) - sid')} AS sun_longitude, degrees(atan2(qz, sqrt(qx * qx + qy * qy))) AS moon_latitude,
        {wrap_sql('degrees(atan2(qy, qx)) - sid')} AS moon_longitude, 1.32712440018e20 * 6371000.0 * 6371000.0 / pow(sun_far, 3) / 9.80665 AS sa, 4.90280066e12 * 6371000.0 * 6371000.0 / pow(far, 3) / 9.80665 AS ma2
    FROM t7
), seen AS (
    SELECT *, cos(radians(latitude)) * cos(radians(sun_latitude)) * cos(radians(longitude - sun_longitude)) + sin(radians(latitude)) * sin(radians(sun_latitude)) AS cs,
        cos(radians(latitude)) * cos(radians(moon_latitude)) * cos(radians(longitude - moon_longitude)) + sin(radians(latitude)) * sin(radians(moon_latitude)) AS cm FROM bodies
)
SELECT event_id, round(sun_latitude, 5) AS sun_latitude, round(sun_longitude, 5) AS sun_longitude, round(moon_latitude, 5) AS moon_latitude, round(moon_longitude, 5) AS moon_longitude, round(far / 1000, 3) AS moon_km,
    round(sa, 6) AS sun_amplitude_m, round(ma2, 6) AS moon_amplitude_m, round(sa * (3 * cs * cs - 1) / 2 + ma2 * (3 * cm * cm - 1) / 2, 6) AS tide_m
FROM seen"""


@query(TIDES_SQL)
def tide_at_events(spark, d):
    b = tides.with_bodies(X.quakes(spark, d).select("event_id", "time_ms", "latitude", "longitude"))
    five, six = (lambda c: F.round(c, 5).alias(c)), (lambda c: F.round(c, 6).alias(c))
    return b.select("event_id", *(five(f"{x}_{y}") for x in ("sun", "moon") for y in ("latitude", "longitude")), F.round(F.col("moon_distance_m") / 1000, 3).alias("moon_km"), six("sun_amplitude_m"), six("moon_amplitude_m"), F.round(tides.tide_m(), 6).alias("tide_m"))
