"""Queries of polylines over the supplied tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremor.operators import polylines as P
from tremor.plans.catalogue import hav, query
from tremor.sources import fixtures as X
from tremor.sources.fixtures import STEPS_SQL, TRACKS_SQL, TRENCH_SQL

SEGMENTS_SQL = f"""WITH {TRACKS_SQL}, ahead AS (
    SELECT *, lead(latitude) OVER w AS b_lat, lead(longitude) OVER w AS b_lon FROM tracks WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
), segs AS (
    SELECT *, CASE WHEN b_lat IS NOT NULL THEN {hav('latitude', 'longitude', 'b_lat', 'b_lon')} END AS km FROM ahead
), cut AS (
    SELECT *, CAST(greatest(1, ceil(coalesce(km, 0) / 50)) AS BIGINT) AS k, km / 6371.0 AS w FROM segs
)"""


@query(f"""{SEGMENTS_SQL}, each AS (SELECT *, unnest(range(k)) AS step FROM cut), p AS (
    SELECT *, CASE WHEN w < 1e-12 THEN 1 - step / k ELSE sin((1 - step / k) * w) / sin(w) END AS a, CASE WHEN w < 1e-12 THEN step / k ELSE sin(step / k * w) / sin(w) END AS b FROM each
), xyz AS (
    SELECT *, a * cos(radians(latitude)) * cos(radians(longitude)) + b * cos(radians(b_lat)) * cos(radians(b_lon)) AS x, a * cos(radians(latitude)) * sin(radians(longitude)) + b * cos(radians(b_lat)) * sin(radians(b_lon)) AS y,
        a * sin(radians(latitude)) + b * sin(radians(b_lat)) AS z FROM p
)
SELECT user_id, event_id, CAST(step AS INTEGER) AS step, round(CASE WHEN step = 0 THEN latitude ELSE degrees(atan2(z, sqrt(x * x + y * y))) END, 5) AS latitude, round(CASE WHEN step = 0 THEN longitude ELSE degrees(atan2(y, x)) END, 5) AS longitude FROM xyz""")
def densified_tracks(spark, d):
    dense = P.densify(P.segments(X.tracks(spark, d), "user_id", "event_id"))
    return dense.select("user_id", "event_id", "step", F.round("latitude", 5).alias("latitude"), F.round("longitude", 5).alias("longitude"))


@query(f"""{SEGMENTS_SQL} SELECT user_id, count(*) AS vertices, CAST(sum(k) AS BIGINT) AS dense, round(coalesce(sum(km), 0), 6) AS length_km, round(max(km / k), 6) AS longest_chord_km,
    CASE WHEN coalesce(sum(km), 0) >= 100 THEN 0 WHEN coalesce(sum(km), 0) >= 30 THEN 1 ELSE 2 END AS tier FROM cut GROUP BY 1""")
def track_lengths(spark, d):
    dense = P.densify(P.segments(X.tracks(spark, d), "user_id", "event_id"))
    km = F.coalesce(F.sum("chord_km"), F.lit(0.0))
    by = dense.groupBy("user_id").agg(F.count_if(F.col("step") == 0).alias("vertices"), F.count("*").alias("dense"), F.round(km, 6).alias("length_km"), F.round(F.max("chord_km"), 6).alias("longest_chord_km"), P.zoom_tier(km).alias("tier"))
    return by


@query(f"""WITH {STEPS_SQL}, seen AS (
    SELECT *, lag(boundary) OVER w AS lb, lag(cls) OVER w AS lc, lag(end_latitude) OVER w AS la, lag(end_longitude) OVER w AS lo FROM steps WINDOW w AS (ORDER BY event_id)
), runs AS (
    SELECT *, sum(CASE WHEN lb = boundary AND lc = cls AND abs(la - start_latitude) < 1e-6 AND abs(lo - start_longitude) < 1e-6 THEN 0 ELSE 1 END) OVER (ORDER BY event_id) AS chain FROM seen
), numbered AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY event_id) AS number FROM runs
), vertices AS (
    SELECT chain, boundary, cls, number, end_latitude AS latitude, end_longitude AS longitude FROM numbered
    UNION ALL SELECT chain, boundary, cls, 0, start_latitude, start_longitude FROM numbered WHERE number = 1
)
SELECT CAST(chain AS BIGINT) AS chain, boundary, cls, CASE WHEN cls IN ('SUB', 'OCB', 'CCB') THEN 'convergent' WHEN cls IN ('OSR', 'CRB') THEN 'divergent' ELSE 'transform' END AS motion, number, round(latitude, 3) AS latitude, round(longitude, 3) AS longitude FROM vertices""")
def boundary_chains(spark, d):
    v = P.merge_steps(X.steps(spark, d), "event_id", ["boundary", "cls"], "cls")
    return v.select("chain", "boundary", "cls", "motion", "number", F.round("latitude", 3).alias("latitude"), F.round("longitude", 3).alias("longitude"))


RUNS_SQL = f"""WITH RECURSIVE {TRENCH_SQL}, seen AS (
    SELECT *, lag(slab) OVER w AS ls, lag(latitude) OVER w AS la, lag(longitude) OVER w AS lo FROM trench WINDOW w AS (ORDER BY event_id)
), far AS (SELECT *, {hav('la', 'lo', 'latitude', 'longitude')} AS far FROM seen
), runs AS (
    SELECT *, CAST(sum(CASE WHEN ls = slab AND far <= 150 THEN 0 ELSE 1 END) OVER (ORDER BY event_id) AS BIGINT) AS run, CASE WHEN ls = slab AND far <= 150 THEN far ELSE 0 END AS km FROM far
), placed AS (SELECT *, sum(km) OVER (PARTITION BY run ORDER BY event_id) AS along FROM runs)"""


@query(f"{RUNS_SQL} SELECT run, min(slab) AS slab, count(*) AS points, round(sum(km), 6) AS km, count(*) >= 2 AS drawable FROM runs GROUP BY 1")
def trench_runs(spark, d):
    runs = P.runs_by_distance(X.trench(spark, d), "event_id", ["slab"])
    return runs.groupBy("run").agg(F.min("slab").alias("slab"), F.count("*").alias("points"), F.round(F.sum("km"), 6).alias("km"), (F.count("*") >= 2).alias("drawable"))


@query(f"""{RUNS_SQL}, jumps AS (
    SELECT p.run, p.event_id, min(q.event_id) AS next FROM placed p JOIN placed q ON p.run = q.run AND p.along + 150 <= q.along GROUP BY 1, 2
), walk AS (
    SELECT run, min(event_id) AS event_id FROM placed WHERE along >= 75 GROUP BY 1
    UNION ALL SELECT w.run, j.next FROM walk w JOIN jumps j USING (run, event_id)
)
SELECT run, event_id, slab, (azimuth + 90) % 360 AS dip, round(along, 6) AS along_km FROM walk JOIN placed USING (run, event_id)""")
def trench_teeth(spark, d):
    runs = P.runs_by_distance(X.trench(spark, d), "event_id", ["slab"])
    return P.teeth(runs, "run", "event_id", "azimuth").select("run", "event_id", "slab", F.col("dip").cast("long").alias("dip"), F.round("along_km", 6).alias("along_km"))


@query(f"""{RUNS_SQL}, steps AS (
    SELECT run, lag(along) OVER w AS a, along AS b, lag(latitude) OVER w AS la, lag(longitude) OVER w AS lo, latitude, longitude FROM placed WINDOW w AS (PARTITION BY run ORDER BY event_id)
), each AS (
    SELECT *, unnest(range(CAST(floor(a / 150 + 0.5) AS BIGINT), CAST(floor(b / 150 + 0.5) AS BIGINT))) AS mark FROM steps WHERE a IS NOT NULL
), shares AS (SELECT *, ((mark + 0.5) * 150 - a) / (b - a) AS f, {hav('la', 'lo', 'latitude', 'longitude')} / 6371.0 AS w FROM each
), xyz AS (
    SELECT *, sin((1 - f) * w) / sin(w) * cos(radians(la)) * cos(radians(lo)) + sin(f * w) / sin(w) * cos(radians(latitude)) * cos(radians(longitude)) AS x,
        sin((1 - f) * w) / sin(w) * cos(radians(la)) * sin(radians(lo)) + sin(f * w) / sin(w) * cos(radians(latitude)) * sin(radians(longitude)) AS y, sin((1 - f) * w) / sin(w) * sin(radians(la)) + sin(f * w) / sin(w) * sin(radians(latitude)) AS z FROM shares
)
SELECT run, mark, round(degrees(atan2(z, sqrt(x * x + y * y))), 5) AS latitude, round(degrees(atan2(y, x)), 5) AS longitude FROM xyz""")
def trench_marks(spark, d):
    runs = P.runs_by_distance(X.trench(spark, d), "event_id", ["slab"])
    return P.marks(runs, "run", "event_id").select("run", "mark", F.round("latitude", 5).alias("latitude"), F.round("longitude", 5).alias("longitude"))
