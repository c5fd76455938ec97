"""Queries of tracks and axes over the supplied tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremor.functions import tracks as T
from tremor.operators import series as S
from tremor.plans.catalogue import DAY, END_MS, HOUR, NOW, START_MS, query
from tremor.sources import fixtures as X
from tremor.sources.fixtures import QUAKES_SQL, SERIES_SQL

BUCKETS = 100
FROM_MS, TO_MS = START_MS + 2 * DAY, NOW - 3 * DAY


@query(f"""WITH {SERIES_SQL}, n AS (SELECT count(*) AS n FROM series), r AS (SELECT *, row_number() OVER (ORDER BY time_ms) - 1 AS r FROM series),
b AS (SELECT i AS bucket, floor(i * (n / {BUCKETS})) AS lo, least(floor((i + 1) * (n / {BUCKETS})), n) AS hi FROM range({BUCKETS}) t(i), n),
g AS (SELECT bucket, min(time_ms) AS start_ms, count(*) AS hours, max(kp) AS peak, quantile_disc(kp, 0.5) AS typical, count(kp) AS measured_hours, min(dst) AS secondary FROM b JOIN r ON r >= lo AND r < hi GROUP BY 1)
SELECT start_ms, round((start_ms - {FROM_MS}) / {TO_MS - FROM_MS}.0, 6) AS x, round(CASE WHEN typical IS NULL THEN 0 ELSE least(typical / 9, 1) END, 6) AS typical_height, round(CASE WHEN peak IS NULL THEN 0 ELSE least(peak / 9, 1) END, 6) AS peak_height, coalesce(peak >= 5, false) AS peak_stormy, coalesce(typical >= 5, false) AS typical_stormy,
    round(typical, 6) AS typical, round(peak, 6) AS peak, round(secondary, 6) AS secondary, hours, measured_hours, measured_hours = 0 AS unmeasured FROM g WHERE start_ms BETWEEN {FROM_MS} AND {TO_MS}""")
def track_layout(spark, d):
    b = S.downsample(X.series(spark, d), BUCKETS, {"kp": "max", "dst": "min"})
    bars = T.layout(b, "kp", FROM_MS, TO_MS, "dst")
    return bars.withColumns({c: F.round(c, 6) for c in ("x", "typical_height", "peak_height", "typical", "peak", "secondary")})


STEPS_SQL = "steps(k, unit, every, ms) AS (VALUES " + ", ".join(f"({k}, '{u}', {n}, {float(n * T.MEAN_MS[u])!r}::DOUBLE)" for k, (u, n) in enumerate(T.STEPS)) + ")"


@query(f"""WITH {QUAKES_SQL}, {STEPS_SQL}, spans AS (
    SELECT user_id, min(time_ms) AS start_ms, CAST(min(time_ms) + pow(1 + user_id % 60, 3) * {HOUR} AS BIGINT) AS end_ms, CAST(2 + user_id % 7 AS INTEGER) AS max_ticks FROM quakes JOIN events USING (event_id) GROUP BY user_id
), chosen AS (
    SELECT w.*, s.unit, s.every FROM spans w JOIN steps s ON s.k = coalesce((SELECT min(k) FROM steps WHERE (w.end_ms - w.start_ms) / ms <= w.max_ticks), {len(T.STEPS) - 1})
), dated AS (SELECT *, make_timestamp(start_ms * 1000) AS t FROM chosen
), aligned AS (
    SELECT *, CASE unit WHEN 'hour' THEN date_trunc('day', t) + to_hours(CAST(hour(t) // every * every AS INTEGER)) WHEN 'day' THEN date_trunc('day', t) WHEN 'month' THEN make_timestamp(year(t), (month(t) - 1) // every * every + 1, 1, 0, 0, 0) ELSE make_timestamp(year(t) // every * every, 1, 1, 0, 0, 0) END AS a FROM dated
), walked AS (
    SELECT *, unnest(range(greatest(4 * max_ticks, 8))) + CASE WHEN a < t THEN 1 ELSE 0 END AS k FROM aligned
), placed AS (
    SELECT *, CASE unit WHEN 'hour' THEN a + to_hours(CAST(k * every AS INTEGER)) WHEN 'day' THEN a + to_days(CAST(CASE WHEN a < t THEN 1 + (k - 1) * every ELSE k * every END AS INTEGER)) WHEN 'month' THEN a + to_months(CAST(k * every AS INTEGER)) ELSE a + to_years(CAST(k * every AS INTEGER)) END AS tick FROM walked
), shown AS (SELECT *, epoch_ms(tick) AS tick_ms, (epoch_ms(tick) - start_ms) / CAST(end_ms - start_ms AS DOUBLE) AS x FROM placed WHERE epoch_ms(tick) <= end_ms)
SELECT user_id, start_ms, end_ms, max_ticks, tick_ms, round(x, 6) AS x, CASE WHEN unit = 'year' THEN CAST(year(tick) AS VARCHAR) WHEN unit = 'month' THEN strftime(tick, '%b %Y') WHEN unit = 'day' OR hour(tick) = 0 THEN strftime(tick, '%-d %b') ELSE strftime(tick, '%H:00') END AS label,
    CASE WHEN x < 0.04 THEN 'start' WHEN x > 0.96 THEN 'end' ELSE 'middle' END AS anchor FROM shown""")
def axis_ticks(spark, d):
    """Axes from each user's first event on, from an hour to many years long."""
    q = X.quakes_of(spark.read.parquet(f"{d}/events.parquet"), "user_id")
    w = q.groupBy("user_id").agg(F.min("time_ms").alias("start_ms"))
    w = w.select("user_id", "start_ms", (F.col("start_ms") + F.pow(1 + F.col("user_id") % 60, F.lit(3.0)) * HOUR).cast("long").alias("end_ms"), (2 + F.col("user_id") % 7).cast("int").alias("max_ticks"))
    return T.ticks(w).withColumn("x", F.round("x", 6))
