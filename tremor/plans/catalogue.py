"""Every query by name, with its SQL: the operators applied to the supplied tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor import constants as K
from tremor.functions import geo, space
from tremor.operators import decluster as D
from tremor.operators import match as M
from tremor.operators import scan, series as S, stats
from tremor.operators import sequences as Q
from tremor.operators import upsert as U
from tremor.plans import hypotheses as H
from tremor.sources import fixtures as X
from tremor.sources.fixtures import CMES_SQL, END_MS, FLARES_SQL, LEDGER_SQL, QUAKES_SQL, SERIES_SQL, START_MS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

DAY, HOUR = K.DAY_MS, K.HOUR_MS
T1, T2 = START_MS + 5 * DAY, START_MS + 20 * DAY
NOW = START_MS + 30 * DAY


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def hav(a: str, b: str, c: str, d: str) -> str:
    return f"2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(({c}) - ({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians(({d}) - ({b})) / 2), 2))))"


def radius_sql(m: str) -> str:
    return f"pow(10.0, 0.1238 * {m} + 0.983)"


def window_sql(m: str) -> str:
    return f"(CASE WHEN {m} >= 6.5 THEN pow(10.0, 0.032 * {m} + 2.7389) ELSE pow(10.0, 0.5409 * {m} - 0.547) END)"


def gk_sql(where: str = "magnitude >= 5.0", more: str = "") -> str:
    """CTEs that end in `independent`, the declustered events."""
    return f"""WITH RECURSIVE {QUAKES_SQL}{more},
    c AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY magnitude DESC, time_ms, event_id) AS ord FROM quakes WHERE {where}),
    preds AS MATERIALIZED (
        SELECT x.ord, list(s.ord) AS p FROM c x JOIN c s ON s.ord < x.ord AND x.time_ms > s.time_ms AND x.time_ms - s.time_ms <= {window_sql('s.magnitude')} * {DAY}
            AND abs(x.latitude - s.latitude) <= 2 AND {hav('s.latitude', 's.longitude', 'x.latitude', 'x.longitude')} <= {radius_sql('s.magnitude')} GROUP BY 1),
    steps AS MATERIALIZED (SELECT c.ord, coalesce(p, []) AS p FROM c LEFT JOIN preds USING (ord)),
    walk AS (
        SELECT CAST(0 AS BIGINT) AS ord, CAST([] AS BIGINT[]) AS free
        UNION ALL
        SELECT s.ord, CASE WHEN list_has_any(w.free, s.p) THEN w.free ELSE list_append(w.free, s.ord) END FROM walk w JOIN steps s ON s.ord = w.ord + 1),
    independent AS MATERIALIZED (SELECT c.* FROM c JOIN (SELECT unnest(free) AS ord FROM (SELECT free FROM walk ORDER BY ord DESC LIMIT 1)) USING (ord))"""


# ------------------------------------------------------------------ reads

@query(f"WITH {QUAKES_SQL} SELECT event_id, time_ms, magnitude FROM quakes WHERE time_ms BETWEEN {T1} AND {T2} AND magnitude >= 5.0")
def scan_time_mag(spark, d):
    return scan.events(X.quakes(spark, d), T1, T2, 5.0).select("event_id", "time_ms", "magnitude")


@query(f"WITH {QUAKES_SQL} SELECT event_id, latitude, longitude, depth_km FROM quakes WHERE latitude BETWEEN -10 AND 30 AND longitude BETWEEN 20 AND 90")
def scan_bbox(spark, d):
    return scan.events_in_box(X.quakes(spark, d), -10, 30, 20, 90).select("event_id", "latitude", "longitude", "depth_km")


@query(f"WITH {QUAKES_SQL} SELECT event_id, time_ms, magnitude, source FROM quakes WHERE event_id = 77")
def event_by_id(spark, d):
    return scan.event_by_id(X.quakes(spark, d), 77).select("event_id", "time_ms", "magnitude", "source")


@query(f"WITH {QUAKES_SQL} SELECT time_ms // 1000 * 1000 AS time_ms, latitude, longitude, magnitude FROM quakes WHERE magnitude >= 5.5 AND time_ms >= {T1} AND time_ms < {T2}")
def analysis_catalog(spark, d):
    return scan.analysis_catalog(X.quakes(spark, d), 5.5, T1, T2)


@query(f"WITH {SERIES_SQL} SELECT time_ms, round(kp, 6) AS kp, round(dst, 6) AS dst FROM series WHERE time_ms >= {T1} AND time_ms < {T2}")
def space_weather_range(spark, d):
    return rounded(scan.half_open(X.series(spark, d), T1, T2).select("time_ms", "kp", "dst"), "kp", "dst")


@query(f"WITH {SERIES_SQL} SELECT time_ms, round(wind_speed, 6) AS wind_speed FROM series WHERE time_ms = {T1 // HOUR * HOUR}")
def series_at(spark, d):
    return rounded(scan.half_open(X.series(spark, d), T1 // HOUR * HOUR, T1 // HOUR * HOUR + HOUR).select("time_ms", "wind_speed"), "wind_speed")


@query(f"WITH {SERIES_SQL} SELECT count(*) AS n FROM series WHERE coalesce(kp >= 5, false) OR coalesce(dst <= -100, false)")
def stormy_hours(spark, d):
    return X.series(spark, d).where(scan.is_stormy(F.col("kp"), F.col("dst"))).agg(F.count("*").alias("n"))


CUT = START_MS + 10 * DAY


@query(f"WITH {FLARES_SQL} SELECT id, source, peak_ms FROM flares WHERE (source = 'goes' AND peak_ms < {CUT}) OR (source = 'donki' AND peak_ms >= {CUT})")
def flares_preferred(spark, d):
    return scan.preferred_flares(X.flares(spark, d), cutover_ms=CUT).select("id", "source", "peak_ms")


@query(f"WITH {FLARES_SQL} SELECT id, flare_class, magnitude FROM flares WHERE flare_class = 'X' OR (flare_class = 'M' AND magnitude >= 5.0)")
def flares_at_least(spark, d):
    return X.flares(spark, d).where(scan.flare_at_least(F.col("flare_class"), F.col("magnitude"), "M", 5.0)).select("id", "flare_class", "magnitude")


@query(f"WITH {CMES_SQL} SELECT id, time_ms FROM cmes WHERE NOT glancing AND NOT minor")
def direct_impacts(spark, d):
    return X.cmes(spark, d).where(scan.is_direct(F.col("glancing"), F.col("minor"))).select("id", "time_ms")


@query(f"WITH {QUAKES_SQL} SELECT event_id, magnitude FROM quakes WHERE magnitude >= 5.5 AND magnitude < 6.0 AND time_ms >= {T1}")
def magnitude_band(spark, d):
    return scan.band(X.quakes(spark, d), 5.5, 6.0, T1).select("event_id", "magnitude")


@query(f"WITH {QUAKES_SQL} SELECT event_id FROM quakes WHERE time_ms BETWEEN {T1} AND {T1 + DAY}")
def playhead(spark, d):
    return scan.playhead(X.quakes(spark, d), T1, T1 + DAY).select("event_id")


@query(f"WITH {QUAKES_SQL} SELECT event_id, magnitude, time_ms FROM quakes WHERE time_ms > {T1} AND magnitude >= 5.8 ORDER BY magnitude DESC, time_ms DESC, event_id LIMIT 10")
def missed_events_topk(spark, d):
    return scan.missed(X.quakes(spark, d), T1).select("event_id", "magnitude", "time_ms")


@query(f"WITH {QUAKES_SQL} SELECT count(*) AS n FROM quakes WHERE time_ms > {T1} AND magnitude >= 5.8")
def missed_events_count(spark, d):
    return scan.missed(X.quakes(spark, d), T1, limit=None).agg(F.count("*").alias("n"))


@query(f"WITH {QUAKES_SQL} SELECT event_id, time_ms FROM quakes WHERE magnitude >= 5.8 AND {T2} - time_ms <= 14400000 AND event_id % 2 = 0 ORDER BY time_ms DESC, event_id LIMIT 1")
def select_alert(spark, d):
    q = X.quakes(spark, d)
    return scan.alert(q, T2, q.where("event_id % 2 <> 0")).select("event_id", "time_ms")


@query(f"WITH {QUAKES_SQL} SELECT event_id, magnitude FROM quakes ORDER BY magnitude DESC, time_ms DESC, event_id LIMIT 25 OFFSET 50")
def list_page(spark, d):
    return scan.page(X.quakes(spark, d), [F.desc("magnitude"), F.desc("time_ms"), F.asc("event_id")], 50, 25).select("event_id", "magnitude")


@query(f"WITH {QUAKES_SQL} SELECT count(*) AS n, max(updated_ms) AS latest_update FROM quakes WHERE time_ms >= {T1}")
def catalog_signature(spark, d):
    return scan.signature(X.quakes(spark, d), T1)


@query(f"WITH {SERIES_SQL} SELECT count(*) AS n, min(time_ms) AS first_ms, max(time_ms) AS last_ms FROM series")
def series_coverage(spark, d):
    return scan.coverage(X.series(spark, d))


@query(f"WITH {SERIES_SQL} SELECT DISTINCT year(make_timestamp(time_ms * 1000)) AS year FROM series WHERE kp IS NOT NULL")
def years_present(spark, d):
    return scan.years_present(X.series(spark, d), "kp")


@query(f"WITH {LEDGER_SQL} SELECT count(*) AS chunks, CAST(coalesce(sum(event_count), 0) AS BIGINT) AS events FROM ledger")
def ledger_summary(spark, d):
    return scan.ledger_summary(X.ledger(spark, d))


@query(f"WITH {LEDGER_SQL} SELECT DISTINCT year FROM ledger WHERE min_magnitude <= 5.0")
def completed_years(spark, d):
    return scan.completed_years(X.ledger(spark, d), 5.0)


@query(f"WITH {LEDGER_SQL} SELECT CAST(y AS INTEGER) AS year FROM range(1994, 2003) r(y) WHERE y NOT IN (SELECT year FROM ledger)")
def missing_years(spark, d):
    return scan.missing_years(X.ledger(spark, d), 1994, 2002)


@query(f"WITH {LEDGER_SQL} SELECT count(*) = 0 AS complete FROM range(1995, 2001) r(y) WHERE y NOT IN (SELECT year FROM ledger WHERE min_magnitude <= 5.5)")
def archive_complete(spark, d):
    return scan.is_complete(X.ledger(spark, d), 5.5, 1995, 2001)


@query(f"""WITH {LEDGER_SQL}, runs AS (SELECT year, year - row_number() OVER (ORDER BY year) AS g FROM (SELECT DISTINCT year FROM ledger))
SELECT string_agg(t, ', ' ORDER BY a) AS ranges FROM (SELECT min(year) AS a, CASE WHEN min(year) = max(year) THEN CAST(min(year) AS VARCHAR) ELSE min(year) || '–' || max(year) END AS t FROM runs GROUP BY g)""")
def year_ranges(spark, d):
    return S.year_ranges(X.ledger(spark, d).select("year"))


@query(f"""WITH {LEDGER_SQL}, chunks AS (SELECT y AS year, 7.5 AS min_magnitude FROM range(1900, 1970) r(y) UNION ALL SELECT y, 4.5 FROM range(1970, 2003) r(y))
SELECT CAST(c.year AS INTEGER) AS year, CAST(c.min_magnitude AS DOUBLE) AS min_magnitude FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.year = c.year AND l.min_magnitude <= c.min_magnitude AND l.year < 2002)""")
def planned_chunks(spark, d):
    return scan.planned_chunks(spark, X.ledger(spark, d), 2002)


# ------------------------------------------------------------------ mutations

@query(f"WITH {QUAKES_SQL} SELECT event_id, magnitude FROM quakes WHERE NOT (time_ms < {T2} AND magnitude < 5.0)")
def prune_retention(spark, d):
    return U.prune(X.quakes(spark, d), T2, 5.0).select("event_id", "magnitude")


@query(f"WITH {QUAKES_SQL} SELECT count(*) FILTER (time_ms < {T2} AND magnitude < 4.6) AS removed FROM quakes")
def prune_count(spark, d):
    return U.pruned_count(X.quakes(spark, d), T2, 4.6)


@query(f"""WITH {QUAKES_SQL}, old AS (SELECT event_id, magnitude, source FROM quakes WHERE event_id % 3 <> 0), new AS (SELECT event_id, magnitude + 0.5 AS magnitude, 'new' AS source FROM quakes WHERE event_id % 2 = 0)
SELECT coalesce(o.event_id, n.event_id) AS event_id, coalesce(n.magnitude, o.magnitude) AS magnitude, coalesce(o.source, n.source) AS source FROM old o FULL JOIN new n USING (event_id)""")
def merge_latest(spark, d):
    q = X.quakes(spark, d).select("event_id", "magnitude", "source")
    twice = q.where("event_id % 2 = 0").selectExpr("event_id", "explode(array(0.25D, 0.5D)) as k", "magnitude", "'new' as source").selectExpr("event_id", "magnitude + k as magnitude", "source", "k")
    return U.merge_latest(q.where("event_id % 3 <> 0"), twice, "event_id", order="k", keep_old=("source",))


@query(f"""WITH {SERIES_SQL}, old AS (SELECT time_ms, kp, dst FROM series WHERE time_ms % 7200000 = 0), new AS (SELECT time_ms, kp + 1 AS kp, CASE WHEN kp > 2 THEN dst - 1 END AS dst FROM series WHERE time_ms % 10800000 = 0)
SELECT time_ms, round(coalesce(n.kp, o.kp), 6) AS kp, round(coalesce(n.dst, o.dst), 6) AS dst FROM old o FULL JOIN new n USING (time_ms)""")
def merge_coalesce(spark, d):
    s = X.series(spark, d).select("time_ms", "kp", "dst")
    new = s.where("time_ms % 10800000 = 0").selectExpr("time_ms", "kp + 1 as kp", "case when kp > 2 then dst - 1 end as dst")
    return rounded(U.merge_coalesce(s.where("time_ms % 7200000 = 0"), new, "time_ms"), "kp", "dst")


# ------------------------------------------------------------------ series

@query(f"WITH {QUAKES_SQL} SELECT time_ms // {HOUR} * {HOUR} AS time_ms, floor(avg(magnitude) * 10 + 0.5) / 10 AS magnitude FROM quakes GROUP BY 1")
def hourly_mean_round1(spark, d):
    return S.hourly_mean(X.quakes(spark, d), "time_ms", "magnitude")


@query(f"WITH {QUAKES_SQL} SELECT time_ms // {HOUR} * {HOUR} AS time_ms, max(depth_km) AS depth_km FROM quakes WHERE depth_km > 0 GROUP BY 1")
def hourly_max(spark, d):
    return S.hourly_max(X.quakes(spark, d), "time_ms", "depth_km")


@query(f"WITH {SERIES_SQL} SELECT time_ms + k * {HOUR} AS time_ms, round(kp, 6) AS kp FROM series, range(3) r(k) WHERE time_ms % 10800000 = 0 AND kp IS NOT NULL")
def kp_expand_3h(spark, d):
    return rounded(S.expand_three_hours(X.series(spark, d).where("time_ms % 10800000 = 0 and kp is not null").select("time_ms", "kp"), "kp"), "kp")


@query(f"""WITH {SERIES_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY time_ms) - 1 AS r, count(*) OVER () AS n FROM series),
b AS (SELECT CAST(x AS BIGINT) AS bucket, floor(x * (n / least(50, n))) AS lo, least(floor((x + 1) * (n / least(50, n))), n) AS hi FROM range(50) t(x), (SELECT count(*)::DOUBLE AS n FROM series) WHERE x < n)
SELECT bucket, min(time_ms) AS start_ms, count(*) AS hours, round(max(kp), 6) AS kp_peak, round(quantile_disc(kp, 0.5), 6) AS kp_typical, count(kp) AS kp_measured,
    round(min(dst), 6) AS dst_peak, round(quantile_disc(dst, 0.5), 6) AS dst_typical, count(dst) AS dst_measured FROM r JOIN b ON r >= lo AND r < hi GROUP BY 1""")
def downsample_series(spark, d):
    return rounded(S.downsample(X.series(spark, d), 50, {"kp": "max", "dst": "min"}), "kp_peak", "kp_typical", "dst_peak", "dst_typical")


@query(f"""WITH {QUAKES_SQL}, c AS (SELECT least(39, floor((time_ms - {T1}) / ({T2 - T1} / 40.0))) AS bin, count(*) AS n, max(magnitude) AS m FROM quakes WHERE time_ms BETWEEN {T1} AND {T2} GROUP BY 1)
SELECT CAST(x AS BIGINT) AS bin, coalesce(n, 0) AS n, m AS max_magnitude, coalesce(m >= 5.5, false) AS emphasised FROM range(40) t(x) LEFT JOIN c ON bin = x""")
def track_bins(spark, d):
    return S.track_bins(X.quakes(spark, d), T1, T2, 40)


@query(f"WITH {SERIES_SQL} SELECT round(max(kp), 6) AS kp_peak, round(min(dst), 6) AS dst_peak, round(max(wind_speed), 6) AS wind_peak FROM series")
def track_peaks(spark, d):
    return rounded(S.peaks(X.series(spark, d)), "kp_peak", "dst_peak", "wind_peak")


GRID_SQL = f"{SERIES_SQL}, grid AS (SELECT CAST(i AS BIGINT) AS idx, {START_MS} + i * {HOUR} AS time_ms, s.kp, s.dst, s.wind_speed FROM range(720) r(i) LEFT JOIN series s ON s.time_ms = {START_MS} + i * {HOUR})"


def grid(spark, d, *values):
    return S.hourly_grid(X.series(spark, d), START_MS, END_MS, list(values))


@query(f"WITH {GRID_SQL} SELECT idx, time_ms, round(kp, 6) AS kp, round(dst, 6) AS dst FROM grid")
def hourly_grid(spark, d):
    return rounded(grid(spark, d, "kp", "dst"), "kp", "dst")


def episodes_sql(name: str, test: str, least: int) -> str:
    return f"{name} AS (SELECT min(time_ms) AS onset_ms, count(*) AS run_hours FROM (SELECT *, idx - row_number() OVER (ORDER BY idx) AS g FROM grid WHERE {test}) GROUP BY g HAVING count(*) >= {least})"


@query(f"WITH {GRID_SQL}, {episodes_sql('e', 'wind_speed >= 500', 6)} SELECT * FROM e")
def threshold_episodes(spark, d):
    return S.episodes(grid(spark, d, "wind_speed"), "wind_speed", 500.0, True, 6)


ELIGIBLE_SQL = "eligible AS (SELECT idx, time_ms FROM (SELECT *, count({v}) OVER (ORDER BY idx ROWS BETWEEN CURRENT ROW AND {w} FOLLOWING) AS c FROM grid) WHERE c = {w} + 1)"


@query(f"WITH {GRID_SQL}, {ELIGIBLE_SQL.format(v='wind_speed', w=5)} SELECT * FROM eligible")
def eligible_hours(spark, d):
    return S.eligible(grid(spark, d, "wind_speed"), "wind_speed", 6)


# ------------------------------------------------------------------ space

@query(f"WITH {QUAKES_SQL} SELECT event_id, round({hav('latitude', 'longitude', '35.0', '139.0')}, 6) AS km FROM quakes")
def haversine_to_point(spark, d):
    return X.quakes(spark, d).select("event_id", F.round(geo.haversine_km("latitude", "longitude", 35.0, 139.0), 6).alias("km"))


@query(f"WITH {QUAKES_SQL} SELECT event_id, -latitude AS alat, CASE WHEN longitude >= 0 THEN longitude - 180 ELSE longitude + 180 END AS alon FROM quakes")
def antipode_projection(spark, d):
    la, lo = geo.antipode("latitude", "longitude")
    return X.quakes(spark, d).select("event_id", la.alias("alat"), lo.alias("alon"))


@query(f"WITH {QUAKES_SQL} SELECT event_id, magnitude FROM quakes WHERE magnitude >= 5.0 AND {hav('10.0', '40.0', 'latitude', 'longitude')} <= 1500")
def circle_query(spark, d):
    return Q.circle(X.quakes(spark, d), 10.0, 40.0, 1500.0, 5.0).select("event_id", "magnitude")


@query(f"WITH {QUAKES_SQL} SELECT event_id FROM quakes WHERE {hav('-20.0', '178.0', 'latitude', 'longitude')} <= 2500")
def antimeridian_circle(spark, d):
    return Q.circle(X.quakes(spark, d), -20.0, 178.0, 2500.0).select("event_id")


NEAREST_SQL = f"""{QUAKES_SQL}, {X.segments_values()},
flat AS (SELECT event_id, line, pair, cls, ((ax - longitude + 540) % 360 - 180) * cos(radians(latitude)) * 111.32 AS x1, (ay - latitude) * 111.32 AS y1,
    ((bx - longitude + 540) % 360 - 180) * cos(radians(latitude)) * 111.32 AS x2, (b_y - latitude) * 111.32 AS y2 FROM quakes, segs),
par AS (SELECT *, CASE WHEN x1 = x2 AND y1 = y2 THEN 0 ELSE greatest(0, least(1, -(x1 * (x2 - x1) + y1 * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) END AS t FROM flat),
dist AS (SELECT *, sqrt(pow(x1 + t * (x2 - x1), 2) + pow(y1 + t * (y2 - y1), 2)) AS km FROM par),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY km, line) AS r FROM dist) WHERE r = 1)"""


@query(f"WITH {NEAREST_SQL} SELECT event_id, line, round(km, 6) AS distance_km FROM near")
def nearest_boundary(spark, d):
    return rounded(M.nearest_line(X.quakes(spark, d), M.segments(X.lines(spark))), "distance_km")


@query(f"WITH {NEAREST_SQL} SELECT pair, count(*) AS n, arg_min(cls, line) AS cls FROM near GROUP BY pair")
def boundary_breakdown(spark, d):
    return M.breakdown(X.quakes(spark, d), M.segments(X.lines(spark)), X.lines(spark))


# ------------------------------------------------------------------ matching: emsc events, and usgs copies shifted a little

COPY_SQL = f"{QUAKES_SQL}, twin AS (SELECT event_id + 10000000 AS event_id, time_ms + event_id % 90 * 1000 AS time_ms, magnitude + (event_id % 4) * 0.2 AS magnitude, latitude + 0.1 AS latitude, longitude + (event_id % 3) * 0.3 AS longitude FROM quakes WHERE source = 'emsc')"


def twin(q: DataFrame) -> DataFrame:
    return q.where("source = 'emsc'").selectExpr("event_id + 10000000 as event_id", "time_ms + event_id % 90 * 1000 as time_ms", "magnitude + (event_id % 4) * 0.2D as magnitude", "latitude + 0.1D as latitude", "longitude + (event_id % 3) * 0.3D as longitude")


@query(f"WITH {COPY_SQL} SELECT a.event_id AS a_event_id, b.event_id AS b_event_id FROM quakes a JOIN twin b ON abs(a.time_ms - b.time_ms) <= 60000 AND abs(a.latitude - b.latitude) <= 1 AND abs(a.longitude - b.longitude) <= 1")
def candidate_matches(spark, d):
    q = X.quakes(spark, d)
    return M.candidate_matches(q, twin(q), 60).select("a_event_id", "b_event_id")


@query(f"""WITH {COPY_SQL} SELECT t.event_id FROM twin t WHERE NOT EXISTS (SELECT 1 FROM quakes q WHERE abs(t.time_ms - q.time_ms) <= 60000 AND abs(t.magnitude - q.magnitude) <= 0.5
    AND {hav('t.latitude', 't.longitude', 'q.latitude', 'q.longitude')} <= 50)""")
def dedupe_antijoin(spark, d):
    q = X.quakes(spark, d)
    return M.reject_duplicates(twin(q), q).select("event_id")


MATCH_SQL = f"""{COPY_SQL}, near AS (SELECT * FROM (SELECT a.event_id, b.event_id AS mech_id, a.time_ms AS ta, b.time_ms AS tb, {hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} AS dist,
    row_number() OVER (PARTITION BY a.event_id ORDER BY {hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')}, b.time_ms, b.event_id) AS r
    FROM quakes a JOIN twin b ON abs(a.time_ms - b.time_ms) <= 60000 WHERE {hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} <= 100) WHERE r = 1),
kept AS (SELECT *, row_number() OVER (PARTITION BY mech_id ORDER BY dist, abs(ta - tb), ta, event_id) AS k FROM near)"""


@query(f"WITH {MATCH_SQL} SELECT event_id, mech_id, round(dist, 6) AS distance_km FROM kept WHERE k = 1")
def match_mechanisms(spark, d):
    q = X.quakes(spark, d)
    return rounded(M.match_mechanisms(q, twin(q)).where("mech_id is not null").select("event_id", "mech_id", "distance_km"), "distance_km")


@query(f"WITH {MATCH_SQL} SELECT q.event_id, coalesce(k > 1, false) AS contested FROM quakes q LEFT JOIN kept USING (event_id) WHERE k IS NULL OR k > 1")
def match_unmatched(spark, d):
    q = X.quakes(spark, d)
    return M.match_mechanisms(q, twin(q)).where("mech_id is null").select("event_id", "contested")


# ------------------------------------------------------------------ declustering and what follows

@query(f"WITH {QUAKES_SQL} SELECT event_id, round({radius_sql('magnitude')}, 6) AS radius_km, round({window_sql('magnitude')}, 6) AS window_days FROM quakes")
def gk_windows(spark, d):
    return X.quakes(spark, d).select("event_id", F.round(D.gk_radius_km(F.col("magnitude")), 6).alias("radius_km"), F.round(D.gk_window_days(F.col("magnitude")), 6).alias("window_days"))


@query(gk_sql() + " SELECT event_id, magnitude FROM independent")
def gk_decluster(spark, d):
    return D.decluster(X.quakes(spark, d).where("magnitude >= 5.0")).select("event_id", "magnitude")


@query(gk_sql() + " SELECT (SELECT count(*) FROM c) AS n_raw, (SELECT count(*) FROM independent) AS n_independent")
def gk_counts(spark, d):
    q = X.quakes(spark, d).where("magnitude >= 5.0")
    return q.agg(F.count("*").alias("n_raw")).join(F.broadcast(D.decluster(q).agg(F.count("*").alias("n_independent"))))


SHOCK_SQL = f"""{QUAKES_SQL}, main AS (SELECT event_id AS main_id, time_ms AS main_ms, magnitude AS mm, latitude AS mlat, longitude AS mlon, {window_sql('magnitude')} AS win FROM quakes WHERE magnitude >= 6.5),
members AS (SELECT main_id, main_ms, mm, event_id, magnitude, time_ms, (time_ms - main_ms) / {DAY}.0 AS days FROM main JOIN quakes ON time_ms BETWEEN main_ms AND least(main_ms + win * {DAY}, {NOW}) AND event_id <> main_id AND magnitude >= 4.5
    AND {hav('mlat', 'mlon', 'latitude', 'longitude')} <= {radius_sql('mm')})"""


@query(f"WITH {SHOCK_SQL} SELECT main_id, event_id, round(days, 6) AS elapsed_days FROM members")
def aftershock_members(spark, d):
    q = X.quakes(spark, d)
    return rounded(Q.aftershocks(q, q.where("magnitude >= 6.5"), NOW).select("main_id", "event_id", "elapsed_days"), "elapsed_days")


@query(f"""WITH {SHOCK_SQL}, bins(bin, lo, hi) AS (VALUES (0, 0.0, 1.0), (1, 1.0, 7.0), (2, 7.0, 30.0), (3, 30.0, 180.0), (4, 180.0, NULL)),
c AS (SELECT main_id, CASE WHEN days < 1 THEN 0 WHEN days < 7 THEN 1 WHEN days < 30 THEN 2 WHEN days < 180 THEN 3 ELSE 4 END AS bin, count(*) AS n FROM members GROUP BY 1, 2),
f AS (SELECT main_id, bin, coalesce(n, 0) AS n, greatest(0.0, least(least(({NOW} - main_ms) / {DAY}.0, win), coalesce(hi, 1e9)) - lo) AS od FROM main CROSS JOIN bins LEFT JOIN c USING (main_id, bin))
SELECT main_id, bin, n, round(od, 6) AS observed_days, round(CASE WHEN od > 0 THEN n / od END, 6) AS per_day FROM f""")
def aftershock_bins(spark, d):
    q = X.quakes(spark, d)
    main = q.where("magnitude >= 6.5")
    return rounded(Q.aftershock_bins(Q.aftershocks(q, main, NOW), main, NOW), "observed_days", "per_day")


@query(f"""WITH {SHOCK_SQL} SELECT main_id, count(*) AS n, max(magnitude) AS largest_magnitude, max(magnitude) > first(mm) AS exceeded,
    round((arg_max(time_ms, (magnitude, -time_ms)) - first(main_ms)) / {HOUR}.0, 6) AS hours_to_largest FROM members GROUP BY 1""")
def sequence_summary(spark, d):
    q = X.quakes(spark, d)
    return rounded(Q.sequence_summary(Q.aftershocks(q, q.where("magnitude >= 6.5"), NOW)).drop("largest_id"), "hours_to_largest")


REGION = f"magnitude >= 5.0 AND time_ms BETWEEN {START_MS} AND {NOW} AND " + hav("10.0", "40.0", "latitude", "longitude") + " <= 3000"


def region(spark, d):
    return Q.circle(X.quakes(spark, d), 10.0, 40.0, 3000.0, 5.0, START_MS, NOW)


@query(gk_sql(REGION) + f" SELECT event_id, round((time_ms - lag(time_ms) OVER (ORDER BY time_ms, event_id)) / {DAY}.0, 6) AS gap FROM independent")
def recurrence_gaps(spark, d):
    return rounded(Q.gaps(D.decluster(region(spark, d)), DAY).select("event_id", "gap"), "gap")


@query(gk_sql(REGION) + f""", g AS (SELECT time_ms, (time_ms - lag(time_ms) OVER (ORDER BY time_ms, event_id)) / {DAY}.0 AS gap FROM independent)
SELECT count(*) AS n_independent, count(gap) AS n_intervals, round(CASE WHEN count(gap) >= 8 THEN list_sort(list(gap) FILTER (gap IS NOT NULL))[CAST(count(gap) // 2 + 1 AS BIGINT)] END, 6) AS median_gap,
    round(min(gap), 6) AS shortest, round(max(gap), 6) AS longest, round(({NOW} - max(time_ms)) / {DAY}.0, 6) AS since_last, CAST(30 AS DOUBLE) AS observed FROM g""")
def recurrence_summary(spark, d):
    r = Q.recurrence(X.quakes(spark, d), 10.0, 40.0, 3000.0, 5.0, NOW, START_MS, DAY)
    return rounded(r, "median_gap", "shortest", "longest", "since_last", "observed")


@query(f"""WITH {QUAKES_SQL}, main AS (SELECT event_id AS main_id, time_ms AS t, -latitude AS la, CASE WHEN longitude >= 0 THEN longitude - 180 ELSE longitude + 180 END AS lo FROM quakes WHERE magnitude >= 6.0)
SELECT main_id, event_id, round({hav('la', 'lo', 'latitude', 'longitude')}, 6) AS distance_km, round((time_ms - t) / {HOUR}.0, 6) AS delay_hours FROM main JOIN quakes ON time_ms BETWEEN t + 1 AND t + 72 * {HOUR} AND magnitude >= 5.0
WHERE {hav('la', 'lo', 'latitude', 'longitude')} <= 1000""")
def antipodal_window(spark, d):
    q = X.quakes(spark, d)
    return rounded(Q.antipodal(q, q.where("magnitude >= 6.0")), "distance_km", "delay_hours")


@query(f"""WITH {QUAKES_SQL}, n AS (SELECT count(*) AS n FROM quakes WHERE magnitude >= 5.0 AND time_ms BETWEEN {START_MS} AND {NOW} AND {hav('-10.0', '-140.0', 'latitude', 'longitude')} <= 1000)
SELECT n, round(n / 30.0, 6) AS per_year, n = 0 AS silent, round(CASE WHEN n > 0 THEN 30.0 * 365.25 / n END, 6) AS interval_days FROM n""")
def antipodal_background(spark, d):
    return rounded(Q.antipodal_background(X.quakes(spark, d), 10.0, 40.0, START_MS, NOW, DAY), "per_year", "interval_days")


# ------------------------------------------------------------------ statistics

HALF = 3 * DAY
KP_SQL = f"{GRID_SQL}, {episodes_sql('onsets', 'kp >= 6', 1)}, targets AS (SELECT time_ms AS p FROM quakes WHERE magnitude >= 6.0 AND time_ms BETWEEN {START_MS} AND {END_MS})"


def rate_sql(t: str) -> str:
    lo, hi = f"greatest({t} - {HALF}, {START_MS})", f"least({t} + {HALF}, {END_MS})"
    return f"(SELECT count(*) FROM targets WHERE p BETWEEN {lo} AND {hi}) / nullif(({hi} - {lo}) / {HOUR}.0, 0)"


def kp_triggers(spark, d):
    return S.episodes(grid(spark, d, "kp"), "kp", 6.0).select(F.col("onset_ms").alias("time_ms"))


def big(spark, d):
    return X.quakes(spark, d).where(F.col("time_ms").between(START_MS, END_MS) & (F.col("magnitude") >= 6.0))


@query(f"WITH {QUAKES_SQL}, {KP_SQL} SELECT onset_ms AS time_ms, round({rate_sql('onset_ms')}, 6) AS rate FROM onsets")
def local_rate(spark, d):
    return rounded(stats.local_rate(kp_triggers(spark, d), big(spark, d), START_MS, END_MS, HALF), "rate")


@query(f"WITH {QUAKES_SQL}, {KP_SQL} SELECT onset_ms AS time_ms, (SELECT count(*) FROM targets WHERE p >= onset_ms AND p < onset_ms + 24 * {HOUR}) AS observed FROM onsets")
def lag_counts(spark, d):
    return stats.lag_counts(kp_triggers(spark, d), big(spark, d), 0, 24)


@query(f"""WITH {QUAKES_SQL}, {KP_SQL}, r AS (SELECT (SELECT count(*) FROM targets WHERE p >= onset_ms + 24 * {HOUR} AND p < onset_ms + 48 * {HOUR}) AS o, 24 * {rate_sql('onset_ms')} AS e FROM onsets)
SELECT count(*) AS triggers, CAST(sum(o) AS BIGINT) AS observed, round(sum(e), 6) AS expected, round(sum(o) / sum(e), 6) AS ratio FROM r""")
def lag_window_ratio(spark, d):
    return rounded(stats.ratio_of(stats.hour_table(kp_triggers(spark, d), big(spark, d), 24, 48, START_MS, END_MS, HALF)), "expected", "ratio")


def subsolar_sql(t: str) -> str:
    n = f"({t} / {DAY}.0 + 2440587.5 - 2451545.0)"
    mod = lambda x: f"((({x}) % 360.0 + 360.0) % 360.0)"
    mean, g = mod(f"280.460 + 0.9856474 * {n}"), f"radians({mod(f'357.528 + 0.9856003 * {n}')})"
    lam = f"radians({mean} + 1.915 * sin({g}) + 0.020 * sin(2 * {g}))"
    tilt = f"radians(23.439 - 0.0000004 * {n})"
    eq = f"({mod(f'{mean} - degrees(atan2(cos({tilt}) * sin({lam}), cos({lam}))) + 180.0')} - 180.0)"
    return f"({mod(f'-15.0 * (({t} % {DAY}) / {HOUR}.0 - 12.0) - {eq} + 180.0')} - 180.0)"


@query(f"WITH {QUAKES_SQL} SELECT event_id, round({subsolar_sql('time_ms')}, 5) AS sub_lon FROM quakes")
def subsolar_longitude(spark, d):
    return X.quakes(spark, d).select("event_id", F.round(stats.subsolar(F.col("time_ms"))[1], 5).alias("sub_lon"))


@query(f"""WITH {QUAKES_SQL}, {CMES_SQL}, p AS (SELECT abs(((longitude - {subsolar_sql('c.time_ms')} + 180.0) % 360.0 + 360.0) % 360.0 - 180.0) <= 90 AS near FROM cmes c JOIN quakes q ON q.time_ms >= c.time_ms AND q.time_ms < c.time_ms + 24 * {HOUR} AND q.magnitude >= 6.0 WHERE NOT glancing AND NOT minor)
SELECT count(*) FILTER (near) AS near, count(*) FILTER (NOT near) AS far, round(count(*) FILTER (near) / count(*) FILTER (NOT near), 6) AS ratio FROM p""")
def hemisphere_ratio(spark, d):
    t = X.cmes(spark, d).where(scan.is_direct(F.col("glancing"), F.col("minor"))).select("time_ms")
    return rounded(stats.hemisphere_ratio(t, X.quakes(spark, d).where("magnitude >= 6.0"), 0, 24), "ratio")


ANTI = "-a.latitude", "CASE WHEN a.longitude >= 0 THEN a.longitude - 180 ELSE a.longitude + 180 END"
REF_SQL = f"""{QUAKES_SQL}, trig AS (SELECT * FROM quakes WHERE magnitude >= 7.0), targ AS (SELECT * FROM quakes WHERE magnitude >= 6.0),
refc AS (SELECT least(200, floor(({hav(*ANTI, 'b.latitude', 'b.longitude')}) / 100.0)) AS bin, count(*) AS n FROM trig a, targ b GROUP BY 1),
ref AS (SELECT CAST(x AS BIGINT) AS bin, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (ORDER BY x) / sum(coalesce(n, 0)) OVER () AS cdf FROM range(201) t(x) LEFT JOIN refc ON bin = x),
obsc AS (SELECT least(200, floor(({hav(*ANTI, 'b.latitude', 'b.longitude')}) / 100.0)) AS bin, count(*) AS n FROM trig a JOIN targ b ON b.time_ms > a.time_ms AND b.time_ms < a.time_ms + 72 * {HOUR} GROUP BY 1),
obs AS (SELECT CAST(x AS BIGINT) AS bin, coalesce(sum(coalesce(n, 0)) OVER (ORDER BY x) / nullif(sum(coalesce(n, 0)) OVER (), 0), 0) AS cdf FROM range(201) t(x) LEFT JOIN obsc ON bin = x)"""


def ks(spark, d):
    q = X.quakes(spark, d)
    return q.where("magnitude >= 7.0"), q.where("magnitude >= 6.0")


@query(f"WITH {REF_SQL} SELECT bin, n, round(cdf, 6) AS cdf FROM ref")
def ks_reference_cdf(spark, d):
    return rounded(stats.cdf(stats.reference_counts(*ks(spark, d))), "cdf")


@query(f"WITH {REF_SQL} SELECT round(max(greatest(o.cdf - r.cdf, 0)), 6) AS d_plus, round(max(abs(o.cdf - r.cdf)), 6) AS two_sided FROM obs o JOIN ref r USING (bin)")
def ks_d_plus(spark, d):
    a, b = ks(spark, d)
    return rounded(stats.d_plus(stats.cdf(stats.distance_counts(stats.window_distances(a, b, 0, 72))), stats.cdf(stats.reference_counts(a, b))), "d_plus", "two_sided")


ITER = 60  # of the short forms; the registered_* queries run K.ITERATIONS
NULL_SQL = f"""{QUAKES_SQL}, {KP_SQL}, pool AS (SELECT idx, (SELECT count(*) FROM targets WHERE p >= time_ms AND p < time_ms + 24 * {HOUR}) AS o, 24 * coalesce({rate_sql('time_ms')}, 0) AS e FROM grid WHERE kp IS NOT NULL),
trig AS (SELECT count(*) AS n FROM onsets),
drawn AS (SELECT i AS iter, o, e, row_number() OVER (PARTITION BY i ORDER BY md5('7:' || i || ':' || idx), idx) AS r FROM pool, range({ITER}) t(i)),
nulls AS (SELECT iter, sum(o) / sum(e) AS ratio FROM drawn, trig WHERE r <= n GROUP BY 1)"""


def kp_null(spark, d, iterations=ITER):
    g = grid(spark, d, "kp")
    table = stats.hour_tables(S.eligible(g, "kp", 1), big(spark, d), ((0, 24),), START_MS, END_MS, HALF)[0, 24]
    n = S.episodes(g, "kp", 6.0).count()
    return stats.null_by_hash(table, n, iterations, 7)


@query(f"WITH {NULL_SQL} SELECT iter, round(ratio, 6) AS ratio FROM nulls")
def null_distribution(spark, d):
    return rounded(kp_null(spark, d), "ratio")


@query(f"WITH {NULL_SQL} SELECT count(ratio) AS n, round(avg(ratio), 6) AS mean, round(stddev_pop(ratio), 6) AS sd, round(quantile_cont(ratio, 0.5), 6) AS q50, round(quantile_cont(ratio, 0.9), 6) AS q90, round(quantile_cont(ratio, 0.95), 6) AS q95, round(quantile_cont(ratio, 0.99), 6) AS q99 FROM nulls")
def null_summary(spark, d):
    return rounded(stats.null_summary(kp_null(spark, d)), "mean", "sd", "q50", "q90", "q95", "q99")


@query(f"""WITH {NULL_SQL}, e AS (SELECT min(ratio) AS lo, max(ratio) AS hi FROM nulls), c AS (SELECT least(59, floor((ratio - lo) / (hi - lo) * 60)) AS bin, count(*) AS n FROM nulls, e GROUP BY 1)
SELECT CAST(x AS BIGINT) AS bin, coalesce(n, 0) AS n FROM range(60) t(x) LEFT JOIN c ON bin = x""")
def null_histogram(spark, d):
    return stats.null_histogram(kp_null(spark, d))


@query(f"WITH {NULL_SQL} SELECT round((1 + count(*) FILTER (ratio >= 1.0)) / {ITER + 1}.0, 6) AS p FROM nulls")
def permutation_p(spark, d):
    return rounded(stats.p_value(kp_null(spark, d), 1.0, ITER), "p")


LONG_NULL_SQL = NULL_SQL.replace(f"range({ITER}) t(i)", f"range({K.ITERATIONS}) t(i)")


@query(f"WITH {LONG_NULL_SQL} SELECT iter, round(ratio, 6) AS ratio FROM nulls")
def registered_null_distribution(spark, d):
    return rounded(kp_null(spark, d, K.ITERATIONS), "ratio")


@query(f"WITH {LONG_NULL_SQL} SELECT count(ratio) AS n, round(avg(ratio), 6) AS mean, round(stddev_pop(ratio), 6) AS sd, round(quantile_cont(ratio, 0.5), 6) AS q50, round(quantile_cont(ratio, 0.9), 6) AS q90, round(quantile_cont(ratio, 0.95), 6) AS q95, round(quantile_cont(ratio, 0.99), 6) AS q99 FROM nulls")
def registered_null_summary(spark, d):
    return rounded(stats.null_summary(kp_null(spark, d, K.ITERATIONS)), "mean", "sd", "q50", "q90", "q95", "q99")


@query(f"""WITH {LONG_NULL_SQL}, e AS (SELECT min(ratio) AS lo, max(ratio) AS hi FROM nulls), c AS (SELECT least(59, floor((ratio - lo) / (hi - lo) * 60)) AS bin, count(*) AS n FROM nulls, e GROUP BY 1)
SELECT CAST(x AS BIGINT) AS bin, coalesce(n, 0) AS n FROM range(60) t(x) LEFT JOIN c ON bin = x""")
def registered_null_histogram(spark, d):
    return stats.null_histogram(H.written(kp_null(spark, d, K.ITERATIONS), "null"))


@query(f"WITH {LONG_NULL_SQL} SELECT round((1 + count(*) FILTER (ratio >= 1.0)) / {K.ITERATIONS + 1}.0, 6) AS p FROM nulls")
def registered_permutation_p(spark, d):
    return rounded(stats.p_value(kp_null(spark, d, K.ITERATIONS), 1.0, K.ITERATIONS), "p")


BH_SQL = """WITH t AS (SELECT p_partkey AS test_id, ((p_partkey * 7919) % 1000 + 1) / 1001.0 AS p FROM part), r AS (SELECT *, row_number() OVER (ORDER BY p, test_id) AS k, count(*) OVER () AS m FROM t),
a AS (SELECT *, least(1.0, min(p * m / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM r) SELECT test_id, round(p, 6) AS p, round(q, 6) AS p_adjusted, q <= 0.3 AS rejected FROM a"""


@query(BH_SQL)
def bh_adjusted(spark, d):
    """Every part is a test, in a family of their count."""
    t = spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey as test_id", "((p_partkey * 7919) % 1000 + 1) / 1001.0D as p")
    return rounded(stats.benjamini_hochberg(t, 0.3), "p", "p_adjusted")


@query(BH_SQL)
def bh_adjusted_all(spark, d):
    return bh_adjusted(spark, d)


# ------------------------------------------------------------------ the registered tests, over the span there is

def lag_tests_sql(name: str, targets: str, trig: str, lags: list[tuple[int, int]]) -> str:
    rows = [
        f"""SELECT '{name}/{a}-{b}h' AS test_id, count(*) AS triggers, CAST(coalesce(sum(o), 0) AS BIGINT) AS observed, round(coalesce(sum(e), 0), 6) AS expected, round(CASE WHEN sum(e) > 0 THEN sum(o) / sum(e) END, 6) AS ratio
        FROM (SELECT (SELECT count(*) FROM targets WHERE p >= t + {a * HOUR} AND p < t + {b * HOUR}) AS o, {b - a} * coalesce({rate_sql('t')}, 0) AS e FROM {trig})"""
        for a, b in lags
    ]
    return " UNION ALL ".join(rows)


TARGETS = f", targets AS (SELECT time_ms AS p FROM independent WHERE time_ms BETWEEN {START_MS} AND {END_MS})"


def parameters(h: str, **more) -> H.Parameters:
    return H.Parameters.of(**({"hypothesis": h, "start_ms": START_MS, "end_ms": END_MS, "half_ms": HALF} | more))


@query(gk_sql() + TARGETS + f", {GRID_SQL}, {episodes_sql('k', 'kp >= 6', 1)}, {episodes_sql('s', 'dst <= -100', 1)}, kt AS (SELECT onset_ms AS t FROM k), st AS (SELECT onset_ms AS t FROM s) " + lag_tests_sql("H4c/kp>=6", "", "kt", K.LAGS["H4c"]) + " UNION ALL " + lag_tests_sql("H4c/dst<=-100", "", "st", K.LAGS["H4c"]))
def h4c_tests(spark, d):
    return rounded(H.h4c(X.quakes(spark, d), X.series(spark, d), parameters("H4c"), with_null=False), "expected", "ratio")


@query(gk_sql() + TARGETS + f", {GRID_SQL}, {episodes_sql('k', 'wind_speed >= 500', 6)}, kt AS (SELECT onset_ms AS t FROM k) " + lag_tests_sql("H3b/wind>=500", "", "kt", K.LAGS["H3b"]))
def h3b_tests(spark, d):
    return rounded(H.h3b(X.quakes(spark, d), X.series(spark, d), parameters("H3b"), with_null=False), "expected", "ratio")


@query(gk_sql(more=f", {FLARES_SQL}") + TARGETS + f", ft AS (SELECT peak_ms AS t FROM flares WHERE (flare_class = 'X' OR (flare_class = 'M' AND magnitude >= 1.0)) AND peak_ms >= {START_MS} AND peak_ms < {END_MS}) " + lag_tests_sql("H1b/flare>=M1.0", "", "ft", K.LAGS["H1b"]))
def h1b_tests(spark, d):
    big_flares = X.flares(spark, d).where(scan.flare_at_least(F.col("flare_class"), F.col("magnitude"), "M"))
    return rounded(H.h1b(X.quakes(spark, d), big_flares, parameters("H1b"), with_null=False), "expected", "ratio")


@query(gk_sql(more=f", {CMES_SQL}") + f", tq AS (SELECT * FROM independent WHERE time_ms BETWEEN {START_MS} AND {END_MS}) " + " UNION ALL ".join(
    f"""SELECT 'H2b/direct-impact/{a}-{b}h' AS test_id, count(*) FILTER (near) AS near, count(*) FILTER (NOT near) AS far, round(count(*) FILTER (near) / count(*) FILTER (NOT near), 6) AS ratio FROM (
        SELECT abs(((longitude - {subsolar_sql('c.time_ms')} + 180.0) % 360.0 + 360.0) % 360.0 - 180.0) <= 90 AS near FROM cmes c JOIN tq q ON q.time_ms >= c.time_ms + {a * HOUR} AND q.time_ms < c.time_ms + {b * HOUR} WHERE NOT glancing AND NOT minor)"""
    for a, b in K.LAGS["H2b"]))
def h2b_tests(spark, d):
    direct = X.cmes(spark, d).where(scan.is_direct(F.col("glancing"), F.col("minor"))).select("time_ms")
    return rounded(H.h2b(X.quakes(spark, d), direct, parameters("H2b"), with_null=False), "ratio")


@query()
def h4c_with_null(spark, d):
    """With permutation p-values, adjusted within the run and over the matrix."""
    return H.h4c(X.quakes(spark, d), X.series(spark, d), parameters("H4c", mode="numpy"))


@query()
def h3b_with_null(spark, d):
    return H.h3b(X.quakes(spark, d), X.series(spark, d), parameters("H3b", mode="numpy"))


@query()
def h1b_with_null(spark, d):
    big_flares = X.flares(spark, d).where(scan.flare_at_least(F.col("flare_class"), F.col("magnitude"), "M"))
    return H.h1b(X.quakes(spark, d), big_flares, parameters("H1b", mode="numpy", short="none"))


@query()
def h2b_with_null(spark, d):
    direct = X.cmes(spark, d).where(scan.is_direct(F.col("glancing"), F.col("minor"))).select("time_ms")
    return H.h2b(X.quakes(spark, d), direct, parameters("H2b", mode="numpy", short="none"))


def lag_null_sql(h: str, name: str, k: str, pool: str, hits: str, trig: str | None) -> tuple[str, str]:
    """CTEs of one series' tests with hash-drawn nulls, and the select of their rows. hits: idx of triggers; trig: their times, where those are not hours."""
    lags, seed, n = K.LAGS[h], K.SEEDS[h], K.ITERATIONS
    o = lambda t, a, b: f"(SELECT count(*) FROM targets WHERE p >= {t} + {a * HOUR} AND p < {t} + {b * HOUR})"
    columns = lambda t: ", ".join(f"{o(t, a, b)} AS o{j}, {b - a} * r AS e{j}" for j, (a, b) in enumerate(lags))
    seen = f"SELECT {columns('t')} FROM (SELECT t, coalesce({rate_sql('t')}, 0) AS r FROM {trig})" if trig else f"SELECT h{k}.* FROM h{k} JOIN {hits} USING (idx)"
    ctes = f"""h{k} AS MATERIALIZED (SELECT idx, {columns('time_ms')} FROM (SELECT idx, time_ms, coalesce({rate_sql('time_ms')}, 0) AS r FROM {pool})),
    seen{k} AS MATERIALIZED ({seen}), d{k} AS (SELECT i, h.*, row_number() OVER (PARTITION BY i ORDER BY md5('{seed}:' || i || ':' || idx), idx) AS rk FROM h{k} h, range({n}) t(i)),
    n{k} AS MATERIALIZED (SELECT i, {", ".join(f"CASE WHEN sum(e{j}) > 0 THEN sum(o{j}) / sum(e{j}) END AS x{j}" for j in range(len(lags)))} FROM d{k} WHERE rk <= (SELECT count(*) FROM seen{k}) GROUP BY 1)"""
    value = "coalesce(x{j}, 0)" if h == "H1b" else "x{j}"
    rows = " UNION ALL ".join(
        f"""SELECT '{h}/{name}/{a}-{b}h' AS test_id, s.*, (1 + (SELECT count(*) FROM n{k} WHERE {value.format(j=j)} >= coalesce(s.ratio, 0))) / {n + 1}.0 AS p
        FROM (SELECT count(*) AS triggers, CAST(coalesce(sum(o{j}), 0) AS BIGINT) AS observed, coalesce(sum(e{j}), 0) AS expected, CASE WHEN sum(e{j}) > 0 THEN sum(o{j}) / sum(e{j}) END AS ratio FROM seen{k}) s"""
        for j, (a, b) in enumerate(lags)
    )
    return ctes, rows


def matrix_sql(ctes: list[str], rows: list[str]) -> str:
    ranked = "ranked AS (SELECT *, row_number() OVER (ORDER BY p, test_id) AS k, count(*) OVER () AS m FROM tests)"
    least = lambda m: f"least(1.0, min(p * {m} / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
    return (
        ", ".join(ctes) + ", tests AS (" + " UNION ALL ".join(rows) + f"), {ranked}, both_ AS (SELECT *, {least('m')} AS p_run FROM ranked)"
        + f" SELECT test_id, triggers, observed, round(expected, 6) AS expected, round(ratio, 6) AS ratio, round(p, 6) AS p, round(p_run, 6) AS p_run, round(p_adj, 6) AS p_matrix, p_adj <= {K.FALSE_DISCOVERY_RATE} AS rejected FROM (SELECT *, {least(str(K.MATRIX_SIZE))} AS p_adj FROM ranked JOIN (SELECT test_id, p_run FROM both_) USING (test_id))"
    )


def null_rounded(df):
    return rounded(df, "expected", "ratio", "p", "p_run", "p_matrix")


_KP, _DST = lag_null_sql("H4c", "kp>=6", "1", "(SELECT * FROM grid WHERE kp IS NOT NULL)", "k1", None), lag_null_sql("H4c", "dst<=-100", "2", "(SELECT * FROM grid WHERE dst IS NOT NULL)", "k2", None)


@query(gk_sql() + TARGETS + f", {GRID_SQL}, {episodes_sql('k', 'kp >= 6', 1)}, {episodes_sql('s', 'dst <= -100', 1)}, k1 AS (SELECT (onset_ms - {START_MS}) // {HOUR} AS idx FROM k), k2 AS (SELECT (onset_ms - {START_MS}) // {HOUR} AS idx FROM s), " + matrix_sql([_KP[0], _DST[0]], [_KP[1], _DST[1]]))
def h4c_hash_null(spark, d):
    """The whole run with draws that SQL can make too."""
    return null_rounded(H.h4c(X.quakes(spark, d), X.series(spark, d), parameters("H4c")))


_WIND = lag_null_sql("H3b", "wind>=500", "1", "(SELECT * FROM (SELECT *, count(wind_speed) OVER (ORDER BY idx ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS c FROM grid) WHERE c = 6)", "k1", None)


@query(gk_sql() + TARGETS + f", {GRID_SQL}, {episodes_sql('k', 'wind_speed >= 500', 6)}, k1 AS (SELECT (onset_ms - {START_MS}) // {HOUR} AS idx FROM k), " + matrix_sql([_WIND[0]], [_WIND[1]]))
def h3b_hash_null(spark, d):
    return null_rounded(H.h3b(X.quakes(spark, d), X.series(spark, d), parameters("H3b")))


_FLARE = lag_null_sql("H1b", "flare>=M1.0", "1", f"(SELECT i AS idx, {START_MS} + i * {HOUR} AS time_ms FROM range(719) t(i))", "", "ft")


@query(gk_sql(more=f", {FLARES_SQL}") + TARGETS + f", ft AS MATERIALIZED (SELECT peak_ms AS t FROM flares WHERE (flare_class = 'X' OR (flare_class = 'M' AND magnitude >= 1.0)) AND peak_ms >= {START_MS} AND peak_ms < {END_MS}), " + matrix_sql([_FLARE[0]], [_FLARE[1]]))
def h1b_hash_null(spark, d):
    big_flares = X.flares(spark, d).where(scan.flare_at_least(F.col("flare_class"), F.col("magnitude"), "M"))
    return null_rounded(H.h1b(X.quakes(spark, d), big_flares, parameters("H1b", short="every")))


@query()
def h5_test(spark, d):
    return rounded(H.h5(X.quakes(spark, d), parameters("H5", mode="numpy", short="none")), "d_plus", "two_sided")


# ------------------------------------------------------------------ encodings

@query(f"WITH {QUAKES_SQL} SELECT CASE WHEN depth_km IS NULL THEN -1 WHEN depth_km >= 500 THEN 4 WHEN depth_km >= 300 THEN 3 WHEN depth_km >= 70 THEN 2 WHEN depth_km >= 20 THEN 1 ELSE 0 END AS depth_bin, count(*) AS n FROM quakes GROUP BY 1")
def depth_class_hist(spark, d):
    bins = F.lit(0)
    for k, low in enumerate(K.DEPTH_BINS_KM):
        bins = F.when(F.col("depth_km") >= low, F.lit(k)).otherwise(bins)
    return X.quakes(spark, d).groupBy(F.when(F.col("depth_km").isNull(), F.lit(-1)).otherwise(bins).alias("depth_bin")).agg(F.count("*").alias("n"))


@query(f"""WITH {SERIES_SQL}, x AS (SELECT time_ms, dst / 20 AS bz, greatest(1.6726e-6 * kp * wind_speed * wind_speed, 0.01) AS p FROM series WHERE kp IS NOT NULL AND dst IS NOT NULL AND wind_speed IS NOT NULL),
y AS (SELECT *, (10.22 + 1.29 * tanh(0.184 * (bz + 8.14))) * pow(p, -1 / 6.6) AS r FROM x)
SELECT time_ms, round(r, 6) AS standoff_re, round((0.58 - 0.007 * bz) * (1 + 0.024 * ln(p)), 6) AS flaring, r < 6.6 AS inside_geosynchronous FROM y""")
def magnetopause(spark, d):
    x = X.series(spark, d).where("kp is not null and dst is not null and wind_speed is not null")
    m = x.select("time_ms", space.magnetopause(F.col("dst") / 20, space.dynamic_pressure(F.col("kp"), F.col("wind_speed"))).alias("m"))
    return rounded(m.select("time_ms", "m.standoff_re", "m.flaring", "m.inside_geosynchronous"), "standoff_re", "flaring")
