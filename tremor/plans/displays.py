"""Queries of what displays show, of feeds' grids and of ledgers, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremor import constants as K
from tremor.functions import geo, space
from tremor.functions import views as V
from tremor.operators import match as M
from tremor.operators import scan
from tremor.operators import sequences as Q
from tremor.operators import upsert as U
from tremor.plans.catalogue import DAY, HOUR, NEAREST_SQL, NOW, SHOCK_SQL, hav, query, rounded
from tremor.sources import feeds
from tremor.sources import fixtures as X
from tremor.sources.fixtures import CMES_SQL, FLARES_SQL, LEDGER_SQL, QUAKES_SQL, SERIES_SQL, START_MS


def fixed_sql(x: str, digits: int) -> str:
    n = f"CAST(floor(({x}) * {10**digits} + 0.5) AS BIGINT)"
    return f"CAST({n} // {10**digits} AS VARCHAR)" + (f" || '.' || lpad(CAST({n} % {10**digits} AS VARCHAR), {digits}, '0')" if digits else "")


SPAN_FROM, SPAN_TO, YEAR_NOW = 694_224_000_000, 962_409_600_000, 912_470_400_000  # 1992, mid 2000, end of 1998


@query(f"""WITH {LEDGER_SQL}, done AS (SELECT DISTINCT year FROM ledger WHERE min_magnitude <= 4.5), y AS (SELECT CAST(i AS INTEGER) AS year, epoch_ms(make_timestamp(i, 1, 1, 0, 0, 0)) AS a, epoch_ms(make_timestamp(i + 1, 1, 1, 0, 0, 0)) - 1 AS b FROM range(1992, 2001) t(i))
SELECT year FROM y WHERE year NOT IN (SELECT year FROM done) AND NOT (year = 1998 AND (SELECT count(*) FROM done) > 0)
    AND NOT (greatest(a, {SPAN_FROM}) >= {YEAR_NOW - 720 * HOUR} AND least(b, {SPAN_TO}) <= {YEAR_NOW})""")
def uncovered_years(spark, d):
    return scan.uncovered_years(X.ledger(spark, d), SPAN_FROM, SPAN_TO, YEAR_NOW)


@query(f"WITH {NEAREST_SQL} SELECT pair, count(*) AS n FROM near GROUP BY 1 ORDER BY n DESC, pair LIMIT 4")
def boundary_top_shares(spark, d):
    """The four boundaries with most events: the report's own limit."""
    return M.breakdown(X.quakes(spark, d), M.segments(X.lines(spark)), X.lines(spark)).limit(4).select("pair", "n")


@query(f"""WITH {QUAKES_SQL} SELECT event_id, CASE WHEN depth_km IS NULL THEN NULL WHEN depth_km < 70 THEN 'shallow' WHEN depth_km < 300 THEN 'intermediate' ELSE 'deep' END AS depth_class,
    round(5 + (least(8.0, greatest(1.0, magnitude)) - 1) / 7 * 17, 6) AS pixels, round(13 + (least(8.0, greatest(1.0, magnitude)) - 1) / 7 * 17, 6) AS ring_pixels, round(3 + least(9.5, greatest(0.0, magnitude)) / 9.5 * 6, 6) AS dot_pixels,
    magnitude >= 5.5 AS emphasized, {NOW} - time_ms <= 24 * {HOUR} AS recent, magnitude >= 5.0 AS has_sequence, magnitude >= 6.0 AS has_antipode, CASE WHEN magnitude >= 7.5 THEN 1900 ELSE 1970 END AS complete_since FROM quakes""")
def event_encodings(spark, d):
    m = F.col("magnitude")
    size = V.pixels(m, "magnitude")
    out = X.quakes(spark, d).select(
        "event_id", V.depth_class(F.col("depth_km")).alias("depth_class"), size.alias("pixels"), (size + 2 * V.RING_GAP_PIXELS).alias("ring_pixels"), V.pixels(m, "dot").alias("dot_pixels"), V.is_emphasized(m).alias("emphasized"),
        V.is_recent(F.col("time_ms"), NOW).alias("recent"), (m >= V.SEQUENCE_MAGNITUDE).alias("has_sequence"), (m >= V.ANTIPODAL_MAGNITUDE).alias("has_antipode"), V.complete_since(m).alias("complete_since"),
    )
    return rounded(out, "pixels", "ring_pixels", "dot_pixels")


@query(f"WITH {FLARES_SQL} SELECT id, round(CASE WHEN flare_class = 'X' THEN 14 ELSE 8 END + least(10.0, greatest(0.0, magnitude)) * 0.4, 6) AS pixels FROM flares")
def flare_markers(spark, d):
    return rounded(X.flares(spark, d).select("id", V.flare_pixels(F.col("flare_class"), F.col("magnitude")).alias("pixels")), "pixels")


@query(f"WITH {SERIES_SQL} SELECT time_ms, round(8 + least(9.0, greatest(0.0, coalesce(kp, 0.0))) / 9 * 8, 6) AS pixels FROM series")
def arrival_markers(spark, d):
    return rounded(X.series(spark, d).select("time_ms", V.pixels(F.col("kp"), "kp").alias("pixels")), "pixels")


FLUX_SQL = "(value * value * 1.25e-9 - 1e-9)"


@query(f"""SELECT event_id, CASE WHEN f IS NULL OR f <= 0 THEN '—' WHEN f >= 1e-4 THEN 'X' || {fixed_sql('f / 1e-4', 1)} WHEN f >= 1e-5 THEN 'M' || {fixed_sql('f / 1e-5', 1)} WHEN f >= 1e-6 THEN 'C' || {fixed_sql('f / 1e-6', 1)}
    WHEN f >= 1e-7 THEN 'B' || {fixed_sql('f / 1e-7', 1)} WHEN f >= 1e-8 THEN 'A' || {fixed_sql('f / 1e-8', 1)} ELSE '<A' || {fixed_sql('f / 1e-8', 1)} END AS label FROM (SELECT event_id, {FLUX_SQL} AS f FROM events)""")
def flux_labels(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", V.flux_label(F.col("value") * F.col("value") * F.lit(1.25e-9) - F.lit(1e-9)).alias("label"))


HOURS_SQL, RATE_SQL = "(value * value / 7 - 0.01)", "(value / 37)"


@query(f"""SELECT event_id, CASE WHEN h < 0 THEN 'unknown' WHEN h < 1 THEN {fixed_sql('h * 60', 0)} || ' min' WHEN h < 48 THEN {fixed_sql('h', 0)} || ' h' WHEN h / 24 < 60 THEN {fixed_sql('h / 24', 0)} || ' d'
    WHEN h / 24 / 30.44::DOUBLE < 24 THEN {fixed_sql('h / 24 / 30.44::DOUBLE', 0)} || ' mo' ELSE {fixed_sql('h / 24 / 365.25::DOUBLE', 1)} || ' y' END AS elapsed,
    CASE WHEN r = 0 THEN '0/day' WHEN r >= 10 THEN {fixed_sql('r', 0)} || '/day' WHEN r >= 1 THEN {fixed_sql('r', 1)} || '/day' WHEN r >= 0.1 THEN {fixed_sql('r', 2)} || '/day' ELSE {fixed_sql('r * 30.44::DOUBLE', 1)} || '/mo' END AS rate
    FROM (SELECT event_id, {HOURS_SQL} AS h, {RATE_SQL} AS r FROM events)""")
def span_labels(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", V.elapsed_label(F.col("value") * F.col("value") / 7 - F.lit(0.01)).alias("elapsed"), V.rate_label(F.col("value") / 37).alias("rate"))


@query(f"""WITH {QUAKES_SQL} SELECT event_id, round((longitude + 90 + 360) % 360, 6) AS dip, round(sin(radians(longitude)), 6) AS east, round(cos(radians(longitude)), 6) AS north,
    round((latitude * 7 + 180 + 3600) % 360 - 180, 6) AS wrapped, round(2.0 / 3 * (log10(pow(10.0, 1.5 * magnitude + 16.1)) - 16.1), 6) AS moment_magnitude FROM quakes""")
def directions(spark, d):
    """Compass directions, wrapping and moment magnitude of every event; its longitude stands for a strike."""
    q = X.quakes(spark, d)
    east, north = V.unit_vector(F.col("longitude"))
    moment = F.pow(F.lit(10.0), 1.5 * F.col("magnitude") + 16.1)
    out = q.select("event_id", V.dip_azimuth(F.col("longitude")).alias("dip"), east.alias("east"), north.alias("north"), geo.wrap_half_open(F.col("latitude") * 7).alias("wrapped"), feeds.moment_magnitude(moment).alias("moment_magnitude"))
    return rounded(out, "dip", "east", "north", "wrapped", "moment_magnitude")


@query(f"""WITH {QUAKES_SQL}, w AS (SELECT *, {hav('latitude', 'longitude', '10.0', '40.0')} / 6371.0 AS w FROM quakes),
v AS (SELECT event_id, sin(0.75 * w) / sin(w) AS p, sin(0.25 * w) / sin(w) AS q, radians(latitude) AS a, radians(longitude) AS b, radians(10.0) AS c, radians(40.0) AS d FROM w WHERE w > 0.001),
x AS (SELECT event_id, p * cos(a) * cos(b) + q * cos(c) * cos(d) AS x, p * cos(a) * sin(b) + q * cos(c) * sin(d) AS y, p * sin(a) + q * sin(c) AS z FROM v)
SELECT event_id, round(degrees(atan2(z, sqrt(x * x + y * y))), 6) AS latitude, round(degrees(atan2(y, x)), 6) AS longitude FROM x""")
def great_circle_step(spark, d):
    """A quarter of the way from every event to one place."""
    q = X.quakes(spark, d).where(geo.haversine_km("latitude", "longitude", 10.0, 40.0) / K.EARTH_RADIUS_KM > 0.001)
    lat, lon = geo.great_circle("latitude", "longitude", 10.0, 40.0, 0.25)
    return rounded(q.select("event_id", lat.alias("lat"), lon.alias("lon")).withColumnsRenamed({"lat": "latitude", "lon": "longitude"}), "latitude", "longitude")


WINDOW_ROWS = "(24, 1.0), (48, 1.0), (72, 1.0), (168, 1.0), (720, 2.5), (8766, 4.5), (87660, 5.5), (1139580, 5.5)"


@query(f"""WITH {QUAKES_SQL}, w(hours, least) AS (VALUES {WINDOW_ROWS}), f(m) AS (VALUES (1.0), (2.5), (4.5), (5.5), (6.0), (7.0)), x AS (
SELECT CAST(hours AS BIGINT) AS hours, CAST(least AS DOUBLE) AS least_magnitude, (SELECT CAST(max(x.hours) AS BIGINT) FROM w x WHERE x.hours < w.hours) AS previous, (SELECT CAST(min(m) AS DOUBLE) FROM f WHERE m > least) AS next_floor, (SELECT count(*) FROM f WHERE m >= least) AS floors,
    CAST({NOW} - CAST(coalesce((SELECT max(x.hours) FROM w x WHERE x.hours < w.hours), hours) AS BIGINT) * {HOUR} AS BIGINT) AS trail_start_ms FROM w)
SELECT x.*, count(*) FILTER (time_ms BETWEEN {NOW} - x.hours * {HOUR} AND {NOW}) AS shown, count(*) FILTER (time_ms BETWEEN trail_start_ms AND {NOW}) AS trailed FROM x JOIN quakes ON magnitude >= least_magnitude GROUP BY ALL""")
def display_windows(spark, d):
    """Every offered window: what it holds, the one before it, the floors that make sense in it, where its trail starts, and the events that it and its trail show."""
    w = spark.createDataFrame(V.windows(), "hours long, held double")
    start, _ = V.display_window(F.col("hours"), F.lit(None).cast("long"), F.lit(True), F.lit(NOW))
    least = V.least_magnitude(F.col("hours"))
    floors = F.size(F.filter(F.array(*[F.lit(m) for m in V.FLOORS]), lambda m: m >= least)).cast("long")
    w = w.select("hours", least.alias("least_magnitude"), V.previous_window(F.col("hours")).cast("long").alias("previous"), V.next_floor(least).alias("next_floor"), floors.alias("floors"), start.cast("long").alias("trail_start_ms"))
    each = X.quakes(spark, d).where(F.col("time_ms") <= NOW).join(F.broadcast(w), F.col("magnitude") >= F.col("least_magnitude"))  # eight windows
    return each.groupBy(*w.columns).agg(F.count_if(F.col("time_ms") >= NOW - F.col("hours") * HOUR).alias("shown"), F.count_if(F.col("time_ms") >= F.col("trail_start_ms")).alias("trailed"))


@query(f"""WITH {QUAKES_SQL}, w(hours, least) AS (VALUES (24, 1.0), (48, 1.0), (72, 1.0), (168, 1.0), (720, 2.5)), p AS (SELECT CAST(least AS DOUBLE) AS min_magnitude, CAST(max(hours) AS BIGINT) AS window_hours FROM w GROUP BY 1)
SELECT p.*, count(*) AS fetched, round(max(magnitude), 6) AS largest FROM p JOIN quakes ON magnitude >= min_magnitude AND time_ms >= {NOW} - window_hours * {HOUR} AND time_ms <= {NOW} GROUP BY ALL""")
def ingest_passes(spark, d):
    """The fewest fetches that cover all live windows, the longest of each floor, with the events that each brings."""
    p = spark.createDataFrame(V.WINDOWS, "hours long, min_magnitude double").groupBy("min_magnitude").agg(F.max("hours").alias("window_hours"))
    hit = X.quakes(spark, d).join(F.broadcast(p), (F.col("magnitude") >= F.col("min_magnitude")) & (F.col("time_ms") >= NOW - F.col("window_hours") * HOUR) & (F.col("time_ms") <= NOW))
    return hit.groupBy("min_magnitude", "window_hours").agg(F.count("*").alias("fetched"), F.round(F.max("magnitude"), 6).alias("largest"))


@query(f"WITH {SERIES_SQL} SELECT time_ms, {NOW} - time_ms > 20 * 60000 AS aurora_stale, {NOW} - time_ms > 90 * 60000 AS tec_stale, time_ms >= {NOW} - 72 * {HOUR} AND time_ms < {NOW} AS in_range FROM series")
def freshness(spark, d):
    t = F.col("time_ms")
    return X.series(spark, d).select("time_ms", V.is_stale(t, NOW, V.AURORA_STALE_MINUTES).alias("aurora_stale"), V.is_stale(t, NOW, V.TEC_STALE_MINUTES).alias("tec_stale"), ((t >= NOW - 72 * HOUR) & (t < NOW)).alias("in_range"))


# ------------------------------------------------------------------ grids and stations

POINTS_SQL = "points AS (SELECT event_id AS seq, ((user_id * 97) % 359 - 179) + 0.5 AS longitude, ((user_id * 37) % 179 - 89) + 0.25 AS latitude, value FROM events)"


def points(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.selectExpr("event_id as seq", "((user_id * 97) % 359 - 179) + 0.5D as longitude", "((user_id * 37) % 179 - 89) + 0.25D as latitude", "value")


TEC_SQL = f"{POINTS_SQL}, cells AS (SELECT CAST(floor((90 - latitude) / 2.5) AS BIGINT) AS row, CAST(floor((longitude + 180) / 5) AS BIGINT) AS col, arg_max(value, seq) AS value FROM points GROUP BY 1, 2)"


@query(f"WITH {TEC_SQL} SELECT row, col, round(value, 6) AS value FROM cells WHERE row BETWEEN 0 AND 71 AND col BETWEEN 0 AND 71")
def tec_grid(spark, d):
    return rounded(feeds.tec_cells(points(spark, d)), "value")


@query(f"WITH {TEC_SQL} SELECT round(max(value), 6) AS peak FROM cells WHERE row BETWEEN 0 AND 71 AND col BETWEEN 0 AND 71")
def tec_peak(spark, d):
    """The highest value of a grid; null where nothing was measured."""
    return rounded(feeds.tec_cells(points(spark, d)).agg(F.max("value").alias("peak")), "peak")


AURORA_SQL = "seen AS (SELECT (event_id * 7919) % 360 AS longitude, (event_id * 104729) % 181 - 90 AS latitude, max(value) - 20.5 AS value FROM events GROUP BY 1, 2), pts AS (SELECT i AS longitude, j - 90 AS latitude, coalesce(s.value, 0) AS value FROM range(360) a(i) CROSS JOIN range(181) b(j) LEFT JOIN seen s ON s.longitude = i AND s.latitude = j - 90)"


def aurora_points(spark, d):
    """A whole grid: the strongest event of each cell, 0 where there is none."""
    seen = spark.read.parquet(f"{d}/events.parquet").selectExpr("(event_id * 7919) % 360 as longitude", "(event_id * 104729) % 181 - 90 as latitude", "value").groupBy("longitude", "latitude").agg((F.max("value") - 20.5).alias("value"))
    cells = spark.range(360 * 181).selectExpr("id % 360 as longitude", "id div 360 - 90 as latitude")
    return cells.join(seen, ["longitude", "latitude"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


@query(f"WITH {AURORA_SQL} SELECT CAST(90 - latitude AS INTEGER) AS row, CAST((longitude + 180) % 360 AS INTEGER) AS col, CAST(greatest(0, least(255, floor(value + 0.5))) AS INTEGER) AS value FROM pts")
def aurora_grid(spark, d):
    return feeds.aurora_grid(aurora_points(spark, d))


@query(f"WITH {AURORA_SQL} SELECT greatest(0, max(CAST(greatest(0, least(255, floor(value + 0.5))) AS INTEGER))) AS peak FROM pts")
def aurora_peak(spark, d):
    """The strongest value of a grid, 0 where there is none."""
    return feeds.aurora_grid(aurora_points(spark, d)).agg(F.greatest(F.lit(0), F.coalesce(F.max("value"), F.lit(0))).alias("peak"))


@query("""WITH r AS (SELECT user_id % 50 AS station, value FROM events WHERE event_type = 'view'), s AS (SELECT DISTINCT user_id % 60 AS station FROM events),
x AS (SELECT station, max(value) - min(value) AS range_nt, count(*) AS n FROM r GROUP BY 1 HAVING count(*) >= 2) SELECT station, round(range_nt, 6) AS range_nt, n FROM s LEFT JOIN x USING (station)""")
def station_disturbances(spark, d):
    """Every station with how far its readings go apart; null where fewer than two were read."""
    e = spark.read.parquet(f"{d}/events.parquet")
    readings = e.where("event_type = 'view'").selectExpr("user_id % 50 as station", "unix_micros(cast(ts as timestamp)) div 1000 as time_ms", "value")
    known = e.selectExpr("user_id % 60 as station").distinct()
    return rounded(known.join(feeds.disturbances(readings), "station", "left").select("station", "range_nt", "n"), "range_nt")


@query(f"""WITH {QUAKES_SQL}, c AS (SELECT source, time_ms // {DAY} AS day, count(*) AS n FROM quakes GROUP BY 1, 2), b AS (SELECT *, max(n) OVER (PARTITION BY source) AS most FROM c)
SELECT source, day, n, round(greatest(4.0, n / most * 100), 6) AS height FROM b""")
def bar_heights(spark, d):
    """Events by source and day, as percent of the source's busiest day."""
    from pyspark.sql import Window

    c = X.quakes(spark, d).groupBy("source", F.expr(f"time_ms div {DAY}").alias("day")).agg(F.count("*").alias("n"))
    return rounded(c.withColumn("height", V.bar_height(F.col("n"), F.max("n").over(Window.partitionBy("source")))), "height")


@query(f"WITH {QUAKES_SQL}, b AS (SELECT time_ms // {DAY} - {START_MS // DAY} AS day, count(*) AS n FROM quakes GROUP BY 1) SELECT CAST(day AS BIGINT) AS day, n FROM b ORDER BY abs(day + 0.5 - 0.4 * 30), day LIMIT 1")
def nearest_bar(spark, d):
    """The day whose middle is nearest to two fifths of the way: the first on ties."""
    b = X.quakes(spark, d).groupBy((F.expr(f"time_ms div {DAY}") - START_MS // DAY).alias("day")).agg(F.count("*").alias("n"))
    return b.agg(F.min_by(F.struct("day", "n"), F.struct(F.abs(F.col("day") + 0.5 - 0.4 * 30), "day")).alias("x")).select("x.day", "x.n")


# ------------------------------------------------------------------ ledgers, states, single events

@query(f"""WITH {LEDGER_SQL} SELECT year, CAST(min_magnitude AS DOUBLE) AS min_magnitude, CAST(event_count + 7 AS BIGINT) AS event_count FROM ledger WHERE year <= 1994 UNION ALL SELECT year, CAST(min_magnitude AS DOUBLE), CAST(event_count AS BIGINT) FROM ledger WHERE year > 1994 UNION ALL SELECT 1997, CAST(4.5 AS DOUBLE), 1""")
def record_chunks(spark, d):
    """Chunks done again replace their rows, a new one is added."""
    ledger = X.ledger(spark, d)
    again = ledger.where("year <= 1994").withColumn("event_count", F.col("event_count") + 7)
    new = spark.range(1).selectExpr("1997 as year", "4.5D as min_magnitude", "1L as event_count")
    return U.record_chunk(ledger, again.unionByName(new))


@query(f"WITH {QUAKES_SQL} SELECT CAST(max(time_ms) AS VARCHAR) AS value FROM quakes")
def seen_through(spark, d):
    """A watermark kept in the state table, moved forward and read back."""
    latest = X.quakes(spark, d).agg(F.max("time_ms")).first()[0]
    state = spark.createDataFrame([("seen_through", "0", 0), ("other", "x", 0)], "key string, value string, updated_ms long")
    return U.get_state(U.put_state(state, "seen_through", str(latest), NOW), "seen_through")


@query(f"WITH {SHOCK_SQL}, one AS (SELECT min(main_id) AS id FROM main) SELECT main_id, event_id, round(days, 6) AS elapsed_days FROM members JOIN one ON main_id = id")
def sequence_of_event(spark, d):
    """An event looked up by id, then its sequence."""
    q = X.quakes(spark, d)
    event = q.where("magnitude >= 6.5").agg(F.min("event_id")).first()[0]
    return rounded(Q.aftershocks(q, scan.event_by_id(q, event), NOW).select("main_id", "event_id", "elapsed_days"), "elapsed_days")


@query(f"WITH {CMES_SQL} SELECT count(*) AS n, min(time_ms) AS first_ms, max(time_ms) AS last_ms FROM cmes WHERE time_ms >= {START_MS + 3 * DAY} AND time_ms < {NOW}")
def arrivals_open_end(spark, d):
    """Bounds are optional: here only the start is given and the end is now."""
    c = scan.half_open(X.cmes(spark, d), START_MS + 3 * DAY, NOW)
    return scan.coverage(c)


@query(f"""WITH {QUAKES_SQL}, main AS (SELECT event_id AS main_id, time_ms AS t, -latitude AS la, CASE WHEN longitude >= 0 THEN longitude - 180 ELSE longitude + 180 END AS lo FROM quakes WHERE magnitude >= 6.0),
hit AS (SELECT main_id, event_id, {hav('la', 'lo', 'latitude', 'longitude')} AS km FROM main JOIN quakes ON time_ms BETWEEN t + 1 AND t + 72 * {HOUR} AND magnitude >= 5.0 WHERE {hav('la', 'lo', 'latitude', 'longitude')} <= 1000),
near AS (SELECT main_id, count(*) AS n, min(km) AS km, arg_min(event_id, (km, event_id)) AS id FROM hit GROUP BY 1)
SELECT main_id, coalesce(n, 0) AS n, id AS nearest_id, round(km, 6) AS nearest_km, round(greatest(0, least(1, ({START_MS + 20 * DAY} - t) / (72.0 * {HOUR}))), 6) AS elapsed_fraction FROM main LEFT JOIN near USING (main_id)""")
def antipodal_progress(spark, d):
    """Every large event's antipodal window as it stands on the twentieth day."""
    q = X.quakes(spark, d)
    main = q.where("magnitude >= 6.0")
    return rounded(Q.antipodal_progress(q, main, START_MS + 20 * DAY), "nearest_km", "elapsed_fraction")


@query(f"""WITH {SERIES_SQL}, x AS (SELECT time_ms, dst / 20 AS bz, greatest(1.6726e-6 * kp * wind_speed * wind_speed, 0.01) AS p FROM series WHERE kp IS NOT NULL AND dst IS NOT NULL AND wind_speed IS NOT NULL),
y AS (SELECT time_ms, (10.22 + 1.29 * tanh(0.184 * (bz + 8.14))) * pow(p, -1 / 6.6) AS r, (0.58 - 0.007 * bz) * (1 + 0.024 * ln(p)) AS a FROM x), z AS (SELECT *, unnest(range(61)) AS k FROM y)
SELECT time_ms, CAST(k AS INTEGER) AS step, round(radians(120) * k / 60, 6) AS theta, round(r * pow(2 / (1 + cos(radians(120) * k / 60)), a), 6) AS radius_re FROM z""")
def magnetopause_profiles(spark, d):
    """The boundary's outline in every hour that has what it needs."""
    x = X.series(spark, d).where("kp is not null and dst is not null and wind_speed is not null")
    m = x.select("time_ms", space.magnetopause(F.col("dst") / 20, space.dynamic_pressure(F.col("kp"), F.col("wind_speed"))).alias("m"))
    each = m.select("time_ms", F.explode(space.profile(F.col("m"))).alias("p"))
    return rounded(each.select("time_ms", "p.step", "p.theta", "p.radius_re"), "theta", "radius_re")
