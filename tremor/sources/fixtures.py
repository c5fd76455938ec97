"""The supplied `events` and `orders` tables seen as a catalogue, an hourly series and ledgers; each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

START_MS = 1_704_067_200_000  # 2024-01-01T00:00:00Z
END_MS = START_MS + 719 * 3_600_000

QUAKES_SQL = """quakes AS (
    SELECT event_id, epoch_us(ts) // 1000 AS time_ms, (45 + (CAST(round(value * 100) AS BIGINT) // 1150)) / 10.0 AS magnitude,
        ((user_id * 37) % 121 - 60) + ((event_id * 7) % 21 - 10) / 20.0 AS latitude,
        ((user_id * 97) % 359 - 179) + ((event_id * 13) % 21 - 10) / 20.0 AS longitude,
        CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_id % 600 END AS depth_km,
        CASE WHEN event_id % 5 = 0 THEN 'emsc' ELSE 'usgs' END AS source,
        epoch_us(ts) // 1000 + 300000 AS updated_ms
    FROM events)"""

SERIES_SQL = """series AS (
    SELECT epoch_us(date_trunc('hour', ts)) // 1000 AS time_ms, max(value) FILTER (event_type = 'view') / 40 AS kp,
        -max(value) FILTER (event_type = 'error') AS dst, 300 + 5 * max(value) FILTER (event_type = 'click') AS wind_speed
    FROM events GROUP BY 1)"""

LEDGER_SQL = """ledger AS (
    SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CASE WHEN year(o_orderdate) % 2 = 0 THEN 4.5 ELSE 5.5 END AS min_magnitude, count(*) AS event_count
    FROM orders WHERE year(o_orderdate) <> 1997 GROUP BY 1, 2)"""

FLARES_SQL = """flares AS (
    SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'goes' ELSE 'donki' END AS source, epoch_us(ts) // 1000 AS peak_ms,
        CASE WHEN value < 20 THEN 'B' WHEN value < 50 THEN 'C' WHEN value < 150 THEN 'M' ELSE 'X' END AS flare_class, round(value / 20, 1) AS magnitude
    FROM events WHERE event_type = 'purchase')"""

CMES_SQL = """cmes AS (
    SELECT event_id AS id, epoch_us(ts) // 1000 AS time_ms, event_id % 2 = 0 AS glancing, event_id % 3 = 0 AS minor FROM events WHERE event_type = 'signup')"""


TRACKS_SQL = """tracks AS (
    SELECT user_id, event_id, ((user_id * 37) % 121 - 60) + ((event_id * 7) % 21 - 10) / 20.0 AS latitude, ((user_id * 97) % 359 - 179) + ((event_id * 13) % 21 - 10) / 20.0 AS longitude FROM events)"""

TRENCH_SQL = """trench AS (
    SELECT event_id, 'S' || ((event_id // 400) % 7) AS slab, -50 + (event_id % 400) * 0.2 AS latitude, ((event_id // 400) * 37) % 300 - 160 + (event_id % 400) * 0.1 + ((event_id // 97) % 3) * 3.5 AS longitude, (event_id * 53) % 360 AS azimuth
    FROM events)"""

STEPS_SQL = """steps AS (
    SELECT event_id, 'B' || (event_id // 50) AS boundary, ['SUB', 'OCB', 'CCB', 'OSR', 'CRB', 'OTF', 'CTF'][(event_id // 6) % 7 + 1] AS cls, ((event_id * 7) % 1600) / 10.0 - 80 AS start_latitude, ((event_id * 11) % 3600) / 10.0 - 180 AS start_longitude,
        (((event_id + 1) * 7) % 1600) / 10.0 - 80 + CASE WHEN event_id % 11 = 0 THEN 0.01 WHEN event_id % 13 = 0 THEN 5e-7 ELSE 0 END AS end_latitude, (((event_id + 1) * 11) % 3600) / 10.0 - 180 AS end_longitude
    FROM events)"""


ARCHIVED_SQL = """archived AS (
    SELECT o_orderkey, epoch_ms(o_orderdate) AS time_ms, (40 + (o_orderkey * 37) % 45) / 10.0 AS magnitude, (o_orderkey * 7) % 1800 / 10.0 - 90 AS latitude, (o_custkey * 11) % 3600 / 10.0 - 180 AS longitude, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderkey % 600 END AS depth_km
    FROM orders)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def quakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quakes_of(_events(spark, sf_dir))


def quakes_of(events: DataFrame, *kept: str) -> DataFrame:
    """Events, in a table or a stream, as quakes."""
    return events.selectExpr(
        *kept,
        "event_id",
        "unix_micros(cast(ts as timestamp)) div 1000 as time_ms",
        "(45 + (cast(round(value * 100) as bigint) div 1150)) / 10.0D as magnitude",
        "((user_id * 37) % 121 - 60) + ((event_id * 7) % 21 - 10) / 20.0D as latitude",
        "((user_id * 97) % 359 - 179) + ((event_id * 13) % 21 - 10) / 20.0D as longitude",
        "case when event_id % 17 = 0 then null else event_id % 600 end as depth_km",
        "case when event_id % 5 = 0 then 'emsc' else 'usgs' end as source",
        "unix_micros(cast(ts as timestamp)) div 1000 + 300000 as updated_ms",
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy(_hour().alias("time_ms")).agg(*(f for f in _measures()))


def _hour():
    from pyspark.sql import functions as F

    return F.expr("unix_micros(cast(date_trunc('hour', ts) as timestamp)) div 1000")


def _measures():
    from pyspark.sql import functions as F

    return [F.expr("max(value) filter (where event_type = 'view') / 40").alias("kp"), F.expr("-max(value) filter (where event_type = 'error')").alias("dst"), F.expr("300 + 5 * max(value) filter (where event_type = 'click')").alias("wind_speed")]


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("year(o_orderdate) as year").where("year <> 1997")
    return o.groupBy("year").count().selectExpr("year", "case when year % 2 = 0 then 4.5D else 5.5D end as min_magnitude", "`count` as event_count")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as the vertices of a line."""
    return _events(spark, sf_dir).selectExpr("user_id", "event_id", "((user_id * 37) % 121 - 60) + ((event_id * 7) % 21 - 10) / 20.0D as latitude", "((user_id * 97) % 359 - 179) + ((event_id * 13) % 21 - 10) / 20.0D as longitude")


def trench(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as points of trenches, in the order of their ids: a slab for every 400, a jump after every 97."""
    return _events(spark, sf_dir).selectExpr(
        "event_id",
        "concat('S', (event_id div 400) % 7) as slab",
        "-50 + (event_id % 400) * 0.2D as latitude",
        "((event_id div 400) * 37) % 300 - 160 + (event_id % 400) * 0.1D + ((event_id div 97) % 3) * 3.5D as longitude",
        "(event_id * 53) % 360 as azimuth",
    )


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as steps of boundaries; most end where the next starts, some nearly, some not."""
    return _events(spark, sf_dir).selectExpr(
        "event_id",
        "concat('B', event_id div 50) as boundary",
        "array('SUB', 'OCB', 'CCB', 'OSR', 'CRB', 'OTF', 'CTF')[cast((event_id div 6) % 7 as int)] as cls",
        "((event_id * 7) % 1600) / 10.0D - 80 as start_latitude",
        "((event_id * 11) % 3600) / 10.0D - 180 as start_longitude",
        "(((event_id + 1) * 7) % 1600) / 10.0D - 80 + case when event_id % 11 = 0 then 0.01D when event_id % 13 = 0 then 5e-7D else 0 end as end_latitude",
        "(((event_id + 1) * 11) % 3600) / 10.0D - 180 as end_longitude",
    )


def mirror(spark: SparkSession, sf_dir: str, root: str) -> None:
    """Orders as the features of an archive, written by year under root, in order of time, so that a read of some days skips the rest."""
    from pyspark.sql import functions as F

    o = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(
        "o_orderkey",
        "unix_micros(cast(o_orderdate as timestamp)) div 1000 as time_ms",
        "(40 + (o_orderkey * 37) % 45) / 10.0D as magnitude",
        "(o_orderkey * 7) % 1800 / 10.0D - 90 as latitude",
        "(o_custkey * 11) % 3600 / 10.0D - 180 as longitude",
        "cast(case when o_orderkey % 17 = 0 then null else o_orderkey % 600 end as double) as depth_km",
    )
    properties = F.struct(F.col("magnitude").alias("mag"), F.col("time_ms").alias("time"), (F.col("time_ms") + 300_000).alias("updated"), F.lit("reviewed").alias("status"))
    feature = F.struct(F.concat(F.lit("o"), "o_orderkey").alias("id"), properties.alias("properties"), F.struct(F.array("longitude", "latitude", "depth_km").alias("coordinates")).alias("geometry"))
    rows = o.select("time_ms", "magnitude", F.to_json(feature).alias("feature"), F.year(F.timestamp_millis("time_ms")).alias("year"))
    rows.repartitionByRange("year", "time_ms").sortWithinPartitions("year", "time_ms").write.partitionBy("year").option("parquet.block.size", 16 << 20).parquet(root)


def flares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).where("event_type = 'purchase'").selectExpr(
        "event_id as id",
        "case when event_id % 2 = 0 then 'goes' else 'donki' end as source",
        "unix_micros(cast(ts as timestamp)) div 1000 as peak_ms",
        "case when value < 20 then 'B' when value < 50 then 'C' when value < 150 then 'M' else 'X' end as flare_class",
        "round(value / 20, 1) as magnitude",
    )


def cmes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).where("event_type = 'signup'").selectExpr("event_id as id", "unix_micros(cast(ts as timestamp)) div 1000 as time_ms", "event_id % 2 = 0 as glancing", "event_id % 3 = 0 as minor")


#: Ten lines: one across 180 degrees twice over, one of a single vertex.
LINES = [
    (0, "PA-NA", "OTF", [-130.0, 20.0, -120.0, 35.0, -125.0, 48.0]), (1, "PA-AU", "SUB", [170.0, -40.0, 179.0, -25.0, -176.0, -15.0]), (2, "NA-EU", "OSR", [-30.0, 40.0, -35.0, 55.0]),
    (3, "SA-NZ", "SUB", [-75.0, -40.0, -70.0, -20.0, -81.0, 0.0]), (4, "EU-AF", "CCB", [-10.0, 36.0, 10.0, 38.0, 30.0, 35.0]), (5, "IN-EU", "CCB", [70.0, 30.0, 80.0, 30.0, 92.0, 27.0]),
    (6, "AF-AN", "OSR", [0.0, -50.0, 30.0, -45.0]), (7, "PA-EU", "SUB", [142.0, 35.0, 150.0, 45.0, 178.0, 51.0, -170.0, 52.0]), (8, "HOT", "PT", [100.0, 10.0]), (9, "PA-NA", "SUB", [-105.0, 15.0, -95.0, 14.0]),
]


def lines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LINES, "line int, pair string, cls string, p array<double>")


def segments_values() -> str:
    """The segments of LINES as SQL values."""
    rows = []
    for line, pair, cls, p in LINES:
        pts = list(zip(p[::2], p[1::2]))
        for a, b in zip(pts, pts[1:] or pts):
            rows.append(f"({line}, '{pair}', '{cls}', {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)")
    return "segs(line, pair, cls, ax, ay, bx, b_y) AS (VALUES " + ", ".join(rows) + ")"


EPOCHS = [1900.0 + 5 * k for k in range(26)]


def coefficient_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as the text of a coefficient table: a header, a comment, and a line of ragged columns for each of 195 coefficients.

    The parts that serve are staged first: filters on the text, which come next, would else make it for every part.
    Coefficient i = 1, 2, ... has degree n = floor(sqrt(i)); the first of a degree is g of order 0, then g and h of each order.
    """
    from pyspark.sql import functions as F

    from tremor.operators.tables import written

    width = len(EPOCHS)
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey + 1 as i", "cast(round(p_retailprice * 100) as bigint) % 2000000 as cents", "p_size").where("i <= 195").selectExpr("i", "cast(floor(sqrt(i)) as bigint) as n", "cents", "p_size")
    parts = written(parts, "parts")
    value = f"cast((cents div (n * n) - 1000000 div (n * n) + case when k < {width} then k else 0 end * (p_size % 11) * 100 - case when k = {width} then 700 else 0 end) / 100.0 as decimal(14, 2))"
    spaced = f"array_join(transform(sequence(0, {width}), k -> concat(repeat(' ', 1 + cast(k % 3 as int)), cast({value} as string))), ' ')"
    kind, order = "case when i - n * n = 0 or (i - n * n) % 2 = 1 then 'g' else 'h' end", "(i - n * n + 1) div 2"
    rows = parts.selectExpr(f"concat({kind}, '  ', n, ' ', {order}, {spaced}, '  ') as value")
    head = "g/h n m " + " ".join(map(str, EPOCHS)) + " 2025-30"
    top = parts.agg(F.count("*").alias("c")).select(F.explode(F.array(F.concat(F.lit("# "), "c", F.lit(" coefficients")), F.lit(head))).alias("value"))
    return top.unionByName(rows)
