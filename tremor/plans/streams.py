"""Queries of streams over the supplied tables: independent streams into one table, alerts by state, the digest on start."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremor import constants as K
from tremor.operators.tables import new_folder
from tremor.plans.catalogue import DAY, START_MS, query
from tremor.sources import fixtures as X
from tremor.sources.fixtures import QUAKES_SQL, SERIES_SQL
from tremor.streaming import alerts as A
from tremor.streaming import feeds as S

TABLE = "time_ms long, kp double, dst double, wind_speed double"


def _stream(spark, d):
    """The events as a stream of files; a pattern, since a stream's path must not be a single file."""
    return spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.parque[t]")


@query(f"WITH {SERIES_SQL} SELECT time_ms, round(kp, 6) AS kp, round(dst, 6) AS dst, round(wind_speed, 6) AS wind_speed FROM series WHERE kp IS NOT NULL OR dst IS NOT NULL OR wind_speed IS NOT NULL")
def merged_streams(spark, d):
    """Three streams of the events, each measuring a column of the hours of one table."""
    hour = F.expr("unix_micros(cast(date_trunc('hour', ts) as timestamp)) div 1000").alias("time_ms")
    measures = {"kp": ("view", F.max("value") / 40), "dst": ("error", -F.max("value")), "wind_speed": ("click", 300 + 5 * F.max("value"))}
    streams = {n: _stream(spark, d).where(F.col("event_type") == kind) for n, (kind, _) in measures.items()}
    prepare = {n: (lambda batch, n=n, m=m: batch.groupBy(hour).agg(m.alias(n))) for n, (_, m) in measures.items()}
    table = S.VersionedTable(spark, new_folder(spark, "hours"), TABLE)
    failed = {n: e for n, e in S.poll(streams, prepare, table, "time_ms", new_folder(spark, "checkpoints")).items() if e}
    if failed:
        raise RuntimeError(str(failed))
    table.compact(keep=1)
    return table.read().select("time_ms", *(F.round(c, 6).alias(c) for c in ("kp", "dst", "wind_speed")))


@query(f"""WITH {QUAKES_SQL}, large AS (SELECT *, source || ':' || (user_id % 40) AS key, updated_ms AS at_ms FROM quakes JOIN events USING (event_id) WHERE magnitude >= {K.ALERT_MAGNITUDE}),
timed AS (SELECT *, max(at_ms) OVER (PARTITION BY key) AS now FROM large), ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY time_ms DESC, CAST(event_id AS VARCHAR) DESC) AS r FROM timed WHERE now - time_ms <= {K.ALERT_AGE_MINUTES * 60000})
SELECT key, CAST(event_id AS VARCHAR) AS event_id, round(magnitude, 6) AS magnitude, time_ms FROM ranked WHERE r = 1""")
def standing_alerts(spark, d):
    """The alerts that one batch of all events announces, a key for every network and fortieth of the users."""
    quake = X.quakes_of(_stream(spark, d), "user_id")
    inputs = quake.selectExpr("concat(source, ':', user_id % 40) as key", "'event' as kind", "cast(event_id as string) as event_id", "magnitude", "time_ms", "updated_ms as at_ms")
    out, name = new_folder(spark, "alerts"), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, A.ROCKS)
    try:
        A.alert_changes(inputs).writeStream.format("parquet").option("path", out).option("checkpointLocation", new_folder(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
    changes = spark.read.schema(A.ALERT).parquet(out)
    return A.current_alerts(changes.where("change <> 'expired'")).withColumn("magnitude", F.round("magnitude", 6))


@query(f"""WITH {QUAKES_SQL}, mark AS (SELECT {START_MS} + CAST(count(*) % 20 AS BIGINT) * {DAY} AS since_ms FROM orders), missed AS (SELECT * FROM quakes, mark WHERE magnitude >= {K.MISSED_MAGNITUDE} AND time_ms > since_ms),
ranked AS (SELECT *, row_number() OVER (ORDER BY magnitude DESC, time_ms DESC, event_id) AS rank, count(*) OVER () AS total FROM missed)
SELECT since_ms, total, CAST(rank AS INTEGER) AS rank, event_id, round(magnitude, 6) AS magnitude FROM ranked WHERE rank <= {K.MISSED_LIMIT}""")
def start_digest(spark, d):
    mark = spark.read.parquet(f"{d}/orders.parquet").agg(F.count("*").alias("c")).select(F.lit(A.SEEN_THROUGH).alias("key"), (START_MS + F.col("c") % 20 * DAY).cast("string").alias("value"), F.lit(0).cast("long").alias("updated_ms"))
    found = A.digest(X.quakes(spark, d), mark)
    return found.select("since_ms", "total", F.posexplode("events").alias("at", "e")).select("since_ms", "total", (F.col("at") + 1).cast("int").alias("rank"), "e.event_id", F.round("e.magnitude", 6).alias("magnitude"))
