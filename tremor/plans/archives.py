"""Queries of paged loading: a mirror of the supplied orders in files, fetched by pages into an archive with its ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremor.operators.tables import new_folder
from tremor.plans.catalogue import query
from tremor.sources import archive as A
from tremor.sources import fixtures as X
from tremor.sources.fixtures import ARCHIVED_SQL

NOW_MS = 993_945_600_000  # 2001-07-01
TIERS = ((1994, 1996, 7.5), (1997, None, 4.5))
PAGE_ROWS = 500


def _filled(spark, d):
    mirror = new_folder(spark, "mirror")
    X.mirror(spark, d, mirror)
    archive = A.Archive(spark, new_folder(spark, "archive"))
    progress = A.backfill(archive, A.file_pages(mirror), NOW_MS, tiers=TIERS, page_rows=PAGE_ROWS)
    if progress.state != "complete":
        raise RuntimeError(progress.error)
    return archive


CHUNKS_SQL = f"""WITH {ARCHIVED_SQL}, chunks AS (
    SELECT y AS year, CASE WHEN y < 1997 THEN 7.5 ELSE 4.5 END AS min_magnitude FROM range(1994, 2002) t(y)
), held AS (
    SELECT c.year, c.min_magnitude, a.* EXCLUDE (o_orderkey), 'o' || o_orderkey AS event_id FROM chunks c JOIN archived a ON a.magnitude >= c.min_magnitude AND year(make_timestamp(time_ms * 1000)) = c.year
)"""


@query(f"""{CHUNKS_SQL} SELECT CAST(c.year AS INTEGER) AS year, CAST(c.min_magnitude AS DOUBLE) AS min_magnitude, CASE WHEN c.year < 2001 THEN count(h.event_id) END AS event_count, count(h.event_id) AS stored, min(h.time_ms) AS first_ms, max(h.time_ms) AS last_ms
FROM chunks c LEFT JOIN held h USING (year, min_magnitude) GROUP BY c.year, c.min_magnitude""")
def archive_backfill(spark, d):
    archive = _filled(spark, d)
    ms = F.unix_millis("time_utc")
    held = archive.events().groupBy("year", "min_magnitude").agg(F.count("*").alias("stored"), F.min(ms).alias("first_ms"), F.max(ms).alias("last_ms"))
    both = archive.ledger().select("year", "min_magnitude", "event_count").join(held, ["year", "min_magnitude"], "full")
    return both.select(F.col("year").cast("int").alias("year"), F.col("min_magnitude").cast("double").alias("min_magnitude"), "event_count", F.coalesce("stored", F.lit(0)).alias("stored"), "first_ms", "last_ms")


@query(f"{CHUNKS_SQL} SELECT event_id, CAST(year AS INTEGER) AS year, time_ms, round(magnitude, 6) AS magnitude, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, CAST(depth_km AS DOUBLE) AS depth_km FROM held")
def archive_events(spark, d):
    e = _filled(spark, d).events()
    return e.select("event_id", F.col("year").cast("int").alias("year"), F.unix_millis("time_utc").alias("time_ms"), *(F.round(c, 6).alias(c) for c in ("magnitude", "latitude", "longitude")), "depth_km")
