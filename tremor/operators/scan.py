"""Reads of the catalogue and the hourly series: filters, sorts, counts. All are plain plans that Catalyst pushes down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor import constants as K


def events(df: DataFrame, start_ms: int | None = None, end_ms: int | None = None, min_magnitude: float | None = None) -> DataFrame:
    """Both ends inclusive, newest first."""
    for c in ([F.col("time_ms") >= start_ms] if start_ms is not None else []) + ([F.col("time_ms") <= end_ms] if end_ms is not None else []) + ([F.col("magnitude") >= min_magnitude] if min_magnitude is not None else []):
        df = df.where(c)
    return df.orderBy(F.desc("time_ms"), "event_id")


def events_in_box(df: DataFrame, min_lat: float, max_lat: float, min_lon: float, max_lon: float) -> DataFrame:
    return df.where(F.col("latitude").between(min_lat, max_lat) & F.col("longitude").between(min_lon, max_lon)).orderBy(F.desc("time_ms"), "event_id")


def event_by_id(df: DataFrame, event_id) -> DataFrame:
    return df.where(F.col("event_id") == event_id)


def analysis_catalog(df: DataFrame, min_magnitude: float, start_ms: int, end_ms: int) -> DataFrame:
    """Half open, whole seconds, oldest first."""
    hit = df.where((F.col("magnitude") >= min_magnitude) & (F.col("time_ms") >= start_ms) & (F.col("time_ms") < end_ms))
    return hit.select((F.expr("time_ms div 1000") * 1000).alias("time_ms"), "latitude", "longitude", "magnitude").orderBy("time_ms")


def half_open(df: DataFrame, start_ms: int, end_ms: int, time_col: str = "time_ms", min_magnitude: float | None = None) -> DataFrame:
    hit = df.where((F.col(time_col) >= start_ms) & (F.col(time_col) < end_ms))
    return (hit if min_magnitude is None else hit.where(F.col("magnitude") >= min_magnitude)).orderBy(time_col)


def preferred_flares(df: DataFrame, source: str = "preferred", cutover_ms: int = K.PREFERRED_FLARE_CUTOVER_MS) -> DataFrame:
    """One catalogue before the cutover and the other from it on; `all`, or a source by name."""
    if source == "all":
        return df
    if source != "preferred":
        return df.where(F.col("source") == source)
    return df.where(((F.col("source") == "goes") & (F.col("peak_ms") < cutover_ms)) | ((F.col("source") == "donki") & (F.col("peak_ms") >= cutover_ms)))


def flare_rank(cls: Column) -> Column:
    return F.instr(F.lit(K.FLARE_CLASSES), cls)


def flare_at_least(cls: Column, magnitude: Column, least: str, least_magnitude: float = 1.0) -> Column:
    want = K.FLARE_CLASSES.index(least) + 1
    return (flare_rank(cls) > want) | ((flare_rank(cls) == want) & (magnitude >= least_magnitude))


def is_direct(glancing: Column, minor: Column) -> Column:
    return ~F.coalesce(glancing, F.lit(False)) & ~F.coalesce(minor, F.lit(False))


def is_stormy(kp: Column, dst: Column) -> Column:
    return F.coalesce(kp >= K.STORM_KP, F.lit(False)) | F.coalesce(dst <= K.STORM_DST, F.lit(False))


def band(df: DataFrame, floor: float, next_floor: float | None, cutoff_ms: int | None = None) -> DataFrame:
    hit = df.where(F.col("magnitude") >= floor)
    if next_floor is not None:
        hit = hit.where(F.col("magnitude") < next_floor)
    return hit if cutoff_ms is None else hit.where(F.col("time_ms") >= cutoff_ms)


def playhead(df: DataFrame, trail_start_ms: int, playhead_ms: int) -> DataFrame:
    return df.where(F.col("time_ms").between(trail_start_ms, playhead_ms))


def missed(df: DataFrame, since_ms: int, min_magnitude: float = K.MISSED_MAGNITUDE, limit: int | None = K.MISSED_LIMIT) -> DataFrame:
    """Later than `since`, the largest first; the limit is the report's."""
    hit = df.where((F.col("time_ms") > since_ms) & (F.col("magnitude") >= min_magnitude)).orderBy(F.desc("magnitude"), F.desc("time_ms"), "event_id")
    return hit if limit is None else hit.limit(limit)


def alert(df: DataFrame, now_ms: int, alerted: DataFrame | None = None) -> DataFrame:
    """The latest large event that is young enough and was not alerted before."""
    hit = df.where((F.col("magnitude") >= K.ALERT_MAGNITUDE) & (now_ms - F.col("time_ms") <= K.ALERT_AGE_MINUTES * 60_000))
    if alerted is not None:
        hit = hit.join(alerted.select("event_id"), "event_id", "left_anti")
    return hit.orderBy(F.desc("time_ms"), "event_id").limit(1)


def signature(df: DataFrame, since_ms: int | None = None) -> DataFrame:
    hit = df if since_ms is None else df.where(F.col("time_ms") >= since_ms)
    return hit.agg(F.count("*").alias("n"), F.max("updated_ms").alias("latest_update"))


def coverage(df: DataFrame, time_col: str = "time_ms") -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.min(time_col).alias("first_ms"), F.max(time_col).alias("last_ms"))


def years_present(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).select(F.year(F.timestamp_millis("time_ms")).alias("year")).distinct()


def ledger_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("chunks"), F.coalesce(F.sum("event_count"), F.lit(0)).alias("events"))


def completed_years(ledger: DataFrame, min_magnitude: float) -> DataFrame:
    """A lower floor satisfies a higher request."""
    return ledger.where(F.col("min_magnitude") <= min_magnitude).select("year").distinct()


def missing_years(ledger: DataFrame, first: int, last: int) -> DataFrame:
    wanted = ledger.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    return wanted.join(ledger.select(F.col("year").cast("int").alias("year")).distinct(), "year", "left_anti")


def is_complete(ledger: DataFrame, min_magnitude: float, epoch_year: int, current_year: int) -> DataFrame:
    return missing_years(completed_years(ledger, min_magnitude), epoch_year, current_year - 1).agg((F.count("*") == 0).alias("complete"))


def uncovered_years(ledger: DataFrame, start_ms: int, end_ms: int, now_ms: int, min_magnitude: float = K.ARCHIVE_FLOOR) -> DataFrame:
    """Years of [start, end] that nothing covers: no ledger row at or below the floor, nor the rolling cache.

    The current year counts as covered once any year at that floor is; the cache covers a year whose part of the span lies
    within the last 720 hours.
    """
    spark = ledger.sparkSession
    done = completed_years(ledger, min_magnitude).select(F.col("year").cast("int").alias("year"))
    span = spark.range(1).select(F.explode(F.sequence(F.year(F.timestamp_millis(F.lit(start_ms))), F.year(F.timestamp_millis(F.lit(end_ms))))).alias("year"))
    begun = done.agg((F.count("*") > 0).alias("begun"))
    first_of = lambda y: F.unix_millis(F.make_timestamp(y, *[F.lit(x) for x in (1, 1, 0, 0, 0)]))
    slice_start, slice_end = F.greatest(first_of(F.col("year")), F.lit(start_ms)), F.least(first_of(F.col("year") + 1) - 1, F.lit(end_ms))
    left = span.join(done, "year", "left_anti").join(F.broadcast(begun))
    current = (F.col("year") == F.year(F.timestamp_millis(F.lit(now_ms)))) & F.col("begun")
    cached = (slice_start >= now_ms - K.RETENTION_HOURS * K.HOUR_MS) & (slice_end <= now_ms)
    return left.where(~current & ~cached).select("year")


def planned_chunks(spark, ledger: DataFrame, current_year: int) -> DataFrame:
    """Deep and main chunks less those completed; the current year is never final."""
    deep = spark.range(K.DEEP_EPOCH_YEAR, K.ARCHIVE_EPOCH_YEAR).select(F.col("id").cast("int").alias("year"), F.lit(K.DEEP_FLOOR).alias("min_magnitude"))
    main = spark.range(K.ARCHIVE_EPOCH_YEAR, current_year + 1).select(F.col("id").cast("int").alias("year"), F.lit(K.ARCHIVE_FLOOR).alias("min_magnitude"))
    done = ledger.where(F.col("year") < current_year).select(F.col("year").cast("int").alias("y"), F.col("min_magnitude").alias("m"))
    chunks = deep.unionByName(main)
    return chunks.join(done, (F.col("year") == F.col("y")) & (F.col("m") <= F.col("min_magnitude")), "left_anti")


def page(df: DataFrame, order: list[Column], first: int, rows: int) -> DataFrame:
    """Rows [first, first + rows) of an order: what a list in view shows."""
    return df.orderBy(*order).offset(first).limit(rows)
