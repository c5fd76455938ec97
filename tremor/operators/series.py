"""Hourly series: complete grids, threshold episodes, eligible hours, reductions, downsampling, islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremor import constants as K


def hourly_grid(series: DataFrame, start_ms: int, end_ms: int, values: list[str], order: str | None = None) -> DataFrame:
    """Every hour from start to end, ends included; a sample belongs to the hour it falls in, the last of an hour counts."""
    hours = (end_ms - start_ms) // K.HOUR_MS + 1
    spark = series.sparkSession
    idx = F.floor((F.col("time_ms") - start_ms) / K.HOUR_MS).cast("long")
    inside = series.withColumn("idx", idx).where(F.col("idx").between(0, hours - 1))
    last = inside.groupBy("idx").agg(*(F.max_by(v, order or "time_ms").alias(v) for v in values))
    return spark.range(hours).select(F.col("id").alias("idx"), (F.col("id") * K.HOUR_MS + start_ms).alias("time_ms")).join(last, "idx", "left")



def episodes(grid: DataFrame, value: str, threshold: float, above: bool = True, least_hours: int = 1) -> DataFrame:
    """(onset_ms, run_hours) of runs of consecutive hours beyond the threshold; an unmeasured hour ends a run.

    Hours beyond the threshold are few; among them, the hour less its rank is the same within a run.
    """
    hit = grid.where(F.col(value) >= threshold if above else F.col(value) <= threshold)
    island = hit.withColumn("run", F.col("idx") - F.row_number().over(Window.orderBy("idx")))
    return island.groupBy("run").agg(F.min("time_ms").alias("onset_ms"), F.count("*").alias("run_hours")).where(F.col("run_hours") >= least_hours).drop("run")


def eligible(grid: DataFrame, value: str, hours: int = 1) -> DataFrame:
    """(idx, time_ms) of hours from which `hours` hours in the grid are all measured: a join of measured hours with themselves, shifted."""
    measured = grid.where(F.col(value).isNotNull()).select("idx", "time_ms")
    ahead = measured.select(F.explode(F.sequence(F.col("idx") - (hours - 1), F.col("idx"))).alias("idx")).groupBy("idx").agg(F.count("*").alias("n")).where(F.col("n") == hours)
    return measured.join(ahead, "idx").select("idx", "time_ms")


def hourly_mean(df: DataFrame, time_col: str, value: str) -> DataFrame:
    """Mean by hour to one decimal, halves up."""
    return df.where(F.col(value).isNotNull()).groupBy((F.floor(F.col(time_col) / K.HOUR_MS) * K.HOUR_MS).alias("time_ms")).agg((F.floor(F.avg(value) * 10 + 0.5) / 10).alias(value))


def hourly_max(df: DataFrame, time_col: str, value: str) -> DataFrame:
    return df.where(F.col(value) > 0).groupBy((F.floor(F.col(time_col) / K.HOUR_MS) * K.HOUR_MS).alias("time_ms")).agg(F.max(value).alias(value))


def expand_three_hours(df: DataFrame, value: str) -> DataFrame:
    """Each three-hour value as three hourly rows."""
    return df.withColumn("_k", F.explode(F.array(*[F.lit(k) for k in range(3)]))).withColumn("time_ms", F.col("time_ms") + F.col("_k") * K.HOUR_MS).drop("_k")


def downsample(series: DataFrame, buckets: int, peaks: dict[str, str]) -> DataFrame:
    """Buckets of equal numbers of rows: start, and per measure its peak (max or min), lower median and number of measurements.

    Bounds are floor(b * n / k) in floating point. The row number is over the hourly series, of which there are at most a
    million or so in a century.
    """
    n = series.count()
    k = min(buckets, n)
    if k == 0:
        series = series.limit(0)
        k = 1
    numbered = series.withColumn("_r", F.row_number().over(Window.orderBy("time_ms")) - 1)
    step = n / k
    bounds = series.sparkSession.range(k).select(F.col("id").alias("bucket"), F.floor(F.col("id") * F.lit(step)).alias("_lo"), F.least(F.floor((F.col("id") + 1) * F.lit(step)), F.lit(n)).alias("_hi"))
    rows = bounds.withColumn("_r", F.explode(F.sequence("_lo", F.greatest(F.col("_hi") - 1, F.col("_lo"))))).where("_r < _hi")
    out = [F.min("time_ms").alias("start_ms"), F.count("*").alias("hours")]
    for v, how in peaks.items():
        out += [(F.max(v) if how == "max" else F.min(v)).alias(f"{v}_peak"), F.expr(f"percentile_disc(0.5) within group (order by {v})").alias(f"{v}_typical"), F.count(v).alias(f"{v}_measured")]
    return numbered.join(rows, "_r").groupBy("bucket").agg(*out)


def year_ranges(years: DataFrame) -> DataFrame:
    """One row: runs of consecutive years as `1999–2001, 2005`."""
    run = years.distinct().withColumn("g", F.col("year") - F.row_number().over(Window.orderBy("year")))
    text = run.groupBy("g").agg(F.min("year").alias("a"), F.max("year").alias("b")).select("a", F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("–", "a", "b")).alias("t"))
    return text.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("a", "t"))), lambda x: x["t"]), ", ").alias("ranges"))


def track_bins(events: DataFrame, start_ms: int, end_ms: int, bins: int) -> DataFrame:
    """Equal-width bins in time, empty ones kept, the end in the last: count, greatest magnitude and emphasis."""
    width = (end_ms - start_ms) / bins
    hit = events.where(F.col("time_ms").between(start_ms, end_ms)).withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.col("time_ms") - start_ms) / width)).cast("long"))
    counts = hit.groupBy("bin").agg(F.count("*").alias("n"), F.max("magnitude").alias("max_magnitude"))
    full = events.sparkSession.range(bins).select(F.col("id").alias("bin")).join(counts, "bin", "left")
    return full.select("bin", F.coalesce("n", F.lit(0)).alias("n"), "max_magnitude", F.coalesce(F.col("max_magnitude") >= K.EMPHASIS_MAGNITUDE, F.lit(False)).alias("emphasised"))


def peaks(series: DataFrame) -> DataFrame:
    return series.agg(F.max("kp").alias("kp_peak"), F.min("dst").alias("dst_peak"), F.max("wind_speed").alias("wind_peak"))


def measured_fraction(measured: Column, hours: Column) -> Column:
    return F.coalesce(F.try_divide(F.sum(measured), F.sum(hours)), F.lit(1.0))


def distance_runs(points: DataFrame, key: str, order: str, max_km: float) -> DataFrame:
    """Numbers the runs of points of which each is within max_km of the one before: sessions by distance."""
    from tremor.functions.geo import haversine_km

    w = Window.partitionBy(key).orderBy(order)
    gap = haversine_km(F.lag("latitude").over(w), F.lag("longitude").over(w), F.col("latitude"), F.col("longitude"))
    return points.withColumn("_break", F.coalesce((gap > max_km).cast("int"), F.lit(0))).withColumn("run", F.sum("_break").over(w)).drop("_break")
